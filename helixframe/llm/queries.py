"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import secrets
import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, merkle, packing, pseudonyms, quality, rank_search, substring_dedup, tiktoken_codec, token_count, token_files, url_filter, warc
from .common import fresh, saved, scratch, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = saved(_table(spark, sf_dir, "documents").select("doc_id", quality.text_statistics(F.col("text")).alias("counts")), "statistics")
    out, name = quality.judge(counted, statistics="counts")
    q = F.col(name)
    return out.select("doc_id", q.n_words.alias("n_words"), q.word_chars.alias("word_chars"), q.n_symbols.alias("n_symbols"), q.n_dup_lines.alias("n_dup_lines"), q.n_repeat_words.alias("n_repeat_words"), q.base_failed.alias("base_failed"), q.kept.alias("kept"), q.posterior.alias("posterior"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_digest(spark, path)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents")).withColumnRenamed("component", "component_id")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.responses(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return made.select("page_id", warc.derive(F.col("response")).alias("d")).select("page_id", "d.*")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_session_keys: dict[str, str] = {}


def pseudonym_key(spark: SparkSession) -> str:
    """The permutation's key: spark.helixframe.pseudonyms.key, or without that setting a random one that ends with the application."""
    own = _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return spark.conf.get("spark.helixframe.pseudonyms.key", own)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark), found_col="n_private")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = decontaminate.match_benchmark(docs, _table(spark, sf_dir, "benchmark"))
    c = F.col(name)
    hit = fresh(out, "hit")
    out = out.select("doc_id", name, decontaminate.n_hit(c).alias(hit))
    n = F.col(hit)
    return out.select("doc_id", c.n_words.alias("n_words"), n.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(c["items"]), ",").cast("binary"), 256).alias("items_sha256"), ((n > 0) & (20 * n >= c.n_words)).alias("contaminated"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    r = tiktoken_codec.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", r.alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


URL_RULES = [url_filter.Rule.parse(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]
#: The list of unwanted URLs: those on three hosts, and those that carry a tracking field. Pages under other spellings of them are listed too.
LISTED_HOSTS, LISTED_FIELDS = r"(^|\.)(spam-farm|cheap-pills|casino-win)\.", r"[?&](utm_[^=&#]*|ref)="


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS) | F.col("url").rlike(LISTED_FIELDS)).select("url")
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = merkle.leaf(*[lower if f == "text" else F.col(f) for f in LEAF_FIELDS])
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    rows = merkle.manifest(docs, LEAF_FIELDS, other=other).proofs()
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
    packed = packing.pack(pieces, 1024)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc32").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op13_rank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_token_files, op4_jaccard_join, op5_warc_derivatives, op6_token_counts, op7_pseudonyms, op8_decontamination, op9_byte_bpe, op10_url_filter, op11_merkle_manifest, op12_best_fit_packing, op13_rank_search)}

_OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (s)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS x FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.x, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10_SQL = r"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, list_sort([x for x in string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&') if x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')]) AS fields FROM p),
c AS (SELECT page_id, url, host, path, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical FROM q),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND (regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|casino-win)\.') OR regexp_matches(url, '[?&](utm_[^=&#]*|ref)='))),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT c.page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM c LEFT JOIN fit USING (page_id) LEFT JOIN listed ON c.canonical = listed.canonical
"""



def _merkle_sql(depth: int = 5, top_depth: int = 3) -> str:
    """Trees of `depth` levels of 16 hold a million leaves a source, those of `top_depth` 4,096 sources."""

    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"

    def levels(p: str, first: str, n: int) -> list[str]:
        out = [f"{p}n0 AS ({first})"]
        for k in range(n):
            out.append(f"{p}r{k} AS (SELECT key, idx // 16 AS run, any_value(n) AS n, list(d ORDER BY idx) AS ds FROM {p}n{k} WHERE n > 1 GROUP BY key, idx // 16)")
            out.append(f"{p}n{k + 1} AS (SELECT key, run AS idx, (n + 15) // 16 AS n, sha256(array_to_string(ds, '')) AS d FROM {p}r{k} UNION ALL SELECT key, idx, n, d FROM {p}n{k} WHERE n = 1)")
        return out

    def climb(p: str, first: str, n: int) -> list[str]:
        out = [f"{p}p0 AS ({first})"]
        for k in range(n):
            before, after = "coalesce(array_to_string(ds[1:idx % 16], ''), '')", "coalesce(array_to_string(ds[idx % 16 + 2:], ''), '')"
            out.append(f"{p}p{k + 1} AS (SELECT doc_id, leaf, src, subroot, a.key, idx // 16 AS idx, proof || {before} || {after} AS proof, CASE WHEN ds IS NULL THEN x ELSE sha256({before} || x || {after}) END AS x FROM {p}p{k} a LEFT JOIN {p}r{k} r ON r.key = a.key AND r.run = a.idx // 16)")
        return out

    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    names = LEAF_FIELDS[:-1]
    head = " || ".join(field(x) for x in names)
    table = "SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c FROM range(256) t(i)"
    for _ in range(8):
        table = f"SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) AS c FROM ({table})"
    parts = [
        f"codes AS ({table})",
        "ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL)",
        "crc AS (SELECT s, 0 AS pos, CAST(4294967295 AS BIGINT) AS c FROM ids UNION ALL SELECT s, pos + 1, xor(crc.c >> 8, codes.c) FROM crc JOIN codes ON codes.i = xor(crc.c & 255, CAST(ascii(s[pos + 1]) AS BIGINT)) WHERE pos < length(s))",
        "tampered AS (SELECT s FROM crc WHERE pos = length(s) AND xor(c, 4294967295) % 5 = 0)",
        f"docs AS (SELECT doc_id, coalesce('=' || source, '') AS key, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field('low')}) AS low FROM (SELECT *, translate(text, '{upper}', '{lower}') AS low FROM documents))",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM docs)",
        *levels("s", "SELECT key, idx, n, leaf AS d FROM placed", depth),
        *levels("t", f"SELECT '' AS key, row_number() OVER (ORDER BY encode(key)) - 1 AS idx, count(*) OVER () AS n, d FROM sn{depth}", top_depth),
        *climb("s", f"SELECT doc_id, leaf, placed.key AS src, sn{depth}.d AS subroot, placed.key, placed.idx, '' AS proof, CASE WHEN t.s IS NULL THEN leaf ELSE low END AS x FROM placed JOIN sn{depth} USING (key) LEFT JOIN tampered t ON t.s = CAST(doc_id AS VARCHAR)", depth),
        *climb("t", f"SELECT doc_id, leaf, src, subroot, '' AS key, o.idx, proof, x FROM sp{depth} JOIN (SELECT key, row_number() OVER (ORDER BY encode(key)) - 1 AS idx FROM sn{depth}) o ON o.key = src", top_depth),
    ]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.d AS verified FROM tp{top_depth}, tn{top_depth} r"


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * c.n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * tf.n * c.n) // c.l)))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN df USING (t), c GROUP BY item, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1_SQL, "op4_jaccard_join": _OP4_SQL, "op8_decontamination": _OP8_SQL, "op10_url_filter": _OP10_SQL, "op11_merkle_manifest": _merkle_sql(), "op13_rank_search": _OP13_SQL}
