"""Each registered query on small tables of its own: odd and long texts, nulls, repeats, clashing columns, and empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import tiktoken_codec, warc
from helixframe.llm.queries import QUERIES

from . import brute
from .test_text_operators import near_texts, odd_texts

LONG = [" " * 1_000_000 + "a", "word " * 40_000 + "\n" * 5000 + "end", "".join(chr(97 + k * k % 26) for k in range(300_000)), " ".join(f"w{k % 5000}" for k in range(120_000))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    texts = [None, "", *near_texts(60, seed=11), *odd_texts(40, seed=12), *LONG]
    texts += texts[5:9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS mark", "'x' AS quality", "3 AS n_words", "4 AS host", "5 AS tokens", "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id = 16 THEN '' WHEN doc_id % 3 = 0 THEN 'é' ELSE concat('s', doc_id % 4) END AS source", "'en' AS lang", "nullif(doc_id % 5, 2) AS n_chars", "6 AS key", "7 AS digest", "8 AS other", "9 AS path", "10 AS part")
    docs.repartition(3).write.parquet(f"{d}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{d}/none/documents.parquet")
    items = [(i, t) for i, t in enumerate([*texts[3:12], None, "", "word word", " ".join(f"w{k}" for k in range(40))])] + [(None, "w7 w8")]
    bench = spark.createDataFrame([(None if i is None else f"b{i}", t) for i, t in items], "item_id string, text string")
    pages = spark.createDataFrame([(i, f"http://a.org/{i}" if i % 3 else None, t) for i, t in enumerate(texts[:40])], "page_id long, url string, html string").selectExpr("*", "1 AS response", "2 AS status")
    for name, table in (("benchmark", bench), ("pages", pages)):
        table.write.parquet(f"{d}/some/{name}.parquet")
        table.limit(0).write.parquet(f"{d}/none/{name}.parquet")
    return d, texts, [(r.item_id, r.text) for r in bench.collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, tables, name):
    assert QUERIES[name](spark, f"{tables[0]}/none").count() == 0


def _rows(spark, tables, name):
    rows = QUERIES[name](spark, f"{tables[0]}/some").collect()
    return {r[0]: r for r in rows}


def test_op1(spark, tables):
    got = _rows(spark, tables, "op1_substring_dedup")
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(tables[1]))] == brute.substring_dedup(tables[1], 35)


def test_op2(spark, tables):
    got = _rows(spark, tables, "op2_quality_rules")
    for i, t in enumerate(tables[1]):
        s, n = brute.statistics(t), got[i]
        assert (n.n_words, n.word_chars, n.n_symbols, n.n_dup_lines, n.n_repeat_words) == s
        assert n.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and n.kept == (not n.base_failed and n.posterior >= 0.5)


def test_op3(spark, tables):
    got, t, start = _rows(spark, tables, "op3_token_files"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i, text in enumerate(tables[1]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4(spark, tables):
    got = _rows(spark, tables, "op4_jaccard_join")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.jaccard_components(list(enumerate(tables[1])), 3, 9, 10)


def test_op5(spark, tables):
    got = _rows(spark, tables, "op5_warc_derivatives")
    for i, html in enumerate(tables[1][:40]):
        r, page = got[i], warc.Page((html or "").encode().decode())
        payload = warc.digest((html or "").encode())
        assert (r.status, r.text, r.title, r.n_links, r.payload_ok, r.payload_digest) == ("ok", page.text, page.title, len(page.links), True, payload)
        for kind in ("metadata", "conversion"):
            names, _, _ = warc.parse(bytes(r[kind]))
            assert names["warc-refers-to"] == r.refers_to == r.response_id and names["warc-payload-digest"] == payload and names.get("warc-target-uri") == r.target_uri
        assert warc.parse(bytes(r.conversion))[2].decode() == r.text


def test_op6(spark, tables):
    got, t = _rows(spark, tables, "op6_token_counts"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in enumerate(tables[1]):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)


def test_op7(spark, tables):
    got = _rows(spark, tables, "op7_pseudonyms")
    assert all(got[i].text == t and got[i].n_private == 0 for i, t in enumerate(tables[1]) if not any(c in "@0123456789" for c in t or ""))
    assert (got[0].text, got[0].n_private, got[1].text) == (None, 0, "")


def test_op8(spark, tables):
    got = _rows(spark, tables, "op8_decontamination")
    want = brute.decontaminate(tables[1], tables[2], 13)
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i in range(len(want))] == want


def test_op9(spark, tables):
    got = _rows(spark, tables, "op9_byte_bpe")
    enc = tiktoken_codec.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, text in enumerate(tables[1]):
        raw = (text or "").encode()
        assert got[i].decoded_sha256 == hashlib.sha256(raw).hexdigest()
        if not raw.startswith(b" " * 1000):  # the library's regex runs out of stack there
            ids = enc.encode_ordinary(text or "")
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))))
    assert got[tables[1].index(LONG[0])].n_tokens == 1_000_000


def test_op11(spark, tables):
    got = _rows(spark, tables, "op11_merkle_manifest")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{tables[0]}/some/documents.parquet").collect()]
    want = brute.merkle(rows, 16, lambda r: r[:4] + (brute.lower(r[4]) if r[4] is not None else None,) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else None)
    assert sorted(tuple(r) for r in got.values()) == sorted(want)
    assert 0 < sum(not r.verified for r in got.values()) < len(rows)


def test_op12(spark, tables):
    rows = QUERIES["op12_best_fit_packing"](spark, f"{tables[0]}/some").collect()
    t, want, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i, text in enumerate(tables[1]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        total += len(ids)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) <= -(-total // 1024) + 3


def test_op13(spark, tables):
    rows = QUERIES["op13_rank_search"](spark, f"{tables[0]}/some").collect()
    want = brute.rank_search(list(enumerate(tables[1])), tables[2], 20)
    assert sorted((str(r.item_id), r["rank"], r.doc_id, r.score) for r in rows) == sorted((str(i), *x) for (i, _), best in zip(tables[2], want) for x in best)
