"""Operators on texts against plain versions: random texts, odd characters, nulls, empties, repeats, long texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import decontaminate, jaccard_join, quality, substring_dedup, tiktoken_codec, token_count, token_files

from . import brute

ODD = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "a", "B", "é", "ß", "1", "22", ".", "!!", "'s", "'LL", "<|endoftext|>", "日本", "\U0001f600", "́", "\x00", "\r\n", "-", "_", "Σ"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(n)]


def near_texts(n, seed=2):
    """Copies, near copies, shared passages, short and empty texts, nulls."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeFGé") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.choice((3, 12, 40, 90)))] for _ in range(n // 6)]
    passage = [word() for _ in range(45)]
    out = [None, "", " \n\t", "one", "one two"]
    while len(out) < n:
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 5))):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            at = r.randrange(len(w))
            w[at:at] = passage[r.randrange(10) :]
        out.append(r.choice((" ", "\n", "  ")).join(w))
    return out


def frame(spark, texts, extra=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", "1 AS n_words", "'x' AS Mark", "2 AS id", "3 AS quality")


@pytest.mark.parametrize("n,seed", [(3, 2), (12, 8), (35, 8)])
def test_substring_dedup(spark, n, seed):
    texts = near_texts(150) + odd_texts(30)
    texts += texts[10:14]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts), n=n, seed=seed).collect()}
    assert [got[i] for i in range(len(texts))] == brute.substring_dedup(texts, n)


def test_substring_dedup_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (None, text), (1, text + " tail"), (1, "other"), (1, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(-1, 40, 40), (-1, 40, 40), (1, 1, 0), (1, 1, 0), (1, 41, 40)]


def test_statistics(spark):
    texts = odd_texts(100) + near_texts(40) + ["a b c d e a b c d e", "x\nx\n \n \nx y\nx y", "# $ <b> é"]
    out, name = quality.judge(frame(spark, texts))
    got = {r.doc_id: r[name] for r in out.collect()}
    for i, t in enumerate(texts):
        s = got[i]
        n, chars, symbols, lines, repeats = brute.statistics(t)
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert s.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (s.base_failed and s.kept)


def test_label_model_against_plain_em():
    r = np.random.default_rng(4)
    kind = r.choice(4, 4000, p=[0.85, 0.08, 0.05, 0.02])  # 0 is good; 1, 2 and 3 fail one rule each
    votes = r.choice([0, 2, 3], (4000, 5), p=[0.95, 0.04, 0.01])
    for k in (1, 2, 3):
        votes[(kind == k) & (r.random(4000) < 0.95), k - 1] = 3
    votes[r.random((4000, 5)) < 0.1] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    options = dict(good=(0.9, 0.08, 0.02), failure=(0.1, 0.2, 0.7), weight=0.3, smooth=0.5)
    m = quality.fit_label_model(patterns, counts.astype(float), **options)
    want = brute.label_model([tuple(p) for p in patterns.tolist()], counts.tolist(), **options)
    assert np.abs(m.posterior(patterns) - np.array(want)).max() < 1e-6
    kept = m.posterior(votes) >= 0.5
    assert kept[kind == 0].mean() > 0.94 and kept[kind > 0].mean() < 0.3  # a seventh of the failures got no bad vote
    doubtful = (votes == 2).any(axis=1) & ~(votes == 3).any(axis=1)
    assert kept[doubtful].mean() > 0.8
    assert m.accuracy().min() > 0.9 and np.allclose(m.votes.sum(axis=2), 1) and m.prior.sum() == pytest.approx(1)
    free = quality.fit_label_model(patterns, counts.astype(float), weight=0.0)
    assert not np.allclose(free.votes[0], m.votes[0], atol=1e-3)  # the votes move what the priors say


def test_verdicts_on_all_documents(spark):
    """Rules know nothing of the labels. The verdict is not that of a filter that all rules must pass, and agrees with labels no less."""
    d = "/root/testdata/sf0.1"
    out, name = quality.judge(spark.read.parquet(f"{d}/documents.parquet"))
    q = F.col(name)
    votes = F.array(*[F.floor(q.pattern / 4**k) % 4 for k in range(8)])
    judged = out.select("doc_id", q.kept.alias("kept"), q.base_failed.alias("failed"), q.posterior.alias("p"), q.pattern.alias("code"), votes.alias("votes")).cache()
    rows = judged.filter("NOT failed").collect()
    one_doubt = [r for r in rows if sorted(r.votes) == [0] * 7 + [2]]
    assert one_doubt and all(r.kept for r in one_doubt)
    all_good = lambda r: max(r.votes) <= 1
    assert sum(r.kept != all_good(r) for r in rows) > 100
    labelled = judged.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    agree = lambda f: sum(f(r) == bool(r["quality"]) for r in labelled)
    model, strict = agree(lambda r: r.kept), agree(lambda r: not r.failed and all_good(r))
    assert model >= 3898 and model > strict
    counts = {r["code"]: r["count"] for r in judged.groupBy("code").count().collect()}
    codes = sorted(counts)
    want = dict(zip(codes, brute.label_model([tuple(c // 4**k % 4 for k in range(8)) for c in codes], [counts[c] for c in codes], rounds=600)))
    assert all(abs(want[r.code] - r.p) < 1e-4 for r in judged.select("code", "p").distinct().collect())


def test_quality_does_not_drop_by_length(spark):
    """Clean texts of over 100,000 words are kept, whatever share of them is new words; long junk is not."""
    r = np.random.default_rng(5)

    def text(vocabulary, n):
        return " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}en" for k in r.integers(0, vocabulary, n).tolist())

    clean, junk = [text(5000, 120_000), text(16_000, 120_000), text(5000, 100_000), text(1500, 30_000)], [text(20, 120_000), "ab cd " * 60_000]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out, name = quality.judge(docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(clean + junk)], docs.schema)))
    kept = dict(out.filter("doc_id < 0").select("doc_id", F.col(name).kept).collect())
    assert [kept[-1 - i] for i in range(len(clean + junk))] == [True] * len(clean) + [False] * len(junk)


def test_distinct_words_by_window(spark):
    texts = [" ".join(str(k % m) for k in range(n)) for n, m in ((0, 1), (1, 1), (999, 700), (1000, 700), (1001, 700), (2500, 3000), (2500, 10))]
    out, name = quality.judge(frame(spark, texts))
    got = dict(out.select("doc_id", F.col(name).n_distinct).collect())
    words = [t.split() for t in texts]
    assert [got[i] for i in range(len(texts))] == [sum(len(set(w[k : k + 1000])) for k in range(0, len(w), 1000)) for w in words]


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert quality.judge(none)[0].count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert token_count.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert decontaminate.decontaminate(none, none.selectExpr("doc_id AS item_id", "text")).count() == 0


@pytest.mark.parametrize("k,num,den,subspaces", [(3, 9, 10, "parts"), (5, 4, 5, "singles"), (2, 4, 5, "parts"), (1, 1, 2, "singles"), (1, 1, 2, "parts")])
def test_jaccard_components(spark, k, num, den, subspaces):
    texts = near_texts(140, seed=5) + odd_texts(10)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard_join.jaccard_components(frame(spark, texts), k=k, threshold=jaccard_join.Threshold(num, den), subspaces=subspaces).collect()}
    assert got == brute.jaccard_components(rows, k, num, den)


@pytest.mark.parametrize("subspaces,bits", [("singles", 64), ("parts", 64), ("parts", 11)])
def test_jaccard_recursion(spark, subspaces, bits):
    """Small regions force recursion and copies of boundary sets; short keys force clashes."""
    texts = near_texts(160, seed=8) + odd_texts(10)
    small = jaccard_join.Voronoi(block=4, fan=3, depth=2, chunk=16, shrink=1.0)
    out = jaccard_join.jaccard_components(frame(spark, texts), k=1, threshold=jaccard_join.Threshold(4, 5), subspaces=subspaces, voronoi=small, key_bits=bits)
    assert {r.doc_id: (r.n_shingles, r.component) for r in out.collect()} == brute.jaccard_components(list(enumerate(texts)), 1, 4, 5)


@pytest.mark.parametrize("elements", [1 << 18, 500])
def test_near_copies_make_no_row_a_pair(spark, monkeypatch, elements):
    """A group of near copies, whose linked pairs grow with its square, makes rows in proportion to its sets."""
    monkeypatch.setattr(jaccard_join, "ELEMENTS", elements)
    monkeypatch.setattr(jaccard_join, "STRIP", 64)
    rows, r = [], random.Random(3)
    for i in range(150):
        words = [f"w{j}" for j in range(60)]
        for j in r.sample(range(20), 4):
            words[j] = f"own{i}x{j}"
        rows.append(" ".join(words))
    t, made, near, linked = jaccard_join.Threshold(4, 5), [], jaccard_join._candidates, jaccard_join._region_links
    monkeypatch.setattr(jaccard_join, "_candidates", lambda *x: (made.append(near(*x).count() / x[0].count()), near(*x))[1])
    monkeypatch.setattr(jaccard_join, "_region_links", lambda *x: (made.append(linked(*x).count() / x[0].count()), linked(*x))[1])
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard_join.jaccard_components(frame(spark, rows), k=1, threshold=t, subspaces="singles").collect()}
    assert got == brute.jaccard_components(list(enumerate(rows)), 1, 4, 5)
    assert len(made) == 2 and made[0] <= 1 and made[1] <= (1 if elements > 500 else 20)


def test_keep_one(spark):
    texts = near_texts(80, seed=6)
    df = frame(spark, texts)
    kept = jaccard_join.keep_one(df.unionByName(df.filter("doc_id % 7 = 0")), k=3)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    want = brute.jaccard_components(list(enumerate(texts)), 3, 9, 10)
    empty = [i for i, (n, _) in want.items() if n == 0]
    assert sorted(set(got)) == sorted({c for n, c in want.values() if n} | set(empty))
    full = [i for i in got if i not in empty]
    assert len(full) == len(set(full))


def test_decontamination(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((1, 3, 13, 20))))) for i in range(12)] + [(12, None), (13, ""), (14, "É-a b"), (3, "again w1 w2")]
    texts = [None, "", "W1, w2!"] + [" ".join(r.choice(words) for _ in range(50)) + ". " + (r.choice(items)[1] or "").upper() + r.choice((" end", "")) for _ in range(60)] + odd_texts(20)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate(texts, items, 13)
    for size in (16 << 20, 60):  # one block, many blocks
        out, name = decontaminate.match_benchmark(frame(spark, texts), bench, block_bytes=size)
        c = F.col(name)
        rows = out.select("doc_id", c.n_words.alias("n"), decontaminate.n_hit(c).alias("h"), F.sort_array(c["items"]).alias("i"), decontaminate.contaminated(c).alias("bad")).collect()
        got = {x.doc_id: (x.n, x.h, len(x.i), brute.sha(",".join(x.i)), x.bad) for x in rows}
        assert [got[i] for i in range(len(texts))] == want
    kept = {x.doc_id for x in decontaminate.decontaminate(frame(spark, texts), bench).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[4]}


def test_cut_spans(spark):
    bench = spark.createDataFrame([(1, "secret words of the test")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before, SECRET words-of the test! After"), (2, None), (3, "secret words")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert got == {1: "Before, ! After", 2: None, 3: "secret words"}


@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_token_counts(spark, chunk):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts(200) + near_texts(30) + [None, "", "x" * 50_000, "<|startoftext|> I'll <|endoftext|>"]
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, texts), path, chunk_bytes=chunk, limit=20).collect()}
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 20), repr(text)


def test_token_counts_repeated_long_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "ab cd " * 20)] * 3, "doc_id long, text string")
    assert [r.n_tokens for r in token_count.count_tokens(df, path, chunk_bytes=16).collect()] == [len(Tokenizer.from_file(path).encode("ab cd " * 20, add_special_tokens=False).ids)] * 3


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = odd_texts(150) + near_texts(60) + [None, ""]
    df = frame(spark, texts).unionByName(frame(spark, [texts[3]]))
    token_files.write_tokens(df, str(tmp_path / "t"), path, files=4)
    rows = sorted(token_files.token_digest(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    t, start = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in rows] == sorted([*range(len(texts)), 0])
    for r in rows:
        want = {zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for x in ([texts[0], texts[3]] if r.doc_id == 0 else [texts[r.doc_id]])}
        assert r.start == start and r.ids_crc32 in want
        start += r.n_tokens
    df.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    assert token_files.input_bytes(df) == 0 < token_files.input_bytes(stored)
    token_files.write_tokens(stored, str(tmp_path / "by_volume"), path, file_bytes=token_files.input_bytes(stored) // 11)
    assert sorted(token_files.token_digest(spark, str(tmp_path / "by_volume")).collect()) == sorted(rows)
    assert spark.read.parquet(str(tmp_path / "by_volume")).select(F.input_file_name()).distinct().count() > 8
    import pyarrow.parquet as pq

    f = pq.ParquetFile(next((tmp_path / "t").glob("part-*.parquet")))
    col = f.metadata.row_group(0).column(3)
    assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(col.encodings) and col.has_offset_index and f.metadata.row_group(0).column(0).has_column_index


def test_encoder_stays_exact_when_full():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), token_files.Encoder(path, max_pieces=50)
    texts = odd_texts(400, seed=9)
    for i in range(0, 400, 20):
        raw, offs, _ = token_files.flat(pa.array(texts[i : i + 20]))
        ids, n = e.encode(raw[: offs[-1]], offs)
        assert ids.tolist() == [x for s in texts[i : i + 20] for x in t.encode(s, add_special_tokens=False).ids]


def test_tiktoken(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tiktoken_codec.codec(path, pattern)
    texts = odd_texts(300) + near_texts(20) + [None, "", " ".join(odd_texts(200)), "y" * 3000]
    rows = frame(spark, texts).select("doc_id", tiktoken_codec.round_trip(F.col("text"), path, pattern).alias("r"), tiktoken_codec.decode_bytes(tiktoken_codec.encode_ids(F.col("text"), path, pattern), path, pattern).alias("raw")).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.r.n_tokens, r.r.ids_sha256, r.r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), hashlib.sha256(t.encode()).hexdigest())
        assert bytes(r.raw) == t.encode()
    for t in texts:
        assert tiktoken_codec.encode(enc, t or "", size=5) == enc.encode_ordinary(t or "")


def test_page_scan_is_cheap_and_unchanged():
    from helixframe.llm import warc

    class Chars(str):
        def __iter__(self):
            raise AssertionError("a page is gone through by character")

    page = warc.Page(Chars("<HEAD><Title>İ T</TITLE></HEAD>\t a  İ\n \n<A HREF='x > y'>b</A> \xa0c<SCRIPT>İ s</Script> d"))
    assert (page.title, page.links, page.text) == ("İ T", ["x > y"], "a İ b c d")
