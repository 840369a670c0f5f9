"""Each stage against its plain version, on its own input; columns, and what clean documents keep."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from helixframe.llm import quality
from helixframe.llm.common import saved

from . import brute
from .test_native_operators import pseudonym

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    spark.conf.set("spark.helixframe.pseudonyms.key", "of the test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0)], docs.schema))
    docs = docs.unionByName(odd)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, SF), name)
        if name != "token_ids":
            assert after.columns == columns
        steps[name] = ({(r.doc_id, r.text): r for r in docs.collect()}, after.collect())
        docs = after
    before, after = steps["quality_rules"]
    judged, q = quality.judge(spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd))
    assert {(r.doc_id, r.text) for r in after} == {(r.doc_id, r.text) for r in judged.filter(F.col(q).kept).collect()}
    before, after = steps["near_duplicates"]
    groups = brute.jaccard_components([(i, t) for i, t in before], 5, 4, 5)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups.values()})
    before, after = steps["benchmark_passages"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keys = list(before)
    bad = brute.decontaminate([t for _, t in keys], items, 13)
    assert {r.doc_id for r in after} == {i for (i, _), b in zip(keys, bad) if not b[4]}
    before, after = steps["private_data"]
    import hashlib

    from helixframe.llm import pseudonyms
    from tests.llm import test_native_operators as native

    native.KEY = "of the test"
    try:
        want = {i: re.sub(pseudonyms.PATTERN, lambda m: pseudonym(m[0]), t) for i, t in before}
    finally:
        native.KEY = "k"
        spark.conf.unset("spark.helixframe.pseudonyms.key")
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == before[r.doc_id, t].n_chars + len(r.text) - len(t) for i, t in before for r in after if r.doc_id == i)
    _, after = steps["token_ids"]
    assert {r.doc_id: r.decoded_sha256 for r in after} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_stages_of_empty_tables_and_clashing_columns(spark):
    """Stages keep columns whatever their names, and give no rows for none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.withColumns({c: F.lit(1) for c in ("quality", "mark", "possible", "contamination", "matches", "renamed", "s", "label", "before")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, clash.limit(0), SF)
        assert none.columns == clash.columns and none.count() == 0
    for name, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[2], corpus_pipeline.STAGES[3]):
        some = stage(spark, clash, SF)
        assert some.columns == clash.columns and some.count() == stage(spark, docs, SF).count()


def test_long_texts_repeats_and_clashing_columns_in_every_stage(spark):
    """Whole long texts, repeated rows and columns of names that operators use, with rows, through each stage on its own."""
    long = " ".join(f"{chr(97 + i * 7 % 26)}{chr(97 + i % 7001 % 25)}{chr(97 + i // 26 % 24)}{chr(97 + i // 624 % 26)}en" for i in range(60_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = spark.createDataFrame([(900_001, long, "en", "a", len(long)), (900_002, long, "en", "a", len(long)), (900_003, f"a few words of their own to keep {1} number 4111 1111 1111 1111", "en", "b", 1), (900_003, f"a few words of their own to keep {1} number 4111 1111 1111 1111", "en", "b", 1)], schema)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(own)
    clash = docs.withColumns({c: F.lit(1) for c in ("quality", "mark", "possible", "contamination", "matches", "renamed", "s", "label", "before", "ids", "group", "d")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, docs, SF), stage(spark, clash, SF)
        key = lambda df: sorted((str(r.doc_id), str(r.text if name != "token_ids" else r.decoded_sha256)) for r in df.collect())  # noqa: B023, E731
        plain = key(a)
        assert plain == key(b), name
        kept[name] = plain
    of = lambda name, i: [t for d, t in kept[name] if d == str(900_000 + i)]
    assert of("quality_rules", 1) == of("quality_rules", 2) == [long]
    assert len(of("near_duplicates", 1)) == 1 and of("near_duplicates", 2) == [] and len(of("near_duplicates", 3)) == 1
    assert of("benchmark_passages", 1) == of("private_data", 1) == [long] and all("4111 1111 1111 1111" not in t for t in of("private_data", 3))
    assert of("token_ids", 1) == [brute.sha(long)]
    assert corpus_pipeline.token_ids(spark, docs.select("doc_id", "text"), SF).columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert 0 < corpus_pipeline.run(spark, SF).count() < 200
