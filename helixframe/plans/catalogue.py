"""Every registered query on the sequence-novelty side, with DuckDB SQL where SQL can express it.

Queries run over whole tables. Sums of floating numbers are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences, statistics
from ..operators import cohorts, density, features, kernels, nystrom, ocsvm, reports, sampling
from ..operators.kernel_rows import StringRows
from ..sources import fasta, fixtures, score_tables
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_READS = "reads AS (SELECT source AS patient, doc_id AS read_idx, CASE WHEN source IN ('src14','src15','src16','src17','src18','src19') THEN -1 ELSE 1 END AS label, upper(regexp_replace(text, '[^ACGTMHacgtmh]', '', 'g')) AS seq FROM documents)"
_SCORES = "scores AS (SELECT 'LOO_' || user_id AS fold, user_id AS subject, CASE WHEN user_id % 3 = 0 THEN -1 ELSE 1 END AS label, list_position(['click','error','purchase','signup','view'], event_type) AS round, event_id AS read_idx, value AS score FROM events)"
_LETTERS = "['A','C','G','T','M','H']"


def query(sql: str | None = None):
    """Register the function under its name, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# Scores by subject


@query(f"WITH {_SCORES} SELECT subject, label, round(avg(-score), 6) AS mean_score, count(*) AS n FROM scores GROUP BY ALL")
def patient_mean_score(spark, d):
    return r6(reports.subject_scores(fixtures.scores(spark, d)), "mean_score")


_MEANS = "means AS (SELECT subject, label, avg(-score) AS value FROM scores GROUP BY ALL)"
_RANKED = "ranked AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM means)"


@query(f"WITH {_SCORES}, {_MEANS}, {_RANKED} SELECT round((sum(r) FILTER (label = -1) - count(*) FILTER (label = -1) * (count(*) FILTER (label = -1) + 1) / 2.0) / (count(*) FILTER (label = -1) * count(*) FILTER (label <> -1)), 6)::DOUBLE AS auc, count(*) FILTER (label = -1) AS n_pos, count(*) FILTER (label <> -1) AS n_neg FROM ranked")
def auc_mean_aggregator(spark, d):
    means = reports.subject_scores(fixtures.scores(spark, d)).withColumn("all", F.lit(1))
    return r6(statistics.auc(means, "mean_score", F.col("label") == -1, ["all"]).drop("all"), "auc")


@query(f"WITH {_SCORES}, means AS (SELECT label, score AS value FROM scores), {_RANKED} SELECT round((sum(r) FILTER (label = -1) - count(*) FILTER (label = -1) * (count(*) FILTER (label = -1) + 1) / 2.0) / (count(*) FILTER (label = -1) * count(*) FILTER (label <> -1)), 6)::DOUBLE AS auc, count(*) FILTER (label = -1) AS n_pos, count(*) FILTER (label <> -1) AS n_neg FROM ranked")
def auc_reads(spark, d):
    return r6(statistics.auc_of_reads(fixtures.scores(spark, d), "score", F.col("label") == -1), "auc")


def _aggregator(name: str, sql: str) -> None:
    def run(spark, d):
        values = statistics.aggregate_all(fixtures.scores(spark, d), ["subject", "label"], tops=(5, 20, 100, 500))
        return r6(values.filter(F.col("aggregator") == name).select("subject", "label", "value"), "value")

    run.__name__ = {"top5": "agg_topk_mean_5", "top20": "agg_topk_mean_20", "top100": "agg_topk_mean_100", "top500": "agg_topk_mean_500"}.get(name, f"agg_{name}")
    query(f"WITH {_SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC) AS rn FROM scores) SELECT subject, label, round({sql}, 6) AS value FROM ranked GROUP BY ALL")(run)


for _name, _sql in (("max", "max(score)"), ("mean", "avg(score)"), ("median", "quantile_cont(score, 0.5)"), ("p90", "quantile_cont(score, 0.9)"), ("p95", "quantile_cont(score, 0.95)"), ("p99", "quantile_cont(score, 0.99)"), *((f"top{k}", f"avg(score) FILTER (rn <= {k})") for k in (5, 20, 100, 500))):
    _aggregator(_name, _sql)


@query(f"WITH {_SCORES} SELECT subject, label, round, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, count(*) AS n_sequences FROM scores GROUP BY ALL")
def round_summary(spark, d):
    return reports.round_summary(fixtures.scores(spark, d))


@query(f"WITH {_SCORES}, m AS (SELECT subject, label, round, avg(score) AS m FROM scores GROUP BY ALL) SELECT subject, label, round(avg(m), 6) AS mean_of_rounds, round(stddev_pop(m), 6) AS std_of_rounds, count(*) AS n_rounds FROM m GROUP BY ALL")
def subject_summary(spark, d):
    return r6(reports.subject_summary(fixtures.scores(spark, d)), "mean_of_rounds", "std_of_rounds")


_FOLDS = f"WITH {_SCORES}, m AS (SELECT subject, label, round(avg(score), 9) AS v FROM scores GROUP BY ALL), f AS (SELECT 'LOO_' || h.subject AS fold, avg(CASE WHEN t.v > h.v THEN 1.0 WHEN t.v = h.v THEN 0.5 ELSE 0.0 END) AS auc FROM m h JOIN m t ON h.label = 1 AND t.label = -1 GROUP BY h.subject)"


@query(f"{_FOLDS} SELECT fold, round(auc, 6)::DOUBLE AS auc FROM f")
def loo_fold_auc(spark, d):
    return r6(reports.fold_aucs(fixtures.scores(spark, d)), "auc")


@query(f"{_FOLDS} SELECT round(avg(auc), 6)::DOUBLE AS mean, round(stddev_pop(auc), 6)::DOUBLE AS std, round(min(auc), 6)::DOUBLE AS min, round(max(auc), 6)::DOUBLE AS max, count(*) AS n FROM f")
def loo_fold_summary(spark, d):
    return r6(reports.describe(reports.fold_aucs(fixtures.scores(spark, d)), "auc"), "mean", "std", "min", "max")


@query(f"WITH {_SCORES}, p AS (SELECT DISTINCT subject AS patient, label FROM scores) SELECT 'LOO_' || h.patient AS fold, p.patient, CASE WHEN p.label = -1 THEN 'tumor' WHEN p.patient = h.patient THEN 'held_out' ELSE 'train' END AS role FROM p JOIN p h ON h.label = 1")
def loo_folds(spark, d):
    return cohorts.loo_folds(fixtures.scores(spark, d).select(F.col("subject").alias("patient"), "label"))


@query(f"WITH {_SCORES}, s AS (SELECT DISTINCT subject, label FROM scores) SELECT s.subject, s.label, count(*) AS n, round(avg(b.score), 6) AS mean, round(stddev_pop(b.score), 6) AS std, round(min(b.score), 6) AS lo, round(max(b.score), 6) AS hi FROM s JOIN scores b ON b.label = 1 AND b.subject <> s.subject GROUP BY ALL")
def loo_background_pool(spark, d):
    return r6(cohorts.background(fixtures.scores(spark, d)), "mean", "std", "lo", "hi")


@query(f"WITH {_SCORES}, c AS (SELECT quantile_cont(score, 0.99) AS hi, quantile_cont(score, 0.01) AS lo FROM scores WHERE label = 1), m AS (SELECT subject, avg(score) AS mu FROM scores GROUP BY ALL) SELECT subject, label, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(100.0 * avg(CASE WHEN score > hi THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pct_right, round(100.0 * avg(CASE WHEN score < lo THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pct_left, round(avg(pow(score - mu, 3)) / pow(stddev_pop(score), 3), 6) AS skewness, round(kurtosis_pop(score), 6) AS kurtosis FROM scores JOIN m USING (subject), c GROUP BY subject, label")
def tail_stats(spark, d):
    return r6(reports.tail_statistics(fixtures.scores(spark, d)), "mean", "std", "pct_right", "pct_left", "skewness", "kurtosis")


@query(f"WITH {_SCORES}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scores), g AS (SELECT i AS t_i, CASE WHEN i = 499 THEN hi ELSE lo + i * ((hi - lo) / 499) END AS t FROM e, range(500) r(i)) SELECT subject, label, CAST(t_i AS INTEGER) AS t_i, round(t, 6) AS t, round(avg(CASE WHEN score > t THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS survival FROM scores, g GROUP BY subject, label, t_i, t")
def survival_curve(spark, d):
    return r6(density.survival(fixtures.scores(spark, d), ["subject", "label"]), "t", "survival")


@query(f"WITH {_SCORES}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scores), g AS (SELECT i AS t_i, CASE WHEN i = 499 THEN hi ELSE lo + i * ((hi - lo) / 499) END AS t FROM e, range(500) r(i)) SELECT label, CAST(t_i AS INTEGER) AS t_i, round(t, 6) AS t, round(avg(CASE WHEN score > t THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS survival FROM scores, g GROUP BY label, t_i, t")
def survival_pooled(spark, d):
    return r6(density.survival(fixtures.scores(spark, d), ["label"]), "t", "survival")


@query(f"WITH {_SCORES}, e AS (SELECT subject, min(score) AS lo, max(score) AS hi, count(*) AS total FROM scores GROUP BY ALL), b AS (SELECT subject, total, (hi - lo) / 100 AS w, CASE WHEN hi = lo THEN 0 ELSE least(floor((score - lo) / ((hi - lo) / 100)), 99) END AS bin FROM scores JOIN e USING (subject)) SELECT subject, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(count(*) / any_value(total) / nullif(any_value(w), 0), 6) AS density FROM b GROUP BY subject, bin")
def score_histogram(spark, d):
    return r6(reports.histogram(fixtures.scores(spark, d), ["subject"]), "density")


@query(f"WITH {_SCORES}, c AS (SELECT avg(score) AS cut FROM scores WHERE label = 1), p AS (SELECT label AS t, CASE WHEN score - cut > 0 THEN 1 ELSE -1 END AS p FROM scores, c), k AS (SELECT unnest([-1, 1]) AS class), s AS (SELECT class, count(*) FILTER (t = class AND p = class) AS hit, count(*) FILTER (p = class) AS said, count(*) FILTER (t = class) AS support FROM p, k GROUP BY class) SELECT class, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0 * hit / nullif(said + support, 0), 0), 6)::DOUBLE AS f1, support FROM s")
def classification_report(spark, d):
    s = fixtures.scores(spark, d)
    cut = F.broadcast(s.filter("label = 1").agg(F.avg("score").alias("cut")))
    p = s.join(cut, F.lit(True)).withColumn("predicted", ocsvm.predict(F.col("score") - F.col("cut")))
    return r6(reports.classification_report(p, "label", "predicted"), "precision", "recall", "f1")


@query(f"WITH s AS (SELECT user_id AS subject, value AS a, length(props) AS b FROM events), r AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY a) + (count(*) OVER (PARTITION BY subject, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY subject ORDER BY b) + (count(*) OVER (PARTITION BY subject, b) - 1) / 2.0 AS rb FROM s) SELECT subject, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r GROUP BY subject")
def spearman_two_scorings(spark, d):
    e = fixtures.table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("value").alias("a"), F.length("props").alias("b"))
    return r6(statistics.spearman(e, "a", "b", ["subject"]), "spearman")


@query(f"WITH {_SCORES} SELECT round(avg(score) FILTER (label = 1), 6) AS mean_healthy_score, round(avg(score) FILTER (label = -1), 6) AS mean_tumor_score, round(avg(score) FILTER (label = -1) - avg(score) FILTER (label = 1), 6) AS score_gap FROM scores")
def score_gap(spark, d):
    return r6(reports.score_gap(fixtures.scores(spark, d)), "mean_healthy_score", "mean_tumor_score", "score_gap")


# Areas by aggregator and sample size

_SIZES = [10, 25, 1000]
_NAMES = {"max": "max(score)", "mean": "avg(score)", "median": "quantile_cont(score, 0.5)", "p90": "quantile_cont(score, 0.9)", "p95": "quantile_cont(score, 0.95)", "p99": "quantile_cont(score, 0.99)", "top100": "avg(score) FILTER (rk <= 100)", "top500": "avg(score) FILTER (rk <= 500)"}


def _units_sql(by_round: bool, held_out: bool, repeats: int, where: str = "TRUE") -> str:
    keys = "subject, round" if by_round else "subject"
    cell = "aggregator, n_reads, rep" + (", round" if by_round else "")
    on = " AND ".join(f"h.{c} = t.{c}" for c in cell.split(", "))
    aggs = ", ".join(f'{v} AS "{k}"' for k, v in _NAMES.items())
    names = ", ".join(f'"{k}"' for k in _NAMES)
    group = f"h.subject, {', '.join('h.' + c for c in cell.split(', '))}" if held_out else ", ".join("h." + c for c in cell.split(", "))
    return f"""WITH {_SCORES}, laid AS (SELECT s.*, n_reads, rep FROM scores s, (SELECT unnest({_SIZES}) AS n_reads), (SELECT unnest(range(1, {repeats + 1})) AS rep) WHERE {where}),
sub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, n_reads, rep ORDER BY md5(concat_ws('|', '42', rep, n_reads, {keys}, read_idx)), read_idx) AS rn FROM laid) WHERE rn <= n_reads),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys}, n_reads, rep ORDER BY score DESC) AS rk FROM sub),
wide AS (SELECT {keys}, label, n_reads, rep, {aggs} FROM ranked GROUP BY ALL),
vals AS (SELECT * REPLACE (round(value, 9) AS value) FROM (UNPIVOT wide ON {names} INTO NAME aggregator VALUE value)),
units AS (SELECT {group}, avg(CASE WHEN t.value > h.value THEN 1.0 WHEN t.value = h.value THEN 0.5 ELSE 0.0 END) AS auc FROM vals h JOIN vals t ON {on} AND h.label = 1 AND t.label = -1 GROUP BY {group})"""


def _heatmap(name: str, by_round: bool, held_out: bool, repeats: int = 1, only_round: int | None = None) -> None:
    def run(spark, d):
        s = fixtures.scores(spark, d)
        s = s.filter(F.col("round") == only_round) if only_round else s
        return r6(reports.heatmap(reports.heatmap_units(s, _SIZES, by_round, held_out, repeats)), "mean_auc", "std_auc")

    run.__name__ = name
    where = f"round = {only_round}" if only_round else "TRUE"
    query(_units_sql(by_round, held_out, repeats, where) + " SELECT aggregator, n_reads, round(avg(auc), 6)::DOUBLE AS mean_auc, round(stddev_pop(auc), 6)::DOUBLE AS std_auc, count(auc) AS n_auc FROM units GROUP BY ALL")(run)


_heatmap("heatmap_rounds", True, True)
_heatmap("heatmap_all_healthy", True, False)
_heatmap("heatmap_folds", False, True)
_heatmap("heatmap_folds_all_healthy", False, False)
_heatmap("heatmap_pooled", False, True, repeats=10)
_heatmap("heatmap_pooled_all_healthy", False, False, repeats=10)
_heatmap("heatmap_single_round", False, True, only_round=1)


def _boxplot(name: str, held_out: bool) -> None:
    def run(spark, d):
        units = reports.heatmap_units(fixtures.scores(spark, d), [25], True, held_out)
        return r6(reports.boxplot(units.withColumnRenamed("round", "nu"), ["nu", "aggregator"]), "p5", "q1", "median", "q3", "p95")

    run.__name__ = name
    q = ", ".join(f"round(quantile_cont(auc, {x}), 6)::DOUBLE AS {n}" for n, x in (("p5", 0.05), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p95", 0.95)))
    query(_units_sql(True, held_out, 1, "n_reads = 25").replace("avg(CASE WHEN t.value", "avg(CASE WHEN t.value") + f" SELECT round AS nu, aggregator, {q}, count(auc) AS n_auc FROM units GROUP BY ALL")(run)


_boxplot("nu_boxplot_stats", True)
_boxplot("nu_boxplot_all_healthy", False)

# Sampling, audits, work lists


@query(f"WITH {_READS} SELECT patient, read_idx, label, seq FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY md5(concat_ws('|', '42', patient, read_idx)), read_idx) AS rn FROM reads) WHERE rn <= 10")
def stratified_sample(spark, d):
    return sampling.stratified(fixtures.reads(spark, d), 200, 20)


@query(f"WITH {_READS}, excluded AS (SELECT patient, read_idx FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY md5(concat_ws('|', '42', patient, read_idx)), read_idx) AS rn FROM reads) WHERE rn <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY md5(concat_ws('|', '43', patient, read_idx)), read_idx) AS rn, least(4, floor(count(*) OVER (PARTITION BY patient) / 5)) AS f FROM reads ANTI JOIN excluded USING (patient, read_idx)) SELECT patient, read_idx, label, seq, CAST(floor((rn - 1) / 5) + 1 AS INTEGER) AS round FROM r WHERE rn <= f * 5")
def disjoint_rounds(spark, d):
    reads = fixtures.reads(spark, d)
    return sampling.disjoint_rounds(reads, 4, 5, 43, sampling.stratified(reads, 200, 20), strict=False)


@query(f"WITH {_READS}, seen AS (SELECT symbol, count(*) AS n FROM (SELECT DISTINCT read_idx, unnest(string_split(seq, '')) AS symbol FROM reads WHERE seq <> '') GROUP BY symbol), known AS (SELECT unnest(['A','C','G','T','U','R','Y','K','M','S','W','B','D','H','V','N','-']) AS symbol) SELECT coalesce(known.symbol, seen.symbol) AS symbol, CASE WHEN n IS NULL THEN 'missing' WHEN known.symbol IS NULL THEN 'unexpected' ELSE 'present' END AS status, coalesce(n, 0) AS n_reads FROM known FULL JOIN seen ON known.symbol = seen.symbol")
def symbol_audit(spark, d):
    return fasta.symbol_audit(fixtures.reads(spark, d))


@query(f"WITH {_READS} SELECT patient, label, count(*) AS num_sequences, CAST(sum(length(seq)) AS BIGINT) AS letters, min(length(seq)) AS shortest, max(length(seq)) AS longest FROM reads WHERE seq IS NOT NULL GROUP BY ALL")
def read_lengths_per_patient(spark, d):
    r = sampling.readable(fixtures.reads(spark, d))
    n = F.length("seq").cast("long")
    return r.groupBy("patient", "label").agg(F.count("*").alias("num_sequences"), F.sum(n).alias("letters"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query(f"WITH {_SCORES}, done AS (SELECT subject, round FROM scores GROUP BY ALL HAVING count(*) >= 15), subjects AS (SELECT DISTINCT subject FROM scores), work AS (SELECT subject, CAST(round AS INTEGER) AS round FROM subjects, (SELECT unnest([1, 2, 3, 4, 5]) AS round)) SELECT subject, round FROM work ANTI JOIN done USING (subject, round)")
def work_list_antijoin(spark, d):
    s = fixtures.scores(spark, d)
    work = s.select("subject").distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return score_tables.outstanding(work, s.groupBy("subject", "round").count().filter("count >= 15"), ["subject", "round"])


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY read_idx) - 1 AS row FROM scores) SELECT row, " + ", ".join(f"round(any_value(score) FILTER (round = {i}), 6) AS round_{i}" for i in range(1, 6)) + " FROM r GROUP BY row")
def wide_round_pivot(spark, d):
    return r6(score_tables.widen(fixtures.scores(spark, d), "round", [1, 2, 3, 4, 5], "round_"), *[f"round_{i}" for i in range(1, 6)])


# k-mers and features


def _kmers(k: int) -> str:
    return f"kmers AS (SELECT patient, read_idx, kmer, count(*) AS cnt FROM (SELECT patient, read_idx, substring(seq, CAST(unnest(range(1, length(seq) - {k} + 2)) AS INTEGER), {k}) AS kmer FROM reads WHERE length(seq) >= {k}) GROUP BY ALL)"


def _near(k: int, m: int) -> str:
    """Vocabulary pairs within m substitutions, by Hamming distance."""
    vocabulary = f"vocab AS (SELECT {' || '.join(f'l{i}.x' for i in range(k))} AS kmer FROM " + ", ".join(f"(SELECT unnest({_LETTERS}) AS x) l{i}" for i in range(k)) + ")"
    return f"{vocabulary}, near AS (SELECT a.kmer, b.kmer AS neighbor, hamming(a.kmer, b.kmer) AS dist FROM vocab a JOIN vocab b ON hamming(a.kmer, b.kmer) <= {m})"


def _features(k: int, m: int = 1) -> str:
    return f"{_READS}, {_kmers(k)}, {_near(k, m)}, f AS (SELECT patient, read_idx, neighbor AS kmer, sum(cnt * pow(0.5, dist)) AS w FROM kmers JOIN near USING (kmer) GROUP BY ALL)"


@query(f"WITH {_READS}, {_kmers(3)} SELECT * FROM kmers")
def kmer_counts_k3(spark, d):
    return features.kmer_counts(fixtures.reads(spark, d), 3)


@query(f"WITH {_READS}, {_kmers(3)}, {_near(3, 1)} SELECT patient, read_idx, neighbor AS kmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM kmers JOIN near USING (kmer) GROUP BY ALL")
def mismatch_unweighted_k3_m1(spark, d):
    return features.mismatch_counts(fixtures.reads(spark, d), 3, 1)


@query(f"WITH {_features(3)} SELECT patient, read_idx, 3 AS k, kmer, w FROM f")
def mismatch_weighted_k3_m1(spark, d):
    return features.weighted_features(fixtures.reads(spark, d), 3, 1)


@query(f"WITH {_features(3, 2)} SELECT patient, read_idx, 3 AS k, kmer, w FROM f")
def mismatch_weighted_k3_m2(spark, d):
    return features.weighted_features(fixtures.reads(spark, d), 3, 2)


_K6 = f"{_READS}, {_kmers(6)}, f AS (SELECT patient, read_idx, neighbor AS kmer, sum(cnt * pow(0.5, dist)) AS w FROM (SELECT patient, read_idx, cnt, kmer AS neighbor, 0 AS dist FROM kmers UNION ALL SELECT patient, read_idx, cnt, substring(kmer, 1, p - 1) || x || substring(kmer, p + 1), 1 FROM kmers, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS p), (SELECT unnest({_LETTERS}) AS x) WHERE substring(kmer, p, 1) <> x) GROUP BY ALL)"


@query(f"WITH {_K6} SELECT patient, read_idx, count(*) AS n_features, sum(w) AS total, sum(w * w) AS diag FROM f GROUP BY ALL")
def mismatch_weighted_k6_m1(spark, d):
    return features.feature_sums(fixtures.reads(spark, d), 6, 1)


@query(f"WITH {_READS}, {_kmers(3)}, v AS (SELECT l1.x || l2.x || l3.x AS kmer, (list_position({_LETTERS}, l1.x) - 1) * 36 + (list_position({_LETTERS}, l2.x) - 1) * 6 + list_position({_LETTERS}, l3.x) - 1 AS col FROM (SELECT unnest({_LETTERS}) AS x) l1, (SELECT unnest({_LETTERS}) AS x) l2, (SELECT unnest({_LETTERS}) AS x) l3) SELECT v.kmer, CAST(col AS BIGINT) AS col, count(cnt) AS n_reads, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS n FROM v LEFT JOIN kmers USING (kmer) GROUP BY ALL")
def full_vocabulary_k3(spark, d):
    """Every string of the vocabulary with its column, and how many reads hold it how often."""
    seen = features.kmer_counts(fixtures.reads(spark, d), 3).groupBy("kmer").agg(F.count("*").alias("n_reads"), F.sum("cnt").alias("n"))
    return sequences.full_vocabulary(spark, 3).join(seen, "kmer", "left").select("kmer", "col", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_READS}, k AS (SELECT unnest(range(1, 7)) AS k), w AS (SELECT k, greatest(k - 2, 0) AS w FROM k), s AS (SELECT k, round(w / sum(w) OVER (), 4) AS linear, round(w * w / sum(w * w) OVER (), 4) AS quadratic FROM w) SELECT CAST(k AS INTEGER) AS k, linear, quadratic, count(*) AS n_reads, CAST(sum(length(seq) - k + 1) AS BIGINT) AS n_strings FROM s JOIN reads ON length(seq) >= k GROUP BY ALL")
def mkl_weights(spark, d):
    """The kernel's weight of each k, with the reads and strings that it weighs."""
    rows = [(k + 1, a, b) for k, (a, b) in enumerate(zip(sequences.kernel_weights(6), sequences.kernel_weights(6, scaling="quadratic")))]
    lengths = fixtures.reads(spark, d).groupBy(F.length("seq").cast("long").alias("size")).agg(F.count("*").alias("c"))
    weights = F.broadcast(spark.createDataFrame(rows, "k int, linear double, quadratic double"))
    return lengths.join(weights, F.col("size") >= F.col("k")).groupBy("k", "linear", "quadratic").agg(F.sum("c").alias("n_reads"), F.sum(F.col("c") * (F.col("size") - F.col("k") + 1)).alias("n_strings"))


@query(f"WITH {_features(3)} SELECT patient, read_idx, 3 AS k, sum(w * w) AS diag, round(greatest(sqrt(sum(w * w)), 1e-12), 6) AS norm FROM f GROUP BY ALL")
def self_norms(spark, d):
    return features.self_norms(features.weighted_features(fixtures.reads(spark, d), 3, 1)).withColumn("norm", F.round(F.greatest(F.sqrt("diag"), F.lit(1e-12)), 6))


# Kernels

_PAIR = "(a.patient < b.patient OR (a.patient = b.patient AND a.read_idx <= b.read_idx))"


def _flat_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("i.patient").alias("patient_i"), F.col("i.read_idx").alias("read_i"), F.col("j.patient").alias("patient_j"), F.col("j.read_idx").alias("read_j"), "k")


@query(f"WITH {_features(3)}, g AS (SELECT a.patient AS patient_i, a.read_idx AS read_i, b.patient AS patient_j, b.read_idx AS read_j, sum(a.w * b.w) AS k FROM f a JOIN f b ON a.kmer = b.kmer AND {_PAIR} GROUP BY ALL), n AS (SELECT DISTINCT patient, read_idx FROM f) SELECT a.patient AS patient_i, a.read_idx AS read_i, b.patient AS patient_j, b.read_idx AS read_j, coalesce(k, 0) AS k FROM n a JOIN n b ON {_PAIR} LEFT JOIN g ON a.read_idx = read_i AND b.read_idx = read_j")
def gram_symmetric_k3(spark, d):
    return _flat_pairs(kernels.gram(features.read_vectors(fixtures.reads(spark, d), [3], 1), {3: 1.0}))


_MKL = f"{_READS}, " + ", ".join(f"k{k} AS (SELECT patient, read_idx, kmer, count(*) AS cnt FROM (SELECT patient, read_idx, substring(seq, CAST(unnest(range(1, length(seq) - {k} + 2)) AS INTEGER), {k}) AS kmer FROM reads WHERE length(seq) >= {k}) GROUP BY ALL), {_near(k, 1).replace('vocab', f'v{k}').replace('near AS', f'n{k} AS')}, f{k} AS (SELECT patient, read_idx, {k} AS k, neighbor AS kmer, sum(cnt * pow(0.5, dist)) AS w FROM k{k} JOIN n{k} USING (kmer) GROUP BY ALL)" for k in (2, 3)) + ", f AS (SELECT * FROM f2 UNION ALL SELECT * FROM f3), wk AS (SELECT unnest([2, 3]) AS k, unnest([0.4::DOUBLE, 0.6::DOUBLE]) AS wt)"
# reads as dense vectors over all strings, so that a pair costs one product of lists
_NORMALISED = _MKL + f", cols AS (SELECT 2 AS k, kmer FROM v2 UNION ALL SELECT 3, kmer FROM v3), named AS (SELECT DISTINCT patient, read_idx FROM f), vec AS (SELECT patient, read_idx, list(coalesce(w, 0) * sqrt(wt) ORDER BY k, kmer) AS v FROM named CROSS JOIN cols JOIN wk USING (k) LEFT JOIN f USING (patient, read_idx, k, kmer) GROUP BY patient, read_idx), dg AS (SELECT *, list_dot_product(v, v) AS dg FROM vec), gn AS (SELECT a.patient AS pi, a.read_idx AS ri, b.patient AS pj, b.read_idx AS rj, list_dot_product(a.v, b.v) / sqrt(greatest(a.dg, 1e-12) * greatest(b.dg, 1e-12)) AS k FROM dg a JOIN dg b ON {_PAIR})"
_WEIGHTS = {2: 0.4, 3: 0.6}


@query(f"WITH {_NORMALISED} SELECT pi AS patient_i, ri AS read_i, pj AS patient_j, rj AS read_j, round(k, 6) AS k FROM gn")
def gram_mkl_normalised(spark, d):
    return _flat_pairs(kernels.gram(features.read_vectors(fixtures.reads(spark, d), [2, 3], 1), _WEIGHTS, cosine=True, digits=6))


@query(f"WITH {_NORMALISED}, d AS (SELECT pi, pj, sqrt(greatest(0, 2 * (1 - k))) AS d FROM gn WHERE ri <> rj OR pi <> pj) SELECT pi AS patient_i, pj AS patient_j, count(*) AS n, round(avg(d), 6) AS mean, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM d GROUP BY ALL")
def kernel_distances(spark, d):
    g = kernels.distance_sums(features.read_vectors(fixtures.reads(spark, d), [2, 3], 1), _WEIGHTS)
    return r6(g.withColumnsRenamed({"i": "patient_i", "j": "patient_j"}), "mean", "nearest", "farthest")


@query(f"WITH {_READS}, {_kmers(3)}, f AS (SELECT kmers.*, label FROM kmers JOIN reads USING (patient, read_idx)), dg AS (SELECT patient, read_idx, sum(cnt * cnt) AS dg FROM f GROUP BY ALL), g AS (SELECT a.patient AS pi, a.read_idx AS ri, b.patient AS pj, b.read_idx AS rj, sum(a.cnt * b.cnt) AS k FROM f a JOIN f b ON a.kmer = b.kmer AND a.label = -1 AND b.label = 1 GROUP BY ALL) SELECT x.patient AS patient_i, x.read_idx AS read_i, y.patient AS patient_j, y.read_idx AS read_j, round(coalesce(k, 0) / sqrt(x.dg * y.dg), 6) AS k FROM (SELECT dg.* FROM dg JOIN reads USING (patient, read_idx) WHERE label = -1) x JOIN (SELECT dg.* FROM dg JOIN reads USING (patient, read_idx) WHERE label = 1) y ON true LEFT JOIN g ON pi = x.patient AND ri = x.read_idx AND pj = y.patient AND rj = y.read_idx")
def gram_asymmetric_normalised(spark, d):
    r = fixtures.reads(spark, d)
    test, train = (features.weighted_features(r.filter(F.col("label") == x), 3, 0).cache() for x in (-1, 1))
    return _flat_pairs(kernels.cross_gram(test, train, {3: 1.0}, cosine=True, digits=6))


_EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"WITH {_EMB} SELECT a.id AS i, b.id AS j, round(list_dot_product(a.v, b.v), 6) AS k FROM e a JOIN e b ON a.id <= b.id")
def embedding_linear_kernel(spark, d):
    e = fixtures.embeddings(spark, d)
    return kernels.embedding_kernel(e, digits=6)


@query(f"WITH {_EMB}, g AS (SELECT 1.0 / (max(len(v)) * (SELECT var_pop(x) FROM (SELECT unnest(v) AS x FROM e))) AS gamma FROM e) SELECT a.id AS i, b.id AS j, round(exp(-gamma * pow(list_distance(a.v, b.v), 2)), 6) AS k FROM e a JOIN e b ON a.id <= b.id, g")
def embedding_rbf_kernel(spark, d):
    e = fixtures.embeddings(spark, d)
    return kernels.embedding_kernel(e, kind="rbf", digits=6)


# Densities and overlapping areas

_MOMENTS = "m AS (SELECT subject, label, CAST(count(*) AS DOUBLE) AS n, CASE WHEN stddev_samp(score) IS NULL OR max(score) = min(score) THEN 1e-6 ELSE stddev_samp(score) END * pow(count(*), -0.2) AS h, min(score) AS lo, max(score) AS hi FROM scores GROUP BY ALL)"


@query(f"WITH {_SCORES}, {_MOMENTS}, g AS (SELECT subject, n, h, i AS grid_i, i * (hi / 511) AS x FROM m, range(512) r(i)) SELECT g.subject, CAST(grid_i AS INTEGER) AS grid_i, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - score) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS y FROM g JOIN scores s ON s.subject = g.subject GROUP BY g.subject, grid_i, x")
def kde_curve(spark, d):
    return r6(density.curve(fixtures.scores(spark, d), ["subject"], "score"), "x", "y")


_REST = "rest AS (SELECT s.subject, any_value(s.label) AS label, CAST(count(*) AS DOUBLE) AS n, CASE WHEN count(*) < 2 OR max(b.score) = min(b.score) THEN 1e-6 ELSE stddev_samp(b.score) END * pow(count(*), -0.2) AS h, min(b.score) AS lo, max(b.score) AS hi FROM m s JOIN scores b ON b.label = 1 AND b.subject <> s.subject GROUP BY s.subject)"


@query(f"""WITH {_SCORES}, {_MOMENTS}, {_REST}, g AS (SELECT m.subject, m.label, m.n, m.h, r.n AS n2, r.h AS h2, least(m.lo, r.lo) AS lo, (greatest(m.hi, r.hi) - least(m.lo, r.lo)) / 499 AS step FROM m LEFT JOIN rest r USING (subject)),
c AS (SELECT subject, label, score, count(*) AS c FROM scores GROUP BY ALL), pool AS (SELECT score, sum(c) AS c FROM c WHERE label = 1 GROUP BY score), pts AS (SELECT *, i, lo + i * step AS x FROM g, range(500) r(i)),
own AS (SELECT pts.subject, i, x, sum(c * exp(-0.5 * pow((x - score) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS y, sum(c * exp(-0.5 * pow((x - score) / h2, 2))) AS mine FROM pts JOIN c USING (subject) GROUP BY pts.subject, i, x),
others AS (SELECT subject, any_value(label) AS label, i, x, sum(c * exp(-0.5 * pow((x - score) / h2, 2))) AS s, any_value(n2 * h2) AS nh FROM pts, pool WHERE n2 IS NOT NULL GROUP BY subject, i, x)
SELECT subject, 'own' AS curve, CAST(i AS INTEGER) AS grid_i, round(x, 6) AS x, round(y, 6) AS y FROM own UNION ALL
SELECT o.subject, 'baseline', CAST(o.i AS INTEGER), round(o.x, 6), round(greatest(s - CASE WHEN label = 1 THEN mine ELSE 0 END, 0) / (nh * sqrt(2 * pi())), 6) FROM others o JOIN own USING (subject, i)""")
def baseline_density(spark, d):
    """Each subject's density beside that of all other healthy subjects."""
    return r6(density.baseline_curves(fixtures.scores(spark, d)), "x", "y")


@query(f"""WITH {_SCORES}, {_MOMENTS}, means AS (SELECT subject, avg(score) AS mean_score FROM scores GROUP BY ALL), t AS (SELECT min(lo) AS lo, max(hi) AS hi FROM m WHERE label = -1),
f AS (SELECT m.subject AS held, least(m.lo, t.lo) AS lo, (greatest(m.hi, t.hi) - least(m.lo, t.lo)) / 499 AS step FROM m, t WHERE label = 1),
pts AS (SELECT held, m.subject, m.label, n, h, i, f.lo + i * step AS x FROM f JOIN m ON m.label = -1 OR m.subject = held, range(500) r(i)), c AS (SELECT subject, score, count(*) AS c FROM scores GROUP BY ALL)
SELECT 'LOO_' || held AS fold, pts.subject, label, round(any_value(mean_score), 6) AS mean_score, CAST(i AS INTEGER) AS grid_i, round(x, 6) AS x, round(sum(c * exp(-0.5 * pow((x - score) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS y FROM pts JOIN c USING (subject) JOIN means USING (subject) GROUP BY held, pts.subject, label, i, x""")
def fold_overlay(spark, d):
    """For each fold the densities of its held-out subject and of all tumors, with their means."""
    return density.fold_overlay(fixtures.scores(spark, d), digits=6)


@query(f"""WITH {_SCORES}, {_MOMENTS}, p AS (SELECT label, CAST(count(*) AS DOUBLE) AS n, stddev_samp(score) * pow(count(*), -0.2) AS h FROM scores GROUP BY label), q AS (SELECT quantile_cont(score, 0.95) AS hi, quantile_cont(score, 0.05) AS lo FROM scores WHERE label = 1), e AS (SELECT min(score) AS lo, max(score) AS hi FROM scores),
ends AS (SELECT 'left' AS tail, e.lo AS a, q.lo AS b FROM e, q UNION ALL SELECT 'right', q.hi, e.hi FROM e, q), panel AS (SELECT tail, a - 0.05 * (b - a) AS lo, (b + 0.05 * (b - a) - (a - 0.05 * (b - a))) / 2047 AS step FROM ends), pts AS (SELECT tail, i, lo + i * step AS x FROM panel, range(2048) r(i)),
c AS (SELECT label, subject, score, count(*) AS c FROM scores GROUP BY ALL), pc AS (SELECT label, score, sum(c) AS c FROM c GROUP BY ALL)
SELECT tail, m.label, CAST(m.subject AS VARCHAR) AS subject, CAST(i AS INTEGER) AS grid_i, round(x, 6) AS x, round(sum(c * exp(-0.5 * pow((x - score) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS y FROM pts, m JOIN c USING (subject) GROUP BY tail, m.label, m.subject, i, x UNION ALL
SELECT tail, p.label, 'pool', CAST(i AS INTEGER), round(x, 6), round(sum(c * exp(-0.5 * pow((x - score) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) FROM pts, p JOIN pc USING (label) GROUP BY tail, p.label, i, x""")
def tail_zoom(spark, d):
    """Densities in both tails, of subjects and pools."""
    curves = density.tail_zoom(fixtures.scores(spark, d)).withColumn("subject", F.coalesce(F.col("subject").cast("string"), F.lit("pool")))
    return r6(curves, "x", "y")


def _oa_sql(pairs: str, points: int) -> str:
    return f"""WITH {_SCORES}, {_MOMENTS}, pairs AS ({pairs}),
grid AS (SELECT p.a, p.b, least(x.lo, y.lo) - 0.1 * (greatest(x.hi, y.hi) - least(x.lo, y.lo)) AS lo, 1.1 * greatest(abs(least(x.lo, y.lo)), abs(greatest(x.hi, y.hi))) AS hi FROM pairs p JOIN m x ON x.subject = p.a JOIN m y ON y.subject = p.b),
pts AS (SELECT a, b, i, lo + i * ((hi - lo) / {points - 1}) AS x FROM grid, range({points}) r(i)),
dens AS (SELECT p.a, p.b, i, x, m.subject, sum(exp(-0.5 * pow((x - score) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS y FROM pts p JOIN m ON m.subject = p.a OR m.subject = p.b JOIN scores s ON s.subject = m.subject GROUP BY p.a, p.b, i, x, m.subject),
diff AS (SELECT a, b, i, x, abs(sum(CASE WHEN subject = a THEN y ELSE -y END)) AS d FROM dens GROUP BY a, b, i, x),
steps AS (SELECT a, b, (x - lag(x) OVER w) * (d + lag(d) OVER w) / 2 AS s FROM diff WINDOW w AS (PARTITION BY a, b ORDER BY i)),
oas AS (SELECT a, b, 1 - sum(s) / 2 AS oa FROM steps GROUP BY a, b)"""


def _healthy_neighbours(spark, d) -> tuple[DataFrame, DataFrame]:
    s = fixtures.scores(spark, d)
    subjects = s.filter("label = 1").select("subject").distinct()
    from pyspark.sql import Window

    return s, subjects.select(F.col("subject").alias("a"), F.lead("subject").over(Window.orderBy("subject")).alias("b")).filter("b IS NOT NULL")


@query(_oa_sql("SELECT a, b FROM (SELECT subject AS a, lead(subject) OVER (ORDER BY subject) AS b FROM (SELECT DISTINCT subject FROM scores WHERE label = 1)) WHERE b IS NOT NULL", 1024) + " SELECT a, b, round(oa, 6) AS oa FROM oas")
def oa_pair(spark, d):
    """Each healthy subject against the next one."""
    return r6(density.oa_pairs(*_healthy_neighbours(spark, d)), "oa")


@query(_oa_sql("SELECT x.subject AS a, y.subject AS b FROM m x JOIN m y ON x.label = 1 AND y.label = 1 AND x.subject < y.subject", 1024) + " SELECT a, b, round(oa, 6) AS oa FROM oas")
def oa_healthy_pairs(spark, d):
    return r6(density.oa_all(fixtures.scores(spark, d), tumors=False).drop("tumor"), "oa")


_ALL_PAIRS = "SELECT x.subject AS a, y.subject AS b FROM m x JOIN m y ON x.label = 1 AND (y.label = -1 OR x.subject < y.subject)"


@query(_oa_sql(_ALL_PAIRS, 1024) + ", typed AS (SELECT CASE WHEN m.label = -1 THEN 'healthy_vs_tumor' ELSE 'healthy_vs_healthy' END AS comparison_type, oa FROM oas JOIN m ON m.subject = b) SELECT comparison_type, round(avg(oa), 6) AS mean_oa, round(stddev_pop(oa), 6) AS std_oa, round(min(oa), 6) AS min_oa, round(max(oa), 6) AS max_oa, count(*) AS n FROM typed GROUP BY ALL")
def oa_comparison_summary(spark, d):
    return r6(density.summary(pipelines.compare_all(fixtures.scores(spark, d)), ["comparison_type"]), "mean_oa", "std_oa", "min_oa", "max_oa")


_P = 512


@query(f"""WITH {_READS}, {_kmers(3)}, f AS (SELECT kmers.*, label FROM kmers JOIN reads USING (patient, read_idx)), dg AS (SELECT patient, read_idx, label, sum(cnt * cnt)::DOUBLE AS dg FROM f GROUP BY ALL),
g AS (SELECT a.patient AS pi, a.read_idx AS ri, a.label AS li, b.patient AS pj, b.read_idx AS rj, sum(a.cnt * b.cnt)::DOUBLE AS k FROM f a JOIN f b ON a.kmer = b.kmer AND b.label = 1 AND (a.label = -1 OR {_PAIR}) GROUP BY ALL),
pairs AS (SELECT x.patient AS pi, x.read_idx AS ri, x.label AS li, y.patient AS pj, y.read_idx AS rj, sqrt(x.dg * y.dg) AS s FROM dg x JOIN dg y ON y.label = 1 AND (x.label = -1 OR (x.patient < y.patient OR (x.patient = y.patient AND x.read_idx < y.read_idx)))),
dist AS (SELECT CASE WHEN pairs.li = 1 THEN 'reference' ELSE pi END AS patient, sqrt(greatest(0, 2 * (1 - coalesce(g.k, 0) / s))) AS d FROM pairs LEFT JOIN g USING (ri, rj, pi, pj)),
m AS (SELECT patient, CAST(count(*) AS DOUBLE) AS n, stddev_samp(d) * pow(count(*), -0.2) AS h, max(d) AS hi FROM dist GROUP BY ALL),
pts AS (SELECT i, i * ((SELECT hi FROM m WHERE patient = 'reference') / {_P - 1}) AS x FROM range({_P}) r(i)),
dens AS (SELECT patient, i, x, sum(exp(-0.5 * pow((x - d) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS y FROM dist JOIN m USING (patient), pts GROUP BY patient, i, x),
diff AS (SELECT a.patient, a.i, a.x, abs(a.y - b.y) AS v FROM dens a JOIN dens b ON b.patient = 'reference' AND a.i = b.i AND a.patient <> 'reference'),
steps AS (SELECT patient, (x - lag(x) OVER w) * (v + lag(v) OVER w) / 2 AS s FROM diff WINDOW w AS (PARTITION BY patient ORDER BY i))
SELECT patient, round(1 - sum(s) / 2, 6) AS oa, round(sum(s) / 2, 6) AS anomaly_score FROM steps GROUP BY patient""")
def oa_reference_patient(spark, d):
    r = fixtures.reads(spark, d)
    test, train = (features.weighted_features(r.filter(F.col("label") == x), 3, 0) for x in (-1, 1))
    return r6(pipelines.reference_overlaps(train, test, {3: 1.0}, _P), "oa", "anomaly_score")


@query(_oa_sql(f"SELECT x.subject AS a, y.subject AS b FROM m x JOIN m y ON x.label = 1 AND y.label = 1 AND x.subject < y.subject", 1024) + ", both AS (SELECT a, b, oa FROM oas UNION ALL SELECT b, a, oa FROM oas UNION ALL SELECT subject, subject, 1.0 FROM m WHERE label = 1) SELECT a AS subject, round(avg(oa) FILTER (a <> b), 6) AS mean_oa, round(min(oa), 6) AS min_oa, round(max(oa), 6) AS max_oa, round(stddev_pop(oa) FILTER (a <> b), 6) AS std_oa, count(*) AS n FROM both GROUP BY a".replace("both", "mirrored"))
def reference_pairwise_oa(spark, d):
    """The mirrored matrix with ones on its diagonal, by row."""
    s = fixtures.scores(spark, d)
    h = s.filter("label = 1").select("subject").distinct()
    oas = density.oa_all(s, tumors=False)
    return r6(density.by_row(density.mirrored(oas, h)), "mean_oa", "min_oa", "max_oa", "std_oa")


# Documentation-derived


@query(f"WITH {_SCORES}, {_MEANS}, c AS (SELECT value, count(*) FILTER (label = -1) AS p, count(*) FILTER (label <> -1) AS n FROM means GROUP BY value), roc AS (SELECT value AS threshold, sum(p) OVER w / sum(p) OVER () AS tpr, sum(n) OVER w / sum(n) OVER () AS fpr FROM c WINDOW w AS (ORDER BY value DESC)) SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) AS j FROM roc ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1")
def roc_youden(spark, d):
    return r6(reports.youden(reports.subject_scores(fixtures.scores(spark, d)).withColumnRenamed("mean_score", "value")), "threshold", "tpr", "fpr", "j")


@query(f"WITH {_SCORES}, t AS (SELECT quantile_cont(score, 0.99) AS tau FROM scores WHERE label = 1) SELECT subject, label, round(avg(CASE WHEN score > tau THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS proportion, count(*) AS n FROM scores, t GROUP BY subject, label")
def outlier_proportion(spark, d):
    return r6(reports.outlier_proportion(fixtures.scores(spark, d)), "proportion")


@query(f"WITH {_SCORES}, {_MEANS}, t AS (SELECT quantile_cont(value, 0.9) AS tau FROM means WHERE label = 1) SELECT subject, label, round(value, 6) AS value, CASE WHEN value >= tau THEN 'TUMOR' ELSE 'HEALTHY' END AS diagnosis FROM means, t")
def diagnosis(spark, d):
    values = reports.subject_scores(fixtures.scores(spark, d)).select("subject", "label", F.col("mean_score").alias("value"))
    tau = F.broadcast(values.filter("label = 1").agg(F.percentile("value", F.lit(0.9)).alias("tau")))
    return r6(reports.diagnose(values.join(tau, F.lit(True)), F.col("tau")).drop("tau"), "value")


@query(f"WITH {_SCORES}, {_MEANS}, nb AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value, subject) - 1 AS k, count(*) OVER (PARTITION BY label) AS size FROM means), draws AS (SELECT rep, label, CAST('0x' || substring(md5(concat_ws('|', '42', rep, label, k)), 1, 8) AS BIGINT) % size AS k FROM nb, (SELECT unnest(range(1, 1001)) AS rep)), picked AS (SELECT rep, nb.label, nb.value FROM draws JOIN nb ON draws.label = nb.label AND draws.k = nb.k), a AS (SELECT h.rep, avg(CASE WHEN t.value > h.value THEN 1.0 WHEN t.value = h.value THEN 0.5 ELSE 0.0 END) AS auc FROM picked h JOIN picked t ON h.rep = t.rep AND h.label = 1 AND t.label = -1 GROUP BY h.rep) SELECT round(quantile_cont(auc, 0.025), 6)::DOUBLE AS low, round(quantile_cont(auc, 0.5), 6)::DOUBLE AS median, round(quantile_cont(auc, 0.975), 6)::DOUBLE AS high FROM a")
def bootstrap_auc(spark, d):
    values = reports.subject_scores(fixtures.scores(spark, d)).withColumnRenamed("mean_score", "value")
    return r6(reports.bootstrap_auc(values), "low", "median", "high")


# Models (no SQL form; tested by their optimality conditions)

_KERNEL = pipelines.Kernel(3, 1, (0.0, 0.4, 0.6))
_SPLIT = f"{_READS}, ranked AS (SELECT patient, read_idx, row_number() OVER (PARTITION BY patient ORDER BY md5(concat_ws('|', '42', patient, read_idx)), read_idx) AS rn FROM reads WHERE label = 1 AND seq IS NOT NULL), train AS (SELECT * FROM ranked WHERE rn <= 100)"


@query()
def nystrom_phi(spark, d):
    r = fixtures.reads(spark, d)
    f = _KERNEL.rows(r).cache()
    return nystrom.transform(f, nystrom.fit(r.filter("length(seq) >= 3"), f, _KERNEL.by_k, 20), reads=r)


@query()
def nystrom_frobenius(spark, d):
    r = fixtures.reads(spark, d)
    f = _KERNEL.rows(r).cache()
    phi = nystrom.transform(f, nystrom.fit(r.filter("length(seq) >= 3"), f, _KERNEL.by_k, 20), reads=r)
    return nystrom.map_errors(f, phi, _KERNEL.by_k)


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    r = fixtures.reads(spark, d)
    train = sampling.stratified(r.filter("label = 1"), 1400, 14).cache()
    return train, r.join(train.select("patient", "read_idx"), ["patient", "read_idx"], "left_anti")


@query()
def ocsvm_scores_exact(spark, d):
    return pipelines.exact_scores(*_split(spark, d), _KERNEL)


@query()
def ocsvm_scores_nystrom(spark, d):
    return pipelines.low_rank_scores(*_split(spark, d), _KERNEL, 20)


@query()
def ocsvm_scores_embeddings(spark, d):
    e = fixtures.embeddings(spark, d)
    return pipelines.embedding_scores(e.filter("label < 5"), e.filter("label >= 5"), "rbf")


@query()
def mil_exact_patients(spark, d):
    train, test = _split(spark, d)
    return pipelines.evaluate(pipelines.exact_scores(train, test, _KERNEL), test)["patients"]


@query()
def nu_model_boxplot(spark, d):
    """Models of half of the healthy patients at three nu; the other half against all tumors, by aggregator, as a boxplot for each nu."""
    r = sampling.readable(fixtures.reads(spark, d))
    half = [f"src{i}" for i in range(7)]
    known = F.col("patient").isin(half)
    units = pipelines.nu_comparison(r.filter(known), r.filter(~known), _KERNEL, [0.1, 0.2, 0.5], 25)
    return r6(reports.boxplot(units, ["nu", "aggregator"]), "p5", "q1", "median", "q3", "p95")


@query()
def nystrom_sweep_iteration(spark, d):
    """One model of the landmark sweep at its published size: at most 30,000 training reads, 300 landmarks, k up to 6 with one mismatch, 10,000 test reads."""
    r = fixtures.short_reads(spark, d)
    train = sampling.stratified(r.filter("label = 1"), 30_000, 14).cache()
    rest = r.join(train.select("patient", "read_idx"), ["patient", "read_idx"], "left_anti")
    test = sampling.stratified(rest.filter("label = 1"), 5000, 14).unionByName(sampling.stratified(rest.filter("label = -1"), 5000, 6)).cache()
    scored = pipelines.low_rank_scores(train, test, pipelines.Kernel(), 300).join(test.select("patient", "read_idx", "label"), ["patient", "read_idx"]).withColumn("score", -F.col("decision")).cache()
    n = train.agg(F.count("*").alias("n_train"))
    return n.join(statistics.auc_of_reads(scored, "score", F.col("label") == -1), F.lit(True)).join(reports.score_gap(scored), F.lit(True))


# What holds of any fitted model, so that SQL can state it


def _optimality(scored: DataFrame, alpha: DataFrame, nu: float) -> DataFrame:
    """(nu, n, sum_alpha, out_of_bounds, kkt_violations) of training reads' scores and weights."""
    rows = scored.join(alpha.select("id.*", "alpha"), ["patient", "read_idx"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))
    decision, a = -F.col("score"), F.col("alpha")
    wrong = ((a < 1 - 1e-9) & (decision < -2e-3)) | ((a > 1e-9) & (decision > 2e-3))
    return r6(rows.agg(F.lit(nu).alias("nu"), F.count("*").alias("n"), F.sum("alpha").alias("sum_alpha"), F.count_if((a < 0) | (a > 1)).alias("out_of_bounds"), F.count_if(wrong).alias("kkt_violations")), "sum_alpha")


@query(f"WITH {_READS} SELECT 0.2::DOUBLE AS nu, count(*) AS n, round(0.2 * count(*), 6)::DOUBLE AS sum_alpha, 0::BIGINT AS out_of_bounds, 0::BIGINT AS kkt_violations FROM reads WHERE label = 1")
def ocsvm_all_healthy_invariants(spark, d):
    """The exact model of every healthy read, whatever their number: each on the side of the margin that its weight says."""
    train = fixtures.reads(spark, d).filter("label = 1")
    params, tables = pipelines.train(train, _KERNEL)
    return _optimality(pipelines.infer(train, params, tables), tables["alpha"], 0.2)


@query(f"WITH {_READS}, train AS (SELECT * FROM reads WHERE label = 1) SELECT nu, count(*) AS n, round(nu * count(*), 6)::DOUBLE AS sum_alpha, 0::BIGINT AS out_of_bounds, 0::BIGINT AS kkt_violations FROM train, (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE]) AS nu) GROUP BY nu")
def nu_path_invariants(spark, d):
    """Models along a path over nu, each begun at the one before: every one is optimal for its own nu."""
    train = fixtures.reads(spark, d).filter("label = 1")
    f = _KERNEL.rows(train).cache()
    rows, out = StringRows(train, f, _KERNEL.by_k), None
    for nu, model in ocsvm.solve_path(rows, [0.1, 0.2, 0.5]).items():
        alpha = rows.with_alpha(model.alpha)
        vector = ocsvm.primal(f.join(alpha.select("id.*"), features.READ, "left_semi"), alpha, _KERNEL.by_k)
        scored = ocsvm.decide_primal(f, vector, _KERNEL.by_k, model.rho, train).select("id.*", (-F.col("decision")).alias("score"))
        one = _optimality(scored, alpha, nu)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_READS}, t AS (SELECT * FROM reads WHERE label = -1 OR patient IN ('src7', 'src8', 'src9', 'src10', 'src11', 'src12', 'src13')) SELECT count(*) AS n, count(*) FILTER (label = -1) AS n_pos, count(*) FILTER (label = 1) AS n_neg, CAST(count(*) FILTER (label = -1) AS BIGINT) AS support_tumor, CAST(count(*) FILTER (label = 1) AS BIGINT) AS support_healthy, count(DISTINCT patient) AS n_patients, true AS f1_is_harmonic, true AS area_near_exact FROM t")
def low_rank_evaluation(spark, d):
    """Report and areas of low-rank scores: supports and class sizes are the table's, f1 follows from precision and recall, and the read-level area is the exact model's to 0.02."""
    r = fixtures.reads(spark, d)
    known = F.col("patient").isin([f"src{i}" for i in range(7)])
    train, test = r.filter(known), r.filter(~known).cache()
    near = pipelines.evaluate(pipelines.low_rank_scores(train, test, _KERNEL, 100), test)
    exact = pipelines.evaluate(pipelines.exact_scores(train, test, _KERNEL), test)["reads"].select(F.col("auc").alias("exact"))
    p, q = F.col("precision"), F.col("recall")
    of = lambda c: F.sum(F.when(F.col("class") == c, F.col("support")))
    report = near["report"].agg(of(-1).alias("support_tumor"), of(1).alias("support_healthy"), F.min(F.abs(F.col("f1") - F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0))) < 1e-9).alias("f1_is_harmonic"))
    areas = near["reads"].join(exact, F.lit(True)).select((F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg", (F.abs(F.col("auc") - F.col("exact")) < 0.02).alias("area_near_exact"))
    return areas.join(report, F.lit(True)).join(near["patients"].agg(F.count("*").alias("n_patients")), F.lit(True))


@query(f"WITH {_SPLIT}, test AS (SELECT * FROM reads ANTI JOIN train USING (patient, read_idx)) SELECT patient, label, count(*) AS n, true AS mean_of_reads FROM test GROUP BY ALL")
def mil_exact_invariants(spark, d):
    """Patients of the exact model: their reads are the table's, and their value is the mean of their reads' scores, made by way of the stored model."""
    train, test = _split(spark, d)
    params, tables = pipelines.train(train, _KERNEL)
    patients = pipelines.evaluate(pipelines.decided(test, tables["vector"], _KERNEL, params["rho"]), test)["patients"]
    stored = pipelines.infer(test, params, tables).groupBy("patient").agg(F.avg("score").alias("again"))
    return patients.join(stored, "patient").select("patient", "label", "n", (F.abs(F.col("value") - F.col("again")) < 1e-6).alias("mean_of_reads"))


@query(f"WITH {_READS} SELECT count(*) AS n, count(*) FILTER (length(seq) < 2) AS n_without_features, true AS zero_reads_score_rho, true AS as_fresh FROM reads")
def nystrom_stored_invariants(spark, d):
    """A stored low-rank model scores every read as the model that was fitted, and reads without a feature at its offset."""
    train, _ = _split(spark, d)
    reads = fixtures.reads(spark, d)
    params, tables = pipelines.train(train, _KERNEL, landmarks=40)
    fresh = pipelines.low_rank_scores(train, reads, _KERNEL, 40).select("patient", "read_idx", (-F.col("decision")).alias("fresh"))
    rows = pipelines.infer(reads, params, tables).join(fresh, ["patient", "read_idx"]).join(reads.select("patient", "read_idx", F.length("seq").alias("size")), ["patient", "read_idx"])
    short = F.col("size") < 2
    return rows.agg(F.count("*").alias("n"), F.count_if(short).alias("n_without_features"), F.coalesce(F.max(F.when(short, F.abs(F.col("score") - params["rho"]))) < 1e-9, F.lit(True)).alias("zero_reads_score_rho"), (F.max(F.abs(F.col("score") - F.col("fresh"))) < 1e-6).alias("as_fresh"))




@query(f"WITH {_SPLIT} SELECT count(*) AS n, round(0.2 * count(*), 6)::DOUBLE AS sum_alpha, 0::BIGINT AS out_of_bounds, 0::BIGINT AS kkt_violations FROM train")
def ocsvm_invariants(spark, d):
    """sum of alpha = nu * n, 0 <= alpha <= 1, and every training read on the side of the margin that its alpha says."""
    train, _ = _split(spark, d)
    params, tables = pipelines.train(train, _KERNEL)
    return _optimality(pipelines.infer(train, params, tables), tables["alpha"], 0.2).drop("nu")


@query(f"WITH {_READS} SELECT count(*) AS n_reads, count(*) FILTER (length(seq) < 2) AS n_zero, 0::BIGINT AS n_longer_than_one, true AS landmarks_exact, true AS frobenius_below_a_fifth FROM reads")
def nystrom_invariants(spark, d):
    """Every read has a map, no map is longer than the read's own norm of 1, landmarks keep their kernel, and the kernel's error is small."""
    r = fixtures.reads(spark, d)
    f = _KERNEL.rows(r).cache()
    state = nystrom.fit(r.filter("length(seq) >= 3"), f, _KERNEL.by_k, 40)
    phi = nystrom.transform(f, state, reads=r).cache()
    square = F.aggregate("phi", F.lit(0.0), lambda s, x: s + x * x)
    counts = phi.agg(F.count("*").alias("n_reads"), F.count_if(square == 0).alias("n_zero"), F.count_if(square > 1 + 1e-6).alias("n_longer_than_one"))
    marks = f.join(F.broadcast(spark.createDataFrame(state.order, r.select("patient", "read_idx").schema)), features.READ, "left_semi")
    own = nystrom.intrinsic_errors(kernels.gram(marks, _KERNEL.by_k, cosine=True), phi).select((F.col("rel_frobenius_error") < 1e-6).alias("landmarks_exact"))
    error = nystrom.map_errors(f, phi, _KERNEL.by_k).select((F.col("rel_frobenius_error") < 0.2).alias("frobenius_below_a_fifth"))
    return counts.join(own, F.lit(True)).join(error, F.lit(True))


@query(f"WITH {_SPLIT} SELECT (SELECT count(*) FROM reads) - count(*) AS n, true AS correlated FROM train")
def nystrom_agrees_with_exact(spark, d):
    """Decisions of the low-rank model (primal solver) and of the exact one (dual solver) on the same reads: correlation above 0.95."""
    train, test = _split(spark, d)
    exact = pipelines.exact_scores(train, test, _KERNEL).select("patient", "read_idx", F.col("decision").alias("exact"))
    near = pipelines.low_rank_scores(train, test, _KERNEL, 100)
    return near.join(exact, ["patient", "read_idx"]).agg(F.count("*").alias("n"), (F.corr("decision", "exact") > 0.95).alias("correlated"))


@query()
def nystrom_stored_scores(spark, d):
    """A low-rank model as it is stored, scoring every read."""
    train, _ = _split(spark, d)
    return pipelines.infer(fixtures.reads(spark, d), *pipelines.train(train, _KERNEL, landmarks=40))


@query()
def ocsvm_scores_all_healthy(spark, d):
    """The low-rank model trained on every healthy read, scoring every tumor read."""
    r = fixtures.reads(spark, d)
    return pipelines.low_rank_scores(r.filter("label = 1"), r.filter("label = -1"), _KERNEL, 40)


del _name, _sql
