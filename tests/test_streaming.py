"""The stateless scorer on a stream gives what the batch scorer gives."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import kernels, ocsvm
from helixframe.operators.kernel_rows import StringRows
from helixframe.plans.pipelines import Kernel
from helixframe.streaming import scoring

from .test_sequences import SAMPLE, frame


def test_stream_equals_batch(spark, tmp_path):
    kernel = Kernel(2, 1, (0.0, 1.0))
    train, test = frame(spark, [*SAMPLE, "ACGTACGT", "GGGAAATT"]), frame(spark, ["ATGCAA", "MHMHMH", "A", "ACNGT"])
    f, w = kernel.features(train), kernel.by_k
    alpha, rho = ocsvm.fit_rows(StringRows(train, f, w), 0.5)
    vector = ocsvm.primal(f, alpha, w)
    batch = {r.id.read_idx: r.decision for r in ocsvm.decide_primal(kernel.features(test), vector, w, rho).collect()}
    cross = kernels.normalise(kernels.cross_gram(kernel.features(test), f, w), kernels.diagonal(kernel.features(test), w), kernels.diagonal(f, w))
    assert {r.id.read_idx: r.decision for r in ocsvm.decide(cross, alpha, rho).collect()} == pytest.approx(batch)
    test.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test.schema).parquet(str(tmp_path / "in"))
    q = scoring.score_stream(stream, vector, w, 1, rho).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.read_idx: -r.score for r in spark.table("scored").collect()}
    assert {i: got[i] for i in batch} == pytest.approx(batch)
    assert got[2] == pytest.approx(-rho)
