"""The fitted bundle of gates against a plain version, saved and loaded, on batches and on a stream."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions.arrays import whitened_distance
from sievemark.operators.bundle import GateEstimator, GateModel

BOUNDS = {"min_brightness": 10.0, "max_brightness": 90.0, "min_contrast": 1.0, "min_sharpness": 1.0, "min_green_frac": 0.1}
ADVICE = {k: f"about {k}" for k in ("too_dark", "too_bright", "too_blurry", "low_contrast", "no_leaf", "ood", "low_confidence")}
SCHEMA = (
    "id long, split string, kind string, y int, logits array<double>, knn double, mahalanobis double,"
    " brightness double, contrast double, sharpness double, green_frac double"
)


def _row(i, split, kind, y, logits, knn, light=50.0, maha=1.0):
    return (i, split, kind, y, logits, knn, maha, light, 5.0, 5.0, 0.5)


@pytest.fixture(scope="module")
def rows():
    """Own rows lie at knn below 0.4, foreign ones above 0.6; every tenth own answer is wrong and unsure."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(200):
        y, wrong = i % 3, i % 10 == 0
        z = [0.0, 0.0, 0.0]
        z[(y + 1) % 3 if wrong else y] = float(rng.uniform(0.5, 1.0) if wrong else rng.uniform(4.0, 6.0))
        out.append(_row(i, "val" if i < 100 else "test", "id", y, z, float(rng.uniform(0.1, 0.4)), 5.0 if i % 25 == 7 else 50.0))
    for i in range(200, 260):
        far = i % 2 == 0
        out.append(_row(i, "cal" if i < 230 else "test", "far" if far else "near", None, [1.0, 1.1, 0.9], float(rng.uniform(0.6, 0.9))))
    return out


def _estimator(**more):
    return GateEstimator(["a", "b", "c"], BOUNDS, ADVICE, **more)


def test_fit_equals_a_plain_version(spark, rows):
    model = _estimator(target=0.95).fit(spark.createDataFrame(rows, SCHEMA))
    t = model.getOrDefault("temperature")
    val = [r for r in rows if r[1] == "val"]

    def soft(z, t):
        e = [math.exp(x / t) for x in z]
        return [x / sum(e) for x in e]

    def loss(t):
        return sum(-math.log(soft(r[4], t)[r[3]] + 1e-12) for r in val)

    assert loss(t) <= min(loss(t * 1.01), loss(t / 1.01))
    missing = sorted(1 - soft(r[4], t)[r[3]] for r in val)
    n = len(val)
    assert model.getOrDefault("qhat") == pytest.approx(missing[math.ceil(math.ceil((n + 1) * 0.9) / n * (n - 1))])
    assert model.getOrDefault("scorer") == "knn"  # msp and energy part the sides less well here
    assert model.getOrDefault("level") == 0.995  # foreign rows pass at no level
    tau = model.getOrDefault("tau")
    assert tau == pytest.approx(np.quantile([r[5] for r in val], 0.995))
    passed = [r for r in val if r[7] >= 10 and r[5] <= tau]
    best = 0.5
    for c in sorted({max(soft(r[4], t)) for r in passed}):
        at = [int(np.argmax(r[4])) == r[3] for r in passed if max(soft(r[4], t)) >= c]
        if sum(at) / len(at) >= 0.95:
            best = c
            break
    assert model.getOrDefault("tauConf") == pytest.approx(best)


def test_loaded_model_decides_alike_on_batches_and_streams(spark, rows, tmp_path):
    odd = [
        _row(300, "test", "id", 0, None, None, 5.0),  # dark: needs neither logits nor score
        _row(301, "test", "id", 0, None, 0.2),
        _row(302, "test", "id", None, [9.0, 0.0, 0.0], 0.2),
        _row(302, "test", "id", None, [9.0, 0.0, 0.0], 0.2),
    ]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    fitted = _estimator().fit(df)
    fitted.save(str(tmp_path / "gates"))
    model = GateModel.load(str(tmp_path / "gates"))
    flat = [F.col("id"), F.col("decision.status").alias("status"), F.col("decision.reason").alias("reason"), F.col("decision.label").alias("label")]
    test = df.where("split = 'test'")
    want = sorted(map(tuple, fitted.transform(test).select(*flat).collect()), key=str)
    got = sorted(map(tuple, model.transform(test).select(*flat).collect()), key=str)
    assert got == want
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[300] == ("rejected", "low_quality", None)
    assert by_id[301][0] == "uncertain" and by_id[301][2] is None
    assert by_id[302] == ("accepted", None, "a") and sum(r[0] == 302 for r in got) == 2
    assert all(by_id[i] == ("rejected", "ood", None) for i in range(230, 260))
    test.write.parquet(str(tmp_path / "in"))
    live = model.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).select(*flat)
    live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(
        str(tmp_path / "out")
    ).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want


def test_a_side_without_rows_is_an_error(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for side in ("val", "cal"):
        with pytest.raises(ValueError, match="calibration"):
            _estimator().fit(df.where(F.col("split") != side))


def test_whitened_distance_is_the_smallest_quadratic_form(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4, 4))
    cov, means, x = a @ a.T + np.eye(4), rng.normal(size=(3, 4)), rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(20, None)], "id int, v array<double>")
    got = dict(df.select("id", whitened_distance("v", means, cov)).collect())
    inverse = np.linalg.inv(cov)
    for i, v in enumerate(x):
        assert got[i] == pytest.approx(min((v - m) @ inverse @ (v - m) for m in means))
    assert got[20] is None
