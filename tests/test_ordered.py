from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemark.operators import histories, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold well over a third of the rows."""
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n)),
            "v": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 10, n).round(2)),
            "w": rng.integers(0, 5, n),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_positions_per_group(skewed):
    pdf, df = skewed
    out = ordered.with_position(df, [F.col("v").desc(), F.col("id")], by=["g"], total="n").toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
    np.testing.assert_array_equal(out["position"], want)
    np.testing.assert_array_equal(out["n"], pdf.groupby("g")["id"].transform("size"))


def test_running_sums(skewed):
    pdf, df = skewed
    out = ordered.with_running_sums(df, ["v", "id"], ["w"]).toPandas().sort_values("id")
    s = pdf.sort_values(["v", "id"])["w"]
    np.testing.assert_array_equal(out["w_before"], (s.cumsum() - s).sort_index())
    assert (out["w_total"] == pdf["w"].sum()).all()


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p995": 0.995, "p100": 1.0, "p0": 0.0}
    out = ordered.quantiles(df, "v", probs, ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(out.loc[g, list(probs)].to_numpy(float), np.quantile(part["v"], list(probs.values())))


def test_quantiles_of_few_and_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (9.0,), (4.0,)], "v double")
    r = ordered.quantiles(df, "v", {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}).first()
    assert tuple(r) == pytest.approx((1.03, 1.75, 3.0, 8.85))


@pytest.mark.parametrize("n", [5, 6, 7, 10, 23, 40])
def test_rank_bins_equal_quantile_cut(spark, n):
    bins = pd.qcut(pd.Series(range(1, n + 1)), 4, labels=False) + 1
    got = spark.range(1, n + 1).select(ordered.quantile_bin(F.col("id"), F.lit(n), 4).alias("b")).toPandas()["b"]
    np.testing.assert_array_equal(got, bins)


def test_previous_and_running_max(skewed):
    pdf, df = skewed
    s = ordered.scan(df, ["g"], ["id"])
    s = ordered.running_max(ordered.previous(s, ["g"], ["v"]), ["g"], "v", "top")
    out = ordered.unscan(s).toPandas().sort_values("id")
    by = pdf.sort_values("id").groupby("g")["v"]
    np.testing.assert_allclose(out["previous_v"], by.shift(1))
    np.testing.assert_allclose(out["top"], by.cummax().groupby(pdf["g"]).shift(1))


def test_histories_of_one_long_run(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"run": 1, "t": np.arange(500), "v": rng.random(500), "stage": rng.choice(["x", "y"], 500)})
    df = spark.createDataFrame(pdf).repartition(9)
    got = histories.running_best(df, "run", "t", "v").toPandas().sort_values("t")
    best, last, patience = -1.0, 0, []
    for i, v in enumerate(pdf["v"]):
        if v > best:
            best, last = v, i
        patience.append(i - last)
    np.testing.assert_array_equal(got["patience"], patience)
    np.testing.assert_allclose(got["best"], pdf["v"].cummax())
    starts = histories.stage_starts(df, "run", "t", "stage").toPandas().sort_values("t")
    np.testing.assert_array_equal(starts["starts"], pdf["stage"] != pdf["stage"].shift(1))
    area = histories.area_under(df, "run", "t", "v").first()["area"]
    assert area == pytest.approx(np.trapezoid(pdf["v"], pdf["t"]) / 499)


@pytest.mark.parametrize(("items", "reach", "small"), [(800, 0.01, 100_000), (800, 0.01, 0), (8, 1e-6, 100_000)])
def test_bracketed_quantiles_equal_sorting(spark, monkeypatch, items, reach, small):
    """Sketches that hold, counts too many for one window, and sketches that err."""
    monkeypatch.setattr(ordered, "KLL_ITEMS", items)
    monkeypatch.setattr(ordered, "KLL_REACH", reach)
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", small)
    rng = np.random.default_rng(3)
    groups = {
        "bell": rng.normal(size=5000), "few": rng.integers(0, 4, 3000).astype(float), "two": np.array([1.0, 2.0]),
        "one": np.array([-7.5]), "tail": np.exp(rng.normal(size=4000) * 4), None: rng.uniform(size=50),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(6)
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.77, "e": 1.0}
    out = ordered.bracketed_quantiles(df, "value", probs, ["g"], [F.count("*").alias("rows"), F.sum("value").alias("total")])
    got = {r.g: r for r in out.collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert [got[g][n] for n in probs] == pytest.approx([np.quantile(xs, p) for p in probs.values()])
        assert got[g].rows == len(xs) + (g == "two") and got[g].total == pytest.approx(xs.sum())


def test_bracketed_quantiles_of_nan_and_nothing(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", float("nan")), ("x", 3.0), ("y", float("nan"))], "g string, value double")
    got = {r.g: (r.low, r.high) for r in ordered.bracketed_quantiles(df, "value", {"low": 0.0, "high": 1.0}, ["g"]).collect()}
    assert got["x"][0] == 1.0 and np.isnan(got["x"][1]) and np.isnan(got["y"]).all()
    assert ordered.bracketed_quantiles(df.limit(0), "value", {"m": 0.5}, ["g"]).count() == 0
