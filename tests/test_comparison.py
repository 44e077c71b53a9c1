"""Model comparison and label audit from out-of-fold predictions, against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import audit, metrics


def _f1(y, p, w):
    out = []
    for c in set(y[w > 0]) | set(p[w > 0]):
        hit, have, said = w[(y == c) & (p == c)].sum(), w[y == c].sum(), w[p == c].sum()
        out.append(2 * hit / (have + said))
    return float(np.mean(out))


def test_comparison_is_paired_and_equals_a_plain_version(spark):
    rng = np.random.default_rng(11)
    n, reps = 60, 40
    y = rng.integers(0, 3, n)
    answers = {"main": np.where(rng.random(n) < 0.8, y, (y + 1) % 3), "worse": np.where(rng.random(n) < 0.5, y, (y + 2) % 3)}
    answers["twin"] = answers["main"]
    rows = [(m, i, int(y[i]), int(p[i])) for m, p in answers.items() for i in range(n)]
    df = spark.createDataFrame(rows, "model string, id long, y int, pred int")
    got = {r["model"]: r for r in metrics.compare_models(df, "main", replicates=reps).collect()}

    def weight(i, rep):
        u = int(hashlib.md5(f"boot{rep // 4}:{i}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8], 16) / 2**32
        return sum(u >= s for s in metrics.POISSON_STEPS)

    w = np.array([[weight(i, r) for i in range(n)] for r in range(reps)])
    assert set(got) == set(answers)
    for m, p in answers.items():
        f1 = [_f1(y, p, w[r]) for r in range(reps)]
        assert got[m]["f1_lo"] == pytest.approx(np.quantile(f1, 0.025))
        assert got[m]["f1_hi"] == pytest.approx(np.quantile(f1, 0.975))
        assert got[m]["errors"] == (p != y).sum() and got[m]["macro_f1"] == pytest.approx(_f1(y, p, np.ones(n)))
    gaps = np.array([_f1(y, answers["main"], w[r]) - _f1(y, answers["worse"], w[r]) for r in range(reps)])
    assert got["worse"]["diff_lo"] == pytest.approx(np.quantile(gaps, 0.025))
    assert got["worse"]["share_not_better"] == pytest.approx((gaps <= 0).mean())
    twin = got["twin"]
    assert (twin["diff"], twin["diff_lo"], twin["diff_hi"], twin["share_not_better"]) == (0.0, 0.0, 0.0, 1.0)
    assert got["main"]["diff"] is None and got["main"]["share_not_better"] is None


def test_comparison_of_nothing_has_no_rows(spark):
    df = spark.createDataFrame([], "model string, id long, y int, pred int")
    assert metrics.compare_models(df, "main", replicates=4).count() == 0


def test_centroids_leave_out_the_own_fold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y, fold = rng.integers(0, 2, 40), rng.integers(0, 4, 40)
    rows = [(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(40)]
    rows += [(40, None, 0, 1), (41, [1.0, 2.0, 3.0], 9, 2), (42, [1.0, 2.0, 3.0], None, 2)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, fold int")
    out = {r["id"]: r["logits"] for r in audit.out_of_fold_centroids(df, "v", "y", "fold", (0, 1), 2.0).collect()}
    for i in range(40):
        for c in (0, 1):
            others = x[(y == c) & (fold != fold[i])]
            assert out[i][c] == pytest.approx(2 * x[i] @ others.mean(axis=0))
    assert out[40] is None and len(out[41]) == len(out[42]) == 2


def test_a_class_of_one_fold_has_no_probability_there(spark):
    rows = [(0, [1.0], 0, 0), (1, [1.0], 0, 1), (2, [5.0], 1, 1)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, fold int")
    out = {r["id"]: r["logits"] for r in audit.out_of_fold_centroids(df, "v", "y", "fold", (0, 1)).collect()}
    assert out[2][1] < -1e8 and out[0][1] == pytest.approx(5.0)


def test_issues_are_ranked_by_self_confidence_and_reported(spark):
    issues = spark.createDataFrame(
        [(3, 0, 1, 0.2, 0.7), (1, 0, 1, 0.1, 0.8), (2, 1, 0, 0.1, 0.6)], "id int, y int, pred int, given_prob double, pred_prob double"
    )
    ranks = {r["id"]: r["rank"] for r in audit.ranked_issues(issues, "id").collect()}
    assert ranks == {1: 1, 2: 2, 3: 3}
    said = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, pred int")
    rows = {(r["section"], r["key"]): (r["n"], r["rate"]) for r in audit.audit_report(issues, said, "y").collect()}
    assert rows["all", "issues"] == (3, 0.75) and rows["pair", "0>1"][0] == 2
    assert rows["model", "oof_accuracy"] == (4, 0.75)
    assert rows["model", "oof_macro_f1"][1] == pytest.approx((2 / 3 + 4 / 5) / 2)
