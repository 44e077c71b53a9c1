"""The gates of a classifier as one estimator: fitted together, saved, loaded, applied to batches and streams."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.arrays import energy, softmax
from sievemark.operators import calibration, gates, ood
from sievemark.operators.metrics import predicted
from sievemark.session import stored

MEASURES = ("brightness", "contrast", "sharpness", "green_frac")
SLACK = 1e-12  # the record that sets the conformal threshold stays inside its own set


def _scores(df: DataFrame, temperature: float) -> dict[str, Column]:
    """Every scorer that the columns allow: two from logits, the others as columns of their own name."""
    found = {"msp": 1 - F.array_max(softmax("logits", temperature)), "energy": energy("logits", temperature)}
    return found | {name: F.col(name) for name in ood.PREFERENCE if name not in found and name in df.columns}


class _Shared(Params):
    classes = Param(Params._dummy(), "classes", "class names in the order of the logits", TypeConverters.toListString)
    bounds = Param(Params._dummy(), "bounds", "bounds of the quality gate by name")
    advice = Param(Params._dummy(), "advice", "text for each issue and reason")

    def issues(self) -> Column:
        return gates.quality_issues(*[F.col(c) for c in MEASURES], self.getOrDefault("bounds"))


class GateModel(Model, _Shared, DefaultParamsWritable, DefaultParamsReadable):
    """Fitted gates. ``transform`` adds ``score`` and ``decision`` (see :func:`gates.decide`).

    Needs ``logits``, the four measures and, unless the scorer is ``msp`` or ``energy``, a column named after the
    scorer. A row that fails the quality gate needs none of the rest; a row that passes it but has no logits or
    no score is ``uncertain`` without a label.
    """

    temperature = Param(Params._dummy(), "temperature", "divisor of the logits", TypeConverters.toFloat)
    qhat = Param(Params._dummy(), "qhat", "conformal threshold", TypeConverters.toFloat)
    scorer = Param(Params._dummy(), "scorer", "chosen foreignness score", TypeConverters.toString)
    level = Param(Params._dummy(), "level", "share of validation rows under tau", TypeConverters.toFloat)
    tau = Param(Params._dummy(), "tau", "largest score that passes", TypeConverters.toFloat)
    tauConf = Param(Params._dummy(), "tauConf", "least confidence of an accepted row", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        scored = df.withColumns(
            {"_probs": softmax("logits", get("temperature")), "score": _scores(df, get("temperature"))[get("scorer")]}
        )
        decision = gates.decide(
            "_probs", "score", self.issues(), get("classes"), get("tau"), get("qhat") + SLACK, get("tauConf"), get("advice")
        )
        return scored.withColumn("decision", decision).drop("_probs")


class GateEstimator(Estimator, _Shared):
    """Fits temperature, conformal threshold, scorer, foreignness and confidence thresholds, in this order.

    Rows: ``split`` and ``kind``, ``y`` (position of the class), ``logits``, the measures and scores by name. Own
    validation rows (``split = 'val'``, ``kind = 'id'``) fit all but the scorer and its level, which also see
    the foreign calibration rows (``split = 'cal'``, ``kind`` near or far). The confidence threshold uses only rows past
    both gates. Rows with NULL in logits, class, or a score are left out of the fit; a side without rows is an error.
    """

    alpha = Param(Params._dummy(), "alpha", "share of sets that may miss the class", TypeConverters.toFloat)
    maxAccept = Param(Params._dummy(), "maxAccept", "share of foreign rows that may pass", TypeConverters.toFloat)
    target = Param(Params._dummy(), "target", "accuracy of accepted rows", TypeConverters.toFloat)

    def __init__(self, classes, bounds, advice, alpha: float = 0.1, maxAccept: float = 0.01, target: float = 0.99):
        super().__init__()
        self._set(classes=list(classes), bounds=bounds, advice=advice, alpha=alpha, maxAccept=maxAccept, target=target)

    def _fit(self, df: DataFrame) -> GateModel:
        get = self.getOrDefault
        extra = [name for name in ood.PREFERENCE if name in df.columns]
        wanted = df.where("(split = 'val' and kind = 'id') or (split = 'cal' and kind <> 'id')").select(
            "split", "kind", "y", "logits", *extra, (F.size(self.issues()) == 0).alias("clean")
        )
        rows = stored(wanted.where("kind <> 'id' or y is not null").na.drop(subset=["logits", *extra]), "gates")
        sides = {r["split"] for r in rows.select("split").distinct().collect()}  # at most two
        if sides != {"val", "cal"}:
            raise ValueError(f"gates need own validation and foreign calibration rows, found {sorted(sides)}")
        t = calibration.fit_temperature(rows.where("split = 'val'"), "logits", "y")
        scores = _scores(rows, t)
        scaled = predicted(rows.withColumn("probs", softmax("logits", t)))
        done = stored(scaled.select("split", "kind", "y", "clean", "probs", "conf", "correct", *[c.alias(n) for n, c in scores.items()]))
        own, foreign = done.where("split = 'val'"), done.where("split = 'cal'")
        qhat = calibration.qhat(own, "probs", "y", get("alpha")).first()["qhat"]
        areas = ood.scorer_comparison(done.unpivot(["kind"], list(scores), "scorer", "score"))
        scorer = ood.choose_scorer(areas).first()["scorer"]
        level, tau = gates.foreign_threshold(own, foreign, scorer, get("maxAccept")).first()
        passed = own.where(F.col("clean") & (F.col(scorer) <= tau))
        sure = gates.confidence_threshold(passed, "conf", "correct", get("target")).first()["tau_conf"]
        model = GateModel()._set(temperature=t, qhat=qhat, scorer=scorer, level=float(level), tau=float(tau), tauConf=sure)
        return model._set(classes=get("classes"), bounds=get("bounds"), advice=get("advice"))
