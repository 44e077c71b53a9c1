from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.functions import arrays, hashing, rules, text


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row if len(cols) > 1 else row[0]


@pytest.mark.parametrize(
    "name,pattern",
    [("C10P10H1.jpg", "C#P#H#"), ("20231123_102720 (2).jpg", "#_#"), ("aug_12_3.jpeg", "aug_#_#"), ("a/b/.x7", ".x#")],
)
def test_name_pattern(spark, name, pattern):
    assert one(spark, p=text.name_pattern(F.lit(name))) == pattern


def test_labels_and_paths(spark):
    assert one(spark, s=text.label_slug(F.lit(" Leaf  Rust! "))) == "leaf_rust"
    label = text.canonical_label(F.lit(" cercospra "), ["Healthy", "Cercospora"], {"Cercospra": "Cercospora"})
    assert one(spark, c=label) == "Cercospora"
    assert one(spark, c=text.canonical_label(F.lit("maize"), ["Healthy"], {})) is None
    assert one(spark, c=text.class_id(F.lit("b"), ["a", "b"])) == 1
    assert one(spark, c=text.source_split(F.lit("raw/Train Aug/x/1.jpg"))) == "train aug"
    assert one(spark, c=text.source_split(F.lit("test.jpg"))) == ""
    assert one(spark, c=text.run_fold(F.lit("2024-net-cv3-s42"))) == 3
    assert one(spark, c=text.run_fold(F.lit("2024-net"))) is None
    assert one(spark, c=text.run_slug(F.lit("!!"))) == "run"
    assert one(spark, c=text.matches_any(F.lit("aug_/x.jpg"), ["^aug_"])) is False


def test_hash_bits(spark):
    row = one(
        spark,
        ones=hashing.hex_to_long(F.lit("ffffffffffffffff")),
        d=hashing.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long")),
        png=hashing.sniff_format(F.unhex(F.lit("89504E470D0A1A0A00"))),
        webp=hashing.sniff_format(F.unhex(F.lit("524946460000000057454250"))),
        no=hashing.sniff_format(F.unhex(F.lit("4749"))),
    )
    assert tuple(row) == (-1, 64, "PNG", "WEBP", None)


def test_word_signature_matches_plain_python(spark):
    import hashlib
    import re

    texts = ["One two two three", "", "déjà vu — DÉJÀ", "x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.signature for r in hashing.text_signatures(df, "id", "t").collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"[\W_]+", t.lower()) if w]
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] == (value - (1 << 64) if value >> 63 else value)


def test_word_signature_over_cuts_and_repeated_keys(spark, monkeypatch):
    """Texts of many words are summed in pieces; rows of one key are one text, as when each word was a row."""
    words = [f"w{i % 700}" for i in range(2000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:900])), (2, " ".join(words[900:])), (3, None), (4, "...")], "id int, t string")
    want = {r.id: r.signature for r in hashing.text_signatures(df, "id", "t").collect()}
    assert want[1] == want[2] and want[3] == want[4] == 0
    whole = hashing._bit_counts(pa.array([words, [""], words[:300]]))
    monkeypatch.setattr(hashing, "WORDS", 64)
    assert hashing._bit_counts(pa.array([words, [""], words[:300]])).equals(whole)


def test_probability_arrays(spark):
    p = F.array(*[F.lit(v) for v in (0.4, 0.3, 0.2, 0.1)])
    flat = F.array(*[F.lit(0.25)] * 4)
    z = F.array(*[F.lit(v) for v in (1.0, 2.0, 4.0)])
    row = one(
        spark,
        top=arrays.argmax(flat),
        a=arrays.prediction_set(p, 0.0),
        b=arrays.prediction_set(flat, 0.0),
        c=arrays.prediction_set(p, 0.75),
        named=arrays.candidate_classes(p, F.array(F.lit(0)), 0.15),
        cold=arrays.softmax(z, 0.5),
        warm=arrays.softmax(z, 5.0),
        energy=arrays.energy(z, 2.0),
        area=arrays.trapezoid(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)), [0.0, 0.5, 1.0]),
    )
    assert row.top == 0 and row.a == [0] and row.b == [0] and row.c == [0, 1] and row.named == [0, 1, 2]
    v = np.array([1.0, 2.0, 4.0])
    for got, t in ((row.cold, 0.5), (row.warm, 5.0)):
        e = np.exp(v / t)
        np.testing.assert_allclose(got, e / e.sum())
    assert max(row.warm) < max(row.cold)
    assert row.energy == pytest.approx(-2 * np.log(np.exp(v / 2).sum()))
    assert row.area == pytest.approx(0.5)


def test_vector_kernels(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(40, 5)), rng.normal(size=(3, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    out = df.select(
        "id", arrays.linear_scores("v", w, np.ones(3)).alias("s"), arrays.quadratic_scores("v", w, np.eye(5)).alias("q"),
        arrays.norm(arrays.unit("v")).alias("n"),
    ).toPandas().sort_values("id")
    np.testing.assert_allclose(np.stack(out.s), x @ w.T + 1)
    np.testing.assert_allclose(out.q, ((x[:, None] - w) ** 2).sum(2).min(1))
    np.testing.assert_allclose(out.n, 1)
    zero = one(spark, u=arrays.unit(F.array(F.lit(0.0), F.lit(0.0))))
    assert zero == [0.0, 0.0]


def test_first_reason_and_order_of_issues(spark):
    rows = spark.createDataFrame([(0, 10), (5, 10), (50, 1), (50, 99)], "size int, pixels int").select(
        rules.intake_reason(F.col("size"), F.when(F.col("size") > 5, "PNG"), F.col("pixels"), F.col("pixels") == 1, 100, 90).alias("r")
    ).collect()
    assert [r.r for r in rows] == ["empty_file", "unsupported_media_type", "invalid_image", "image_too_large"]
    both = rules.all_issues([("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(True))])
    assert one(spark, i=both) == ["a", "c"]
    verdict = rules.difference_verdict(F.lit(-0.1), F.lit(0.2))
    assert one(spark, v=verdict) == "no clear difference"
