from __future__ import annotations

import zipfile

import numpy as np
from pyspark.sql import functions as F

from pictures import picture, png_bytes
from sievemark.operators import groups, pairs
from sievemark.session import freeze
from sievemark.sources import files, images

CLASSES = ["Drum", "Flute", "Violin"]


def scan(spark, root):
    return files.scan_images(spark, str(root), CLASSES, {"Violine": "Violin"})


def test_listing_takes_images_only(spark, image_tree):
    paths = [r.path for r in files.list_images(spark, str(image_tree)).collect()]
    assert paths == sorted(paths) and len(paths) == 9 + 7
    assert not any("ghost" in p or p.endswith(".csv") for p in paths)


def test_manifest_of_good_and_bad_files(spark, image_tree):
    rows = {r.path: r for r in scan(spark, image_tree).collect()}
    issues = {p: list(r.issues) for p, r in rows.items() if r.issues}
    assert issues == {
        "training/Drum/nothing.png": ["empty_file"],
        "training/Drum/half.png": ["unreadable:DecodeError"],
        "training/Drum/stamp.png": ["too_small"],
        "training/Kazoo/solo.png": ["unknown_label"],
    }
    assert rows["training/Drum/nothing.png"].sha256 is None
    r = rows["validation/Violine/take-22.png"]
    assert (r.is_valid, r.label, r.class_id, r.source_split, r.name_pattern) == (True, "Violin", 2, "validation", "take-#")
    assert (r.width, r.height, r.mode, r.format) == (256, 192, "RGB", "PNG")
    assert r.cache_path == f"violin/{r.sha256[:20]}.jpg"
    assert rows["training/Drum/take-00 (3).png"].name_pattern == "take-#"


def test_copies_conflicts_and_turned_pictures(spark, image_tree):
    m = freeze(scan(spark, image_tree)).withColumn("status", groups.base_status(F.col("is_valid"), "path"))
    variants = m.where("is_valid").groupBy("phash").agg(F.min("phash_d4").alias("v"))
    out, counts = groups.assign_groups(m, signature="phash", variants=pairs.variant_pairs(variants, "phash", "v", 5))
    rows = {r.path: r for r in out.collect()}
    copies = [rows["training/Drum/take-00 (3).png"], rows["training/Drum/take-00.png"]]
    assert [r.status for r in copies] == ["ok", "duplicate"] and copies[1].duplicate_of == copies[0].path
    assert {rows[p].status for p in ("training/Drum/take-01.png", "validation/Flute/borrowed.png")} == {"conflict"}
    turned, plain = rows["training/Flute/upside.png"], rows["training/Flute/take-11.png"]
    assert turned.status == plain.status == "ok" and turned.group_id == plain.group_id
    ids = [r.group_id for r in rows.values() if r.status == "ok"]
    assert len(ids) - len(set(ids)) == 1 and counts.first().near_pairs == 1
    assert all(r.group_id is None for r in rows.values() if r.status != "ok")


def test_measures_follow_the_picture():
    base = picture(5) + np.random.default_rng(0).normal(0, 20, (192, 256, 1))
    sharp = images.measures(base)
    blurred = sum(np.roll(base, (i, j), (0, 1)) for i in range(5) for j in range(5)) / 25
    assert images.measures(blurred)[2] < sharp[2]
    assert images.measures(base * 0.3)[0] < sharp[0]
    flat = images.measures(np.full((50, 60, 3), 128.0))
    assert flat[1] < 1e-9 and flat[2] < 1e-9 and flat[3] == 0
    green = np.zeros((50, 60, 3))
    green[..., 1] = 200
    assert images.measures(green)[3] == 1.0
    assert images.measures(np.zeros((50, 60, 3)))[4] == 1.0
    assert images.measures(np.full((50, 60, 3), 255.0))[5] == 1.0


def test_hash_variants_find_turned_copies():
    a = images.turned_hashes(picture(11))
    for turned in (np.rot90(picture(11)), picture(11)[:, ::-1], picture(11).transpose(1, 0, 2)):
        b = images.turned_hashes(turned)[0]
        assert min(bin((b ^ v) & (2**64 - 1)).count("1") for v in a) <= 5
    other = images.turned_hashes(picture(12))[0]
    assert min(bin((other ^ v) & (2**64 - 1)).count("1") for v in a) > 5


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.png", png_bytes(picture(1, 20, 20)))
        z.writestr("x/2.txt", "hello")
    rows = files.read_archives(spark, str(tmp_path / "*.zip")).collect()
    assert sorted(r.name for r in rows) == ["x/1.png", "x/2.txt"]
    assert dict((r.name, bytes(r.content)) for r in rows)["x/2.txt"] == b"hello"
