"""Operator 13: near-duplicate vectors by Euclidean p-stable hashing.

On unit vectors a cosine of at least 0.95 is a distance of at most sqrt(0.1). A hash is the quantised place
floor((a·v + b) / WIDTH) along a Gaussian direction a; ``hashes`` of them make the key of a table. How many
are joined follows from the number of vectors, so that about MATES unrelated ones share a bucket, and the
number of tables follows from the wanted recall at the very threshold (closer pairs are found more surely).

Crowds first become balls. In a bucket of at least CROWD vectors those within half the threshold's angle of
one of them form a ball: any two are linked by the triangle inequality, so the ball needs no pair at all.
This goes on table by table until no ball of some size is left. Then balls and single vectors that share a bucket are
candidates; a 64-bit sketch of signs drops those far apart before any vector moves, and each pair is decided
once: by the exact cosine of two single vectors, for balls by the angle of their centres and their radii, and
where these leave it open by the exact cosines of their members, in blocks of bounded size. Links between
balls give the components.

Only a crowd that is too loose for balls (few members within half the angle of any other) costs its pairs;
its bucket is dealt into blocks, so no task holds it whole, and only counts and ball pairs leave a task.

Cases: vectors that are null, empty, zero or hold a null or non-finite entry link with nothing and stand for
themselves, as do rows without an id (null ids link like others, but are never a component's name if another
id is there). Vectors of different lengths never link. Equal vectors are one class with a count. Rows that
repeat an id are each counted as other vectors. An empty table gives an empty table. Other columns are not
returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators.components import connected_components
from sievemark.session import stored

LEAST = 0.95
WIDTH = 2.0  # of a quantisation step
MATES = 8  # unrelated vectors that share a bucket, about
RECALL = 0.99  # of pairs at the threshold
CROWD = 32  # vectors of a bucket that are worth a ball
BLOCK = 512  # members of one block
SKETCH = 64
UNLIKE = 20  # signs that differ at most
SLACK = 1e-9  # radians that rounding may move an angle
SEED = 13


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one hash is the same at this distance (Datar et al. 2004)."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, least: float = LEAST) -> tuple[int, int]:
    """``(hashes of a key, tables)`` for this many vectors."""
    hashes = max(1, math.ceil(math.log(max(rows / MATES, 2)) / -math.log(collision(math.sqrt(2)))))
    near = collision(math.sqrt(2 - 2 * least)) ** hashes
    return hashes, max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-near)))


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest entry is taken out first, so nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, unit vectors)`` for each length in the column."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, units(flat.astype(np.float64).reshape(-1, size))


class Hashing:
    """Directions, offsets and sketch directions for vectors of one length."""

    def __init__(self, size: int, hashes: int, tables: int):
        rng = np.random.default_rng((SEED, size))
        self.size, self.shape = size, (tables, hashes)
        self.directions = rng.normal(size=(size, hashes * tables))
        self.offsets = rng.uniform(0, WIDTH, hashes * tables)
        self.signs = rng.normal(size=(size, SKETCH))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        places = np.floor((unit @ self.directions + self.offsets) / WIDTH).astype(np.int16)
        tables, hashes = self.shape
        cells = np.ascontiguousarray(places.reshape(len(unit), tables, hashes))
        return np.array([[xxhash.xxh64_intdigest(cell.tobytes(), t << 20 | self.size) for t, cell in enumerate(row)] for row in cells], np.uint64).view(np.int64).reshape(len(unit), tables)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64).ravel()


def _hashed(classes: DataFrame, hashes: int, tables: int) -> DataFrame:
    """Classes with a key for each table and a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashing] = {}
        for batch in batches:
            keys, sketches = np.zeros((batch.num_rows, tables), np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, unit in by_length(batch.column("v")):
                size = unit.shape[1]
                if size not in made:
                    made[size] = Hashing(size, hashes, tables)
                keys[rows], sketches[rows] = made[size].keys(unit), made[size].sketches(unit)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sketches)], [*batch.schema.names, "keys", "sketch"])

    return classes.mapInArrow(run, f"{classes._jdf.schema().toDDL()}, keys array<long>, sketch long")


def _with_cosine(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The cosine of two vector columns, which have the same length in each row; the vectors go."""
    kept = [f for f in pairs.schema if f.name not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros(batch.num_rows)
            for (rows, x), (_, y) in zip(by_length(batch.column(a)), by_length(batch.column(b)), strict=True):
                made[rows] = np.clip((x * y).sum(axis=1), -1.0, 1.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(made)], [*[f.name for f in kept], "cosine"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return pairs.mapInArrow(run, f"{ddl}, cosine double")


def balls(hashed: DataFrame, tables: int, least: float = LEAST) -> DataFrame:
    """``(cls, ball, angle)``: classes of crowded buckets with the class at the centre of their ball.

    Only the members of crowded buckets move, and rounds end when a table has no bucket that is crowded by
    vectors near each other.
    """
    half = math.acos(least) / 2 - SLACK
    found = None
    for t in range(tables):
        keyed = hashed.select("cls", F.col("keys")[t].alias("key"))
        if found is not None:
            keyed = keyed.join(found.select(F.col("cls").alias("_in")), F.col("cls") == F.col("_in"), "left_anti")
        crowds = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("ball")).where(F.col("m") >= CROWD)
        crowds = stored(crowds.select(F.col("key").alias("_key"), "ball"), "crowds")
        near = stored(keyed.join(crowds, F.col("key") == F.col("_key")).select(F.col("cls").alias("_c"), "ball"), "crowded")
        vectors = hashed.select("cls", "v")
        centres = crowds.select(F.col("ball").alias("_b")).join(vectors, F.col("_b") == F.col("cls")).select("_b", F.col("v").alias("b"))
        pairs = near.join(vectors, F.col("_c") == F.col("cls")).select("cls", "ball", F.col("v").alias("a"))
        pairs = pairs.join(stored(centres, "centres"), F.col("ball") == F.col("_b")).drop("_b")
        inside = _with_cosine(pairs).where(F.col("cosine") >= math.cos(half)).select("cls", "ball", F.acos("cosine").alias("angle"))
        inside = stored(inside, "inside")
        sizes = stored(inside.groupBy("ball").count().where("count > 1"), "sizes")
        inside = inside.join(sizes.select(F.col("ball").alias("_b")), F.col("ball") == F.col("_b"), "left_semi")
        found = inside if found is None else stored(found.unionByName(inside), "inside")
        if sizes.where(F.col("count") >= CROWD // 4).isEmpty():
            break
    return found


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every pair of sketches."""
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])  # of a signed number numpy counts the absolute value


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of balls with like sketches in a bucket or a pair of its blocks; rows come sorted by (key, i, j)."""
    rest = None

    def pairs(keys: np.ndarray, own: np.ndarray, ball: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        ends = np.append(new, len(keys))
        a, b = [], []
        for start, end in zip(np.append(0, new), ends, strict=True):
            for at in range(start, end, BLOCK):
                x, y = np.nonzero(unlike(sketch[at : min(at + BLOCK, end)], sketch[at:end]) <= UNLIKE)
                # in a pair of different blocks only pairs across them; those within a block have their own task
                across = (y > x) & ((keys[start, 1] == keys[start, 2]) | (own[at + x] != own[at + y]))
                a.append(ball[at + x[across]])
                b.append(ball[at + y[across]])
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        parts = [keys, *(batch.column(c).to_numpy() for c in ("own", "ball", "sketch"))]
        parts = parts if rest is None else [np.concatenate(p) for p in zip(rest, parts, strict=True)]
        # the last bucket may go on in the next batch
        last = np.flatnonzero((parts[0] != parts[0][-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        rest = [p[cut:] for p in parts]
        if cut:
            yield pairs(*(p[:cut] for p in parts))
    if rest is not None:
        yield pairs(*rest)


def candidates(members: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: balls that share a bucket and are not far apart by their sketches, each once, stored."""
    keyed = members.select("ball", "sketch", F.explode("keys").alias("key"))
    keyed = keyed.groupBy("key", "ball").agg(F.min("sketch").alias("sketch"))  # a crowd is one row here
    keyed = stored(keyed, "keyed")
    sizes = stored(keyed.groupBy("key").count().where("count > 1").select(F.col("key").alias("_key"), F.ceil(F.col("count") / BLOCK).cast("int").alias("k")), "sizes")
    rows = keyed.join(sizes, F.col("key") == F.col("_key")).withColumn("own", F.pmod(F.xxhash64("ball"), "k").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    dealt = rows.select("key", "ball", "sketch", "own", others)
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ball", "sketch")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stored(dealt.mapInArrow(_search, "a long, b long").distinct(), "candidates")


def _across(open_pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """``(cls, ball, hits)``: for balls whose members have to be compared, how many rows of the other ball each class links with."""
    sizes = members.groupBy("ball").count().select(F.col("ball").alias("_ball"), F.ceil(F.col("count") / BLOCK).cast("int").alias("k"))
    wanted = open_pairs.select(F.col("a").alias("_b")).unionByName(open_pairs.select(F.col("b").alias("_b"))).distinct()
    some = stored(members.join(wanted, F.col("ball") == F.col("_b"), "left_semi"), "members")
    dealt = some.join(stored(sizes, "sizes"), F.col("ball") == F.col("_ball")).withColumn("part", F.pmod(F.xxhash64("cls"), "k"))
    blocks = stored(dealt.groupBy("ball", "part").agg(F.collect_list(F.struct("cls", "n", "v")).alias("m")), "blocks")

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("ball").alias(f"_{name}"), F.transform("m", lambda m: m["cls"]).alias(f"{name}_cls"), F.transform("m", lambda m: m["n"]).alias(f"{name}_n"), F.flatten(F.transform("m", lambda m: m["v"])).alias(f"{name}_v"))

    met = open_pairs.select("a", "b").join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (units(np.array(row[f"{s}_v"], np.float64).reshape(len(row[f"{s}_cls"]), -1)) for s in "ab")
                linked = np.einsum("id,jd->ij", x, y) >= least
                out = []
                for s, other, hit in (("a", "b", linked), ("b", "a", linked.T)):
                    hits = hit @ np.array(row[f"{other}_n"], np.int64)
                    own = np.flatnonzero(hits)
                    out.append((np.array(row[f"{s}_cls"], np.int64)[own], np.full(len(own), row[other]), hits[own]))
                cls, ball, hits = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(ball), pa.array(hits)], ["cls", "ball", "hits"])

    return met.drop("_a", "_b").mapInArrow(run, "cls long, ball long, hits long")


def near_copies(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    v = F.col(embedding)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda x: x + F.lit(0).cast("float"))).alias("v"))  # -0.0 becomes 0.0
    rows = stored(rows, "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return alone
    hashes, tables = plan(total, least)
    hashed = stored(_hashed(classes, hashes, tables), "hashed")
    inside = stored(balls(hashed, tables, least).select(F.col("cls").alias("_cls"), "ball", "angle"), "balls")
    members = hashed.join(inside, F.col("cls") == F.col("_cls"), "left").drop("_cls")
    members = stored(members.withColumns({"ball": F.coalesce("ball", "cls"), "angle": F.coalesce("angle", F.lit(0.0))}), "members")
    facts = members.groupBy("ball").agg(F.sum("n").alias("weight"), F.max("angle").alias("radius"), F.min("first").alias("first"))
    centres = members.where("cls = ball").select(F.col("cls").alias("_c"), "v")
    facts = stored(facts.join(stored(centres, "centres"), F.col("ball") == F.col("_c")).drop("_c"), "facts")

    met = candidates(members)
    for s in ("a", "b"):
        side = facts.select(F.col("ball").alias(f"_{s}"), F.col("v").alias(f"v{s}"), F.col("radius").alias(f"r{s}"), F.col("weight").alias(f"w{s}"))
        met = met.join(side, F.col(s) == F.col(f"_{s}")).drop(f"_{s}")
    met = _with_cosine(met, "va", "vb").withColumn("angle", F.acos("cosine"))
    bound, reach = math.acos(least), F.col("ra") + F.col("rb")
    single = (F.col("ra") == 0) & (F.col("rb") == 0) & (F.col("wa") >= 1)
    verdict = (
        F.when(single, F.when(F.col("cosine") >= least, "all").otherwise("none"))
        .when(F.col("angle") + reach <= bound - SLACK, "all")
        .when(F.col("angle") - reach > bound + SLACK, "none")
        .otherwise("some")
    )
    met = stored(met.select("a", "b", "wa", "wb", verdict.alias("verdict")).where("verdict <> 'none'"), "met")
    every = met.where("verdict = 'all'")
    some = stored(_across(met.where("verdict = 'some'"), members.select("cls", "ball", "n", "v"), least), "across")

    whole = every.select(F.col("a").alias("ball"), F.col("wb").alias("w")).unionByName(every.select(F.col("b").alias("ball"), F.col("wa").alias("w")))
    whole = stored(whole.groupBy("ball").agg(F.sum("w").alias("whole")), "whole")
    each = stored(some.groupBy("cls").agg(F.sum("hits").alias("each")), "each")
    home = members.select("cls", "ball")
    crossed = some.select(F.col("cls").alias("_cls"), F.col("ball").alias("b")).join(home, F.col("_cls") == F.col("cls")).select(F.col("ball").alias("a"), "b").distinct()
    parts = connected_components(every.select("a", "b").unionByName(crossed))
    named = facts.select("ball", "first", "weight").join(stored(parts, "parts"), F.col("ball") == F.col("node"), "left").withColumn("part", F.coalesce("component", "ball"))
    least_id = named.groupBy(F.col("part").alias("_part")).agg(F.min("first").alias("component_id"))
    named = stored(named.select("ball", "part", "weight"), "named").join(stored(least_id, "least"), F.col("part") == F.col("_part"))
    named = named.join(whole.withColumnRenamed("ball", "_w"), F.col("ball") == F.col("_w"), "left")
    named = stored(named.select(F.col("ball").alias("_ball"), "component_id", (F.col("weight") - 1 + F.coalesce("whole", F.lit(0))).alias("base")), "named")
    done = home.join(named, F.col("ball") == F.col("_ball")).join(each.withColumnRenamed("cls", "_e"), F.col("cls") == F.col("_e"), "left")
    done = stored(done.select("cls", "component_id", (F.col("base") + F.coalesce("each", F.lit(0))).alias("n_links")), "done")
    counted = classes.select("v", "n", "first", F.col("cls").alias("_c")).join(done, F.col("_c") == F.col("cls"))
    counted = stored(counted.select(F.col("v").alias("_v"), "n", "first", "n_links", "component_id"), "counted")
    # a vector without copies is its class's only row; copies find their class by value
    lone = counted.where("n = 1").select(F.col("first").alias("vec_id"), "n_links", "component_id")
    shared = stored(counted.where("n > 1").select("_v", "n_links", "component_id"), "shared")
    out = rows.join(shared, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())).unionByName(alone)
