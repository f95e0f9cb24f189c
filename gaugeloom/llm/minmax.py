"""Near-duplicate documents by min-max hashing of word shingles.

Under each of ``permutations`` hash functions both the smallest and the largest
value of a document's shingles are kept, so the signature has twice as many
unbiased components as hash evaluations.  ``rows`` components make a band;
documents that share a band are candidates.

Work is kept whole without emitting all pairs of a group:

1. equal shingle sets fold into one class (its smallest id stands for it);
2. in each band bucket every class is compared with the bucket's smallest class,
   and takes the smallest class that it is linked with as its label;
3. buckets that still hold several labels are compared in full, in tasks of two
   blocks of at most about ``2 * block`` classes of one bucket that look only at
   pairs of different labels and emit only confirmed links.  A pair that shares
   several such buckets is looked at in one of them.

Every link is confirmed on full shingle sets computed from the whole texts
(64-bit shingle hashes of 64-bit word hashes).  Sets are computed again only for
the classes that share a bucket, and each is written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, bounded, small_batches
from .graph import components

#: Bits of the map of ids whose texts are read again.
BITS = 1 << 24
SIGNATURE = "id long, n_shingles long, d1 long, d2 long, bands array<long>"


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted distinct set."""
    if not len(s):
        return 0, 0
    a = K.mix(s * K.U64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    b = K.mix(s + K.U64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + K.U64(len(s))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _extremes(s: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    low = high = None
    for i in range(0, len(s), 1 << 15):
        v = s[i : i + (1 << 15), None] * a + c
        lo, hi = v.min(0), v.max(0)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return np.concatenate([low, high])


def sketch(permutations: int, rows: int, width: int):
    """mapInArrow function (id, text) -> SIGNATURE."""
    rng = np.random.Generator(np.random.PCG64(97))
    a = rng.integers(0, 2**64, permutations, dtype=np.uint64) | np.uint64(1)
    c = rng.integers(0, 2**64, permutations, dtype=np.uint64)
    n_bands = 2 * permutations // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.mix(np.arange(1, n_bands + 1, dtype=np.uint64))
        odd = np.arange(1, 2 * rows, 2, dtype=np.uint64)
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j, part, o in K.runs(buf, off):
                sets = K.shingle_sets(part, o, width)
                digests = [_digest(s) for s in sets]
                keys = []
                for s in sets:
                    if len(s):
                        v = _extremes(s, a, c)[: n_bands * rows].reshape(n_bands, rows)
                        keys.append(K.mix(K.mix(v * odd).sum(1, dtype=np.uint64) + salt).view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else [], pa.int64())),
                    ],
                    names=["id", "n_shingles", "d1", "d2", "bands"],
                )

    return run


def sets_of(width: int):
    """mapInArrow function (id, text) -> (id, d1, set): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j, part, o in K.runs(buf, off):
                sets = K.shingle_sets(part, o, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([_digest(s)[0] for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["id", "d1", "shingles"],
                )

    return run


def _set(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both) and both > 0


def confirm_pairs(num: int, den: int):
    """mapInArrow function over (a, b, a_set, b_set) -> linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(_set(x), _set(y), num, den) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def confirm_blocks(num: int, den: int):
    """applyInArrow function over one pair of blocks of a bucket -> links that join labels.

    Rows: (task, key, x, y, block, label, keys, shingles).  Pairs inside a block
    are looked at only by the task of that block with itself (x = y), and a pair
    only in the first of the buckets that it shares.
    """

    def run(t: pa.Table) -> pa.Table:
        out = []
        key = t.column("key").to_numpy()
        for k in np.unique(key):
            one = t.filter(pa.array(key == k))
            labels, block = one.column("label").to_numpy(), one.column("block").to_numpy()
            keys = [set(x) for x in one.column("keys").to_pylist()]
            sets = [_set(v) for v in one.column("shingles")]
            alone = one.column("x")[0].as_py() == one.column("y")[0].as_py()
            size = np.array([len(s) for s in sets])
            root = np.unique(labels, return_inverse=True)[1]
            for i in range(1, len(sets)):
                late = (root[:i] != root[i]) & ((block[:i] == block[i]) == alone)
                late &= np.minimum(size[:i], size[i]) * den >= num * np.maximum(size[:i], size[i])
                for j in np.flatnonzero(late).tolist():
                    if root[i] == root[j] or min(keys[i] & keys[j]) != k:
                        continue
                    if _linked(sets[i], sets[j], num, den):
                        out.append((labels[i], labels[j]))
                        root[root == root[i]] = root[j]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def marked(wanted: DataFrame, rows: DataFrame, id_col: str = "id", absent: bool = False) -> DataFrame:
    """Rows whose id may be among the wanted ones, by a bitmap of BITS bits at most (2 MB).

    With ``absent`` the other rows, null ids included, whose id certainly is not.
    Spares most texts a shuffle; where the bitmap is full it lets everything
    through as possible.  ``wanted`` has the ids in a column of the same name.
    """
    at = F.pmod(F.xxhash64(id_col), F.lit(BITS)) + 1
    bits = wanted.where(F.col(id_col).isNotNull()).select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits")
    )
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)) & F.col(id_col).isNotNull()
    kept = [f"`{c}`" for c in rows.columns]
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col("__bucket"), "left").where(~hit if absent else hit).select(*kept)


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, d1, leader, l1) of the classes that share a band with another one."""
    entries = classes.select("rep", "d1", F.explode("bands").alias("key"))
    leaders = entries.groupBy("key").agg(F.min(F.struct("rep", "d1")).alias("l"), F.count("*").alias("n")).where("n > 1")
    return entries.join(leaders.select("key", F.col("l.rep").alias("leader"), F.col("l.d1").alias("l1")), "key")


def _leader_links(buckets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Confirmed (a, b): a bucket's smallest class and another of its classes."""
    pairs = buckets.where("leader < rep").select(F.col("leader").alias("a"), F.col("l1").alias("a1"), F.col("rep").alias("b"), F.col("d1").alias("b1")).distinct()
    left = sets.select(F.col("id").alias("a"), F.col("d1").alias("a1"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("id").alias("b"), F.col("d1").alias("b1"), F.col("shingles").alias("b_set"))
    return (
        pairs.join(right, ["b", "b1"]).join(left, ["a", "a1"]).select("a", "b", "a_set", "b_set").mapInArrow(confirm_pairs(num, den), "a long, b long").distinct()
    )


def _labels(links: DataFrame) -> DataFrame:
    """(rep, label): the smallest class two steps of links down, for classes that have one."""
    one = links.groupBy("b").agg(F.min("a").alias("a"))
    two = one.select(F.col("b").alias("a"), F.col("a").alias("aa"))
    return one.join(two, "a", "left").select(F.col("b").alias("rep"), F.coalesce("aa", "a").alias("label"))


def _late_links(scratch: Scratch, rest: DataFrame, sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links between labels of the buckets (key, rep, d1, label, n) that hold several."""
    big = rest.groupBy("key", "label").agg(F.count("*").alias("size")).where(f"size >= {block // 2}")
    big = bounded(scratch.store(big, "big"))
    open_keys = rest.groupBy("rep", "d1").agg(F.collect_set("key").alias("keys"))
    # a large label has blocks of its own, small ones share blocks; small buckets share tasks
    solo = F.col("size").isNotNull()
    cuts = F.ceil(F.coalesce("size", "n") / block).cast("long")
    salt = F.when(solo, F.xxhash64(F.lit(1), "rep", "d1")).otherwise(F.xxhash64(F.lit(2), "label"))
    own = F.when(solo, F.col("label"))
    members = scratch.store(
        rest.join(big, ["key", "label"], "left").select("key", "rep", "d1", "label", own.alias("own"), F.xxhash64(own, F.pmod(salt, cuts)).alias("block")),
        "members",
    )
    blocks = scratch.store(members.groupBy("key", "block", "own").agg(F.count("*").alias("m")), "blocks")
    others = blocks.select("key", F.col("block").alias("y"), F.col("own").alias("y_own"))
    tasks = (
        blocks.withColumnRenamed("block", "x").join(others, "key").where("x <= y AND NOT (own IS NOT NULL AND own <=> y_own)").select("key", "x", "y")
    )
    several = blocks.groupBy("key").agg(F.count("*").alias("k"), F.sum("m").alias("m")).where("k > 1").select("key", F.lit(True).alias("cut"))
    bundles = max(1, -(-rest.count() // (2 * block)))
    task = F.when(F.col("cut"), F.xxhash64("key", "x", "y")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bundles)))
    dealt = (
        tasks.join(bounded(scratch.store(several, "several")), "key", "left")
        .select("key", task.alias("task"), "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    )
    known = sets.join(open_keys.withColumnRenamed("rep", "id"), ["id", "d1"])
    return (
        members.join(bounded(scratch.store(dealt, "dealt")), ["key", "block"])
        .withColumnRenamed("rep", "id")
        .join(known, ["id", "d1"])
        .select("task", "key", "x", "y", "block", "label", "keys", "shingles")
        .groupBy("task")
        .applyInArrow(confirm_blocks(num, den), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: tuple[int, int] = (8, 10),
    width: int = 5,
    permutations: int = 40,
    rows: int = 4,
    block: int = 512,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked when den * |A & B| >= num * |A | B| for their shingle
    sets; ``component_id`` is the smallest id reachable by links, itself
    included, and ``kept`` says that it is the document's own.  With 40 hash
    evaluations (80 components in 20 bands of 4) a pair at similarity 0.85 is
    missed as a candidate with probability 4e-7, one at 0.8 with 3e-5.

    Null or empty texts and texts without words have the empty set and are
    linked with nothing.  A null id is linked with nothing: its component is
    null and it is kept.  Rows that repeat an id belong to one component.  Ids
    are integers.  An empty table gives an empty table; other columns are
    ignored, whatever their names.
    """
    num, den = similarity
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minmax")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = scratch.store(d.mapInArrow(sketch(permutations, rows, width), SIGNATURE), "sketches")
    some = sig.where("id IS NOT NULL AND n_shingles > 0")
    classes = scratch.store(some.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "classes")
    buckets = scratch.store(_buckets(classes), "buckets")
    wanted = scratch.store(buckets.select(F.col("rep").alias("id"), "d1").distinct(), "wanted")
    again = marked(wanted, d).mapInArrow(sets_of(width), "id long, d1 long, shingles binary")
    sets = again.groupBy("id", "d1").agg(F.first("shingles").alias("shingles")).join(wanted, ["id", "d1"])
    sets = scratch.store(sets, "sets")
    links = scratch.store(_leader_links(buckets, sets, num, den), "links")
    labels = scratch.store(_labels(links), "labels")

    placed = buckets.join(labels, "rep", "left").select("key", "rep", "d1", F.coalesce("label", "rep").alias("label"))
    placed = scratch.store(placed, "placed")
    scratch.drop(buckets, wanted)
    several = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    rest = scratch.store(placed.join(bounded(scratch.store(several, "several")), "key"), "rest")
    scratch.drop(placed)

    # what is left joins labels: a graph with a vertex for each label, not for each document
    known = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
    upper = labels.select(F.col("rep").alias("a"), F.col("label").alias("la"))
    joined = links.join(known, "b").join(upper, "a", "left").select(F.coalesce("la", "a").alias("a"), F.col("lb").alias("b")).where("a <> b")
    if rest.limit(1).count():
        joined = joined.unionByName(_late_links(scratch, rest, sets, num, den, block))
    joined = scratch.store(joined.distinct(), "joined")
    final = scratch.store(components(joined), "components").select(F.col("id").alias("label"), "component")
    named = (
        classes.select("d1", "d2", "rep")
        .join(labels, "rep", "left")
        .withColumn("label", F.coalesce("label", "rep"))
        .join(final, "label", "left")
        .select("d1", "d2", F.coalesce("component", "label").alias("component_id"))
    )
    named = scratch.store(named, "named")
    scratch.drop_others(sig, named)
    # rows that repeat an id under several texts meet in the smallest component
    linked = sig.where("n_shingles > 0").select("id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    linked = linked.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = sig.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
