"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors with equal labels are clustered; each vector goes to its ``OVERLAP``
nearest clusters, so the shards overlap.  Every shard builds a robust-pruned
graph over its vectors; the adjacency lists of a vector are united over its
shards.  Each vector is then searched from the medoid of its shards by greedy
best-first steps, and on through every vector found within the threshold (range
expansion).  Recall is audited against brute force for samples of vectors with
and without found links, and the search is widened until it meets the target;
if the widest search does not, all blocks of a label are compared in full.  Every
link is verified by its cosine in double precision.

Equal vectors fold into one class first.  Shards over ``BLOCK`` vectors are cut
into blocks; the vectors of two blocks search each other's graph in one task, so
memory is bounded whatever the size of a label or a cluster.  A task gives each
vector's number of links and a root of its links, not the pairs; a pair that
shares several shards counts in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored
from .graph import components
from .topk import usable

SHARD, BLOCK, OVERLAP = 768, 1536, 2
MAX_CLUSTERS, SAMPLE = 512, 8192
DEGREE, POOL, ALPHA, BEAM = 24, 64, 1.2, 32
#: Vectors audited of those with and of those without links, and the mean recall to meet.
AUDIT, TARGET, WIDEST = 256, 0.9, 64
#: Products computed at once.
SLICE = 1 << 16


def vectors_of(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arr), -1) if len(arr) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of unit vectors from a fixed start."""
    rng = np.random.Generator(np.random.PCG64(5))
    c = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def build(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned out-neighbours of each unit vector, with reverse edges."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    m = min(POOL, n - 1)
    pool = np.argpartition(-sim, m - 1, axis=1)[:, :m]
    rows = np.arange(n)[:, None]
    pool = np.take_along_axis(pool, np.argsort(-sim[rows, pool], axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(2 - 2 * sim[rows, pool], 0))
    alive = np.ones(pool.shape, bool)
    edges = []
    for _ in range(min(DEGREE, m)):
        has = np.flatnonzero(alive.any(1))
        if not len(has):
            break
        at = alive[has].argmax(1)
        pick = pool[has, at]
        edges.append(np.stack([has, pick], 1))
        between = np.sqrt(np.maximum(2 - 2 * sim[pick[:, None], pool[has]], 0))
        alive[has] &= ALPHA * between > far[has]
        alive[has, at] = False
    e = np.concatenate(edges)
    e = np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)
    return np.split(e[:, 1], np.searchsorted(e[:, 0], np.arange(1, n)))


def search(x: np.ndarray, near: list[np.ndarray], q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) positions with cosine of at least about the threshold."""
    width = max([1, *(len(a) for a in near)])
    table = np.full((len(x), width), -1, np.int64)
    for i, a in enumerate(near):
        table[i, : len(a)] = a
    medoid = int((x @ x.sum(0)).argmax())
    out = []
    for lo in range(0, len(q), 512):
        part = q[lo : lo + 512]
        front = np.full((len(part), len(x)), -np.inf, np.float32)
        visited = np.zeros(front.shape, bool)
        front[:, medoid] = part @ x[medoid]
        visited[:, medoid] = True
        hits = [np.stack([np.flatnonzero(front[:, medoid] >= threshold), np.full((front[:, medoid] >= threshold).sum(), medoid)], 1)]
        live, step = np.arange(len(part)), 0
        while len(live):
            pick = front[live].argmax(1)
            best = front[live, pick]
            go = np.isfinite(best) & ((step < beam) | (best >= threshold))
            live, pick = live[go], pick[go]
            front[live, pick] = -np.inf
            row = np.repeat(live, width)
            to = table[pick].reshape(-1)
            ok = to >= 0
            row, to = row[ok], to[ok]
            new = ~visited[row, to]
            row, to = row[new], to[new]
            visited[row, to] = True
            s = np.concatenate([np.einsum("ij,ij->i", part[row[k : k + SLICE]], x[to[k : k + SLICE]]) for k in range(0, max(len(row), 1), SLICE)])
            front[row, to] = s
            found = s >= threshold
            hits.append(np.stack([row[found], to[found]], 1))
            step += 1
        h = np.concatenate(hits)
        out.append((h[:, 0] + lo, h[:, 1]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _assign(sent, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, ids = b.column(0).to_pylist(), b.column(1).to_numpy()
            rows, shards = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            by: dict = {}
            for i, label in enumerate(labels):
                by.setdefault(label, []).append(i)
            for label, at in by.items():
                c = sent.value.get(label)
                at = np.array(at)
                if c is None:
                    rows.append(at)
                    shards.append(np.zeros(len(at), np.int64))
                    continue
                x = unit(vectors_of(b.column(2).take(pa.array(at))))
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
                rows.append(np.repeat(at, near.shape[1]))
                shards.append(near.reshape(-1))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.concatenate(shards)), b.column(1).take(at), b.column(2).take(at)],
                names=["label", "shard", "id", "v"],
            )

    return run


def _build(t: pa.Table) -> pa.Table:
    ids = t.column("id").to_numpy()
    near = build(unit(vectors_of(t.column("v"))))
    return pa.table({"id": pa.array(ids), "near": pa.array([ids[a].tolist() for a in near], pa.list_(pa.int64()))})


def _graph(ids: np.ndarray, lists: list) -> list[np.ndarray]:
    """Neighbours as positions among ``ids``; those of other blocks are left out."""
    order, near = np.argsort(ids), []
    for a in lists:
        a = np.array(a or [], np.int64)
        at = order[np.minimum(np.searchsorted(ids, a, sorter=order), len(ids) - 1)]
        near.append(at[ids[at] == a])
    return near


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position reachable from each of n positions by pairs (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _search(threshold: float, beam: int, exact: bool):
    """applyInArrow function over two blocks (or one with itself) -> (id, n, root)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, block, m = (t.column(c).to_numpy() for c in ("id", "block", "m"))
        raw, shard = vectors_of(t.column("v")), t.column("shard")[0].as_py()
        x = unit(raw).astype(np.float32)
        shards = t.column("shards").to_pylist()
        sides = [np.flatnonzero(block == k) for k in np.unique(block)]
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        found = []
        for left, right in [(sides[0], sides[0])] if one else [sides, sides[::-1]] if len(sides) == 2 else []:
            if exact:
                i, j = np.nonzero(x[right] @ x[left].T >= threshold - 1e-4)
            else:
                lists = t.column("near").take(pa.array(left)).to_pylist()
                i, j = search(x[left], _graph(ids[left], lists), x[right], threshold - 1e-4, beam)
            found.append(np.stack([right[i], left[j]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        pairs = pairs[ids[pairs[:, 0]] != ids[pairs[:, 1]]]
        ok = [cosine(raw[part[:, 0]], raw[part[:, 1]]) >= threshold for part in np.array_split(pairs, len(pairs) // SLICE + 1)]
        a, b = pairs[np.concatenate(ok)].T
        n = np.zeros(len(ids), np.int64)
        own = np.array([min(set(shards[i]) & set(shards[j])) == shard for i, j in zip(a, b, strict=True)], bool) if any(len(s) > 1 for s in shards) else np.ones(len(a), bool)
        np.add.at(n, a[own], m[b[own]])
        np.add.at(n, b[own], m[a[own]])
        order = np.argsort(ids)  # positions in the order of ids, so a root is the smallest id
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        low = ids[order[roots(rank[a], rank[b], len(ids))[rank]]]
        some = np.unique(np.concatenate([a, b]))
        return pa.table({"id": pa.array(ids[some]), "n": pa.array(n[some]), "root": pa.array(low[some])})

    return run


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision; lengths scaled against overflow."""
    a = a / np.maximum(np.abs(a).max(1, keepdims=True, initial=0), 1e-300)
    b = b / np.maximum(np.abs(b).max(1, keepdims=True, initial=0), 1e-300)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _links(classes: DataFrame, sent, threshold: float, overlap: int, beam: int, exact: bool = False) -> DataFrame:
    """(id, n, root) rows: sums of ``n`` by id are numbers of links, (id, root) are links' components."""
    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "id", "v").mapInArrow(_assign(sent, overlap), f"label {label}, shard long, id long, v array<double>")
    placed = stored(placed, "flat-shards")
    sizes = placed.groupBy("label", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(bounded(sizes), ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lists = placed.groupBy("id").agg(F.collect_list("shard").alias("shards"))
    if exact:
        lists = lists.withColumn("near", F.array().cast("array<long>"))
    else:
        near = placed.groupBy("label", "shard", "block").applyInArrow(_build, "id long, near array<long>")
        lists = lists.join(near.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "id")
    rows = placed.join(lists, "id").join(classes.select("id", "m"), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select(
        "label", "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "v", "near", "m", "shards"
    )
    return rows.groupBy("label", "shard", "i", "j").applyInArrow(_search(threshold, beam, exact), "id long, n long, root long")


def audit_recall(classes: DataFrame, degree: DataFrame, threshold: float, sample: int = AUDIT) -> tuple[float, int]:
    """Mean recall over the vectors that have links, and the number of true links it rests on.

    ``sample`` vectors with found links (degree: id, n) and as many without are
    compared with all vectors of their labels; a vector's recall is the share of
    its true links that were found, so a large group weighs no more than a pair.
    """
    known = classes.select("label", "id", "v", "m").join(degree, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = {r["linked"]: r["k"] for r in known.groupBy((F.col("n") > 0).alias("linked")).agg(F.count("*").alias("k")).collect()}
    chosen = []
    for linked in sizes:
        chosen += known.where((F.col("n") > 0) == linked).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).collect()
    by: dict = {}
    for r in chosen:
        by.setdefault((r["label"], len(r["v"])), []).append((r["id"], r["v"]))
    sent = classes.sparkSession.sparkContext.broadcast({k: (np.array([i for i, _ in x]), np.array([v for _, v in x], float)) for k, x in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            for label, i, v, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                v = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
                ids, x = sent.value.get((label, len(v)), (None, None))
                if ids is not None:
                    for k in ids[(cosine(x, np.broadcast_to(v, x.shape)) >= threshold) & (ids != i)].tolist():
                        seen[k] = seen.get(k, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["id", "n"])

    true = {r["id"]: r["n"] for r in classes.select("label", "id", "v", "m").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    having, caught = 0.0, 0.0  # vectors with links, and their recalls, by the strata's sizes
    for linked, size in sizes.items():
        part = [r for r in chosen if (r["n"] > 0) == linked]
        recalls = [r["n"] / true[r["id"]] for r in part if true.get(r["id"])]
        having += size * len(recalls) / len(part)
        caught += size * sum(recalls) / len(part)
    return (caught / having if having else 1.0), sum(true.values())


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and their
    lengths agree.  Null and zero vectors, vectors with null or non-finite
    components and rows without label link with nothing; a row without id has a
    null component and is kept.  Of rows that repeat an id, the smallest (label,
    vector) is compared, and every row gets the id's result.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    good = (
        base.where("id IS NOT NULL AND label IS NOT NULL AND " + usable() + " AND exists(v, x -> x <> 0)")
        .groupBy("id")
        .agg(F.min(F.struct("label", "v")).alias("s"))
        .select("id", F.concat_ws("/", F.col("s.label").cast("string"), F.size("s.v").cast("string")).alias("label"), F.col("s.v").alias("v"))
    )
    good = stored(good, "flat-vectors")
    classes = stored(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("m")).select("label", "id", "v", "m"), "flat-classes")
    counts = {r["label"]: r["n"] for r in classes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
    picked: dict = {}
    if counts:
        big = classes.where(F.col("label").isin(list(counts)))
        share = min(1.0, SAMPLE / sum(counts.values()))
        for r in big.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("label", "v").orderBy("label", "v").collect():
            picked.setdefault(r["label"], []).append(r["v"])
    cents = {label: centroids(unit(np.array(x, float)), min(MAX_CLUSTERS, -(-counts[label] * OVERLAP // SHARD), len(x))) for label, x in picked.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(cents)
    overlap, beam, exact = OVERLAP, BEAM, False
    while True:
        links = stored(_links(classes, sent, threshold, overlap, beam, exact), "flat-links")
        degree = stored(links.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0"), "flat-degrees")
        if exact or audit_recall(classes, degree, threshold)[0] >= TARGET:
            break
        overlap, beam = overlap * 2, beam * 2
        if overlap > WIDEST:  # compare in full
            overlap, exact, sent = 1, True, vectors.sparkSession.sparkContext.broadcast({})
    degree = degree.select(F.col("id").alias("rep"), F.col("n").alias("others"))
    comp = components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    result = (
        classes.select("label", "v", F.col("id").alias("rep"), "m")
        .join(degree, "rep", "left")
        .join(comp, "rep", "left")
        .select("label", "v", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    named = good.join(result, ["label", "v"]).select("id", "n", "c")
    return (
        base.select("id")
        .join(named, "id", "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
