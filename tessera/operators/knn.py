"""Exact k-nearest neighbours inside one table (J6) and SMOTE.

Cells of a k-d tree with exact radius checks
--------------------------------------------
Equal points collapse to one vector with their k + 1 lowest ids, so duplicates
cost nothing and cells of distinct vectors can always be split. A k-d tree
from a bounded sample cuts the space into cells of about ``cell_rows``
vectors; the exact bounding boxes of the cells follow from one aggregate.
Round one finds every vector's k + 1 nearest in its own cell, which bounds
the distance r of its true ones. Round two visits just the cells whose box is
within r of the vector (ties included) and keeps k + 1 per visit. The merge of
both is exact, ties by id. A task holds one cell's vectors and at most
``VISITS_PER_TASK`` visitors and works in blocks of CHUNK visitors; nothing
is collected per point beyond k + 1 neighbours a visit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rand import uniform
from tessera.operators.split import rank_assign
from tessera.session import BROADCAST_BYTES, materialize

CELL_ROWS = 2048
VISITS_PER_TASK = 50_000
CHUNK = 256
#: Above so many dimensions the matrix product takes single precision.
FLOAT_DIMS = 16
#: A first bound of a row's k-th distance comes from so many points.
FIRST = 512

_NBRS = "array<struct<d:double,id:long>>"


def _exact(q: np.ndarray, points: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the pairs (row, col), added up dimension by dimension."""
    sq = np.zeros(len(row))
    for i in range(q.shape[1]):
        sq += np.square(q[row, i] - points[col, i])
    return np.sqrt(sq)


def nearest_flat(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the queries, distances and ids of their k nearest points, by
    (row, distance, id). A matrix product gives all squared distances up to a
    known rounding error; the pairs within that error of a row's k-th are
    measured exactly, so the result is that of a full scan."""
    dims = points.shape[1]
    plain = len(points) <= k or not (np.isfinite(queries).all() and np.isfinite(points).all())
    if not plain:
        mid = points.mean(axis=0)
        p = points - mid
        size = np.square(p).sum(axis=1)
        kind = np.float32 if dims > FLOAT_DIMS and size.max() < 1e30 and np.abs(queries).max(initial=0.0) < 1e15 else np.float64
        side, size_k = np.ascontiguousarray(p.T, dtype=kind), size.astype(kind)
        unit = 4 * (dims + 8) * float(np.finfo(kind).eps)
    out = []
    for at in range(0, len(queries), CHUNK):
        q = queries[at : at + CHUNK]
        if plain:
            row, col = (v.ravel() for v in np.indices((len(q), len(points))))
        else:
            c = q - mid
            near = (-2 * c).astype(kind) @ side
            near += size_k  # less the square of the query, the same for its row
            slack = 2 * unit * (np.square(c).sum(axis=1) + size.max())
            bound = np.partition(near[:, : max(FIRST, k)], k - 1, axis=1)[:, k - 1] + slack
            row, col = np.nonzero(near <= bound[:, None].astype(np.float64))
            v = near[row, col].astype(np.float64)
            kth = v[np.lexsort((v, row))[np.searchsorted(row, np.arange(len(q))) + k - 1]]
            keep = v <= (kth + slack)[row]
            row, col = row[keep], col[keep]
        d = _exact(q, points, row, col)
        if plain:  # nothing is near a vector that is not a number
            row, col, d = (v[~np.isnan(d)] for v in (row, col, d))
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
        out.append((row[keep] + at, d[keep], ids[col[keep]]))
    none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, ids.dtype))
    return tuple(np.concatenate(v) for v in zip(none, *out))


def _nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per query its k nearest entries by (distance, id): distances and ids."""
    row, d, near = nearest_flat(queries, points, ids, k)
    if not len(queries):
        return [], []
    cuts = np.searchsorted(row, np.arange(1, len(queries)))
    return np.split(d, cuts), np.split(near, cuts)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dims)


def _entries(x: np.ndarray, ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Points and ids with a vector repeated for each of its ids."""
    lists = ids.combine_chunks()
    count = np.diff(lists.offsets.to_numpy())
    return np.repeat(x, count, axis=0), lists.flatten().to_numpy(zero_copy_only=False)


def _nbr_lists(dist: list[np.ndarray], found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, dist)]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *dist])), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["d", "id"])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of the splits of a full tree, in heap order."""
    dim, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    todo = [(0, sample)]
    while todo:
        node, rows = todo.pop()
        if node >= len(dim):
            continue
        if len(rows):
            dim[node] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            value[node] = np.median(rows[:, dim[node]])
        right = rows[:, dim[node]] > value[node]
        todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
    return dim, value


def knn_self_join(df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, excluding the point itself;
    ties broken by id) -> (id, nbrs array<struct<d: double, id>>). Ids are
    unique; a table of fewer than k + 1 points gives shorter lists."""
    spark, dims = df.sparkSession, len(cols)
    pts = df.select(F.col(id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    # the row limit is applied in each task before the shuffle
    rank = F.row_number().over(Window.partitionBy("x").orderBy("_id"))
    few = pts.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    vecs = materialize(few.groupBy("x").agg(F.sort_array(F.collect_list("_id")).alias("ids")))
    n = vecs.count()

    cells = max(1, min(-(-n // cell_rows), BROADCAST_BYTES // (16 * dims)))
    depth = (cells - 1).bit_length()
    wanted = min(64 << depth, BROADCAST_BYTES // (8 * dims))
    share = min(1.0, wanted / max(n, 1))
    picked = vecs.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").collect() if depth else []
    tree = spark.sparkContext.broadcast(_tree(np.array([r["x"] for r in picked]).reshape(-1, dims), depth))

    @F.arrow_udf("long")
    def cell_of(x: pa.Array) -> pa.Array:
        dim, value = tree.value
        m = _matrix(pa.chunked_array([x]), dims)
        node = np.zeros(len(m), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (m[np.arange(len(m)), dim[node]] > value[node])
        return pa.array(node)

    table = materialize(vecs.select(F.col("ids")[0].alias("vid"), "x", "ids", cell_of("x").alias("cell")))
    box = [F.array(*[f(F.col("x")[i]) for i in range(dims)]).alias(a) for f, a in ((F.min, "lo"), (F.max, "hi"))]
    rows = table.groupBy("cell").agg(*box).collect()  # at most BROADCAST_BYTES
    boxes = spark.sparkContext.broadcast((np.array([r["cell"] for r in rows], np.int64), np.array([r["lo"] for r in rows]).reshape(-1, dims), np.array([r["hi"] for r in rows]).reshape(-1, dims)))

    def gap(lo, hi, blo, bhi):
        """Distances between a box (or points) and boxes."""
        return np.sqrt(np.square(np.maximum(0, np.maximum(blo - hi, lo - bhi))).sum(axis=-1))

    def own(t: pa.Table) -> pa.Table:
        x = _matrix(t["x"], dims)
        dist, found = _nearest(x, *_entries(x, t["ids"]), k + 1)
        r = np.array([d[-1] if len(d) > k else np.inf for d in dist]) * (1 + 1e-12)
        cell, lo, hi = boxes.value
        here = t["cell"][0].as_py()
        close = np.flatnonzero((cell != here) & (gap(x.min(axis=0), x.max(axis=0), lo, hi) <= r.max()))
        visits: list[list[int]] = [[] for _ in range(len(x))]
        for c in close:
            for i in np.flatnonzero(gap(x, x, lo[c], hi[c]) <= r):
                visits[i].append(int(cell[c]))
        vectors = t["x"].cast(pa.list_(pa.field("element", pa.float64())))
        return pa.table({"vid": t["vid"], "x": vectors, "nbrs": _nbr_lists(dist, found), "visits": pa.array(visits, pa.list_(pa.int64()))})

    first = materialize(table.groupBy("cell").applyInArrow(own, f"vid long, x array<double>, nbrs {_NBRS}, visits array<long>"))
    visits = first.select("vid", "x", F.explode("visits").alias("cell"))
    most = visits.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // VISITS_PER_TASK) or 1
    visits = visits.withColumn("part", F.pmod(F.xxhash64("vid"), F.lit(parts)))
    hosts = table.select("x", "ids", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def visit(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows:
            return pa.table({"vid": pa.array([], pa.int64()), "nbrs": _nbr_lists([], [])})
        return pa.table({"vid": q["vid"], "nbrs": _nbr_lists(*_nearest(_matrix(q["x"], dims), *_entries(_matrix(t["x"], dims), t["ids"]), k + 1))})

    away = visits.groupBy("cell", "part").cogroup(hosts.groupBy("cell", "part")).applyInArrow(visit, f"vid long, nbrs {_NBRS}")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("nbrs"))), 1, k + 1).alias("near")
    near = first.select("vid", "nbrs").unionByName(away).groupBy("vid").agg(best)
    near = first.select("vid", "x").join(near, "vid").select("x", "near")
    return pts.join(near, "x").select(F.col("_id").alias(id_col), F.slice(F.filter("near", lambda e: e["id"] != F.col("_id")), 1, k).alias("nbrs"))


def smote(
    df: DataFrame, id_col: str, cols: Sequence[str], label_col: str, minority=1, ratio: float = 1.0, k: int = 5, seed: int = 42,
    neighbours: Callable[[DataFrame, str, Sequence[str], int], DataFrame] = knn_self_join,
) -> DataFrame:
    """Oversample the minority class to ``ratio * n_majority`` rows:
    each synthetic row is x + gap * (neighbour - x) with a random one of the
    k nearest minority neighbours and gap ~ U[0,1); ``neighbours`` finds them
    (exactly, unless a forest is given for many dimensions). Synthetic rows are
    spread evenly over the minority points in a seeded hash order. Output:
    originals (synthetic = false) then synthetic rows (origin id, draw t)."""
    y = F.col(label_col)
    mino = df.where(y == minority)
    counts = df.agg(F.count_if(y == minority).alias("n_min"), F.count_if(y != minority).alias("n_maj")).first()
    n_min, n_maj = counts["n_min"], counts["n_maj"]
    orig = df.select(id_col, *cols, label_col, F.lit(False).alias("synthetic"), F.lit(None).cast("int").alias("t"))
    n_syn = int(ratio * n_maj) - n_min
    if n_syn <= 0 or n_min < 2:
        return orig
    nn = neighbours(mino, id_col, cols, k)
    base, extra = divmod(n_syn, n_min)
    # the first ``extra`` points in a seeded hash order get one more sample:
    # exact ranks from the bucketed histogram, no global sort
    order = rank_assign(mino.select(id_col), id_col, None, lambda r, n: (r < extra).cast("int"), "_plus", "smote", seed)
    reps = F.lit(base) + F.col("_plus")
    syn = order.select(id_col, reps.alias("_reps")).where("_reps > 0").join(nn, id_col)
    syn = syn.select(id_col, "nbrs", F.explode(F.sequence(F.lit(0), F.col("_reps") - 1)).alias("t"))
    pick = F.floor(uniform(F.col(id_col), "smote:nn", seed, F.col("t")) * F.size("nbrs")).cast("int")
    syn = syn.withColumn("_nb", F.element_at("nbrs", pick + 1)["id"]).withColumn(
        "_gap", uniform(F.col(id_col), "smote:gap", seed, F.col("t"))
    )
    base_x = mino.select(id_col, *cols)
    nb_x = mino.select(F.col(id_col).alias("_nb"), *[F.col(c).alias(f"_nb_{c}") for c in cols])
    s = syn.join(base_x, id_col).join(nb_x, "_nb")
    new = [(F.col(c) + F.col("_gap") * (F.col(f"_nb_{c}") - F.col(c))).alias(c) for c in cols]
    synth = s.select(id_col, *new, F.lit(minority).cast(df.schema[label_col].dataType).alias(label_col),
                     F.lit(True).alias("synthetic"), F.col("t").cast("int").alias("t"))
    return orig.unionByName(synth)
