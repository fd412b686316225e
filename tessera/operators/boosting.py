"""Leaf-wise gradient-boosted trees with early stopping by patience.

Features are binned once by approximate quantiles of mergeable summaries; a row is then one byte a
feature, its label, weight and margin. A tree grows best-first: of all leaves
the one with the largest gain is split, up to ``max_leaves``. Split finding
needs per leaf, feature and bin the sums of gradients and Hessians: one
aggregate over the rows (summed in every task, then by key), of the smaller
child alone, as its sibling is the parent less the child. One job computes the
children of the PREFETCH most promising nodes, those among them that are not yet
part of the tree: this changes no split but saves jobs, so that a tree takes about
as many as it has levels. The job for the root of a tree also sums the losses of
the trees before it, so the validation loss costs no pass of its own.

Rows are pinned as blocks of up to BLOCK_ROWS, a block's columns as bytes: a pass
reads arrays, not rows. It follows a block's rows only to the nodes asked for, and
computes margins and gradients of those rows alone.

Gradients are summed as integers (2^-SCALE_BITS units): results do not depend on
how rows are dealt to tasks, nor on retries.

The driver holds histograms of one tree's leaves (leaves x features x bins), and
the trees. Rows are pinned with their margin every REFRESH trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize

SCALE_BITS = 24
PREFETCH = 16
REFRESH = 8
BLOCK_ROWS = 1 << 16

_BLOCKS = "y binary, w binary, held binary, margin binary, bins binary"
_SUMS = "slot long, g long, h long, n long"


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1. Rows with a
    bin of at most ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = children
        for v in values:
            for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, v), (self.gain, 0.0)):
                column.append(x)
        return children

    def rows_of(self, bins: np.ndarray, rows: np.ndarray, wanted: Iterable[int] | None = None) -> dict[int, np.ndarray]:
        """Which of ``rows`` (columns of ``bins``) are in the leaves ``wanted``, by default all."""
        on_way = None
        if wanted is not None:
            above = {c: n for n, f in enumerate(self.feature) if f >= 0 for c in (self.left[n], self.right[n])}
            on_way = set()
            for n in wanted:
                while n not in on_way:
                    on_way.add(n)
                    n = above.get(n, 0)
        out, todo = {}, [(0, rows)]
        while todo:
            n, at = todo.pop()
            if on_way is not None and n not in on_way:
                continue
            if self.feature[n] < 0:
                out[n] = at
                continue
            go = bins[self.feature[n]][at] <= self.cut[n]
            todo += [(self.left[n], at[go]), (self.right[n], at[~go])]
        return out


def _margin(bins: np.ndarray, trees: Sequence[Tree], rows: np.ndarray | None = None) -> np.ndarray:
    """Summed values of the trees for every one of ``rows``, by default all."""
    out = np.zeros(bins.shape[1])
    for t in trees:
        for n, at in t.rows_of(bins, np.arange(bins.shape[1]) if rows is None else rows).items():
            out[at] += t.value[n]
    return out if rows is None else out[rows]


def _bin(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """(features, rows), one byte each: 0 for missing values, else 1 + the edges below."""
    out = np.zeros((len(edges), len(columns[0]) if len(columns) else 0), np.uint8)
    for i, (v, e) in enumerate(zip(columns, edges)):
        out[i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left"))
    return out


@dataclass
class LeafwiseModel:
    """``history``: (trees, training loss, validation loss or None) by round;
    scores use the first ``best`` trees."""

    features: list[str]
    edges: list[list[float]]
    init: float
    trees: list[Tree]
    history: list[tuple[int, float, float | None]]
    best: int
    stopped: int | None

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "trees": [t.__dict__ for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> LeafwiseModel:
        d = json.loads(text)
        return LeafwiseModel(**{**d, "trees": [Tree(**t) for t in d["trees"]], "history": [tuple(h) for h in d["history"]]})

    def history_table(self, spark: SparkSession, run: str = "leafwise") -> DataFrame:
        """Long metric history (run_id, step, train_loss, val_loss), as W4, W8 and M11 read it."""
        return spark.createDataFrame([(run, *h) for h in self.history], "run_id string, step int, train_loss double, val_loss double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """Total gain and number of splits of every feature."""
        gain, splits = [0.0] * len(self.features), [0] * len(self.features)
        for t in self.trees[: self.best]:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gain[f] += g
                    splits[f] += 1
        return spark.createDataFrame(list(zip(self.features, gain, splits)), "feature string, importance double, splits int")

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep``, the probability of class 1 and the class from 0.5 on."""
        model = df.sparkSession.sparkContext.broadcast((self.edges, self.trees[: self.best], self.init))

        @F.arrow_udf("double")
        def prob(*columns: pa.Array) -> pa.Array:
            edges, trees, init = model.value
            x = [c.to_numpy(zero_copy_only=False) for c in columns]
            return pa.array(1 / (1 + np.exp(-(init + _margin(_bin(x, [np.array(e) for e in edges]), trees)))))

        scored = df.select(*keep, prob(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features]).alias("prob"))
        return scored.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def _merged(values: np.ndarray, counts: np.ndarray, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order with their counts; with ``points``, at most
    so many, at equal steps of the rank: their ranks and the largest value are exact."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, counts, len(values)).astype(np.int64)
    if points and len(values) > points:
        upto = np.cumsum(counts)
        keep = np.unique(np.searchsorted(upto, -(-np.arange(1, points + 1) * upto[-1] // points)))
        values, counts = values[keep], np.diff(upto[keep], prepend=0)
    return values, counts


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """At most ``max_bins`` - 2 inner edges a feature (a byte holds a bin, 0 is
    for missing values): distinct approximate quantiles, in one pass. A task sums
    every feature up in values and counts, exactly while there are few distinct
    values, else in ``accuracy`` of them; pairs of equally many rows are merged, so a
    rank is off by about a share of 1 / accuracy for each doubling."""
    qs = np.arange(1, max_bins - 1) / (max_bins - 1)
    # adding zero makes -0.0 and 0.0 one edge
    src = df.select(*[F.coalesce(F.col(c).cast("double") + F.lit(0.0), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(features)])
    width = len(features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(width)]

        def add(parts: list[pa.RecordBatch]) -> None:
            for i, known in enumerate(levels):
                x = np.concatenate([b.column(i).to_numpy() for b in parts])
                x = x[~np.isnan(x)]
                one, level = _merged(x, np.ones(len(x)), accuracy), 0
                while level in known:
                    one, level = _merged(*(np.concatenate(v) for v in zip(known.pop(level), one)), accuracy), level + 1
                known[level] = one

        parts, n = [], 0
        for b in batches:
            parts.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                add(parts)
                parts, n = [], 0
        if n:
            add(parts)
        for i, known in enumerate(levels):
            if known:
                values, counts = _merged(*(np.concatenate(v) for v in zip(*known.values())), accuracy)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(counts)], ["feature", "value", "n"])

    def edges(t: pa.Table) -> pa.Table:
        values, counts = _merged(t["value"].to_numpy(), t["n"].to_numpy())
        upto = np.cumsum(counts)
        e = np.unique(values[np.searchsorted(upto, np.maximum(1, np.ceil(qs * upto[-1] - 1e-9)))])
        # a value above the largest edge must exist
        return pa.table({"feature": t["feature"][:1], "edges": pa.array([e[e < values[-1]].tolist()], pa.list_(pa.float64()))})

    few = src.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    sums = few.mapInArrow(run, "feature int, value double, n long")
    found = {r["feature"]: r["edges"] for r in sums.groupBy("feature").applyInArrow(edges, "feature int, edges array<double>").collect()}  # a row a feature
    return [list(found.get(i, [])) for i in range(width)]


def _binned(df: DataFrame, features: Sequence[str], edges: list[list[float]], label: str, weight: str | None, validation: str | None, init: float) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    src = df.select(
        d(label).alias("y"), (d(weight) if weight else F.lit(1.0)).alias("w"), (F.col(validation) if validation else F.lit(False)).alias("held"),
        *[F.coalesce(d(c), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(features)],
    ).where("y is not null and w is not null")
    known = [np.array(e) for e in edges]

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        y, w, held = (t.column(i).to_numpy() for i in range(3))
        codes = _bin([t.column(3 + i).to_numpy() for i in range(len(known))], known)
        held = np.array([h is True for h in held]) if held.dtype == object else held  # null: no validation row
        return _block(y, w, held, np.full(len(y), init), codes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield block(parts)
                    parts, n = [], 0
                parts.append(part)
                n += part.num_rows
        if parts:
            yield block(parts)

    return src.mapInArrow(run, _BLOCKS)


def _block(y: np.ndarray, w: np.ndarray, held: np.ndarray, margin: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
    columns = (np.ascontiguousarray(c, dtype=kind) for c, kind in ((y, np.float64), (w, np.float64), (held, np.uint8), (margin, np.float64), (bins, np.uint8)))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["y", "w", "held", "margin", "bins"])


def _blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """y, w, held, margin and bins (features, rows) of every block."""
    kinds = (np.float64, np.float64, np.bool_, np.float64, np.uint8)
    for b in batches:
        for i in range(b.num_rows):
            *columns, bins = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in enumerate(kinds))
            yield *columns, bins.reshape(width, len(columns[0]))


def _add_histograms(acc: np.ndarray, codes: np.ndarray, sel: np.ndarray, slot: np.ndarray, values: Sequence[np.ndarray | None]) -> None:
    """Adds to ``acc`` (slots, values, features, bins) the values (None: 1 each) of
    the rows ``sel`` by their slot. They are whole numbers with sums below 2^53 in a
    block: exact as doubles. Two features share a pass where their cells are few."""
    slots, _, width, bins = acc.shape
    two = 4 * slots * bins * bins <= len(sel)
    for f in range(0, width, 2 if two else 1):
        cell = slot * bins + codes[f][sel]
        both = two and f + 1 < width
        if both:
            cell = cell * bins + codes[f + 1][sel]
        shape = (slots, bins, bins) if both else (slots, bins)
        for j, v in enumerate(values):
            sums = np.bincount(cell, v, minlength=int(np.prod(shape))).reshape(shape).astype(np.int64)
            acc[:, j, f] += sums.sum(axis=2) if both else sums
            if both:
                acc[:, j, f + 1] += sums.sum(axis=1)


#: Rows of a leaf on one side of a split: (leaf, feature, cut, left).
Wanted = tuple[int, int, int, bool]


def _sums(rows: DataFrame, width: int, bins: int, recent: Sequence[Tree], tree: Tree, wanted: Sequence[Wanted | None], losses: bool) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Histograms (wanted, 3, features, bins) of gradients, Hessians and rows of
    the training rows (``None`` wants all), and summed losses and weights of both parts."""
    shared = rows.sparkSession.sparkContext.broadcast((list(recent), tree, list(wanted)))
    size = width * bins

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now, want = shared.value
        acc = np.zeros((len(want), 3, width, bins), np.int64)
        loss = np.zeros((2, 3), np.int64)
        unit = float(1 << SCALE_BITS)
        for y, w, held, margin, codes in _blocks(batches, width):
            if losses:
                margin = margin + _margin(codes, before)
                each = np.rint(w * (np.logaddexp(0, margin) - y * margin) * unit).astype(np.int64)
                for i, part in enumerate((~held, held)):
                    loss[i] += [each[part].sum(), np.rint(w[part] * unit).astype(np.int64).sum(), part.sum()]
            train = np.flatnonzero(~held)
            at = now.rows_of(codes, train, {x[0] for x in want if x is not None}) if any(want) else {}
            asked = [train if x is None else at[x[0]][(codes[x[1]][at[x[0]]] <= x[2]) == x[3]] for x in want]
            slot, sel = np.repeat(np.arange(len(want)), [len(a) for a in asked]), np.concatenate(asked)
            m = margin[sel] if losses else margin[sel] + _margin(codes, before, sel)
            p = 1 / (1 + np.exp(-m))
            g, h = np.rint(w[sel] * (p - y[sel]) * unit), np.rint(w[sel] * p * (1 - p) * unit)
            _add_histograms(acc, codes, sel, slot, (g, h, None))
        acc = acc.reshape(len(want), 3, size)
        slot, cell = np.nonzero(acc[:, 2])
        out = [np.r_[slot * size + cell, -1, -2], *(np.r_[acc[slot, j, cell], loss[:, j]] for j in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], ["slot", "g", "h", "n"])

    total = rows.mapInArrow(run, _SUMS).groupBy("slot").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    slot, sums = total["slot"].to_numpy(), [total[c].to_numpy() for c in "ghn"]
    hist = np.zeros((len(wanted), 3, size), np.int64)
    at = slot[slot >= 0]
    for j, s in enumerate(sums):
        hist[at // size, j, at % size] = s[slot >= 0]
    unit = float(1 << SCALE_BITS)
    parts = {name: (float(sums[0][slot == k].sum()) / unit, float(sums[1][slot == k].sum()) / unit) for k, name in ((-1, "train"), (-2, "val"))}
    return hist.reshape(len(wanted), 3, width, bins), parts


@dataclass
class _Leaf:
    hist: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = 0


def _best_split(hist: np.ndarray, min_rows: int, min_hessian: float, l2: float) -> _Leaf:
    """The split of most gain; of equal ones the first feature, then the lowest cut."""
    unit = float(1 << SCALE_BITS)
    g, h = hist[0] / unit, hist[1] / unit
    gl, hl, nl = np.cumsum(hist[0], 1)[:, :-1] / unit, np.cumsum(hist[1], 1)[:, :-1] / unit, np.cumsum(hist[2], 1)[:, :-1]
    gt, ht, nt = g[0].sum(), h[0].sum(), hist[2][0].sum()
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    ok = (nl >= min_rows) & (nr >= min_rows) & (hl >= min_hessian) & (hr >= min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2), 0.0)
    # sums of integers in these units: what is below their rounding is no gain
    best = int(np.argmax(gain))
    leaf = _Leaf(hist)
    if gain.flat[best] > 1e-9:
        leaf.gain, leaf.feature, leaf.cut = float(gain.flat[best]), best // gain.shape[1], best % gain.shape[1]
    return leaf


def _value(hist: np.ndarray, rate: float, l2: float) -> float:
    g, h = hist[0][0].sum(), hist[1][0].sum()
    return float(-rate * g / (h + l2 * (1 << SCALE_BITS))) if h else 0.0


def fit_leafwise(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, validation: str | None = None, max_leaves: int = 31,
    learning_rate: float = 0.1, max_iter: int = 100, patience: int = 10, max_bins: int = 64, min_rows: int = 20, min_hessian: float = 1e-3, l2: float = 0.0,
) -> LeafwiseModel:
    """logistic loss, best-first trees of at most ``max_leaves`` leaves.

    Rows where ``validation`` is true give the validation loss alone; fitting
    stops after ``patience`` rounds without a lower one, and scores use the trees
    up to the lowest (all without validation rows). Nulls and NaN share a bin of
    their own, the lowest; rows without a label or weight are left out.
    """
    if not 2 <= max_bins <= 256:
        raise ValueError("max_bins: 2 to 256, a byte a feature")
    spark, width = df.sparkSession, len(features)
    train = df if validation is None else df.where(~F.col(validation))
    edges = bin_edges(train, features, max_bins)
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    r = train.where(y.isNotNull()).agg(F.sum(w * y).alias("pos"), F.sum(w).alias("all")).first()
    share = min(max((r["pos"] or 0.0) / (r["all"] or 1.0), 1e-12), 1 - 1e-12)
    init = float(np.log(share / (1 - share)))
    rows = _few_tasks(materialize(_binned(df, features, edges, label, weight, validation, init)))
    trees: list[Tree] = []
    recent: list[Tree] = []  # not yet in the rows' margins
    history: list[tuple[int, float, float | None]] = []
    best, best_loss, stopped = 0, float("inf"), None
    while True:
        tree = Tree()
        (root,), loss = _sums(rows, width, max_bins, recent, tree, [None], True)
        if trees:
            held = loss["val"][0] / loss["val"][1] if loss["val"][1] else None
            history.append((len(trees), loss["train"][0] / loss["train"][1], held))
            if held is None:
                best = len(trees)
            elif held < best_loss:
                best, best_loss = len(trees), held
            elif len(trees) - best >= patience:
                stopped = len(trees)
        if stopped or len(trees) == max_iter or not root[2].any():
            break
        _grow(rows, width, max_bins, recent, tree, root, max_leaves, learning_rate, (min_rows, min_hessian, l2))
        if tree.leaves == 1:
            break
        trees.append(tree)
        recent.append(tree)
        if len(recent) == REFRESH:
            rows, recent = _few_tasks(materialize(_with_margin(rows, width, recent))), []
    return LeafwiseModel(list(features), edges, init, trees, history, best, stopped)


def _few_tasks(blocks: DataFrame) -> DataFrame:
    """Every task of a pass gives sums of its own, and holds a few blocks: a task
    takes many partitions."""
    return blocks.coalesce(4 * blocks.sparkSession.sparkContext.defaultParallelism)


def _with_margin(rows: DataFrame, width: int, recent: Sequence[Tree]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(list(recent))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, w, held, margin, bins in _blocks(batches, width):
            yield _block(y, w, held, margin + _margin(bins, shared.value), bins)

    return rows.mapInArrow(run, _BLOCKS)


def _grow(rows: DataFrame, width: int, bins: int, recent: Sequence[Tree], tree: Tree, root: np.ndarray, max_leaves: int, rate: float, limits: tuple[int, float, float]) -> None:
    """Best-first growth of ``tree`` from the root's histogram. ``known`` has all
    nodes whose histogram is known, more than the tree will get."""
    l2 = limits[2]
    known, nodes = Tree(), [_best_split(root, *limits)]
    leaves = {0: 0}  # node of ``known`` by leaf of ``tree``
    used = set()  # nodes of ``known`` that are split in ``tree``
    while tree.leaves < max_leaves:
        order = sorted((n for n, k in leaves.items() if nodes[k].gain > 0), key=lambda n: (-nodes[leaves[n]].gain, n))
        if not order:
            return
        node = order[0]
        at = leaves.pop(node)
        if known.feature[at] < 0:
            # of the nodes not yet split no more can be than splits are left
            best = sorted((k for k, x in enumerate(nodes) if k not in used and k != at and x.gain > 0), key=lambda k: (-nodes[k].gain, k))[: max_leaves - tree.leaves - 1]
            ahead = [at, *[k for k in best if known.feature[k] < 0][: PREFETCH - 1]]
            small = []
            for k in ahead:
                x = nodes[k]
                left = x.hist[2][x.feature, : x.cut + 1].sum()
                small.append(bool(2 * left <= x.hist[2][x.feature].sum()))
            got, _ = _sums(rows, width, bins, recent, known, [(k, nodes[k].feature, nodes[k].cut, s) for k, s in zip(ahead, small)], False)
            for k, hist, s in zip(ahead, got, small):
                x = nodes[k]
                known.split(k, x.feature, x.cut, x.gain, (0.0, 0.0))
                rest = x.hist - hist
                nodes += [_best_split(h, *limits) for h in ((hist, rest) if s else (rest, hist))]
        used.add(at)
        x, children = nodes[at], (known.left[at], known.right[at])
        made = tree.split(node, x.feature, x.cut, x.gain, tuple(_value(nodes[k].hist, rate, l2) for k in children))
        leaves.update(zip(made, children))
