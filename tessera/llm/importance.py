"""Quality classification by importance resampling.

Two generative models over hashed word n-grams (unigrams and bigrams in
``CELLS`` cells) are counted over whole texts: one over the labelled target
documents, one over all raw documents. A document's log weight is the sum over
its n-grams of the log ratio of their smoothed probabilities. Sampling without
replacement in proportion to the weights is Gumbel top-k: a Gumbel draw, fixed
by the document's id and the seed, is added to each log weight, and the k
highest keys are taken.

Bounds: a model is ``CELLS`` counts, summed in each task before they are
shuffled; the log ratios (one number a cell) are broadcast. The top k is a
distributed rank over (key, id) rows, never one task or the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.rand import uniform
from tessera.llm.common import arrow_schema, lean, pinned, small_or_not
from tessera.operators.ordering import global_row_number

CELLS = 1 << 16
SEED = 42
#: Distinct words of which a worker keeps the hash.
CACHE_WORDS = 150_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_hashes: dict[str, int] = {}


def cells(text: str | None) -> np.ndarray:
    """The cells of the text's unigrams and bigrams, repeats included."""
    words = _TOKEN.findall((text or "").lower())
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint32, len(words))
    two = (one[:-1] * np.uint32(0x9E3779B1)) ^ (one[1:] + np.uint32(0x7F4A7C15))
    two = (two ^ (two >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return np.concatenate([one, two ^ (two >> np.uint32(13))]) % CELLS


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(cell, n) over all whole texts; one row a cell and task is shuffled."""
    out = arrow_schema(docs.sparkSession, "cell int, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for t in b.column(0):
                total += np.bincount(cells(t.as_py()), minlength=CELLS)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(CELLS, dtype=np.int32), "n": total}, schema=out)

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def log_ratio(raw: DataFrame, target: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """Log of target over raw probability of every cell, add-``smooth``."""
    out = []
    for d in (target, raw):
        n = np.full(CELLS, smooth)
        for r in d.collect():  # CELLS rows
            n[r["cell"]] += r["n"]
        out.append(np.log(n / n.sum()))
    return out[0] - out[1]


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, n_grams."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)
    schema = "doc_id long, log_weight double, n_grams long"
    out = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cells(t.as_py()) for t in b.column(1)]
            weights = [float(shared.value[c].sum()) for c in found]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "log_weight": weights, "n_grams": [len(c) for c in found]}, schema=out)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(run), schema)


def resample(docs: DataFrame, target_ids: DataFrame, k: int | None = None, share: float = 0.5, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key, rank, selected of every row.

    ``target_ids`` has one column, the ids of target documents; ``k`` rows are
    selected (by default ``share`` of all). Null and empty texts have no
    n-gram and log weight 0. Keys that tie are ordered by id, null ids last;
    rows that repeat an id have the same draw. Without target documents every
    log weight reflects the smoothing alone; an empty table gives an empty
    result. Other columns of the tables are not read.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    src = docs.select(id_.cast("long").alias("doc_id"), text.alias("text"))
    wanted = pinned(target_ids.select(F.col(f"`{target_ids.columns[0]}`").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
    target = src.join(small_or_not(wanted, 64), "doc_id", "left_semi")
    ratio = log_ratio(counts(src), counts(target))
    u = uniform(F.col("doc_id"), "gumbel", seed)  # below 1; 0 gives minus infinity's neighbour
    weighed = log_weights(src, ratio).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log((u + 1e-10) / (1 + 2e-10))))
    weighed = pinned(weighed)
    if k is None:
        k = round(weighed.count() * share)
    ranked = global_row_number(weighed, [F.col("gumbel_key").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    return ranked.withColumn("selected", F.col("rank") <= k)
