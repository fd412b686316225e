"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of their character n-grams by
presence: for n = 1 to 4 the number of hashed n-grams that both have over the
geometric mean of their numbers, averaged over n. A bounded sample of labelled
documents, taken by hash from every language, gives Nystroem landmarks; kernel
ridge regression, one language against the rest, is solved in the landmark
space. As every landmark is itself a presence vector, the kernel sums over
landmarks fold into one weight per (n-gram cell, language), and a batch of
texts is scored by one product of its presence matrix with these weights.

Bounds: ``sample_per_lang`` and ``landmarks_per_lang`` rows a language, at a
fixed 32 KB of packed presence bits each, reach the driver for the fit; the
weights (2^18 cells by languages, 4 bytes each) are broadcast. The languages
are the distinct labels, a small closed set. Scoring is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, give_back, lean, map_arrow

UNKNOWN = "und"
ORDERS = 4
CELL_BITS = 16
CELLS = 1 << CELL_BITS
SPACE = 32

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point below 2^16 to its lower-case letter, or to a space."""
    global _letters
    if _letters is None:
        table = np.full(1 << 16, SPACE, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters = table
    return _letters


def letters(text: str) -> np.ndarray:
    """Lower-case letters of the text, every other run as one space, a space
    at both ends; letters beyond the basic plane stay as they are."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = a < (1 << 16)
    a = np.where(low, _letter_table()[np.where(low, a, 0)], a) if not low.all() else _letter_table()[a]
    if not low.all():
        other = np.unique(a[a >= (1 << 16)])
        drop = np.array([c for c in other if not chr(c).isalpha()], np.uint32)
        a = np.where(np.isin(a, drop), SPACE, a)
    a = np.concatenate([[SPACE], a, [SPACE]]).astype(np.uint32)
    space = a == SPACE
    return a[~(space & np.r_[False, space[:-1]])]


def presence(text: str, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams that occur, and how many for each n. ``scratch`` is
    a zeroed array of ORDERS * CELLS flags, zeroed again on return."""
    a = letters(text)
    if len(a) < 2:
        return np.zeros(0, np.int64), np.zeros(ORDERS, np.int64)
    mixed = a * np.uint32(2654435761)
    gram = mixed
    for n in range(ORDERS):
        if n:
            gram = gram[:-1] * np.uint32(0x01000193) + mixed[n:] if len(gram) > 1 else gram[:0]
        scratch[((gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - CELL_BITS)).astype(np.int64) + n * CELLS] = True
    cells = np.flatnonzero(scratch)
    scratch[cells] = False
    return cells, np.bincount(cells >> CELL_BITS, minlength=ORDERS)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # (ORDERS * CELLS, languages), float32

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One row of scores a text, NaN where it has no letter."""
        scratch = np.zeros(ORDERS * CELLS, bool)
        out = np.full((len(texts), len(self.langs)), np.nan)
        for i, t in enumerate(texts):
            cells, sizes = presence(t or "", scratch)
            if len(cells):
                # one row of the presence matrix times the weights, order by order
                ends = np.cumsum(sizes)
                row = np.zeros(len(self.langs))
                for n, (at, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                    if end > at:
                        row += self.weights[cells[at:end]].sum(axis=0, dtype=np.float64) / np.sqrt(end - at)
                out[i] = row
        return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Presence kernel of two matrices of packed presence bits, in blocks."""
    out = np.zeros((len(rows), len(landmarks)))
    width = CELLS // 8
    for n in range(ORDERS):
        part = slice(n * width, (n + 1) * width)
        b = np.unpackbits(landmarks[:, part], axis=1).astype(np.float32)
        nb = np.sqrt(np.maximum(b.sum(axis=1), 1))
        for at in range(0, len(rows), 64):
            a = np.unpackbits(rows[at : at + 64, part], axis=1).astype(np.float32)
            na = np.sqrt(np.maximum(a.sum(axis=1), 1))
            out[at : at + 64] += (a @ b.T) / np.outer(na, nb) / ORDERS
    return out


def fit(rows: list[tuple[str, bytes]], landmarks_per_lang: int, ridge: float) -> Model:
    """``rows``: (language, packed presence bits), in a fixed order."""
    langs = tuple(sorted({r[0] for r in rows}))
    if not langs:
        return Model((), np.zeros((ORDERS * CELLS, 0), np.float32))
    bits = np.array([np.frombuffer(b, np.uint8) for _, b in rows])
    seen: dict[str, int] = {}
    chosen = []
    for i, (lang, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks_per_lang:
            chosen.append(i)
    marks = bits[chosen]
    k_mm, k_nm = kernel(marks, marks), kernel(bits, marks)
    value, vector = np.linalg.eigh(k_mm)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # K^(-1/2) on its range
    phi = k_nm @ root
    y = np.array([[float(r[0] == c) for c in langs] for r in rows])
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    alpha = root @ w  # landmark by language
    weights = np.zeros((ORDERS * CELLS, len(langs)), np.float32)
    width = CELLS // 8
    for n in range(ORDERS):
        b = np.unpackbits(marks[:, n * width : (n + 1) * width], axis=1).astype(np.float32)
        scaled = (alpha / (ORDERS * np.sqrt(np.maximum(b.sum(axis=1), 1)))[:, None]).astype(np.float32)
        weights[n * CELLS : (n + 1) * CELLS] = b.T @ scaled
    return Model(langs, weights)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, folds: int) -> list[tuple[str, bytes]]:
    """Up to ``per_lang`` labelled documents a language with at least a letter,
    by hash of the id, outside the held-out fold: a fixed choice in a fixed order."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    src = src.where("id is not null and lang is not null").where(~held_out(F.col("id"), folds)).where(F.col("text").rlike(r"\p{L}"))
    src = src.withColumn("h", F.xxhash64(F.lit("landmark"), F.col("id").cast("string")))
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    if not counts:
        return []
    # twice the wanted share by hash, so that ranking sees few rows
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * per_lang / n + 20 / n)))])
    few = src.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(1 << 30))

    def pack(b: pa.RecordBatch) -> dict:
        scratch = np.zeros(ORDERS * CELLS, bool)
        out = []
        for t in b.column(1).to_pylist():
            flags = np.zeros(ORDERS * CELLS, np.uint8)
            flags[presence(t, scratch)[0]] = 1
            out.append(np.packbits(flags).tobytes())
        return {"lang": b.column(0), "bits": out, "h": b.column(2), "id": b.column(3)}

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
    few = few.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "text", "h", F.col("id").cast("string").alias("id"))
    rows = map_arrow(few, pack, "lang string, bits binary, h long, id string").collect()
    return [(r["lang"], bytes(r["bits"])) for r in sorted(rows, key=lambda r: (r["h"], r["id"], r["bits"]))]


def held_out(id_col, folds: int = 5):
    """crc32 of the id as text, by remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 256, landmarks_per_lang: int = 32, ridge: float = 1e-2, folds: int = 5) -> Model:
    model = fit(sample(docs, id_col, text_col, lang_col, sample_per_lang, folds), landmarks_per_lang, ridge)
    give_back()
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    lang_pred is the learned language with the highest score (ties: the first
    by code point), the score is that of the regression, cut to [0, 1]. Null
    texts and texts without a letter, and every text if nothing was learned,
    give `und` and 0. Prediction reads the text alone. Repeated rows are
    reported alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(F.col(f"`{id_col}`"), folds).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    out = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (part.slice(at, 512) for part in batches for at in range(0, part.num_rows, 512)):
            langs, scores = judge(m, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], schema=out)

    return src.mapInArrow(lean(run), schema)


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    if not texts or not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    s = model.scores(texts)
    known = ~np.isnan(s[:, 0])
    best = np.argmax(np.where(known[:, None], s, 0), axis=1)
    score = np.where(known, np.clip(s[np.arange(len(s)), best], 0, 1), 0.0)
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)], score


def keep_known(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language and at least ``min_score``, with
    all their columns: one map, the flag computed beside the text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(text), 512):
            langs, scores = judge(shared.value, text.slice(at, 512).to_pylist())
            out += [p != UNKNOWN and s >= min_score for p, s in zip(langs, scores)]
        give_back()
        return pa.array(out, pa.bool_())

    return docs.where(known(F.col(f"`{text_col}`")))
