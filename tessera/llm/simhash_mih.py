"""SimHash near-deduplication with multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Equal fingerprints collapse to one row before any search. The 64
bits are cut into segments; by the pigeonhole principle two fingerprints
within ``max_bits`` differ in at most ``max_bits // segments`` bits in some
segment. So a table per segment is looked up with every value in the small
Hamming ball around each fingerprint's own segment value, and matches are
verified on all 64 bits. Links become components by repeated contraction.

Bounds: a ball has 1 + 32 values at the default two segments. A bucket with
more than ``dense`` distinct fingerprints is indexed again by the halves of
the remaining 32 bits, so a cluster that shares one segment is not paired off
in full; the result is the same. Fingerprints are never collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, pinned, settle_rows

SEED = 42
DENSE_BUCKET = 256
EDGES_PER_TASK = 200_000


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """The 64-bit fingerprint as a signed number; no word gives zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest, k = xxhash.xxh64_intdigest, words_per_shingle
    if len(words) < k:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "fp": [fingerprint(t.as_py(), shingle) for t in b.column(1)]}

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(src, run, "doc_id long, fp long")


def _segment(fp: Column, seg: int) -> Column:
    """Half ``seg`` (0 low, 1 high) of 64 bits as a number of 32 bits."""
    return (F.shiftrightunsigned(fp, 32) if seg else fp.bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")


def _ball(value: Column, width: int, radius: int) -> Column:
    """All numbers of ``width`` bits within ``radius`` (0 to 2) of ``value``."""
    masks = [0]
    if radius >= 1:
        masks += [1 << i for i in range(width)]
    if radius >= 2:
        masks += [1 << i | 1 << j for i in range(width) for j in range(i)]
    if radius >= 3:
        raise ValueError("max_bits up to 5 is supported with two segments")
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, max_bits: int = 3, dense: int = DENSE_BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within ``max_bits``.

    ``fps`` is a pinned table of distinct fingerprints in column fp."""
    radius = max_bits // 2
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits

    def table(*keep: str) -> DataFrame:
        # key: the segment's number above its 32 bits
        seg = [F.struct((_segment(F.col("fp"), s) + (s << 32)).alias("key"), _segment(F.col("fp"), 1 - s).alias("rest")) for s in (0, 1)]
        return fps.select("fp", F.explode(F.array(*seg)).alias("e")).select("fp", "e.key", *keep)

    def lookups(*keep: str) -> DataFrame:
        seg = [F.struct(_ball(_segment(F.col("fp"), s) + (s << 32), 32, radius).alias("keys"), _segment(F.col("fp"), 1 - s).alias("rest")) for s in (0, 1)]
        return fps.select("fp", F.explode(F.array(*seg)).alias("e")).select("fp", F.explode("e.keys").alias("key"), *keep)

    def matches(t: DataFrame, p: DataFrame, keys: list[str]) -> DataFrame:
        both = t.withColumnRenamed("fp", "a").join(p.withColumnRenamed("fp", "b"), keys)
        return both.where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    crowded = pinned(table().groupBy("key").count().where(F.col("count") > dense).select("key"))
    if not crowded.limit(1).count():
        return matches(table(), lookups(), ["key"]).distinct()
    plain = matches(table().join(crowded, "key", "left_anti"), lookups(), ["key"])
    # crowded keys: the other 32 bits in two halves of 16, again with a ball
    half = lambda s: (F.shiftright("rest", 16) if s else F.col("rest").bitwiseAND(F.lit(0xFFFF))).cast("long")
    parts = F.explode(F.array(*[half(s) + (s << 16) for s in (0, 1)])).alias("part")
    balls = F.explode(F.concat(*[_ball(half(s) + (s << 16), 16, radius) for s in (0, 1)])).alias("part")
    fine = table("e.rest").join(crowded, "key", "left_semi").select("fp", "key", parts)
    fine_lookups = lookups("e.rest").join(crowded, "key", "left_semi").select("fp", "key", balls)
    return plain.unionByName(matches(fine, fine_lookups, ["key", "part"])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b); root is one node of its
    component. Each round every node steps to its first neighbour in a random
    order of that round, or stays where it is first itself, and the edges are
    contracted; steps are then resolved from the last round back. Random orders
    shrink the edges by a constant factor a round, long chains included."""
    steps: list[DataFrame] = []
    edges = pinned(edges.select("a", "b"))
    while n := edges.count():
        # no more tasks than the edges that are left need
        tasks = n // EDGES_PER_TASK + 1
        place = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("node"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("to"))
        step = pinned(first.select(F.col("a").alias("node"), F.least(place("a"), F.col("to"))["node"].alias("root")).coalesce(tasks))
        steps.append(step)
        x, y = (step.select(F.col("node").alias(c), F.col("root").alias(to)) for c, to in (("a", "x"), ("b", "y")))
        moved = edges.join(x, "a").join(y, "b").where("x != y")
        edges = pinned(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(tasks))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps.pop()
    while steps:
        step, later = steps.pop(), out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        out = pinned(out.coalesce(step.rdd.getNumPartitions()))
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, dense: int = DENSE_BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Words are the runs of `[^\\x20\\x09-\\x0D]` of the text with A-Z in lower
    case. Texts of fewer words than a shingle give one shingle of all their
    words; null, empty and blank texts have fingerprint zero and link like any
    other. component_id is the smallest doc_id that is reachable over links of
    at most ``max_bits`` bits (null ids count only if there is no other).
    Rows that repeat an id are reported alike; an empty table gives an empty
    result; other columns are not read.
    """
    keyed = pinned(fingerprints(docs, id_col, text_col, shingle))
    out = _label(keyed, max_bits, dense)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _label(keyed: DataFrame, max_bits: int, dense: int) -> DataFrame:
    nodes = pinned(keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = components(links(nodes.select("fp"), max_bits, dense))
    rooted = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = pinned(rooted)
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return keyed.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each component stays: the one with its smallest id.

    Rows that repeat an id are one document, of which one row stays; rows
    without an id cannot be named by a component and stay."""
    c = near_components(docs, id_col, text_col, shingle, max_bits).where("doc_id is not null")
    marks = c.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("once"), F.count(F.lit(1)).alias("n"))
    marks = marks.where("not once or n > 1").select("doc_id", "once")
    return settle_rows(docs, marks, {"doc_id": F.col(f"`{id_col}`").cast("long")}, 96)
