"""Mixing sources to target weights with a multivariate-hypergeometric tree.

Documents of a source are put in the order of a seeded hash and cut into
blocks by the leading bits of that hash. A source whose target is t times its
size takes every block floor(t) times and, of one more pass, the blocks up to
the rest of its quota of words; the one block that straddles the quota is taken
up to the document whose middle reaches it. These block copies are shared out
among output shards by a splitting tree: each node gives half of its copies,
source by source, to its left child as one multivariate-hypergeometric draw,
so shards get exact block quotas that add up to the source's. Every shard then
takes its own run of the source's permuted copies, and rows are shuffled
within a shard by hash.

Bounds: the tables of sources (one row each) and of the tree's quotas are on
the driver; documents never are. Blocks are at most 2^16 a source, ranked in
window partitions of narrow rows; a block is spread evenly by its hash, so a
source with a third of all rows has a third of the blocks, not one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rand import hash32
from tessera.llm.common import pinned, small_or_not

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 42
BLOCK_ROWS = 1024
#: Words that a task of the finished mix has about.
PART_WORDS = 1 << 21


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``max_repeats`` times its size,
    the excess shared again by weight among the others until none is above.

    At the end the others hold weight * level; the level is found by going
    through the sources in the order in which they reach their limit."""
    total, caps = float(sum(sizes)), [max_repeats * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    full, open_weight = 0.0, float(sum(weights))
    for i in order:
        level = (total - full) / open_weight
        if caps[i] >= weights[i] * level:
            break
        full, open_weight = full + caps[i], open_weight - weights[i]
    else:
        level = math.inf
    return [min(float(c), w * level) for c, w in zip(caps, weights)]


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts that add up to ``counts`` exactly."""
    if shards == 1:
        return counts[None, :]
    left = rng.multivariate_hypergeometric(counts, int(counts.sum()) // 2, method="marginals") if counts.sum() else counts * 0
    return np.vstack([split_quotas(left, shards // 2, rng), split_quotas(counts - left, shards // 2, rng)])


def _decide(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], shards: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Narrow rows of the documents with their copies, the table of sources,
    that of the blocks with copies, and the leading hash bits of a block."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    spark = docs.sparkSession
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        words(F.col(f"`{text_col}`")).alias("size"),
    )
    base = pinned(base.withColumn("h", _order(F.col("doc_id"), seed)))
    sums = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sums = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    aim = targets([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))])
    bits = min(16, max(4, (sum(r["n"] for r in sums) // (BLOCK_ROWS * max(1, len(sums)))).bit_length()))
    passes = [int(t / r["size"]) if r["size"] else 0 for r, t in zip(sums, aim)]
    quota_of = spark.createDataFrame(
        [(i, r["source"], r["size"], t, p, t - p * r["size"]) for i, (r, t, p) in enumerate(zip(sums, aim, passes))],
        "sid int, source string, source_size long, target double, passes int, rest double",
    )
    quota_of = small_or_not(pinned(quota_of), 256)
    rows = _of_source(base, quota_of).withColumn("block", F.shiftright("h", 32 - bits))

    # words up to each block of a source, in hash order
    run = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("sid", "block", "passes", "rest").agg(F.sum("size").alias("w")).withColumn("upto", F.sum("w").over(run))
    blocks = blocks.withColumn("start", F.col("upto") - F.col("w"))
    blocks = pinned(blocks.withColumn("more", F.when(F.col("upto") <= F.col("rest"), "all").when(F.col("start") < F.col("rest"), "part").otherwise("none")))

    # copies of blocks: every pass, and the part of one more
    copies = blocks.select("sid", "block", "passes", "more").withColumn("k", F.col("passes") + (F.col("more") != "none").cast("int")).where("k > 0")
    copies = pinned(copies.select("sid", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("pass")))
    counts = np.zeros(len(sums), np.int64)
    for r in copies.groupBy("sid").count().collect():
        counts[r["sid"]] = r["count"]
    ends = split_quotas(counts, shards, np.random.default_rng(seed)).cumsum(axis=0)
    quotas = spark.createDataFrame([(i, [int(x) for x in ends[:, i]]) for i in range(len(sums))], T.StructType.fromDDL("sid int, ends array<long>"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(hash32(F.col("sid"), F.col("block"), F.col("pass"), "permute", seed), "block", "pass"))
    dealt = copies.withColumn("place", place).join(small_or_not(pinned(quotas), 96 + 8 * shards), "sid")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    dealt = dealt.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("got"))
    plan = pinned(blocks.select("sid", "block", "start", "more").join(dealt, ["sid", "block"]).select("sid", "block", "start", "more", F.col("got.shard").alias("shards")))
    plan = small_or_not(plan, 176)

    own = rows.join(plan, ["sid", "block"], "left")
    out = ["doc_id", "source", "size", "source_size", "target", "more", "shards"]
    none = F.array().cast("array<int>")
    sure = own.where("more is null or more != 'part'").withColumn("shards", F.coalesce("shards", none)).select(*out)
    upto = F.col("start") + F.sum("size").over(Window.partitionBy("sid", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = own.where("more = 'part'").withColumn("last", upto - F.col("size") / 2.0 <= F.col("rest"))
    edge = edge.withColumn("shards", F.when(F.col("last"), F.col("shards")).otherwise(F.slice("shards", F.lit(1), F.size("shards") - 1))).select(*out)
    return sure.unionByName(edge), quota_of, plan, bits


def _order(doc_id: Column, seed: int) -> Column:
    """32-bit hash in whose order a source's documents are taken."""
    return hash32(doc_id, "mix", seed)


def _of_source(rows: DataFrame, quota_of: DataFrame) -> DataFrame:
    """Rows with the columns of their source's quota; null is a source."""
    return rows.join(quota_of.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, shards (array<int>, an entry for each copy taken).

    Sources in code point order, null last, weigh ``weights`` in turn; a null
    source is a source. Null and blank texts have size 0 and no effect on
    quotas. Documents are ordered by a hash of their id, so ties (repeated
    ids) are ordered by id and size; rows that tie in these as well are alike.
    A result depends on ids, sizes, sources and ``seed`` alone, so reruns
    agree. An empty table gives an empty result; other columns are not read.
    """
    return _decide(docs, id_col, text_col, source_col, weights, shards, seed)[0].drop("more")


def taken_words(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row."""
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.size("shards")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The mix itself: every copy taken, as a row of ``docs`` with all its
    columns, each shard together and shuffled in itself. Rows that repeat an
    id, source and size get the same number of copies."""
    decided, quota_of, plan, bits = _decide(docs, id_col, text_col, source_col, weights, shards, seed)
    # whole blocks are decided by (source, block); only the documents of the
    # one straddling block of a source are looked up by themselves
    part = decided.where("more = 'part'").groupBy("doc_id", "source", "size").agg(F.max_by("shards", F.size("shards")).alias("shards"))
    part = pinned(part.select(F.col("doc_id").alias("__pi"), F.col("source").alias("__ps"), F.col("size").alias("__pn"), F.col("shards").alias("__own")))
    words_taken = decided.agg(F.sum(F.col("size") * F.size("shards"))).first()[0] or 0
    own = {"__i": F.col(f"`{id_col}`").cast("long"), "__src": F.col(f"`{source_col}`").cast("string")}
    rows = docs.withColumns(own).withColumn("__block", F.shiftright(_order(F.col("__i"), seed), 32 - bits))
    q = quota_of.select(F.col("sid").alias("__sid"), F.col("source").alias("__qs"))
    b = plan.select(F.col("sid").alias("__bs"), F.col("block").alias("__bb"), F.col("more").alias("__more"), F.col("shards").alias("__shards"))
    rows = rows.join(q, F.col("__src").eqNullSafe(F.col("__qs"))).join(b, (F.col("__sid") == F.col("__bs")) & (F.col("__block") == F.col("__bb")))
    size = F.when(F.col("__more") == "part", words(F.col(f"`{text_col}`")))
    cond = (F.col("__more") == "part") & F.col("__i").eqNullSafe(F.col("__pi")) & F.col("__src").eqNullSafe(F.col("__ps")) & (size == F.col("__pn"))
    rows = rows.join(small_or_not(part, 320), cond, "left")
    rows = rows.withColumn("__shards", F.when(F.col("__more") == "part", F.col("__own")).otherwise(F.col("__shards")))
    rows = rows.select(*[docs[c] for c in docs.columns], "__i", F.posexplode("__shards").alias("__copy", "__shard"))
    # a shard is as many parts as its words need; the hash order shuffles each
    parts = words_taken // (shards * PART_WORDS) + 1
    rows = rows.withColumn("__h", hash32(F.col("__i"), F.col("__copy"), "local", seed))
    rows = rows.repartition(shards * parts, "__shard", F.pmod("__h", F.lit(4 * parts))).sortWithinPartitions("__shard", "__h")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
