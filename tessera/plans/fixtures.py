"""Fixture views: the driver's TPC-H-ish tables reshaped into the wide
recommendation layout the operators expect (ids/labels, behaviour
sequences, multi-hot baskets, scored predictions, scalar features, metric
histories). Each view exists twice — as a lazy Spark DataFrame and as
DuckDB SQL text — and both give identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rand import SqlExpr, hash32, hash32_sql
from tessera.sources.tables import read_table


def _epoch(c):
    # TIMESTAMP_NTZ -> Unix seconds; independent of the session time zone.
    return F.unix_timestamp(F.col(c))


def v_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: sample_id, user_id, item_id, label_type (2 = positive),
    label_time and an observation time ts_now."""
    o = read_table(spark, sf, "orders")
    first_item = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("item_id"))
    return o.join(first_item, o.o_orderkey == first_item.l_orderkey).select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("user_id"),
        "item_id",
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("label_type"),
        _epoch("o_orderdate").alias("label_time"),
        (_epoch("o_orderdate") - F.pmod(F.col("o_orderkey"), F.lit(900))).alias("ts_now"),
    )


EVENT_TYPE_CODE = {"view": 1, "click": 2, "signup": 3, "purchase": 4}  # others -> -1 (missing)


def v_user_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: ts_now and three parallel sequences (ts, type, value) in time
    order. Adapter for tests: real inputs already store sequences as arrays."""
    e = read_table(spark, sf, "events")
    ty = F.lit(-1)
    for k, v in reversed(list(EVENT_TYPE_CODE.items())):
        ty = F.when(F.col("event_type") == k, F.lit(v)).otherwise(ty)
    e = e.select(
        "user_id", "event_id", _epoch("ts").alias("t"), ty.alias("ty"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    g = e.groupBy("user_id").agg(
        F.max("t").alias("ts_now"),
        F.array_sort(F.collect_list(F.struct("t", "event_id", "ty", "v"))).alias("s"),
    )
    return g.select(
        "user_id", "ts_now",
        F.transform("s", lambda x: x["t"]).alias("seq_ts"),
        F.transform("s", lambda x: x["ty"].cast("bigint")).alias("seq_type"),
        F.transform("s", lambda x: x["v"]).alias("seq_val"),
    )


def v_basket(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: multi-hot item ids and a parallel dense quantity array."""
    return _basket(spark, sf).drop("item_id")


def _basket(spark: SparkSession, sf: str) -> DataFrame:
    """``v_basket`` and the lowest item of the order. The item is an aggregate
    of its own, so that the arrays are left out where nothing reads them."""
    li = read_table(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("s"),
        F.min("l_partkey").alias("item_id"),
    )
    return g.select(
        "l_orderkey",
        F.transform("s", lambda x: x["l_partkey"]).alias("items"),
        F.transform("s", lambda x: x["l_quantity"]).alias("qty"),
        "item_id",
    )


def v_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored predictions: id, label, score, prob (the score to 3 decimals, so
    ties exist) and a split by hash of the id, so every split has both classes."""
    e = read_table(spark, sf, "events")
    score = F.col("value") / (F.col("value") + F.lit(50.0))
    h = F.pmod(hash32(F.col("event_id"), "scored", 42), F.lit(10))
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        F.round(score, 3).alias("prob"),
        F.when(h < 7, "train").when(h < 8, "val").otherwise("test").alias("split"),
        score.alias("score"),
    )


_ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # and the price in cents


def row_hash():
    """60-bit id from the md5 of a lineitem row's keys and price (order and
    line number repeat in the driver's tables); the same in DuckDB. A test
    checks that no id repeats."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in _ROW_KEY], F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def v_features(spark: SparkSession, sf: str, with_id: bool = True) -> DataFrame:
    """Scalar features per lineitem row, with a hash id of the row's keys: a
    map, no sort. ``with_id=False`` leaves the id out."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        *([row_hash().alias("id")] if with_id else []),
        F.col("l_quantity").alias("f1"),
        F.col("l_extendedprice").alias("f2"),
        F.when(F.col("l_discount") != 0.0, F.col("l_discount")).alias("f3"),
        F.col("l_tax").alias("f4"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("label_type"),
    )


def v_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Metric history: one validation AUC-like value per (run, step)."""
    o = read_table(spark, sf, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("run_id"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("step"),
    ).agg(F.round(F.avg("o_totalprice") / 1000000, 6).alias("val_auc"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


# ---------------------------------------------------------------- DuckDB twins

SQL = {
    "v_interactions": """
select o.o_orderkey sample_id, o.o_custkey user_id, l.item_id,
       case when o.o_orderstatus='F' then 2 else 1 end label_type,
       cast(floor(epoch(o.o_orderdate)) as bigint) label_time,
       cast(floor(epoch(o.o_orderdate)) as bigint) - (o.o_orderkey % 900) ts_now
from orders o join (select l_orderkey, min(l_partkey) item_id from lineitem group by 1) l
  on o.o_orderkey = l.l_orderkey""",
    "v_user_seq": """
select user_id, max(t) ts_now,
       list(t order by t, event_id, ty, v) seq_ts,
       list(cast(ty as bigint) order by t, event_id, ty, v) seq_type,
       list(v order by t, event_id, ty, v) seq_val
from (select user_id, event_id, cast(floor(epoch(ts)) as bigint) t,
             case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3
                             when 'purchase' then 4 else -1 end ty,
             cast(round(value*100) as bigint) v
      from events) e
group by user_id""",
    "v_basket": """
select l_orderkey,
       list(l_partkey order by l_linenumber, l_partkey, l_quantity) items,
       list(l_quantity order by l_linenumber, l_partkey, l_quantity) qty
from lineitem group by 1""",
    "v_scored": f"""
select event_id id, case when event_type='purchase' then 1 else 0 end label, round(score,3) prob,
       case when h < 7 then 'train' when h < 8 then 'val' else 'test' end split, score
from (select *, value/(value+50.0) score, {hash32_sql(SqlExpr('event_id'), 'scored', '42')} % 10 h from events)""",
    "v_features": """
select cast('0x' || substr(md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))), 1, 15) as bigint) id,
       l_quantity f1, l_extendedprice f2, nullif(l_discount,0.0) f3, l_tax f4,
       case when l_returnflag='R' then 2 else 1 end label_type
from lineitem""",
    "v_runs": """
select o_orderpriority run_id, cast(year(o_orderdate)*12+month(o_orderdate) as int) step,
       round(avg(o_totalprice)/1000000,6) val_auc
from orders group by 1,2""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix DuckDB SQL with CTEs for the named fixture views."""
    ctes = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    return f"with {ctes}\n{body}" if names else body


VIEWS = {
    "v_interactions": v_interactions,
    "v_user_seq": v_user_seq,
    "v_basket": v_basket,
    "v_scored": v_scored,
    "v_features": v_features,
    "v_runs": v_runs,
}


# ---------------------------------------------------------------- wide sample table

def v_wide(spark: SparkSession, sf: str, with_seq: bool = True) -> DataFrame:
    """The reference's wide layout rebuilt from driver tables: id/label block,
    scalar and multi-hot int features, a dense vector and two behaviour
    sequence domains, named by family prefix + feature id. ``with_seq=False``
    leaves out the sequences and their join."""
    # One lineitem aggregation feeds both the basket arrays and item_id, so
    # lineitem is scanned and shuffled once; the inner join keeps exactly
    # v_interactions' rows.
    vb = _basket(spark, sf)
    o = read_table(spark, sf, "orders")
    vi = o.join(vb, o.o_orderkey == vb.l_orderkey).select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("user_id"),
        "item_id",
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("label_type"),
        _epoch("o_orderdate").alias("label_time"),
        (_epoch("o_orderdate") - F.pmod(F.col("o_orderkey"), F.lit(900))).alias("ts_now"),
        "items", "qty",
    )
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    part = read_table(spark, sf, "part").select("p_partkey", "p_size")
    # the two user-keyed joins run back to back so, at scale, they share one
    # exchange on user_id; the sequences come last, no exchange moves them
    # once they are repeated for every order of their user
    d = vi.join(part, vi.item_id == part.p_partkey, "left")
    d = d.join(cust, vi.user_id == cust.c_custkey, "left")
    if with_seq:
        d = d.join(v_user_seq(spark, sf).withColumnRenamed("ts_now", "seq_now"), "user_id", "left")
    return d.select(
        "sample_id", "user_id", "item_id", "label_type", "label_time",
        F.col("ts_now").alias("timestamp"),
        F.col("c_nationkey").cast("bigint").alias("user_int_feats_1"),
        (F.pmod(F.col("user_id"), F.lit(7)) - 1).alias("user_int_feats_3"),
        F.col("items").alias("user_int_feats_15"),
        F.col("qty").cast("array<float>").alias("user_dense_feats_61"),
        F.col("p_size").cast("bigint").alias("item_int_feats_5"),
        F.transform("items", lambda x: F.pmod(x, F.lit(50))).alias("item_int_feats_11"),
        *[F.col(c).alias(a) for c, a in (
            ("seq_type", "domain_a_seq_38"), ("seq_ts", "domain_a_seq_39"), ("seq_val", "domain_a_seq_40"),
            ("seq_type", "domain_b_seq_70"), ("seq_val", "domain_b_seq_71"),
        ) if with_seq],
    )


SQL["v_wide"] = f"""
select vi.sample_id, vi.user_id, vi.item_id, vi.label_type, vi.label_time, vi.ts_now "timestamp",
       cast(c.c_nationkey as bigint) user_int_feats_1,
       ((vi.user_id % 7) - 1) user_int_feats_3,
       vb.items user_int_feats_15,
       cast(vb.qty as float[]) user_dense_feats_61,
       cast(p.p_size as bigint) item_int_feats_5,
       list_transform(vb.items, lambda x: x % 50) item_int_feats_11,
       us.seq_type domain_a_seq_38, us.seq_ts domain_a_seq_39, us.seq_val domain_a_seq_40,
       us.seq_type domain_b_seq_70, us.seq_val domain_b_seq_71
from ({SQL['v_interactions']}) vi
left join ({SQL['v_basket']}) vb on vi.sample_id = vb.l_orderkey
left join customer c on vi.user_id = c.c_custkey
left join part p on vi.item_id = p.p_partkey
left join ({SQL['v_user_seq']}) us on vi.user_id = us.user_id"""

VIEWS["v_wide"] = v_wide
