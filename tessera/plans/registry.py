"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver tables (through the fixture views) so its
"""

from __future__ import annotations

import json
import math
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.rand import SqlExpr, hash32_sql
from tessera.operators import split as R
from tessera.plans import fixtures as V
from tessera.plans.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------- split (R)

def _rank_sql(src: str, id_col: str, cls: str, salt: str, seed: int = 42) -> str:
    h = hash32_sql(SqlExpr(id_col), salt, str(seed))
    return f"""select *, row_number() over (partition by {cls} order by {h}, {id_col}) - 1 rk,
                   count(*) over (partition by {cls}) n from {src}"""


SPLIT_SQL_CORE = f"""
s as (select *, cast(floor(n*0.2+0.5) as bigint) nt from ({_rank_sql('v_interactions', 'sample_id', 'label_type', 'split')})),
s2 as (select *, cast(floor((n-nt)*{0.1 / 0.8!r}+0.5) as bigint) nv from s),
sp as (select sample_id, user_id, item_id, label_type,
              case when rk < nt then 'test' when rk < nt + nv then 'val' else 'train' end split from s2)"""


def _split(spark, sf):
    return R.stratified_split(V.v_interactions(spark, sf), "sample_id", "label_type", 0.2, 0.1, 42)


register(
    "R1_stratified_split",
    with_views(f", {SPLIT_SQL_CORE.strip()}\nselect * from sp", "v_interactions"),
)(lambda spark, sf: _split(spark, sf).select("sample_id", "user_id", "item_id", "label_type", "split"))


R2_SQL = """
select split, label_type, n, cast(split_rows as bigint) split_rows,
       round(split_rows * 100.0 / sum(n) over (), 6) split_pct,
       round(n * 1.0 / split_rows, 6) label_share
from (select split, label_type, count(*) n, sum(count(*)) over (partition by split) split_rows
      from sp group by 1, 2) g"""


@register("R2_split_report", with_views(f", {SPLIT_SQL_CORE.strip()}\n{R2_SQL}", "v_interactions"))
def q_split_report(spark, sf):
    return R.split_report(_split(spark, sf), "label_type")


# ---------------------------------------------------------------- catalog / inference (C)

from tessera.operators import catalog as C  # noqa: E402
from tessera.operators import encode as EN  # noqa: E402
from tessera.plans import duck as D  # noqa: E402

# Column list of the wide fixture (fixed by its definition).
WIDE_INT = [  # (column, kind, fid, is_array, domain, ordinal)
    ("user_int_feats_1", "user_int", 1, False, None, 6),
    ("user_int_feats_3", "user_int", 3, False, None, 7),
    ("user_int_feats_15", "user_int", 15, True, None, 8),
    ("user_dense_feats_61", "user_dense", 61, True, None, 9),
    ("item_int_feats_5", "item_int", 5, False, None, 10),
    ("item_int_feats_11", "item_int", 11, True, None, 11),
    ("domain_a_seq_38", "seq", 38, True, "seq_a", 12),
    ("domain_a_seq_39", "seq", 39, True, "seq_a", 13),
    ("domain_a_seq_40", "seq", 40, True, "seq_a", 14),
    ("domain_b_seq_70", "seq", 70, True, "seq_b", 15),
    ("domain_b_seq_71", "seq", 71, True, "seq_b", 16),
]


def _infer_sql_rows() -> list[str]:
    parts = []
    for col, kind, fid, is_arr, dom, ordn in WIDE_INT:
        if kind == "user_dense":
            vocab = "cast(0 as bigint)"
            dim = f"coalesce(arg_min(len({col}), case when {col} is not null then sample_id end), 1)"
        else:
            pm = (f"max(list_max(list_filter({col}, lambda v: v > 0)))" if is_arr
                  else f"max(case when {col} > 0 then {col} end)")
            vocab = f"coalesce({pm} + 1, 1)"
            dim = f"coalesce(max(len({col})), 1)" if (is_arr and kind != "seq") else "1"
        d = f"'{dom}'" if dom else "cast(null as varchar)"
        parts.append(
            f"select '{col}' as \"column\", '{kind}' kind, {d} domain, {fid} fid, {ordn} ordinal, "
            f"cast({vocab} as bigint) vocab, cast({dim} as bigint) dim from v_wide"
        )
    return parts


INFER_SQL = "inferred as (" + "\nunion all\n".join(_infer_sql_rows()) + ")"


def _inferred(spark, sf):
    return C.infer_schema(V.v_wide(spark, sf), "sample_id")


@register("C1_catalog")
def q_catalog(spark, sf):
    return C.catalog_df(spark, V.v_wide(spark, sf))


register("C2_C4_infer_schema", with_views(f", {INFER_SQL}\nselect * from inferred", "v_wide"))(_inferred)

register(
    "C5_infer_ts_fid",
    with_views(
        f""", {INFER_SQL}
select domain, case when vocab > {C.TS_VOCAB_MIN} then fid end ts_fid
from (select *, row_number() over (partition by domain order by vocab desc, ordinal) r
      from inferred where kind = 'seq') where r = 1""",
        "v_wide",
    ),
)(lambda spark, sf: C.infer_ts_fid(_inferred(spark, sf)))

register(
    "C6_cardinality_flags",
    with_views(
        f""", {INFER_SQL}
select coalesce(domain, kind) family, count(*) n_features,
       count(*) filter (where vocab <= 0) n_skip, count(*) filter (where vocab > 10000) n_id_like
from inferred where kind <> 'user_dense' group by 1""",
        "v_wide",
    ),
)(lambda spark, sf: C.cardinality_flags(_inferred(spark, sf), 0, 10000))


# ---------------------------------------------------------------- encode batch

# A frozen schema.json-style config for the wide fixture (vocab, dims, ts fid):
# deliberately small vocabularies so out-of-vocabulary clipping is exercised.
ENCODE_SCHEMA = {
    # 15: no limit here; _encode_schema takes its vocabulary from the data
    "user_int": [[1, 25, 1], [3, 6, 1], [15, 1 << 62, 8]],
    "item_int": [[5, 40, 1], [11, 50, 4]],
    "user_dense": [[61, 8]],
    "seq": {
        "seq_a": {"prefix": "domain_a_seq", "ts_fid": 39, "features": [[38, 5], [39, 0], [40, 3000]]},
        "seq_b": {"prefix": "domain_b_seq", "ts_fid": None, "features": [[70, 4], [71, 0]]},
    },
}
ENCODE_MAX_LENS = {"seq_a": 64, "seq_b": 50}
WIDE_ARRAYS = {c for c, _, _, a, _, _ in WIDE_INT if a}


def _int_block_sql(prefix: str, entries) -> str:
    parts = []
    for fid, vocab, dim in sorted(entries):
        col = f"{prefix}{fid}"
        parts.append(D.pad_ids(col, dim, vocab) if col in WIDE_ARRAYS else f"[{D.clean_scalar(col, vocab)}]")
    return D.concat(parts)


def _encode_sql(schema=ENCODE_SCHEMA, max_lens=ENCODE_MAX_LENS) -> str:
    cols = [
        "sample_id",
        "cast(coalesce(label_type, 0) = 2 as bigint) label",
        '"timestamp"',
        _int_block_sql("user_int_feats_", schema["user_int"]) + " user_int_feats",
        _int_block_sql("item_int_feats_", schema["item_int"]) + " item_int_feats",
        D.concat([D.pad_dense(f"user_dense_feats_{fid}", dim) for fid, dim in sorted(schema["user_dense"])], "float")
        + " user_dense_feats",
    ]
    for dom in sorted(schema["seq"]):
        cfg, L = schema["seq"][dom], max_lens[dom]
        sides = EN.side_fids(cfg)
        pre = cfg["prefix"] + "_"
        cols.append("[" + ", ".join(D.pad_ids(f"{pre}{fid}", L, vs) for fid, vs in sides) + f"] {dom}")
        lens = [f"least({D.length(pre + str(fid))}, {L})" for fid, _ in sides]
        cols.append((f"greatest({', '.join(lens)})" if len(lens) > 1 else lens[0]) + f" {dom}_len")
        if cfg.get("ts_fid") is None:
            cols.append(f"list_resize(cast([] as bigint[]), {L}, cast(0 as bigint)) {dom}_time_bucket")
        else:
            cols.append(D.time_bucket_array('"timestamp"', D.pad_raw(f"{pre}{cfg['ts_fid']}", L)) + f" {dom}_time_bucket")
    return "select " + ",\n  ".join(cols) + " from v_wide"


def _encode_schema(spark, sf):
    """ENCODE_SCHEMA with the basket's vocabulary as inferred from the table
    (C2), so that every basket id is encoded; the other columns stay short."""
    found = C.infer_schema(V.v_wide(spark, sf, with_seq=False).select("sample_id", "user_int_feats_15"), "sample_id").first()
    return ENCODE_SCHEMA | {"user_int": [[f, found["vocab"] if f == 15 else v, d] for f, v, d in ENCODE_SCHEMA["user_int"]]}


def q_encode(spark, sf):
    return EN.encode_batch(V.v_wide(spark, sf), _encode_schema(spark, sf), ENCODE_MAX_LENS)


register("A10_A13_encode_batch", with_views(_encode_sql(), "v_wide"))(q_encode)

FEATURE_GROUPS = {"geo": [1, 3], "basket": [15]}


def _groups_sql() -> str:
    by_fid = {e[0]: e for e in ENCODE_SCHEMA["user_int"]}
    cols = ["sample_id"]
    for name, members in FEATURE_GROUPS.items():
        cols.append(_int_block_sql("user_int_feats_", [by_fid[m] for m in members]) + f" {name}")
    return "select " + ", ".join(cols) + " from v_wide"


register("A19_feature_groups", with_views(_groups_sql(), "v_wide"))(
    lambda spark, sf: EN.feature_groups(V.v_wide(spark, sf), "user_int_feats_", _encode_schema(spark, sf)["user_int"], FEATURE_GROUPS)
)


def _oob_sql() -> str:
    parts = []
    for kind in ("user_int", "item_int"):
        for fid, vocab, dim in ENCODE_SCHEMA[kind]:
            col = f"{kind}_feats_{fid}"
            if vocab <= 0:
                continue
            if col in WIDE_ARRAYS:
                over = f"list_filter({col}[1:{dim}], lambda v: v >= {vocab})"
                parts.append(f"select '{kind}' grp, '{col}' \"column\", {vocab} vocab, coalesce(sum(len({over})), 0) n, "
                             f"min(list_min({over})) lo, max(list_max({over})) hi from v_wide")
            else:
                parts.append(f"select '{kind}' grp, '{col}' \"column\", {vocab} vocab, count(*) filter (where {col} >= {vocab}) n, "
                             f"min(case when {col} >= {vocab} then {col} end) lo, max(case when {col} >= {vocab} then {col} end) hi from v_wide")
    for dom, cfg in ENCODE_SCHEMA["seq"].items():
        L = ENCODE_MAX_LENS[dom]
        for fid, vocab in EN.side_fids(cfg):
            if vocab <= 0:
                continue
            col = f"{cfg['prefix']}_{fid}"
            over = f"list_filter({col}[1:{L}], lambda v: v >= {vocab})"
            parts.append(f"select '{dom}' grp, '{col}' \"column\", {vocab} vocab, coalesce(sum(len({over})), 0) n, "
                         f"min(list_min({over})) lo, max(list_max({over})) hi from v_wide")
    u = "\nunion all\n".join(parts)
    return f"""select grp, "column", cast(vocab as bigint) vocab, cast(n as bigint) oob_count,
       cast(lo as bigint) min_oob, cast(hi as bigint) max_oob,
       case when lo >= vocab then 'TOO_HIGH' else 'TOO_LOW' end direction
from ({u}) where n > 0"""


register("G15_oob_stats", with_views(_oob_sql(), "v_wide"))(
    lambda spark, sf: EN.oob_stats(V.v_wide(spark, sf), _encode_schema(spark, sf), ENCODE_MAX_LENS)
)


# ---------------------------------------------------------------- arrays (A)

from tessera.functions import arrays as A  # noqa: E402
from tessera.functions import scalars as S  # noqa: E402


def _r6(c):
    return F.round(c, 6)


@register(
    "A1_A5_array_pool",
    with_views(
        """select l_orderkey,
  coalesce(cast(list_sum(items) as double) / nullif(len(items), 0), 0.0) items_mean, coalesce(list_max(items), 0) items_max,
  coalesce(list_min(items), 0) items_min, cast(coalesce(list_sum(items), 0) as bigint) items_sum,
  cast(coalesce(len(items), 0) as bigint) items_len,
  round(coalesce(list_avg(qty), 0.0), 6) qty_mean, round(coalesce(list_sum(qty), 0.0), 6) qty_sum
from v_basket""",
        "v_basket",
    ),
)
def q_array_pool(spark, sf):
    b = V.v_basket(spark, sf)
    return b.select(
        "l_orderkey",
        A.pool_mean("items", True).alias("items_mean"), A.pool_max("items").alias("items_max"),
        A.pool_min("items").alias("items_min"), A.pool_sum("items").alias("items_sum"),
        A.length("items").alias("items_len"),
        _r6(A.pool_mean("qty")).alias("qty_mean"), _r6(A.pool_sum_double("qty")).alias("qty_sum"),
    )


SEQ_COLS = ["domain_a_seq_38", "domain_a_seq_39", "domain_a_seq_40"]


@register(
    "A6_A7_sequence_stats",
    with_views(
        "select sample_id, "
        + ", ".join(
            f"cast(coalesce(len({c}), 0) as bigint) {c}_len, coalesce(cast(list_sum({c}) as double) / nullif(len({c}), 0), 0.0) {c}_mean, "
            f"coalesce(list_max({c}), 0) {c}_max, coalesce({c}[-1], 0) {c}_last"
            for c in SEQ_COLS
        )
        + " from v_wide",
        "v_wide",
    ),
)
def q_seq_stats(spark, sf):
    w = V.v_wide(spark, sf)
    cols = ["sample_id"]
    for c in SEQ_COLS:
        cols += [A.length(c).alias(f"{c}_len"), A.pool_mean(c, True).alias(f"{c}_mean"),
                 A.pool_max(c).alias(f"{c}_max"), A.last(c).alias(f"{c}_last")]
    return w.select(*cols)


@register(
    "A8_A9_pad",
    with_views(
        f"""select sample_id, {D.pad_ids('user_int_feats_15', 5, 1000)} items_pad,
  {D.pad_ids('domain_a_seq_38', 16, 0)} seq_zero, {D.pad_dense('user_dense_feats_61', 4)} qty_pad
from v_wide""",
        "v_wide",
    ),
)
def q_pad(spark, sf):
    w = V.v_wide(spark, sf)
    return w.select(
        "sample_id", A.pad_ids("user_int_feats_15", 5, 1000).alias("items_pad"),
        A.pad_ids("domain_a_seq_38", 16, 0).alias("seq_zero"), A.pad_dense("user_dense_feats_61", 4).alias("qty_pad"),
    )


_L, _K = 64, 8


@register(
    "A14_A15_mask_and_latest_k",
    with_views(
        f"""select user_id, mask, round(s / greatest(n, 1), 6) masked_mean,
  list_concat(list_resize(cast([] as bigint[]), {_K} - len(tail), cast(0 as bigint)), tail) latest
from (select user_id, n, list_transform(p, lambda v, i: i - 1 >= n) mask,
             list_sum(p[1:n]) s, p[greatest(n - {_K}, 0) + 1 : greatest(n - {_K}, 0) + least(n, {_K})] tail
      from (select user_id, {D.pad_ids('seq_val', _L, 1000000)} p, least({D.length('seq_val')}, {_L}) n from v_user_seq))""",
        "v_user_seq",
    ),
)
def q_mask_latest(spark, sf):
    u = V.v_user_seq(spark, sf).select(
        "user_id", A.pad_ids("seq_val", _L, 1000000).alias("p"), A.padded_len("seq_val", _L).alias("n")
    )
    return u.select(
        "user_id", A.padding_mask("p", "n").alias("mask"), _r6(A.masked_mean("p", "n")).alias("masked_mean"),
        A.latest_k("p", "n", _K).alias("latest"),
    )


@register(
    "A17_vector_chunks",
    """select vec_id, list_transform(range(0, 5), lambda i:
         list_resize(cast(embedding as float[]), 65, cast(0 as float))[i * 13 + 1 : i * 13 + 13]) chunks
from embeddings""",
)
def q_chunks(spark, sf):
    e = V.embeddings(spark, sf)
    return e.select("vec_id", A.chunks("embedding", 5, 64).alias("chunks"))


# ---------------------------------------------------------------- scalars (P)

@register(
    "P1_P5_P6_labels_time",
    with_views(
        """select sample_id, cast(coalesce(label_type, 0) = 2 as bigint) label, cast(label_type - 1 as bigint) y,
  cast(((label_time % 86400) + 86400) % 86400 // 3600 as int) label_time_hour,
  cast((((ts_now // 86400) + 3) % 7 + 7) % 7 as int) ts_weekday,
  cast(((ts_now % 86400) + 86400) % 86400 // 3600 as int) ts_hour,
  cast(user_id as varchar) user_key
from v_interactions""",
        "v_interactions",
    ),
)
def q_labels_time(spark, sf):
    v = V.v_interactions(spark, sf)
    return v.select(
        "sample_id", S.label_binary("label_type").alias("label"), S.label_shift("label_type").alias("y"),
        S.hour_of_day("label_time").alias("label_time_hour"), S.weekday("ts_now").alias("ts_weekday"),
        S.hour_of_day("ts_now").alias("ts_hour"), F.col("user_id").cast("string").alias("user_key"),
    )


@register(
    "P2_drop_to_features",
    with_views(
        'select * exclude (sample_id, user_id, item_id, label_type, label_time, "timestamp") from v_wide', "v_wide"
    ),
)
def q_drop(spark, sf):
    return V.v_wide(spark, sf).drop("sample_id", "user_id", "item_id", "label_type", "label_time", "timestamp")


@register(
    "P3_P4_fill_and_clean",
    with_views(
        f"""select f.id, coalesce(f.f3, 0.0) f3_filled, coalesce(f.f1, 0.0) f1_filled
from v_features f""",
        "v_features",
    ),
)
def q_fill(spark, sf):
    f = V.v_features(spark, sf)
    return f.select("id", S.fill_zero("f3").alias("f3_filled"), S.fill_zero("f1").alias("f1_filled"))


@register(
    "P4_scalar_clean",
    with_views(
        f"""select sample_id, {D.clean_scalar('user_int_feats_3', 6)} u3, {D.clean_scalar('user_int_feats_1', 0)} u1,
  {D.clean_scalar('item_int_feats_5', 40)} i5 from v_wide""",
        "v_wide",
    ),
)
def q_clean(spark, sf):
    w = V.v_wide(spark, sf)
    return w.select(
        "sample_id", S.clean_scalar("user_int_feats_3", 6).alias("u3"), S.clean_scalar("user_int_feats_1", 0).alias("u1"),
        S.clean_scalar("item_int_feats_5", 40).alias("i5"),
    )


_LOGIT_SQL = "ln(least(greatest(prob, 1e-15), 1 - 1e-15) / (1 - least(greatest(prob, 1e-15), 1 - 1e-15)))"
_SIG_SQL = f"(1.0 / (1.0 + exp(-({_LOGIT_SQL}))))"
_BCE_SQL = f"(greatest({_LOGIT_SQL}, 0.0) - ({_LOGIT_SQL}) * label + ln(1 + exp(-abs({_LOGIT_SQL}))))"
_FOCAL_SQL = (
    f"((0.1 * label + 0.9 * (1 - label)) * pow(1.0 - ({_SIG_SQL} * label + (1.0 - {_SIG_SQL}) * (1 - label)), 2.0)"
    f" * {_BCE_SQL})"
)


def _scored_logit(spark, sf):
    return V.v_scored(spark, sf).withColumn("x", S.logit("prob"))


@register(
    "P7_P10_rowwise_loss",
    with_views(
        f"""select id, round(least(greatest(prob, 1e-15), 1 - 1e-15), 6) p_clip, round({_LOGIT_SQL}, 6) logit,
  round({_SIG_SQL}, 6) p_back, cast(prob >= 0.5 as int) pred, round({_BCE_SQL}, 6) bce, round({_FOCAL_SQL}, 6) focal
from v_scored""",
        "v_scored",
    ),
)
def q_rowwise_loss(spark, sf):
    s = _scored_logit(spark, sf)
    return s.select(
        "id", _r6(S.clip_prob("prob")).alias("p_clip"), _r6(F.col("x")).alias("logit"),
        _r6(S.sigmoid("x")).alias("p_back"), S.threshold("prob", 0.5).alias("pred"),
        _r6(S.bce_with_logits("x", "label")).alias("bce"), _r6(S.focal_loss("x", "label", 0.1, 2.0)).alias("focal"),
    )


@register(
    "P10_focal_reduce",
    with_views(
        f"select split, round(avg({_FOCAL_SQL}), 6) focal_mean, round(sum({_FOCAL_SQL}), 6) focal_sum from v_scored group by split",
        "v_scored",
    ),
)
def q_focal_reduce(spark, sf):
    s = _scored_logit(spark, sf).withColumn("fl", S.focal_loss("x", "label", 0.1, 2.0))
    return s.groupBy("split").agg(_r6(F.avg("fl")).alias("focal_mean"), _r6(F.sum("fl")).alias("focal_sum"))


@register(
    "P11_filters",
    with_views(
        """select sample_id, list_filter(domain_a_seq_38, lambda v: v > 0) pos_types
from v_wide where domain_a_seq_38 is not null and label_time is not null""",
        "v_wide",
    ),
)
def q_filters(spark, sf):
    w = V.v_wide(spark, sf).dropna(subset=["domain_a_seq_38", "label_time"])
    return w.select("sample_id", A.positive_only("domain_a_seq_38").alias("pos_types"))


_P12_NOW_SQL = "(label_time + (sample_id * 7919) % 40000000)"


@register(
    "P12_time_bucket",
    with_views(f"select sample_id, {D.time_bucket(_P12_NOW_SQL, 'label_time')} bucket from v_interactions", "v_interactions"),
)
def q_time_bucket(spark, sf):
    v = V.v_interactions(spark, sf)
    now = F.col("label_time") + F.pmod(F.col("sample_id") * 7919, F.lit(40000000))
    return v.select("sample_id", S.time_bucket(now, "label_time").alias("bucket"))


# ---------------------------------------------------------------- profiling (G)

from tessera.operators import profile as G  # noqa: E402

WIDE_COLS = [
    "sample_id", "user_id", "item_id", "label_type", "label_time", "timestamp", "user_int_feats_1",
    "user_int_feats_3", "user_int_feats_15", "user_dense_feats_61", "item_int_feats_5", "item_int_feats_11",
    "domain_a_seq_38", "domain_a_seq_39", "domain_a_seq_40", "domain_b_seq_70", "domain_b_seq_71",
]
WIDE_SCALARS = ["user_id", "item_id", "label_type", "user_int_feats_1", "user_int_feats_3", "item_int_feats_5"]
FEAT_COLS = ["f1", "f2", "f3", "f4"]

register(
    "G1_basic_info",
    with_views(
        f"""select count(*) n_samples, cast({len(WIDE_COLS)} as bigint) n_features,
  count(distinct user_id) n_users, count(distinct item_id) n_items from v_wide""",
        "v_wide",
    ),
)(lambda spark, sf: G.basic_info(V.v_wide(spark, sf)))


def _describe_sql() -> str:
    parts = [
        f"""select '{c}' "column", count({c}) "count", round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std,
  round(min({c}), 6) "min", round(max({c}), 6) "max", round(quantile_cont({c}, 0.25), 6) p25,
  round(quantile_cont({c}, 0.5), 6) p50, round(quantile_cont({c}, 0.75), 6) p75 from v_features"""
        for c in FEAT_COLS
    ]
    return "\nunion all\n".join(parts)


@register("G2_describe", with_views(_describe_sql(), "v_features"))
def q_describe(spark, sf):
    d = G.describe(V.v_features(spark, sf, with_id=False), FEAT_COLS)
    return d.select("column", "count", *[_r6(F.col(c)).alias(c) for c in ["mean", "std", "min", "max", "p25", "p50", "p75"]])


register(
    "G3_distinct_counts",
    with_views(
        "\nunion all\n".join(f"select '{c}' \"column\", count(distinct {c}) n_distinct from v_wide" for c in WIDE_SCALARS),
        "v_wide",
    ),
)(lambda spark, sf: G.distinct_counts(V.v_wide(spark, sf), WIDE_SCALARS))

register(
    "G4_value_counts",
    with_views(
        """select item_int_feats_5, count(*) n, round(count(*) / sum(count(*)) over (), 6) share
from v_wide where item_int_feats_5 is not null group by 1""",
        "v_wide",
    ),
)(lambda spark, sf: G.value_counts(V.v_wide(spark, sf), "item_int_feats_5").withColumn("share", _r6(F.col("share"))))

register(
    "G5_time_range",
    with_views(
        "select min(label_time) label_time_min, max(label_time) label_time_max, min(ts_now) ts_now_min, max(ts_now) ts_now_max from v_interactions",
        "v_interactions",
    ),
)(lambda spark, sf: G.time_range(V.v_interactions(spark, sf), ["label_time", "ts_now"]))

register(
    "G6_histogram",
    with_views(
        """select bin, count(*) n, round(any_value(lo) + (any_value(hi) - any_value(lo)) * bin / 30, 6) edge_lo
from (select cast(least(floor((f2 - lo) / (hi - lo) * 30), 29) as int) bin, lo, hi
      from v_features, (select min(f2) lo, max(f2) hi from v_features) r where f2 is not null) group by 1""",
        "v_features",
    ),
)(lambda spark, sf: G.histogram(V.v_features(spark, sf, with_id=False), "f2", 30).withColumn("edge_lo", _r6(F.col("edge_lo"))))

LEN_COLS = ["user_int_feats_15", "item_int_feats_11", "domain_a_seq_38", "domain_a_seq_39", "domain_b_seq_70"]


def _len_profile_sql() -> str:
    parts = [
        f"""select '{c}' "column", min(l) min_len, max(l) max_len, round(avg(l), 6) mean_len,
  round(quantile_cont(l, 0.5), 6) median_len from (select {D.length(c)} l from v_wide)"""
        for c in LEN_COLS
    ]
    return "\nunion all\n".join(parts)


@register("G7_G9_G10_length_profile", with_views(_len_profile_sql(), "v_wide"))
def q_len_profile(spark, sf):
    p = G.array_length_profile(V.v_wide(spark, sf), LEN_COLS)
    return p.select("column", "min_len", "max_len", _r6(F.col("mean_len")).alias("mean_len"), _r6(F.col("median_len")).alias("median_len"))


register(
    "G8_dense_profile",
    """select count(*) "count", round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(cast(min(v) as double), 6) "min",
  round(cast(max(v) as double), 6) "max", round((select avg(len(embedding)) from embeddings), 6) mean_len
from (select unnest(embedding) v from embeddings)""",
)(lambda spark, sf: G.dense_profile(V.embeddings(spark, sf), "embedding").select(
    "count", *[_r6(F.col(c)).alias(c) for c in ["mean", "std", "min", "max", "mean_len"]]))

register(
    "G12_interaction_summary",
    with_views(
        """select k "key", count(*) n_keys, cast(sum(c) as bigint) n_rows, min(c) min_per_key, max(c) max_per_key,
  round(avg(c), 6) mean_per_key
from (select 'user_id' k, user_id id, count(*) c from v_interactions group by 2
      union all select 'item_id', item_id, count(*) from v_interactions group by 2) group by 1""",
        "v_interactions",
    ),
)(lambda spark, sf: G.interaction_summary(V.v_interactions(spark, sf)).withColumn("mean_per_key", _r6(F.col("mean_per_key"))))

register(
    "G12_per_user_histogram",
    with_views(
        """select bin, count(*) n, round(any_value(lo) + (any_value(hi) - any_value(lo)) * bin / 20, 6) edge_lo
from (select cast(least(floor((k - lo) / (hi - lo) * 20), 19) as int) bin, lo, hi
from (select user_id, count(*) k from v_interactions group by 1) p,
     (select case when min(k) = max(k) then min(k) - 0.5 else min(k) end lo,
             case when min(k) = max(k) then max(k) + 0.5 else max(k) end hi
      from (select user_id, count(*) k from v_interactions group by 1)) r) group by 1""",
        "v_interactions",
    ),
)(lambda spark, sf: G.per_key_histogram(V.v_interactions(spark, sf), "user_id", 20).withColumn("edge_lo", _r6(F.col("edge_lo"))))

register(
    "G13_missing_values",
    with_views(
        "\nunion all\n".join(
            f"select '{c}' \"column\", count(*) filter (where {c} is null{' or isnan(' + c + ')' if c in ('x',) else ''}) n_missing from v_wide"
            for c in WIDE_COLS
        ),
        "v_wide",
    ),
)(lambda spark, sf: G.missing_values(V.v_wide(spark, sf)))

register(
    "G13_missing_summary",
    with_views(
        "select count(*) filter (where n > 0) n_cols_with_missing, cast(sum(case when c in ('user_id','item_id','label_type','label_time','timestamp') then n else 0 end) as bigint) id_missing from ("
        + "\nunion all\n".join(f"select '{c}' c, count(*) filter (where {c} is null) n from v_wide" for c in WIDE_COLS)
        + ")",
        "v_wide",
    ),
)(lambda spark, sf: G.missing_summary(V.v_wide(spark, sf), ["user_id", "item_id", "label_type", "label_time", "timestamp"]))

register(
    "G14_duplicate_rows",
    "select cast(sum(k - 1) as bigint) n_duplicates from (select *, count(*) k from lineitem group by all)",
)(lambda spark, sf: (lambda li: G.duplicate_rows(li, li.columns))(V.read_table(spark, sf, "lineitem")))

register(
    "G16_class_weights",
    with_views(
        """select y, n_c, round(sum(n_c) over () / (count(*) over () * n_c), 6) weight,
  round(sum(case when y = 0 then n_c end) over () / sum(case when y = 1 then n_c end) over (), 6) scale_pos_weight
from (select cast(label_type - 1 as bigint) y, count(*) n_c from v_interactions group by 1)""",
        "v_interactions",
    ),
)(lambda spark, sf: G.class_weights(V.v_interactions(spark, sf).select(S.label_shift("label_type").alias("y")), "y")
  .select("y", "n_c", _r6(F.col("weight")).alias("weight"), _r6(F.col("scale_pos_weight")).alias("scale_pos_weight")))

register(
    "G17_feature_std",
    with_views(
        "\nunion all\n".join(
            f"select '{c}' \"column\", round(stddev_samp({c}), 6) std, coalesce(stddev_samp({c}) = 0 or isnan(stddev_samp({c})), true) skip from v_features"
            for c in FEAT_COLS
        ),
        "v_features",
    ),
)(lambda spark, sf: G.feature_std(V.v_features(spark, sf, with_id=False), FEAT_COLS).withColumn("std", _r6(F.col("std"))))

register(
    "G18_grouped_mean_std",
    with_views(
        "select run_id, round(avg(val_auc), 6) mean, round(stddev_pop(val_auc), 6) std, count(val_auc) n from v_runs group by 1",
        "v_runs",
    ),
)(lambda spark, sf: G.grouped_mean_std(V.v_runs(spark, sf), "run_id", "val_auc").select(
    "run_id", _r6(F.col("mean")).alias("mean"), _r6(F.col("std")).alias("std"), "n"))


# ---------------------------------------------------------------- metrics (M) and ranking (W)

from tessera.operators import metrics as M  # noqa: E402
from tessera.operators import ranking as W  # noqa: E402

_AUC_SQL = """
c as (select split, prob, cast(sum(label) as bigint) pos, cast(sum(1 - label) as bigint) neg from v_scored
      where not isnan(prob) group by 1, 2),
a0 as (select *, sum(neg) over (partition by split order by prob rows between unbounded preceding and current row) cum_neg from c),
a as (select split, sum(pos * ((cum_neg - neg) + neg / 2.0)) num, sum(pos) p, sum(neg) n from a0 group by 1),
auc as (select split, case when p * n > 0 then num / (p * n) else 'nan'::double end auc from a)"""


def _scored(spark, sf):
    return V.v_scored(spark, sf)


register("M1_auc", with_views(f", {_AUC_SQL.strip()}\nselect split, round(auc, 6) auc from auc", "v_scored"))(
    lambda spark, sf: M.auc(_scored(spark, sf), "split").withColumn("auc", _r6(F.col("auc")))
)

register("M1_auc_unrounded", with_views(f", {_AUC_SQL.strip().replace('prob', 'score')}\nselect split, round(auc, 6) auc from auc", "v_scored"))(
    lambda spark, sf: M.auc(_scored(spark, sf), "split", score="score").withColumn("auc", _r6(F.col("auc")))
)

register(
    "M1_auc_overall",
    with_views(
        f", {_AUC_SQL.strip().replace('from v_scored', 'from (select label, prob, 1 split from v_scored)')}\nselect round(auc, 6) auc from auc",
        "v_scored",
    ),
)(lambda spark, sf: M.auc(_scored(spark, sf).withColumn("split", F.lit(1)), "split").select(_r6(F.col("auc")).alias("auc")))

_LL_SQL = "-(label * ln(least(greatest(prob, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15)))"

register("M2_logloss", with_views(f"select split, round(avg({_LL_SQL}), 6) logloss from v_scored group by 1", "v_scored"))(
    lambda spark, sf: M.logloss(_scored(spark, sf), "split").withColumn("logloss", _r6(F.col("logloss")))
)

register(
    "M2_bce_logits",
    with_views(f"select split, round(avg({_BCE_SQL}), 6) bce from v_scored group by 1", "v_scored"),
)(lambda spark, sf: M.bce_logits_mean(_scored_logit(spark, sf), "split", "label", "x").withColumn("bce", _r6(F.col("bce"))))

register(
    "M3_threshold_metrics",
    with_views(
        """select split, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy,
  round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) "precision",
  round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) recall,
  round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) f1
from (select split, count(*) filter (where label = 1 and prob >= 0.5) tp, count(*) filter (where label = 0 and prob >= 0.5) fp,
             count(*) filter (where label = 1 and prob < 0.5) fn, count(*) filter (where label = 0 and prob < 0.5) tn
      from v_scored group by 1)""",
        "v_scored",
    ),
)(lambda spark, sf: M.threshold_metrics(_scored(spark, sf), "split").select(
    "split", *[_r6(F.col(c)).alias(c) for c in ["accuracy", "precision", "recall", "f1"]]))

register(
    "M4_classification_report",
    with_views(
        """, cm as (select split, label, cast(prob >= 0.5 as int) pred, count(*) n from v_scored group by 1, 2, 3),
per as (select split, cast(cls as varchar) cls,
          case when pp > 0 then tp / pp else 0.0 end "precision", case when sup > 0 then tp / sup else 0.0 end recall,
          case when pp + sup > 0 then 2 * tp / (pp + sup) else 0.0 end f1, sup support
        from (select split, k.cls, sum(case when label = k.cls and pred = k.cls then n else 0 end) tp,
                     sum(case when pred = k.cls then n else 0 end) pp, sum(case when label = k.cls then n else 0 end) sup
              from cm, (values (0), (1)) k(cls) group by 1, 2)),
rep as (select * from per
  union all select split, 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support) from per group by 1
  union all select split, 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) from per group by 1)
select split, cls, round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1, cast(support as bigint) support from rep""",
        "v_scored",
    ),
)(lambda spark, sf: M.classification_report(_scored(spark, sf), "split").select(
    "split", "cls", *[_r6(F.col(c)).alias(c) for c in ["precision", "recall", "f1"]], F.col("support").cast("bigint").alias("support")))

register(
    "M5_confusion_matrix",
    with_views("select split, label, cast(prob >= 0.5 as int) pred, count(*) n from v_scored group by 1, 2, 3", "v_scored"),
)(lambda spark, sf: M.confusion_matrix(_scored(spark, sf), "split"))

_CURVE_SQL = """
c as (select split, prob, cast(sum(label) as bigint) pos, cast(sum(1 - label) as bigint) neg from v_scored
      where not isnan(prob) group by 1, 2),
cc as (select *, sum(pos) over w cum_pos, sum(neg) over w cum_neg, sum(pos) over (partition by split) p, sum(neg) over (partition by split) n
       from c window w as (partition by split order by prob desc rows between unbounded preceding and current row))"""

register(
    "M6_W7_roc_curve",
    with_views(
        f""", {_CURVE_SQL.strip()}
select split, prob threshold, round(case when n > 0 then cum_neg / n else 'nan'::double end, 6) fpr,
       round(case when p > 0 then cum_pos / p else 'nan'::double end, 6) tpr from cc
union all
select distinct split, 'inf'::double, 0.0, 0.0 from cc""",
        "v_scored",
    ),
)(lambda spark, sf: M.roc_curve(_scored(spark, sf), "split").select("split", "threshold", _r6(F.col("fpr")).alias("fpr"), _r6(F.col("tpr")).alias("tpr")))

register(
    "M6_roc_curve_unrounded",
    with_views(
        f""", {_CURVE_SQL.strip().replace('prob', 'score')}
select split, score threshold, round(cum_neg / n, 6) fpr, round(cum_pos / p, 6) tpr from cc
union all
select distinct split, 'inf'::double, 0.0, 0.0 from cc""",
        "v_scored",
    ),
)(lambda spark, sf: M.roc_curve(_scored(spark, sf), "split", score="score").select("split", "threshold", _r6(F.col("fpr")).alias("fpr"), _r6(F.col("tpr")).alias("tpr")))

register(
    "M7_pr_curve",
    with_views(
        f""", {_CURVE_SQL.strip()}
select split, prob threshold, round(cum_pos / (cum_pos + cum_neg), 6) "precision",
       round(case when p > 0 then cum_pos / p else 'nan'::double end, 6) recall from cc""",
        "v_scored",
    ),
)(lambda spark, sf: M.pr_curve(_scored(spark, sf), "split").select("split", "threshold", _r6(F.col("precision")).alias("precision"), _r6(F.col("recall")).alias("recall")))

register(
    "M7_average_precision",
    with_views(
        f""", {_CURVE_SQL.strip()}
select split, round(case when any_value(p) > 0 then sum(pos * cum_pos / (cum_pos + cum_neg)) / any_value(p) else 'nan'::double end, 6) average_precision
from cc group by 1""",
        "v_scored",
    ),
)(lambda spark, sf: M.average_precision(_scored(spark, sf), "split").withColumn("average_precision", _r6(F.col("average_precision"))))

register(
    "M8_best_f1_threshold",
    with_views(
        """select split, round(arg_max(i, struct_pack(f1 := f1, ni := -i)) / 100.0, 6) threshold,
       round(max(f1), 6) f1
from (select split, i, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end f1
      from (select s.split, g.i, count(*) filter (where s.label = 1 and s.prob >= g.i / 100.0) tp,
                   count(*) filter (where s.label = 0 and s.prob >= g.i / 100.0) fp,
                   count(*) filter (where s.label = 1 and s.prob < g.i / 100.0) fn
            from v_scored s, (select range i from range(10, 100)) g where not isnan(s.prob) group by 1, 2))
group by 1""",
        "v_scored",
    ),
)(lambda spark, sf: M.best_f1_threshold(_scored(spark, sf), "split").select("split", _r6(F.col("threshold")).alias("threshold"), _r6(F.col("f1")).alias("f1")))

register(
    "M9_nan_filter",
    with_views(
        "select count(*) filter (where prob is null or isnan(prob)) n_nan, count(*) filter (where not (prob is null or isnan(prob))) n_kept from v_scored",
        "v_scored",
    ),
)(lambda spark, sf: (lambda kept_nan: kept_nan[1].crossJoin(kept_nan[0].agg(F.count(F.lit(1)).alias("n_kept"))))(M.nan_filter(_scored(spark, sf))))

register(
    "M10_split_comparison",
    with_views(
        f""", {_AUC_SQL.strip()}
select 'events' model, round(max(case when split = 'train' then auc end), 6) auc_train,
       round(max(case when split = 'val' then auc end), 6) auc_val, round(max(case when split = 'test' then auc end), 6) auc_test,
       round(max(case when split = 'train' then auc end) - max(case when split = 'test' then auc end), 6) auc_gap from auc""",
        "v_scored",
    ),
)(lambda spark, sf: M.split_comparison(M.auc(_scored(spark, sf), "split").withColumn("model", F.lit("events")), "model").select(
    "model", *[_r6(F.col(c)).alias(c) for c in ["auc_train", "auc_val", "auc_test", "auc_gap"]]))

_HIST = "(select label, prob, id, split run, id % 5 step, split || ':' || (id % 5) split from v_scored)"
register(
    "M11_metric_history",
    with_views(
        f""", {_AUC_SQL.strip().replace('from v_scored', f'from {_HIST}')},
rest as (select split, any_value(run) run, any_value(step) step, avg({_BCE_SQL}) loss, avg({_LL_SQL}) logloss,
                avg(case when (prob >= 0.5) = (label = 1) then 1.0 else 0.0 end) accuracy from {_HIST} group by 1)
select run, step, round(loss, 6) loss, round(auc, 6) auc, round(logloss, 6) logloss, round(accuracy, 6) accuracy from rest join auc using (split)""",
        "v_scored",
    ),
)(lambda spark, sf: M.history(_scored_logit(spark, sf).withColumn("run", F.col("split")).withColumn("step", F.pmod("id", F.lit(5))), "run", "step", logit="x")
  .select("run", "step", *[_r6(F.col(c)).alias(c) for c in ["loss", "auc", "logloss", "accuracy"]]))

register(
    "M11_history_table",
    with_views(
        "select run_id, count(*) n_steps, round(avg(val_auc), 6) mean_val_auc, arg_max(val_auc, step) last_val_auc, min(step) first_step, max(step) last_step from v_runs group by 1",
        "v_runs",
    ),
)(lambda spark, sf: V.v_runs(spark, sf).groupBy("run_id").agg(
    F.count(F.lit(1)).alias("n_steps"), _r6(F.avg("val_auc")).alias("mean_val_auc"), F.max_by("val_auc", "step").alias("last_val_auc"),
    F.min("step").alias("first_step"), F.max("step").alias("last_step")))

register(
    "W1_W2_top10",
    with_views("select run_id, step, val_auc from v_runs order by val_auc desc, run_id, step limit 10", "v_runs"),
)(lambda spark, sf: W.head(V.v_runs(spark, sf), "val_auc", 10, ["run_id", "step"]))

register(
    "W3_top_k_runs",
    with_views(
        "select * from (select run_id, step, val_auc, row_number() over (partition by run_id order by val_auc desc, step) \"rank\" from v_runs) where \"rank\" <= 3",
        "v_runs",
    ),
)(lambda spark, sf: W.top_k_per_group(V.v_runs(spark, sf), "run_id", "val_auc", "step", 3))

register(
    "W4_best_step",
    with_views(
        "select run_id, arg_max(step, struct_pack(v := val_auc, ns := -step)) best_step, max(val_auc) best_value from v_runs group by 1",
        "v_runs",
    ),
)(lambda spark, sf: W.best_step(V.v_runs(spark, sf), "run_id", "val_auc", "step", "max"))

register(
    "W5_feature_rank",
    with_views(
        """select "column", round(std, 6) std, row_number() over (order by std desc, "column") "rank" from (
  select 'f1' "column", stddev_samp(f1) std from v_features union all select 'f2', stddev_samp(f2) from v_features
  union all select 'f3', stddev_samp(f3) from v_features union all select 'f4', stddev_samp(f4) from v_features)""",
        "v_features",
    ),
)(lambda spark, sf: W.rank_rows(G.feature_std(V.v_features(spark, sf, with_id=False), FEAT_COLS).drop("skip"), "std", 20, ["column"])
  .select("column", _r6(F.col("std")).alias("std"), "rank"))

register(
    "W6_dedupe_last",
    with_views(
        "select user_id, arg_max(sample_id, sample_id) sample_id, arg_max(item_id, sample_id) item_id from v_interactions group by 1",
        "v_interactions",
    ),
)(lambda spark, sf: W.dedupe(V.v_interactions(spark, sf).select("user_id", "sample_id", "item_id"), "user_id", "sample_id", "last"))

register(
    "W6_dedupe_first",
    with_views(
        "select user_id, arg_min(sample_id, sample_id) sample_id, arg_min(item_id, sample_id) item_id from v_interactions group by 1",
        "v_interactions",
    ),
)(lambda spark, sf: W.dedupe(V.v_interactions(spark, sf).select("user_id", "sample_id", "item_id"), "user_id", "sample_id", "first"))

register(
    "W8_early_stopping",
    with_views(
        """, h as (select run_id, step, val_auc, row_number() over (partition by run_id order by step) rn,
          max(val_auc) over (partition by run_id order by step rows between unbounded preceding and 1 preceding) prev_best from v_runs),
i as (select *, max(case when prev_best is null or val_auc > prev_best then rn end)
          over (partition by run_id order by rn rows between unbounded preceding and current row) last_imp from h)
select run_id, max(val_auc) best_value, cast(arg_min(step, struct_pack(nv := -val_auc, s := step)) as bigint) best_step,
       cast(any_value(stop_step) as bigint) stop_step
from (select *, min(case when rn - last_imp >= 3 then step end) over (partition by run_id) stop_step from i)
where stop_step is null or step <= stop_step group by 1""",
        "v_runs",
    ),
)(lambda spark, sf: W.early_stopping(V.v_runs(spark, sf), "run_id", "step", "val_auc", patience=3, min_delta=0.0, mode="max"))


def _w8_sql(margin: float, patience: int, mode: str) -> str:
    """The tracker step by step, one recursion row a step of every run."""
    better = f"h.val_auc > r.best + {margin!r}" if mode == "max" else f"h.val_auc < r.best - {margin!r}"
    return f"""with recursive v_runs as ({V.SQL['v_runs']}),
h as (select *, row_number() over (partition by run_id order by step) rn from v_runs),
r as (select run_id, rn, val_auc best, cast(step as bigint) best_step, 0 counter, cast(null as bigint) stop_step from h where rn = 1
  union all
  select h.run_id, h.rn,
         case when r.stop_step is null and {better} then h.val_auc else r.best end,
         case when r.stop_step is null and {better} then h.step else r.best_step end,
         case when r.stop_step is not null then r.counter when {better} then 0 else r.counter + 1 end,
         case when r.stop_step is not null then r.stop_step when not ({better}) and r.counter + 1 >= {patience} then h.step end
  from r join h on h.run_id = r.run_id and h.rn = r.rn + 1)
select run_id, max_by(best, rn) best_value, max_by(best_step, rn) best_step, cast(max(stop_step) as bigint) stop_step from r group by run_id"""


for _mode in ("max", "min"):
    register(f"W8_early_stopping_margin_{_mode}", _w8_sql(1e-4, 5, _mode))(
        lambda spark, sf, mode=_mode: W.early_stopping(V.v_runs(spark, sf), "run_id", "step", "val_auc", patience=5, min_delta=1e-4, mode=mode))


# ---------------------------------------------------------------- augmentation (N, J3, A18)

from tessera.functions.rand import uniform_sql, gaussian_sql  # noqa: E402,F401
from tessera.operators import augment as N  # noqa: E402

def _r4(c):
    return F.round(c, 4)


_SD = "(select stddev_samp(f1) sd_f1, stddev_samp(f2) sd_f2, stddev_samp(f4) sd_f4 from v_features) sd"

register(
    "N1_scalar_gaussian_noise",
    with_views(
        f"select id, {', '.join(f'round({D.n1(c, 'id', c, 0.01, 'sd_' + c)}, 4) {c}' for c in ['f1', 'f2', 'f4'])}, f3 from v_features, {_SD}",
        "v_features",
    ),
)(lambda spark, sf: N.scalar_gaussian_noise(V.v_features(spark, sf).select("id", "f1", "f2", "f4", "f3"), ["f1", "f2", "f4"], "id", 0.01)
  .select("id", *[_r4(F.col(c)).alias(c) for c in ["f1", "f2", "f4"]], "f3"))

register(
    "N2_scalar_random_scale",
    with_views(f"select id, {', '.join(f'round({D.n2(c, 'id', c, 0.95, 1.05)}, 4) {c}' for c in ['f1', 'f2'])} from v_features", "v_features"),
)(lambda spark, sf: N.scalar_random_scale(V.v_features(spark, sf).select("id", "f1", "f2"), ["f1", "f2"], "id", 0.95, 1.05)
  .select("id", *[_r4(F.col(c)).alias(c) for c in ["f1", "f2"]]))

_ARR = "user_int_feats_15"

register(
    "N3_N4_array_mask_crop",
    with_views(
        f"select sample_id, {D.n3(_ARR, 'sample_id', _ARR, 0.1)} masked, {D.n4(_ARR, 'sample_id', _ARR, 0.8)} cropped from v_wide",
        "v_wide",
    ),
)(lambda spark, sf: (lambda w: N.array_random_mask(w, [_ARR], "sample_id", 0.1).select("sample_id", F.col(_ARR).alias("masked")).join(
    N.array_random_crop(w, [_ARR], "sample_id", 0.8).select("sample_id", F.col(_ARR).alias("cropped")), "sample_id"))(
    V.v_wide(spark, sf).select("sample_id", _ARR)))

register(
    "N5_N6_N7_sequence_ops",
    with_views(
        f"""select user_id, {D.n5('seq_val', 'user_id', 'seq_val', 0.15)} masked, {D.n6('seq_type', 'user_id', 'seq_type', 0.8)} sub,
  {D.n7('seq_ts', 'user_id', 'seq_ts', 3)} reordered from v_user_seq""",
        "v_user_seq",
    ),
)(lambda spark, sf: (lambda u: N.chunk_reorder(N.sequence_subsample(N.sequence_random_mask(u, ["seq_val"], "user_id", 0.15), ["seq_type"], "user_id", 0.8),
                                               ["seq_ts"], "user_id", 3))(V.v_user_seq(spark, sf))
  .select("user_id", F.col("seq_val").alias("masked"), F.col("seq_type").alias("sub"), F.col("seq_ts").alias("reordered")))

AUG_SCALARS = ["user_int_feats_1", "item_int_feats_5"]
AUG_ARRAYS = ["user_int_feats_15"]
AUG_SEQS = ["domain_a_seq_38", "domain_a_seq_40"]
_WSD = "(select " + ", ".join(f"stddev_samp({c}) sd_{c}" for c in AUG_SCALARS) + " from v_wide) sd"


def _preset_sql(kind: str, key: str) -> str:
    cols = []
    for c in AUG_SCALARS:
        if kind == "conservative":
            cols.append(f"round({D.n1(c, key, c, 0.01, 'sd_' + c)}, 4) {c}")
        else:
            cols.append(f"round({D.n2(D.n1(c, key, c, 0.05, 'sd_' + c), key, c, 0.9, 1.1)}, 4) {c}")
    for c in AUG_ARRAYS:
        cols.append((D.n3(c, key, c, 0.1) if kind == "conservative" else D.n4(D.n3(c, key, c, 0.2), key, c, 0.8)) + f" {c}")
    for c in AUG_SEQS:
        r1, r2 = (0.1, 0.8) if kind == "conservative" else (0.15, 0.7)
        cols.append(D.n6(D.n5(c, key, c, r1), key, c, r2) + f" {c}")
    return ", ".join(cols)


def _preset_spark(spark, sf, kind):
    w = V.v_wide(spark, sf).select("sample_id", *AUG_SCALARS, *AUG_ARRAYS, *AUG_SEQS)
    narrow = V.v_wide(spark, sf, with_seq=False).select(*AUG_SCALARS)  # deviations without the sequences
    a = N.STRATEGIES[kind](w, AUG_SCALARS, AUG_ARRAYS, AUG_SEQS, "sample_id", std_source=narrow)
    return a.withColumns({c: _r4(F.col(c)) for c in AUG_SCALARS})


register("N8_conservative_preset", with_views(f"select sample_id, {_preset_sql('conservative', 'sample_id')} from v_wide, {_WSD}", "v_wide"))(
    lambda spark, sf: _preset_spark(spark, sf, "conservative"))
register("N9_aggressive_preset", with_views(f"select sample_id, {_preset_sql('aggressive', 'sample_id')} from v_wide, {_WSD}", "v_wide"))(
    lambda spark, sf: _preset_spark(spark, sf, "aggressive"))

_AKEY = "concat_ws('#', cast(sample_id as varchar), cast(copy + 42 as varchar))"


@register(
    "N10_augmented_dataset",
    with_views(
        ", ".join([]) + f"""select sample_id, {', '.join(f'round(cast({c} as double), 4) {c}' for c in AUG_SCALARS)}, {', '.join(AUG_ARRAYS + AUG_SEQS)}, cast(0 as int) copy from v_wide
union all
select sample_id, {_preset_sql('conservative', _AKEY)}, cast(copy as int)
from (select *, unnest(range(1, 3)) copy from v_wide), {_WSD}""",
        "v_wide",
    ),
)
def q_aug_dataset(spark, sf):
    w = V.v_wide(spark, sf).select("sample_id", *AUG_SCALARS, *AUG_ARRAYS, *AUG_SEQS)
    narrow = V.v_wide(spark, sf, with_seq=False).select(*AUG_SCALARS)  # deviations without the sequences
    a = N.augmented_dataset(w, AUG_SCALARS, AUG_ARRAYS, AUG_SEQS, "sample_id", factor=3, strategy="conservative", std_source=narrow)
    return a.withColumns({c: _r4(F.col(c)) for c in AUG_SCALARS}).withColumn("copy", F.col("copy").cast("int"))


_N11_BLOCK = 100
register(
    "N11_batch_dense_augment",
    f"""select vec_id, list_transform(case when (vec_id % {_N11_BLOCK}) % 32 < floor(least(32, n - ((vec_id % {_N11_BLOCK}) - (vec_id % {_N11_BLOCK}) % 32)) * 0.1::double + 1e-9) then
  list_transform(embedding, lambda v, i: cast(v * (0.9::double + {0.2!r}::double * {uniform_sql(SqlExpr('vec_id'), 'n11s', '42')}) + {gaussian_sql(SqlExpr('vec_id'), 'n11g', '42', SqlExpr('i - 1'))} * 0.01::double as float))
  else embedding end, lambda x: cast(x as double)) embedding
from (select *, count(*) over (partition by vec_id // {_N11_BLOCK}) n from embeddings)""",
)(lambda spark, sf: N.batch_dense_augment(
    V.embeddings(spark, sf).select("vec_id", "embedding", F.floor(F.col("vec_id") / _N11_BLOCK).alias("block"), F.pmod("vec_id", F.lit(_N11_BLOCK)).alias("pos")),
    "embedding", "vec_id", "block", "pos", 32, 0.1, 0.01, (0.9, 1.1)).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))

_PAIR_SQL = f"""select *, coalesce(lead({{c}}) over w, first_value({{c}}) over wa) {{c}}_partner from (
  select *, {hash32_sql(SqlExpr('{k}'), 'pair', '42')} h from {{src}})
window w as ({{by}}order by h, {{k}}), wa as ({{by}}order by h, {{k}} rows between unbounded preceding and unbounded following)"""


def _pair_sql(src: str, k: str, c: str, by: str = "") -> str:
    return _PAIR_SQL.replace("{k}", k).format(src=src, c=c, by=by, k=k)


register(
    "J3_partner_pairing",
    with_views(f"select id, f2, f2_partner from ({_pair_sql('v_features', 'id', 'f2')})", "v_features"),
)(lambda spark, sf: N.pair_partners(V.v_features(spark, sf).select("id", "f2"), "id", ["f2"]))

register(
    "N14_array_mix",
    f"select vec_id, list_transform(list_zip(embedding, embedding_partner), lambda z: 0.3 * cast(z[1] as double) + 0.7 * cast(z[2] as double)) embedding from ({_pair_sql('embeddings', 'vec_id', 'embedding')})",
)(lambda spark, sf: N.array_mix(V.embeddings(spark, sf).select("vec_id", "embedding"), "vec_id", "embedding", 0.3))

register(
    "A18_same_label_concat",
    with_views(
        f"select sample_id, label_type, list_concat(domain_a_seq_38, domain_a_seq_38_partner[1:5]) domain_a_seq_38 from ({_pair_sql('(select sample_id, label_type, domain_a_seq_38 from v_wide)', 'sample_id', 'domain_a_seq_38', 'partition by label_type ')})",
        "v_wide",
    ),
)(lambda spark, sf: N.same_label_concat(V.v_wide(spark, sf).select("sample_id", "label_type", "domain_a_seq_38"), "sample_id", "domain_a_seq_38", "label_type", 5))


def _beta_sql(key: str, a: float) -> str:
    u = {s: uniform_sql(SqlExpr(key), f"mixup:{s}", "42") for s in "uvab"}
    y = f"(0.5 * (1.0 + cos({2 * math.pi!r} * {u['u']}) * sqrt(1.0 - pow(1.0 - {u['v']}, {2.0 / (2.0 * a + 1.0)!r}))))"
    y = f"least(greatest({y}, 1e-16), {1.0 - 1e-16!r})"
    return f"(1.0 / (1.0 + exp(-(ln({y}) - ln(1.0 - {y}) + (ln(1.0 - {u['a']}) - ln(1.0 - {u['b']})) / {a!r}))))"


register(
    "N13_mixup",
    with_views(
        f"""select id, round(lam * f2 + (1 - lam) * f2_partner, 6) f2, round(lam * y + (1 - lam) * y_partner, 6) y, round(lam, 6) lam from (
  select *, {_beta_sql('id', 0.2)} lam from (
    select p.*, q.y_partner from ({_pair_sql('(select id, f2, cast(label_type - 1 as double) y from v_features)', 'id', 'f2')}) p
    join ({_pair_sql('(select id, f2, cast(label_type - 1 as double) y from v_features)', 'id', 'y')}) q using (id)))""",
        "v_features",
    ),
)(lambda spark, sf: N.mixup(V.v_features(spark, sf).select("id", "f2", S.label_shift("label_type").cast("double").alias("y")), "id", ["f2"], "y", 0.2)
  .select("id", _r6(F.col("f2")).alias("f2"), _r6(F.col("y")).alias("y"), _r6(F.col("lam")).alias("lam")))

register(
    "N15_train_only_augment",
    with_views(
        f""", {SPLIT_SQL_CORE.strip()}
select sample_id, split, case when split = 'train' then {D.n3('items', 'sample_id', 'items', 0.1)} else items end items
from (select sp.sample_id, sp.split, b.items from sp join v_basket b on sp.sample_id = b.l_orderkey)""",
        "v_interactions", "v_basket",
    ),
)(lambda spark, sf: N.augment_train_only(
    _split(spark, sf).join(V.v_basket(spark, sf), F.col("sample_id") == F.col("l_orderkey")).select("sample_id", "split", "items"),
    lambda d: N.array_random_mask(d, ["items"], "sample_id", 0.1)))


# ---------------------------------------------------------------- joins (J), fitted transforms (F1, F2)

from tessera.operators import codes as CO  # noqa: E402
from tessera.operators import joins as J  # noqa: E402

_SCALE_SQL = """select id, {cols} from v_features,
  (select {stats} from v_features) s"""


def _f1_sql() -> str:
    stats = ", ".join(f"avg(case when not isnan({c}) then {c} end) m_{c}, stddev_pop(case when not isnan({c}) then {c} end) s_{c}" for c in FEAT_COLS)
    cols = ", ".join(f"round(({c} - m_{c}) / (case when s_{c} is null or s_{c} = 0 then 1.0 else s_{c} end), 6) {c}" for c in FEAT_COLS)
    return _SCALE_SQL.format(cols=cols, stats=stats)


@register("F1_J1_standard_scale", with_views(_f1_sql(), "v_features"))
def q_scale(spark, sf):
    f = V.v_features(spark, sf).select("id", *FEAT_COLS)
    out = J.apply_scaler(f, J.fit_scaler(f, FEAT_COLS), FEAT_COLS)
    return out.select("id", *[_r6(F.col(c)).alias(c) for c in FEAT_COLS])


@register(
    "F2_J2_label_encode",
    with_views(
        """select sample_id, cast(dense_rank() over (order by cast(user_id as varchar)) - 1 as bigint) user_code,
  cast(dense_rank() over (order by cast(item_id as varchar)) - 1 as bigint) item_code from v_interactions""",
        "v_interactions",
    ),
)
def q_label_encode(spark, sf):
    v = V.v_interactions(spark, sf).select("sample_id", "user_id", "item_id")
    out = J.apply_label_codes(v, J.fit_label_codes(v, "user_id"), "user_id", "user_code")
    out = J.apply_label_codes(out, J.fit_label_codes(v, "item_id"), "item_id", "item_code")
    return out.select("sample_id", "user_code", "item_code")


_EMB_DIM = 64
# every item is looked up: ids fold onto the vectors that the table has
_BAG_SQL = """select l_orderkey, list_transform(items, lambda x: x % nv) items from v_basket, (select count(*) nv from embeddings)"""
_ZERO_SQL = f"list_resize(cast([] as float[]), {_EMB_DIM}, cast(0 as float))"


def _bags(spark, sf):
    """Baskets of vector ids, and the vocabulary: one more than the largest id."""
    e = V.embeddings(spark, sf).agg(F.count(F.lit(1)).alias("n"), (F.max("vec_id") + 1).alias("vocab")).first()
    b = V.v_basket(spark, sf).select("l_orderkey", F.transform("items", lambda x: F.pmod(x, F.lit(e["n"]))).alias("items"))
    return b, e["vocab"]


@register(
    "J4_vector_lookup",
    with_views(
        f"""select b.l_orderkey, b.pos, b.id, case when b.id > 0 then coalesce(e.embedding, {_ZERO_SQL}) else {_ZERO_SQL} end embedding
from (select l_orderkey, unnest(range(0, len(items))) pos, unnest(items) id from ({_BAG_SQL})) b
left join embeddings e on b.id > 0 and e.vec_id = b.id""",
        "v_basket",
    ),
)
def q_lookup(spark, sf):
    bags, vocab = _bags(spark, sf)
    ids = bags.select("l_orderkey", F.posexplode("items").alias("pos", "id")).withColumn("pos", F.col("pos").cast("bigint"))
    return J.lookup_vectors(ids, "id", V.embeddings(spark, sf), "vec_id", "embedding", vocab, _EMB_DIM)


@register(
    "A16_embedding_bag",
    with_views(
        f""", bag as ({_BAG_SQL}), ex as (select l_orderkey, unnest(items) id from bag),
v as (select ex.l_orderkey, unnest(range(0, {_EMB_DIM})) d, unnest(coalesce(e.embedding, {_ZERO_SQL})) x
      from ex left join embeddings e on e.vec_id = ex.id where ex.id > 0),
m as (select l_orderkey, list(round(mx, 6) + 0.0 order by d) bag from (select l_orderkey, d, avg(cast(x as double)) mx from v group by 1, 2) group by 1)
select b.l_orderkey, coalesce(m.bag, list_resize(cast([] as double[]), {_EMB_DIM}, 0.0)) bag from v_basket b left join m using (l_orderkey)""",
        "v_basket",
    ),
)
def q_bag(spark, sf):
    bags, vocab = _bags(spark, sf)
    out = J.embedding_bag_mean(bags, "l_orderkey", "items", V.embeddings(spark, sf), "vec_id", "embedding", vocab, _EMB_DIM)
    # adding zero: a small negative mean rounds to zero, not to minus zero
    return out.withColumn("bag", F.transform("bag", lambda x: F.round(x, 6) + F.lit(0.0)))


def _codebook(spark, sf):
    e = V.embeddings(spark, sf)
    return e.where(F.col("vec_id") < 16)


register(
    "J5_nearest_codebook",
    """select vec_id, arg_min(cv, struct_pack(d := d2, i := cv)) code, round(min(d2), 6) d2 from (
  select e.vec_id, c.vec_id cv,
         list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda z: pow(cast(z[1] as double) - cast(z[2] as double), 2))) d2
  from embeddings e, (select * from embeddings where vec_id < 16) c) group by vec_id""",
)(lambda spark, sf: J.nearest_code(V.embeddings(spark, sf), "vec_id", "embedding", _codebook(spark, sf), "vec_id", "embedding")
  .select("vec_id", "code", _r6(F.col("d2")).alias("d2")))

register(
    "J5_vq_losses",
    """select round(avg(d2 / 64), 6) codebook_loss, round(avg(d2 / 64) * 0.25, 6) commitment_loss, round(avg(d2 / 64) * 1.25, 6) vq_loss from (
  select vec_id, min(list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda z: pow(cast(z[1] as double) - cast(z[2] as double), 2)))) d2
  from embeddings e, (select embedding from embeddings where vec_id < 16) c group by vec_id)""",
)(lambda spark, sf: J.vq_losses(J.nearest_code(V.embeddings(spark, sf), "vec_id", "embedding", _codebook(spark, sf), "vec_id", "embedding"), 64)
  .select(*[_r6(F.col(c)).alias(c) for c in ["codebook_loss", "commitment_loss", "vq_loss"]]))

register(
    "J7_keyed_xy_join",
    with_views("select id, f1, f2, cast(label_type - 1 as bigint) y from v_features", "v_features"),
)(lambda spark, sf: V.v_features(spark, sf).select("id", "f1", "f2", S.label_shift("label_type").alias("y")))

register(
    "J9_S11_coverage_check",
    """select (select count(*) from (select distinct user_id from events where event_type = 'purchase') t
           where user_id not in (select user_id from events where value >= 10)) n_missing,
          (select count(*) from (select distinct user_id from events where value >= 10) p
           where user_id not in (select user_id from events where event_type = 'purchase')) n_extra""",
)(lambda spark, sf: J.coverage(
    V.read_table(spark, sf, "events").where(F.col("value") >= 10).select("user_id").distinct(),
    V.read_table(spark, sf, "events").where(F.col("event_type") == "purchase").select("user_id").distinct(), "user_id"))


# ---------------------------------------------------------------- split family

register(
    "R3_stratified_kfold",
    with_views(
        f"""select sample_id, label_type, cast(floor(((rk + 1) * 5 - 1) / n) as int) fold
from ({_rank_sql('v_interactions', 'sample_id', 'label_type', 'fold')})""",
        "v_interactions",
    ),
)(lambda spark, sf: R.stratified_kfold(V.v_interactions(spark, sf).select("sample_id", "label_type"), "sample_id", "label_type", 5))

_BLOCK_ROWS = 500


def _event_blocks(spark, sf, block_rows=_BLOCK_ROWS):
    """Events with their block's ordinal in file-name order, and the number of blocks."""
    from tessera.sources.tables import block_table, read_parquet_dir, with_block_ordinal
    e = read_parquet_dir(spark, f"{sf}/events.parquet").select("event_id", "_file", "_row")
    table = block_table(e, block_rows)
    return with_block_ordinal(e, block_rows, table), table.count()


def _tail_sql(block_rows: int, valid_ratio: float, train_ratio: float, legacy: bool) -> str:
    # n_blocks known only at run time: computed in SQL the same way.
    return f"""with b as (select event_id, event_id // {block_rows} block from events),
n as (select count(distinct block) nb from b),
k as (select nb, case when {valid_ratio!r} <= 0 then 0 else greatest(1, cast(floor(nb * {valid_ratio!r}) as bigint)) end nv from n),
k2 as (select nb, nv, nb - nv nt, case when {train_ratio!r} < 1.0 then greatest(1, cast(floor((nb - nv) * {train_ratio!r}) as bigint)) else nb - nv end keep from k)
select event_id, block, part from (
  select event_id, block, case when block >= {'keep' if legacy else 'nt'} then 'valid' when block < keep then 'train' end part from b, k2)
where part is not null"""


def _tail(spark, sf, valid_ratio, train_ratio, legacy, block_rows=_BLOCK_ROWS):
    e, nb = _event_blocks(spark, sf, block_rows)
    return R.tail_split(e, "block", nb, valid_ratio, train_ratio, legacy).select("event_id", "block", "part")


register("R4_R5_tail_split", _tail_sql(_BLOCK_ROWS, 0.1, 0.5, False))(lambda spark, sf: _tail(spark, sf, 0.1, 0.5, False))
register("R5_tail_split_legacy", _tail_sql(_BLOCK_ROWS, 0.1, 0.5, True))(lambda spark, sf: _tail(spark, sf, 0.1, 0.5, True))
register("R6_single_block", _tail_sql(10 ** 9, 0.0001, 1.0, False))(lambda spark, sf: _tail(spark, sf, 0.0001, 1.0, False, 10 ** 9))

register(
    "R7_shard",
    f"select event_id, cast((event_id // {_BLOCK_ROWS}) % 4 as int) rank, cast(((event_id // {_BLOCK_ROWS}) // 4) % 2 as int) worker from events",
)(lambda spark, sf: R.shard(_event_blocks(spark, sf)[0], "block", 4, 2).select("event_id", "rank", "worker"))

register(
    "R8_windowed_shuffle",
    f"""select event_id, shuffle_window, shuffle_key, (row_number() over (partition by shuffle_window order by shuffle_key, event_id) - 1) // 64 batch
from (select event_id, cast((event_id // {_BLOCK_ROWS}) // 4 as bigint) shuffle_window, {hash32_sql(SqlExpr('event_id'), 'shuffle', '42')} shuffle_key from events)""",
)(lambda spark, sf: R.cut_batches(R.windowed_shuffle(_event_blocks(spark, sf)[0], "block", "event_id", 4), "event_id", 64)
  .select("event_id", "shuffle_window", "shuffle_key", "batch"))

register(
    "R9_batch_ids",
    f"select event_id, event_id // {_BLOCK_ROWS} block, cast((event_id % {_BLOCK_ROWS}) // 64 as bigint) batch from events",
)(lambda spark, sf: R.batch_ids(_event_blocks(spark, sf)[0], "_pos", 64).select("event_id", "block", "batch"))

register(
    "R9_batch_count",
    f"select cast(sum(ceil(n / 64)) as bigint) n_batches from (select event_id // {_BLOCK_ROWS} b, count(*) n from events group by 1)",
)(lambda spark, sf: R.batch_count(_event_blocks(spark, sf)[0].groupBy("block").agg(F.count(F.lit(1)).alias("rows")), "rows", 64))

register(
    "R10_seeded_draws",
    f"select event_id, {uniform_sql(SqlExpr('event_id'), 'draw', '42')} u42, {uniform_sql(SqlExpr('event_id'), 'draw', '43')} u43 from events",
)(lambda spark, sf: V.read_table(spark, sf, "events").select(
    "event_id", RD_uniform(F.col("event_id"), "draw", 42).alias("u42"), RD_uniform(F.col("event_id"), "draw", 43).alias("u43")))

from tessera.functions.rand import uniform as RD_uniform  # noqa: E402


# ---------------------------------------------------------------- sources

from tessera.sources import tables as T_  # noqa: E402

register("S1_read_table", "select * from orders")(lambda spark, sf: T_.read_table(spark, sf, "orders"))

register("S2_read_dir_ordered", "select o_orderkey, 'orders.parquet' _file, o_orderkey _row from orders")(
    lambda spark, sf: T_.read_parquet_dir(spark, f"{sf}/orders.parquet").select("o_orderkey", "_file", "_row"))

register(
    "S3_block_listing",
    f"select 'events.parquet' \"file\", event_id // {_BLOCK_ROWS} block_in_file, count(*) \"rows\" from events group by 2",
)(lambda spark, sf: T_.blocks(T_.read_parquet_dir(spark, f"{sf}/events.parquet"), _BLOCK_ROWS).select(
    F.col("_file").alias("file"), F.col("block_in_file").cast("bigint").alias("block_in_file"), "rows"))

register(
    "S4_family_projection",
    with_views("select sample_id, user_int_feats_1, user_int_feats_3, user_int_feats_15, item_int_feats_5, item_int_feats_11 from v_wide", "v_wide"),
)(lambda spark, sf: T_.select_family(V.v_wide(spark, sf), ["user_int_feats_", "item_int_feats_"], keep=["sample_id"]))


# ---------------------------------------------------------------- ML features, fits, scoring (F, I, S5-S10)

from tessera.operators import boosting as BO  # noqa: E402
from tessera.operators import models as ML  # noqa: E402
from tessera.operators import newton as NW  # noqa: E402
from tessera.sources import sinks as SK  # noqa: E402


def _f3_sql() -> str:
    def mean_int(c):
        return f"coalesce(cast(list_sum({c}) as double) / nullif(len({c}), 0), 0.0)"

    cols = [
        "sample_id",
        "cast(dense_rank() over (order by cast(user_id as varchar)) - 1 as bigint) user_id",
        "cast(dense_rank() over (order by cast(item_id as varchar)) - 1 as bigint) item_id",
        "label_type", "label_time",
        "coalesce(user_int_feats_1, 0) user_int_feats_1", "coalesce(user_int_feats_3, 0) user_int_feats_3",
        f"{mean_int('user_int_feats_15')} user_int_feats_15_mean",
        "round(coalesce(list_sum(list_transform(user_dense_feats_61, lambda v: cast(v as double))) / nullif(len(user_dense_feats_61), 0), 0.0), 6) user_dense_feats_61_mean",
        "coalesce(item_int_feats_5, 0) item_int_feats_5",
        f"{mean_int('item_int_feats_11')} item_int_feats_11_mean",
    ]
    for c in ["domain_a_seq_38", "domain_a_seq_39", "domain_a_seq_40", "domain_b_seq_70", "domain_b_seq_71"]:
        cols += [f"{D.length(c)} {c}_len", f"{mean_int(c)} {c}_mean", f"cast(coalesce(list_max({c}), 0) as bigint) {c}_max"]
    cols += ["cast(((label_time % 86400) + 86400) % 86400 // 3600 as int) label_time_hour",
             "cast((((label_time // 86400) + 3) % 7 + 7) % 7 as int) label_time_dayofweek"]
    return "select " + ", ".join(cols) + " from v_wide"


@register("F3_ml_feature_table", with_views(_f3_sql(), "v_wide"))
def q_features_ml(spark, sf):
    f = ML.features_ml(V.v_wide(spark, sf))
    return f.withColumn("user_dense_feats_61_mean", _r6(F.col("user_dense_feats_61_mean")))


def _anova_sql(cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' feature, round(((sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2)) / (count(*) - 1))
  / (sum(coalesce((n - 1) * v, 0)) / (sum(n) - count(*))), 6) f_score
from (select label_type, count({c}) n, avg({c}) m, var_samp({c}) v from v_features group by 1)""")
    return "\nunion all\n".join(parts)


register("F4_anova_f_scores", with_views(_anova_sql(["f1", "f2", "f3", "f4"]), "v_features"))(
    lambda spark, sf: ML.anova_f(V.v_features(spark, sf, with_id=False), ["f1", "f2", "f3", "f4"], "label_type").withColumn("f_score", _r6(F.col("f_score"))))


#: Rows of a partition of the training frame: what a task of a fit reads and
#: caches, whatever the size of the table.
TRAIN_ROWS = 100_000


def _train_frame(spark, sf):
    """The F3 feature table with label, exact split, and weights from train
    alone; pinned, as fits and checks read it many times. The features are
    pinned before the split, whose passes would each make them again."""
    from tessera.session import materialize
    f = ML.features_ml(V.v_wide(spark, sf), V.v_interactions(spark, sf))
    features = [c for c in f.columns if c not in ("sample_id", "label_type", "label_time")]
    f = f.select("sample_id", "user_id", S.label_shift("label_type").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x_{c}") for c in features])
    parts = max(spark.sparkContext.defaultParallelism, -(-V.read_table(spark, sf, "orders").count() // TRAIN_ROWS))
    f = materialize(f.repartition(parts, "sample_id"))
    sp = R.stratified_split(f, "sample_id", "y", 0.2, 0.1, 42)
    return materialize(ML.with_balanced_weight(sp, "y", fit_on=sp.where("split = 'train'"))), [f"x_{c}" for c in features]


@register("F4_select_top_k")
def q_select(spark, sf):
    f = V.v_features(spark, sf).withColumn("y", S.label_shift("label_type").cast("double")).fillna(0.0, subset=FEAT_COLS)
    tr = R.stratified_split(f, "id", "y", 0.2, 0.1, 42).where("split = 'train'")
    chosen = ML.select_top_k(tr, FEAT_COLS, "y", 2)
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


def _fit_lr(spark, sf):
    d, features = _train_frame(spark, sf)
    tr = d.where("split = 'train'")
    w = tr.agg(F.sum("weight")).first()[0]
    return d, features, ML.logistic_regression(features, "y", 1.0, w).fit(tr)


# Facts of a fit that DuckDB can state: rows (fact, n, ok).

_FACTS = "fact string, n long, ok boolean"


def _fact(df, name, n=None, ok=None):
    """One row from an aggregate over ``df``: a count and a check."""
    return df.agg(F.lit(name).alias("fact"), (F.count(F.lit(1)) if n is None else n).cast("long").alias("n"), (F.lit(True) if ok is None else ok).alias("ok"))


def _split_facts(scored):
    """Rows of each split, all with a probability, and the class that follows from it."""
    ok = F.min((F.col("prob") >= 0) & (F.col("prob") <= 1) & ((F.col("prob") > 0.5).cast("int") == F.col("pred")))
    return scored.groupBy(F.concat(F.lit("rows "), F.col("split")).alias("fact")).agg(F.count(F.lit(1)).alias("n"), ok.alias("ok"))


def _better_than_rate(scored, weight="weight"):
    """Whether the weighted training logloss is below that of the constant rate."""
    t = scored.where("split = 'train'")
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    w = F.col(weight)
    rate = F.sum(w * F.col("y")) / F.sum(w)
    return _fact(t, "training loss below the constant rate's", ok=F.sum(w * loss) / F.sum(w) < -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate)))


_SPLIT_SIZES_SQL = f"""{SPLIT_SQL_CORE.strip()},
facts as (select 'rows ' || split fact, count(*) n, true ok from sp group by 1)"""
_TRAIN_SQL = "select 'training loss below the constant rate''s', count(*), true from sp where split = 'train'"


def _facts_sql(*more: str) -> str:
    return with_views(f", {_SPLIT_SIZES_SQL}\nselect * from facts" + "".join(f"\nunion all {m}" for m in more), "v_interactions")


_N_FEATURES = 25  # of the wide fixture's F3 table, without ids of rows and labels


@register("F5_F8_lr_fit_score", _facts_sql(_TRAIN_SQL, f"select 'gradient near zero', {_N_FEATURES} + 1, true"))
def q_lr(spark, sf):
    d, features, model = _fit_lr(spark, sf)
    s = ML.score(model, d, d.columns)
    g = ML.penalised_gradient(s.where("split = 'train'"), model, features, "y", "weight")
    return _split_facts(s).unionByName(_better_than_rate(s)).unionByName(_fact(g, "gradient near zero", ok=F.max(F.abs("gradient")) < 5e-3))


def _rank_auc(s):
    """One row (split, auc) by the rank-sum formula, without the curve operators."""
    r = s.withColumn("r", F.rank().over(Window.partitionBy("split").orderBy("prob"))).withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("split", "prob")))
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    ranks = F.sum(F.col("y") * (F.col("r") + (F.col("ties") - 1) / 2))
    return r.groupBy("split").agg(((ranks - pos * (pos + 1) / 2) / (pos * neg)).alias("rank_auc"))


@register("F6_gbt_fit_score", _facts_sql(_TRAIN_SQL, "select 'training loss falls with the trees', 100, true"))
def q_gbt(spark, sf):
    d, features = _train_frame(spark, sf)
    train = d.where("split = 'train'")
    model = ML.gbt(features, "y").fit(train)
    s = ML.score(model, d, ["split", "y"]).withColumn("weight", F.lit(1.0))
    grown = model.stages[-1]
    loss = grown.evaluateEachIteration(model.stages[0].transform(train))
    falls = all(a > b for a, b in zip(loss[::25], [*loss[25::25], loss[-1]]))
    fact = spark.createDataFrame([("training loss falls with the trees", len(loss), falls)], _FACTS)
    return _split_facts(s).unionByName(_better_than_rate(s)).unionByName(fact)


@register(
    "F7_leafwise_boosting",
    _facts_sql(
        _TRAIN_SQL,
        "select 'trees of 2 to 31 leaves', 1, true", "select 'training loss falls every round', 1, true", "select 'stop round of the tracker', 1, true",
        "select 'validation loss of the written scores', count(*), true from sp where split = 'val'",
        "select 'training auc by ranks', count(*), true from sp where split = 'train'", f"select 'features with a gain', {_N_FEATURES}, true",
    ),
)
def q_leafwise(spark, sf):
    """31 leaves, balanced weights, patience 10 on the validation loss."""
    d, features = _train_frame(spark, sf)
    m = BO.fit_leafwise(d.where("split <> 'test'").withColumn("held", F.col("split") == "val"), features, "y", "weight", "held", max_iter=24)
    path = SK.scratch_path(spark, "leafwise-scores")
    m.score(d, ["split", "y", "weight"]).write.parquet(path)
    s = spark.read.parquet(path)
    w, p = F.col("weight"), F.col("prob")
    loss = F.sum(w * -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))) / F.sum(w)
    (t,) = W.early_stopping(m.history_table(spark), "run_id", "step", "val_loss", patience=10, min_delta=0.0, mode="min").collect()
    train = [h[1] for h in m.history]
    checks = [
        ("trees of 2 to 31 leaves", all(2 <= x.leaves <= 31 for x in m.trees)),
        ("training loss falls every round", all(a > b for a, b in zip(train, train[1:]))),
        ("stop round of the tracker", (t["best_step"], t["stop_step"]) == (m.best, m.stopped)),
    ]
    ranks = _rank_auc(s.where("split = 'train'"))
    curve = M.auc(s.where("split = 'train'").withColumn("label", F.col("y").cast("int")), "split")
    auc = s.where("split = 'train'").join(F.broadcast(ranks.join(curve, "split")), "split")
    return (
        _split_facts(s).unionByName(_better_than_rate(s)).unionByName(spark.createDataFrame([(f, 1, ok) for f, ok in checks], _FACTS))
        .unionByName(_fact(s.where("split = 'val'"), "validation loss of the written scores", ok=F.abs(loss - F.lit(m.history[m.best - 1][2])) < 1e-6))
        .unionByName(_fact(auc, "training auc by ranks", ok=(F.max(F.abs(F.col("auc") - F.col("rank_auc"))) < 1e-9) & (F.min("auc") > 0.55)))
        .unionByName(_fact(m.importance(spark), "features with a gain", ok=F.min(F.col("importance") >= 0) & (F.max("importance") > 0)))
    )


@register("F7_gbt_weighted_early_stop", _facts_sql(_TRAIN_SQL))
def q_lgbm(spark, sf):
    d, features = _train_frame(spark, sf)
    d = d.withColumn("is_val", F.col("split") == "val")
    model = ML.gbt(features, "y", max_iter=100, depth=5, subsample=1.0, colsample=1.0, weight="weight", validation="is_val").fit(
        d.where("split in ('train', 'val')"))
    s = ML.score(model, d, ["split", "y", "weight"])
    return _split_facts(s).unionByName(_better_than_rate(s))


@register("F9_S9_importance_csv", f"select 'coefficients' fact, {_N_FEATURES} n, true ok union all select 'in descending order', {_N_FEATURES}, true")
def q_importance(spark, sf):
    _, features, model = _fit_lr(spark, sf)
    path = SK.scratch_path(spark, "importance")
    SK.write_importance_csv(ML.importance(model, features), path)
    back = spark.read.option("header", True).schema("feature string, value double, importance double").csv(path)
    known = back.join(spark.createDataFrame([(f, float(c)) for f, c in zip(features, model.stages[-1].coefficients.toArray())], "feature string, c double"), "feature")
    order = back.withColumn("at", F.monotonically_increasing_id())
    before = F.lag("importance").over(Window.orderBy("at"))  # one row a feature
    return _fact(known, "coefficients", ok=F.max(F.abs(F.col("value") - F.col("c"))) + F.max(F.abs(F.col("importance") - F.abs("c"))) == 0).unionByName(
        _fact(order.withColumn("down", F.coalesce(before >= F.col("importance"), F.lit(True))), "in descending order", ok=F.min("down")))


@register("F10_M10_evaluate_by_split", with_views(f", {_SPLIT_SIZES_SQL}\nselect fact, n, ok from facts", "v_interactions"))
def q_evaluate(spark, sf):
    d, _, model = _fit_lr(spark, sf)
    s = ML.score(model, d, ["split", "y"]).withColumn("label", F.col("y").cast("int"))
    m = M.metric_table(s, "split", "label", "prob")
    plain = s.groupBy(F.col("split").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("acc"))
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-15)), F.lit(1e-15))
    losses = s.groupBy("split").agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("ll"))
    m = m.join(_rank_auc(s), "split").join(losses, "split")
    ok = (F.abs(F.col("auc") - F.col("rank_auc")) < 1e-9) & (F.abs(F.col("logloss") - F.col("ll")) < 1e-9) & (F.abs(F.col("accuracy") - F.col("acc")) < 1e-12)
    return m.join(plain, F.col("split") == F.col("s")).select(F.concat(F.lit("rows "), F.col("split")).alias("fact"), "n", ok.alias("ok"))


@register("F11_kmeans_codebook_assign", "select 'assigned to the nearest centre' fact, count(*) n, true ok from embeddings union all select 'centres', 16, true")
def q_kmeans(spark, sf):
    e = V.embeddings(spark, sf)
    book = ML.kmeans_codebook(e, "embedding", k=16)
    got = J.nearest_code(e, "vec_id", "embedding", book, "code", "center")
    # every distance to every centre, 16 a vector, the plain way
    d2 = F.aggregate(F.zip_with(F.col("embedding"), F.col("center"), lambda a, b: F.pow(a.cast("double") - b, 2)), F.lit(0.0), lambda s, v: s + v)
    least = e.join(F.broadcast(book)).groupBy("vec_id").agg(F.min(d2).alias("least"))
    near = _fact(got.join(least, "vec_id"), "assigned to the nearest centre", ok=F.max(F.abs(F.col("d2") - F.col("least"))) < 1e-9)
    return near.unionByName(_fact(book, "centres"))


@register("S10_model_roundtrip", with_views(f", {SPLIT_SQL_CORE.strip()}\nselect 'equal scores after reload' fact, count(*) n, true ok from sp", "v_interactions"))
def q_model_roundtrip(spark, sf):
    d, _, model = _fit_lr(spark, sf)
    path = SK.scratch_path(spark, "lr-model")
    SK.save_model(model, path)
    a, b = (ML.score(m, d, ["sample_id"]).withColumnRenamed("prob", p) for m, p in ((model, "a"), (SK.load_model(path), "b")))
    return _fact(a.join(b, "sample_id"), "equal scores after reload", ok=F.max(F.abs(F.col("a") - F.col("b"))) == 0)


@register(
    "R3_cross_validation",
    with_views(
        f"""select cast(floor(((rk + 1) * 5 - 1) / n) as int) fold, any_value(total) - count(*) n_train, count(*) n_test, true ok
from (select *, count(*) over () total from ({_rank_sql('(select sample_id, cast(label_type - 1 as double) y from v_interactions)', 'sample_id', 'y', 'fold')})) group by 1
union all select -1, 5, 3, true""",
        "v_interactions",
    ),
)
def q_cv(spark, sf):
    """Fold sizes, metric ranges, and in the last row the summary checked against the folds."""
    d, features = _train_frame(spark, sf)
    folds = ML.cross_validate(d.drop("split", "weight"), "sample_id", "y", features, 5)
    ok = (F.col("auc") >= 0) & (F.col("auc") <= 1) & (F.col("logloss") > 0) & (F.col("accuracy") >= 0) & (F.col("accuracy") <= 1)
    s = ML.cv_summary(folds)
    plain = folds.agg(F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s"))
    summary = s.crossJoin(F.broadcast(plain)).agg(
        F.lit(-1).alias("fold"), F.max("folds").alias("n_train"), F.count(F.lit(1)).alias("n_test"),
        F.max(F.when(F.col("metric") == "auc", (F.abs(F.col("mean") - F.col("m")) < 1e-12) & (F.abs(F.col("std") - F.col("s")) < 1e-12))).alias("ok"))
    return folds.select("fold", "n_train", "n_test", ok.alias("ok")).unionByName(summary)


_CV_SQL = f"""select cast(floor(((rk + 1) * 5 - 1) / n) as int) fold, any_value(total) - count(*) n_train, count(*) n_test, true ok
from (select *, count(*) over () total from ({_rank_sql('(select sample_id, cast(label_type - 1 as double) y from v_interactions)', 'sample_id', 'y', 'fold')})) group by 1"""


@register("R3_cross_validation_at_once", with_views(_CV_SQL, "v_interactions"))
def q_cv_at_once(spark, sf):
    """All folds' fits in one pass a Newton step: each fold's metrics against
    those of the scores as written, and the optimum of every model."""
    from tessera.session import materialize
    d, features = _train_frame(spark, sf)
    folded = materialize(R.stratified_kfold(d.select("sample_id", "y", *features), "sample_id", "y", 5))
    models = NW.fit_folds(folded, "fold", "y", features, 5)
    path = SK.scratch_path(spark, "fold-scores")
    models.score(folded, "fold", ["fold", "y"]).write.parquet(path)
    s = spark.read.parquet(path).withColumn("label", F.col("y").cast("int"))
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-15)), F.lit(1e-15))
    plain = s.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("ll"), F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("acc"))
    ranks = _rank_auc(s.withColumnRenamed("fold", "split")).withColumnRenamed("split", "fold")
    got = ML.cross_validate(d.drop("split", "weight"), "sample_id", "y", features, 5).join(plain, "fold").join(ranks, "fold")
    ok = (F.abs(F.col("auc") - F.col("rank_auc")) < 1e-9) & (F.abs(F.col("logloss") - F.col("ll")) < 1e-9) & (F.abs(F.col("accuracy") - F.col("acc")) < 1e-9)
    return got.select("fold", "n_train", "n_test", (ok & (F.col("rows") == F.col("n_test")) & F.lit(models.gradient < 1e-9)).alias("ok"))


@register("S5_S6_schema_sidecar_roundtrip")
def q_sidecar(spark, sf):
    schema = C.schema_dict(_inferred(spark, sf))
    path = SK.scratch_path(spark, "schema-json")
    SK.write_json_sidecar(spark, schema, path)
    return SK.schema_catalog(SK.read_json_sidecar(spark, path))


@register("S5_feature_groups_sidecar", with_views(_groups_sql(), "v_wide"))
def q_groups_sidecar(spark, sf):
    """The groups as written to and parsed from their sidecar, then applied."""
    path = SK.scratch_path(spark, "groups-json")
    SK.write_json_sidecar(spark, FEATURE_GROUPS, path)
    groups = SK.parse_groups(SK.read_json_sidecar(spark, path))
    return EN.feature_groups(V.v_wide(spark, sf), "user_int_feats_", _encode_schema(spark, sf)["user_int"], groups)


@register("S8_results_write")
def q_results(spark, sf):
    m = M.metric_table(_scored(spark, sf), "split")
    long = m.select("split", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in ["auc", "logloss", "accuracy"]])))
    path = SK.scratch_path(spark, "results")
    SK.write_results(long, path)
    return spark.read.json(path)


_PRED_SQL = "select user_id, arg_max(round(value / (value + 50.0), 3), event_id) prob from events group by 1"


def _event_predictions(spark, sf):
    e = V.read_table(spark, sf, "events").withColumn("prob", F.round(F.col("value") / (F.col("value") + F.lit(50.0)), 3))
    return SK.dedupe_predictions(e, "user_id", "prob", "event_id")


@register("S7_predictions_last_wins", _PRED_SQL)
def q_predictions(spark, sf):
    """Last write wins per user, written as JSON lines and read back."""
    path = SK.scratch_path(spark, "predictions")
    SK.write_predictions(_event_predictions(spark, sf), path)
    return spark.read.schema("user_id long, prob double").json(path)


# expected users: the customers, whoever has events
register(
    "I3_prediction_checks",
    f"""select (select count(*) from ({_PRED_SQL}) p where prob is null or isnan(prob) or prob < 0 or prob > 1) n_bad_prob,
  (select count(*) from customer where c_custkey not in (select user_id from ({_PRED_SQL}))) n_missing,
  (select count(*) from ({_PRED_SQL}) p where user_id not in (select c_custkey from customer)) n_extra""",
)(lambda spark, sf: (lambda p: SK.probability_range_ok(p, "prob").crossJoin(
    J.coverage(p, V.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")))(_event_predictions(spark, sf)))

register(
    "I1_inference_encode",
    with_views(_encode_sql().replace("cast(coalesce(label_type, 0) = 2 as bigint) label", "cast(0 as bigint) label"), "v_wide"),
)(lambda spark, sf: EN.encode_batch(V.v_wide(spark, sf), _encode_schema(spark, sf), ENCODE_MAX_LENS, is_training=False))


@register(
    "I2_score_users",
    with_views(
        """select 'users written' fact, count(distinct user_id) n, true ok from v_interactions
union all select 'expected users without a score', (select count(*) from customer where c_custkey not in (select user_id from v_interactions)), true
union all select 'scores of unknown users', (select count(distinct user_id) from v_interactions where user_id not in (select c_custkey from customer)), true""",
        "v_interactions",
    ),
)
def q_score_users(spark, sf):
    """Score every row, keep the last row's probability of each user, check
    the users against the expected ones, and write the file."""
    d, _, model = _fit_lr(spark, sf)
    users = V.v_interactions(spark, sf).select("sample_id", F.col("user_id").alias("user"))
    scored = ML.score(model, d, ["sample_id"]).join(users, "sample_id").select("sample_id", F.col("user").alias("user_id"), "prob")
    path = SK.scratch_path(spark, "predictions")
    SK.write_predictions(SK.dedupe_predictions(scored, "user_id", "prob", "sample_id"), path)
    back = spark.read.schema("user_id long, prob double").json(path)
    c = J.coverage(back, V.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")
    last = scored.groupBy("user_id").agg(F.max_by("prob", "sample_id").alias("p"))
    return _fact(back.join(last, "user_id"), "users written", ok=F.max(F.abs(F.col("prob") - F.col("p"))) < 1e-12).unionByName(
        c.select(F.inline(F.array(
            F.struct(F.lit("expected users without a score").alias("fact"), F.col("n_missing").alias("n"), F.lit(True).alias("ok")),
            F.struct(F.lit("scores of unknown users").alias("fact"), F.col("n_extra").alias("n"), F.lit(True).alias("ok"))))))


# ---------------------------------------------------------------- streaming (additions)

from tessera.streaming import stream as ST  # noqa: E402

register("ST_stream_event_counts", "select event_type, count(*) n from events group by 1")(
    lambda spark, sf: ST.category_counts_stream(spark, sf, "events", "event_type"))


# ---------------------------------------------------------------- union

register(
    "U1_union_all",
    with_views(
        """select id, f1, 0 copy from v_features
union all
select id, round(f1 * 2.0, 6), 1 from v_features""",
        "v_features",
    ),
)(lambda spark, sf: (lambda f: W.union_all([f.select("id", "f1", F.lit(0).alias("copy")),
                                            f.select("id", _r6(F.col("f1") * 2.0).alias("f1"), F.lit(1).alias("copy"))]))(
    V.v_features(spark, sf)))


# ---------------------------------------------------------------- exact kNN (J6) and SMOTE
# Their DuckDB oracles (below) compare all pairs of the minority class;
# tests/test_knn.py checks both against numpy as well.

from tessera.operators import knn as KN  # noqa: E402
from tessera.operators import neighbours as NB  # noqa: E402


def _minority_features(spark, sf):
    f = V.v_features(spark, sf).fillna(0.0, subset=FEAT_COLS)
    return f.withColumn("y", S.label_shift("label_type"))


@register("J6_knn_minority")
def q_knn(spark, sf):
    m = _minority_features(spark, sf).where("y = 1")
    nn = KN.knn_self_join(m, "id", FEAT_COLS, k=5)
    return nn.select("id", F.transform("nbrs", lambda x: x["id"]).alias("nbr_ids"), _r6(F.col("nbrs")[4]["d"]).alias("d_k"))


@register("N12_smote")
def q_smote(spark, sf):
    f = _minority_features(spark, sf).select("id", *FEAT_COLS, "y")
    return KN.smote(f, "id", FEAT_COLS, "y", minority=1, ratio=1.0, k=5)

register(
    "ST_stream_vector_chunks",
    ORACLE["A17_vector_chunks"],
)(lambda spark, sf: ST.stream_transform_to_parquet(
    spark, sf, "embeddings", lambda b: b.select("vec_id", A.chunks("embedding", 5, 64).alias("chunks"))))


# ---------------------------------------------------------------- oracles for metadata / sidecar / results queries

ORACLE["C1_catalog"] = with_views(
    r"""select "column", family, fid, is_array, domain, ordinal from (
  select column_name "column",
    case when regexp_matches(column_name, '^user_int_feats_\d+$') then case when column_type like '%[]' then 'user_int_array' else 'user_int_scalar' end
         when regexp_matches(column_name, '^item_int_feats_\d+$') then case when column_type like '%[]' then 'item_int_array' else 'item_int_scalar' end
         when regexp_matches(column_name, '^user_dense_feats_\d+$') then 'user_dense'
         when regexp_matches(column_name, '^domain_[a-z]_seq_\d+$') then 'domain_' || regexp_extract(column_name, '^domain_([a-z])_', 1)
         when column_name in ('user_id', 'item_id', 'label_type', 'label_time', 'timestamp') then 'id_label' end family,
    case when regexp_matches(column_name, '_\d+$') and column_name not in ('user_id', 'item_id', 'label_type', 'label_time', 'timestamp')
         then cast(regexp_extract(column_name, '(\d+)$', 1) as int) else -1 end fid,
    column_type like '%[]' is_array,
    case when regexp_matches(column_name, '^domain_[a-z]_seq_\d+$') then 'seq_' || regexp_extract(column_name, '^domain_([a-z])_', 1) end domain,
    cast(row_number() over () - 1 as int) ordinal
  from (describe v_wide)) where family is not null""",
    "v_wide",
)

ORACLE["S5_S6_schema_sidecar_roundtrip"] = with_views(
    f""", {INFER_SQL}
select kind, cast(null as varchar) "domain", cast(fid as bigint) fid, vocab, dim from inferred where kind in ('user_int', 'item_int')
union all
select kind, null, cast(fid as bigint), cast(null as bigint), dim from inferred where kind = 'user_dense'
union all
select kind, domain, cast(fid as bigint), vocab, cast(null as bigint) from inferred where kind = 'seq'""",
    "v_wide",
)

ORACLE["S8_results_write"] = with_views(
    f""", {_AUC_SQL.strip()},
ll as (select split, avg({_LL_SQL}) logloss, avg(case when (prob >= 0.5) = (label = 1) then 1.0 else 0.0 end) accuracy
       from v_scored group by 1)
select split, metric, round(value, 6) value from (
  select split, 'auc' metric, auc value from auc
  union all select split, 'logloss', logloss from ll
  union all select split, 'accuracy', accuracy from ll)""",
    "v_scored",
)
_q_results_raw = QUERIES["S8_results_write"]
QUERIES["S8_results_write"] = lambda spark, sf: _q_results_raw(spark, sf).withColumn("value", _r6(F.col("value")))


def _train_sql() -> str:
    src = "(select id, coalesce(f1, 0.0) f1, coalesce(f2, 0.0) f2, coalesce(f3, 0.0) f3, coalesce(f4, 0.0) f4, cast(label_type - 1 as double) y from v_features)"
    return f"""tr as (select * from (
  select *, cast(floor(n*0.2+0.5) as bigint) nt from ({_rank_sql(src, 'id', 'y', 'split')})) s
  where rk >= nt + cast(floor((n - nt)*{0.1 / 0.8!r}+0.5) as bigint))"""


def _anova_train_sql(cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' feature, ((sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2)) / (count(*) - 1))
  / (sum(coalesce((n - 1) * v, 0)) / (sum(n) - count(*))) f_score
from (select y, count({c}) n, avg({c}) m, var_samp({c}) v from tr group by 1)""")
    return "\nunion all\n".join(parts)


ORACLE["F4_select_top_k"] = with_views(
    f""", {_train_sql()}
select feature from ({_anova_train_sql(FEAT_COLS)}) order by f_score desc limit 2""",
    "v_features",
)


# exact kNN / SMOTE oracles: brute force over all minority pairs with DuckDB's
# top-n min_by (about 6 s at sf0.01)
_KNN_CTES = """
f as (select id, coalesce(f1, 0.0) f1, coalesce(f2, 0.0) f2, coalesce(f3, 0.0) f3, coalesce(f4, 0.0) f4,
             cast(label_type - 1 as bigint) y from v_features),
m as (select * from f where y = 1),
nn as (select a.id, min_by(struct_pack(d := sqrt((a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2) + (a.f3-b.f3)*(a.f3-b.f3) + (a.f4-b.f4)*(a.f4-b.f4)), n := b.id),
                               struct_pack(d := sqrt((a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2) + (a.f3-b.f3)*(a.f3-b.f3) + (a.f4-b.f4)*(a.f4-b.f4)), n := b.id), 5) nbrs
       from m a, m b where a.id <> b.id group by a.id)"""

ORACLE["J6_knn_minority"] = with_views(
    f""", {_KNN_CTES.strip()}
select id, list_transform(nbrs, lambda s: s.n) nbr_ids, round(nbrs[5].d, 6) d_k from nn""",
    "v_features",
)

ORACLE["N12_smote"] = with_views(
    f""", {_KNN_CTES.strip()},
cnt as (select count(*) filter (where y = 1) n_min, count(*) filter (where y <> 1) n_maj from f),
ord as (select id, row_number() over (order by h, id) - 1 q from (select id, {hash32_sql(SqlExpr('id'), 'smote', '42')} h from m)),
reps as (select ord.id, (n_maj - n_min) // n_min + case when q < (n_maj - n_min) % n_min then 1 else 0 end r from ord, cnt),
syn as (select id, unnest(range(0, r)) t from reps where r > 0),
pick as (select syn.id, syn.t,
                nn.nbrs[cast(floor({uniform_sql(SqlExpr('syn.id'), 'smote:nn', '42', SqlExpr('syn.t'))} * len(nn.nbrs)) as int) + 1].n nb,
                {uniform_sql(SqlExpr('syn.id'), 'smote:gap', '42', SqlExpr('syn.t'))} gap
         from syn join nn on syn.id = nn.id)
select id, f1, f2, f3, f4, y, false synthetic, cast(null as int) t from f
union all
select p.id, x.f1 + p.gap * (b.f1 - x.f1), x.f2 + p.gap * (b.f2 - x.f2), x.f3 + p.gap * (b.f3 - x.f3), x.f4 + p.gap * (b.f4 - x.f4),
       cast(1 as bigint), true, cast(p.t as int)
from pick p join m x on x.id = p.id join m b on b.id = p.nb""",
    "v_features",
)


# ---------------------------------------------------------------- many dimensions (J6), many codes


def _wide_vectors(spark, sf):
    """200 dimensions from the 64 of an embedding: values, squares, products
    with the reversed vector, and the first eight again."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = V.embeddings(spark, sf).select("vec_id", e.alias("e"))
    mixed = F.concat("e", F.transform("e", lambda x: x * x), F.zip_with("e", F.reverse("e"), lambda a, b: a * b), F.slice("e", 1, 8))
    return v.select("vec_id", mixed.alias("x"))


@register("J6_knn_high_dimension", "select 'vectors' fact, count(*) n, true ok from embeddings union all select 'probes with a recall of 0.9 or more', count(*), true from embeddings where vec_id % 50 = 0")
def q_knn_forest(spark, sf):
    """10 neighbours in 200 dimensions; the recall of every 50th vector against
    brute force, beside the one that the operator measured itself."""
    v = _wide_vectors(spark, sf)
    # small cells, so that the test tables have many
    found, measured = NB.knn_forest(v, "vec_id", "x", k=10, cell_rows=512)
    asked = v.where("vec_id % 50 = 0").collect()  # at most a fiftieth of the vectors, as stated
    truth = NB.exact_probe(v.select("vec_id", "x"), [(r["vec_id"], r["x"]) for r in asked], 10)
    recall = NB.recall_of(found, truth, "vec_id")
    return _fact(found, "vectors", ok=F.max(F.size("nbrs")) <= 10).unionByName(
        spark.createDataFrame([("probes with a recall of 0.9 or more", len(truth), recall >= 0.9 and measured >= 0.9)], _FACTS))


register(
    "J5_nearest_code_pruned",
    """select vec_id, arg_min(cv, struct_pack(d := d2, i := cv)) code, round(min(d2), 6) d2 from (
  select e.vec_id, c.vec_id cv,
         list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda z: pow(cast(z[1] as double) - cast(z[2] as double), 2))) d2
  from embeddings e, (select * from embeddings where vec_id % 4 = 1) c) group by vec_id""",
)(lambda spark, sf: CO.nearest_code_pruned(V.embeddings(spark, sf), "vec_id", "embedding", V.embeddings(spark, sf).where("vec_id % 4 = 1"), "vec_id", "embedding")
  .select("vec_id", "code", _r6(F.col("d2")).alias("d2")))


# ---------------------------------------------------------------- online runs (W8, W3), merging profiles (G3, G4), external scorer

from tessera.operators import heavy as HV  # noqa: E402
from tessera.operators import scorer as SC  # noqa: E402
from tessera.operators import sketches as SS  # noqa: E402


def _run_files(spark, sf):
    """The metric history in four files, one after the other in steps."""
    path = SK.scratch_path(spark, "history")
    runs = V.v_runs(spark, sf)
    lo, hi = runs.agg(F.min("step"), F.max("step")).first()
    for i in range(4):
        a, z = (lo + (hi + 1 - lo) * k // 4 for k in (i, i + 1))
        runs.where((F.col("step") >= a) & (F.col("step") < z)).coalesce(1).write.mode("append").parquet(path)
    return path


register("ST_W8_early_stopping_online", _w8_sql(1e-4, 5, "max"))(
    lambda spark, sf: ST.track_run_files(spark, _run_files(spark, sf), "run_id", "step", "val_auc", patience=5, min_delta=1e-4, mode="max")
    .select("run_id", "best_value", "best_step", "stop_step"))

register(
    "ST_W3_top_k_online",
    f"""with v_runs as ({V.SQL['v_runs']})
select run_id, cast(r as int) place, cast(step as bigint) step, val_auc from (
  select *, row_number() over (partition by run_id order by val_auc desc, step) r from v_runs) where r <= 3""",
)(lambda spark, sf: ST.track_run_files(spark, _run_files(spark, sf), "run_id", "step", "val_auc", top_k=3)
  .select("run_id", F.posexplode(F.arrays_zip("kept_values", "kept_steps")).alias("place", "k"))
  .select("run_id", (F.col("place") + 1).alias("place"), F.col("k.kept_steps").alias("step"), F.col("k.kept_values").alias("val_auc")))

_SKETCHED = ["user_id", "event_type", "value", "event_id"]


@register(
    "G3_distinct_sketches",
    "\nunion all\n".join(f"select '{c}' fact, count(*) n, true ok from events" for c in _SKETCHED)
    + "\nunion all select 'files read: two, the two new ones, none', 3, true",
)
def q_sketches(spark, sf):
    """Distinct counts of a folder that grows, within four standard errors."""
    events = V.read_table(spark, sf, "events").select(*_SKETCHED)
    data, state = SK.scratch_path(spark, "events"), SK.scratch_path(spark, "sketches")
    parts = [events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1) for i in range(4)]
    read = []
    for more in (parts[:2], parts[2:], []):
        for x in more:
            x.write.mode("append").parquet(data)
        read.append(SS.refresh(spark, state, data, _SKETCHED))
    est = SS.report(spark, state, data, _SKETCHED)
    exact = G.distinct_counts(events, _SKETCHED).withColumnRenamed("n_distinct", "exact")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 4 * SS.relative_error() * F.col("exact") + 1
    facts = est.join(exact, "column").select(F.col("column").alias("fact"), F.col("rows").alias("n"), (near & (F.col("files") == 4)).alias("ok"))
    return facts.unionByName(spark.createDataFrame([("files read: two, the two new ones, none", 3, read == [2, 2, 0])], _FACTS))


register("G4_most_frequent", "select l_partkey, count(*) n from lineitem group by 1 order by n desc, l_partkey limit 20")(
    lambda spark, sf: HV.most_frequent(V.read_table(spark, sf, "lineitem"), "l_partkey", 20)[0])


def _load_linear(data: bytes):
    import numpy as np

    m = json.loads(data)
    return np.array(m["coefficients"]), m["intercept"]


def _predict_linear(model, x):
    import numpy as np

    return 1 / (1 + np.exp(-(x @ model[0] + model[1])))


@register("I2_external_scorer", with_views(f", {SPLIT_SQL_CORE.strip()}\nselect 'scores of a model from a file' fact, count(*) n, true ok from sp", "v_interactions"))
def q_external(spark, sf):
    """A scorer of its own, its model read from a file, against MLlib's scores."""
    d, features, model = _fit_lr(spark, sf)
    path = SK.scratch_path(spark, "scorer")
    lr = model.stages[-1]
    SK.write_json_sidecar(spark, {"coefficients": lr.coefficients.toArray().tolist(), "intercept": lr.intercept}, path)
    file = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").first()[0]
    scorer = SC.Scorer.read(spark, file, features, _load_linear, _predict_linear)
    both = SC.score_external(d, scorer, ["sample_id"], "mine").join(ML.score(model, d, ["sample_id"]), "sample_id")
    return _fact(both, "scores of a model from a file", ok=F.max(F.abs(F.col("mine") - F.col("prob"))) < 1e-12)


# ---------------------------------------------------------------- row groups from the footers

from tessera.sources import rowgroups as RG  # noqa: E402


#: Rows of a file that S3_R4_row_groups writes, and so of the task that writes it.
ORDERS_PER_FILE = 250_000


@register(
    "S3_R4_row_groups",
    """select 'rows of the row groups' fact, count(*) n, true ok from orders
union all select 'rows of the training and validation groups', count(*), true from orders
union all select 'orders of one customer through the row groups', count(*), true from orders where o_custkey = (select min(o_custkey) from orders)""",
)
def q_row_groups(spark, sf):
    """Orders written in small row groups, listed from the footers, split at the
    tail by row groups, and read back with a filter."""
    orders = V.read_table(spark, sf, "orders")
    path = SK.scratch_path(spark, "orders")
    files = max(3, -(-orders.count() // ORDERS_PER_FILE))
    orders.repartitionByRange(files, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("parquet.block.size", str(1 << 16)).option("parquet.block.size.row.check.min", "100").parquet(path)
    from tessera.session import materialize
    blocks = materialize(RG.row_groups(spark, path))
    n = blocks.count()
    cut = n - max(1, int(n * 0.1))
    train, val = (RG.read_row_groups(spark, path, blocks.where(part), ["o_orderkey", "o_custkey"]) for part in (f"block < {cut}", f"block >= {cut}"))
    both = train.select(F.lit(0).alias("held"), "o_orderkey", "_block").unionByName(val.select(F.lit(1).alias("held"), "o_orderkey", "_block"))
    per = both.groupBy("_block").agg(F.count(F.lit(1)).alias("got"), F.max("held").alias("held")).join(blocks, F.col("_block") == F.col("block"), "full")
    first = orders.agg(F.min("o_custkey")).first()[0]
    one = RG.read_row_groups(spark, path, blocks).where(F.col("o_custkey") == first)
    same = one.join(orders.where(F.col("o_custkey") == first).select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], "left_semi")
    return (
        _fact(blocks, "rows of the row groups", n=F.sum("rows"), ok=F.count(F.lit(1)) >= 3)
        .unionByName(_fact(per, "rows of the training and validation groups", n=F.sum("got"), ok=F.min((F.col("got") == F.col("rows")) & (F.col("held") == (F.col("block") >= cut).cast("int")))))
        .unionByName(_fact(same, "orders of one customer through the row groups"))
    )


# ---------------------------------------------------------------- encode and count as a stream


#: Most rows of a file of the streamed table.
FILE_ROWS = 100_000


def _encoded_stream(spark, sf, is_training=False):
    """The wide rows written as files, three at least, by the tasks that made
    them, and encoded as a stream in about three micro-batches."""
    path = SK.scratch_path(spark, "wide")
    rows = V.read_table(spark, sf, "orders").count()
    V.v_wide(spark, sf).write.option("maxRecordsPerFile", max(1, min(FILE_ROWS, rows // 3))).parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return ST.encode_stream(spark, path, _encode_schema(spark, sf), ENCODE_MAX_LENS, is_training=is_training, max_files=-(-files // 3))


register("ST_encode_stream", ORACLE["A10_A13_encode_batch"])(
    lambda spark, sf: _encoded_stream(spark, sf, is_training=True)[0])
register("ST_G15_oob_over_batches", ORACLE["G15_oob_stats"])(
    lambda spark, sf: _encoded_stream(spark, sf)[1])


def _forest_of_features(df, id_col, cols, k):
    return NB.knn_forest(df.select(id_col, F.array(*[F.col(c).cast("double") for c in cols]).alias("x")), id_col, "x", k, target_recall=0.97)[0]


@register(
    "N12_smote_forest",
    with_views("""select 'rows of the majority' fact, count(*) n, true ok from v_features where label_type <> 2
union all select 'rows of the minority with its synthetic ones', count(*), true from v_features where label_type <> 2""", "v_features"),
)
def q_smote_forest(spark, sf):
    """SMOTE over the forest's neighbours: class sizes become equal, and every
    synthetic value lies within the minority's range."""
    f = _minority_features(spark, sf).select("id", *FEAT_COLS, "y")
    out = KN.smote(f, "id", FEAT_COLS, "y", minority=1, ratio=1.0, k=5, neighbours=_forest_of_features)
    box = f.where("y = 1").agg(*[g(c).alias(f"{a}_{c}") for c in FEAT_COLS for a, g in (("lo", F.min), ("hi", F.max))])
    inside = None
    for c in FEAT_COLS:
        x = (F.col(c) >= F.col(f"lo_{c}") - 1e-9) & (F.col(c) <= F.col(f"hi_{c}") + 1e-9)
        inside = x if inside is None else inside & x
    mine = out.where("y = 1").crossJoin(F.broadcast(box))
    return _fact(out.where("y <> 1"), "rows of the majority").unionByName(_fact(mine, "rows of the minority with its synthetic ones", ok=F.min(inside)))
