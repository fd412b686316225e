"""DuckDB SQL text emitters mirroring the Column functions, used only to
write oracle SQL for the correctness gate."""

from __future__ import annotations

from tessera.functions.scalars import BUCKET_BOUNDARIES

B_SQL = "[" + ", ".join(str(b) for b in BUCKET_BOUNDARIES) + "]"


def clean_scalar(x: str, vocab: int) -> str:
    if vocab <= 0:
        return "cast(0 as bigint)"
    return f"cast(case when {x} is null or {x} <= 0 or {x} >= {vocab} then 0 else {x} end as bigint)"


def pad_ids(x: str, dim: int, vocab: int) -> str:
    head = f"coalesce({x}, cast([] as bigint[]))[1:{dim}]"
    if vocab <= 0:
        cleaned = f"list_transform({head}, lambda v: cast(0 as bigint))"
    else:
        cleaned = f"list_transform({head}, lambda v: cast(case when v > 0 and v < {vocab} then v else 0 end as bigint))"
    return f"list_resize({cleaned}, {dim}, cast(0 as bigint))"


def pad_raw(x: str, dim: int, fill: str = "cast(0 as bigint)", dtype: str = "bigint") -> str:
    return f"list_resize(coalesce(cast({x} as {dtype}[]), cast([] as {dtype}[]))[1:{dim}], {dim}, {fill})"


def pad_dense(x: str, dim: int) -> str:
    return pad_raw(x, dim, "cast(0 as float)", "float")


def length(x: str) -> str:
    return f"cast(coalesce(len({x}), 0) as bigint)"


def bucket_of(dt: str, t: str) -> str:
    return (
        f"cast(case when {t} = 0 then 0 else least(len(list_filter({B_SQL}, lambda b: b < {dt})), "
        f"{len(BUCKET_BOUNDARIES) - 1}) + 1 end as bigint)"
    )


def time_bucket(now: str, ts: str) -> str:
    return bucket_of(f"greatest({now} - {ts}, 0)", ts)


def time_bucket_array(now: str, ts_padded: str) -> str:
    return f"list_transform({ts_padded}, lambda t: {bucket_of(f'greatest({now} - t, 0)', 't')})"


def concat(parts: list[str], empty_type: str = "bigint") -> str:
    if not parts:
        return f"cast([] as {empty_type}[])"
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


# ---- augmentation twins (DuckDB list lambdas are 1-based: index i -> i - 1)

from tessera.functions.rand import SqlExpr, gaussian_sql, uniform_sql  # noqa: E402


def n1(x: str, key: str, col: str, ratio: float, sd: str, seed: int = 42) -> str:
    g = gaussian_sql(SqlExpr(key), f"n1:{col}", str(seed))
    return f"(case when {sd} is not null and not isnan({sd}) and {sd} <> 0 then {x} + {g} * {ratio!r} * {sd} else cast({x} as double) end)"


def n2(x: str, key: str, col: str, lo: float, hi: float, seed: int = 42) -> str:
    return f"({x} * ({lo!r} + {hi - lo!r} * {uniform_sql(SqlExpr(key), f'n2:{col}', str(seed))}))"


def n3(x: str, key: str, col: str, ratio: float, seed: int = 42) -> str:
    u = uniform_sql(SqlExpr(key), f"n3:{col}", str(seed), SqlExpr("i - 1"))
    return f"list_transform({x}, lambda v, i: case when {u} > {ratio!r} then v else v * 0 end)"


def _start(key: str, salt: str, seed: int, n: str, length: str) -> str:
    return f"cast(floor({uniform_sql(SqlExpr(key), salt, str(seed))} * ({n} - {length} + 1)) as int)"


def n4(x: str, key: str, col: str, ratio: float, seed: int = 42) -> str:
    n = f"len({x})"
    L = f"greatest(1, cast(floor({n} * {ratio!r}) as int))"
    st = _start(key, f"n4:{col}", seed, n, L)
    return f"(case when {x} is null or {n} <= 2 then {x} else {x}[{st} + 1 : {st} + {L}] end)"


def n5(x: str, key: str, col: str, ratio: float, seed: int = 42) -> str:
    n = f"len({x})"
    k = f"greatest(1, cast(floor({n} * {ratio!r}) as int))"
    u = uniform_sql(SqlExpr(key), f"n5:{col}", str(seed), SqlExpr("i - 1"))
    chosen = f"list_transform(list_sort(list_transform({x}, lambda v, i: struct_pack(u := {u}, i := i - 1)))[1:{k}], lambda s: s.i)"
    masked = f"list_transform({x}, lambda v, i: case when list_contains({chosen}, i - 1) then v * 0 else v end)"
    return f"(case when {x} is null or {n} <= 2 then {x} else {masked} end)"


def n6(x: str, key: str, col: str, ratio: float, seed: int = 42) -> str:
    n = f"len({x})"
    L = f"greatest(2, cast(floor({n} * {ratio!r}) as int))"
    st = _start(key, f"n6:{col}", seed, n, L)
    return f"(case when {x} is null or {n} <= 3 then {x} else {x}[{st} + 1 : {st} + {L}] end)"


def n7(x: str, key: str, col: str, chunk: int = 3, seed: int = 42) -> str:
    nc = f"greatest(cast(ceil(len({x}) / {chunk}) as int) - 1, 0)"
    u = uniform_sql(SqlExpr(key), f"n7:{col}", str(seed), SqlExpr("j"))
    parts = f"list_transform(range(0, {nc} + 1), lambda j: struct_pack(u := {u}, p := {x}[j * {chunk} + 1 : j * {chunk} + {chunk}]))"
    out = f"flatten(list_transform(list_sort({parts}), lambda s: s.p))"
    return f"(case when {x} is null or len({x}) = 0 then {x} else {out} end)"
