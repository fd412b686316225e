"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rand import SqlExpr, hash32_sql
from tessera.llm import (
    bpe_tree, collocation, exact_quotient, html_template, importance, language_kernel, license_index, mixing_tree, paragraph_sketch, secret_ledger, simhash_mih,
    token_alignment, toxicity,
)
from tessera.llm.common import read_table, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


OP5_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 from documents)
select doc_id,
       first_value(doc_id) over w keep_id,
       count(*) over (partition by text_sha256) group_size,
       row_number() over w = 1 kept,
       text_sha256
from t window w as (partition by text_sha256 order by n_chars desc, doc_id)
"""


@register("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quotient.exact_groups(read_table(spark, sf_dir, "documents")).drop("n_chars")


@register("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_mih.near_components(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@register("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_kernel.predict(docs, language_kernel.train(docs))


@register("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    spec = bpe_tree.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    return bpe_tree.digests(bpe_tree.encode(read_table(spark, sf_dir, "documents"), spec))


OP10_SQL = rf"""
with t as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
                  {hash32_sql(SqlExpr('doc_id'), 'mix', '42')} h from documents),
s as (select source, cast(sum(size) as bigint) source_size, 3 * sum(size) cap,
             cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) w from t group by source),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0)) / sum(w) over from_here as level
      from s window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding),
                    from_here as (order by cap / w, source nulls last rows between current row and unbounded following)),
a as (select source, source_size, least(cap, w * (select min_by(level, cap / w) from l where cap >= w * level)) target from l),
d as (select t.*, source_size, target, floor(target / nullif(source_size, 0)) passes,
             sum(size) over (partition by t.source order by h, doc_id, size rows unbounded preceding) upto
      from t join a on t.source is not distinct from a.source)
select doc_id, size, source_size, round(target, 6) target,
       cast(coalesce(size * (passes + case when upto - size / 2.0 <= target - passes * source_size then 1 else 0 end), 0) as bigint) taken
from d
"""


@register("op10_mixing", OP10_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_tree.taken_words(mixing_tree.mix(read_table(spark, sf_dir, "documents")))


def _op2_sql() -> str:
    """The contract's plain runs for the base kinds; spans by running sums of
    the lengths between and of the matches."""
    plain = {"access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    kinds = []
    for place, r in enumerate(secret_ledger.RULES):
        pattern, group, least = plain.get(r.kind, (r.pattern, r.group, r.least))
        q = "'" + pattern.replace("'", "''") + "'"
        kinds.append(f"""select r, {place} place, '{r.kind}' kind, {least} least, unnest(m) m, unnest(v) v, unnest(g[1:len(m)]) g, unnest(range(len(m))) k
from (select r, regexp_extract_all(t, {q}) m, regexp_extract_all(t, {q}, {group}) v, string_split_regex(t, {q}) g from d)""")
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
h as ({" union all ".join(kinds)}),
e as (select *, sum(length(g) + length(m)) over (partition by r, place order by k rows unbounded preceding) ends from h),
s as (select r, kind, place, kind || ':' || cast(ends - length(m) as bigint) || ':' || cast(ends as bigint) span, cast(ends - length(m) as bigint) start from e where length(v) >= least),
a as (select r, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
             string_agg(span, ',' order by start, place) filter (place < 3) base, string_agg(span, ',' order by start, place) spans from s group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join a using (r)
"""


@register("op2_secret_scan", _op2_sql())
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ledger = secret_ledger.scan(docs, secret_ledger.empty_ledger(spark))
    return secret_ledger.digests(secret_ledger.findings(docs, ledger))


def _op9_sql() -> str:
    """Base phrases by comparing word lists; labels from aligned words."""
    sql_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    base = [t for t in license_index.TEMPLATES if t.base]
    places = ", ".join(
        f"list_transform(list_filter(range(len(words)), lambda i: words[i + 1:i + {len(t.words)}] = {sql_list(t.words)}), lambda i: {{'at': i, 'label': '{t.label}'}})" for t in base
    )
    postings = ", ".join(
        f"('{w}', {n}, {o}, {len(t.words)}, {o in t.key_offsets}, {len(t.key.split())}, '{t.label}')"
        for n, t in enumerate(license_index.TEMPLATES) for o, w in enumerate(t.words)
    )
    return rf"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents),
b as (select *, flatten([{places}]) base from d),
p(word, template, place, length, is_key, keys, label) as (values {postings}),
u as (select r, unnest(words) word, unnest(range(len(words))) as pos from d),
v as (select r, template, label, pos - place start, count(*) agree, count(*) filter (is_key) key_agree, any_value(length) length, any_value(keys) keys
      from u join p using (word) group by r, template, label, pos - place),
l as (select r, string_agg(distinct label, ',' order by label) labels, max(round(agree / length, 6)) score from v
      where key_agree = keys and agree >= length * {license_index.LEAST_SHARE} group by r)
select doc_id, cast(len(words) as bigint) n_words, cast(len(base) as bigint) n_base,
       list_min(list_transform(base, lambda x: x.at)) first_word, list_max(list_transform(base, lambda x: x.at)) last_word,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') base_labels,
       coalesce(labels, '') labels, coalesce(score, 0.0) score
from b left join l using (r)
"""


@register("op9_license_scan", _op9_sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.digests(license_index.scan(read_table(spark, sf_dir, "documents")))


@register("op3_paragraph_sketch")
def op3_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.compare_with_next(read_table(spark, sf_dir, "documents"))


@register("op6_importance_resampling")
def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality; as many documents are taken
    as the labels' share of good ones suggests."""
    labels = read_table(spark, sf_dir, "labels")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    good = labels.where("quality = 1").select("doc_id")
    return importance.resample(read_table(spark, sf_dir, "documents"), good, share=share)


@register("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(read_table(spark, sf_dir, "pages"))


@register("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_alignment.read_files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.link_digests(read_table(spark, sf_dir, "documents"), files)


#: Every contiguous phrase of every piece, counted one by one.
OP13_SQL = r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase
      from w, (select unnest([1, 2, 3, 4]) k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) f from g group by all),
n as (select lang, cast(sum(f) as bigint) n from f where k = 1 group by lang),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') ws from f where k >= 2 and f >= 30),
u as (select c.*, cut, array_to_string(ws[1:cut], ' ') lp, array_to_string(ws[cut + 1:], ' ') rp from c, (select unnest([1, 2, 3]) cut) where cut < k),
s as (select u.*, x.f l, y.f r, cast((cast(u.a as hugeint) * 2000000) // (cast(x.f as hugeint) + y.f) as bigint) score
      from u join f x on x.lang = u.lang and x.phrase = lp and x.k = cut join f y on y.lang = u.lang and y.phrase = rp and y.k = u.k - cut),
b as (select *, row_number() over (partition by lang, phrase order by score, cut) pick from s),
i as (select lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda j: array_to_string(ws[j:j + m - 1], ' '))))) phrase from c where k > 2),
m as (select lang, phrase, max(a) longer from i group by all),
t as (select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
      from b left join m using (lang, phrase) where pick = 1 and (longer is null or cast(longer as hugeint) * 100 < cast(a as hugeint) * 80))
select lang, rank, phrase, a, l, r, n, score from t join n using (lang) where rank <= 2000
"""


@register("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read_table(spark, sf_dir, "documents"))
