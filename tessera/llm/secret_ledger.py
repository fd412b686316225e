"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger is a table of the (blob, rule, rule version) pairs scanned so far
and their findings; a scan takes the distinct blobs of the versions given,
leaves out the pairs the ledger has, scans the rest, and adds a row for each
pair, findings or none. Findings then join back to all versions by blob, so a
text that thousands of paths share is scanned once for each rule version.

Matches are located without Python: the text between matches and the matches
come from the same expression (``split`` and ``regexp_extract_all``), and a
running sum of their lengths gives the code point positions. The sum is a
window in one blob and rule, linear in its matches.

Bounds: the rules are a fixed short list. Blobs are grouped by address with
partial aggregation, so copies of a text collapse before the shuffle. Findings
of a blob are one row; they are broadcast to the versions only if they are
measured small, else joined by a shuffle that can split a hot blob's versions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, pinned


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    #: cheap necessary condition, then the expression that finds a match
    hint: str
    pattern: str
    #: the group whose length counts (0: the match) and its least length
    group: int = 0
    least: int = 1


# Fixed values of the contract (assign, access, hex), then further kinds. Runs
# of 16 or 32 characters at least are matched as such: a shorter run of the
# same characters cannot hold one, so the matches are those of the plain runs.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32}", r"[0-9a-f]{32,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36}", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", 1, r"PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob binary, kind string, version int, spans array<struct<start:long,end:long>>"


def address(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows for the blobs of ``versions`` and the pairs that
    ``ledger`` lacks. Append them to the ledger; scanning again adds none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blobs = versions.select(address(F.col(f"`{text_col}`")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
    blobs = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    tried = F.explode(F.filter(F.array(*[_pieces(r) for r in rules]), lambda p: p["kind"].isNotNull())).alias("p")
    pairs = blobs.select("blob", tried).select("blob", "p.kind", "p.version", F.posexplode_outer(F.arrays_zip("p.gaps", "p.matches", "p.counted")).alias("k", "m"))
    # a match ends after the gaps and matches up to it; a blob is in one task
    # already, so neither the window nor the grouping moves rows
    order = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = pairs.withColumn("end", F.sum(F.col("m.gaps") + F.col("m.matches")).over(order))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    span = F.when(F.col("m.matches").isNotNull() & (F.col("m.counted") >= least[F.col("kind")]), F.struct((F.col("end") - F.col("m.matches")).alias("start"), F.col("end")))
    return ends.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _pieces(r: Rule) -> Column:
    """Lengths of the gaps, of the matches and of the group that counts; all
    null when the ledger has the pair, empty when the hint does not hold."""
    text, lengths = F.col("text"), lambda a: F.transform(a, lambda s: F.length(s).cast("long"))
    hit = text.rlike(r.hint)
    some = lambda a: F.when(hit, lengths(a)).otherwise(F.array().cast("array<long>"))
    todo = ~F.array_contains("done", f"{r.kind}:{r.version}")
    return F.struct(
        F.when(todo, F.lit(r.kind)).alias("kind"),
        F.lit(r.version).alias("version"),
        F.when(todo, some(F.split(text, r.pattern, -1))).alias("gaps"),
        F.when(todo, some(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)))).alias("matches"),
        F.when(todo, some(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)))).alias("counted"),
    )


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and spans (array of start, place, kind, end; sorted) of every row.

    A span is a code point range, end exclusive; place is the kind's place in
    ``rules``. Null and empty texts have no span. Rows that repeat an id or a
    text are reported alike; an empty table gives an empty result; only the
    two columns are read.
    """
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    wanted = None
    for r in rules:
        c = (F.col("kind") == r.kind) & (F.col("version") == r.version)
        wanted = c if wanted is None else wanted | c
    rows = ledger.where(wanted).where(F.size("spans") > 0).select("blob", "kind", F.explode("spans").alias("s"))
    spans = F.array_sort(F.collect_set(F.struct("s.start", place[F.col("kind")].alias("place"), F.col("kind"), "s.end")))
    found = pinned(rows.groupBy("blob").agg(spans.alias("spans")))
    size = found.agg(F.sum(F.size("spans") * 80 + 96)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    docs = versions.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), address(F.col(f"`{text_col}`")).alias("blob"))
    none = F.array().cast("array<struct<start:long,place:int,kind:string,end:long>>")
    return docs.join(found, "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
