"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are digested to 64 bits (with the number of earlier equal
paragraphs, so that repeats count) and added to three cells each of a sketch:
a count, the XOR of the digests, the XOR of their check sums. Sketches of two
versions subtract cell by cell; what both have cancels, and peeling cells that
hold one digest recovers the digests that differ, on either side. When peeling
stops short, both texts are sketched again in ``GROW`` times the cells.
Likeness is 1 minus the recovered difference over the paragraphs of both.

The next document of an ascending order is found without a global window:
documents are dealt into blocks of consecutive ids, and the first document of
each block is also dealt to the block before it as a guest. A task reads its
blocks in order and holds two texts at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, lean, pinned, shuffle_width
from tessera.operators.ordering import global_row_number

CELLS = 12
GROW = 4
BLOCK_ROWS = 512
MAX_BLOCKS = 1 << 17
#: Longer lines are cut; a piece but the last has at least half as many characters.
PARAGRAPH_CHARS = 200

#: Sentence ends: ASCII before white space, others anywhere, with closing marks.
_END = re.compile("[.!?][\"')\\]]*(?=\\s|\\Z)|[\u3002\uff01\uff1f\uff61\uff0e\u2026\u203c\u2047-\u2049\u061f\u06d4\u0964\u0965\u104b\u1362\u17d4\u1803\u1809][\u201d\u2019\u300d\u300f\uff09\u3011]*")
#: Code points before a place that decide on a cut there.
_WINDOW = 8
_POWERS = np.array([pow(0x01000193, i, 1 << 32) for i in range(_WINDOW)], np.uint32)
_MASK = (1 << 64) - 1


def _content_cut(part: str) -> int:
    """A place in the latter half of ``part``: the first with the least hash of
    the code points before it."""
    codes = np.frombuffer(part[len(part) // 2 - _WINDOW :].encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled = (np.lib.stride_tricks.sliding_window_view(codes, _WINDOW) * _POWERS).sum(axis=1, dtype=np.uint32)
    return len(part) // 2 + int(np.argmin((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)))


def paragraphs(text: str) -> Iterator[str]:
    """Lines; of a line the next piece ends with the first sentence that ends in
    the latter half of PARAGRAPH_CHARS characters, else, if the line goes on
    beyond these, at a place there chosen by the code points around it."""
    for line in text.split("\n"):
        at = 0
        while at < len(line):
            low, high = at + PARAGRAPH_CHARS // 2, at + PARAGRAPH_CHARS
            end = _END.search(line, low - 1, high + 1)  # one more, to see what follows
            if end and end.end() <= high:
                cut = end.end()
            elif len(line) > high:
                cut = at + _content_cut(line[at:high])
            else:
                cut = len(line)
            yield line[at:cut]
            at = cut


def digests(text: str) -> list[int]:
    """64-bit digests of the paragraphs: lines, long ones in pieces; the n-th
    repeat of a paragraph has a digest of its own."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        p = p.strip()
        if p:
            n = seen.get(p, 0)
            seen[p] = n + 1
            out.append(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), n))
    return out


def _check(key: int) -> int:
    return ((key * 0x9E3779B97F4A7C15 & _MASK) >> 29) & 0xFFFFFFFF


def _places(key: int, third: int) -> tuple[int, int, int]:
    return key % third, third + (key >> 21) % third, 2 * third + (key >> 42) % third


class Sketch:
    """Cells of counts, digest XORs and check XORs."""

    __slots__ = ("counts", "keys", "checks")

    def __init__(self, digests: Iterable[int], cells: int):
        self.counts, self.keys, self.checks = [0] * cells, [0] * cells, [0] * cells
        counts, keys, checks, third = self.counts, self.keys, self.checks, cells // 3
        for k in digests:
            c = _check(k)
            for i in _places(k, third):
                counts[i] += 1
                keys[i] ^= k
                checks[i] ^= c

    def hex(self) -> str:
        return "".join(f"{c & 0xFFFFFFFF:08x}{k:016x}{h:08x}" for c, k, h in zip(self.counts, self.keys, self.checks))

    def difference(self, other: Sketch) -> tuple[list[int], list[int]] | None:
        """Digests only here and only there; None if peeling stops short."""
        counts = [a - b for a, b in zip(self.counts, other.counts)]
        keys = [a ^ b for a, b in zip(self.keys, other.keys)]
        checks = [a ^ b for a, b in zip(self.checks, other.checks)]
        third = len(counts) // 3
        mine: list[int] = []
        theirs: list[int] = []
        todo = [i for i, c in enumerate(counts) if c in (1, -1)]
        while todo:
            i = todo.pop()
            c, k = counts[i], keys[i]
            if c not in (1, -1) or checks[i] != _check(k) or i not in _places(k, third):
                continue
            (mine if c == 1 else theirs).append(k)
            h = checks[i]
            for j in _places(k, third):
                counts[j] -= c
                keys[j] ^= k
                checks[j] ^= h
                if counts[j] in (1, -1):
                    todo.append(j)
        return None if any(counts) or any(keys) or any(checks) else (mine, theirs)


class Fingerprint:
    """Sketches of one text, larger ones made when they are needed."""

    __slots__ = ("text", "digests", "sketches")

    def __init__(self, text: str):
        self.text = text
        self.digests = digests(text)
        self.sketches = [Sketch(self.digests, CELLS)]

    def at(self, level: int) -> Sketch:
        while len(self.sketches) <= level:
            self.sketches.append(Sketch(self.digests, CELLS * GROW ** len(self.sketches)))
        return self.sketches[level]

    def difference(self, other: Fingerprint) -> tuple[list[int], list[int]]:
        level = 0
        while (found := self.at(level).difference(other.at(level))) is None:
            level += 1
        return found

    def likeness(self, other: Fingerprint) -> float:
        total = len(self.digests) + len(other.digests)
        return 1.0 - sum(map(len, self.difference(other))) / total if total else 1.0


def edited(text: str, following: str) -> str:
    """The last half replaced by as many first code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited version, and their likeness.

    Null texts count as empty. Order is by id, null ids first, repeated ids by
    text; the document after the last is the first (a single document follows
    itself). Texts without paragraphs are alike (1) to each other and 0 to any
    other. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    src = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(low)).alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ranked = global_row_number(src.select("key").distinct(), ["key"])
    ranked = pinned(ranked.select("key", "rn"))
    step = max(BLOCK_ROWS, ranked.count() // MAX_BLOCKS)
    # one id a block: at most MAX_BLOCKS + 1
    heads = spark.sparkContext.broadcast(np.array(sorted(r["key"] for r in ranked.where((F.col("rn") - 1) % step == 0).collect()), np.int64))

    @F.arrow_udf("array<long>")
    def blocks(key: pa.Array) -> pa.Array:
        """The block of an id and, for the first id of a block, the block before it."""
        k, first = key.to_numpy(zero_copy_only=False), heads.value
        own = np.searchsorted(first, k, side="right") - 1
        guest = first[own] == k
        flat = np.column_stack([own, (own - 1) % len(first)]).ravel()
        take = np.column_stack([np.ones(len(k), bool), guest]).ravel()
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(1 + guest)].astype(np.int32)), pa.array(flat[take]))

    dealt = src.select("key", "text", F.posexplode(blocks("key")).alias("guest", "block"))
    dealt = dealt.repartition(shuffle_width(docs), "block").sortWithinPartitions("block", "guest", "key", "text")
    out = arrow_schema(spark, _SCHEMA)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, Fingerprint] | None = None  # block, key and text still without its next
        for b in batches:
            rows = []
            for key, text, guest, block in zip(*(b.column(i).to_pylist() for i in range(4))):
                if guest and (last is None or last[0] != block):
                    continue  # only the first guest is a next document
                now = Fingerprint(text)
                if last is not None:
                    rows.append(_compare(last[1], last[2], now))
                last = None if guest else (block, key, now)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return dealt.select("key", "text", "guest", "block").mapInArrow(lean(run), _SCHEMA)


def _compare(key: int, now: Fingerprint, following: Fingerprint) -> tuple:
    new = Fingerprint(edited(now.text, following.text))
    return (
        None if key == -(1 << 63) else key,
        len(now.text),
        hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).hexdigest(),
        now.at(0).hex(),
        new.at(0).hex(),
        now.likeness(new),
        now.likeness(following),
    )
