"""Collocations by prefix-free parsing.

Every run of words is cut into chunks where its content says so: a window of
OVERLAP words whose hash is a multiple of ``MODULUS`` ends a chunk and begins the
next one, so two chunks share just that window and equal passages fall into
equal chunks wherever they stand. The distinct chunks with the number of their
occurrences in the parse are the dictionary; a passage that a million texts
share is one entry of it. Runs without a trigger are cut after LONGEST words.

An n-gram of up to OVERLAP + 1 words lies whole in a chunk, and it is counted
once, in the chunk where it does not begin inside the window that ends it (the
last chunk of a run has none). So the n-gram counts of the table are sums over
distinct chunks weighted by their occurrences.

A phrase is as frequent as asked only if both its parts with one word less are.
Counts go up by length; at each length a table of bits that the frequent
phrases of the length before have set by hash lets through what may be frequent. It
can only let too much through, the sums are exact. Its size follows the
number of those phrases up to MOST_BITS, the proven bound of what is broadcast.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, lean, pinned, small_or_not
from tessera.sources.sinks import scratch_path

NO_LANG = "und"
OVERLAP = 3
MODULUS = 16
LONGEST = 256
MOST_WORDS = OVERLAP + 1
MOST_BITS = 1 << 27
#: Phrases of a task's own sums before they are handed on.
HELD = 500_000
#: Bytes of texts that are parsed together, and chunks that are counted together.
TOGETHER = 1 << 21
CHUNKS = 16_384

_SPACE, _END = 32, 10
# A-Z in lower case, the signs that end a piece all as one
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 15
_CHUNK = "lang string, chunk string, tail boolean, n long"
_COUNT = "lang string, phrase string, f long"

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse modulo 2^64, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p)], dtype=np.uint64) for p in (_PRIME, _INVERSE))
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word data[start:end]: differences of a running sum
    of bytes times powers, brought to the same power."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _BLOCK):
        b, e = starts[at : at + _BLOCK], ends[at : at + _BLOCK]
        part = data[b[0] : e[-1]]
        power, inverse = _powers_to(len(part))
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=run[1:])
        out[at : at + _BLOCK] = (run[e - b[0]] - run[b - b[0]]) * inverse[b - b[0]]
    return out


def _windows(h: np.ndarray, n: int, seed: np.ndarray | int = 0) -> np.ndarray:
    """A hash of every n words in a row; ``seed`` goes with a position."""
    size = max(0, len(h) - n + 1)
    x = np.full(size, n, np.uint64) + (seed[:size] if isinstance(seed, np.ndarray) else np.uint64(seed))
    for k in range(n):
        x = (x ^ h[k : k + size]) * _PRIME
        x ^= x >> np.uint64(29)
    return x


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and run of every word of folded text: words end at space and
    tab, runs at the sign that ends a piece."""
    a = np.frombuffer(data, np.uint8)
    inside = (a != _SPACE) & (a != 9) & (a != _END)
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(np.flatnonzero(a == _END), starts)


def cuts(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """First words of the chunks of runs of words with hashes ``h``; the runs lie
    one after the other and begin at ``begins`` (the end of the words included)."""
    n = len(h)
    run_end = np.repeat(begins[1:], np.diff(begins))
    trigger = np.zeros(n, bool)
    window = _windows(h, OVERLAP)
    trigger[: len(window)] = (window >> np.uint64(33)) % np.uint64(MODULUS) == 0
    place = np.arange(n)
    # a word at least before the window and after it
    trigger &= place + OVERLAP < run_end
    trigger[begins[:-1]] = True
    starts = np.flatnonzero(trigger)
    gap = np.diff(np.r_[starts, n])
    if (gap > LONGEST).any():
        more = [np.arange(s + LONGEST, s + g, LONGEST) for s, g in zip(starts[gap > LONGEST], gap[gap > LONGEST])]
        more = np.concatenate(more)
        starts = np.union1d(starts, more[more + OVERLAP < run_end[more]])
    return starts


def chunks_of(data: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The parse of folded text: each chunk's place, its words by single spaces,
    and whether it ends its run."""
    starts, ends, run = words_of(data)
    if not len(starts):
        return starts, [], np.zeros(0, bool)
    begins = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
    a = np.frombuffer(data, np.uint8)
    first = cuts(word_hashes(a, starts, ends), begins)
    run_end = np.repeat(begins[1:], np.diff(begins))[first]
    following = np.r_[first[1:], len(starts)]
    tails = following == run_end
    last = np.where(tails, run_end, following + OVERLAP) - 1
    # a chunk whose words stand one space apart is a slice of the text
    wide = (starts[1:] - ends[:-1] != 1) | (a[ends[:-1]] != _SPACE)
    wide = np.r_[0, np.cumsum(wide)]
    chunks = [data[s:e] for s, e in zip(starts[first].tolist(), ends[last].tolist())]
    for i in np.flatnonzero(wide[last] != wide[first]).tolist():
        chunks[i] = b" ".join(chunks[i].split())
    return starts[first], chunks, tails


def _strings(values: Iterable[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, chunk (its words by single spaces), tail (whether it ends its run)
    and n, how often the parse of all texts has it."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang")
    src = docs.select(lang, F.col(f"`{text_col}`").alias("text")).where("text is not null")
    schema = arrow_schema(docs.sparkSession, _CHUNK)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed(langs: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            place, chunks, tails = chunks_of(b"\n".join(texts))
            if chunks:
                text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), place, side="right")
                t = pa.table({"lang": pa.array(langs, pa.string()).take(pa.array(text)), "chunk": _strings(chunks), "tail": pa.array(tails)})
                t = t.group_by(["lang", "chunk", "tail"]).aggregate([([], "count_all")])
                yield from t.select(["lang", "chunk", "tail", "count_all"]).cast(schema.with_metadata(None).set(3, pa.field("count_all", pa.int64()))).rename_columns(schema.names).to_batches()

        langs, texts, size = [], [], 0
        for b in (part.slice(at, 64) for part in batches for at in range(0, part.num_rows, 64)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                langs.append(lang)
                texts.append(text.encode().translate(_FOLD))
                size += len(texts[-1])
                if size > TOGETHER:
                    yield from parsed(langs, texts)
                    langs, texts, size = [], [], 0
        yield from parsed(langs, texts)

    return src.mapInArrow(lean(parse), _CHUNK).groupBy("lang", "chunk", "tail").agg(F.sum("n").alias("n"))


def _count_words(chunks: list[bytes], tails: np.ndarray, weights: np.ndarray, sums: Counter) -> None:
    """Adds the words of chunks, times their occurrences, and all of them at None;
    words of a window with which the next chunk begins are counted there."""
    once = weights == 1
    words = b" ".join([c for c, one in zip(chunks, once.tolist()) if one]).split()
    sums.update(words)
    total = len(words)
    for i in np.flatnonzero(~once).tolist():
        words, k = chunks[i].split(b" "), int(weights[i])
        total += k * len(words)
        for x in words:
            sums[x] += k
    for i in np.flatnonzero(~tails).tolist():
        k = int(weights[i])
        total -= k * OVERLAP
        for x in chunks[i].rsplit(b" ", OVERLAP)[1:]:
            sums[x] -= k
    sums[None] += total


class _Words:
    """The words of a column of strings whose words stand one space apart."""

    def __init__(self, strings: pa.Array, langs: list[str]):
        _, offsets, data = strings.buffers()
        at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        self.data = data.to_pybytes()[at[0] : at[-1]] if data is not None else b""
        at -= at[0]
        a = np.frombuffer(self.data, np.uint8)
        inside = a != _SPACE
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[at[:-1]] = True  # no string is empty
        last[at[1:] - 1] = True
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        upto = np.searchsorted(self.starts, at)
        self.sizes, self.upto = np.diff(upto), upto[1:]
        self.h = word_hashes(a, self.starts, self.ends)
        code: dict[str, int] = {}
        for x in langs:
            if x not in code:
                raw = np.frombuffer(x.encode(), np.uint8)
                code[x] = int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0
        self.seeds = np.repeat(np.array([code[x] for x in langs], np.uint64), self.sizes)

    def bits(self, n: int, bits: int) -> np.ndarray:
        """The bit of every n words in a row; meant only where n words of one
        string follow."""
        return (_windows(self.h, n, self.seeds) >> np.uint64(20)) % np.uint64(bits)


def _flags(spark: SparkSession, frequent: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Number of bits and the packed bits that ``frequent`` phrases of n words set."""
    bits = 1 << 16
    while bits < min(16 * frequent.count(), MOST_BITS):
        bits *= 2
    schema = arrow_schema(spark, "word long, bit long")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = _Words(b.column(1).cast(pa.string()), b.column(0).to_pylist()).bits(n, bits)[::n].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], schema=schema)

    set_bits = frequent.select("lang", "phrase").mapInArrow(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    flags = np.zeros(bits >> 5, np.uint32)
    got = set_bits.toArrow()  # at most bits / 32 rows
    flags[got["word"].to_numpy()] = got["bit"].to_numpy().astype(np.uint32)
    return bits, flags


def phrase_counts(dictionary: DataFrame, n: int, least: int, shorter: DataFrame | None = None) -> DataFrame:
    """lang, phrase, f of the phrases of ``n`` words with f >= ``least``; for
    n > 1 ``shorter`` are those of one word less. For n = 1 a row with a null
    phrase is the number of all words of a language."""
    spark = dictionary.sparkSession
    schema = arrow_schema(spark, _COUNT)
    shared = spark.sparkContext.broadcast(_flags(spark, shorter, n - 1) if shorter is not None else None)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        flags = shared.value

        def hand_on(least: int = 0) -> Iterator[pa.RecordBatch]:
            if sum(map(len, held.values())) > least:
                for lang, sums in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), _strings(sums), pa.array(sums.values(), pa.int64())], schema=schema)
                held.clear()

        for b in (part.slice(at, CHUNKS) for part in batches for at in range(0, part.num_rows, CHUNKS)):
            langs, weights = b.column(0).to_pylist(), b.column(3).to_numpy()
            tails = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            of = np.array([code[x] for x in langs], np.int32)
            if n == 1:
                chunks = b.column(1).cast(pa.binary())
                for lang, i in code.items():
                    mine = np.flatnonzero(of == i)
                    _count_words(chunks.take(pa.array(mine)).to_pylist(), tails[mine], weights[mine], held[lang])
                yield from hand_on(HELD)
                continue
            w = _Words(b.column(1).cast(pa.string()), langs)
            place = np.arange(len(w.starts))
            # n words to the chunk's end, and not from the window that the next chunk begins with
            ok = (place + n <= np.repeat(w.upto, w.sizes)) & (place < np.repeat(w.upto - np.where(tails, 0, OVERLAP), w.sizes))
            bits, table = flags
            bit = w.bits(n - 1, bits)
            known = np.zeros(len(place) + 1, bool)
            known[: len(bit)] = (table[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
            at = np.flatnonzero(ok & known[:-1] & known[1:])
            chunk = np.repeat(np.arange(len(langs)), w.sizes)[at]
            starts, ends, times, of = w.starts[at], w.ends[at + n - 1], weights[chunk], of[chunk]
            for lang, i in code.items():
                mine, sums = of == i, held[lang]
                once = mine & (times == 1)
                sums.update([w.data[s:e] for s, e in zip(starts[once].tolist(), ends[once].tolist())])
                more = mine & (times != 1)
                for s, e, k in zip(starts[more].tolist(), ends[more].tolist(), times[more].tolist()):
                    sums[w.data[s:e]] += k
            yield from hand_on(HELD)
        yield from hand_on()

    f = dictionary.mapInArrow(lean(count), _COUNT).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return f.where((F.col("f") >= least) | F.col("phrase").isNull())


def _exact(c: Column | str) -> Column:
    """Arithmetic of 38 digits: products of counts may pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, most_words: int = MOST_WORDS, cover_percent: int = 80, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, the best ``top`` of each language.

    Candidates are phrases of 2 to ``most_words`` (at most OVERLAP + 1) words
    that stand at least ``min_count`` times in the pieces of a language's texts.
    The score of a cut is floor(2000000 a / (l + r)); the lowest of a phrase
    counts, of equal ones the earliest. A candidate goes if a longer candidate
    holds it and has at least ``cover_percent`` of its count. Order: score and
    a from the highest, then the phrase by its bytes; ``top`` None returns all.

    Null texts have no words, a null language is `und`; repeated rows count each
    time; a very long text is parsed like others, chunk by chunk. An empty table,
    or no phrase as frequent, gives an empty result. Other columns are not read.
    """
    if not 2 <= most_words <= OVERLAP + 1:
        raise ValueError(f"phrases of 2 to {OVERLAP + 1} words")
    spark = docs.sparkSession
    path = scratch_path(spark, "chunks")
    dictionary(docs, text_col, lang_col).write.parquet(path)
    entries = spark.read.parquet(path)
    ones = pinned(phrase_counts(entries, 1, min_count))
    words = ones.where("phrase is null").select("lang", F.col("f").alias("n"))
    levels = [ones.where("phrase is not null")]
    for n in range(2, most_words + 1):
        levels.append(pinned(phrase_counts(entries, n, min_count, levels[-1])))
    return rank(levels, words, cover_percent, top)


def rank(levels: list[DataFrame], words: DataFrame, cover_percent: int = 80, top: int | None = 2000) -> DataFrame:
    """Scores, covers and ranks the counted phrases; ``levels`` by length, from
    1 word; ``words`` (lang, n) has the words of each language."""
    parts = levels[0]
    for x in levels[1:-1]:
        parts = parts.unionByName(x)
    sized = [x.select("lang", "phrase", F.col("f").alias("a"), F.lit(n).alias("size")) for n, x in enumerate(levels, 1)][1:]
    cand = sized[0]
    for x in sized[1:]:
        cand = cand.unionByName(x)
    word = F.split("phrase", " ")
    text = lambda at, n: F.array_join(F.slice("word", at, n), " ")
    cut = cand.withColumn("word", word).select("lang", "phrase", "a", "size", "word", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "size", "k", text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    parts = pinned(parts)
    # a part of many phrases is one key: broadcast when measured small, else
    # left to the join that splits skewed partitions
    of = lambda side, c: small_or_not(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(c)), 512)
    cut = cut.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cut = cut.withColumn("score", score)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cut.groupBy("lang", "phrase", "a", "size").agg(lowest).select("lang", "phrase", "a", "size", "cut.l", "cut.r", "cut.score")

    inner = cand.where("size > 2").withColumn("word", word).select("lang", "a", "size", "word", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "word", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", text(F.col("at"), F.col("m")).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * cover_percent)).drop("longer", "size")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        # the best of each slice of a language, then the best of those
        slices = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        kept = kept.withColumn("at", F.row_number().over(slices)).where(F.col("at") <= top).drop("at")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    words = pinned(words)
    return ranked.join(small_or_not(words, 256), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
