"""Alignment of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a
sentencepiece model with byte fallback; both read a space and the text. The
spans that the libraries report are coarse cuts: characters for A (from its
offsets), bytes for B (from its proto of pieces). A cut holds where no two
tokens share a character and no run of byte tokens goes on; between two cuts the
tokens' own decoded bytes place the ends, which splits multibyte characters and
byte-fallback runs exactly. Decoded bytes that differ from the text's at any
place leave the text without tokens.

A text falls apart before every space that follows a character other than
white space: no token of either side crosses it (A's splitter never joins the
two, B has no piece with a space inside, which the constructor checks). So the
alignment of a text is that of its units, short units are cached, and a long
text costs no more memory than its token ids. One unsplit unit is encoded whole.

Counts of linked id pairs. A task collects texts in chunks of at most
CHUNK_CHARS characters or CHUNK_ROWS texts; a chunk is one row with its texts'
digests, its distinct pairs, and each text's pairs as numbers into them. Pair counts over
the corpus sum one row a chunk and pair, so that a pair in every text is no hot
key; each chunk then fetches the counts of its own pairs by a join and a
cogroup with the chunk's row. Nothing is broadcast but the tokenizer files and
one row an A id (its highest count), whose number the vocabulary bounds.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import arrow_schema, lean, map_arrow
from tessera.sources.sinks import scratch_path

CHUNK_CHARS = 8 << 20
CHUNK_ROWS = 4_096
CACHE_UNITS = 150_000
CACHED_CHARS = 48

_CUT = re.compile(r"(?<=\S) (?!\Z)")
_ODD = tuple(c + " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")

_SPAN = attrgetter("id"), attrgetter("begin"), attrgetter("end")

#: A ids, B ids, end bytes of both.
Tokens = tuple[list[int], list[int], list[int], list[int]]


def _byte_table() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: visible Latin-1
    characters stand for themselves, the others for code points from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if chr(b) not in table]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


def units(text: str) -> list[str]:
    """Parts of space + text without their leading space."""
    if text.isascii() and not any(c in text for c in _ODD):
        parts = text.split(" ")
        if "" not in parts:
            return parts
    return _CUT.split(text)


def refine(spans: Sequence[tuple[int, int]], decoded: Sequence[bytes], runs: Sequence[bool], data: bytes) -> list[int] | None:
    """End bytes of tokens. ``spans`` are coarse byte ranges (a token may span
    a whole character that it shares), ``runs`` marks byte-fallback tokens;
    None if the decoded bytes are not ``data``."""
    ends: list[int] = []
    at, first, last = 0, 0, len(spans) - 1
    for k, (_, end) in enumerate(spans):
        if k < last and (end <= at or end > spans[k + 1][0] or (runs[k] and runs[k + 1])):
            continue
        piece = at
        for d in decoded[first : k + 1]:
            piece += len(d)
            ends.append(piece)
        if piece != end or b"".join(decoded[first : k + 1]) != data[at:end]:
            return None
        at, first = end, k + 1
    return ends if at == len(data) else None


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the numbers are in ``y``; both ascend, ``y`` is not empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


class Aligner:
    """One pair of tokenizers; the digests of short units are cached, in two
    generations of at most about CACHE_UNITS each."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_spec)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        table = _byte_table()
        self._a_bytes = {i: bytes(map(table.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space inside")
        self._is_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self._b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self._is_byte)]
        self.b_size = len(pieces)
        most = max(self._a_bytes) + 1
        self._a_list = [self._a_bytes.get(i, b"") for i in range(most)]
        self._a_len = np.array([len(x) for x in self._a_list])
        self._b_len = np.array([len(x) for x in self._b_bytes])
        self._b_byte = np.array(self._is_byte)
        # an id as it is written inside a group and at the end of its side
        self._a_text = [[f"{i}{c}" for i in range(most)] for c in ",|"]
        self._b_text = [[f"{i}{c}" for i in range(len(pieces))] for c in ",;"]
        self._new: dict[str, tuple | None] = {}
        self._old: dict[str, tuple | None] = {}

    def tokens(self, parts: Sequence[str]) -> list[Tokens | None]:
        """Ids and end bytes of units given without their leading space."""
        out: list[Tokens | None] = []
        a_all = self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)
        for part, a, b in zip(parts, a_all, self.b.encode(list(parts), return_type="proto", num_threads=1)):
            data = b" " + part.encode()
            a_ids, spans = a.ids, a.offsets
            if len(data) != len(part) + 1:  # characters to bytes
                place = np.cumsum([0, 1, *(len(c.encode()) for c in part)]).tolist()
                spans = [(place[s], place[e]) for s, e in spans]
            a_ends = refine(spans, [self._a_bytes[i] for i in a_ids], [False] * len(a_ids), data)
            b_ids = [p.id for p in b.pieces]
            # B's spans are those of the text after its own space
            b_spans = [(p.begin + 1 if k else 0, p.end + 1) for k, p in enumerate(b.pieces)]
            b_ends = refine(b_spans, [self._b_bytes[i] for i in b_ids], [self._is_byte[i] for i in b_ids], data)
            out.append(None if a_ends is None or b_ends is None else (a_ids, b_ids, a_ends, b_ends))
        return out

    def _joined(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and end bytes of units that are encoded as one text, or None if
        the libraries' spans or bytes do not agree with it everywhere."""
        text = " " + " ".join(parts)
        data = text.encode()
        a = self.a.encode(text, add_special_tokens=False)
        a_ids = np.array(a.ids)
        spans = np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        b_ids, begin, end = (np.fromiter(map(f, pieces), np.int64, len(pieces)) for f in _SPAN)
        a_ends, b_ends = np.cumsum(self._a_len[a_ids]), np.cumsum(self._b_len[b_ids])
        if a_ends[-1] != len(data) or b_ends[-1] != len(data):
            return None
        place = np.arange(len(text) + 1)
        if len(data) != len(text):  # characters to bytes
            lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            place = np.r_[np.flatnonzero(lead), len(data)]
        # coarse cuts of the spans: no shared character, no run of byte tokens
        a_cut = np.r_[spans[1:, 0] >= spans[:-1, 1], True]
        b_cut = np.r_[(begin[1:] >= end[:-1]) & ~(self._b_byte[b_ids][1:] & self._b_byte[b_ids][:-1]), True] & (end > np.r_[0, end[:-1]])
        if (place[spans[a_cut, 1]] != a_ends[a_cut]).any() or (end[b_cut] + 1 != b_ends[b_cut]).any():
            return None
        if b"".join(map(self._a_list.__getitem__, a_ids.tolist())) != data or b"".join(map(self._b_bytes.__getitem__, b_ids.tolist())) != data:
            return None
        return a_ids, b_ids, a_ends, b_ends

    def digests(self, parts: Sequence[str]) -> list[tuple | None]:
        """Per unit the numbers of its A ids, B ids and groups, the groups' text
        (each with a `;` behind it) and its linked pairs; None without tokens.

        Units that end in a character other than white space are encoded
        together, as they stand in texts; where that text does not come back,
        halves of them, at last one by one."""
        out: list[tuple | None] = [None] * len(parts)
        todo = [[i for i, p in enumerate(parts) if p and not p[-1].isspace()]]
        alone = [i for i, p in enumerate(parts) if not p or p[-1].isspace()]
        while todo:
            some = todo.pop()
            if not some:
                continue
            own = [parts[i] for i in some]
            t = self._joined(own)
            ends = np.cumsum([len(p.encode()) + 1 for p in own])
            if t is not None and _among(ends, t[2]).all() and _among(ends, t[3]).all():
                for i, d in zip(some, self._digests(ends, *t)):
                    out[i] = d
            elif len(some) > 1:
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]
            else:
                alone += some
        for i, t in zip(alone, self.tokens([parts[i] for i in alone]) if alone else []):
            if t is not None:
                ids_and_ends = [np.array(x) for x in t]
                out[i] = next(self._digests(ids_and_ends[2][-1:], *ids_and_ends))
        return out

    def _digests(self, unit_ends: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple]:
        """Digests of units from the tokens of their joined text."""
        a_last, b_last = _among(a_ends, b_ends), _among(b_ends, a_ends)
        both = a_ends[a_last]  # ends of groups
        # between two ends of any tokens just one token of either side goes on: a link
        ends = np.sort(np.r_[a_ends, b_ends[~b_last]], kind="stable")
        pairs = a_ids[np.searchsorted(a_ends, ends)] * self.b_size + b_ids[np.searchsorted(b_ends, ends)]
        # order of writing: by group, A before B
        a_group, b_group = (np.cumsum(x) - x for x in (a_last, b_last))
        order = np.argsort(np.r_[2 * a_group, 2 * b_group + 1], kind="stable")
        words = [self._a_text[k][i] for i, k in zip(a_ids.tolist(), a_last.tolist())] + [self._b_text[k][i] for i, k in zip(b_ids.tolist(), b_last.tolist())]
        words = [words[i] for i in order.tolist()]
        upto = [np.searchsorted(x, unit_ends, side="right") for x in (a_ends, b_ends, both, ends)]
        n_a, n_b, n_groups = (np.diff(x, prepend=0).tolist() for x in upto[:3])
        write = np.r_[0, upto[0] + upto[1]].tolist()
        links = np.r_[0, upto[3]].tolist()
        for k in range(len(unit_ends)):
            yield n_a[k], n_b[k], n_groups[k], "".join(words[write[k] : write[k + 1]]), pairs[links[k] : links[k + 1]].tobytes()

    def entries(self, texts: Sequence[list[str]]) -> list[list[tuple | None]]:
        """The digests of every text's units, by units cached over texts."""
        new, old = self._new, self._old
        missing = set().union(*texts).difference(new)
        if len(new) + len(missing) > CACHE_UNITS:
            self._old = old = new
            self._new = new = {}
            missing = set().union(*texts)
        found = {u: old[u] for u in missing if u in old}
        unknown = sorted(missing.difference(found))
        for at in range(0, len(unknown), 4096):
            some = unknown[at : at + 4096]
            found.update(zip(some, self.digests(some)))
        new.update((u, e) for u, e in found.items() if len(u) <= CACHED_CHARS)
        long = {u: e for u, e in found.items() if len(u) > CACHED_CHARS}
        get = (lambda u: long[u] if u in long else new[u]) if long else new.__getitem__
        return [list(map(get, t)) for t in texts]


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(a_spec: str, b_model: bytes) -> Aligner:
    """One per worker process and pair of files."""
    key = hashlib.sha256(a_spec.encode() + b_model).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_spec, b_model)
    return _ALIGNERS[key]


def read_files(a_path: str, b_path: str) -> tuple[str, bytes]:
    """The two tokenizer files, read on the driver; tasks get their contents."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


_ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<long>, b_ends array<long>"


def align(docs: DataFrame, files: tuple[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of both tokenizers and the end byte of each token in space +
    text, for every row; two tokens are linked where their byte ranges overlap,
    and a common end closes a group. Empty arrays for null and empty texts and
    for those that a tokenizer does not give back byte by byte. Repeated rows
    give repeated results, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(b: pa.RecordBatch) -> dict:
        al = aligner(*shared.value)
        rows: list[Tokens] = []
        for text in b.column(1).to_pylist():
            whole: Tokens = ([], [], [], [])
            parts = units(text) if text else []
            at = 0
            for k in range(0, len(parts), 4096):
                for part, t in zip(parts[k : k + 4096], al.tokens(parts[k : k + 4096])):
                    if t is None:
                        parts = []
                        break
                    for column, values, by in zip(whole, t, (0, 0, at, at)):
                        column.extend([v + by for v in values])
                    at += 1 + len(part.encode())
            rows.append(whole if parts else ([], [], [], []))
        return {"doc_id": b.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(("a_ids", "b_ids", "a_ends", "b_ends"))}

    return map_arrow(_source(docs, id_col, text_col), run, _ALIGNED)


_CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
    "pairs array<long>, docs array<long>, ends array<long>, places binary, times binary"
)
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _chunk(al: Aligner, rows: list[tuple[int | None, str]]) -> tuple:
    """The fields of one chunk's row but its number."""
    parts = [units(t) if t else [] for _, t in rows]
    sizes, shas, own, times = [], [], [], []
    for at in range(0, len(rows), 64):
        for entries in al.entries(parts[at : at + 64]):
            if not entries or None in entries:
                sizes.append((0, 0, 0))
                shas.append("")
                entries = []
            else:
                n_a, n_b, n_groups, groups, _ = zip(*entries)
                sizes.append((sum(n_a), sum(n_b), sum(n_groups)))
                shas.append(hashlib.sha256("".join(groups)[:-1].encode()).hexdigest())
            pair, n = np.unique(np.frombuffer(b"".join([e[4] for e in entries]), np.int64), return_counts=True)
            own.append(pair)
            times.append(n)
    pairs, places, held = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(p) for p in own])
    return (
        [d for d, _ in rows], *map(list, zip(*sizes)), shas, pairs, held, ends,
        places.astype(np.int32).tobytes(), np.concatenate(times).astype(np.int32).tobytes(),
    )


def link_chunks(docs: DataFrame, files: tuple[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk of texts; its number is that of the task and of the chunk
    in it, so the rows are to be written before they are read twice."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(files)
    out = arrow_schema(spark, _CHUNK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*shared.value)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple[int | None, str]] = []
        chars = 0

        def full() -> pa.RecordBatch:
            nonlocal number, chars
            row = (number, *_chunk(al, rows))
            number, chars = number + 1, 0
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out)], schema=out)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.append((doc, text))
                    chars += len(text)
                    if chars >= CHUNK_CHARS or len(rows) == CHUNK_ROWS:
                        yield full()
        if rows:
            yield full()

    return _source(docs, id_col, text_col).mapInArrow(lean(run), _CHUNK)


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """pair (A id times ``b_size`` plus B id), n (texts that hold it linked) and
    best (whether no pair of its A id has more)."""
    held = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    path = scratch_path(chunks.sparkSession, "pair-counts")
    counts.write.parquet(path)
    counts = chunks.sparkSession.read.parquet(path).withColumn("a", F.expr(f"pair div {b_size}"))
    # at most one row an A id
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_digests(docs: DataFrame, files: tuple[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: numbers of tokens, groups and links, and how the links' id pairs
    stand in the whole table: n_best links whose pair is its A id's most
    frequent (ties included), count_sum over the links' counts.

    A pair counts once for every row that holds it linked, repeated rows each.
    Null and empty texts and those without tokens give zeros and ''. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "link-chunks")
    link_chunks(docs, files, id_col, text_col).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.parquet(path)
    b_size = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    wanted = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    counts = wanted.join(pair_counts(chunks, b_size), "pair").select("chunk", "place", "n", "best")
    rows = spark.read.parquet(path).drop("pairs", "docs")
    out = arrow_schema(spark, _OUT)

    def finish(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        tables = [_finish_chunk({n: c[i] for n, c in zip(chunk.column_names, chunk.columns)}, counted, out) for i in range(chunk.num_rows)]
        return pa.concat_tables([out.empty_table(), *tables])

    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(finish, _OUT)


def _finish_chunk(row: dict, counted: pa.Table, schema: pa.Schema) -> pa.Table:
    n, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
    place = counted["place"].to_numpy()
    n[place] = counted["n"].to_numpy()
    best[place] = counted["best"].to_numpy().astype(np.int64)
    places = np.frombuffer(row["places"].as_py(), np.int32)
    times = np.frombuffer(row["times"].as_py(), np.int32).astype(np.int64)
    ends = row["ends"].values.to_numpy()

    def per_text(values: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(values)][np.r_[0, ends]]
        return np.diff(upto)

    sums = {"n_links": per_text(times), "n_best": per_text(times * best[places]), "count_sum": per_text(times * n[places])}
    return pa.Table.from_arrays([pa.array(sums[f.name]) if f.name in sums else row[f.name].values for f in schema], schema=schema)
