"""BPE encoding and decoding with tree concatenation.

Long texts are halved again and again until every part is a leaf. Halves are
cut at ASCII white space where there is any, so that no token crosses the cut;
a run of letters or signs that nothing splits is normalised and cut anyway.
Leaves are separate rows that Spark encodes in parallel. Neighbouring halves
of an unsplit run are then joined bottom up: the tokens around the join are
encoded again in a window that doubles until its first token is the left
half's and its last token is the right half's. A token sequence is the BPE
encoding exactly if every adjacent pair is, so the joined sequence is exact.

Texts of at most ``LEAF_CHARS`` code points are one leaf, encoded where they
are read. The vocabulary travels to the tasks as one broadcast value of the
tokenizer file's fixed size. A worker caches the ids of words in two
generations of at most ``CACHE_WORDS`` each: words of the old one that come up
again move to the new one, the others go when the new one is full.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tessera.llm.common import arrow_schema, lean, shuffle_width

LEAF_CHARS = 16_384
LEAF_SYMBOLS = 4_096
CACHE_WORDS = 100_000

_CHUNK = re.compile(r"[^ \t\n\r]+")
# ASCII signs between a letter or digit and white space: a token of their own
_TAIL = re.compile(r"(?<=[^\W_])([!-&(-/:-@\[-^`{-~]+)(?=[ \n])")
# beyond Latin letters, or perhaps a special token: not put in lower case here
_AS_IS = re.compile(r"[^\x00-\u024f]|<\|")
# words that are one token group each: many are encoded in one call
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_SPACES = " \t\n\r"


class Encoder:
    """One tokenizer file: whole texts by cached words, unsplit runs by tree."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(spec)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self._spec = spec
        self._new: dict[str, bytes] = {}  # word to its ids as int32
        self._old: dict[str, bytes] = {}
        self._pieces: dict[int, str] = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self._ends = np.zeros(max(self._pieces) + 1, bool)
        self._ends[[i for i, t in self._pieces.items() if self.suffix and t.endswith(self.suffix)]] = True

    def _part_tokenizer(self, suffix: str | None) -> Tokenizer:
        """The merges alone, for parts of a run; made when a run needs it."""
        model = json.loads(self._spec)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        more = {"end_of_word_suffix": suffix} if suffix else {}
        return Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, unk_token=model["unk_token"], **more))

    @cached_property
    def _inner(self) -> Tokenizer:
        return self._part_tokenizer(None)

    @cached_property
    def _last(self) -> Tokenizer:
        return self._part_tokenizer(self.suffix or None)

    def decoded(self, ids: Iterable[int]) -> str:
        """decode(ids, skip_special_tokens=False) of a file without a decoder."""
        return " ".join(map(self._pieces.__getitem__, ids))

    def chunk(self, text: str) -> list[int]:
        """Tokens of a text without `[ \\t\\n\\r]`."""
        if len(text) <= LEAF_SYMBOLS:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for run in self.runs(text):
            out += run if isinstance(run, list) else self.tree(self.leaves(run))
        return out

    def plain(self, text: str) -> np.ndarray:
        """Tokens of a text, by words cached over texts."""
        # fewer different words to cache, with the same tokens: the normalizer
        # folds case anyway, and the splitter ends a token where _TAIL cuts
        if not _AS_IS.search(text):
            text = _TAIL.sub(r" \1", text.lower())
        words = _CHUNK.findall(text)
        missing = set(words).difference(self._new)
        if missing:
            if len(self._new) + len(missing) > CACHE_WORDS:
                self._old, self._new = self._new, {}
                missing = set(words)
            self._learn(missing)
        return np.frombuffer(b"".join(map(self._new.__getitem__, words)), np.int32)

    def _learn(self, missing: set[str]) -> None:
        new, old = self._new, self._old
        unknown = []
        for w in missing:
            if w in old:
                new[w] = old[w]
            else:
                unknown.append(w)
        letters = [w for w in unknown if len(w) <= LEAF_SYMBOLS and _LETTERS.fullmatch(w)] if self.suffix else []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, np.int32)
        at = 0
        for w, end in zip(letters, (np.flatnonzero(self._ends[ids]) + 1).tolist()):
            new[w] = ids[at:end].tobytes()
            at = end
        for w in set(unknown).difference(letters):
            new[w] = np.array(self.chunk(w), np.int32).tobytes()

    # ---- unsplit runs

    def runs(self, chunk: str) -> list[list[int] | str]:
        """The chunk's pre-tokens in order: token ids of short ones (and of
        special tokens), the byte-level symbols of long unsplit ones."""
        out: list[list[int] | str] = []
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        parts = re.split("(" + "|".join(map(re.escape, special)) + ")", chunk) if special else [chunk]
        for part in filter(None, parts):
            if part in special:
                out.append([special[part]])
                continue
            text = self.tokenizer.normalizer.normalize_str(part)
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                out.append(word if len(word) > LEAF_SYMBOLS else self._last.encode(word, add_special_tokens=False).ids)
        return out

    @staticmethod
    def leaves(symbols: str) -> list[str]:
        """Repeated halves of at most LEAF_SYMBOLS."""
        if len(symbols) <= LEAF_SYMBOLS:
            return [symbols]
        mid = len(symbols) // 2
        return Encoder.leaves(symbols[:mid]) + Encoder.leaves(symbols[mid:])

    def leaf(self, symbols: str, last: bool) -> list[int]:
        """Tokens of part of a run; only its last part has the word end."""
        return (self._last if last else self._inner).encode(symbols, add_special_tokens=False).ids

    def tree(self, leaves: list[str]) -> list[int]:
        return self.join_all([self.leaf(s, i == len(leaves) - 1) for i, s in enumerate(leaves)])

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Bottom-up joins of the encoded leaves of one run."""
        while len(parts) > 1:
            ends = len(parts)
            parts = [self.join(parts[i], parts[i + 1], i + 2 >= ends) if i + 1 < ends else parts[i] for i in range(0, ends, 2)]
        return parts[0] if parts else []

    def _symbols(self, ids: list[int]) -> str:
        return "".join(map(self._pieces.__getitem__, ids))

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of both halves together; ``last``: right ends the run."""
        if not left or not right:
            return left or right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            ends = last and k >= len(right)
            text = self._symbols(a + b)
            if ends and self.suffix and text.endswith(self.suffix):
                text = text[: -len(self.suffix)]
            mid = self.leaf(text, ends)
            agrees_left = k >= len(left) or mid[0] == a[0]
            agrees_right = k >= len(right) or mid[-1] == b[-1]
            if agrees_left and agrees_right:
                return left[:-k] + mid + right[k:]
            k *= 2


_ENCODERS: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One per worker process and tokenizer file."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def halves(text: str, limit: int = LEAF_CHARS) -> list[str]:
    """The text cut at ASCII white space next to the middle, again and again;
    a part without any stays whole however long it is."""
    done, todo = [], [text]
    while todo:
        t = todo.pop()
        if len(t) <= limit:
            done.append(t)
            continue
        mid = len(t) // 2
        after = _SPACE.search(t, mid)
        cut = after.start() if after else max(t.rfind(c, 0, mid) for c in _SPACES)
        if cut <= 0 or cut >= len(t) - 1:
            inner = t.strip(_SPACES)
            if len(inner) == len(t) or not inner:
                done.append(t)
            else:
                todo.append(inner)
            continue
        todo += [t[cut:], t[:cut]]
    return done


_SPACE = re.compile(r"[ \t\n\r]")

_OUT = "doc_id long, ids array<int>, decoded string"
_LEAF = "doc_id long, row long, seq long, part long, symbols boolean, last boolean, text string"
_DONE = "doc_id long, row long, seq long, part long, symbols boolean, last boolean, ids array<int>"


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of every row, by the tokenizer file ``spec``
    (its JSON text, a file with a normalizer, a word splitter and no decoder).

    The ids equal the library's ``encode(text, add_special_tokens=False)`` and
    decoded its ``decode(ids, skip_special_tokens=False)``. Null, empty and
    blank texts give no ids and an empty decoding; special tokens written in a
    text are encoded as the library does. Repeated rows give repeated results;
    an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    is_long = F.length("text") > LEAF_CHARS
    out, leaf, done = (arrow_schema(spark, s) for s in (_OUT, _LEAF, _DONE))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [enc.plain(t) for t in part.column(1).to_pylist()]
                yield _ids_batch({"doc_id": part.column(0)}, got, out, decoded=[enc.decoded(g.tolist()) for g in got])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            for doc, row, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows = [(doc, row, *x) for x in _leaves(enc, text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), leaf)], schema=leaf)

    def encode_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            ids = [np.array(enc.leaf(t, last), np.int32) if s else enc.plain(t) for s, last, t in zip(*(b.column(i).to_pylist() for i in (4, 5, 6)))]
            yield _ids_batch({n: b.column(i) for i, n in enumerate(done.names[:-1])}, ids, done)

    def join(table: pa.Table) -> pa.Table:
        enc = encoder(shared.value)
        rows = sorted(zip(*(table[c].to_pylist() for c in ("seq", "part", "symbols", "ids"))), key=lambda r: r[:2])
        ids: list[int] = []
        run: list[list[int]] = []
        for i, (seq, _, symbols, tokens) in enumerate(rows):
            if not symbols:
                ids += tokens
                continue
            run.append(tokens)
            if i + 1 == len(rows) or rows[i + 1][0] != seq:
                ids += enc.join_all(run)
                run = []
        b = _ids_batch({"doc_id": table["doc_id"].slice(0, 1).combine_chunks()}, [np.array(ids, np.int32)], out, decoded=[enc.decoded(ids)])
        return pa.Table.from_batches([b])

    short = src.where(~is_long).mapInArrow(lean(whole), _OUT)
    rows = src.where(is_long).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = rows.mapInArrow(lean(cut), _LEAF).repartition(shuffle_width(docs), "row", "seq", "part")
    long = parts.mapInArrow(lean(encode_leaves), _DONE).groupBy("row").applyInArrow(join, _OUT)
    return short.unionByName(long)


def _leaves(enc: Encoder, text: str) -> list[tuple[int, int, bool, bool, str]]:
    """(seq, part, symbols, last, text) of the leaves of a long text."""
    out: list[tuple[int, int, bool, bool, str]] = []
    seq = 0
    for piece in halves(text):
        if len(piece) <= LEAF_CHARS or _SPACE.search(piece):
            out.append((seq, 0, False, False, piece))
            seq += 1
            continue
        # one unsplit run of the text: its long pre-tokens become leaves
        for run in enc.runs(piece):
            if isinstance(run, list):
                leaves = [enc._symbols(run)]
                if leaves[0].endswith(enc.suffix) and enc.suffix:
                    out.append((seq, 0, True, True, leaves[0][: -len(enc.suffix)]))
                else:  # a special token's own string
                    out.append((seq, 0, False, False, leaves[0]))
            else:
                leaves = enc.leaves(run)
                out += [(seq, i, True, i == len(leaves) - 1, s) for i, s in enumerate(leaves)]
            seq += 1
    return out


def _ids_batch(cols: dict, ids: list[np.ndarray], schema: pa.Schema, decoded: list[str] | None = None) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
    cols = dict(cols, ids=pa.ListArray.from_arrays(pa.array(ends), flat))
    if decoded is not None:
        cols["decoded"] = pa.array(decoded, pa.string())
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in (cols[n] for n in schema.names)]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows, and ``more`` columns."""
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
