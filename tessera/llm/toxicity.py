"""Toxicity by gradient-boosted trees over dense features.

Features of a whole text (FEATURES): densities of lexicon words by kind, how
close second-person words stand to them, capitals, punctuation, and the rates of
obfuscated spellings (letters for digits and signs, masked, stretched and
spaced-out words). Beside the stated lexicons there is a learned one: words
that labelled toxic texts hold far more often than others.

A bounded sample of labelled rows, ``sample_rows`` by hash of the id, is dealt
into three parts that share no text: the first gives the learned words, the
second the trees, the third the isotonic calibration of their margin, so that
neither trees nor calibration see words that their own rows have chosen. Trees
and calibration are MLlib's; scoring is one map over the texts and two model transforms.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, lean, pinned

# fixed values: common words of abuse in English, French, German and Spanish
INSULT = """
    idiot idiots moron morons stupid loser losers clown clowns trash garbage scum pathetic worthless disgusting dumb
    fool fools imbecile jerk jerks creep freak pig pigs rat rats vermin filth coward cowards liar liars useless ugly
    dimwit halfwit dunce nitwit scumbag dirtbag lowlife degenerate brainless spineless repulsive despicable
    idiote idiots imbécile crétin crétins débile abruti nul minable ordure connard
    dumm dummkopf idioten trottel depp versager abschaum widerlich wertlos schwachkopf
    idiota idiotas estúpido estúpida imbécil tonto payaso basura asqueroso patético inútil perdedor escoria
""".split()
PROFANITY = """
    damn crap shit bullshit fuck fucking fucked fucker ass asshole bitch bastard piss prick douche
    merde putain salaud salope scheiße scheisse arschloch verdammt mierda joder cabrón puta
""".split()
THREAT = """
    kill die hurt destroy burn hang shoot strangle murder beat punish crawl rot
    crève tuer mourir sterben töten verrecke matar morir muérete
""".split()
SECOND_PERSON = """
    you your yours yourself yourselves u ur youre you're ya tu te toi ton ta tes vous votre vos du dich dir dein deine
    deiner ihr euch euer eure sie usted ustedes tú ti tus vosotros vuestro
""".split()

KINDS = {"insult": INSULT, "profanity": PROFANITY, "threat": THREAT}
FEATURES = (
    "insult_density", "profanity_density", "threat_density", "learned_density", "insult_count", "strong_count", "learned_count",
    "learned_best", "second_person_density", "second_person_closeness", "second_person_nearest", "capital_letters", "capital_words", "capital_hits",
    "exclamations", "questions", "signs", "sign_words", "mixed_words", "stretched_words", "masked_words", "spaced_words", "obfuscated_hits", "log_words",
)

# bits of a token's flags
_INSULT, _PROFANITY, _THREAT, _LEARNED, _PERSON, _CAPS, _SIGNS, _MIXED, _STRETCHED, _MASKED, _HIDDEN, _LETTER, _LONG = (1 << i for i in range(13))
_HIT = _INSULT | _PROFANITY | _THREAT | _LEARNED
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
_RUN, _LONG_RUN = re.compile(r"(.)\1+"), re.compile(r"(.)\1{2,}")
_THRICE = re.compile(r"(\w)\1\1")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…«»„“”‘’–—¡¿"
_CACHED = 150_000
_TOKEN = 64
NEAR = 10
SPACED = 4
#: Rows of the calibration that are averaged before it is fitted.
BLOCK = 25


@dataclass(frozen=True)
class Lexicon:
    """Learned words with their log odds, beside the stated kinds."""

    learned: dict[str, float]

    def __post_init__(self):
        plain = {}
        for bit, words in zip((_INSULT, _PROFANITY, _THREAT), KINDS.values()):
            for w in words:
                plain[w] = plain.get(w, 0) | bit
        for w in self.learned:
            plain[w] = plain.get(w, 0) | _LEARNED
        object.__setattr__(self, "plain", plain)
        object.__setattr__(self, "person", frozenset(SECOND_PERSON))
        by_shape: dict[tuple[str, int], list[str]] = {}
        for w, bits in plain.items():
            if bits & ~_LEARNED:
                by_shape.setdefault((w[0], len(w)), []).append(w)
        object.__setattr__(self, "by_shape", by_shape)
        # flags of known tokens, in two generations of at most _CACHED each
        object.__setattr__(self, "cache", {})
        object.__setattr__(self, "old", {})

    def hidden(self, core: str) -> int:
        """Lexicon bits of a word in another spelling, else 0."""
        if "*" in core:
            for w in self.by_shape.get((core[0], len(core)), ()):
                if all(a in (b, "*") for a, b in zip(core, w)) and core.count("*") * 2 <= len(core):
                    return self.plain[w]
        read = core.translate(_LEET)
        if not read.isascii():
            read = unicodedata.normalize("NFKD", read)
        if not read.isalpha():
            read = "".join(filter(str.isalpha, read))
        forms = (read, _LONG_RUN.sub(r"\1\1", read), _RUN.sub(r"\1", read)) if _RUN.search(read) else (read,)
        for form in forms:
            if len(form) > 2 and form != core and form in self.plain:
                return self.plain[form] & ~_LEARNED
        return 0

    def flags(self, token: str) -> int:
        """Flags of one run of characters without white space, remembered."""
        out = self.old.get(token)
        if out is None:
            out = self._flags(token)
        if len(token) <= _TOKEN:
            if len(self.cache) >= _CACHED:
                self.old.clear()
                self.old.update(self.cache)
                self.cache.clear()
            self.cache[token] = out
        return out

    def _flags(self, token: str) -> int:
        core = token.strip(_EDGE)
        low = core.lower()
        out = self.plain.get(low, 0)
        if low in self.person:
            out |= _PERSON
        if len(core) > 1 and core.isupper():
            out |= _CAPS
        if len(core) == 1 and core.isalpha():
            out |= _LETTER
        if len(token) - len(core) > 2:
            out |= _SIGNS
        if len(token) > _TOKEN:
            return out | _LONG
        if not low.isalpha() and core:
            if any(map(str.isalpha, core)):
                out |= _MASKED if "*" in core else _MIXED
        if len(low) > 3 and _THRICE.search(low):
            out |= _STRETCHED
        # another spelling is tried where the word itself gives cause
        if not out & _HIT and len(core) > 2 and (out & (_MIXED | _MASKED | _STRETCHED) or not low.isascii() or token[0] in "@$" or "!" in token[:-1]):
            bits = self.hidden(low if out & (_MIXED | _MASKED | _STRETCHED) else token.lower().strip(".,;:?\"'()")) & _HIT
            if bits:
                out |= bits | _HIDDEN
        return out

    def features(self, text: str) -> list[float]:
        """FEATURES of a text; an empty or blank one gives zeros."""
        tokens = text.split()
        if not tokens:
            return [0.0] * len(FEATURES)
        known = list(map(self.cache.get, tokens))
        if None in known:
            known = [self.flags(t) if f is None else f for f, t in zip(known, tokens)]
        flags = np.array(known, np.int64)
        spaced, more = self._spaced(tokens, flags)
        n = len(tokens)
        count = lambda bit: int(np.count_nonzero(flags & bit))
        hits = np.flatnonzero(flags & _HIT)
        person = np.flatnonzero(flags & _PERSON)
        closeness = nearest = 0.0
        if len(hits) and len(person):
            at = np.searchsorted(person, hits)
            gap = np.minimum(np.abs(hits - person[np.minimum(at, len(person) - 1)]), np.abs(hits - person[np.maximum(at - 1, 0)]))
            closeness = float(np.mean(1.0 / (1 + gap)))
            nearest = float(np.maximum(0, NEAR - gap.min()))
        insult = count(_INSULT) + more
        strong = count(_PROFANITY | _THREAT)
        learned = count(_LEARNED)
        best = max((self.learned.get(tokens[i].strip(_EDGE).lower(), 0.0) for i in np.flatnonzero(flags & _LEARNED)), default=0.0)
        upper = lower = 0
        letters = text if text.isascii() else None
        if letters is not None:
            data = np.frombuffer(text.encode(), np.uint8)
            upper = int(np.count_nonzero((data >= 65) & (data <= 90)))
            lower = int(np.count_nonzero((data >= 97) & (data <= 122)))
        else:
            folded = text.lower()
            upper = sum(map(str.isupper, text)) if folded != text else 0
            lower = sum(map(str.isalpha, text)) - upper
        signs = sum(map(text.count, "#$%&*@!?^~"))
        per = 1.0 / n
        return [
            insult * per, count(_PROFANITY) * per, count(_THREAT) * per, learned * per, math.log1p(insult), math.log1p(strong), math.log1p(learned),
            best, len(person) * per, closeness, nearest, upper / max(1, upper + lower), count(_CAPS) * per, count(_CAPS) and int(np.count_nonzero((flags & _CAPS > 0) & (flags & _HIT > 0))) * per,
            text.count("!") * per, text.count("?") * per, signs / len(text), count(_SIGNS) * per, count(_MIXED) * per, count(_STRETCHED) * per, count(_MASKED) * per, spaced * per, (count(_HIDDEN) + more) * per, math.log(n + 1),
        ]

    def _spaced(self, tokens: list[str], flags: np.ndarray) -> tuple[int, int]:
        """Letters written apart: how many in runs of SPACED or more, and how
        many of those runs hold a word of the stated lexicons."""
        single = np.r_[False, (flags & _LETTER) > 0, False]
        edge = np.flatnonzero(single[1:] != single[:-1])
        total = found = 0
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= SPACED:
                total += e - s
                word = "".join(t.strip(_EDGE) for t in tokens[s:e]).lower()
                found += any(word[i : i + k] in self.plain for k in range(SPACED, min(e - s, 12) + 1) for i in range(e - s - k + 1))
        return total, found


@dataclass(frozen=True)
class Model:
    """Without trees (nothing labelled, or one class alone) every score is ``share``."""

    lexicon: Lexicon
    share: float
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """crc32 of the id as text, by remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """text, y and part (0 to 9, by the text) of at most ``rows`` labelled
    documents outside the held-out fold, the first by a hash of the id. An id
    with several labels counts as toxic if one says so."""
    y = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    y = y.where(~held_out(F.col("id"))).groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").limit(rows)
    ids = pinned(y)  # at most ``rows`` rows
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = src.join(F.broadcast(ids), "id")
    return found.select("text", "y", F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(10)).alias("part"))


def learned_words(sample: DataFrame, most: int, least_texts: int = 10, least_z: float = 6.0) -> dict[str, float]:
    """Words of labelled toxic texts with their log odds: in at least
    ``least_texts`` of them, after as many different words (a passage that is
    copied from text to text gives its words but one), and with a share above that
    of the other texts by ``least_z`` standard errors; the ``most`` strongest."""
    sizes = sample.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).first()
    if not sizes["n1"] or not sizes["n0"]:
        return {}
    split = sample.select("y", F.split(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+").alias("words"))
    fits = F.length("word").between(3, _TOKEN)
    seen = split.select("y", F.explode(F.array_distinct("words")).alias("word")).where(fits)
    seen = seen.groupBy("word").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")).where(F.col("c1") >= least_texts)
    before = F.arrays_zip(F.concat(F.array(F.lit("")), "words").alias("before"), F.col("words").alias("word"))
    pairs = split.where("y = 1").select(F.explode(before).alias("p")).select("p.*").where(fits).distinct()
    varied = pairs.groupBy("word").count().where(F.col("count") >= least_texts).select("word")
    odds = F.log((F.col("c1") + 0.5) / (sizes["n1"] + 1.0)) - F.log((F.col("c0") + 0.5) / (sizes["n0"] + 1.0))
    n1, n0 = F.lit(float(sizes["n1"])), F.lit(float(sizes["n0"]))
    p = (F.col("c1") + F.col("c0") + 0.5) / (n1 + n0 + 1)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = seen.join(varied, "word").select("word", odds.alias("odds"), z.alias("z")).where(F.col("z") >= least_z)
    return {r["word"]: r["odds"] for r in best.orderBy(F.col("z").desc(), "word").limit(most).collect()}


def featured(rows: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The other columns of ``rows`` and the text's ``features`` as a vector."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon.learned)
    others = [c for c in rows.columns if c != text_col]
    typed = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    schema = f"{typed}, features array<double>"
    out = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(shared.value)
        for b in (part.slice(at, 256) for part in batches for at in range(0, part.num_rows, 256)):
            x = np.array([lex.features(t or "") for t in b.column(len(others)).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], lists.cast(out.field("features").type)], schema=out)

    got = rows.select(*[f"`{c}`" for c in others], f"`{text_col}`").mapInArrow(lean(run), schema)
    return got.withColumn("features", array_to_vector("features"))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 20_000, words: int = 500, trees: int = 20, depth: int = 3, seed: int = 7,
) -> Model:
    """Fits on at most ``sample_rows`` labelled rows: three tenths for the learned
    words, four for the trees, three for the calibration. Held-out rows are not
    read; ids serve to find a row's label, nothing else."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    lexicon = Lexicon(learned_words(sample.where("part < 3"), words))
    rows = featured(sample.where("part >= 3").select("part", F.col("y").cast("double").alias("label"), "text"), lexicon)
    rows = pinned(rows.repartition(8))  # the bounded sample, read by many small jobs
    seen = {(r["grown"], r["label"]): r["count"] for r in rows.groupBy((F.col("part") < 7).alias("grown"), "label").count().collect()}
    total = sum(seen.values())
    share = sum(n for (_, y), n in seen.items() if y == 1) / total if total else 0.0
    if len(seen) < 4:
        return Model(lexicon, share, None, None)
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=20, seed=seed)
    grown = gbt.fit(rows.where("part < 7"))
    margins = grown.transform(rows.where("part >= 7")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    # neighbours by margin are averaged first: no step of the calibration rests
    # on a few rows (one window over a part of the bounded sample)
    block = F.floor((F.row_number().over(Window.orderBy("margin", "label")) - 1) / BLOCK)
    blocks = margins.withColumn("block", block).groupBy("block").agg(F.avg("margin").alias("margin"), F.avg("label").alias("label"), F.count("label").cast("double").alias("weight"))
    return Model(lexicon, share, grown, IsotonicRegression(featuresCol="margin", predictionCol="score", weightCol="weight").fit(blocks))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of every row.

    The score is the calibrated share of label 1 among texts with such a margin.
    Null texts count as empty; empty texts are scored by their features, all
    zero. Repeated rows are reported alike, a very long text is read whole (its
    memory is that of its words); an empty table gives an empty result. Other
    columns are not read.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    if model.trees is None:
        scored = src.select("doc_id", "held_out", F.lit(float(model.share)).alias("score"))
    else:
        grown = model.trees.transform(featured(src, model.lexicon))
        margins = grown.select("doc_id", "held_out", vector_to_array("rawPrediction")[1].alias("margin"))
        scored = model.calibration.transform(margins).select("doc_id", "held_out", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
