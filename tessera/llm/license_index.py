"""Licence scans with a positional rare-token index, in DataFrame functions only.

The index lists the words of licence phrases with their places: a posting is
(word, template, offset, length). Document frequencies of the licence words,
over all documents, make the highest-IDF words; of every template the rarest
word of its mandatory key phrase is looked up in every file. A file without
any of them has no match and goes no further. Elsewhere each licence word at
position p that a template has at offset o votes for the start p - o, and the
votes for one start are intersected: a template stands there when its key
phrase is whole and enough of its other words are in place.

Because the looked-up word belongs to the key phrase, no place is missed
whichever word is the rarest. Bounds: templates and their words are a fixed
list; word positions are read in the row of their file, and only positions of
licence words (in files that have a rare one) become rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, pinned


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: mandatory key phrase: part of the text
    key: str
    base: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(self.text.split())

    @property
    def key_at(self) -> int:
        w, k = self.words, tuple(self.key.split())
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)

    @property
    def key_offsets(self) -> range:
        return range(self.key_at, self.key_at + len(self.key.split()))


# The phrases and labels of the contract, then further notices.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this program is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    # the licences' own notices and bodies, several keys a label
    *(
        Template(label, key, key)
        for label, keys in {
            "mit": (
                "the mit license mit",
                "permission is hereby granted free of charge to any person obtaining a copy",
                "to deal in the software without restriction",
            ),
            "apache-2": ("apache license 2 0", "apache 2 0 license", "apache software license version 2"),
            "gpl-3": (
                "gnu general public license as published by the free software foundation either version 3",
                "gnu general public license as published by the free software foundation version 3",
                "gnu general public license v3",
                "gnu gpl version 3",
                "gnu gpl v3",
            ),
            "gpl-2": (
                "gnu general public license as published by the free software foundation either version 2",
                "gnu general public license as published by the free software foundation version 2",
                "gnu general public license v2",
                "gnu gpl version 2",
                "gnu gpl v2",
            ),
            "lgpl": ("gnu library general public license",),
            "agpl": (
                "gnu affero general public license as published by",
                "under the gnu affero general public license",
                "gnu affero general public license version 3 19 november 2007",
                "gnu affero general public license v3",
            ),
            "mpl-2": ("mozilla public license version 2", "mozilla public license 2 0", "mozilla public license v2"),
            "epl": ("eclipse public license",),
            "bsd": ("redistributions of source code must retain the above copyright notice", "bsd license", "bsd style license", "bsd 2 clause", "bsd 3 clause"),
            "isc": (
                "isc license",
                "fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
            ),
            "cc0": (
                "cc0 1 0",
                "creative commons zero",
                "creative commons cc0",
                "has waived all copyright and related or neighboring rights",
                "creativecommons org publicdomain zero",
            ),
            "cc-by": ("creative commons attribution 4 0", "creative commons attribution 3 0", "creative commons attribution license", "cc by 4 0", "cc by 3 0", "creativecommons org licenses by 4 0", "creativecommons org licenses by 3 0"),
            "cc-by-sa": ("creative commons attribution sharealike", "creative commons attribution share alike", "creativecommons org licenses by sa"),
            "cc-by-nd": ("creative commons attribution noderivatives", "creative commons attribution noderivs", "cc by nd", "creativecommons org licenses by nd"),
            "cc-by-nc": ("creative commons attribution noncommercial", "creative commons attribution non commercial", "creativecommons org licenses by nc"),
        }.items()
        for key in keys
    ),
    *(
        Template(label, f"spdx license identifier {name}", f"spdx license identifier {name}")
        for label, name in (
            ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-3", "gpl 3 0"), ("gpl-2", "gpl 2 0"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl-2", "mpl 2 0"), ("epl", "epl"),
            ("bsd", "bsd"), ("isc", "isc"), ("cc0", "cc0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa"), ("cc-by-nd", "cc by nd"), ("cc-by-nc", "cc by nc"),
        )
    ),
)
#: Share of a template's words that must be in place, its key phrase always.
LEAST_SHARE = 0.5

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def idf(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> dict[str, int]:
    """Number of documents with each licence word, over all documents: one row
    a word of the fixed templates."""
    vocabulary = sorted({w for t in templates for w in t.words})
    have = F.array_intersect(words(F.col(f"`{text_col}`")), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(have).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counts}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words and places (array of start, label, base, share; sorted) of every row.

    Places are word positions from 0. Null, empty and wordless texts have no
    word and no place. Rows that repeat an id are separate rows; an empty
    table gives an empty result; only the two columns are read.
    """
    spark = docs.sparkSession
    frequency = idf(docs, text_col, templates)
    rare = sorted({min((t.words[i] for i in t.key_offsets), key=lambda w: (frequency[w], w)) for t in templates})
    vocabulary = sorted(frequency)
    postings = spark.createDataFrame(
        [(w, n, o, len(t.words), o in t.key_offsets, len(t.key.split()), t.label, t.base) for n, t in enumerate(templates) for o, w in enumerate(t.words)],
        "word string, template int, offset int, length int, key boolean, keys int, label string, base boolean",
    )
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words(F.col(f"`{text_col}`")).alias("words"))
    # a narrow row of each document; only files with a rare word carry positions
    has_rare = F.arrays_overlap("words", F.array(*map(F.lit, rare)))
    is_word = F.array(*map(F.lit, vocabulary))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(is_word, w), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    files = pinned(src.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(has_rare, at).alias("hits")))
    hits = files.where("hits is not null").select("row", F.explode("hits").alias("h")).select("row", "h.*")
    votes = hits.join(F.broadcast(postings), "word").withColumn("start", F.col("at") - F.col("offset"))
    spots = votes.groupBy("row", "template", "label", "base", "length", "keys", "start").agg(F.count(F.lit(1)).alias("agree"), F.count_if("key").alias("key_agree"))
    spots = spots.where((F.col("key_agree") == F.col("keys")) & (F.col("agree") >= F.col("length") * least_share))
    # a start may be before the text: a notice may lack its beginning
    share = F.round(F.col("agree") / F.col("length"), 6)
    found = spots.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "label", "base", share.alias("share")))).alias("places"))
    none = F.array().cast("array<struct<start:long,label:string,base:boolean,share:double>>")
    return files.drop("hits").join(found, "row", "left").select("doc_id", "n_words", F.coalesce("places", none).alias("places"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("places", lambda p: p["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
