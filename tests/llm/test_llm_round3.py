"""Token alignment, collocations and toxicity against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_operators import EDGES, EXTRA, SF, edges, empty  # noqa: F401
from tokenizers import Tokenizer

import public_tokenizers
from tessera.llm import collocation, queries, token_alignment, toxicity

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def files():
    return token_alignment.read_files(A_PATH, B_PATH)


def labels_of(spark, rows):
    return spark.createDataFrame([(d, q, t, *["x"] * len(EXTRA)) for d, q, t in rows], "doc_id long, quality int, toxic int, " + ", ".join(f"{c} string" for c in EXTRA))


def operators(spark):
    both = token_alignment.read_files(A_PATH, B_PATH)
    labels = labels_of(spark, [(d, 1, d % 2) for d in range(12)] + [(3, 1, 0), (None, 1, 1), (4, None, None)])
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "alignment": lambda d: token_alignment.link_digests(d, both),
        "aligned": lambda d: token_alignment.align(d, both),
    }


@pytest.mark.parametrize("name", ["toxicity", "alignment", "aligned"])
def test_edge_rows_and_empty_table(name, spark, edges, empty):  # noqa: F811
    op = operators(spark)[name]
    got = op(edges).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in EDGES)
    assert sorted(map(repr, op(edges.repartition(2)).collect())) == sorted(map(repr, got))  # reruns agree
    assert op(empty).count() == 0


# ---------------------------------------------------------------- 12


def brute_tokens(a, b, a_bytes, text):
    """Both tokenizers over the whole text at once: ids and token bytes."""
    whole = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts = [a_bytes[i] for i in a_ids]
    b_parts = []
    for i in b_ids:
        p = b.id_to_piece(i)
        b_parts.append(bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
        return [], [], [], []
    return a_ids, b_ids, np.cumsum([len(x) for x in a_parts]).tolist(), np.cumsum([len(x) for x in b_parts]).tolist()


def brute_links(rows):
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b_: chr(b_) for b_ in visible}
    hidden = iter(range(256, 600))
    for x in range(256):
        letter.setdefault(x, None) or letter.__setitem__(x, chr(next(hidden)))
    back = {c: x for x, c in letter.items()}
    a_bytes = {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    out, counts = [], Counter()
    for doc, text in rows:
        a_ids, b_ids, a_ends, b_ends = brute_tokens(a, b, a_bytes, text or "")
        links = []
        for i, x in enumerate(a_ids):
            a_from = a_ends[i - 1] if i else 0
            for j, y in enumerate(b_ids):
                if (b_ends[j - 1] if j else 0) < a_ends[i] and a_from < b_ends[j]:
                    links.append((x, y))
        cut = sorted(set(a_ends) & set(b_ends))
        groups, at = [], 0
        for c in cut:
            groups.append(",".join(str(x) for x, e in zip(a_ids, a_ends) if at < e <= c) + "|" + ",".join(str(y) for y, e in zip(b_ids, b_ends) if at < e <= c))
            at = c
        counts.update(set(links))
        out.append((doc, a_ids, b_ids, a_ends, b_ends, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    digest = [
        (d, len(a_ids), len(b_ids), len(g), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a_ids, b_ids, _, _, g, ls in out
    ]
    return digest, [(d, *x) for d, *x, _, _ in out]


ODD_TEXTS = [
    " lead", "trail ", " ", "  ", "a  b", "a \n b", "a\n b", "tab\t x", "nb  sp  em", "x\x1c y", "▁", "a▁b c", "日本語 と 漢字 龘龘 鿿x", "\U0001f600\U0001f469‍\U0001f467 z",
    "é ñ", "<s> </s> <unk> <0x41> <|endoftext|>", "a\x00b", "don't we'll I've", "ﬀ ﷺ ½", "\r\n\r\n x", "�", "... !!! ???", "ك ت ا ب  مرحبا", "𝔘𝔫𝔦 𐍈", "a" * 300, "é" * 200 + " ok",
]


def test_alignment_against_whole_text_tokenizers(spark, files):
    rng = random.Random(5)
    letters = "ab  \n\té日龘\u2003\U0001f600.'s" * 16 + "▁"
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    digest, tokens = brute_links(rows)
    assert sorted(map(tuple, token_alignment.link_digests(docs, files).collect())) == sorted(digest)
    got = {r["doc_id"]: [list(r[c]) for c in ("a_ids", "b_ids", "a_ends", "b_ends")] for r in token_alignment.align(docs, files).collect()}
    assert got == {d: list(x) for d, *x in tokens}
    zeros = {d for d, n, *_ in digest if n == 0}
    assert {i for i, t in rows if "▁" in t} <= zeros and len(zeros) < len(rows) / 2


def test_alignment_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 4000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = token_alignment.read_files(A_PATH, B_PATH)
    assert sorted(map(tuple, token_alignment.link_digests(docs, both).collect())) == sorted(brute_links(rows)[0])


def test_alignment_chunks_and_caches_change_nothing(spark, files, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    want = sorted(map(tuple, token_alignment.link_digests(docs.coalesce(1), files).collect()))
    monkeypatch.setattr(token_alignment, "CHUNK_ROWS", 7)
    al = token_alignment.Aligner(*files)
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 40)
    texts = [token_alignment.units(r["text"]) for r in docs.collect() if r["text"]]
    small = [al.entries([t])[0] for t in texts]
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 100_000)
    assert small == token_alignment.Aligner(*files).entries(texts)
    assert sorted(map(tuple, token_alignment.link_digests(docs.repartition(5), files).collect())) == want


# ---------------------------------------------------------------- 13


def brute_collocations(rows, least=30, cover=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words) if lang is not None or True else 0
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        hidden = set()
        for q, b in cand.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    p = q[i : i + m]
                    if p in cand and 100 * b >= cover * cand[p]:
                        hidden.add(p)
        scored = []
        for p, a in cand.items():
            if p in hidden:
                continue
            s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        total = sum(x for p, x in c.items() if len(p) == 1)
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "lang string, text string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


@pytest.mark.parametrize("longest", [collocation.LONGEST, 5])
def test_collocations_against_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(collocation, "LONGEST", longest)
    rng = random.Random(11)
    words = ["new", "york", "City", "is", "a", "hot", "dog", "É", "é", "x y", "ﬁ"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", "!?"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "Of The Same Passage by many texts, again and again")] * 40 + [("en", "la " * 3000), ("de", None), ("fr", ""), ("fr", " \t\n")]
    for least, top in ((3, 2000), (30, 2000), (5, 7)):
        got = collocation.collocations(table(spark, rows), min_count=least, top=top)
        assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, 80, top)
    some = collocation.collocations(table(spark, rows), min_count=5, most_words=2, top=None)
    assert {len(r["phrase"].split(" ")) for r in some.collect()} == {2}


def test_collocations_of_nothing(spark):
    assert collocation.collocations(table(spark, [("en", None), (None, "a b"), ("en", "")])).count() == 0
    assert collocation.collocations(table(spark, [("en", "a")]).limit(0)).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    big = 9 * 10**18
    ones = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1)], "lang string, phrase string, f long")
    twos = spark.createDataFrame([("en", "a b", big - 2)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", 2 * big)], "lang string, n long") if 2 * big < 2**63 else spark.createDataFrame([("en", big)], "lang string, n long")
    (r,) = collocation.rank([ones, twos], words).collect()
    assert (r["l"], r["r"], r["score"]) == (big, big - 1, 2000000 * (big - 2) // (2 * big - 1))


def test_chunks_overlap_by_the_window_and_cover_once():
    rng = random.Random(2)
    for _ in range(50):
        runs = [" ".join(str(rng.randint(0, 9)) for _ in range(rng.randint(1, 600))) for _ in range(3)]
        data = "\n".join(runs).encode()
        starts, ends, run = collocation.words_of(data)
        begins = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
        first = collocation.cuts(collocation.word_hashes(np.frombuffer(data, np.uint8), starts, ends), begins).tolist()
        assert set(begins[:-1].tolist()) <= set(first)
        for s, e in zip(first, [*first[1:], len(starts)]):
            assert 0 < e - s <= collocation.LONGEST
            if e not in begins:  # the window that the next chunk begins with lies in one run
                assert any(b <= s and e + collocation.OVERLAP < c for b, c in zip(begins, begins[1:]))
        _, chunks, tails = collocation.chunks_of(data)
        words = [len(c.split()) - (0 if t else collocation.OVERLAP) for c, t in zip(chunks, tails)]
        assert sum(words) == len(starts) and sum(tails) == 3


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    monkeypatch.setattr(collocation, "_BLOCK", 5)
    words = [b"a", b"ab", b"ba", b"\x00", b"aa", b"\xc3\xa9", b"x" * 1000] * 7
    random.Random(3).shuffle(words)
    data = b" ".join(words)
    starts, ends, _ = collocation.words_of(data)
    h = collocation.word_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert len(set(h.tolist())) == 7 and len({(w, x) for w, x in zip(words, h.tolist())}) == 7


def test_collocation_bits_only_let_too_much_through(spark, monkeypatch):
    rows = [("en", "a b c d e f " * 40), ("de", "a b x " * 40)]
    want = brute_collocations(rows)
    monkeypatch.setattr(collocation, "_flags", lambda s, f, n: (32, np.array([0xFFFFFFFF], np.uint32)))
    assert sorted(map(tuple, collocation.collocations(table(spark, rows)).collect())) == want


# ---------------------------------------------------------------- 11


def test_toxicity_features():
    lex = toxicity.Lexicon({"zorgle": 3.0})
    row = lambda t: dict(zip(toxicity.FEATURES, lex.features(t)))
    assert set(lex.features("")) == {0.0} == set(lex.features(" \n "))
    plain = row("you are an idiot")
    assert plain["insult_density"] == 0.25 and plain["second_person_nearest"] == toxicity.NEAR - 3 and plain["obfuscated_hits"] == 0
    assert row("the idiot### met you")["insult_density"] > 0
    for hidden in ("1d1ot", "id**t", "iiidiooot", "i.d.i.o.t", "ídiot", "$tupid", "stuuupid"):
        r = row(f"what an {hidden} that was")
        assert r["insult_density"] > 0 and r["obfuscated_hits"] > 0, hidden
    spaced = row("such an i d i o t he is")
    assert spaced["spaced_words"] > 0 and spaced["insult_density"] > 0
    assert row("ein kleiner Hund and 24 cats, a1b2")["insult_density"] == 0
    assert row("a zorgle")["learned_best"] == 3.0
    loud = row("WHAT A LOSER!! so calm")
    assert loud["capital_hits"] > 0 and loud["exclamations"] > 0 and loud["capital_words"] == 0.4
    assert row("Ünïcode ÄÖÜ ab")["capital_letters"] > 0


def planted(spark, n=1600, seed=3):
    rng = random.Random(seed)
    calm = ["river", "stone", "music", "window", "garden", "paper", "letter", "you", "walk", "blue"]
    bad = ["idiot", "moron", "Zorgle", "worthless", "scum!"]
    docs, labels, toxic = [], [], set()
    for i in range(n):
        words = rng.choices(calm, k=rng.randint(5, 60))
        if rng.random() < 0.2:
            toxic.add(i)
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int((i in toxic) != (rng.random() < 0.02))))
    return spark.createDataFrame(docs, "doc_id long, text string"), labels_of(spark, labels), toxic


def test_toxicity_finds_planted_rows_and_leaves_clean_ones(spark):
    docs, labels, toxic = planted(spark)
    model = toxicity.train(docs, labels)
    assert "zorgle" in model.lexicon.learned and "river" not in model.lexicon.learned
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    assert 0.15 < len(held) / len(got) < 0.35 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] for r in held if r["doc_id"] in toxic]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["doc_id"] not in toxic]) < 0.02


def test_learned_words_are_not_those_of_one_copied_passage(spark):
    rng = random.Random(1)
    calm = [f"w{i}" for i in range(30)]
    text = lambda more: " ".join(rng.choices(calm, k=20) + more + rng.choices(calm, k=3))
    rows = [(text(["the", "copied", "passage"]), 1) for _ in range(30)] + [(text([rng.choice(calm), "zorgle"]), 1) for _ in range(30)] + [(text([]), 0) for _ in range(300)]
    words = toxicity.learned_words(spark.createDataFrame(rows, "text string, y int"), 10)
    assert "zorgle" in words and "passage" not in words


def test_toxicity_never_learns_from_held_out_labels(spark):
    docs, labels, _ = planted(spark, 400)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda y: {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, y)).collect()}
    assert score(labels) == score(other)


def test_toxicity_without_labels(spark):
    docs, labels, _ = planted(spark, 40)
    for y, share in ((labels.limit(0), 0.0), (labels.withColumn("toxic", F.lit(1)), 1.0)):
        assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, y)).collect()} == {share}


def test_toxicity_sample_is_bounded(spark):
    docs, labels, _ = planted(spark, 400)
    got = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 50)
    assert got.count() == 50 and got.where("part not between 0 and 9").count() == 0


def test_registered():
    assert [n for n in range(11, 14) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
