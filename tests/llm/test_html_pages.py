"""Page parsing in linear time, names of furniture, and the deduced template."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import html_template as H

MB = 1 << 20
HARD = {
    "open tags": "a<b ", "odd quotes": "<a \"<b '", "values never closed": "<a =\"<b ='", "tags in values": '="><a "', "names": "<a<", "values over tags": "<a ='>",
    "p in object": "<p><object>", "marked spans": "<span class=ad>", "comments": "<!-- <!x ", "quotes": "<blockquote><p>", "text": "no markup at all ",
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_a_megabyte_takes_seconds(name):
    began = time.process_time()
    H.parse(HARD[name] * (MB // len(HARD[name])))
    assert time.process_time() - began < 5


def test_stray_ends_and_deep_lists_take_seconds():
    began = time.process_time()
    H.parse("<div>" * 60_000 + "</section>" * 60_000)
    H.parse("<li><ul>" + "<x>" * 60_000 + "<li></li>" * 40_000)
    assert time.process_time() - began < 8


@pytest.mark.parametrize(
    "name", "comments-area comments-list cookie-bar sidebar-left footer-wrap related-articles ad-slot adsbygoogle newsletter-box".split()
)
def test_furniture_names_go(name):
    for page in (f"<p>Story text.</p><div class='{name}'>Noise</div>", f"<article><p>Story text.</p><section id={name}><p>Noise</p></section></article>"):
        assert H.main_text(H.parse(page)[1], frozenset()) == "Story text."


@pytest.mark.parametrize("page", [
    "<article class='tag-search'><p>Story text.</p></article>", "<div class='content-with-sidebar'><p>Story text.</p></div>",
    "<article class='related-posts'><p>Story text.</p></article>", "<div class='sidebar-left'><main><p>Story text.</p></main></div>",
])
def test_content_names_stay(page):
    assert H.main_text(H.parse(page)[1], frozenset()) == "Story text."


def test_tags_and_quotes():
    text = lambda page: H.main_text(H.parse(page)[1], frozenset())
    assert text("<p title='a > b'>one</p><p title=\"x\">two</p>") == "one\ntwo"
    assert text("a < b and c > d") == "a < b and c > d"
    assert text("<p title='never closed>one</p>") == "one"
    assert text("<p data-x=it's>one</p><p>it's</p>") == "one\nit's"
    assert text("x <3 y <!-- hidden > --> z <!doctype html> w") == "x <3 y z w"
    assert text("open <p at the end") == "open <p at the end"


# ---------------------------------------------------------------- the template decides


def site(spark, body, n=8, host="h"):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(i, f"http://{host}/{i}", body([word() for _ in range(12)])) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def texts(df):
    return {r["page_id"]: r["text"] for r in H.extract(df).collect()}


def test_pages_without_article_lose_what_repeats(spark):
    body = lambda w: f"<div class=top><span>Welcome to the site</span><b>Since 1999</b></div><div class=mid><p>{' '.join(w)}.</p></div><div class=end>All rights kept by us</div>"
    df, rows = site(spark, body)
    got = texts(df)
    for i, _, page in rows:
        alone = H.main_text(H.parse(page)[1], frozenset())
        assert "Welcome" in alone and "rights" in alone
        assert got[i] in alone and "Welcome" not in got[i] and "rights" not in got[i] and len(got[i].split()) == 12


def test_articles_lose_unnamed_furniture_and_keep_headings(spark):
    body = lambda w: f"<article><h1>{w[0]}</h1><h2>Summary</h2><p>{' '.join(w)}.</p><div>Share this story with a friend</div></article>"
    df, rows = site(spark, body)
    got = texts(df)
    for i, _, page in rows:
        assert "Share this" in H.main_text(H.parse(page)[1], frozenset())
        assert "Share this" not in got[i] and got[i].split("\n")[1] == "Summary" and len(got[i].split("\n")) == 3


# ---------------------------------------------------------------- brute-force deduction


def brute_classes(pages):
    """Classes of equal occurrence vectors, written out."""
    counts = [Counter(t) for t in pages]
    vectors = defaultdict(list)
    for token in set().union(*counts):
        vector = tuple(c[token] for c in counts)
        support = sum(v > 0 for v in vector)
        if support >= H.LEAST_PAGES and support >= H.LEAST_SHARE * len(pages):
            vectors[vector].append(token)
    return sorted(sorted(v) for v in vectors.values() if len(v) >= H.LEAST_SIZE)


def brute_valid(pages, classes):
    """Classes whose tokens come as equal whole units in every page, and whose
    units hold no part of another class's unit without the rest of it."""
    valid = []
    for i, c in enumerate(classes):
        own, order, ok = set(c), None, True
        for page in pages:
            got = [t for t in page if t in own]
            if not got:
                continue
            unit = tuple(got[: len(c)])
            order = order or unit
            ok &= unit == order and len(set(unit)) == len(c) and got == list(unit) * (len(got) // len(c))
        if ok:
            valid.append(i)
    return valid


def test_classes_against_written_out_vectors(spark):
    rng = random.Random(6)
    for seed in range(4):
        n = rng.randint(5, 12)
        pages = []
        for i in range(n):
            page = [1, 2, 3]
            for _ in range(rng.randint(1, 3)):
                page += [10, 11, 1000 + rng.randint(0, 9), 12]
            page += [4, 5] if i else [5, 4]
            page += [2000 + i, 6]
            if rng.random() < 0.1:
                page.remove(6)
            pages.append(page)
        table = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)], "host string, page long, tokens array<long>")
        got = H.candidate_classes(table).collect()
        want = brute_classes(pages)
        assert ([sorted(c) for c in got[0]["classes"]] if got else []) == want
        facts = [H.class_facts(np.array(p), want) for p in pages]
        kept = [i for i in range(len(want)) if all(ok for f in facts for c, _, ok in f if c == i) and len({s for f in facts for c, s, _ in f if c == i}) == 1]
        assert kept == brute_valid(pages, want)
