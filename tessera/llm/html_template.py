"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: a tag in its path of enclosing blocks, or a
run of text in its path. Over the distinct pages of a host, tokens with the
same occurrence vector (how often they are in which page) form an equivalence
class. A class is large and frequent when it has at least ``LEAST_SIZE``
tokens and is in most pages of a host of some size; it is valid when its
tokens come in one order in every page, as whole units, and when it nests with
the other classes without interleaving. The valid classes, nested, are the
host's template. What is between template tokens are slots: template text goes,
slots in page furniture (menus, adverts, comments and so on, known by element
and class names) go, and the text of the remaining slots is the result.

An occurrence vector is never built: its support, its total and the XOR of
64-bit hashes of (page, count) stand for it, so a host with a third of all
pages is a partial aggregate. A template has fewer tokens than two pages of
its host. Templates meet pages by broadcast only if they are measured small,
else by a join on host and salt.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, arrow_schema, lean, pinned

LEAST_PAGES = 5
LEAST_SHARE = 0.9
LEAST_SIZE = 2
SALTS = 32

# ---------------------------------------------------------------- one page

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I | re.A) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_INLINE_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("span", "label")}
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
_CLOSABLE = frozenset("p li dt dd tr option".split())
LIST_BOUNDS = frozenset("ul ol menu dl table".split())
P_BOUNDS = LIST_BOUNDS | {"article", "main", "body", "div", "section"}
#: Blocks of running text: inside an article, template text in them is content.
TEXT_BLOCKS = frozenset("article h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre caption figcaption table tr".split())

#: Page furniture by element, and by the last word of a class, id or role.
FURNITURE = frozenset("nav header footer aside form button select input object canvas svg video audio map dialog menu head datalist".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification pagination pager popup promo promoted promotion recommended "
    "related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tagcloud teaser toolbar topbar tracking".split()
)
#: Inside an article its own header stays.
ARTICLE_WORDS = FURNITURE_WORDS - {"header", "banner", "byline"}
#: Not furniture themselves: `no-sidebar`, `has-menu`, `with-ads`.
NEGATIONS = frozenset("no has with without not is show hide".split())
#: Furniture as the first word of a name too: `comments-area`, `ad-slot`.
LEADING_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr nav navbar newsletter "
    "pagination popup promo promoted recommended related reply replies respond sharing sidebar sponsor sponsored subscribe".split()
)
#: Beside a furniture word these make the name one of content: `tag-search`, `category-social`.
CONTENT_WORDS = frozenset("article body cat category content entry format post story tag tags term text topic type".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())


def _names(attrs: str) -> Iterator[list[str]]:
    """The words of each class, id and role."""
    for m in _MARKED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            if parts := [w.lower() for w in _WORD.findall(name)]:
                yield parts


def named(attrs: str, in_article: bool) -> bool:
    """Whether a name of the element is a furniture word, ends in one or begins
    with one of LEADING_WORDS, without a content word or a negation beside it."""
    words = ARTICLE_WORDS if in_article else FURNITURE_WORDS
    return bool(attrs) and any((p[-1] in words or p[0] in LEADING_WORDS) and CONTENT_WORDS.isdisjoint(p) and NEGATIONS.isdisjoint(p) for p in _names(attrs))


def furniture(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether the element is page furniture by its kind, or hidden."""
    if tag in FURNITURE and not (tag == "header" and in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    return bool(_HIDDEN.search(attrs))


class Tags:
    """The tags of a page from left to right, in time linear in its length.

    A quote after `=` hides a `>` up to the next one like it; a tag that this
    leaves open to the end of the page ends at its first `>` instead. What a
    search has not found from a place on, no later search looks for again."""

    def __init__(self, page: str):
        self.page = page
        self.none = {c: len(page) + 1 for c in (">", '"', "'")}  # none of these from here on
        self.stuck: set[int] = set()  # places outside quotes from which no tag ends

    def find(self, c: str, at: int) -> int:
        if at >= self.none[c]:
            return -1
        found = self.page.find(c, at)
        if found < 0:
            self.none[c] = at
        return found

    def end(self, at: int) -> int:
        """Place of the `>` that ends a tag whose name ends before ``at``, or -1."""
        seen, place = [], at
        while place not in self.stuck:
            seen.append(place)
            close = self.find(">", place)
            if close < 0:
                break
            q = _QUOTE.search(self.page, place, close)
            while q and (shut := self.find(q[1], q.end())) < 0:  # never closed: no quote
                q = _QUOTE.search(self.page, q.end(), close)
            if not q:
                return close
            place = shut + 1
        self.stuck.update(seen)
        return self.find(">", at)

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name or None, whether it is an end tag, attributes)."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, (end + 3 if end >= 0 else len(page)), None, False, ""
            if page.startswith(("<!", "<?"), start):
                end = self.find(">", start)
                if end >= 0:
                    return start, end + 1, None, False, ""
                return None
            ending = page.startswith("/", start + 1)
            name = _NAME.match(page, start + 1 + ending) if page[start + 1 + ending : start + 2 + ending].isascii() else None
            if name:
                end = self.end(name.end())
                if end < 0:  # no tag ends any more
                    return None
                return start, end + 1, name[0].lower(), ending, page[name.end() : end]
            at = start + 1
        return None


class Run:
    """A run of text: its token, text, block number and where it stands."""

    __slots__ = ("token", "text", "block", "gone", "article", "main", "link", "named", "tag")

    def __init__(self, token, text, block, gone, article, main, link, named, tag):
        self.token, self.text, self.block = token, text, block
        self.gone, self.article, self.main, self.link, self.named, self.tag = gone, article, main, link, named, tag


_known: dict[tuple, int] = {}


def _path(parent: int, name: str, attrs: str) -> int:
    """64-bit hash of a path of blocks with their class, id and role."""
    key = (parent, name, attrs)
    h = _known.get(key)
    if h is None:
        if len(_known) > 50_000:
            _known.clear()
        marks = " ".join(m[1] or m[2] or m[3] or "" for m in _MARKED.finditer(attrs)) if attrs else ""
        h = _known[key] = xxhash.xxh64_intdigest(f"{name} {marks}".encode("utf-8", "surrogatepass"), parent)
    return h


def parse(source: str | None) -> tuple[list[int], list[Run]]:
    """Tokens of the page in order, and its runs of text.

    A block named as furniture goes with all it holds, unless it holds a main
    element or an outermost article; of its articles, comments do not count.
    These two themselves never go by a name."""
    page = source or ""
    tokens: list[int] = []
    runs: list[Run] = []
    # open blocks: tag, path, furniture, in article, in main, blocks around it
    # named as furniture, and the places of the open p and of the open items of
    # the list around it that a next one closes (0: none)
    stack: list[tuple[str, int, bool, bool, bool, tuple[int, ...], dict[str, int]]] = [("", 0, False, False, False, (), {})]
    opened: Counter[str] = Counter()
    spared: set[int] = set()
    block, links, at = 0, 0, 0
    no_end: dict[str, int] = {}  # from here on an inline element of this name has no end

    def text(part: str) -> None:
        if part and not part.isspace():
            clean = entities.unescape(part) if "&" in part else part
            tag, path, gone, article, main, marks, _ = stack[-1]
            token = xxhash.xxh64_intdigest(" ".join(clean.split()).encode("utf-8", "surrogatepass"), path)
            tokens.append(token)
            runs.append(Run(token, clean, block, gone, article, main, links > 0, marks, tag))
        elif part and runs:
            runs[-1].text += " "

    def close(place: int) -> None:
        """Ends the open blocks from ``place`` of the stack on."""
        for name, path, *_ in reversed(stack[place:]):
            tokens.append(path ^ 1)
            opened[name] -= 1
        del stack[place:]

    tags = Tags(page)
    while m := tags.next(at):
        start, end, name, ending, attrs = m
        text(page[at:start])
        at = end
        if name is None:
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if ending else 1))
            if name in ("td", "th") and runs:
                runs[-1].text += " "
            if not ending and name in ("span", "label") and (furniture(name, attrs, stack[-1][3]) or named(attrs, stack[-1][3])):
                # a marked inline element: skip to its end
                shut = _INLINE_END[name].search(page, at) if at < no_end.get(name, len(page)) else None
                if shut:
                    at = shut.end()
                else:
                    no_end[name] = min(at, no_end.get(name, at))
            continue
        if name == "br":
            if runs:
                runs[-1].text += "\n"
            continue
        if name in RAW:
            if not ending and not attrs.endswith("/"):  # what it holds is no markup: only its own end counts
                shut = _RAW_END[name].search(page, at)
                at = shut.end() if shut else len(page)
            continue
        block += 1
        if ending:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        for other in (("p",) if name in CLOSES_P else ()) + CLOSES_SELF.get(name, ()):
            if place := stack[-1][6].get(other, 0):
                close(place)
        _, path, gone, article, main, marks, near = stack[-1]
        path = _path(path, name, attrs)
        tokens.append(path)
        if name in VOID:
            continue
        gone = gone or furniture(name, attrs, article)
        if name == "main" or name == "article" and not article and not (marks and any(p[0] in COMMENT_WORDS or p[-1] in COMMENT_WORDS for p in _names(attrs))):
            if not gone:
                spared.update(marks)
        elif name not in ("html", "body") and named(attrs, article):
            marks += (block,)
        if name in LIST_BOUNDS:
            near = {}
        elif name in P_BOUNDS and "p" in near:
            near = {k: v for k, v in near.items() if k != "p"}
        if name in _CLOSABLE:
            near = {**near, name: len(stack)}
        stack.append((name, path, gone, article or name == "article", main or name == "main", marks, near))
        opened[name] += 1
        links = 0 if name in CLOSES_P else links
    text(page[at:])
    for r in runs:
        r.gone = r.gone or not spared.issuperset(r.named)
    return tokens, runs


def main_text(runs: list[Run], template: frozenset[int]) -> str:
    """The text of the slots that remain, without blocks of links outside
    articles and main; only that of the articles if they hold most of it, else
    only that of the main element if that does. Template text goes, but for what
    articles have in common in their headings and running text: that is content."""
    left = [r for r in runs if not r.gone and (r.token not in template or r.article and r.tag in TEXT_BLOCKS)]
    linked: dict[int, list[int]] = {}
    for r in left:
        if not (r.article or r.main):
            linked.setdefault(r.block, [0, 0])[r.link] += len(r.text.strip())
    menus = {b for b, (plain, link) in linked.items() if link > 4 * plain}
    left = [r for r in left if r.article or r.main or r.block not in menus]
    for inside in ("article", "main"):
        own = [r for r in left if getattr(r, inside)]
        if 2 * sum(len(r.text.strip()) for r in own) > sum(len(r.text.strip()) for r in left):
            left = own
            break
        left = [r for r in left if r.token not in template]
    blocks: dict[int, list[str]] = {}
    for r in left:
        blocks.setdefault(r.block, []).append(r.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


# ---------------------------------------------------------------- templates


def host(url: Column) -> Column:
    """Lower-case host name of a URL; empty for null or other strings."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def token_table(pages: DataFrame) -> DataFrame:
    """(host, page, tokens) of the distinct pages of (host, html)."""
    out = arrow_schema(pages.sparkSession, "host string, page long, tokens array<long>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array(parse(x.as_py())[0], np.uint64).view(np.int64) for x in b.column(2)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tokens], schema=out)

    rows = pages.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(lean(run), "host string, page long, tokens array<long>")
    return rows.groupBy("host", "page").agg(F.first("tokens").alias("tokens"))


def candidate_classes(table: DataFrame) -> DataFrame:
    """(host, classes): the large and frequent equivalence classes of a host.

    A frequent token is in at least LEAST_SHARE of the host's pages, so a host
    has at most 1 / LEAST_SHARE times a page's tokens here."""
    sizes = table.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    each = table.select("host", "page", F.explode("tokens").alias("token")).groupBy("host", "page", "token").agg(F.count(F.lit(1)).alias("n"))
    vectors = each.groupBy("host", "token").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    frequent = vectors.where(F.col("support") >= LEAST_PAGES).join(sizes, "host").where(F.col("support") >= F.col("pages") * LEAST_SHARE)
    classes = frequent.groupBy("host", "support", "total", "vector").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= LEAST_SIZE)
    return classes.groupBy("host").agg(F.array_sort(F.collect_list("tokens")).alias("classes"))


def class_facts(tokens: np.ndarray, classes: list[list[int]]) -> list[tuple[int, int, bool]]:
    """(class number, hash of its order, whether it is whole and nested) for
    the classes that are in a page."""
    class_of = {t: i for i, c in enumerate(classes) for t in c}
    seen: dict[int, list[int]] = {}
    bad: set[int] = set()
    open_: list[list[int]] = []  # class, tokens of the unit so far
    for t in tokens.tolist():
        c = class_of.get(t)
        if c is None:
            continue
        seen.setdefault(c, []).append(t)
        if any(o[0] == c for o in open_):
            while open_[-1][0] != c:  # begun inside and not ended: interleaved
                bad.add(open_.pop()[0])
            open_[-1][1] += 1
        else:
            open_.append([c, 1])
        if open_[-1][1] == len(classes[c]):
            open_.pop()
    out = []
    for c, got in seen.items():
        size = len(classes[c])
        unit = got[:size]
        whole = len(got) % size == 0 and len(set(unit)) == size and got == unit * (len(got) // size)
        out.append((c, xxhash.xxh64_intdigest(np.array(unit, np.int64).tobytes()) >> 1, whole and c not in bad))
    return out


def with_host_rows(rows: DataFrame, per_host: DataFrame, weight: str) -> DataFrame:
    """``rows`` (with host and a salt column) left-joined to one row a host.
    ``per_host`` is pinned; column ``weight`` is its number of longs."""
    total = per_host.agg(F.sum(F.col(weight) * 8 + 64)).first()[0] or 0
    slim = per_host.drop(weight)
    if total <= BROADCAST_BYTES:
        return rows.drop("salt").join(F.broadcast(slim), "host", "left")
    salted = slim.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.join(salted, ["host", "salt"], "left").drop("salt")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, n): the tokens of the valid classes of every host with one."""
    table = pinned(token_table(pages))
    classes = candidate_classes(table)
    classes = pinned(classes.withColumn("n", F.size(F.flatten("classes")) + F.size("classes")))
    rows = with_host_rows(table.withColumn("salt", F.pmod("page", F.lit(SALTS))), classes, "n").where("classes is not null")
    schema = "host string, class int, sequence long, valid boolean"
    out = arrow_schema(pages.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(h.as_py(), *f) for h, t, c in zip(*b.columns) for f in class_facts(t.values.to_numpy(), c.as_py())]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), out)], schema=out)

    facts = rows.select("host", "tokens", "classes").mapInArrow(lean(run), schema)
    valid = facts.groupBy("host", "class").agg((F.min("valid") & (F.min("sequence") == F.max("sequence"))).alias("valid")).where("valid")
    kept = valid.groupBy("host").agg(F.collect_list("class").alias("kept")).join(classes, "host")
    tokens = F.flatten(F.transform("kept", lambda i: F.get("classes", i)))
    return kept.select("host", tokens.alias("template")).withColumn("n", F.size("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (template tokens of its host) of every row.

    Null and empty pages give an empty text; pages without a host share the
    empty one. Identical pages of a host count once for its template; hosts
    with fewer than LEAST_PAGES distinct pages have none, and their pages are
    read by their elements alone. Repeated rows give repeated results; an
    empty table gives an empty result; other columns are not read.
    """
    src = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"), host(F.col(f"`{url_col}`")).alias("host"),
    )
    own = pinned(templates(src.select("host", "html")))
    rows = with_host_rows(src.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS))), own, "n")
    schema = "page_id long, url string, text string, n_chars long, n_template long"
    out = arrow_schema(pages.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            for source, t in zip(b.column(2), b.column(3)):
                template = t.values.to_numpy().view(np.uint64).tolist() if t.is_valid else []
                texts.append(main_text(parse(source.as_py())[1], frozenset(template)))
                sizes.append(len(template))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(sizes, pa.int64())], schema=out)

    return rows.select("page_id", "url", "html", "template").mapInArrow(lean(run), schema)
