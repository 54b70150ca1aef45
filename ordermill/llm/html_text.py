"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is a path of presentations (tag and class) from
the root; its styles are the sequences of child presentations of the branch that its text lies in.
A block (the text of one node on one page) has an importance from 0 to 1:

- content: 1 - ln(pages with the text) / ln(pages with the node + ``SMOOTHING``). A text on one page has
  1, one on every page of a large host 0. On hosts with few pages the same share of pages says
  less: a text on both of two pages stays above one half;
- presentation: the entropy of the styles over the pages, from 0 (always built alike) to 1;
- importance = content * (1 - ``STYLE_SHARE`` * (1 - presentation)).

Branches, not blocks, go: a branch is an element that divides a page (div, section, ...), with the text that
belongs to it and to no branch inside it, lists and tables included. It goes if none of its blocks reaches
``LEAST_IMPORTANCE``. It stays whatever the importance of its own blocks

- inside a branch that itself holds at least half of the important text below it (an article), or
- if most branches beside it, of the same presentation and style, are important (parts of an article).

So a line that recurs in articles stays in them. Names decide before the tree: text inside an article or main
element stays, and named menus, headers, footers, adverts, notices, forms and comments go, as
their texts are often their own on each page. Words of class, id, role and itemprop count as whole tokens. They name
neither html, body, main nor article, nor an ancestor of an article; an article inside furniture of another article
(comments) belongs to that furniture. The tree is built from all blocks; ``verdicts`` counts where it and the names differ.

Pages with the same article count once in the tree, also if they differ in some lines: the
longest block of the branch with most text stands for the article. On a host with one such page nothing recurs.

Null and empty html, and pages without kept blocks, give an empty text. Pages without a url form one
site. Repeated rows give a row each. Elements may be nested to any depth: each holds a running hash of its
path. Columns other than page_id, url and html are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ordermill.llm.bloom import bloom_filter, with_possible
from ordermill.llm.stored import stored
from ordermill.llm.url_filter import host_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_IMPORTANCE = 0.5
SMOOTHING = 3
STYLE_SHARE = 0.1

# Elements by their part in a page.
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr center dialog".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head title script style noscript template iframe object svg canvas math select textarea button option".split())
ARTICLE = frozenset("article main".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing "
    "social related recommended comment comments disqus reply replies respond widget pagination pager "
    "ad-banner ad-container ad-slot ad-unit cookie-banner cookie-bar cookie-consent cookie-notice comment-list comments-area "
    "complementary contentinfo main-menu main-nav main-navigation nav-bar nav-menu page-footer related-articles related-posts "
    "share-buttons side-bar site-footer site-nav site-navigation social-links social-share".split()
)
HEADER_WORDS = frozenset("header masthead topbar page-header site-header".split())
NEVER_NAMED = frozenset("html body main article".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = frozenset("ul ol dl table article main section div body".split())
_NAMING = frozenset("class id role itemprop".split())

# Elements that divide a page into branches.
BRANCHES = frozenset("html body article main section div header footer nav aside form fieldset dialog details".split())
WHOLE_PAGE = frozenset(["", "html", "body"])

KEEP, DROP, OPEN = 1, 0, 2  # what names say of a block: text, furniture, nothing
_NOTHING = frozenset()
_WORD = (1 << 64) - 1


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _hash(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _label(tag: str, classes: str) -> int:
    return _hash(_bytes(".".join([tag, *sorted(classes.lower().split())])))


def _chained(before: int, label: int) -> int:
    """A running 64-bit hash, as a signed number."""
    mixed = ((before ^ (before >> 29) & _WORD) * 0x9E3779B97F4A7C15 + label) & _WORD
    mixed = ((mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93) & _WORD
    return mixed - (1 << 64) if mixed >> 63 else mixed


class _Element:
    """An open or closed element. ``names`` is what its tag and words say; ``branch`` and ``block`` are the
    innermost elements of these kinds around its text, itself included."""

    __slots__ = (
        "tag", "path", "above", "silent", "names", "in_article", "holds_article", "judged", "block", "branch", "label", "style", "last", "number",
    )

    def __init__(self, tag, above, label, names):
        self.tag, self.above, self.label, self.names = tag, above, label, names
        self.holds_article, self.judged, self.style, self.last, self.number = False, None, 0, 0, -1
        block = tag in BLOCKS or above is None
        self.block = self if block else above.block
        self.branch = self if tag in BRANCHES or above is None else above.branch
        self.path = 0 if above is None else _chained(above.path, label) if block else above.path
        self.silent = above is not None and (above.silent or tag in NO_TEXT)
        self.in_article = above is not None and (above.in_article or above.tag == "article")

    def role(self) -> int:
        """What the names say of the text of this element."""
        chain, at = [], self
        while at is not None and at.judged is None:
            chain.append(at)
            at = at.above
        judged = at.judged if at is not None else (OPEN, "")
        for at in reversed(chain):
            judged = at.judged = at.own_role(*judged)
        return self.judged[0]

    def own_role(self, above: int, giver: str) -> tuple[int, str]:
        """The role here, and the tag of the element that gives it."""
        names = self.names
        if "content" in names:
            # An article brings text back from furniture, but not from that of another article or of a tag.
            return (above, giver) if above == DROP and (self.in_article or giver in FURNITURE) else (KEEP, self.tag)
        if "furniture" in names and not (self.holds_article and self.tag not in FURNITURE - {"form"}):
            return DROP, self.tag
        if "header" in names and above != KEEP and not self.holds_article:
            return DROP, self.tag
        return above, giver


def _names(tag: str, given: dict[str, str]) -> frozenset[str]:
    words = frozenset(" ".join(given.values()).lower().split()) if given else _NOTHING
    if tag in ARTICLE or given.get("role", "").lower() == "main" or given.get("itemprop") == "articleBody":
        return frozenset(["content"])
    if tag in FURNITURE or (tag not in NEVER_NAMED and words & FURNITURE_WORDS):
        return frozenset(["furniture"])
    if tag == "header" or (tag not in NEVER_NAMED and words & HEADER_WORDS):
        return frozenset(["header"])
    return _NOTHING


class _Page(HTMLParser):
    """Collects (element, text) of each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.open: dict[str, int] = {}  # how many elements of a tag are open
        self.parts: list[str] = []
        self.labels: dict[tuple[str, str], int] = {}
        self.found: list[tuple[_Element, str]] = []
        self.root = _Element("", None, 0, _NOTHING)

    def top(self) -> _Element:
        return self.stack[-1] if self.stack else self.root

    def label(self, tag: str, classes: str) -> int:
        if (tag, classes) not in self.labels:
            self.labels[tag, classes] = _label(tag, classes)
        return self.labels[tag, classes]

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.found.append((self.top(), text))

    def close_from(self, place: int) -> None:
        for element in self.stack[place:]:
            self.open[element.tag] -= 1
        del self.stack[place:]

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self.flush()
            self.close_implied(tag)
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        above = self.top()
        given = {key: value or "" for key, value in attrs if key in _NAMING} if attrs else {}
        element = _Element(tag, above, self.label(tag, given.get("class", "")) if block else 0, _names(tag, given))
        if block:
            parent = above.block
            if parent.last != element.label:  # repeats count once
                parent.style, parent.last = _chained(parent.style, element.label), element.label
        if "content" in element.names and not element.in_article:
            at = above
            while at is not None and not at.holds_article:
                at.holds_article = True
                at = at.above
        self.stack.append(element)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_implied(self, tag: str) -> None:
        closed = CLOSED_BY.get(tag, _NOTHING)
        if not (self.open.get("p") or (tag == "body" and self.open.get("head")) or any(self.open.get(c) for c in closed)):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[i].tag
            if open_tag == "p" or open_tag in closed or (tag == "body" and open_tag == "head"):
                self.close_from(i)
                return
            if open_tag in _LISTS:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.close_from(i)
                return

    def handle_data(self, data):
        if not (self.stack and self.stack[-1].silent):
            self.parts.append(data)


def page_blocks(html: str | None) -> list[tuple[_Element, int, str]]:
    """(element, role, text) of each block in page order."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    return [(element, element.role(), text) for element, text in page.found]


def _branches(blocks: list[tuple[_Element, int, str]]) -> list[_Element]:
    """The branches of the open blocks and those around them, outer ones first; each gets its number."""
    chains: list[_Element] = []
    for element, role, _ in blocks:
        at, chain = element.branch, []
        while role == OPEN and at is not None and at.number < 0:
            at.number = 0
            chain.append(at)
            at = at.above.branch if at.above is not None else None
        chains += reversed(chain)
    for number, branch in enumerate(chains):
        branch.number = number
    return chains


def _article(host: bytes, blocks: list[tuple[_Element, int, str]]) -> int:
    """Equal for pages of a host that count once: the longest block of the branch with most text, furniture left out."""
    sizes: dict[_Element, int] = {}
    for element, role, text in blocks:
        if role != DROP:
            sizes[element.branch] = sizes.get(element.branch, 0) + len(text)
    if not sizes:
        return _hash(host, *(_bytes(text) for _, _, text in blocks))
    largest = max(sizes, key=sizes.get)  # of several the first
    longest = max((text for element, role, text in blocks if role != DROP and element.branch is largest), key=len)
    return _hash(host, b"article", _bytes(longest))


_PARSED = pa.struct(
    [
        ("copy", pa.int64()),
        ("texts", pa.list_(pa.struct([("node", pa.int64()), ("key", pa.int64()), ("role", pa.int8()), ("blocks", pa.int32())]))),
        ("styles", pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64()), ("page", pa.int8())]))),
        ("lines", pa.list_(pa.struct([("text", pa.string()), ("key", pa.int64()), ("branch", pa.int32())]))),
        ("branches", pa.list_(pa.struct([("above", pa.int32()), ("label", pa.int64()), ("style", pa.int64()), ("whole", pa.bool_())]))),
    ]
)
_PARSED_DDL = (
    "struct<copy:bigint,texts:array<struct<node:bigint,key:bigint,role:tinyint,blocks:int>>,"
    "styles:array<struct<node:bigint,style:bigint,page:tinyint>>,lines:array<struct<text:string,key:bigint,branch:int>>,"
    "branches:array<struct<above:int,label:bigint,style:bigint,whole:boolean>>>"
)


def parsed_page(host: bytes, html: str | None) -> tuple:
    """What is kept of a page: its article's hash, its distinct texts and styles by node, and the lines that may stay.

    A line's branch is -1 where names keep it. Open lines carry their key and the number of their branch.
    """
    blocks = page_blocks(html)
    texts, styles, lines, nodes = {}, {}, [], {}
    branches = _branches(blocks)
    for element, role, text in blocks:
        path = element.path, role
        node = nodes.get(path)
        if node is None:
            node = nodes[path] = _hash(host, b"%d %d" % path)
        key = _hash(b"%d" % node, _bytes(text))
        texts[key] = (node, key, role, texts[key][3] + 1 if key in texts else 1)
        style = element.branch.style
        if (node, style) not in styles:
            styles[(node, style)] = (node, style, 0)
        if role != DROP:
            lines.append((text, key, element.branch.number if role == OPEN else -1))
    seen = set()
    for pair, (node, style, _) in styles.items():
        styles[pair] = (node, style, int(node not in seen))
        seen.add(node)
    listed = [
        (b.above.branch.number if b.above is not None else -1, b.label, b.style, b.tag in WHOLE_PAGE) for b in branches
    ]
    return _article(host, blocks), list(texts.values()), list(styles.values()), lines, listed


def kept_branches(lines: list[tuple[str, int, int]], branches: list[tuple[int, int, int, bool]], low: set[int]) -> list[bool]:
    """Whether the own lines of each branch stay, given the keys of unimportant texts."""
    count = len(branches)
    own, size, important = [False] * count, [0] * count, [False] * count
    for text, key, branch in lines:
        if branch >= 0:
            own[branch] = True
            if key not in low:
                important[branch] = True
                size[branch] += len(text)
    below = size[:]
    for i in range(count - 1, -1, -1):  # inner branches come after outer ones
        if branches[i][0] >= 0:
            below[branches[i][0]] += below[i]
    alike: dict[tuple, list[int]] = {}
    for i, branch in enumerate(branches):
        if own[i]:
            tally = alike.setdefault(branch[:3], [0, 0])
            tally[0] += 1
            tally[1] += important[i]
    inside, kept = [False] * count, [False] * count
    for i, (above, label, style, _) in enumerate(branches):
        if above >= 0:
            holder = not branches[above][3] and size[above] > 0 and 2 * size[above] >= below[above]
            inside[i] = inside[above] or holder
        if own[i]:
            tally = alike[(above, label, style)]
            kept[i] = important[i] or inside[i] or 2 * tally[1] > tally[0]
    return kept


def _parsed():
    def parse(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, pages in arrays:
            rows = [parsed_page(_bytes(host.as_py() or ""), html.as_py()) for host, html in zip(hosts, pages)]
            yield pa.array(rows, _PARSED)

    return F.arrow_udf(parse, _PARSED_DDL, F.ArrowUDFType.SCALAR_ITER)


def _kept_text():
    """The lines that stay, where some texts of the page are unimportant."""

    def join(arrays: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lines, branches, low in arrays:
            texts = []
            for own, around, keys in zip(lines, branches, low):
                own = [tuple(line.values()) for line in own.as_py()]
                kept = kept_branches(own, [tuple(b.values()) for b in around.as_py()], set(keys.as_py()))
                texts.append("\n".join(text for text, _, branch in own if branch < 0 or kept[branch]))
            yield pa.array(texts, pa.string())

    return F.arrow_udf(join, "string", F.ArrowUDFType.SCALAR_ITER)


def once(pages: DataFrame) -> DataFrame:
    """One row (texts, styles) of each article in ``pages`` (page, copy, texts, styles); only copies are shuffled."""
    repeated = pages.groupBy("copy").count().where("count > 1").select(F.col("copy").alias("_copy"))
    asked = with_possible(pages, "copy", bloom_filter(repeated, "_copy", at_most=pages.count()), "repeats")
    first = asked.where("repeats").groupBy("copy").agg(F.min_by(F.struct("texts", "styles"), "page").alias("first"))
    return asked.where("NOT repeats").select("texts", "styles").unionByName(first.select("first.texts", "first.styles"))


def style_nodes(pages: DataFrame) -> DataFrame:
    """(node, pages, presentation) of each node; counts combine before each shuffle."""
    styles = pages.select(F.explode("styles").alias("s")).groupBy("s.node", "s.style")
    styles = styles.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("s.page").alias("pages"))
    trees = styles.groupBy("node").agg(
        F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("spread")
    )
    entropy = F.when(F.col("n") > 1, 1 - F.col("spread") / F.col("n") / F.log("n")).otherwise(1.0)
    return trees.select("node", "pages", entropy.alias("presentation"))


def importance(holders: Column, pages: Column, presentation: Column) -> Column:
    """Of a text on ``holders`` of the ``pages`` that have its node."""
    content = 1 - F.log(holders.cast("double")) / F.log(pages.cast("double") + SMOOTHING)
    return content * (1 - STYLE_SHARE * (1 - presentation))


def judged_texts(pages: DataFrame) -> DataFrame:
    """(node, key, role, holders, importance) of the texts on two or more pages; all others are important."""
    nodes = stored(style_nodes(pages).where(F.col("pages") > 1), "nodes")
    texts = pages.select(F.explode("texts").alias("t")).groupBy("t.node", "t.key").agg(
        F.max("t.role").alias("role"), F.count(F.lit(1)).alias("holders")
    )
    judged = texts.where(F.col("holders") > 1).join(nodes, "node")
    return judged.select("node", "key", "role", "holders", importance(F.col("holders"), F.col("pages"), F.col("presentation")).alias("importance"))


def _given(pages: DataFrame) -> DataFrame:
    """The pages, parsed once and stored."""
    text = F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url", "html")))
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.md5(text).alias("page"))
    return stored(keyed.select("page_id", "url", "page", _parsed()("host", "html").alias("p")).select("page_id", "url", "page", "p.*"), "parsed")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    Each page is parsed once. The trees need hashes only; lines are shuffled for those pages alone that
    hold an unimportant text no name decides on.
    """
    parsed = _given(pages)
    low = judged_texts(once(parsed)).where((F.col("role") == OPEN) & (F.col("importance") < LEAST_IMPORTANCE))
    low = stored(low.select(F.col("key").alias("_key")), "low")
    places = parsed.select("page", F.explode("texts").alias("t")).where(F.col("t.role") == OPEN).select("page", "t.key")
    asked = with_possible(places, "key", bloom_filter(low, "_key"), "held").where("held")
    changes = asked.join(low, F.col("key") == F.col("_key")).groupBy(F.col("page").alias("_page")).agg(F.collect_set("key").alias("low"))
    changes = stored(changes, "changes")

    asked = with_possible(parsed.select("page_id", "url", "page", "lines", "branches"), "page", bloom_filter(changes, "_page"), "differs")
    whole = F.array_join(F.transform("lines", lambda line: line["text"]), "\n")
    same = asked.where("NOT differs").select("page_id", "url", whole.alias("text"))
    none = F.array().cast("array<bigint>")
    cut = asked.where("differs").join(changes, F.col("page") == F.col("_page"), "left").select(
        "page_id", "url", _kept_text()("lines", "branches", F.coalesce("low", none)).alias("text")
    )
    return same.unionByName(cut).withColumn("n_chars", F.length("text").cast("long"))


def verdicts(pages: DataFrame) -> DataFrame:
    """How many blocks the names keep, drop or leave open (role), and how the tree judges them (important)."""
    parsed = _given(pages)
    low = judged_texts(once(parsed)).where(F.col("importance") < LEAST_IMPORTANCE).select(F.col("key").alias("_key"))
    blocks = parsed.select(F.explode("texts").alias("t")).select("t.key", "t.role", "t.blocks")
    judged = blocks.groupBy("key", "role").agg(F.sum("blocks").alias("blocks")).join(low, F.col("key") == F.col("_key"), "left")
    return judged.groupBy("role", F.col("_key").isNull().alias("important")).agg(F.sum("blocks").alias("blocks"))
