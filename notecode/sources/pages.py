"""Links of stored web pages, read by rules with selectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 10_000  # links of one Arrow batch
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def page_key(url: Column) -> Column:
    """Path and query of a URL, which identify a page whatever its host or fragment."""
    return F.concat(F.regexp_extract(url, PATH, 1), F.lit("?"), F.regexp_extract(url, QUERY, 1))


def first_pages(pages: DataFrame) -> DataFrame:
    """Drop pages whose path and query were already seen on a page of smaller id."""
    keyed = pages.withColumn("page_key", page_key(F.col("url")))
    firsts = keyed.groupBy("page_key").agg(F.min("page_id").alias("page_id"))
    return keyed.join(firsts.select("page_id"), "page_id", "left_semi")


@dataclass(frozen=True)
class LinkRule:
    """Which elements of a page are links, and which of the elements inside them hold the text (all, if none is named).

    A selector is a list of chains, parted by commas. A chain is one or more of ``tag``, ``#id``, ``.class``,
    ``[name]`` and ``[name=value]`` (also ``~= ^= $= *=``) without a blank, joined by blanks (anywhere below)
    or ``>`` (directly below).
    """

    select: str = "a[href]"
    text: str | None = None


_TEST = re.compile(r"""([\w-]+|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*))\s*)?\]""")
_JOIN = re.compile(r"\s*([>,])\s*|\s+")
_HOLDS = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
}


class Selector:
    """A parsed selector: steps (step before or -1, directly below, tests), and which steps end a chain.

    Whether a step is met by an element follows from the steps that its parent and all elements above it
    meet, two bit sets per open element, so nothing above is searched again.
    """

    def __init__(self, selector: str):
        self.steps: list[tuple[int, bool, list[tuple[str, str, str]]]] = []
        self.final = 0
        text, at, before, direct = selector.strip(), 0, -1, False
        while True:
            tests = []
            while found := _TEST.match(text, at):
                tag, name, kind, attribute, sign, *values = found.groups()
                if tag and tests:
                    break
                if tag:
                    tests.append(("tag", "", tag.lower()))
                elif name or kind:
                    tests.append(("id", "=", name) if name else ("class", "~=", kind))
                else:
                    tests.append((attribute.lower(), sign or "", next((v for v in values if v is not None), "")))
                at = found.end()
            if not tests:
                raise ValueError(f"cannot read selector {selector!r} at {at}")
            self.steps.append((before, direct, tests))
            join = _JOIN.match(text, at)
            ends = at == len(text) or (join is not None and join[1] == ",")
            if ends:
                self.final |= 1 << len(self.steps) - 1
            if at == len(text):
                return
            if join is None:
                raise ValueError(f"cannot read selector {selector!r} at {at}")
            at, before, direct = join.end(), -1 if ends else len(self.steps) - 1, join[1] == ">"

    def met(self, tag: str, attributes: dict[str, str], parent: int, above: int) -> int:
        """The steps that an element meets, given those of its parent and of all elements above it."""
        out = 0
        for k, (before, direct, tests) in enumerate(self.steps):
            reached = before < 0 or (parent if direct else above) >> before & 1
            if reached and all(self._passes(tag, attributes, test) for test in tests):
                out |= 1 << k
        return out

    @staticmethod
    def _passes(tag: str, attributes: dict[str, str], test: tuple[str, str, str]) -> bool:
        name, sign, value = test
        if name == "tag" and not sign:
            return value in ("*", tag)
        return name in attributes and (not sign or _HOLDS[sign](attributes[name], value))


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNREAD = frozenset(("script", "style"))
# an element that ends an open one of these tags, unless one of the others was opened since
_ENDS = {
    "a": (("a",), ()),
    "p": (("p",), ("td", "th", "li", "div")),
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}


class LinkReader(HTMLParser):
    """Reads one page and keeps the links of each rule, in the order in which they begin.

    Comments, scripts and style sheets are passed over and character references decoded. A stack holds
    the open elements: an end tag closes everything opened since its start tag, and is ignored without
    one; list items, cells, paragraphs and anchors also end where the next begins.
    """

    def __init__(self, rules: Sequence[LinkRule]):
        super().__init__(convert_charrefs=True)
        self.select = [Selector(r.select) for r in rules]
        self.inside = [Selector(r.text) if r.text else None for r in rules]
        self.found: list[list[list]] = [[] for _ in rules]  # [href, pieces of text]
        self.open: list[list[tuple[int, list]]] = [[] for _ in rules]  # links not yet ended, with their depth
        self.holders: list[list[int]] = [[] for _ in rules]  # depths of open elements that hold the text
        self.stack: list[tuple[str, list[tuple[int, int]]]] = []  # tag and, per selector, steps met here and up to here
        self.tags: Counter[str] = Counter()

    def read(self, page: str) -> list[list[tuple[str | None, str]]]:
        self.feed(page)
        self.close()
        return [[(href, "".join(pieces)) for href, pieces in links] for links in self.found]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, stops = _ENDS.get(tag, ((), ()))
        if any(self.tags[t] for t in closes):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in closes:
                    self._cut(k)
                if k >= len(self.stack) or self.stack[k][0] in stops:
                    break
        attributes = {name: value or "" for name, value in reversed(attrs)}  # the first of equal names counts
        above = self.stack[-1][1] if self.stack else [(0, 0)] * (2 * len(self.select))
        state = []
        for selector, (parent, up) in zip(self.select + self.inside, above):
            here = selector.met(tag, attributes, parent, up) if selector else 0
            state.append((here, up | here))
        depth, n = len(self.stack), len(self.select)
        for k, selector in enumerate(self.select):
            if self.inside[k] and self.open[k] and state[n + k][0] & self.inside[k].final:
                self.holders[k].append(depth)
            if state[k][0] & selector.final:
                link = [None, []]
                self.found[k].append(link)
                self.open[k].append((depth, link))
            if tag == "a" and "href" in attributes:
                for _, link in self.open[k]:
                    if link[0] is None:
                        link[0] = attributes["href"]
        self.stack.append((tag, state))
        self.tags[tag] += 1
        if tag in _VOID:
            self._cut(depth)

    def handle_endtag(self, tag: str) -> None:
        if self.tags[tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self._cut(k)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in _UNREAD:
            return
        for k, links in enumerate(self.open):
            for depth, link in links:
                if self.inside[k] is None or (self.holders[k] and self.holders[k][-1] > depth):
                    link[1].append(data)

    def _cut(self, depth: int) -> None:
        """End all elements from ``depth`` on."""
        while len(self.stack) > depth:
            self.tags[self.stack.pop()[0]] -= 1
        for k, links in enumerate(self.open):
            while links and links[-1][0] >= depth:
                links.pop()
            while self.holders[k] and self.holders[k][-1] >= depth:
                self.holders[k].pop()


def page_links(pages: DataFrame, rules: Sequence[LinkRule] = (LinkRule(),), depth_col: str | None = None) -> DataFrame:
    """Links of each page in order: (page_id, place, href, text).

    A page at depth d (0 without ``depth_col``) is read by ``rules[d]`` and, if that finds nothing, by
    the next rule, if there is one. The href is that of the link or of the first anchor inside it, null
    without one. Pages without html, and those whose depth is null or has no rule, have no links.
    """
    rules = tuple(rules)
    for rule in rules:
        Selector(rule.select), Selector(rule.text or "*")
    key = pages.schema["page_id"]
    schema = T.StructType([T.StructField("page_id", key.dataType)]).add("place", T.IntegerType()).add("href", T.StringType()).add("text", T.StringType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rows: list[tuple] = []

        def given() -> pa.RecordBatch:
            columns = zip(*rows) if rows else ((),) * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for page, html, depth in zip(*(batch.column(k).to_pylist() for k in range(3))):
                tried = rules[depth : depth + 2] if html and depth is not None and depth >= 0 else ()
                links = next((found for found in LinkReader(tried).read(html) if found), []) if tried else []
                rows += [(page, place, href, text) for place, (href, text) in enumerate(links)]
                if len(rows) >= ROWS:
                    yield given()
                    rows.clear()
        yield given()

    depth = F.col(depth_col).cast("int") if depth_col else F.lit(0)
    return pages.select("page_id", F.col("html").cast("string"), depth.alias("depth")).mapInArrow(read, schema)
