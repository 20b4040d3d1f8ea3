"""HTML to signals: a small tree builder and one Arrow UDF that returns all of a page's signals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsonld
from .urls import join, resolve, same_site

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template".split())
#: An opening tag ends these open elements.
ENDS = {
    "a": {"a"}, "button": {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
}
LEVELS = {f"h{i}": i for i in range(1, 7)}
SCOPES = frozenset("table td th button ul ol dl div article section body html".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    #: Something below it is text other than white space; some image below it has a text.
    has_text: bool = False
    has_named_image: bool = False

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def texts(self, skip: frozenset = frozenset()) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n is self or n.tag not in skip:
                stack += reversed(n.children)

    def text(self) -> str:
        return squeeze("".join(self.texts()))

    def rels(self) -> set[str]:
        return set(self.attrs.get("rel", "").lower().split())


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Tree(HTMLParser):
    """Builds a tree: void elements, implied ends of p, li, td and the like, raw text."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.open = [self.root]
        self.nodes: list[Node] = []
        self.feed(html)
        self.close()
        for n in reversed(self.nodes):  # children come after their parents
            if n.parent is not None:
                n.parent.has_text |= n.has_text
                n.parent.has_named_image |= n.has_named_image or (n.tag == "img" and bool(n.attrs.get("alt", "").strip()))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in LEVELS and self.open[-1].tag in LEVELS:  # a heading right inside a heading ends it
            del self.open[-1]
        ends = ENDS.get(tag)
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ends:
                    del self.open[i:]
                    break
                if self.open[i].tag in SCOPES:
                    break
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        node = Node(tag, known, self.open[-1])
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)
        if not data.isspace():
            self.open[-1].has_text = True


# ---- a subset of CSS selectors for extractors ----
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|(:first-child)")
Test = tuple[str, str, str, str]


def selector(text: str) -> list[list[tuple[str, list[Test]]]]:
    """Groups of steps (combinator, tests); raises ValueError for what isn't supported."""
    groups = []
    for group in text.split(","):
        steps: list[tuple[str, list[Test]]] = []
        comb, rest = " ", group.strip()
        if not rest:
            raise ValueError(f"bad selector {text!r}")
        while rest:
            tests: list[Test] = []
            while m := _SIMPLE.match(rest):
                tag, ident, cls, attr, op, *values, first = m.groups()
                if tag:
                    tests.append(("tag", tag.lower(), "", ""))
                elif ident:
                    tests.append(("attr", "id", "=", ident))
                elif cls:
                    tests.append(("attr", "class", "~=", cls))
                elif attr:
                    tests.append(("attr", attr.lower(), op or "", next((v for v in values if v is not None), "")))
                elif first:
                    tests.append(("first", "", "", ""))
                rest = rest[m.end() :]
            if not tests:
                raise ValueError(f"bad selector {text!r}")
            steps.append((comb, tests))
            m = re.match(r"\s*([>+])\s*|\s+", rest)
            if rest and not m:
                raise ValueError(f"bad selector {text!r}")
            if m:
                comb, rest = m.group(1) or " ", rest[m.end() :]
                if not rest:
                    raise ValueError(f"bad selector {text!r}")
        groups.append(steps)
    return groups


def _fits(n: Node, tests: list[Test]) -> bool:
    for kind, name, op, value in tests:
        if kind == "tag":
            if name not in ("*", n.tag):
                return False
        elif kind == "first":
            elements = [c for c in (n.parent.children if n.parent else []) if isinstance(c, Node)]
            if not elements or elements[0] is not n:
                return False
        else:
            have = n.attrs.get(name)
            if have is None:
                return False
            ok = {"": True, "=": have == value, "~=": value in have.split(), "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "*=": bool(value) and value in have, "|=": have == value or have.startswith(value + "-")}
            if not ok[op]:
                return False
    return True


def _selected(n: Node, steps: list[tuple[str, list[Test]]]) -> bool:
    comb, tests = steps[-1]
    if not _fits(n, tests):
        return False
    if len(steps) == 1:
        return True
    before = steps[:-1]
    if comb == ">":
        return n.parent is not None and n.parent.tag != "#" and _selected(n.parent, before)
    if comb == "+":
        sibs = [c for c in n.parent.children if isinstance(c, Node)] if n.parent else []
        i = next((i for i, c in enumerate(sibs) if c is n), 0)
        return i > 0 and _selected(sibs[i - 1], before)
    up = n.parent
    while up is not None and up.tag != "#":
        if _selected(up, before):
            return True
        up = up.parent
    return False


def select(root: Node, groups: list[list[tuple[str, list[Test]]]]) -> Iterator[Node]:
    return (n for n in root.walk() if any(_selected(n, g) for g in groups))


# ---- signals ----
_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_VALIDATION = T.StructType([T.StructField("type_name", _S), T.StructField("missing_required", T.ArrayType(_S)), T.StructField("missing_recommended", T.ArrayType(_S))])
_HREFLANG = T.StructType([T.StructField("lang", _S), T.StructField("href", _S)])
_COUNTS = ("h2_count", "h3_count", "word_count", "images_total", "images_missing_alt", "invalid_jsonld", "mixed_content", "question_headings", "structured_blocks", "links_total", "links_no_text", "buttons_total", "buttons_no_text", "controls_total", "inputs_no_label", "iframes_no_title", "positive_tabindex")
_FLAGS = ("has_viewport", "faq_schema", "has_author", "has_date", "semantic_html", "answerable", "viewport_blocks_zoom", "skipped_heading")
_TEXTS = ("title", "meta_description", "meta_robots", "lang", "canonical", "og_title", "og_image", "twitter_card", "text")
SIGNALS = T.StructType(
    [T.StructField(n, _S) for n in _TEXTS]
    + [T.StructField(n, _I) for n in _COUNTS]
    + [T.StructField(n, _B) for n in _FLAGS]
    + [T.StructField(n, T.ArrayType(_S)) for n in ("h1", "internal_links", "external_links", "schema_types", "headings")]
    + [T.StructField("text_ratio", T.DoubleType()), T.StructField("hreflang", T.ArrayType(_HREFLANG)), T.StructField("schema_validations", T.ArrayType(_VALIDATION))]
)
_SOURCES = {"img": "src", "script": "src", "iframe": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "link": "href", "object": "data"}
_BUTTONS = {"button", "submit", "reset"}
_NO_LABEL = {"hidden", "submit", "button", "reset", "image"}


def blocks_zoom(content: str) -> bool:
    for part in re.split("[,;]", content.lower()):
        k, _, v = (x.strip() for x in part.partition("="))
        if k == "user-scalable" and v in ("no", "0"):
            return True
        if k == "maximum-scale":
            try:
                if float(v) < 2:
                    return True
            except ValueError:
                pass
    return False


def _labelled(a: dict[str, str]) -> bool:
    return any(a.get(x, "").strip() for x in ("aria-label", "aria-labelledby", "title"))


def _named(n: Node) -> bool:
    return n.has_text or n.has_named_image or _labelled(n.attrs)


def signals(url: str, html: str) -> dict:
    """All signals of a page."""
    root = Tree(html).root
    out: dict = dict.fromkeys(_TEXTS) | dict.fromkeys(_COUNTS, 0) | dict.fromkeys(_FLAGS, False)
    host = (urlsplit(url).hostname or "").lower()
    meta_author = False
    h1: list[str] = []
    links: tuple[dict[str, None], dict[str, None]] = ({}, {})
    hreflang, blocks, headings = [], [], []
    controls: list[Node] = []
    labelled: set[str] = set()
    paragraphs, last_level, body = 0, 0, None
    secure = url.startswith("https://")
    for n in root.walk():
        tag, a = n.tag, n.attrs
        if tag == "title" and out["title"] is None and "seen title" not in out:
            out["seen title"] = True
            out["title"] = n.text() or None
        elif tag == "meta":
            name, prop, content = a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "")
            if name == "description":
                out["meta_description"] = squeeze(content)
            elif name == "robots":
                out["meta_robots"] = content.lower()
            elif name == "viewport":
                out["has_viewport"] = True
                out["viewport_blocks_zoom"] = blocks_zoom(content)
            elif name == "author":  # of several the last counts, as for the others
                meta_author = bool(content.strip())
            if prop == "og:title":
                out["og_title"] = content
            elif prop == "og:image":
                out["og_image"] = content
            if "twitter:card" in (prop, name):
                out["twitter_card"] = content
            if prop in ("article:published_time", "article:modified_time"):
                out["has_date"] = True
        elif tag == "link" and "href" in a:
            rels = n.rels()
            if "canonical" in rels:
                out["canonical"] = resolve(url, a["href"]) or out["canonical"]
            if "alternate" in rels and "hreflang" in a:
                hreflang.append({"lang": a["hreflang"], "href": join(url, a["href"])})
        elif tag == "html" and out["lang"] is None:
            out["lang"] = a.get("lang", "").strip() or None
        elif tag == "body" and body is None:
            body = n
        elif tag == "img":
            out["images_total"] += 1
            out["images_missing_alt"] += not a.get("alt", "").strip()
        elif tag == "a" and "href" in a:
            out["links_total"] += 1
            out["links_no_text"] += not _named(n)
            target = resolve(url, a["href"])
            if target:
                inner = same_site((urlsplit(target).hostname or ""), host)
                links[not inner].setdefault(target)
        elif tag == "button":
            out["buttons_total"] += 1
            out["buttons_no_text"] += not _named(n)
        elif tag in ("input", "select", "textarea"):
            kind = a.get("type", "").lower() if tag == "input" else ""
            if kind in _BUTTONS:  # its name is its value
                out["buttons_total"] += 1
                out["buttons_no_text"] += not (a.get("value", "").strip() or _labelled(a))
            if kind not in _NO_LABEL:
                controls.append(n)
        elif tag == "label" and a.get("for"):
            labelled.add(a["for"])
        elif tag == "iframe":
            out["iframes_no_title"] += not _labelled(a)
        elif tag in ("main", "article"):
            out["semantic_html"] = True
        elif tag in ("ul", "ol", "table"):
            out["structured_blocks"] += 1
        elif tag == "p":
            paragraphs += 1
            if paragraphs <= 3 and len(n.text().split()) >= 25:
                out["answerable"] = True
        elif tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            blocks.append("".join(n.texts()))
        elif tag == "time" and "datetime" in a:
            out["has_date"] = True
        if tag in LEVELS:
            level, text = LEVELS[tag], n.text()
            headings.append(f"{level}:{text}")
            if tag == "h1" and text:
                h1.append(text)
            if tag in ("h2", "h3"):
                out[f"{tag}_count"] += 1
            if level <= 3 and text.endswith("?"):
                out["question_headings"] += 1
            if last_level and level > last_level + 1:
                out["skipped_heading"] = True
            last_level = level
        if not a:
            continue
        if ("rel" in a and "author" in n.rels()) or ("class" in a and {"author", "byline"} & set(a["class"].split())):
            out["has_author"] = True
        if "tabindex" in a and re.fullmatch(r"\+?[0-9]+", a["tabindex"].strip()) and 0 < int(a["tabindex"]) < 2**31:
            out["positive_tabindex"] += 1
        if secure and tag in _SOURCES and _SOURCES[tag] in a:
            # The first attribute that is there decides, an empty one too.
            source = next(a[x] for x in ("src", "href", "data") if x in a)
            out["mixed_content"] += source.lstrip().startswith("http://")
    out.pop("seen title", None)
    for n in controls:
        out["controls_total"] += 1
        named = _labelled(n.attrs) or n.attrs.get("id", "\0") in labelled
        up = n.parent
        while not named and up is not None:
            named, up = up.tag == "label", up.parent
        out["inputs_no_label"] += not named
    if body is None:  # no body tag: everything but the head is its content
        body = Node("body", children=[c for n in root.children for c in (n.children if isinstance(n, Node) and n.tag == "html" else [n])])
    text = squeeze(" ".join(body.texts(RAW | {"head", "title"})))
    types, items, invalid = jsonld.validate(blocks)
    raw = " ".join(blocks).lower()
    size = len(html.encode())
    out |= {
        "text": text, "word_count": len(text.split()), "text_ratio": min(1.0, len(text.encode()) / size) if size else 0.0, "h1": h1, "headings": headings,
        "internal_links": list(links[0]), "external_links": list(links[1]), "hreflang": hreflang, "schema_types": types, "schema_validations": items,
        "invalid_jsonld": invalid, "faq_schema": any(t in jsonld.FAQ_TYPES for t in types), "has_author": out["has_author"] or meta_author or '"author"' in raw, "has_date": out["has_date"] or '"datepublished"' in raw,
    }
    return out


@F.pandas_udf(SIGNALS)
def parse_html(urls: pd.Series, html: pd.Series) -> pd.DataFrame:
    """The signals of each page; nulls count as empty."""
    rows = [signals(u or "", h or "") for u, h in zip(urls, html)]
    return pd.DataFrame(rows, columns=SIGNALS.names)


MAX_VALUES = 50


@dataclass(frozen=True)
class Extractor:
    """A named value of a page, by selector (text or an attribute) or by regular expression over the HTML."""

    name: str
    css: str | None = None
    attr: str | None = None
    regex: str | None = None

    def check(self) -> None:
        if self.css:
            selector(self.css)
        elif self.regex:
            re.compile(self.regex)
        else:
            raise ValueError(f"extractor {self.name!r} needs css or regex")

    def values(self, root: Node, html: str) -> list[str]:
        if self.css:
            out: list[str] = []
            for n in select(root, selector(self.css)):
                v = n.attrs.get(self.attr, "").strip() if self.attr else n.text()
                if v:
                    out.append(v)
                if len(out) == MAX_VALUES:
                    break
            return out
        found = [m.group(1) if m.re.groups and m.group(1) is not None else m.group() for m, _ in zip(re.finditer(self.regex or "", html), range(MAX_VALUES))]
        return [v.strip() for v in found if v.strip()]


EXTRACTIONS = T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("values", T.ArrayType(_S))]))


def extract(extractors: list[Extractor]):
    """An Arrow UDF of HTML: the extractors that found something, in order."""
    for e in extractors:
        e.check()

    @F.pandas_udf(EXTRACTIONS)
    def run(html: pd.Series) -> pd.Series:
        out = []
        for h in html:
            root = Tree(h or "").root
            got = [(e.name, e.values(root, h or "")) for e in extractors]
            out.append([{"name": n, "values": v} for n, v in got if v])
        return pd.Series(out, dtype=object)

    return run
