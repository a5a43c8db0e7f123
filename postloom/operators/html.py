"""Captured pages as tables: the one module of the engine that runs Python on the executors.

One parse a page by the standard library's tokenizer, in mapInArrow. The tree gets the end tags that HTML implies (a
paragraph ends where a block begins, a list item, cell, row or option where the next one does), in time linear in the page:
each tag knows where it is open, so no look-up walks the stack. Visibility is what static HTML tells (hidden,
aria-hidden, inline style). Filter rows before, and prune columns after, as Spark can do neither through it.

`page_elements` gives a row an element in interval encoding: `pre` counts opening tags and `last` is the `pre` of the
element's last descendant, so b lies in a if a.pre < b.pre <= a.last; `postloom.operators.elements` works on that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import parser, unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template", "noscript", "head", "title"}
_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "ul",
}
#: Tags besides whose text stands on lines of its own.
_BREAKS = _BLOCK | {"br", "tr", "td", "th", "option", "body"}
# What an opening tag closes: the nearest of the first, if none of the second is open inside it.
_CELLS, _ROWS = ("td", "th"), ("thead", "tbody", "tfoot")
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))), "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)), **dict.fromkeys(_CELLS, (_CELLS, ("table", "tr"))), "tr": (("tr",), ("table",)),
    **dict.fromkeys(_ROWS, (_ROWS, ("table",))),
}
_SCOPE = ("table", "td", "th", "caption", "template", "object", "marquee", "applet")
_TABLE = {"table", "caption", "td", "th", "tr", *_ROWS}

# Tags as they are mostly written, and their attributes; the library's tokenizer takes all others, and the elements whose content isn't tags.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_:-]*(?:="[^"]*")?)*)[ \t\n]*(/?)>""").match
_PLAIN_ATTRS = re.compile(r"""([a-zA-Z][a-zA-Z0-9_:-]*)(?:="([^"]*)")?""").findall
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
_attr_unescape = getattr(parser, "_unescape_attrvalue", unescape)  # references in attributes have a rule of their own in later versions

#: An element's text is given with it up to so many characters; a longer one is a range of its page's text.
SHORT = 300
#: Elements of one Arrow batch, about, and characters of the pages that are held parsed at once.
BATCH = 20_000
CHARS = 1 << 20

_LINK = pa.struct([("href", pa.string()), ("text", pa.string()), ("label", pa.string())])
_TEXTS = pa.list_(pa.string())
SCHEMA = (
    "{key} {kind}, title string, description string, og_title string, og_description string, og_url string, canonical string,"
    " body_text string, links array<struct<href:string,text:string,label:string>>, articles array<string>, messages array<string>,"
    " times array<string>, labels array<string>, role_article bigint, message_container bigint, time_or_date_link bigint,"
    " engagement_controls bigint, descendants bigint"
)


class PageTree(HTMLParser):
    """A page's elements in order of their opening tags, the page itself first, and its visible text.

    tags, attrs, depth, parent, last, hidden (by an attribute of its own), start and stop (its range of text).
    Character references are resolved as browsers do; with `references`, only those of these names that end in a semicolon,
    and the rest stays as it stands.
    """

    def __init__(self, page: str = "", references: tuple[str, ...] | None = None):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.depth, self.parent = ["#page"], [{}], [0], [-1]
        self.last, self.hidden, self.start, self.stop = [0], [False], [0], [0]
        self.stack = [0]
        self.places: dict[str, list[int]] = {}
        self.silent = 0
        self.titles: list[str] = []
        self.pieces: list[str] = []
        self.n, self.gap = 0, ""
        if references is not None:
            page = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", page)
        self._read(page)
        self.close()
        self._close_from(0)
        self.text = "".join(self.pieces)

    def _read(self, page: str) -> None:
        """feed, but with one expression a tag for what is written plainly, from the start of the page to the first that isn't."""
        at = 0
        while (tag := page.find("<", at)) >= 0:
            if tag > at:
                data = page[at:tag]
                self.handle_data(unescape(data) if "&" in data else data)
            at = tag
            m = _PLAIN_TAG(page, at)
            if m is None:
                break
            closes, name, attrs, alone = m.groups()
            name = name.lower()
            if closes:
                if attrs or alone:
                    break
                self.handle_endtag(name)
            elif name in _RAW:
                end = page.find(f"</{name}>", at)
                if end < 0:
                    break
                end += len(name) + 3
                self.feed(page[at:end])
                at = end
                if self.rawdata or self.cdata_elem:  # it isn't over there
                    break
                continue
            else:
                own = [(k.lower(), _attr_unescape(v) if "&" in v else v) for k, v in _PLAIN_ATTRS(attrs)] if attrs else []
                (self.handle_startendtag if alone else self.handle_starttag)(name, own)
            at = m.end()
        self.feed(page[at:])

    def _nearest(self, tags: tuple[str, ...]) -> int:
        """Where in the stack the innermost of these is, or -1."""
        places, most = self.places, -1
        for t in tags:
            own = places.get(t)
            if own and own[-1] > most:
                most = own[-1]
        return most

    def _close_from(self, place: int) -> None:
        """Close the elements of the stack from this place on."""
        while len(self.stack) > place:
            i = self.stack.pop()
            tag = self.tags[i]
            self.last[i] = len(self.tags) - 1
            self.stop[i] = self.n
            if i:
                self.places[tag].pop()
            if self.silent:
                self.silent -= self.silences(i)
            if tag in _BREAKS:
                self._break()

    def silences(self, i: int) -> bool:
        return self.hidden[i] or self.tags[i] in _SILENT

    def _break(self) -> None:
        if self.n and not self.silent:
            self.gap = "\n"

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK and self.places.get("p"):
            p = self._nearest(("p",))
            if p > self._nearest((*_SCOPE, "button")):
                self._close_from(p)
        if tag in _IMPLIED:
            closed, barrier = _IMPLIED[tag]
            at = self._nearest(closed)
            if at > self._nearest(barrier):
                self._close_from(at)
        if tag not in _HEAD and self.places.get("head"):
            self._close_from(self.places["head"][-1])
        if tag in _BREAKS:
            self._break()
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        style = own["style"].replace(" ", "").lower() if "style" in own else ""
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(own)
        self.depth.append(len(self.stack))
        self.parent.append(self.stack[-1])
        self.hidden.append("hidden" in own or own.get("aria-hidden") == "true" or bool(style) and (any(x in style for x in ("display:none", "visibility:hidden", "opacity:0;")) or style.endswith("opacity:0")))
        self.last.append(i)
        self.start.append(self.n)
        self.stop.append(self.n)
        if tag not in _VOID:
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(i)
            self.silent += self.silences(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.places.get("svg") or self.places.get("math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.tags[self.stack[-1]] == tag and tag not in _SCOPE:  # the innermost, as mostly
            self._close_from(len(self.stack) - 1)
            return
        at = self._nearest((tag,))
        if at > self._nearest(("table", "template") if tag in _TABLE - {"table"} else () if tag == "table" else _SCOPE):
            self._close_from(at)

    def handle_data(self, data):
        if self.places.get("title"):
            self.titles.append(data)
        if self.silent:
            return
        words = data.split()  # white space of any kind and length is one space, or one line end between blocks
        if not words or data[0].isspace():
            self.gap = self.gap or (" " if self.n else "")
        if not words:
            return
        text = (self.gap if self.n else "") + " ".join(words)
        if self.gap:  # white space before an element's first text belongs to neither
            self._skip(len(self.gap))
        self.gap = " " if data[-1].isspace() else ""
        self.pieces.append(text)
        self.n += len(text)

    def _skip(self, length: int) -> None:
        for i in reversed(self.stack):
            if self.start[i] != self.n:
                break
            self.start[i] += length

    def visible(self, i: int) -> str:
        return self.text[self.start[i] : max(self.start[i], self.stop[i])]

    def title(self) -> str:
        return " ".join("".join(self.titles).split())


def _is_message(a: dict[str, str]) -> bool:
    return "message" in (a.get("data-ad-preview"), a.get("data-ad-comet-preview"))


def _facts(page: PageTree) -> dict:
    meta: dict[str, str] = {}
    n = {"role_article": 0, "message_container": 0, "time_or_date_link": 0, "engagement_controls": 0, "descendants": len(page.tags) - 1}
    links, articles, messages, times, labels = [], [], [], [], []
    for i, (tag, a) in enumerate(zip(page.tags, page.attrs, strict=True)):
        label = a.get("aria-label", "")
        message = _is_message(a)
        if label:
            labels.append(label)
        if tag == "meta" and a.get("content"):
            meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])
        if tag == "link" and "canonical" in a.get("rel", "").lower():
            meta.setdefault("canonical", a.get("href", ""))
        if tag == "time" and a.get("datetime"):
            times.append(a["datetime"])
        if tag == "a" and a.get("href"):
            links.append({"href": a["href"], "text": _plain(page.visible(i)), "label": label})
        if tag == "article" or a.get("role") == "article":
            articles.append(_plain(page.visible(i)))
        if message:
            messages.append(_plain(page.visible(i)))
        n["role_article"] += a.get("role") == "article"
        n["message_container"] += message
        n["time_or_date_link"] += tag == "time" or (tag == "a" and bool(label))
        n["engagement_controls"] += any(x in label.lower() for x in ("comment", "share", "reaction", "like"))
    return {"title": page.title() or None, "description": meta.get("description"), "og_title": meta.get("og:title"), "og_description": meta.get("og:description"),
            "og_url": meta.get("og:url"), "canonical": meta.get("canonical"), "body_text": _plain(page.text), "links": links, "articles": articles,
            "messages": messages, "times": times, "labels": labels, **n}


def _plain(text: str) -> str:
    return text.replace("\n", " ")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about CHARS bytes of pages, so that what a worker holds doesn't grow with the rows of a batch."""
    start, size = 0, 0
    for end, n in enumerate(pc.binary_length(batch.column("html")).to_pylist(), 1):
        size += n
        if size >= CHARS or end == batch.num_rows:
            yield batch.slice(start, end - start)
            start, size = end, 0


def page_facts(pages: DataFrame, key: str = "page_id", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """(key, facts…) of every page; a null page has empty facts. `references` is PageTree's."""
    kinds = {"links": pa.list_(_LINK), **{k: _TEXTS for k in ("articles", "messages", "times", "labels")},
             **{k: pa.int64() for k in ("role_article", "message_container", "time_or_date_link", "engagement_controls", "descendants")}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(_facts(PageTree()))
        for batch in (part for whole in batches for part in _parts(whole)):
            rows = [_facts(PageTree(text, references)) for text in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names)], [key, *names])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), F.coalesce(html, F.lit("")).alias("html")).mapInArrow(run, SCHEMA.format(key=key, kind=kind))


def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = (), references: tuple[str, ...] | None = None) -> DataFrame:
    """(page, pre, last, depth, parent, tag, attrs, hidden, start, stop, text) of every element of every page.

    pre 0 is the page itself, tagged #page: its text is all visible text and its attrs hold the title, if there is one. Another
    element's text is given up to SHORT characters; a longer one is characters start to stop, from 0, of the page's. Blocks
    stand on lines of their own, other white space is single spaces. A null page has only its #page. Columns of `keep`
    stand in all rows of their page. `references` is PageTree's.
    """
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    names = ["pre", "last", "depth", "parent", "tag", "attrs", "hidden", "start", "stop", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            keys = batch.select(["page", *keep])
            rows: list[int] = []
            columns: list[list] = [[] for _ in names]

            def flush(rows, columns, keys=keys):
                return pa.RecordBatch.from_arrays([*keys.take(pa.array(rows, pa.int64())).columns, *map(pa.array, columns, kinds)], ["page", *keep, *names])

            for row, text in enumerate(batch.column("html").to_pylist()):
                page = PageTree(text, references)
                n = len(page.tags)
                title = page.title()
                if title:
                    page.attrs[0] = {"title": title}
                stops = [max(a, b) for a, b in zip(page.start, page.stop, strict=True)]
                texts = [page.text] + [page.text[a:b] if b - a <= SHORT else None for a, b in zip(page.start[1:], stops[1:], strict=True)]
                rows += [row] * n
                new = (range(n), page.last, page.depth, page.parent, page.tags, [list(a.items()) for a in page.attrs], page.hidden, page.start, stops, texts)
                for column, values in zip(columns, new, strict=True):
                    column += values
                if len(rows) >= BATCH:
                    yield flush(rows, columns)
                    rows, columns = [], [[] for _ in names]
            if rows:
                yield flush(rows, columns)

    kinds_of = dict(pages.dtypes)
    kept = ", ".join(f"`{k}` {kinds_of[k]}" for k in keep) + ", " if keep else ""
    return pages.select(F.col(key).alias("page"), *keep, F.coalesce(html, F.lit("")).alias("html")).mapInArrow(
        run, f"page {kinds_of[key]}, {kept}pre int, last int, depth int, parent int, tag string, attrs map<string,string>, hidden boolean, start int, stop int, text string")
