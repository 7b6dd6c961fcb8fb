"""Texts of chosen elements out of HTML pages.

One scan of a page follows which elements are open and keeps the texts of the chosen ones only, so
that little of a page leaves the task that reads it. What the texts mean is left to Spark
expressions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

# The scan travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without an end tag, elements whose text is not page text, and those of
# them that hold no tags.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
SILENT_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
RAW_TAGS = frozenset(["script", "style"])

# A tag with quoted attribute values, or one whose quotes don't match; a comment; anything else that is no text.
_TOKEN = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(!--)|[!?/])"""
)
_COMMENT_END = re.compile(r"--!?>")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
OUTPUT_ROWS = 500


@dataclass(frozen=True)
class Where:
    """An element by its tag, and by a class, the whole class attribute, or a pattern in it."""

    tag: str
    name: str | None = None
    like: str | None = None

    def test(self) -> Callable[[str], bool]:
        if self.like is not None:
            return lambda classes, found=re.compile(self.like).search: found(classes) is not None
        if self.name is None:
            return lambda classes: True
        if " " in self.name:
            return lambda classes: classes == self.name
        return lambda classes: self.name in classes.split(" ")


@dataclass(frozen=True)
class Field:
    """The text of the first `inner` element inside the first `outer` one, or of that one itself."""

    outer: Where
    inner: Where | None = None
    separator: str = ""


@dataclass(frozen=True)
class Items:
    """Every `item` element with its `data-toggle` and the first `label` and `value` elements inside it."""

    item: Where
    label: Where
    value: Where


def attributes_of(tag: str) -> dict[str, str]:
    """The attributes in the text of a tag; the last of a name counts."""
    return {
        m[1].lower(): unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")) for m in _ATTRIBUTE.finditer(tag)
    }


class Scan:
    """Follows open elements; subclasses say what starts and ends with them and where texts go."""

    wanted: frozenset[str] = frozenset()

    def __init__(self):
        self.open: list[tuple[str, object]] = []
        self.depth: dict[str, int] = {}
        self.silent = 0

    def begin(self, tag: str, attributes: str) -> object:
        """A wanted element begins; what this returns is given to `end`."""

    def end(self, mark: object) -> None:
        """The element of the mark ends."""

    def listens(self) -> bool:
        raise NotImplementedError

    def text(self, piece: str) -> None:
        """A piece of text between two tags, without white space around it."""

    def _close(self) -> str:
        tag, mark = self.open.pop()
        self.depth[tag] -= 1
        self.silent -= tag in SILENT_TAGS
        if mark is not None:
            self.end(mark)
        return tag

    def _say(self, piece: str) -> None:
        piece = (unescape(piece) if "&" in piece else piece).strip()
        if piece:
            self.text(piece)

    def run(self, html: str) -> None:
        at, search, depth = 0, _TOKEN.search, self.depth
        while (token := search(html, at)) is not None:
            low = token.start()
            if low > at and not self.silent and self.listens():
                self._say(html[at:low])
            at = token.end()
            closing, tag, rest, closing2, tag2, rest2, comment = token.groups()
            if tag is None:
                closing, tag, rest = closing2, tag2, rest2
            if tag is None:
                found = _COMMENT_END.search(html, at - (comment is not None)) if comment else None
                stop = found.end() if found else len(html) if comment else html.find(">", at) + 1 or len(html)
                at = max(at, stop)
                continue
            tag = tag.lower()
            if closing:
                if depth.get(tag):
                    while self._close() != tag:
                        pass
                continue
            mark = self.begin(tag, rest) if tag in self.wanted else None
            if tag in VOID_TAGS:
                continue
            self.open.append((tag, mark))
            depth[tag] = depth.get(tag, 0) + 1
            self.silent += tag in SILENT_TAGS
            if rest.endswith("/"):
                self._close()
            elif tag in RAW_TAGS:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
        if not self.silent and self.listens():
            cut = _CUT_TAG.search(html, at)
            self._say(html[at : cut.start() if cut else len(html)])
        while self.open:
            self._close()


class _Chosen(Scan):
    def __init__(self, fields: list[Field], items: Items | None):
        super().__init__()
        self.fields, self.choice = fields, items
        self.tests = {w: w.test() for f in fields for w in (f.outer, f.inner) if w} | (
            {w: w.test() for w in (items.item, items.label, items.value)} if items else {}
        )
        self.wanted = frozenset(w.tag for w in self.tests)
        classed = {w.tag for w in self.tests if w.name is not None or w.like is not None}
        self.plain = self.wanted - classed - ({items.item.tag} if items else set())  # tags whose attributes don't matter
        self.at = [0] * len(fields)  # 0: looks for outer, 1: is inside it, 2: found or past
        self.found: list[list[str] | None] = [None] * len(fields)
        self.items: list[dict] = []
        self.inside: list[dict] = []  # items that are open
        self.sinks: list[list[str]] = []  # where texts go

    def listens(self):
        return bool(self.sinks)

    def text(self, piece):
        for sink in self.sinks:
            sink.append(piece)

    def _listen(self, sink: list[str], marks: list) -> list[str]:
        self.sinks.append(sink)
        marks.append(("sink", sink))
        return sink

    def begin(self, tag, attributes):
        named = {} if tag in self.plain or not attributes else attributes_of(attributes)
        classes = " ".join(named.get("class", "").split())
        marks: list = []

        def fits(where: Where | None) -> bool:
            return where is not None and where.tag == tag and self.tests[where](classes)

        for i, field in enumerate(self.fields):
            if self.at[i] == 1 and fits(field.inner):
                self.found[i], self.at[i] = self._listen([], marks), 2
            elif self.at[i] == 0 and fits(field.outer):
                if field.inner is None:
                    self.found[i], self.at[i] = self._listen([], marks), 2
                else:
                    self.at[i] = 1
                    marks.append(("outer", i))
        if self.choice:
            for key in ("label", "value"):
                if self.inside and fits(getattr(self.choice, key)):
                    for item in self.inside:
                        if item[key] is None:
                            item[key] = self._listen([], marks)
            if fits(self.choice.item):
                item = {"toggle": named.get("data-toggle"), "label": None, "value": None}
                self.items.append(item)
                self.inside.append(item)
                marks.append(("item", item))
        return marks or None

    def end(self, mark):
        for kind, what in mark:
            if kind == "outer":
                self.at[what] = 2
            else:
                held = self.sinks if kind == "sink" else self.inside
                del held[next(k for k in range(len(held) - 1, -1, -1) if held[k] is what)]

    def result(self, html: str) -> tuple[list[str | None], list[dict]]:
        self.run(html)
        texts = [None if t is None else f.separator.join(t) for f, t in zip(self.fields, self.found, strict=True)]
        joined = [{k: "".join(v) if isinstance(v, list) else v for k, v in item.items()} for item in self.items]
        return texts, joined


ITEM = T.StructType([T.StructField(name, T.StringType()) for name in ("toggle", "label", "value")])
_ITEM_ARROW = pa.list_(pa.struct([(f.name, pa.string()) for f in ITEM]))


def page_fields(pages: DataFrame, fields: dict[str, Field], items: Items | None = None, html: str = "html") -> DataFrame:
    """Replace the page text by a text column per field, `items` and `readable`. One pass, no shuffle.

    A text is null where the page lacks the element. A page that is null or cannot be scanned, for
    whatever reason, is not readable and has no items; other pages are not touched by that.
    """
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType([
        *[pages.schema[c] for c in kept],
        *[T.StructField(name, T.StringType()) for name in fields],
        T.StructField("items", T.ArrayType(ITEM)),
        T.StructField("readable", T.BooleanType()),
    ])
    chosen = list(fields.values())

    def scan(page: str | None):
        if page is not None:
            try:
                return (*_Chosen(chosen, items).result(page), True)
            except Exception:  # noqa: BLE001  the fault is one page's
                pass
        return [None] * len(chosen), [], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, OUTPUT_ROWS):
                batch = whole.slice(start, OUTPUT_ROWS)
                found = [scan(page) for page in batch.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept]
                    + [pa.array([texts[i] for texts, _, _ in found], pa.string()) for i in range(len(chosen))]
                    + [pa.array([listed for _, listed, _ in found], _ITEM_ARROW), pa.array([ok for _, _, ok in found], pa.bool_())],
                    names=schema.names,
                )

    return pages.select(*kept, html).mapInArrow(run, schema)
