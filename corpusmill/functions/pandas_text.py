"""Text functions that SQL cannot say, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import calendar
import datetime
import difflib
import hashlib
import os
import re
import unicodedata
from html.parser import HTMLParser
from itertools import accumulate
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import drop_labels

_STR = T.StringType()
#: Fixed value: what may stand in front of a title.
_TITLE_LABEL = re.compile(r"(?i)^\*{0,2}(?:title|abstract)\*{0,2}\s*[:\-]\s*")


def without_title(text: str, title: str, limit: float = 0.72) -> str:
    """The text's lines with white space trimmed, blank ones left out; the first goes if others follow and it is like the title."""
    lines = [x for line in text.splitlines() if (x := line.strip())]
    if title and len(lines) > 1:
        own = _TITLE_LABEL.sub("", lines[0]).strip(' *"').casefold()
        if difflib.SequenceMatcher(None, own, title.casefold()).ratio() > limit:
            del lines[0]
    return " ".join(lines)


@F.arrow_udf(_STR)
def drop_title(text: pa.Array, title: pa.Array) -> pa.Array:
    some = lambda i: [None if (t := x.as_py()) is None else without_title(t, n.as_py() or "") for x, n in zip(text.slice(i, 64), title.slice(i, 64), strict=True)]
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(some(i), pa.string()) for i in range(0, len(text), 64))])  # the objects of few texts at a time


def clean_abstract(text: Column | str, title: Column | str) -> Column:
    """An abstract without a first line like the title, and without section labels."""
    return drop_labels(drop_title(text, title))


@F.pandas_udf(T.ArrayType(_STR))
def prompt_tokens(text: pd.Series) -> pd.Series:
    """NFKC, casefold, word tokens."""
    return text.map(lambda t: None if t is None else re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold()))


@F.pandas_udf(T.StructType([T.StructField("prefix", T.LongType()), T.StructField("suffix", T.LongType())]))
def common_affixes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Lengths of the common prefix, and of the common suffix of what is left."""
    rows = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            rows.append((None, None))
            continue
        p = len(os.path.commonprefix([x, y]))
        rows.append((p, len(os.path.commonprefix([x[p:][::-1], y[p:][::-1]]))))
    return pd.DataFrame(rows, columns=["prefix", "suffix"])


def parse_tagged(text: str, opening: str, closing: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without tags, and the spans they mark. Nested, stray and open tags are errors."""
    out, spans, begin, n = [], [], None, 0
    for part in re.split(f"({re.escape(opening)}|{re.escape(closing)})", text):
        if part == opening:
            if begin is not None:
                raise ValueError("a tag opens within a tag")
            begin = n
        elif part == closing:
            if begin is None:
                raise ValueError("a tag closes that is not open")
            spans.append((begin, n))
            begin = None
        else:
            out.append(part)
            n += len(part)
    if begin is not None:
        raise ValueError("a tag stays open")
    return "".join(out), spans


def tagged_spans(opening: str, closing: str):
    """A column function: (text, spans, error) of tagged texts; a null text gives nulls, wrong tags an error and no spans."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = T.StructType([T.StructField("text", _STR), T.StructField("spans", T.ArrayType(span)), T.StructField("error", _STR)])

    def one(s: str | None) -> tuple:
        if s is None:
            return None, None, None
        try:
            text, spans = parse_tagged(s, opening, closing)
        except ValueError as e:
            return None, None, str(e)
        return text, [{"start": a, "end": b} for a, b in spans], None

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s) for s in text], columns=["text", "spans", "error"])

    return run


# Elements whose text is dropped, and those whose own text makes a block.
SKIPPED = frozenset("script style nav footer header aside form noscript svg button".split())
OWN_BLOCKS = frozenset("p h1 h2 h3 h4 li blockquote".split())


class OwnText(HTMLParser):
    """Blocks that each hold only their own inline text; text of nested blocks isn't repeated. Unclosed blocks end where the next of their kind begins."""

    def __init__(self, kinds: frozenset[str] = OWN_BLOCKS) -> None:
        super().__init__(convert_charrefs=True)
        self.kinds = kinds
        self.open: list[tuple[str, int]] = []
        self.blocks: list[tuple[str, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.handle_data(" ")
        elif tag in self.kinds:
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            self.open.append((tag, len(self.blocks)))
            self.blocks.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.kinds and any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skip and self.open:
            self.blocks[self.open[-1][1]][1].append(data)


def own_blocks(html: str, every: bool = False) -> list[tuple[str, str]]:
    """(element, text) of each block with text; a block that repeats the one before it is left out. With `every` it stays, and all headings are blocks."""
    parser = OwnText(OWN_BLOCKS | {"h5", "h6"} if every else OWN_BLOCKS)
    parser.feed(html)
    parser.close()
    out: list[tuple[str, str]] = []
    for tag, parts in parser.blocks:
        text = " ".join("".join(parts).split())
        if text and (every or not out or out[-1][1] != text):
            out.append((tag, text))
    return out


def _blocks(html: pa.Array, every: bool) -> pa.Array:
    kind = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))
    some = lambda i: [[] if (h := x.as_py()) is None else [{"tag": a, "text": b} for a, b in own_blocks(h, every)] for x in html.slice(i, 64)]
    return pa.concat_arrays([pa.array([], kind), *(pa.array(some(i), kind) for i in range(0, len(html), 64))])  # the objects of few pages at a time


_BLOCKS = T.ArrayType(T.StructType([T.StructField("tag", _STR), T.StructField("text", _STR)]))


@F.arrow_udf(_BLOCKS)
def html_blocks(html: pa.Array) -> pa.Array:
    return _blocks(html, False)


@F.arrow_udf(_BLOCKS)
def html_every_block(html: pa.Array) -> pa.Array:
    return _blocks(html, True)


# Elements of books that are blocks, and those that are no text.
_BOOK_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote".split())
_BOOK_ASIDE = frozenset("nav aside header footer script style".split())


def xhtml_blocks(content: bytes) -> list[str]:
    """Own text of each block of an XHTML body, in document order; text of nested blocks is their own."""
    body = next((n for n in ElementTree.fromstring(content).iter() if n.tag.rpartition("}")[2] == "body"), None)
    out: list[list[str]] = []

    def walk(node: ElementTree.Element, own: list[str] | None) -> None:
        name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        if name not in _BOOK_ASIDE and name:
            inner = own
            if name in _BOOK_BLOCKS:
                inner = []
                out.append(inner)
            if inner is not None and node.text:
                inner.append(node.text)
            for child in node:
                walk(child, inner)
                if inner is not None and child.tail:
                    inner.append(child.tail)

    if body is not None:
        walk(body, None)
    return [t for parts in out if (t := " ".join(" ".join(parts).split()))]


# Headings that end an article, openings of paragraphs that are captions, and words that claim another's rights.
_STOP = re.compile(r"(?i)^(references|references & resources|resources|downloads|related)")
_CAPTION = re.compile(r"(?i)^(image|photo|figure|credit|references|read more)[:\s]")
_RIGHTS = re.compile(r"(?i)©|all rights reserved|reprinted with permission")
#: Fixed value: elements and classes whose text belongs to no article.
_ASIDE = frozenset("figure figcaption aside nav script style blockquote table".split())
_ASIDE_CLASSES = frozenset("caption share related social-share".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class ArticleText(HTMLParser):
    """Paragraphs and headings within the first element of a body name (or the whole page), without asides."""

    def __init__(self, body: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.body, self.found = body, body is None
        self.stack: list[tuple[str, bool]] = []
        self.inside, self.aside = int(body is None), 0
        self.parts: list[tuple[str, list[str]]] = []
        self.current: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            self.handle_data(" ")
            return
        if tag == "p" and any(t == "p" for t, _ in self.stack):
            self.handle_endtag("p")
        classes = set((dict(attrs).get("class") or "").split())
        off = tag in _ASIDE or bool(classes & _ASIDE_CLASSES)
        self.stack.append((tag, off))
        self.aside += off
        if tag == self.body and not self.found:
            self.found, self.inside = True, len(self.stack)
        if tag in ("p", "h2", "h3", "h4") and self.inside and not self.aside:
            self.current = []
            self.parts.append((tag, self.current))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while True:
            if self.body is not None and self.inside == len(self.stack):
                self.inside = 0
            name, off = self.stack.pop()
            self.aside -= off
            if name in ("p", "h2", "h3", "h4"):
                self.current = None
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.current is not None and not self.aside:
            self.current.append(data)


def article(html: str, body: str | None = "article", least: int = 500, most: int = 2400, floor: int = 1800) -> tuple[str, str | None]:
    """(verdict, text) of a page: paragraphs of at least eight words up to a heading of references, without captions.

    Verdicts: missing_body, possible_third_party_rights, too_short (fewer than `least` words) or accepted. A text over
    `most` words ends with the paragraph that reaches `floor`.
    """
    parser = ArticleText(body)
    parser.feed(html)
    parser.close()
    if not parser.found:
        return "missing_body", None
    kept, sizes = [], []
    for tag, parts in parser.parts:
        text = " ".join("".join(parts).split())
        if tag != "p":
            if _STOP.match(text):
                break
            continue
        n = len(text.split())
        if n < 8 or _CAPTION.match(text):
            continue
        if _RIGHTS.search(text):
            return "possible_third_party_rights", None
        kept.append(text)
        sizes.append(n)
    total = list(accumulate(sizes))
    if not total or total[-1] < least:
        return "too_short", None
    if total[-1] > most:
        kept = kept[: next((i for i, n in enumerate(total, 1) if n >= floor), len(kept))]
    return "accepted", "\n\n".join(kept)


def article_text(body: str | None = "article", least: int = 500):
    """A column function: (verdict, text) of pages; a null page is missing_body."""
    kind = T.StructType([T.StructField("verdict", _STR), T.StructField("text", _STR)])

    @F.pandas_udf(kind)
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(h or "", body, least) for h in html], columns=["verdict", "text"])

    return run


def dated_sections(text: str, least: int = 8) -> tuple[str | None, str]:
    """(ISO date, prose) of a text whose first section is a date line: the following sections of at least `least` words, up to notes or thanks."""
    sections = [s for part in re.split(r"\n\s*\n", text) if (s := " ".join(part.split()))]
    m = re.match(rf"^({'|'.join(calendar.month_name[1:])})\s+(?:(\d{{1,2}}),?\s+)?(\d{{4}})$", sections[0]) if sections else None
    if not m:
        return None, ""
    try:
        day = datetime.date(int(m[3]), list(calendar.month_name).index(m[1]), int(m[2] or 1)).isoformat()
    except ValueError:
        return None, ""
    prose = []
    for s in sections[1:]:
        # Headings of what isn't prose any more
        if s in ("Notes", "Thanks", "Thanks to", "Note", "Footnotes") or s.startswith(("Notes [", "Thanks to ")):
            break
        if len(s.split()) >= least:
            prose.append(s)
    return day, "\n\n".join(prose)


@F.pandas_udf(T.StructType([T.StructField("day", _STR), T.StructField("prose", _STR)]))
def dated_prose(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else dated_sections(t) for t in text], columns=["day", "prose"])


def _at(salt: str, n: int) -> int:
    """A place below n, from a hash of the salt."""
    return int(hashlib.sha256(salt.encode()).hexdigest()[:15], 16) % max(1, n)


def sentence_excerpt(text: str, salt: str, target: int) -> str:
    """Whole sentences from a hashed place until `target` words are reached; under 20 words, a run of words of the whole text instead."""
    parts = [s for p in re.split(r"(?<=[.!?])\s+|\n\s*\n", text) if (s := p.strip())]
    out: list[str] = []
    n = 0
    for s in parts[_at(salt, len(parts)) :]:
        out.append(s)
        n += len(s.split())
        if n >= target:
            break
    if n >= 20:
        return " ".join(out)
    own = text.split()
    at = _at(salt + ":words", len(own) - min(target, len(own)) + 1)
    return " ".join(own[at : at + target])


def two_excerpts(text: str, salt: str, target: int) -> tuple[str, str]:
    """Excerpts of the text's two halves by sentences, which share none; texts of under four sentences are halved by words."""
    parts = [s for p in re.split(r"(?<=[.!?])\s+|\n\s*\n", text) if (s := p.strip())]
    if len(parts) >= 4:
        half = len(parts) // 2
        return sentence_excerpt(" ".join(parts[:half]), salt + ":a", target), sentence_excerpt(" ".join(parts[half:]), salt + ":b", target)
    own = text.split()
    half = len(own) // 2
    return " ".join(own[: min(half, target)]), " ".join(own[half : half + target])


def disjoint_excerpts(target: int):
    """A column function of (text, salt): two excerpts that share no sentence."""
    kind = T.StructType([T.StructField("first", _STR), T.StructField("second", _STR)])

    @F.pandas_udf(kind)
    def run(text: pd.Series, salt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else two_excerpts(t, str(k), target) for t, k in zip(text, salt, strict=True)], columns=["first", "second"])

    return run
