"""Main text of web pages by equivalence-class template deduction.

1. Each page is read as a sequence of tokens: places of block elements (the labels
   of the elements around them, told apart among equal siblings) and texts of
   blocks. A token's occurrence vector says how often it stands on each page of its
   host. Vectors are never gathered: a token carries the number of its pages and the
   sum of a hash of (page, count) modulo a prime, which combine in any order, so a
   host with a third of all pages is summed up within each task. Copies of a page on
   a host are one page: each of n copies gives an n-th of all sums.
2. Tokens of a host with the same vector form an equivalence class. It is valid
   if it has at least `least_tokens` tokens, on at least `least_pages` pages and
   `least_share` of the host's pages. Valid classes nest: a class lies in the slot
   of the class whose element is the nearest around its own outermost one. Together
   they are the host's template, and what stands between its tokens are its slots.
3. The main slot is the innermost element of the template that stands once on a
   page and holds at least half of the page's unlinked text, on average over the
   host. Where several qualify and one is an article or main element, that kind
   breaks the tie; a heading just in front of the slot belongs to it. Its blocks are the
   text of the host's pages, without slots nested in it that are mostly links,
   without texts of the template (a text on `fixed_share` of the pages; on a page that
   would lose half of its slot so, it stays: near copies repeat each other), and
   without elements whose kind or class names say what no template can: menus,
   adverts, notices, forms, reader comments.
4. Pages of hosts with too few pages for a template, and pages without their
   host's main slot, are extracted by kinds and class names alone. A class name that
   may mean other things (`share`, `notice`) or a form counts only while its element
   holds less than half of the page's text.

Character references are decoded, white space in a block becomes one space,
blocks are trimmed and joined by a space.

The template of a host is no longer than its pages. Templates are counted: up to
`held_rows` tokens are broadcast, more are joined by host. Nulls: a null html is
empty, null urls form one host. Repeated rows come out as often as they go in;
input columns text and n_chars are replaced, all others but the html pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import release
from corpusmill.session import materialize

# HTML element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul div".split())
NO_TEXT = frozenset("aside button dialog fieldset footer form head input label menu nav object select audio video canvas".split())
MAIN = frozenset(("article", "main"))
LISTED = frozenset("p li tr dt dd option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that mark a part of a page as no article.
NO_ARTICLE = frozenset(
    "ad ads advert advertisement adverts breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager pagination popup related replies sidebar signup sponsor sponsored subscribe toolbar".split()
)
# Such words that stand for other things as well.
MAYBE = frozenset("alert banner notice notices promo promoted search share sharing social widget".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: str  # labels of the elements around it
    place: str  # the same, with numbers among equal siblings
    text: str
    off: tuple[tuple[str, bool], ...]  # elements around it that are no article: (place, whether that's sure)
    main: bool  # in an article or main element
    linked: float  # share of its characters that are link text


@dataclass
class Element:
    name: str
    label: str
    place: str
    off: bool
    children: dict[str, int]


def under(place: str, root: str) -> bool:
    return place == root or place.startswith(root + "/")


def read_page(html: str) -> tuple[list[str], list[Block]]:
    """(places of the opened block elements in order, text blocks in order)."""
    root = Element("", "", "", False, {})
    stack: list[Element] = []
    places: list[str] = []
    blocks: list[Block] = []
    held: list[str] = []
    off: list[tuple[str, bool]] = []
    links = at = main = anchors = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                outer = [e for e in stack if e.name in BLOCK]
                blocks.append(Block("/".join(e.label for e in outer), outer[-1].place if outer else "", text, tuple(off), main > 0, min(1.0, links / len(text))))
            held.clear()
        links = 0

    def pop(to: int) -> None:
        nonlocal main, anchors
        for e in stack[to:]:
            main -= e.name in MAIN
            anchors -= e.name == "a"
        if gone := sum(e.off for e in stack[to:]):
            del off[-gone:]
        del stack[to:]

    def add(text: str) -> None:
        nonlocal links
        if text:
            if "&" in text:
                text = entities.unescape(text)
            held.append(text)
            if anchors:
                links += len(text.strip())

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    pop(i)
                    break
            continue
        if name == "body":
            for i, e in enumerate(stack):
                if e.name == "head":
                    pop(i)
                    break
        attributes = m[4] or ""
        words: list[str] = []
        no, sure = name in NO_TEXT, name != "form"
        if attributes.strip():
            words = _PART.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower())
            if _HIDDEN.search(attributes) or (name not in ("html", "body") and not NO_ARTICLE.isdisjoint(words)):
                no = sure = True
            elif not no and name not in ("html", "body") and not MAYBE.isdisjoint(words):
                no, sure = True, False
        if (name == "header" or (words and "header" in words and name not in ("html", "body"))) and not main:  # an article's own header holds its title
            no = sure = True
        if name in LISTED or name in ("td", "th"):  # these end one that is open, up to the nearest container
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    pop(i)
                    break
                if stack[i].name in BLOCK and stack[i].name not in LISTED and stack[i].name not in ("td", "th"):
                    break
        if name in CLOSES_P:  # so do these with an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    pop(i)
                    break
                if stack[i].name in BLOCK:
                    break
        label = place = f"{name}.{'.'.join(sorted(set(words)))}" if words else name
        outer = next((e for e in reversed(stack) if e.name in BLOCK), root)
        if name in BLOCK:
            if name not in LISTED:
                n = outer.children[label] = outer.children.get(label, 0) + 1
                if n > 1:
                    place = f"{label}~{n}"
            place = f"{outer.place}/{place}" if outer.place else place
            places.append(place)
        else:
            place = f"{outer.place}/~{label}"
        if name in VOID or attributes.endswith("/"):
            continue
        stack.append(Element(name, label, place, no, {}))
        if no:
            off.append((place, sure))
        main += name in MAIN
        anchors += name == "a"
    if at < len(html):
        add(html[at:])
    flush()
    return places, blocks


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


@dataclass
class Token:
    place: str
    is_text: bool
    at: float  # its first place in the page, from 0 to 1
    count: int = 1
    held: float = 0.0  # share of the page's unlinked text within
    linked: float = 0.0  # share of the text within that is linked


def page_tokens(places: list[str], blocks: list[Block]) -> dict[int, Token]:
    """The tokens of a page."""
    out: dict[int, Token] = {}
    held: dict[str, list[float]] = {}
    total = 0.0
    for b in blocks:
        if any(sure for _, sure in b.off):
            continue
        plain = len(b.text) * (1 - b.linked)
        total += plain
        place = b.place
        while place:
            sums = held.setdefault(place, [0.0, 0.0])
            sums[0] += plain
            sums[1] += len(b.text)
            place = place.rpartition("/")[0]
    n = len(places) + len(blocks)
    for i, (place, text) in enumerate([*((p, None) for p in places), *((b.place, f"{b.path}>{b.text}") for b in blocks)]):
        token = _hash(f"<{place}" if text is None else text)
        if token in out:
            out[token].count += 1
        else:
            out[token] = Token(place, text is not None, i / n)
            if text is None and (sums := held.get(place)):
                out[token].held, out[token].linked = sums[0] / total if total else 0.0, 1 - sums[0] / sums[1]
        if text is not None and total and not any(sure for _, sure in blocks[i - len(places)].off):
            out[token].held += len(blocks[i - len(places)].text) * (1 - blocks[i - len(places)].linked) / total
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_FLUSH = 200_000
#: Sums of signatures are taken modulo this prime, where each number of copies has an inverse.
_PRIME = (1 << 61) - 1


def occurrence_signatures(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, place, single, n_pages, sig, held, linked) per token of a host; pages has host, page, copies (rows with this host and page) and html."""
    names = ["host", "token", "is_text", "place", "single", "n_pages", "sig", "held", "linked"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, _signed(t), *v) for (h, t), v in held.items()]
            held.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

        for batch in batches:
            for host, page, copies, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = pow(copies, -1, _PRIME)
                for t, x in page_tokens(*read_page(html)).items():
                    sig = xxhash.xxh64_intdigest(b"%d:%d" % (page, x.count)) * part % _PRIME
                    if old := held.get((host, t)):
                        old[1] = min(old[1], x.place)
                        old[2] = old[2] and x.count == 1
                        old[3] += 1 / copies
                        old[4] = (old[4] + sig) % _PRIME
                        old[5] += x.held / copies
                        old[6] += x.linked / copies
                    else:
                        held[host, t] = [x.is_text, x.place, x.count == 1, 1 / copies, sig, x.held / copies, x.linked / copies]
                if len(held) > _FLUSH:
                    yield flush()
        yield flush()

    rows = pages.mapInArrow(run, "host bigint, token bigint, is_text boolean, place string, single boolean, n_pages double, sig bigint, held double, linked double")
    sig = F.sum(F.col("sig").cast("decimal(38,0)")) % F.lit(_PRIME).cast("decimal(38,0)")
    return rows.groupBy("host", "token").agg(
        F.first("is_text").alias("is_text"), F.min("place").alias("place"), F.min("single").alias("single"), F.round(F.sum("n_pages")).cast("long").alias("n_pages"), sig.cast("long").alias("sig"), F.sum("held").alias("held"), F.sum("linked").alias("linked")
    )


def nested(tokens: pd.DataFrame) -> pd.DataFrame:
    """Tokens of one host's valid classes plus class_id, parent and depth of their class, and role: `main` (the main slot) or `links` (a slot of links in it)."""
    out = tokens.reset_index(drop=True)
    out["class_id"] = out.groupby(["n_pages", "sig"], sort=True).ngroup()
    elements = {r.place: r for r in out[~out["is_text"]].itertuples()}
    top: dict[int, str] = {}
    for r in out.sort_values(["is_text", "place"]).itertuples():
        if r.class_id not in top or r.place.count("/") < top[r.class_id].count("/"):
            top[r.class_id] = r.place
    parent = dict.fromkeys(top, -1)
    for k, place in top.items():
        around = place
        while parent[k] < 0 and around:
            if around in elements and elements[around].class_id != k and (around != place or top[elements[around].class_id] != place):
                parent[k] = elements[around].class_id
            around = around.rpartition("/")[0]
    depth = {}
    for k in parent:
        seen, up = {k}, parent[k]
        while up >= 0 and up not in seen:
            seen.add(up)
            up = parent[up]
        depth[k] = len(seen) - 1
    out["parent"], out["depth"] = out["class_id"].map(parent), out["class_id"].map(depth)
    share = {p: r.held / r.n_pages for p, r in elements.items()}
    kind = lambda p: p.rpartition("/")[2].partition(".")[0].partition("~")[0]
    slots = [p for p, r in elements.items() if r.single and share[p] >= 0.5 and kind(p) not in LISTED | HEADINGS]
    roles: dict[str, str] = {}
    if slots:
        of_kind = [p for p in slots if kind(p) in MAIN]
        main = max(of_kind or slots, key=lambda p: (depth[elements[p].class_id], p.count("/"), p))
        above = main.rpartition("/")[0]
        titles = sum(share[p] for p in elements if p.rpartition("/")[0] == above and kind(p) in HEADINGS)
        fixed = sum(r.held / r.n_pages for r in out[out["is_text"]].itertuples() if under(r.place, above) and not under(r.place, main))
        if above in slots and kind(main) not in MAIN and titles and titles >= 0.9 * (share[above] - share[main] - fixed):
            main = above
        roles[main] = "main"
        roles |= {p: "links" for p, r in elements.items() if p.startswith(main + "/") and r.single and r.linked / r.n_pages > 0.6}
    out["role"] = [None if t else roles.get(p) for t, p in zip(out["is_text"], out["place"], strict=True)]
    return out


def deduce_templates(pages: DataFrame, least_tokens: int = 3, least_pages: int = 4, least_share: float = 0.5, held_copies: int = 1_000_000) -> DataFrame:
    """(host, token, is_text, place, n_pages, share, class_id, parent, depth, role): the template of each host; pages has host, page and html."""
    counts = materialize(pages.groupBy("host", "page").agg(F.count("*").alias("copies")), "counts")
    repeated = counts.filter("copies > 1")
    few = repeated.limit(held_copies + 1).count() <= held_copies
    marked = pages.join(F.broadcast(repeated) if few else repeated.hint("merge"), ["host", "page"], "left")
    tokens = occurrence_signatures(marked.select("host", "page", F.coalesce("copies", F.lit(1)).alias("copies"), "html"))
    hosts = counts.groupBy("host").agg(F.count("*").alias("pages"))
    often = tokens.filter(F.col("n_pages") >= least_pages).join(hosts, "host").filter(F.col("n_pages") >= least_share * F.col("pages"))
    often = materialize(often, "often")  # pages are read once for it, not once for each use
    classes = often.groupBy("host", "sig", "n_pages").agg(F.count("*").alias("tokens")).filter(F.col("tokens") >= least_tokens)
    members = often.join(classes, ["host", "sig", "n_pages"], "left_semi").withColumn("share", F.col("n_pages") / F.col("pages"))
    columns = ["host", "token", "is_text", "place", "n_pages", "share", "class_id", "parent", "depth", "role"]

    def nest(pdf: pd.DataFrame) -> pd.DataFrame:
        return nested(pdf)[columns]

    return members.groupBy("host").applyInPandas(nest, "host bigint, token bigint, is_text boolean, place string, n_pages bigint, share double, class_id int, parent int, depth int, role string")


def _sums(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _token(b: Block) -> int:
    return _signed(_hash(f"{b.path}>{b.text}"))


def slot_text(blocks: list[Block], main: str, links: Iterable[str] = (), fixed: Iterable[int] = ()) -> str | None:
    """The text of the main slot, without the slots of links in it and texts of the template; none if the page has no such slot."""
    links, fixed = list(links), set(fixed)
    slot = [b for b in blocks if under(b.place, main) and not any(x.startswith(main + "/") for x, _ in b.off) and not any(under(b.place, x) for x in links)]
    own = [b for b in slot if _token(b) not in fixed]
    return " ".join(b.text for b in (own if 2 * _sums(own) > _sums(slot) else slot)) if slot else None


def ruled_text(blocks: list[Block], texts: Iterable[int] = ()) -> str:
    """The text of a page without a main slot, by kinds and class names; texts: those of its host's template."""
    sure = [b for b in blocks if not any(s for _, s in b.off)]
    held: dict[str, int] = {}
    for b in sure:
        for place, _ in b.off:
            held[place] = held.get(place, 0) + len(b.text)
    total, texts = _sums(sure), set(texts)
    free = [b for b in sure if all(2 * held[place] > total for place, _ in b.off)]
    within, plain = [b for b in free if b.main], [b for b in free if b.main or b.linked <= 0.6]
    if within and 2 * _sums(within) >= _sums(plain):
        return " ".join(b.text for b in within)
    return " ".join(b.text for b in plain if _token(b) not in texts)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", fixed_share: float = 0.8, held_rows: int = 1_000_000, **options) -> DataFrame:
    """pages without the html, plus text, n_chars (its code points) and by_template: whether the host's main slot gave the text."""
    names = [c for c in pages.columns if c not in ("text", "n_chars", "by_template") and c != html_col]
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own = pages.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(host).alias("__host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))
    hashed = own.select(F.col("__host").alias("host"), F.xxhash64("__html").alias("page"), F.col("__html").alias("html"))
    template = materialize(deduce_templates(hashed, **options), "templates")
    each = template.groupBy(F.col("host").alias("__key")).agg(
        F.max(F.when(F.col("role") == "main", F.col("place"))).alias("__main"),
        F.collect_list(F.when(F.col("role") == "links", F.col("place"))).alias("__links"),
        F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("__texts"),
        F.collect_list(F.when(F.col("is_text") & (F.col("share") >= fixed_share), F.col("token"))).alias("__fixed"),
    )
    few = template.limit(held_rows + 1).count() <= held_rows
    joined = own.join(F.broadcast(each) if few else each, own["__host"] == each["__key"], "left").drop("__host", "__key")
    at = len(names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:at]), "text string", "n_chars bigint", "by_template boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(at + i).to_pylist() for i in range(5)), strict=True)
            made, found = [], []
            for html, main, links, texts, fixed in rows:
                blocks = read_page(html)[1]
                text = None if main is None else slot_text(blocks, main, links, fixed)
                found.append(text is not None)
                made.append(ruled_text(blocks, texts or ()) if text is None else text)
            yield pa.record_batch([*batch.columns[:at], pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64()), pa.array(found, pa.bool_())], [*batch.schema.names[:at], "text", "n_chars", "by_template"])
        release()

    return joined.mapInArrow(run, schema)
