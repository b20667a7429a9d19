"""Sources whose records are whole files: paper XML, sitemaps, web archives, books and zipped CSV.

Each file is one row of `binaryFile` and is parsed by one call, so memory holds a
file at a time and files spread over tasks. A file that can't be parsed is an
error that names it.
"""

from __future__ import annotations

import datetime
import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.pandas_text import xhtml_blocks

# The licences that papers are taken under, the latest day, and the least characters of abstracts, bodies and paragraphs.
CC_BY = re.compile(r"creativecommons\.org/licenses/by/4\.0", re.I)
CC_ZERO = re.compile(r"creativecommons\.org/publicdomain/zero/1\.0", re.I)
LAST_DAY = "2022-12-31"
LEAST_ABSTRACT, LEAST_BODY, LEAST_PARAGRAPH = 300, 1000, 80
_HREF = "{http://www.w3.org/1999/xlink}href"


def each_file(spark: SparkSession, path: str, parse: Callable[[bytes, str], list[dict]], ddl: str, columns: list[str]) -> DataFrame:
    """The rows that parse(content, path) gives for each file that matches."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = parse(content, where)
                except Exception as e:
                    raise ValueError(f"{where}: {e}") from e
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ddl)


def plain(node: ET.Element | None) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def spaced(node: ET.Element | None) -> str:
    return "" if node is None else " ".join(" ".join(node.itertext()).split())


def _day(meta: ET.Element) -> str:
    """The earliest of the article's dates with a year; missing months and days count as 1."""
    days = []
    for node in meta.findall("./pub-date"):
        y, m, d = (plain(node.find(f"./{k}")) for k in ("year", "month", "day"))
        if y.isdigit():
            days.append(datetime.date(int(y), int(m) if m.isdigit() else 1, int(d) if d.isdigit() else 1).isoformat())
    return min(days, default="")


def _paragraphs(node: ET.Element, out: list[str]) -> None:
    for child in node:
        if child.tag in ("fig", "table-wrap", "supplementary-material"):
            continue
        if child.tag == "p" and len(text := spaced(child)) >= LEAST_PARAGRAPH:
            out.append(text)
        _paragraphs(child, out)


def parse_jats(article: ET.Element) -> tuple[str, dict | None]:
    """(verdict, paper) of one article: accepted, or why not."""
    meta = article.find("./front/article-meta")
    if meta is None or article.get("article-type") == "preprint":
        return "kind", None
    licence = meta.find("./permissions/license")
    if licence is None:
        return "licence", None
    url = licence.get(_HREF, "") or next((plain(n) for n in licence.iter() if n.tag.rpartition("}")[2] == "license_ref"), "")
    name = "CC BY 4.0" if CC_BY.search(url) else "CC0 1.0" if CC_ZERO.search(url) else None
    if name is None:
        return "licence", None
    day = _day(meta)
    if not day or day > LAST_DAY:
        return "date", None
    ids = {n.get("pub-id-type"): plain(n) for n in meta.findall("./article-id")}
    number = (ids.get("pmcid") or ids.get("pmc") or "").removeprefix("PMC")
    if not number:
        return "id", None
    abstract, paragraphs = spaced(meta.find("./abstract")), []
    if (body := article.find("./body")) is not None:
        _paragraphs(body, paragraphs)
    text = "\n\n".join(paragraphs)
    if len(abstract) < LEAST_ABSTRACT or len(text) < LEAST_BODY:
        return "length", None
    authors = [f"{plain(n.find('./name/given-names'))} {plain(n.find('./name/surname'))}".strip() for n in meta.findall("./contrib-group/contrib[@contrib-type='author']") if plain(n.find("./name/surname"))]
    return "accepted", {
        "source_id": f"PMC{number}", "doi": ids.get("doi", ""), "title": spaced(meta.find("./title-group/article-title")), "authors": authors,
        "journal": spaced(article.find("./front/journal-meta/journal-title-group/journal-title")), "publication_date": day, "license": name, "abstract": abstract, "body": text,
    }


_JATS = ["source_id", "doi", "title", "authors", "journal", "publication_date", "license", "abstract", "body"]


def read_jats(spark: SparkSession, path: str) -> DataFrame:
    """(verdict, paper fields) for each article of JATS files; the fields of rejected ones are null."""

    def parse(content: bytes, _: str) -> list[dict]:
        root = ET.fromstring(content)
        found = [parse_jats(a) for a in ([root] if root.tag == "article" else root.iter("article"))]
        return [{"verdict": v, **(paper or {})} for v, paper in found]

    ddl = "verdict string, source_id string, doi string, title string, authors array<string>, journal string, publication_date string, license string, abstract string, body string"
    return each_file(spark, path, parse, ddl, ["verdict", *_JATS])


def read_volumes(spark: SparkSession, path: str, first: int = 2016, last: int = 2022) -> DataFrame:
    """(source_id, year, venue, volume, title, authors, abstract): papers of volume XML files named by year, with a title and an abstract of 400 characters and 80 words."""

    def parse(content: bytes, where: str) -> list[dict]:
        stem = PurePosixPath(where).stem
        if not stem[:4].isdigit() or not first <= int(stem[:4]) <= last:
            return []
        rows = []
        for volume in ET.fromstring(content).findall("./volume"):
            for paper in volume.findall("./paper"):
                title, abstract = spaced(paper.find("./title")), spaced(paper.find("./abstract"))
                if title and len(abstract) >= 400 and len(abstract.split()) >= 80:
                    names = [" ".join(x for k in ("first", "last") if (x := plain(a.find(f"./{k}")))) for a in paper.findall("./author")]
                    rows.append({
                        "source_id": f"{stem}-{volume.get('id', '')}.{paper.get('id')}", "year": int(stem[:4]), "venue": spaced(volume.find("./meta/venue")), "volume": volume.get("id", ""),
                        "title": title, "authors": [n for n in names if n], "abstract": abstract,
                    })
        return rows

    ddl = "source_id string, year int, venue string, volume string, title string, authors array<string>, abstract string"
    return each_file(spark, path, parse, ddl, ["source_id", "year", "venue", "volume", "title", "authors", "abstract"])


def read_sitemaps(spark: SparkSession, path: str, url_match: str, index_match: str = "") -> tuple[DataFrame, DataFrame]:
    """(pages, sitemaps): distinct URLs of sitemap files that hold url_match, and those of index files that hold index_match."""

    def parse(content: bytes, _: str) -> list[dict]:
        root = ET.fromstring(content)
        index = root.tag.rpartition("}")[2] == "sitemapindex"
        return [{"is_index": index, "url": plain(n)} for n in root.iter() if n.tag.rpartition("}")[2] == "loc"]

    rows = each_file(spark, path, parse, "is_index boolean, url string", ["is_index", "url"]).distinct()
    pick = lambda index, match: rows.filter(rows["is_index"] == index).filter(rows["url"].contains(match)).select("url")
    return pick(False, url_match), pick(True, index_match)


def warc_payload(record: bytes) -> bytes:
    """The page of one archived response: gzip around the record, two headers, and gzip around the body if there is one."""
    raw = gzip.decompress(record) if record[:2] == b"\x1f\x8b" else record
    parts = raw.split(b"\r\n\r\n", 2)
    if len(parts) < 3:
        raise ValueError("a record has an archive header, a response header and a body")
    return gzip.decompress(parts[2]) if parts[2][:2] == b"\x1f\x8b" else parts[2].removesuffix(b"\r\n\r\n")


def read_warc(spark: SparkSession, index: DataFrame, offset: str = "offset", length: str = "length", name: str = "path") -> DataFrame:
    """index plus `html`: the response at each byte range. The archives are read as whole files by Spark, ranges of one file in one task."""
    listed = [r[0] for r in index.select(name).distinct().toLocalIterator()]  # names of archives, not records
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    content = spark.read.format("binaryFile").load(listed).select(bare("path").alias("__path"), "content")
    joined, columns = index.join(content, bare(name) == F.col("__path")), index.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            html = [warc_payload(bytes(c[int(a) : int(a) + int(n)])).decode("utf-8", "replace") for c, a, n in zip(pdf["content"], pdf[offset], pdf[length], strict=True)]
            yield pdf[columns].assign(html=html)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema), "html string"])
    return joined.select(*columns, "content").mapInPandas(run, ddl)


#: Parts of file names that are no text of a book.
FRONT_MATTER = ("titlepage", "imprint", "colophon", "uncopyright", "halftitle", "toc", "endnotes", "loi", "dedication", "epigraph")


def parse_book(content: bytes) -> dict:
    """title, author, date, rights, subjects and text of a book packed as tar.gz, its files in the order of the package's spine."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
        members = {m.name: m for m in tar.getmembers() if m.isfile()}
        package = next((n for n in members if n.endswith("/src/epub/content.opf")), None)
        if package is None:
            raise ValueError("the archive has no package file")
        base = package.removesuffix("content.opf")
        opf = ET.fromstring(tar.extractfile(members[package]).read())
        named = lambda k: [n for n in opf.iter() if n.tag.rpartition("}")[2] == k]
        hrefs = {n.get("id"): n.get("href", "") for n in named("item")}
        blocks: list[str] = []
        for ref in named("itemref"):
            href = unquote(hrefs.get(ref.get("idref"), "")).removeprefix("./")
            file = members.get(base + href)
            if file is None or not href.endswith(".xhtml") or not href.startswith("text/") or any(x in PurePosixPath(href).name.lower() for x in FRONT_MATTER):
                continue
            blocks += xhtml_blocks(tar.extractfile(file).read())
        first = lambda k: next((plain(n) for n in named(k)), None)
        return {"title": first("title"), "author": first("creator"), "date": first("date"), "rights": first("rights"), "subjects": [plain(n) for n in named("subject")], "text": "\n\n".join(blocks)}


def read_books(spark: SparkSession, path: str) -> DataFrame:
    ddl = "title string, author string, date string, rights string, subjects array<string>, text string"
    return each_file(spark, path, lambda content, _: [parse_book(content)], ddl, ["title", "author", "date", "rights", "subjects", "text"])


def read_zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """The given columns, as text, of a CSV within ZIP archives; a column that isn't there is an error."""

    def parse(content: bytes, _: str) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
            return pd.read_csv(f, usecols=columns, dtype=str, keep_default_na=False, encoding="utf-8-sig")[columns].to_dict("records")

    return each_file(spark, path, parse, ", ".join(f"`{c}` string" for c in columns), columns)
