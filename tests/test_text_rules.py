"""Cleaners, article rules, packing, excerpts and file sources, against loops that follow the rules."""

import gzip
import io
import random
import re
import tarfile
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import pandas_text as P
from corpusmill.functions import text as X
from corpusmill.operators import intervals as I

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def values(spark, texts, column):
    return [r.y for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", column.alias("y")).orderBy("i").collect()]


def test_cleaners(spark):
    texts = ["Abstract: we show. Introduction: this", "**Methods** : a  b -", None, "", "- Results:\nx", "abstracts: stay"]
    assert values(spark, texts, X.drop_labels("s")) == ["we show. Introduction: this", "a b", None, "", "x", "abstracts: stay"]
    rows = [("Title: On  Things\nWe show.", "On Things", "We show."), ("On thing\nWe show.", "On Things", "We show."), ("We show.\nOn Things", "On Things", "We show. On Things"), ("On Things", "On Things", "On Things"), (None, "x", None), ("a\nb", None, "a b")]
    got = spark.createDataFrame(rows, "s string, t string, want string").select(P.clean_abstract("s", "t").alias("y"), "want").collect()
    assert all(r.y == r.want for r in got)
    texts = ["text\n**Title: A b\nrest title: c", "Title - x", "no heading", "my title: x\ntitle: y\nz"]
    assert values(spark, texts, X.clean_generated("s")) == ["text rest title: c", "", "no heading", "my title: x z"]
    texts = ["Sure, here:\n\nOne\n Two", "Sure, here:", "a</think> **Title: b\nc</think>d", "**  #Here\nx", "\tSure\nx", None]
    assert values(spark, texts, X.strip_preamble("s")) == ["one two", "sure, here:", "c</think>d", "x", "sure x", None]
    texts = ["One. Two", "One." + "x" * 299, "One." + "x" * 300, "no stop", 'said "x"', ". x", None]
    assert values(spark, texts, X.trim_tail("s")) == ["One.", "One.", "One." + "x" * 300, "no stop", 'said "x"', ". x", None]


def test_vocabulary_tokens(spark):
    texts = ["See HTTPS://www.Example.co.uk:80/a?b and http://u@localhost/ — x_ 12 a1-", "<b class=x>one</b> snyk-js-a-1234 snyk-js-a-123", "", None]
    want = [["[co-url]", "[localhost-url]", "—", "see", "and", "x", "a1"], ["one", "[snyk-id]", "snyk-js-a-123"], [], None]
    assert values(spark, texts, X.vocabulary_tokens("s")) == want


def test_prompt_tokens(spark):
    texts = ["Ｆｕｌｌ Width ﬁn", "Straße 12", "", None]
    want = [None if t is None else re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold()) for t in texts]
    assert values(spark, texts, P.prompt_tokens("s")) == want == [["full", "width", "fin"], ["strasse", "12"], [], None]


def test_tagged_columns(spark):
    texts = ["a [-[b]-] c", "no tag", "[-[a", "]-]", None]
    got = values(spark, texts, P.tagged_spans("[-[", "]-]")("s"))
    assert got[0].text == "a b c" and [tuple(s) for s in got[0].spans] == [(2, 3)] and got[1].spans == []
    assert all(g.text is None and g.spans is None and g.error for g in got[2:4]) and got[4].text is None and got[4].error is None


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    docs = [[prose(rng, rng.choice([3, 20, 60, 140])) for _ in range(rng.randrange(0, 14))] for _ in range(12)]
    df = spark.createDataFrame([(i, d, [len(x.split()) for x in d]) for i, d in enumerate(docs)], "i int, p array<string>, n array<int>")
    got = {r.i: r for r in df.select("i", I.pack_chunks(F.col("p"), F.col("n"), 100, 40).alias("a"), I.pack_chunks(F.col("p"), F.col("n"), 80, 50, longest=130, keep_short=True, between=" ").alias("b")).collect()}
    for i, parts in enumerate(docs):
        chunks, held = [], []
        for p in [*parts, None]:
            if held and (p is None or len(" ".join([*held, p]).split()) > 100):
                chunks.append("\n".join(held))
                held = []
            held += [p] if p else []
        assert [x.text for x in got[i].a] == [c for c in chunks if len(c.split()) >= 40]
        chunks, held = [], []
        for p in parts:
            if len(p.split()) > 130:
                continue
            size = sum(len(x.split()) for x in held)
            if size >= 50 and size + len(p.split()) > 80:
                chunks.append(" ".join(held))
                held = []
            held.append(p)
        assert [x.text for x in got[i].b] == [c for c in [*chunks, " ".join(held)] if 50 <= len(c.split()) <= 130]


def test_article_rules():
    rng = random.Random(1)
    p = [prose(rng, 30) for _ in range(100)]
    page = lambda inner: f"<html><body><p>{prose(rng, 40)}</p><article><h2>Lead</h2>{inner}</article><p>{prose(rng, 40)}</p></body></html>"
    body = "".join(f"<p>{x}</p>" for x in p[:20])
    assert P.article(page(body)) == ("accepted", "\n\n".join(p[:20]))
    assert P.article("<html><p>x</p></html>") == ("missing_body", None) and P.article(page("<p>too short</p>"))[0] == "too_short"
    assert P.article(page(body + f"<p>{p[30]} reprinted with permission</p>")) == ("possible_third_party_rights", None)
    extra = f"<figure><figcaption>{p[40]}</figcaption></figure><div class='share x'><p>{p[41]}</p></div><blockquote><p>{p[42]}</p></blockquote><p>Photo: {p[43]}</p><p>a few words</p>"
    assert P.article(page(body + extra + f"<h3>References</h3><p>{p[44]}</p>")) == ("accepted", "\n\n".join(p[:20]))
    long = P.article(page("".join(f"<p>{x}</p>" for x in p)))[1]
    assert long == "\n\n".join(p[:60])  # 1,800 words at thirty a paragraph


def test_dated_sections():
    long = "one two three four five six seven eight nine"
    assert P.dated_sections(f"May 2004\n\n{long}\n \nshort\n\n{long} b\n\nThanks to x\n\n{long}") == ("2004-05-01", f"{long}\n\n{long} b")
    assert P.dated_sections(f"May 7, 2004\n\n{long}")[0] == "2004-05-07"
    for bad in ("", f"2004\n\n{long}", f"February 31, 2004\n\n{long}", f"{long}\n\nMay 2004"):
        assert P.dated_sections(bad) == (None, "")


def test_excerpts():
    rng = random.Random(3)
    for k in range(40):
        sentences = [prose(rng, rng.randrange(4, 25)).capitalize() + f" s{i}." for i in range(rng.randrange(1, 14))]
        a, b = P.two_excerpts(" ".join(sentences), str(k), 30)
        assert not set(re.findall(r"s\d+\.", a)) & set(re.findall(r"s\d+\.", b))
        assert a in " ".join(sentences) and b in " ".join(sentences) and (a, b) == P.two_excerpts(" ".join(sentences), str(k), 30)


def test_sections(spark):
    rows = [(1, i, tag, text) for i, (tag, text) in enumerate([("p", "before"), ("h2", "Start here"), ("p", "one"), ("h3", "Skip me"), ("p", "two"), ("h2", "More"), ("p", "three"), ("h2", "End"), ("p", "four")])]
    df = spark.createDataFrame(rows, "d int, at int, tag string, text string")
    got = I.sections(df, "d", "at", ["Start"], ["End"], ["Skip"]).orderBy("at").collect()
    assert [(r.heading, r.text) for r in got] == [("Start here", "one"), ("More", "three")]
    assert [r.text for r in I.sections(df, "d", "at").orderBy("at").collect()] == ["before", "one", "two", "three", "four"]


def test_html_sections_leave_nothing_out(spark, tmp_path):
    """Blocks behind the references, under the contents and equal to the one before stay, and headings of the fifth level are headings."""
    from hashlib import md5

    from corpusmill.queries.registry import QUERIES

    html = "<p>first</p><h1>Title</h1><p>Title</p><p>one</p><p>one</p><h2>Contents</h2><p>list</p><h5>Deep</h5><p>two</p><h2>References</h2><p>book</p><h2>More</h2><li>last</li>"
    spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["html_sections"](spark, str(tmp_path)).orderBy("place").collect()
    want = [(None, "first", True), ("Title", "Title", True), ("Title", "one", True), ("Title", "one", True), ("Contents", "list", False), ("Deep", "two", True), ("References", "book", False), ("More", "last", False)]
    assert [(r.heading, r.key, r.inside) for r in got] == [(h, md5(x.encode()).hexdigest(), i) for h, x, i in want]


def test_file_sources(spark, tmp_path):
    from corpusmill.sources import documents as D
    from corpusmill.sources import readers as RD
    from corpusmill.sources import writers as W

    long = " ".join(["abstract words"] * 60)
    para = " ".join(["body words"] * 60)
    article = lambda extra, when: f"""<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title-group><journal-title>J</journal-title></journal-title-group></journal-meta><article-meta>
      <article-id pub-id-type="pmcid">PMC12</article-id><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>On <i>x</i></article-title></title-group>
      <contrib-group><contrib contrib-type="author"><name><surname>Li</surname><given-names>A B</given-names></name></contrib></contrib-group>
      <pub-date><year>{when}</year><month>3</month></pub-date><permissions><license {extra}/></permissions><abstract><p>{long}</p></abstract></article-meta></front>
      <body><sec><p>{para}</p><fig><p>{para} figure</p></fig><p>{para}</p><p>short</p></sec></body></article>"""  # noqa: E731
    by = 'xlink:href="https://creativecommons.org/licenses/by/4.0/"'
    (tmp_path / "jats").mkdir()
    (tmp_path / "jats/a.xml").write_text(f"<set>{article(by, 2020)}{article('', 2020)}{article(by, 2024)}</set>")
    got = D.read_jats(spark, f"{tmp_path}/jats/*.xml").collect()
    assert sorted(r.verdict for r in got) == ["accepted", "date", "licence"]
    paper = next(r for r in got if r.verdict == "accepted")
    assert (paper.source_id, paper.doi, paper.title, paper.authors, paper.publication_date, paper.license) == ("PMC12", "10.1/x", "On x", ["A B Li"], "2020-03-01", "CC BY 4.0")
    assert paper.body == f"{para}\n\n{para}" and paper.abstract == long

    (tmp_path / "acl").mkdir()
    for name in ("2019.a", "2015.b"):
        (tmp_path / f"acl/{name}.xml").write_text(f"<collection><volume id='1'><meta><venue>v</venue></meta><paper id='7'><title>T</title><author><first>A</first><last>B</last></author><abstract>{long} more words</abstract></paper><paper id='8'><title>T</title><abstract>x</abstract></paper></volume></collection>")
    (row,) = D.read_volumes(spark, f"{tmp_path}/acl/*.xml").collect()
    assert (row.source_id, row.year, row.venue, row.authors) == ("2019.a-1.7", 2019, "v", ["A B"])

    (tmp_path / "maps").mkdir()
    (tmp_path / "maps/a.xml").write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x/news/1 </loc></url><url><loc>https://x/news/1</loc></url><url><loc>https://x/b</loc></url></urlset>')
    (tmp_path / "maps/i.xml").write_text("<sitemapindex><sitemap><loc>https://x/map-2.xml</loc></sitemap></sitemapindex>")
    pages, maps = D.read_sitemaps(spark, f"{tmp_path}/maps/*.xml", "/news/", "map-")
    assert [r.url for r in pages.collect()] == ["https://x/news/1"] and [r.url for r in maps.collect()] == ["https://x/map-2.xml"]

    record = lambda body: gzip.compress(b"WARC/1.0\r\nx: y\r\n\r\nHTTP/1.1 200\r\nz: w\r\n\r\n" + body)
    a, b = record(b"<p>one</p>\r\n\r\n"), record(gzip.compress("<p>zwei ü</p>".encode()))
    (tmp_path / "x.warc.gz").write_bytes(a + b)
    index = spark.createDataFrame([(1, f"{tmp_path}/x.warc.gz", 0, len(a)), (2, f"{tmp_path}/x.warc.gz", len(a), len(b))], "i int, path string, offset long, length long")
    assert {r.i: r.html for r in D.read_warc(spark, index).collect()} == {1: "<p>one</p>", 2: "<p>zwei ü</p>"}

    files = {
        "b/src/epub/content.opf": b"<package xmlns:dc='d'><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:subject>S</dc:subject></metadata><manifest><item id='1' href='text/one.xhtml'/><item id='2' href='text/two.xhtml'/><item id='3' href='text/colophon.xhtml'/></manifest><spine><itemref idref='2'/><itemref idref='1'/><itemref idref='3'/></spine></package>",
        "b/src/epub/text/one.xhtml": b"<html><body><p>first file</p></body></html>", "b/src/epub/text/two.xhtml": b"<html><body><p>second file</p></body></html>", "b/src/epub/text/colophon.xhtml": b"<html><body><p>no</p></body></html>",
    }
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    (tmp_path / "book.tar.gz").write_bytes(out.getvalue())
    (book,) = D.read_books(spark, f"{tmp_path}/book.tar.gz").collect()
    assert (book.title, book.author, book.subjects, book.text) == ("T", "A", ["S"], "second file\n\nfirst file")

    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in.csv", '﻿id,text,other\n1,"a\nb",x\n2,,y\n')
    assert sorted(tuple(r) for r in D.read_zipped_csv(spark, f"{tmp_path}/c.zip", "in.csv", ["id", "text"]).collect()) == [("1", "a\nb"), ("2", "")]
    with pytest.raises(Exception, match="missing"):
        D.read_zipped_csv(spark, f"{tmp_path}/c.zip", "in.csv", ["id", "missing"]).collect()

    (tmp_path / "g.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n{"a": 2}\n'))
    assert sorted(r.a for r in RD.read_jsonl(spark, f"{tmp_path}/g.jsonl.gz", spark.createDataFrame([], "a int").schema).collect()) == [1, 2]
    (tmp_path / "bom.csv").write_bytes("﻿id,text\n1,x\n".encode())
    assert RD.read_csv(spark, f"{tmp_path}/bom.csv", ["id", "text"]).first().text == "x"
    with pytest.raises(FileNotFoundError):
        RD.read_glob(spark, f"file://{tmp_path}/none*.parquet")
    W.copy_files(spark, f"file://{tmp_path}/maps", f"file://{tmp_path}/copied")
    assert (tmp_path / "copied/a.xml").read_bytes() == (tmp_path / "maps/a.xml").read_bytes()
    with pytest.raises(FileExistsError):
        W.copy_files(spark, f"file://{tmp_path}/maps", f"file://{tmp_path}/copied")
    twice = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert W.content_hash(twice).first() != W.content_hash(twice.filter("a = 2")).first()
    assert W.content_hash(twice).first() == W.content_hash(twice.orderBy(F.col("a").desc())).first()
