"""Cleaners that need Python, replay, and machine-learning baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import pandas_text as P
from corpusmill.functions import text as X
from corpusmill.operators import ml as L
from corpusmill.operators import replay as R
from corpusmill.operators.logistic import block_scores, fit_blocks, term_blocks
from corpusmill.operators.neighbours import nearest_vectors
from corpusmill.operators.terms import vocabulary
from corpusmill.queries.registry import Tables, query


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents), c AS (SELECT doc_id, coalesce(array_to_string(CASE WHEN len(l) > 1 THEN l[2:] ELSE l END, ' '), '') || ' Introduction: x. Results: y -' AS s FROM l)
SELECT doc_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\*\*\s*(?:abstract|background|methods?|results?|conclusions?)\s*\*\*\s*[:\-]?', '', 'g'), '(?i)\b(?:abstract|background|methods?|results?|conclusions?)\s*:\s*', '', 'g'), '\s+', ' ', 'g')), '^[ \-]+|[ \-]+$', '', 'g')) AS key FROM c""")
def clean_abstract(t: Tables) -> DataFrame:
    """Each document with its first line, labelled, as the title; section labels at the end."""
    first = F.trim(F.split("text", "\n")[0])
    text = F.concat(F.lit("Title: "), F.ltrim("text"), F.lit("\n Introduction: x. Results: y -"))
    alone = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")) < 2  # a text of one line isn't its own title
    return t.documents.select("doc_id", F.md5(P.clean_abstract(F.when(alone, F.concat("text", F.lit("\n Introduction: x. Results: y -"))).otherwise(text), F.when(alone, "").otherwise(first))).alias("key"))


@query()
def prompt_tokens(t: Tables) -> DataFrame:
    """NFKC has no SQL form; tests compare with Python."""
    d = t.conversations.select("conv_id", "turn", P.prompt_tokens("text").alias("w"))
    return d.select("conv_id", "turn", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("key"))


_LCP = """p AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))), 0) AS prefix FROM c)"""


@query(f"""WITH n AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), c AS (SELECT * FROM n WHERE b IS NOT NULL), {_LCP},
r AS (SELECT *, substr(a, prefix + 1) AS x, substr(b, prefix + 1) AS y FROM p)
SELECT conv_id, turn, CAST(prefix AS BIGINT) AS prefix, CAST(coalesce(list_max(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: right(x, i) = right(y, i))), 0) AS BIGINT) AS suffix FROM r""")
def common_prefix(t: Tables) -> DataFrame:
    """Common prefix and suffix of consecutive turns of a conversation."""
    from pyspark.sql import Window

    c = t.conversations.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next IS NOT NULL")
    return c.select("conv_id", "turn", P.common_affixes("text", "next").alias("x")).select("conv_id", "turn", "x.prefix", "x.suffix")


@query("""WITH k AS (SELECT doc_id, CAST(floor(length(text) * 3 / 5) AS BIGINT) AS kept, length(text) AS n FROM documents), g AS (SELECT *, kept + 1 + 40 * (doc_id % 4) AS total FROM k)
SELECT doc_id, CASE WHEN kept < 200 OR kept / total::DOUBLE < 0.5 OR total - kept < 80 THEN 'weak' ELSE 'kept' END AS verdict, kept AS boundary FROM g""")
def prefix_boundary(t: Tables) -> DataFrame:
    """Where a continued text leaves its source: the first three fifths of a document, then other text."""
    cut = F.expr("substring(text, 1, int(floor(length(text) * 3 / 5)))")
    more = F.expr("concat(char(1), repeat('q', int(40 * (doc_id % 4))))")
    d = t.documents.select("doc_id", F.concat(cut, more).alias("own"), "text").withColumn("x", P.common_affixes("own", "text"))
    kept, total = F.col("x.prefix"), F.length("own")
    weak = (kept < 200) | (kept.cast("double") / total.cast("double") < 0.5) | (total - kept < 80)
    return d.select("doc_id", F.when(weak, "weak").otherwise("kept").alias("verdict"), kept.alias("boundary"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, regexp_extract(text, '^(\S+\s+)\S+', 1) AS lead, regexp_extract(text, '^\S+\s+(\S+)', 1) AS word, contains(text, '[-[') OR contains(text, ']-]') AS tags FROM conversations)
SELECT conv_id, turn, NOT tags AS same, CASE WHEN NOT tags AND word <> '' THEN CAST(length(lead) AS INT) END AS start, CASE WHEN NOT tags AND word <> '' THEN CAST(length(lead) + length(word) AS INT) END AS "end" FROM c""")
def parse_tags(t: Tables) -> DataFrame:
    """Turns with their second word tagged, parsed back; a text that holds a tag of its own is an error, not a failure."""
    tagged = F.regexp_replace("text", r"^(\S+\s+)(\S+)", "$1[-[$2]-]")
    d = t.conversations.select("conv_id", "turn", "text", P.tagged_spans("[-[", "]-]")(tagged).alias("x"))
    one = F.get("x.spans", F.lit(0))
    return d.select("conv_id", "turn", (F.col("x.error").isNull() & F.col("x.text").eqNullSafe(F.col("text"))).alias("same"), one["start"].alias("start"), one["end"].alias("end"))


@query()
def html_text(t: Tables) -> DataFrame:
    """Blocks of own text of each page; tests check the parser."""
    d = t.pages.select("page_id", P.html_blocks("html").alias("b"))
    return d.select("page_id", F.size("b").alias("n_blocks"), F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("key"))


@query()
def html_article(t: Tables) -> DataFrame:
    """Verdict and article text of each page; tests check the rules."""
    d = t.pages.select("page_id", P.article_text(least=50)("html").alias("a"))
    return d.select("page_id", "a.verdict", X.word_count("a.text").alias("n_words"), F.md5("a.text").alias("key"))


@query()
def html_sections(t: Tables) -> DataFrame:
    """(page, heading, place, text, inside): every block of each page, repeats too, under its heading of any level, and whether it lies before the references and not under the contents; tests check the flags."""
    from corpusmill.operators.intervals import sections

    d = t.pages.select("page_id", F.posexplode(P.html_every_block("html")).alias("place", "b")).select("page_id", "place", "b.tag", "b.text")
    return sections(d, "page_id", "place", stop=["References"], skip=["Contents"], mark="inside").select("page_id", "heading", "place", F.md5("text").alias("key"), "inside")


@query()
def dated_prose(t: Tables) -> DataFrame:
    """Documents behind a date line, their lines as sections, notes at the end; tests compare with the rules."""
    text = F.concat(F.lit("March 3, 2020\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\nNotes\n\nthis is left out of the prose as it follows the notes heading"))
    d = t.documents.select("doc_id", P.dated_prose(text).alias("x"))
    return d.select("doc_id", "x.day", F.md5("x.prose").alias("key"))


@query()
def two_excerpts(t: Tables) -> DataFrame:
    """Two excerpts of about sixty words from the halves of each document; tests check that they share no sentence."""
    d = t.documents.select("doc_id", P.disjoint_excerpts(60)("text", F.col("doc_id").cast("string")).alias("x"))
    return d.select("doc_id", F.md5("x.first").alias("first"), F.md5("x.second").alias("second"))


@query("""WITH c AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 1 WHEN length(text) = 1 THEN 0 ELSE -100 END AS label FROM conversations WHERE length(text) > 0),
f AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM c)
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(sum(length(text)) AS INT) AS n_chars, CAST(sum(new) AS INT) AS n_spans, 0 AS edited FROM f GROUP BY conv_id""")
def replay(t: Tables) -> DataFrame:
    """Conversations as editing sessions: system text starts the document, user and assistant turns are appended."""
    from pyspark.sql import Window

    c = t.conversations.withColumn("n", F.length(F.encode("text", "utf-16le")).cast("int") / 2)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    name = F.col("conv_id").cast("string").alias("session")
    kind = "array<struct<retain:int,insert:string,delete:int>>"
    e = c.select(name, (F.col("turn") + 1).cast("int").alias("eventNum"), F.lit("text-insert").alias("eventName"), F.when(F.col("role") == "assistant", "api").otherwise("user").alias("eventSource"), F.lit(None).cast("string").alias("currentDoc"),
                 F.array(F.struct(before.alias("retain"), F.lit(None).cast("string").alias("insert"), F.lit(0).alias("delete")), F.struct(F.lit(0).alias("retain"), F.col("text").alias("insert"), F.lit(0).alias("delete"))).cast(kind).alias("ops"))
    first = t.conversations.select(name).distinct().select("session", F.lit(0).alias("eventNum"), F.lit("system-initialize").alias("eventName"), F.lit("system").alias("eventSource"), F.lit("").alias("currentDoc"), F.array().cast(kind).alias("ops"))
    return R.replay(first.unionByName(e)).select("session", F.length("text").alias("n_chars"), F.size("spans").alias("n_spans"), "edited")


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    return d.filter("NOT test"), d


def _baseline(t: Tables, grams, most: int) -> DataFrame:
    train, rows = _split(t)
    v = vocabulary(train, grams, 3, most)
    blocks = term_blocks(rows, ["doc_id", "label", "test"], "label", ~F.col("test") & F.col("label").isNotNull(), grams, v)
    return block_scores(fit_blocks(blocks, len(v)), blocks).select("doc_id", "label", "test", F.round("score", 6).alias("score"))


@query()
def tfidf_char(t: Tables) -> DataFrame:
    """Fitted, so without SQL; tests check the weights and the held-out rows."""
    return _baseline(t, L.char_ngrams("text"), 300_000)


@query()
def tfidf_word(t: Tables) -> DataFrame:
    return _baseline(t, L.word_ngrams("text"), 200_000)


@query()
def embedding_logistic(t: Tables) -> DataFrame:
    """Logistic regression on unit vectors; every fifth row by hash is held out."""
    e = t.embeddings.filter("embedding IS NOT NULL").select("vec_id", L.unit("embedding").alias("v"), F.col("label").cast("double").alias("label"))
    d = e.withColumn("test", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0).withColumn("features", L.array_to_vector("v"))
    model = L.logistic(d.filter("NOT test"), rounds=1000)
    return model.transform(d).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"), "test")


_VOCAB = [("the", "a", 0.5), ("and", "a", 0.25), ("of", "a", 0.25), ("der", "b", 0.5), ("die", "b", 0.25), ("und", "b", 0.25), ("de", "c", 0.5), ("la", "c", 0.25), ("que", "c", 0.25)]


@query(r"""WITH v(term, cluster, weight) AS (VALUES ('the', 'a', 0.5::DOUBLE), ('and', 'a', 0.25), ('of', 'a', 0.25), ('der', 'b', 0.5), ('die', 'b', 0.25), ('und', 'b', 0.25), ('de', 'c', 0.5), ('la', 'c', 0.25), ('que', 'c', 0.25)),
x AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'))) AS term FROM documents), s AS (SELECT doc_id, cluster, sum(weight) AS s FROM x JOIN v USING (term) GROUP BY 1, 2),
f AS (SELECT doc_id, c.cluster, coalesce(s, 0) AS s FROM documents CROSS JOIN (SELECT DISTINCT cluster FROM v) c LEFT JOIN s USING (doc_id, cluster))
SELECT a.doc_id, a.cluster, round(a.s - ln(sum(exp(b.s))), 9) AS logodds FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.cluster <> b.cluster GROUP BY a.doc_id, a.cluster, a.s""")
def vocabulary_scores(t: Tables) -> DataFrame:
    w = t.spark.createDataFrame(_VOCAB, "term string, cluster string, weight double")
    s = L.vocabulary_scores(t.documents, "doc_id", F.array_distinct(X.tokens("text")), w)
    return s.select("doc_id", "cluster", F.round("logodds", 9).alias("logodds"))


@query()
def linear_probe(t: Tables) -> DataFrame:
    """Labels of held-out vectors from a linear probe."""
    e = t.embeddings.filter("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    d = e.withColumn("test", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)
    return L.probe(d, "v", "label", ~F.col("test")).select("vec_id", "label", "predicted", "test")


@query("""WITH x AS (SELECT vec_id // 4 AS document, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT document, CAST(i AS INT) AS i, round(avg(x), 6) AS mean FROM x GROUP BY 1, 2""")
def document_vector(t: Tables) -> DataFrame:
    """The mean vector of each document's windows; four vectors in a row stand for the windows of a document."""
    return t.embeddings.select(F.expr("vec_id div 4").alias("document"), F.posexplode("embedding").alias("i", "x")).groupBy("document", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS mean FROM x GROUP BY 1, 2""")
def mean_vector(t: Tables) -> DataFrame:
    return t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM u),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS cosine FROM n a JOIN n b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id, cosine FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) = 1""")
def nearest_neighbour(t: Tables) -> DataFrame:
    """The stated query set, ids divisible by 20, against all vectors, in blocks."""
    return nearest_vectors(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding")
