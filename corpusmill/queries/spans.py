"""Spans, tokens and windows over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import spans as S
from corpusmill.queries.registry import Tables, query

_TURNS = """t AS (SELECT conv_id, turn, role, text, length(text) AS n, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -100 END AS label, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM conversations)"""


def turn_spans(t: Tables) -> DataFrame:
    """(conv_id, text, spans): turns joined in order, with a span for each run of one role."""
    label = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(S.MASKED)
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"), label.alias("label"), "text"))).alias("x"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(S.SPANS).alias("out"))
    walk = lambda a, x: F.struct((a["at"] + x["n"]).cast("int").alias("at"), F.concat(a["out"], F.array(S.span(a["at"], a["at"] + x["n"], x["label"]))).alias("out"))
    d = c.select("conv_id", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("text"), F.aggregate("x", start, walk, lambda a: a["out"]).alias("raw"))
    return d.select("conv_id", "text", S.merge_adjacent(F.col("raw")).alias("spans"))


_ISLANDS = f"""{_TURNS}, f AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM t WHERE n > 0),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM f), m AS (SELECT conv_id, CAST(min(off) AS BIGINT) AS start, CAST(max(off + n) AS BIGINT) AS "end", CAST(min(label) AS INT) AS label FROM g GROUP BY conv_id, g)"""


@query(f"WITH {_ISLANDS} SELECT * FROM m")
def turns_to_spans(t: Tables) -> DataFrame:
    return turn_spans(t).select("conv_id", F.explode("spans").alias("s")).select("conv_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.label")


@query(f"""WITH {_ISLANDS} SELECT conv_id, CASE WHEN bool_or(label = 0) AND bool_or(label = 1) THEN 'mixed' WHEN bool_or(label = 0) THEN 'human' WHEN bool_or(label = 1) THEN 'ai' END AS kind FROM m GROUP BY 1""")
def span_kind(t: Tables) -> DataFrame:
    return turn_spans(t).select("conv_id", S.kind(F.col("spans")).alias("kind"))


@query(f"""WITH {_ISLANDS}, k AS (SELECT conv_id, CASE WHEN bool_or(label = 0) AND bool_or(label = 1) THEN 'mixed' WHEN bool_or(label = 0) THEN 'human' WHEN bool_or(label = 1) THEN 'ai' END AS kind, bool_or(label = -100) AS masked FROM m GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'unlabeled' WHEN masked THEN 'invalid_spans' WHEN kind IS DISTINCT FROM 'mixed' THEN 'kind_mismatch' ELSE 'valid' END AS verdict FROM k""")
def span_validity(t: Tables) -> DataFrame:
    """All conversations claim to be mixed; every seventh comes without spans; masked spans are invalid."""
    d = turn_spans(t).withColumn("spans", F.when(F.col("conv_id") % 7 == 0, None).otherwise(F.col("spans")))
    return d.select("conv_id", S.validity(F.col("spans"), F.length("text"), F.lit("mixed")).alias("verdict"))


@query(r"""WITH w AS (SELECT doc_id, length(text) AS n, 10 + doc_id % 7 AS a, 30 + doc_id % 11 AS b, 45 AS c, 45 + doc_id % 5 AS d FROM documents),
p AS (SELECT doc_id, CASE WHEN d > c AND d <= n THEN CASE WHEN d < n THEN [0, a, b, c, d, n] ELSE [0, a, b, c, n] END END AS e FROM w)
SELECT doc_id, e IS NOT NULL AS valid, CAST(coalesce(len(e) - 1, 0) AS BIGINT) AS n_parts, CAST(CASE WHEN e IS NULL THEN 0 ELSE e[3] - e[2] + e[5] - e[4] END AS BIGINT) AS labelled FROM p""")
def span_partition(t: Tables) -> DataFrame:
    """Two intervals of each document as a full partition; empty or outlying ones make it invalid."""
    i = F.col("doc_id")
    two = F.array(F.struct((10 + i % 7).cast("int").alias("start"), (30 + i % 11).cast("int").alias("end")), F.struct(F.lit(45).alias("start"), (45 + i % 5).cast("int").alias("end")))
    d = t.documents.select("doc_id", S.partition(two, F.length("text")).alias("p"))
    total = F.aggregate(F.filter("p", lambda s: s["label"] == 1), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return d.select("doc_id", F.col("p").isNotNull().alias("valid"), F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_parts"), F.coalesce(total, F.lit(0)).cast("long").alias("labelled"))


@query(f"WITH {_ISLANDS} SELECT conv_id, count(*) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS chars FROM m WHERE label >= 0 GROUP BY 1")
def merge_spans(t: Tables) -> DataFrame:
    d = turn_spans(t).select("conv_id", F.explode(F.filter("spans", lambda s: s["label"] >= 0)).alias("s"))
    return d.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("chars"))


@query(rf"""WITH {_TURNS}, c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1), p AS (SELECT conv_id, regexp_extract_all(text, '\s+|\S+') AS p FROM c),
u AS (SELECT conv_id, unnest(p) AS w, unnest(range(len(p))) AS i FROM p), o AS (SELECT conv_id, w, i, coalesce(sum(length(w)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u),
x AS (SELECT o.conv_id, i, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE -100 END AS label FROM o JOIN t ON o.conv_id = t.conv_id AND t.off < o.s + length(w) AND t.off + t.n > o.s WHERE regexp_matches(w, '^\S') GROUP BY o.conv_id, i)
SELECT conv_id, label, count(*) AS n FROM x GROUP BY 1, 2""")
def span_token_label(t: Tables) -> DataFrame:
    """Words of whole conversations with the label of the turns they lie in; words across a boundary are masked."""
    d = turn_spans(t).select("conv_id", F.explode(S.token_labels(S.word_offsets("text"), F.col("spans"))).alias("label"))
    return d.groupBy("conv_id", "label").agg(F.count("*").alias("n"))


@query(r"""WITH n AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS n FROM documents)
SELECT DISTINCT doc_id, CAST(s AS INT) AS start FROM (SELECT doc_id, unnest(range(0, greatest(n - 512, 0) + 1, 256)) AS s FROM n UNION ALL SELECT doc_id, greatest(n - 512, 0) FROM n)""")
def window_starts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(S.window_starts(X.word_count("text").cast("int"))).alias("start"))


@query("""SELECT conv_id, 2 * count(*) AS n, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS supervised FROM conversations GROUP BY 1""")
def repeat2(t: Tables) -> DataFrame:
    """Each conversation's turns twice, the first copy masked."""
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("y")))).alias("x"))
    ids, labels = S.repeat_twice(F.transform("x", lambda x: x["turn"]), F.transform("x", lambda x: x["y"]))
    d = c.select("conv_id", ids.alias("ids"), labels.alias("labels"))
    return d.select("conv_id", F.size("ids").cast("long").alias("n"), F.size(F.filter("labels", lambda y: y == 1)).cast("long").alias("supervised"))


def window_scores(t: Tables) -> DataFrame:
    """(doc_id, starts, scores): a document's windows of 64 words, 32 apart, each word scored by its length and the window's start."""
    d = t.documents.select("doc_id", F.transform(X.words("text"), F.length).alias("w"))
    d = d.select("doc_id", "w", S.window_starts(F.size("w"), 64, 32).alias("starts"))
    score = lambda at: F.transform(F.slice("w", at + 1, F.lit(64)), lambda n: n.cast("double") / 10 + (at % 7).cast("double") / 100)
    return d.select("doc_id", "starts", F.transform("starts", score).alias("scores"))


def stitched_scores(t: Tables) -> DataFrame:
    """(doc_id, scores)."""
    d = S.stitch_rows(window_scores(t), "doc_id", "starts", "scores")
    return d.select("doc_id", F.transform("scores", lambda x: F.round(x, 9)).alias("scores"))


_SCORES = r"""w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), st AS (SELECT DISTINCT doc_id, w, s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 64, 0) + 1, 32)) AS s FROM w UNION ALL SELECT doc_id, w, greatest(len(w) - 64, 0) FROM w)),
ps AS (SELECT doc_id, s, w, unnest(range(s, least(s + 64, len(w)))) AS pos FROM st), sc AS (SELECT doc_id, pos, round(avg(length(w[pos + 1])::DOUBLE / 10 + (s % 7)::DOUBLE / 100), 9) AS score FROM ps GROUP BY 1, 2)"""


@query(f"WITH {_SCORES} SELECT doc_id, CAST(pos AS INT) AS pos, score FROM sc")
def stitch_scores(t: Tables) -> DataFrame:
    return stitched_scores(t).select("doc_id", F.posexplode("scores").alias("pos", "score"))


@query(f"WITH {_SCORES} SELECT doc_id, count(*) AS n, round(max(score), 6) AS top, CAST(sum(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS over FROM sc GROUP BY 1")
def span_scores(t: Tables) -> DataFrame:
    """A ragged score cache, one row of arrays per document, summed up."""
    s = stitched_scores(t)
    n = F.size("scores") + 0 * F.monotonically_increasing_id()  # the row number, times zero, keeps the filter behind the rounded scores
    return s.select("doc_id", n.alias("n"), F.round(F.array_max("scores"), 6).alias("top"), F.size(F.filter("scores", lambda x: x >= 0.9)).cast("long").alias("over")).filter("n > 0")


@query(f"WITH {_SCORES}, m AS (SELECT doc_id, s, avg(length(w[pos + 1])::DOUBLE / 10 + (s % 7)::DOUBLE / 100) AS m FROM ps GROUP BY 1, 2) SELECT doc_id, count(*) AS n_windows, round(avg(m), 12) AS score FROM m GROUP BY 1")
def window_mean(t: Tables) -> DataFrame:
    """A document's score: the mean of its windows' mean scores."""
    mean = lambda x: F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v) / F.size(x)
    d = window_scores(t).select("doc_id", F.transform(F.filter("scores", lambda x: F.size(x) > 0), mean).alias("m"))
    d = d.select("doc_id", (F.size("m") + 0 * F.monotonically_increasing_id()).alias("n_windows"), F.when(F.size("m") > 0, F.round(mean(F.col("m")), 12)).alias("score"))
    return d.filter("n_windows > 0")  # the row number, times zero, keeps the filter here; below the windows it would work out the words again for each


@query(r"""WITH w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '\S+') AS w FROM documents), st AS (SELECT DISTINCT doc_id, lang, source, w, s FROM (SELECT *, unnest(range(0, greatest(len(w) - 512, 0) + 1, 256)) AS s FROM w UNION ALL SELECT *, greatest(len(w) - 512, 0) FROM w)),
x AS (SELECT source, lang, doc_id, s, len(list_filter(w[s + 1:s + 512], lambda x: length(x) >= 5)) AS long_words, len(w[s + 1:s + 512]) AS n FROM st),
d AS (SELECT source, lang, count(*) AS documents, sum(len(w)) AS tokens FROM w GROUP BY 1, 2)
SELECT d.source, d.lang, documents, count(*) AS windows, CAST(max(tokens) AS BIGINT) AS tokens, CAST(sum(long_words) AS BIGINT) AS supervised, CAST(2 * sum(n) AS BIGINT) AS processed FROM d JOIN x ON d.source = x.source AND d.lang = x.lang GROUP BY 1, 2, 3""")
def exposure_windows(t: Tables) -> DataFrame:
    """Documents, windows, tokens, supervised tokens (of five letters and more, counted in each window) and tokens of sequences that repeat each window, by source and language."""
    d = t.documents.select("source", "lang", X.words("text").alias("w")).withColumn("s", S.window_starts(F.size("w")))
    part = F.transform("s", lambda a: F.slice("w", a + 1, F.lit(512)))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    d = d.select("source", "lang", F.size("w").alias("n"), F.size("s").alias("k"), total(F.transform(part, lambda p: F.size(F.filter(p, lambda w: F.length(w) >= 5)))).alias("y"), total(F.transform(part, F.size)).alias("p"))
    return d.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("k").alias("windows"), F.sum("n").alias("tokens"), F.sum("y").alias("supervised"), (2 * F.sum("p")).alias("processed"))


_OFFS = r"""p AS (SELECT doc_id, regexp_extract_all(text, '\s+|\S+') AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS w, unnest(range(len(p))) AS i FROM p),
o AS (SELECT doc_id, w, coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u),
h AS (SELECT doc_id, s, s + length(w) AS e FROM o WHERE regexp_matches(w, '^\S') AND length(w) >= 9), f AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY doc_id ORDER BY s) + 1 >= s THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM f), m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, g)"""


def alarms(t: Tables) -> DataFrame:
    """Spans of words of nine characters and more."""
    d = t.documents.select("doc_id", S.word_offsets("text").alias("o"))
    scores = F.transform("o", lambda o: (o["end"] - o["start"]).cast("double"))
    return d.select("doc_id", S.alarm_spans(scores, F.col("o"), 9.0).alias("spans"))


@query(f"WITH {_OFFS} SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS chars, CAST(min(s) AS BIGINT) AS first FROM m GROUP BY 1")
def predicted_spans(t: Tables) -> DataFrame:
    d = alarms(t).select("doc_id", F.explode("spans").alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("chars"), F.min("s.start").cast("long").alias("first"))


@query(f"WITH {_OFFS} SELECT CASE WHEN e - s < 12 THEN '[0,12)' WHEN e - s < 24 THEN '[12,24)' WHEN e - s < 48 THEN '[24,48)' ELSE '[48,)' END AS bin, count(*) AS n FROM m GROUP BY 1")
def span_bins(t: Tables) -> DataFrame:
    n = F.col("s.end") - F.col("s.start")
    b = F.when(n < 12, "[0,12)").when(n < 24, "[12,24)").when(n < 48, "[24,48)").otherwise("[48,)")
    return alarms(t).select(F.explode("spans").alias("s")).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w, CAST('0x' || substr(sha256('excerpt:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents), k AS (SELECT doc_id, w, h % (len(w) - 29) AS f FROM w WHERE len(w) >= 30)
SELECT doc_id, CAST(f AS BIGINT) AS first_word, md5(ltrim(array_to_string(w[f + 1:f + 30], ''), ' ' || chr(9) || chr(10) || chr(13))) AS key FROM k""")
def excerpt(t: Tables) -> DataFrame:
    """Thirty consecutive words from a hash-derived place, with their original bytes."""
    d = excerpts(t, 30)
    return d.select("doc_id", "first_word", F.md5("cut").alias("key"))


def excerpts(t: Tables, k: int) -> DataFrame:
    h = F.conv(F.substring(X.salted("excerpt:", "doc_id"), 1, 8), 16, 10).cast("long")
    d = t.documents.select("doc_id", "text", S.hashed_run("text", h, F.lit(k).cast("long")).alias("o")).filter("o IS NOT NULL")
    a, b = F.col("o.start"), F.col("o.end")
    return d.select("doc_id", "o.first_word", a.alias("start"), b.alias("end"), F.col("text").substr(a + 1, b - a).alias("cut"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w, CAST('0x' || substr(sha256('excerpt:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents), k AS (SELECT doc_id, w, h % (len(w) - 511) AS f FROM w WHERE len(w) >= 512),
o AS (SELECT doc_id, f, array_to_string(w[f + 1:f + 512], '') AS cut, coalesce(length(array_to_string(w[1:f], '')), 0) AS before FROM k), c AS (SELECT *, ltrim(cut, ' ' || chr(9) || chr(10) || chr(13)) AS own FROM o)
SELECT doc_id, CAST(f AS BIGINT) AS first_word, CAST(before + length(cut) - length(own) AS INT) AS start, CAST(before + length(cut) AS INT) AS "end", md5(own) AS key FROM c""")
def bounded_excerpt(t: Tables) -> DataFrame:
    """One window of 512 words of longer texts, its place kept."""
    return excerpts(t, 512).select("doc_id", "first_word", "start", "end", F.md5("cut").alias("key"))


@query("""WITH g AS (SELECT conv_id, turn // 2 AS pair, count(*) AS n, count(DISTINCT role) AS roles FROM conversations WHERE role <> 'system' GROUP BY 1, 2)
SELECT conv_id, pair, n = 2 AND roles = 2 AS valid FROM g""")
def group_shape(t: Tables) -> DataFrame:
    """Groups of exactly one user and one assistant row."""
    g = t.conversations.filter("role <> 'system'").groupBy("conv_id", F.expr("turn div 2").alias("pair")).agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"))
    return g.select("conv_id", "pair", ((F.col("n") == 2) & (F.col("roles") == 2)).alias("valid"))


@query(r"""WITH w AS (SELECT doc_id, doc_id // 2 AS pair, regexp_extract_all(text, '\S+') AS w FROM documents), m AS (SELECT *, min(len(w)) OVER (PARTITION BY pair) AS least FROM w)
SELECT doc_id, pair, md5(array_to_string(w[1:50], ' ')) AS opening, md5(array_to_string(w[len(w) - 49:len(w)], ' ')) AS ending FROM m WHERE least >= 50""")
def pair_windows(t: Tables) -> DataFrame:
    """Opening and ending windows; if one of a pair is short, both go."""
    from pyspark.sql import Window

    d = t.documents.select("doc_id", F.expr("doc_id div 2").alias("pair"), X.words("text").alias("w"))
    d = d.withColumn("least", F.min(F.size("w")).over(Window.partitionBy("pair"))).filter("least >= 50")
    return d.select("doc_id", "pair", F.md5(F.array_join(F.slice("w", 1, 50), " ")).alias("opening"), F.md5(F.array_join(F.slice("w", -50, 50), " ")).alias("ending"))


@query(f"""WITH {_TURNS}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t)
SELECT conv_id, CAST(max(off + n + 2 * i) AS BIGINT) AS total, CAST(sum(off + 2 * i) AS BIGINT) AS starts, count(*) AS n FROM x GROUP BY 1""")
def shift_spans(t: Tables) -> DataFrame:
    """Turns as span documents, joined with two characters between them; child spans are shifted by the running offset."""
    one = F.array(S.span(F.lit(0), F.length("text"), F.lit(1)))
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"), one.alias("spans")))).alias("x"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(S.SPANS).alias("out"))
    walk = lambda a, x: F.struct((a["at"] + x["n"] + 2).cast("int").alias("at"), F.concat(a["out"], S.shift(x["spans"], a["at"])).alias("out"))
    d = c.select("conv_id", F.explode(F.aggregate("x", start, walk, lambda a: a["out"])).alias("s"))
    return d.groupBy("conv_id").agg(F.max("s.end").cast("long").alias("total"), F.sum("s.start").cast("long").alias("starts"), F.count("*").alias("n"))


_NAMES = "['unaltered_source', 'same_label_short_join', 'same_label_long_join', 'same_source_short_mix', 'same_source_long_mix']"
_ASSEMBLED = rf"""n AS (SELECT doc_id, source, CAST(doc_id % 2 AS INT) AS label, len(regexp_extract_all(text, '\S+')) AS n FROM documents), e AS (SELECT * FROM n WHERE n >= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY sha256('assemble:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source, label) AS m FROM e),
d AS (SELECT doc_id AS output_id, source, label AS first, CAST(CAST('0x' || substr(sha256('plan:' || doc_id), 1, 8) AS BIGINT) AS BIGINT) AS h, rn FROM r),
p AS (SELECT *, {_NAMES}[h % 5 + 1] AS construction, CASE h % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 + h // 5 % 2 WHEN 2 THEN 5 + h // 5 % 3 WHEN 3 THEN 2 ELSE 5 + h // 5 % 3 END AS parts FROM d),
q AS (SELECT *, 1 + h // 15 % greatest(parts - 2, 1) AS switch, unnest(range(parts)) AS i FROM p),
l AS (SELECT *, CASE WHEN h % 5 <= 2 THEN first WHEN h % 5 = 3 THEN CASE WHEN i = 0 THEN first ELSE 1 - first END WHEN i < switch THEN first WHEN i = parts - 1 AND parts >= 6 AND h // 105 % 2 = 0 THEN first ELSE 1 - first END AS label FROM q),
s AS (SELECT output_id, construction, i, l.label, r.doc_id AS source_id, CASE WHEN h % 5 = 0 THEN r.n WHEN h % 5 IN (1, 3) THEN [50, 90, 140][(h // 7 + i) % 3 + 1] ELSE [90, 140, 200][(h // 7 + i) % 3 + 1] END AS k, r.n, h FROM l JOIN r ON r.source = l.source AND r.label = l.label AND r.rn = (l.rn + i - 1) % r.m + 1 QUALIFY count(*) OVER (PARTITION BY output_id) = parts)"""


@query(f"WITH {_ASSEMBLED} SELECT output_id, construction, CAST(i AS INT) AS i, label, source_id, CAST(k AS INT) AS n_words, CAST((h // 11 + i) % (n - k + 1) AS BIGINT) AS first_word FROM s")
def assemble_plan(t: Tables) -> DataFrame:
    """Which excerpt of which document each part of an assembled document is: five constructions with one or both labels, all parts of one source."""
    return S.assembly_plan(assembly_parts(t))


def assembly_parts(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", (F.col("doc_id") % 2).cast("int").alias("label"), F.size(X.words("text")).alias("n"))
    return d.filter("n >= 200")


_PARTS = rf"""c AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w FROM documents),
x AS (SELECT output_id, i, label, source_id, ltrim(array_to_string(w[(h // 11 + i) % (n - k + 1) + 1:(h // 11 + i) % (n - k + 1) + k], ''), ' ' || chr(9) || chr(10) || chr(13)) AS piece, h FROM s JOIN c ON c.doc_id = s.source_id),
o AS (SELECT *, coalesce(sum(length(piece) + CASE (h // 13 + i) % 3 WHEN 0 THEN 1 ELSE 2 END) OVER (PARTITION BY output_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x)"""


@query(f"WITH {_ASSEMBLED}, {_PARTS} SELECT output_id, CAST(i AS INT) AS i, label, source_id, CAST(off AS INT) AS output_start, CAST(off + length(piece) AS INT) AS output_end, md5(piece) AS key FROM o")
def assemble_docs(t: Tables) -> DataFrame:
    """The parts of each assembled document at their places in its text; separators between them have no label."""
    d = S.assemble(S.assembly_plan(assembly_parts(t)), t.documents.select("doc_id", "text"))
    d = d.select("output_id", "text", F.posexplode("components").alias("i", "c"))
    piece = F.expr("substring(text, c.output_start + 1, c.output_end - c.output_start)")
    return d.select("output_id", "i", "c.label", "c.source_id", "c.output_start", "c.output_end", F.md5(piece).alias("key"))


@query(rf"""WITH {_ISLANDS}, c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1), b AS (SELECT conv_id FROM m GROUP BY 1 HAVING bool_or(label = 0) AND bool_or(label = 1)),
w AS (SELECT len(regexp_extract_all(substr(text, start + 1, "end" - start), '\S+')) AS n FROM m JOIN c USING (conv_id) SEMI JOIN b USING (conv_id) WHERE label = 1)
SELECT count(*) AS n_spans, median(n)::DOUBLE AS median_words FROM w""")
def span_words(t: Tables) -> DataFrame:
    """Words of each span of the second label in mixed conversations, and their median."""
    d = turn_spans(t).filter(S.kind(F.col("spans")) == "mixed").select("text", F.explode(F.filter("spans", lambda s: s["label"] == 1)).alias("s"))
    n = F.size(X.words(F.expr("substring(text, s.start + 1, s.end - s.start)")))
    return d.select(n.alias("n")).agg(F.count("*").alias("n_spans"), F.median("n").alias("median_words"))


@query(rf"""WITH {_ISLANDS}, c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1), p AS (SELECT conv_id, regexp_extract_all(text, '\s+|\S+') AS p FROM c),
u AS (SELECT conv_id, unnest(p) AS w, unnest(range(len(p))) AS i FROM p), o AS (SELECT conv_id, w, coalesce(sum(length(w)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
SELECT o.conv_id, count(*) AS n FROM o JOIN m ON o.conv_id = m.conv_id AND m.start <= o.s AND m."end" >= o.s + length(w) AND label = 1 WHERE regexp_matches(w, '^\S') GROUP BY 1""")
def tokens_within(t: Tables) -> DataFrame:
    """Words that lie wholly within a span of the second label."""
    d = turn_spans(t).select("conv_id", S.tokens_inside(S.word_offsets("text"), F.filter("spans", lambda s: s["label"] == 1)).alias("k")).filter(F.size("k") > 0)
    return d.select("conv_id", F.size("k").cast("long").alias("n"))


@query(r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents), p AS (SELECT a.doc_id, a.n - 100 AS hmax, b.n - 100 AS amax, (a.doc_id * 37) % (a.n - 99) AS h FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0 WHERE a.n >= 100 AND b.n >= 100)
SELECT doc_id, CAST(h AS BIGINT) AS first_start, CAST(CASE WHEN hmax > 0 THEN round_even(h / hmax::DOUBLE * amax, 0) ELSE 0 END AS BIGINT) AS matched_start FROM p""")
def matched_start(t: Tables) -> DataFrame:
    """The window of a pair's second text that lies as far in as that of the first, windows of 100 words."""
    n = t.documents.select("doc_id", F.size(X.words("text")).cast("long").alias("n")).filter("n >= 100")
    p = n.filter("doc_id % 2 = 0").join(n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m")), "doc_id")
    h = (F.col("doc_id") * 37) % (F.col("n") - 99)
    return p.select("doc_id", h.alias("first_start"), S.matched_start(h, F.col("n") - 100, F.col("m") - 100).alias("matched_start"))


@query(rf"""WITH {_ISLANDS}, c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1), k AS (SELECT conv_id, count(*) AS n FROM m GROUP BY 1)
SELECT conv_id FROM c LEFT JOIN k USING (conv_id) WHERE n >= 2 AND len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')) >= 80""")
def span_count_gate(t: Tables) -> DataFrame:
    """Conversations of at least two spans and eighty words."""
    return turn_spans(t).filter((F.size("spans") >= 2) & (F.size(X.tokens("text")) >= 80)).select("conv_id")
