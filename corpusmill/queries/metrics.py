"""Thresholds, curves and reports. The score is a text's share of long words, the label its quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import metrics as M
from corpusmill.operators.ranking import value_rank
from corpusmill.queries.registry import Tables, query
from corpusmill.session import materialize

_S = r"""s AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality AS label, l.toxic, len(regexp_extract_all(text, '\S{9,}'))::DOUBLE / len(regexp_extract_all(text, '\S+')) AS score FROM documents d JOIN labels l USING (doc_id))"""
_BAND = "CASE WHEN n_chars <= 512 THEN '0001-0512' WHEN n_chars <= 1024 THEN '0513-1024' WHEN n_chars <= 2048 THEN '1025-2048' ELSE '2049+' END"


def scored(t: Tables) -> DataFrame:
    long, words = (F.regexp_count("text", F.lit(p)) for p in (r"\S{9,}", r"\S+"))
    share = F.when(words == 0, F.lit(float("nan"))).otherwise(long.cast("double") / words)  # as the SQL has it: above every score
    return t.documents.select("doc_id", "lang", "source", "n_chars", share.alias("score")).join(t.labels.select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")


def band():
    n = F.col("n_chars")
    return F.when(n <= 512, "0001-0512").when(n <= 1024, "0513-1024").when(n <= 2048, "1025-2048").otherwise("2049+")


def _cut(target: str, src: str = "s", key: str = "") -> str:
    over = f"PARTITION BY {key} " if key else ""
    return f"(SELECT {key + ', ' if key else ''}score AS cut FROM (SELECT *, row_number() OVER ({over}ORDER BY score DESC) AS rn, count(*) OVER ({over.strip()}) AS n FROM {src} WHERE label = 0) WHERE rn = floor({target} * n) + 1)"


_CELLS = """count(*) FILTER (label = 1 AND a) AS tp, count(*) FILTER (label = 0 AND a) AS fp, count(*) FILTER (label = 1 AND NOT a) AS fn, count(*) FILTER (label = 0 AND NOT a) AS tn"""
_RATES = """round(fp / nullif(fp + tn, 0)::DOUBLE, 9) AS fpr, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS tpr, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1,
round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 9) AS accuracy, round((tp / nullif(tp + fn, 0)::DOUBLE + 1 - fp / nullif(fp + tn, 0)::DOUBLE) / 2, 9) AS balanced"""
_ALARM = f"{_S}, a AS (SELECT s.*, s.score > c.cut AS a FROM s, {_cut('0.02')} c)"
_CUM = "c AS (SELECT score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM s GROUP BY 1), k AS (SELECT score, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM c WINDOW w AS (ORDER BY score DESC))"


@query(f"WITH {_S} SELECT round(cut, 9) AS cut FROM {_cut('0.02')}")
def threshold_fpr(t: Tables) -> DataFrame:
    return M.threshold_at(scored(t), 0.02).select(F.round("cut", 9).alias("cut"))


@query(f"WITH {_S}, m AS (SELECT source AS doc, max(score) AS score, 0 AS label FROM s WHERE label = 0 GROUP BY 1) SELECT round(cut, 9) AS cut FROM {_cut('0.05', 'm')}")
def threshold_doc(t: Tables) -> DataFrame:
    """Calibrated on the highest score of each unit."""
    m = scored(t).filter("label = 0").groupBy("source").agg(F.max("score").alias("score")).withColumn("label", F.lit(0))
    return M.threshold_at(m, 0.05).select(F.round("cut", 9).alias("cut"))


def alarmed(t: Tables) -> DataFrame:
    s = scored(t)
    return M.with_cut(s, M.threshold_at(s, 0.02))


@query(f"WITH {_ALARM}, g AS (SELECT {_CELLS} FROM a) SELECT *, {_RATES} FROM g")
def confusion(t: Tables) -> DataFrame:
    return M.confusion(alarmed(t), F.col("alarm"))


@query(f"WITH {_ALARM}, g AS (SELECT {_CELLS} FROM a) SELECT f1, accuracy, balanced FROM (SELECT {_RATES} FROM g)")
def f1(t: Tables) -> DataFrame:
    return M.confusion(alarmed(t), F.col("alarm")).select("f1", "accuracy", "balanced")


@query(f"WITH {_ALARM}, g AS (SELECT lang, {_BAND} AS band, {_CELLS} FROM a GROUP BY 1, 2) SELECT *, {_RATES} FROM g")
def metrics_by(t: Tables) -> DataFrame:
    return M.confusion(alarmed(t).withColumn("band", band()), F.col("alarm"), ["lang", "band"])


@query(f"WITH {_S}, {_CUM} SELECT round(sum(p * (tn - cn + n / 2)) / (max(tp) * max(tn)), 9) AS auc FROM k")
def roc_auc(t: Tables) -> DataFrame:
    return M.roc_auc(scored(t))


@query(f"WITH {_S}, r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM s) SELECT lang, round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0)::DOUBLE, 9) AS auc FROM r GROUP BY 1")
def span_summary(t: Tables) -> DataFrame:
    """AUC of each language; null where a class is missing."""
    return M.roc_auc(scored(t), ["lang"])


@query(f"WITH {_S}, {_CUM}, x AS (SELECT cn / tn AS x, cp / tp AS y, (cn - n) / tn AS x0, (cp - p) / tp AS y0 FROM k), y AS (SELECT x0, y0, least(x, 0.05) AS x1, CASE WHEN x > x0 THEN y0 + (least(x, 0.05) - x0) / (x - x0) * (y - y0) ELSE y0 END AS y1 FROM x WHERE x0 < 0.05) SELECT round(0.5 * (1 + (sum((x1 - x0) * (y0 + y1) / 2) - 0.00125::DOUBLE) / (0.05::DOUBLE - 0.00125::DOUBLE)), 9) AS pauc FROM y")
def partial_auc(t: Tables) -> DataFrame:
    return M.partial_auc(scored(t))


@query(f"WITH {_S}, {_CUM} SELECT round(sum(p / tp * cp / (cp + cn)), 9) AS ap FROM k")
def average_precision(t: Tables) -> DataFrame:
    return M.average_precision(scored(t))


@query(f"WITH {_S}, {_CUM} SELECT round(score, 9) AS score, round(cn / tn, 9) AS fpr, round(cp / tp, 9) AS tpr FROM k")
def roc_points(t: Tables) -> DataFrame:
    return M._points(scored(t)).select(F.round("score", 9).alias("score"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


_POL = f"""pol AS (SELECT 'zero_fp' AS policy, (SELECT max(score) FROM s WHERE label = 0) AS cut UNION ALL SELECT 'recall_99', (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM s WHERE label = 1) WHERE rn = ceil(0.99::DOUBLE * n)) - 1e-12 UNION ALL SELECT 'half', 0.5 UNION ALL SELECT 'fpr_2', (SELECT cut FROM {_cut('0.02')}) UNION ALL SELECT 'midpoint', (SELECT CASE WHEN n < p THEN (n + p) / 2 END FROM (SELECT max(score) FILTER (label = 0) AS n, min(score) FILTER (label = 1) AS p FROM s)))"""


def policy_cuts(t: Tables) -> DataFrame:
    """A row for each policy: no false positive, 99 % recall, one half, 2 % false positives, midpoint between separate classes. Alarms lie above the cut."""
    s = materialize(scored(t), "scored")
    zero = s.filter("label = 0").agg(F.max("score").alias("cut")).select(F.lit("zero_fp").alias("policy"), "cut")
    c = M.curve(s).withColumn("__need", F.ceil(F.lit(0.99).cast("double") * F.col("n_pos")))
    recall = c.filter("cum_pos >= __need").agg((F.max("score") - F.lit(1e-12).cast("double")).alias("cut")).select(F.lit("recall_99").alias("policy"), "cut")
    half = s.agg(F.lit(0.5).cast("double").alias("cut")).select(F.lit("half").alias("policy"), "cut")
    gap = M.class_gap(s, []).select(F.lit("midpoint").alias("policy"), "cut")
    return zero.unionByName(recall).unionByName(half).unionByName(M.threshold_at(s, 0.02).select(F.lit("fpr_2").alias("policy"), "cut")).unionByName(gap)


@query(f"WITH {_S}, {_POL} SELECT policy, round(cut, 9) AS cut FROM pol")
def policies(t: Tables) -> DataFrame:
    return policy_cuts(t).select("policy", F.round("cut", 9).alias("cut"))


@query(f"WITH {_S}, {_POL}, a AS (SELECT policy, lang, label, score > cut AS a FROM s, pol), g AS (SELECT policy, lang, {_CELLS} FROM a WHERE a IS NOT NULL GROUP BY 1, 2) SELECT *, {_RATES} FROM g")
def tradeoff(t: Tables) -> DataFrame:
    """Every policy on every language; the policies are five rows, and one without a cut raises no rows."""
    return M.confusion(scored(t).crossJoin(F.broadcast(policy_cuts(t).filter("cut IS NOT NULL"))), F.col("score") > F.col("cut"), ["policy", "lang"])


@query(f"WITH {_S}, a AS (SELECT max(cut) AS cut FROM {_cut('0.02')}), b AS (SELECT lang, cut FROM {_cut('0.02', 's', 'lang')}) SELECT lang, round(greatest(a.cut, b.cut), 9) AS cut FROM b, a")
def source_aware(t: Tables) -> DataFrame:
    """The higher of the overall and the language's own threshold."""
    s = scored(t)
    return M.threshold_at(s, 0.02, ["lang"]).withColumnRenamed("cut", "own").crossJoin(F.broadcast(M.threshold_at(s, 0.02))).select("lang", F.round(F.greatest("own", "cut"), 9).alias("cut"))


@query(f"""WITH {_S}, l AS (SELECT DISTINCT lang AS held FROM s), x AS (SELECT held, s.* FROM s JOIN l ON s.lang <> l.held), h AS (SELECT held, cut FROM {_cut('0.05', 'x', 'held')}), a AS (SELECT held, label, score > cut AS a FROM s JOIN h ON lang = held)
SELECT held, count(*) FILTER (label = 0 AND a) AS fp, count(*) FILTER (label = 0) AS n FROM a GROUP BY 1""")
def loo_threshold(t: Tables) -> DataFrame:
    """Each language under the threshold of all others; languages are few, so every row goes to each of them."""
    s = scored(t)
    held = s.select(F.col("lang").alias("held")).distinct()
    cut = M.threshold_at(s.join(F.broadcast(held), F.col("lang") != F.col("held")), 0.05, ["held"])
    a, clean = s.join(F.broadcast(cut), F.col("lang") == F.col("held")), F.col("label") == 0
    return a.groupBy("held").agg(F.count_if(clean & (F.col("score") > F.col("cut"))).alias("fp"), F.count_if(clean).alias("n"))


@query(f"""WITH {_S}, t AS (SELECT unnest([0.005, 0.01, 0.02, 0.05]) AS target), r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM s WHERE label = 0), c AS (SELECT target, score AS cut FROM t JOIN r ON rn = floor(target::DOUBLE * n) + 1)
SELECT CAST(target AS DOUBLE) AS target, lang, count(*) FILTER (label = 0 AND score > cut) AS fp, count(*) FILTER (label = 1 AND score > cut) AS tp FROM s, c GROUP BY 1, 2""")
def target_sweep(t: Tables) -> DataFrame:
    s = scored(t)
    cuts = None
    for target in (0.005, 0.01, 0.02, 0.05):
        c = M.threshold_at(s, target).withColumn("target", F.lit(target).cast("double"))
        cuts = c if cuts is None else cuts.unionByName(c)
    a = s.crossJoin(F.broadcast(cuts))  # four rows on the right
    hit = F.col("score") > F.col("cut")
    return a.groupBy("target", "lang").agg(F.count_if((F.col("label") == 0) & hit).alias("fp"), F.count_if((F.col("label") == 1) & hit).alias("tp"))


@query(f"WITH {_ALARM} SELECT source, count(*) FILTER (a) AS flagged, count(*) AS total FROM a WHERE label = 0 GROUP BY 1")
def publisher_alarms(t: Tables) -> DataFrame:
    return alarmed(t).filter("label = 0").groupBy("source").agg(F.count_if("alarm").alias("flagged"), F.count("*").alias("total"))


@query(f"WITH {_ALARM} SELECT source, lang, bool_or(a) AS alarm, round(avg(CAST(a AS INT)), 9) AS share, avg(CAST(a AS INT)) >= 0.1 AS tenth FROM a GROUP BY 1, 2")
def doc_alarm(t: Tables) -> DataFrame:
    """Any alarm in a unit, the share of alarms, and whether it reaches a tenth."""
    a = F.avg(F.col("alarm").cast("int"))
    return alarmed(t).groupBy("source", "lang").agg(F.bool_or("alarm").alias("alarm"), F.round(a, 9).alias("share"), (a >= 0.1).alias("tenth"))


@query(f"""WITH {_ALARM}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - row_number() OVER (PARTITION BY source, label ORDER BY doc_id) AS run FROM a),
g AS (SELECT source, run, sum(n_chars) AS c, sum(CASE WHEN a THEN n_chars ELSE 0 END) AS h FROM r WHERE label = 1 GROUP BY 1, 2)
SELECT count(*) AS spans, count(*) FILTER (h > 0) AS touched, count(*) FILTER (h * 2 >= c) AS half, round(avg(abs(h / c::DOUBLE - 1)), 9) AS mae FROM g""")
def span_recall(t: Tables) -> DataFrame:
    """Runs of positive rows in a unit: touched at all, half covered, and the error of the covered share, by characters."""
    a = materialize(alarmed(t), "alarms")
    r = value_rank(value_rank(a, ["source"], "doc_id", out="i"), ["source", "label"], "doc_id", out="j").withColumn("run", F.col("i") - F.col("j"))
    g = r.filter("label = 1").groupBy("source", "run").agg(F.sum("n_chars").alias("c"), F.sum(F.when(F.col("alarm"), F.col("n_chars")).otherwise(0)).alias("h"))
    error = F.abs(F.col("h").cast("double") / F.col("c").cast("double") - 1)
    return g.agg(F.count("*").alias("spans"), F.count_if(F.col("h") > 0).alias("touched"), F.count_if(F.col("h") * 2 >= F.col("c")).alias("half"), F.round(F.avg(error), 9).alias("mae"))


_MULTI = "m AS (SELECT event_type AS label, CASE WHEN event_id % 3 = 0 THEN max(event_type) OVER (PARTITION BY user_id) ELSE event_type END AS predicted FROM events)"


@query(f"""WITH {_MULTI}, r AS (SELECT label, count(*) AS s, count(*) FILTER (label = predicted) AS tp FROM m GROUP BY 1), c AS (SELECT predicted AS label, count(*) AS c FROM m GROUP BY 1)
SELECT round(sum(tp) / sum(s)::DOUBLE, 9) AS accuracy, round(avg(tp / s::DOUBLE), 9) AS balanced, round(avg(2 * tp / (s + coalesce(c, 0))::DOUBLE), 9) AS macro_f1 FROM r LEFT JOIN c USING (label)""")
def multiclass(t: Tables) -> DataFrame:
    return M.multiclass(_multi(t))


def _multi(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max("event_type").alias("last"))
    p = F.when(F.col("event_id") % 3 == 0, F.col("last")).otherwise(F.col("event_type"))
    return t.events.join(last, "user_id").select(F.col("event_type").alias("label"), p.alias("predicted"))


@query("""WITH g AS (SELECT source, count(*) FILTER (quality = 1)::DOUBLE AS k, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, k / n AS p FROM g)
SELECT source, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS high FROM z""")
def wilson(t: Tables) -> DataFrame:
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return g.select("source", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(r"""WITH s AS (SELECT quality AS label, -len(regexp_extract_all(text, '\S+')) AS score FROM documents JOIN labels USING (doc_id)), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 9) AS auc FROM r""")
def length_confound(t: Tables) -> DataFrame:
    """AUC of shortness alone."""
    return M.roc_auc(t.documents.select("doc_id", (-X.word_count("text")).cast("double").alias("score")).join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id"))


@query("""WITH o AS (SELECT year(o_orderdate) AS year, o_totalprice AS score, 0 AS label FROM orders), c AS (SELECT quantile_disc(score, 0.98) AS q FROM o)
SELECT CAST(year AS INT) AS year, count(*) FILTER (score > 400000) AS alarms, count(*) AS n, round(count(*) FILTER (score > 400000) / count(*)::DOUBLE, 9) AS rate FROM o GROUP BY 1""")
def human_audit(t: Tables) -> DataFrame:
    """Alarm rate of each year on rows that should raise none."""
    hit = F.count_if(F.col("o_totalprice") > 400000)
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(hit.alias("alarms"), F.count("*").alias("n"), F.round(hit.cast("double") / F.count("*").cast("double"), 9).alias("rate"))


@query(f"WITH {_ALARM}, g AS (SELECT {_CELLS} FROM a) SELECT fp / (fp + tn)::DOUBLE <= 0.1 AND tp / (tp + fn)::DOUBLE >= 0.95 AS strict, fp / (fp + tn)::DOUBLE <= 0.1 AS lenient FROM g")
def gate(t: Tables) -> DataFrame:
    c = M.confusion(alarmed(t), F.col("alarm"))
    return c.select(((F.col("fpr") <= 0.1) & (F.col("tpr") >= 0.95)).alias("strict"), (F.col("fpr") <= 0.1).alias("lenient"))


_XY = "xy AS (SELECT cn / tn AS x, cp / tp AS y FROM k)"


@query(f"""WITH {_S}, {_CUM}, {_XY}, a AS (SELECT coalesce(max(x), 0) AS x0, coalesce(max(y), 0) AS y0 FROM xy WHERE x <= 0.05), b AS (SELECT x AS x1, y AS y1 FROM xy WHERE x > 0.05 ORDER BY x, y LIMIT 1)
SELECT round(coalesce(y0 + (0.05::DOUBLE - x0) * (y1 - y0) / (x1 - x0), y0), 9) AS interpolated, round(y0, 9) AS at_or_below FROM a LEFT JOIN b ON true""")
def recall_at_fpr(t: Tables) -> DataFrame:
    return M.recall_at_fpr(scored(t), 0.05)


_GAP = f"{_S}, z AS (SELECT lang, label, score + label * CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 0 END AS score FROM s)"


@query(f"""WITH {_GAP}, g AS (SELECT lang, max(score) FILTER (label = 0) AS n, min(score) FILTER (label = 1) AS p FROM z GROUP BY 1) SELECT lang, round(CASE WHEN n < p THEN (n + p) / 2 END, 9) AS cut FROM g""")
def class_gap(t: Tables) -> DataFrame:
    """Midpoints of the classes by language; in two of them the scores are drawn apart."""
    more = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 3).otherwise(0)
    return M.class_gap(scored(t).withColumn("score", F.col("score") + F.col("label") * more), ["lang"])


@query(f"""WITH {_MULTI}, c AS (SELECT label, predicted, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT label, sum(n) AS s, sum(CASE WHEN label = predicted THEN n ELSE 0 END) AS tp FROM c GROUP BY 1)
SELECT label, predicted, n, round(tp / s::DOUBLE, 9) AS recall FROM c JOIN r USING (label)""")
def confusion_matrix(t: Tables) -> DataFrame:
    return M.confusion_matrix(_multi(t))


@query("""WITH k AS (SELECT DISTINCT event_type AS name FROM events), s AS (SELECT event_id, event_type AS label, name, (event_id * length(name) + ascii(name)) % 11 AS score FROM events, k),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, name DESC) AS rn FROM s) SELECT count(DISTINCT event_id) AS n, round(count(*) FILTER (rn <= 2 AND name = label) / count(DISTINCT event_id)::DOUBLE, 9) AS top FROM r""")
def top_k(t: Tables) -> DataFrame:
    """Share of events whose type is among the two with the highest made-up scores."""
    names = t.events.select("event_type").distinct().agg(F.array_sort(F.collect_list("event_type")).alias("names"))  # one row, an entry for each type
    score = lambda x: (F.col("event_id") * F.length(x) + F.ascii(x)) % 11
    d = t.events.crossJoin(F.broadcast(names)).select(F.col("event_type").alias("label"), F.transform("names", lambda x: F.struct(score(x).alias("score"), x.alias("name"))).alias("scores"))
    return M.top_k(d, 2)


_TRIALS = f"{_S}, u AS (SELECT 'share' AS trial, score, label FROM s UNION ALL SELECT 'short', -n_chars, label FROM s UNION ALL SELECT 'toxic', toxic + score / 10, label FROM s)"


@query(f"""WITH {_TRIALS}, c AS (SELECT trial, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n FROM u GROUP BY 1, 2),
k AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY trial) AS tp, sum(n) OVER (PARTITION BY trial) AS tn FROM c WINDOW w AS (PARTITION BY trial ORDER BY score DESC)),
a AS (SELECT trial, round(sum(p * (tn - cn + n / 2)) / (max(tp) * max(tn)), 9) AS auc FROM k GROUP BY 1), x AS (SELECT trial, cn / tn AS x, cp / tp AS y, (cn - n) / tn AS x0, (cp - p) / tp AS y0 FROM k),
y AS (SELECT trial, x0, y0, least(x, 0.05) AS x1, CASE WHEN x > x0 THEN y0 + (least(x, 0.05) - x0) / (x - x0) * (y - y0) ELSE y0 END AS y1 FROM x WHERE x0 < 0.05),
q AS (SELECT trial, round(0.5 * (1 + (sum((x1 - x0) * (y0 + y1) / 2) - 0.00125::DOUBLE) / (0.05::DOUBLE - 0.00125::DOUBLE)), 9) AS pauc FROM y GROUP BY 1)
SELECT trial, round(0.7 * pauc + 0.3 * auc, 6) AS score, row_number() OVER (ORDER BY 0.7 * pauc + 0.3 * auc DESC, trial) = 1 AS best FROM a JOIN q USING (trial)""")
def selection_score(t: Tables) -> DataFrame:
    """Three trials and the best of them."""
    s = materialize(scored(t), "scored")
    trials = {"share": F.col("score"), "short": -F.col("n_chars").cast("double"), "toxic": F.col("toxic") + F.col("score") / 10}
    rows = [M.selection_score(s.withColumn("score", c)).select(F.lit(n).alias("trial"), "score") for n, c in trials.items()]
    d = materialize(reduce(DataFrame.unionByName, rows), "trials")
    best = d.agg(F.max(F.struct("score", "trial")).alias("x"))  # one row; no two trials tie
    return d.crossJoin(F.broadcast(best)).select("trial", F.round("score", 6).alias("score"), (F.col("trial") == F.col("x.trial")).alias("best"))
