"""Joins, aggregations and ordered-row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import intervals as I
from corpusmill.operators.dedup import first_of
from corpusmill.operators.ranking import hash_rank
from corpusmill.operators.sampling import group_rank
from corpusmill.queries.registry import Tables, query

# Joins


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, n, o_orderstatus FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n > 6 THEN 'too_many' WHEN o_orderstatus = 'P' THEN 'status' ELSE 'paired' END AS reason, count(*) AS n_orders FROM j GROUP BY 1""")
def pair_join(t: Tables) -> DataFrame:
    """Orders with their lines, and why some have none."""
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = t.orders.select("o_orderkey", "o_orderstatus").join(l, "o_orderkey", "left")
    return j.groupBy(F.when(F.col("n").isNull(), "missing").when(F.col("n") > 6, "too_many").when(F.col("o_orderstatus") == "P", "status").otherwise("paired").alias("reason")).agg(F.count("*").alias("n_orders"))


@query("SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0")
def swap_join(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT source, max(doc_id) FILTER (quality = 0) AS a, max(doc_id) FILTER (quality = 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING a IS NOT NULL AND b IS NOT NULL")
def label_pair(t: Tables) -> DataFrame:
    """One row of each label per source; the last one wins."""
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    p = d.groupBy("source").agg(F.max(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("a"), F.max(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("b"))
    return p.filter("a IS NOT NULL AND b IS NOT NULL")


@query("""WITH d AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256('zip:' || doc_id), doc_id) AS rn FROM documents JOIN labels USING (doc_id))
SELECT a.lang, CAST(a.rn AS INT) AS rn, a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.lang = b.lang AND a.rn = b.rn AND a.quality = 0 AND b.quality = 1""")
def rank_zip(t: Tables) -> DataFrame:
    """The i-th of one label with the i-th of the other in each stratum."""
    d = hash_rank(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), X.salted("zip:", "doc_id"), ["doc_id"], "rn", ["lang", "quality"])
    a, b = (d.filter(F.col("quality") == q).select("lang", "rn", F.col("doc_id").alias(n)) for q, n in ((0, "a"), (1, "b")))
    return a.join(b, ["lang", "rn"])


@query("SELECT c_custkey, coalesce(m.status, 'none') AS status, m.key IS NOT NULL AS replaced FROM customer LEFT JOIN (SELECT o_custkey AS key, max(o_orderstatus) AS status FROM orders WHERE o_totalprice > 300000 GROUP BY 1) m ON c_custkey = m.key")
def coalesce_join(t: Tables) -> DataFrame:
    m = t.orders.filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"))
    return t.customer.select("c_custkey").join(m, "c_custkey", "left").select("c_custkey", F.coalesce("status", F.lit("none")).alias("status"), F.col("status").isNotNull().alias("replaced"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id")
def asof_latest(t: Tables) -> DataFrame:
    return I.latest_before(t.events, "user_id", "ts", F.lit("2024-01-15").cast("timestamp"), "value", "event_id")


@query("""WITH v AS (SELECT * FROM events WHERE event_type = 'view'), c AS (SELECT * FROM events WHERE event_type = 'click')
SELECT c.event_id, (SELECT max(v.ts) FROM v WHERE v.user_id = c.user_id AND v.ts <= c.ts) AS view_ts FROM c""")
def asof_join(t: Tables) -> DataFrame:
    """Each click with the time of the user's last view."""
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    v = e.filter("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("view_ts"))
    return I.asof_join(e.filter("event_type = 'click'"), v, "user_id", "ts", "ts", "view_ts", "view_ts").select("event_id", "view_ts")


# Aggregations


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def count_by(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS big, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS cheap, count(*) AS n FROM lineitem GROUP BY 1")
def cond_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("big"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("cheap"), F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY 1")
def distinct_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


@query("SELECT lang, min(n_chars) AS shortest, max(n_chars) AS longest, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY 1")
def length_stats(t: Tables) -> DataFrame:
    """The median is the element at n // 2, not a mean of two."""
    from corpusmill.operators.quantiles import rank_quantiles as at

    return at(t.documents, ["lang"], "n_chars", {"upper_median": lambda n: F.floor(n / 2)}, extra=[F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")])


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, max(n_chars) FILTER (i = floor(0.1 * (n - 1))) AS p10, max(n_chars) FILTER (i = floor(0.5 * (n - 1))) AS p50, max(n_chars) FILTER (i = floor(0.9 * (n - 1))) AS p90 FROM r GROUP BY 1""")
def rank_quantiles(t: Tables) -> DataFrame:
    from corpusmill.operators.quantiles import rank_quantiles as at

    return at(t.documents, ["source"], "n_chars", {f"p{int(100 * q)}": (lambda n, q=q: F.floor((n - 1) * q)) for q in (0.1, 0.5, 0.9)})


@query("SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99, round(median(value), 6) AS p50 FROM events GROUP BY 1")
def interp_quantile(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.99), 6).alias("p99"), F.round(F.median("value"), 6).alias("p50"))


@query("SELECT lang, source, quality, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(GROUPING(lang) AS INT) * 4 + CAST(GROUPING(source) AS INT) * 2 + CAST(GROUPING(quality) AS INT) AS level FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (quality), (lang, source), (lang, quality), ())")
def exposure_sets(t: Tables) -> DataFrame:
    """Several groupings of the same facts in one pass."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    keys = ["lang", "source", "quality"]
    sets = [[F.col(k) for k in x] for x in (["lang"], ["source"], ["quality"], ["lang", "source"], ["lang", "quality"], [])]
    return d.groupingSets(sets, *keys).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id(*keys).cast("int").alias("level"))


@query("SELECT uses, count(*) AS n_keys FROM (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) GROUP BY 1")
def reuse_hist(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("n_keys"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / sum(length(text))::DOUBLE, 9) AS share FROM conversations GROUP BY 1")
def char_share(t: Tables) -> DataFrame:
    n = F.length("text").cast("long")
    c = t.conversations.groupBy("conv_id").agg(F.sum(n).alias("chars"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("a"))
    return c.select("conv_id", "chars", F.round(F.col("a").cast("double") / F.col("chars").cast("double"), 9).alias("share"))


@query("SELECT source, count(*) AS n, list_sort(list(doc_id))[1:20] AS evidence FROM documents GROUP BY 1")
def evidence_ids(t: Tables) -> DataFrame:
    """The first twenty ids of each group; only those are gathered."""
    r = group_rank(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], "rn").filter("rn <= 20")
    e = r.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("evidence"))
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).join(e, "source")


@query("SELECT user_id, event_type AS mode, c AS n FROM (SELECT user_id, event_type, count(*) AS c, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) = 1")
def modal_value(t: Tables) -> DataFrame:
    """The most frequent type of each user; at a tie the one that came first."""
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("f"))
    return first_of(c, F.col("user_id"), [F.col("n").desc(), "f"]).select("user_id", F.col("event_type").alias("mode"), "n")


@query("SELECT o_custkey, substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey)), 1, 24) AS group_hash FROM orders GROUP BY 1")
def group_hash(t: Tables) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return t.orders.groupBy("o_custkey").agg(F.substring(F.sha2(F.array_join(ids, "\n"), 256), 1, 24).alias("group_hash"))


@query("SELECT round(avg(a), 9) AS macro, count(*) AS n_groups FROM (SELECT source, avg(quality) AS a FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def macro_avg(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.avg("quality").alias("a")).agg(F.round(F.avg("a"), 9).alias("macro"), F.count("*").alias("n_groups"))


@query("SELECT min(a) AS worst_rate, arg_min(source, (a, source)) AS worst FROM (SELECT source, round(avg(quality), 9) AS a FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def worst_group(t: Tables) -> DataFrame:
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 9).alias("a"))
    return g.agg(F.min("a").alias("worst_rate"), F.min_by("source", F.struct("a", "source")).alias("worst"))


# Ordered rows


@query("SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS DISTINCT FROM role")
def adjacent_dedup(t: Tables) -> DataFrame:
    """Without turns whose role repeats that of the turn before."""
    p = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("p", p).filter(~F.col("p").eqNullSafe(F.col("role"))).select("conv_id", "turn")


@query("""WITH r AS (SELECT user_id, ts, value > 50 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, high, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, high, run""")
def runs(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", "event_id", (F.col("value") > 50).alias("high"))
    return I.runs(e, ["user_id"], ["ts", "event_id"], "high").drop("run")


@query("""WITH s AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s, d FROM (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS d FROM events))
SELECT user_id, CAST(min(s) AS BIGINT) AS lowest, CAST(sum(d) AS BIGINT) AS final, min(s) >= 0 AND sum(d) = 0 AS balanced FROM s GROUP BY 1""")
def balanced_events(t: Tables) -> DataFrame:
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return I.balanced(t.events, "user_id", ["ts", "event_id"], step)


@query("""WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS start, count(*) OVER (PARTITION BY user_id) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 6) AS total FROM events)
SELECT user_id, CAST(start AS INT) AS start, total FROM w WHERE start + 5 <= n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total DESC, start) = 1""")
def risk_window(t: Tables) -> DataFrame:
    return I.best_window(t.events, "user_id", ["ts", "event_id"], "value", 5)


def _packed(t: Tables, most: int, least: int, **options) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = t.documents.select("doc_id", lines.alias("p")).withColumn("n", F.transform("p", lambda x: F.size(X.words(x))))
    return d.select("doc_id", F.posexplode(I.pack_chunks(F.col("p"), F.col("n"), most, least, **options)).alias("chunk", "c")).select("doc_id", "chunk", F.col("c.n").alias("n_words"), F.md5("c.text").alias("key"))


@query()
def pack_chunks(t: Tables) -> DataFrame:
    """Lines packed into chunks of at most 360 words, those under 90 dropped; an order-dependent fold, compared with a loop in tests."""
    return _packed(t, 360, 90, between="\n\n")


@query()
def pack_pages(t: Tables) -> DataFrame:
    """The same with at most 380 and at least 100 words."""
    return _packed(t, 380, 100, between="\n\n")


@query()
def pack_bodies(t: Tables) -> DataFrame:
    """Lines over 350 words are left out; a chunk closes over 300 words once it has 150, and holds 150 to 350."""
    return _packed(t, 300, 150, longest=350, keep_short=True, between=" ")


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM documents), i AS (SELECT doc_id, p, unnest(list_distinct([1, len(p) // 2 + 1, len(p)])) AS i FROM l WHERE len(p) > 0)
SELECT doc_id, CAST(i AS INT) AS place, md5(p[i]) AS key FROM i""")
def pick_chunks(t: Tables) -> DataFrame:
    """First, middle and last line."""
    d = t.documents.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("p")).withColumn("n", F.size("p")).filter("n > 0")
    d = d.select("doc_id", "p", F.explode(F.array_distinct(F.array(F.lit(1), F.expr("CAST(n div 2 + 1 AS INT)"), F.col("n")))).alias("place"))
    return d.select("doc_id", "place", F.md5(F.element_at("p", F.col("place"))).alias("key"))


@query("""WITH r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS block FROM events)
SELECT user_id, CAST(block AS BIGINT) AS block, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) = 3""")
def consecutive_blocks(t: Tables) -> DataFrame:
    """Full blocks of three consecutive rows of a user."""
    r = group_rank(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "rn")
    b = r.groupBy("user_id", F.expr("(rn - 1) div 3").alias("block")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
    return b.filter("n = 3")


# Containment and alignment


@query("""WITH l AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 50 = 0 UNION ALL SELECT -1 - doc_id FROM labels WHERE doc_id % 40 = 0), b AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, n FROM documents a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' WHEN n > 1 THEN 'repeated' ELSE 'matched' END AS verdict, count(*) AS n FROM j GROUP BY 1""")
def one_to_one(t: Tables) -> DataFrame:
    """Documents against labels, some of them repeated and some for no document."""
    from corpusmill.operators.contracts import alignment

    own = t.labels.select("doc_id")
    other = own.unionByName(own.filter("doc_id % 50 = 0")).unionByName(own.filter("doc_id % 40 = 0").select((-1 - F.col("doc_id")).alias("doc_id")))
    return alignment(t.documents.select("doc_id"), other, "doc_id").groupBy("verdict").agg(F.count("*").alias("n"))
