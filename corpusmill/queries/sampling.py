"""Ranks, caps, quotas, tiers and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import sampling as S
from corpusmill.operators.dedup import first_of, group_dedup as drop_shared_groups, key_conflicts as conflicts, priority_dedup as dedup_by_priority
from corpusmill.operators.ranking import hash_rank as ranked
from corpusmill.queries.registry import Tables, query

#: Categories and their shares.
SHARES = {"paper": 0.35, "reference_education": 0.20, "creative": 0.20, "social_qa": 0.10, "reviews": 0.10, "news": 0.05}
_DOCS = "documents d JOIN labels l USING (doc_id)"


def labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id")


def small(t: Tables, rows: list[tuple], ddl: str) -> DataFrame:
    return t.spark.createDataFrame(rows, ddl)


@query(f"""WITH d AS (SELECT doc_id, quality, source, lang, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS key FROM {_DOCS}),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END, doc_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('tier:' || doc_id), doc_id) AS rank FROM u)
SELECT doc_id, quality, source, CAST(rank AS INT) AS rank, CASE WHEN rank <= 10 THEN 'small' WHEN rank <= 30 THEN 'medium' ELSE 'full' END AS tier FROM r WHERE rank <= 50""")
def tiers(t: Tables) -> DataFrame:
    """Balanced nested tiers: one row of each text by priority of its language, then the hash order within each class."""
    d = dedup_by_priority(labelled(t), X.norm_key("text"), "lang", ["en", "de", "fr"], ["doc_id"])
    return S.tiers(d, "quality", [X.salted("tier:", "doc_id"), "doc_id"], {"small": 10, "medium": 30, "full": 50}).select("doc_id", "quality", "source", "rank", "tier")


@query("SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('rank:' || doc_id), doc_id) AS INT) AS rank FROM documents")
def hash_rank(t: Tables) -> DataFrame:
    return ranked(t.documents.select("doc_id", "lang"), X.salted("rank:", "doc_id"), ["doc_id"], by=["lang"]).withColumn("rank", F.col("rank").cast("int"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('shuffle:' || doc_id), doc_id) AS place FROM documents")
def hash_shuffle(t: Tables) -> DataFrame:
    return ranked(t.documents.select("doc_id"), X.salted("shuffle:", "doc_id"), ["doc_id"], "place")


@query("SELECT doc_id, source FROM documents ORDER BY sha256('audit:' || doc_id), doc_id LIMIT 100")
def audit_sample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").orderBy(X.salted("audit:", "doc_id"), "doc_id").limit(100)


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('cap:' || o_orderkey), o_orderkey) <= 5")
def group_cap(t: Tables) -> DataFrame:
    return S.group_cap(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], [X.salted("cap:", "o_orderkey"), "o_orderkey"], 5)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, round(l_extendedprice, 6) AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_group(t: Tables) -> DataFrame:
    d = S.group_cap(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 3)
    return d.select("l_suppkey", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("price"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (value > 50) DESC, value DESC, event_id DESC) <= 4")
def hard_topk(t: Tables) -> DataFrame:
    return S.group_cap(t.events.select("user_id", "event_id", "value"), ["user_id"], [(F.col("value") > 50).desc(), F.col("value").desc(), F.col("event_id").desc()], 4)


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, sha256('holdout:' || o_custkey) AS h FROM orders GROUP BY 1),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM s)
SELECT o_custkey, n FROM r WHERE before < round_even(total * 0.18, 0)""")
def venue_holdout(t: Tables) -> DataFrame:
    return S.holdout_groups(t.orders, "o_custkey", "holdout:", 0.18)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_version(t: Tables) -> DataFrame:
    return first_of(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), F.col("o_custkey"), ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY o_custkey) * 0.15, 0)) AS k FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'val' ELSE 'train' END AS split FROM r""")
def time_split(t: Tables) -> DataFrame:
    return S.time_split(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "split")


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256('split:' || doc_id), 1, 8) AS BIGINT) % 10 AS INT) AS bucket, CASE WHEN CAST('0x' || substr(sha256('split:' || doc_id), 1, 8) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents")
def hash_split(t: Tables) -> DataFrame:
    b = S.hash_bucket(X.salted("split:", "doc_id"), 10)
    return t.documents.select("doc_id", b.alias("bucket"), F.when(b < 8, "train").otherwise("test").alias("split"))


@query("""WITH g AS (SELECT o_custkey, min(o_orderpriority) AS origin FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY sha256('frac:' || o_custkey), o_custkey) AS rn, count(*) OVER (PARTITION BY origin) AS n FROM g)
SELECT o_custkey, origin, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'calibration' ELSE 'test' END AS split FROM r""")
def frac_split(t: Tables) -> DataFrame:
    """Groups go to the origin that comes first, then are cut 70/85/100 per origin."""
    g = t.orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("origin"))
    return S.fraction_split(g, ["origin"], X.salted("frac:", "o_custkey"), ["o_custkey"], {"train": 0.7, "calibration": 0.85, "test": 1.0})


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 'val' WHEN 'src2' THEN 'test' WHEN 'src3' THEN 'test' ELSE 'train' END AS split FROM documents")
def assign_split(t: Tables) -> DataFrame:
    m = small(t, [("src1", "val"), ("src2", "test"), ("src3", "test")], "source string, split string")
    return t.documents.select("doc_id", "source").join(F.broadcast(m), "source", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("""WITH s(category, share, ord) AS (VALUES ('paper', 0.35::DOUBLE, 0), ('reference_education', 0.20, 1), ('creative', 0.20, 2), ('social_qa', 0.10, 3), ('reviews', 0.10, 4), ('news', 0.05, 5)),
q AS (SELECT category, ord, CAST(floor(997 * share) AS BIGINT) AS n FROM s)
SELECT category, n + CASE WHEN ord < 997 - (SELECT sum(n) FROM q) THEN 1 ELSE 0 END AS quota FROM q""")
def quota_floor(t: Tables) -> DataFrame:
    return small(t, list(S.quota_floor(997, SHARES).items()), "category string, quota bigint")


@query("""WITH s AS (SELECT source, count(*) AS c FROM documents GROUP BY 1), r AS (SELECT source, 333.0::DOUBLE * c / sum(c) OVER () AS raw FROM s),
f AS (SELECT source, CAST(floor(raw) AS BIGINT) AS n, row_number() OVER (ORDER BY raw - floor(raw) DESC, source DESC) AS k FROM r)
SELECT source, n + CASE WHEN k <= 333 - (SELECT sum(n) FROM f) THEN 1 ELSE 0 END AS quota FROM f""")
def quota_lr(t: Tables) -> DataFrame:
    """Largest remainder over the sources' row counts."""
    return S.quotas_largest_remainder(t.documents.groupBy("source").agg(F.count("*").alias("n")), "source", "n", 333)


@query("""WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY sha256('take:' || o_custkey), o_custkey) AS i FROM orders GROUP BY 1),
f AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS have, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS BIGINT) AS n
  UNION ALL SELECT f.i + 1, CASE WHEN f.have < 400 AND f.have + g.n <= 403 THEN f.have + g.n ELSE f.have END, CASE WHEN f.have < 400 AND f.have + g.n <= 403 THEN g.o_custkey END, g.n FROM f JOIN g ON g.i = f.i + 1)
SELECT o_custkey, n FROM f WHERE o_custkey IS NOT NULL""")
def take_groups(t: Tables) -> DataFrame:
    """Whole customers up to 400 orders, three more at most; those that would pass that are passed over."""
    return S.take_groups(t.orders, "o_custkey", "take:", 400, 3)


@query("""WITH s(category, share) AS (VALUES ('paper', 0.35::DOUBLE), ('reference_education', 0.20), ('creative', 0.20), ('social_qa', 0.10), ('reviews', 0.10), ('news', 0.05))
SELECT 'without_' || a.category AS mixture, b.category, round(b.share / ((SELECT sum(share) FROM s) - a.share), 9) AS share FROM s a JOIN s b ON a.category <> b.category""")
def mixes(t: Tables) -> DataFrame:
    return small(t, [(m, c, round(s, 9)) for m, x in S.drop_one(SHARES).items() for c, s in x.items()], "mixture string, category string, share double")


@query("""WITH q(lang, take) AS (VALUES ('en', 20), ('fr', 10), ('de', 10), ('es', 5)), r AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY sha256('strata:' || doc_id), doc_id) AS rn FROM documents JOIN labels USING (doc_id))
SELECT doc_id, lang, quality FROM r JOIN q USING (lang) WHERE rn <= take""")
def stratified(t: Tables) -> DataFrame:
    q = small(t, [("en", 20), ("fr", 10), ("de", 10), ("es", 5)], "lang string, take int")
    d = S.group_rank(labelled(t).select("doc_id", "lang", "quality"), ["lang", "quality"], [X.salted("strata:", "doc_id"), "doc_id"], "rn")
    return d.join(F.broadcast(q), "lang").filter("rn <= take").select("doc_id", "lang", "quality")


@query("""WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256('one:' || event_id), event_id) = 1)
SELECT event_id, user_id, event_type FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256('star:' || event_id), event_id) <= 10""")
def one_per_key(t: Tables) -> DataFrame:
    """One row of each user, then at most ten of each type."""
    f = first_of(t.events.select("event_id", "user_id", "event_type"), F.col("user_id"), [X.salted("one:", "event_id"), "event_id"])
    return S.group_cap(f, ["event_type"], [X.salted("star:", "event_id"), "event_id"], 10)


@query("""WITH h AS (SELECT count(*) FILTER (lang <> 'en') AS a, count(*) FILTER (lang = 'en') AS b FROM documents), n AS (SELECT unnest(range(2, 4 * (SELECT a + b FROM h) + 1, 2)) AS n)
SELECT max(n) AS tier_rows FROM n, h WHERE round_even(n / 2 * 0.35, 0) <= a AND n / 2 - round_even(n / 2 * 0.35, 0) <= b""")
def feasible_tier(t: Tables) -> DataFrame:
    a, b = t.documents.agg(F.count_if(F.col("lang") != "en"), F.count_if(F.col("lang") == "en")).first()
    return small(t, [(S.feasible_tier(a, b, 0.35),)], "tier_rows bigint")


@query("""SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('robin:' || doc_id), doc_id) AS turn FROM
(SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)) ORDER BY turn, source LIMIT 150""")
def round_robin(t: Tables) -> DataFrame:
    """Repeated texts are dropped first, then sources take turns."""
    d = first_of(t.documents, X.raw_key("text"), ["doc_id"])
    return S.round_robin(d, "source", [X.salted("robin:", "doc_id"), "doc_id"], 150).select("doc_id", "source", "turn")


@query()
def interleave(t: Tables) -> DataFrame:
    """Turns of the sources by what is left of their quotas."""
    counts = {r.lang: r.n for r in t.documents.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return small(t, list(enumerate(S.interleave(S.quota_largest_remainder(200, counts)))), "turn int, lang string")


@query()
def dual_cap(t: Tables) -> DataFrame:
    """At most four orders of a customer and thirty of a day, greedily in hash order."""
    o = t.orders.select("o_orderkey", "o_custkey", F.date_trunc("day", "o_orderdate").alias("day"), X.salted("dual:", "o_orderkey").alias("h"))
    return S.dual_cap(o, ["h", "o_orderkey"], {"o_custkey": 4, "day": 30}).select("o_orderkey", "o_custkey", "day")


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders),
s AS (SELECT o_custkey AS supplier, g, row_number() OVER (PARTITION BY g ORDER BY o_custkey) AS j, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority AS g FROM orders WHERE o_orderstatus = 'F'))
SELECT o_orderkey, d.g AS priority, supplier FROM d JOIN s ON d.g = s.g AND s.j = (i - 1) % n + 1""")
def balanced_assign(t: Tables) -> DataFrame:
    """Orders draw on finished customers of their priority; uses differ by at most one."""
    demand = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    supply = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("supplier"), F.col("o_orderpriority").alias("priority")).distinct()
    return S.balanced_assign(demand, supply, "priority", "o_orderkey", "supplier").select("o_orderkey", "priority", "supplier")


@query("SELECT n, CAST(i AS INT) AS i, CAST(round_even(i * (n - 1) / 7.0::DOUBLE, 0) AS BIGINT) AS pick FROM (SELECT DISTINCT n_chars AS n FROM documents WHERE n_chars > 8), (SELECT unnest(range(8)) AS i)")
def linspace_pick(t: Tables) -> DataFrame:
    """Eight evenly spread positions of n."""
    n = t.documents.filter("n_chars > 8").select(F.col("n_chars").alias("n")).distinct()
    return n.select("n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("n", "i", F.bround(F.col("i") * (F.col("n") - 1) / F.lit(7.0).cast("double")).cast("long").alias("pick"))


@query("""WITH c AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('ct:' || doc_id), doc_id) <= 20),
r AS (SELECT *, row_number() OVER (ORDER BY sha256('ct:total:' || doc_id), doc_id) AS rank FROM c)
SELECT doc_id, source, rank, CASE WHEN rank <= 100 THEN 'calibration' ELSE 'test' END AS split FROM r WHERE rank <= 250""")
def cap_then_total(t: Tables) -> DataFrame:
    return S.cap_then_total(t.documents.select("doc_id", "source"), "source", "ct:", "doc_id", 20, {"calibration": 100, "test": 150})


@query("""WITH base AS (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0), gone AS (SELECT doc_id FROM base WHERE lang = 'fr' ORDER BY sha256('swap:' || doc_id), doc_id LIMIT 15),
more AS (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 1 AND lang = 'es' ORDER BY sha256('swap:' || doc_id), doc_id LIMIT 15)
SELECT doc_id, lang FROM base WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT * FROM more""")
def swap_in(t: Tables) -> DataFrame:
    """Fifteen French rows of one half make room for as many Spanish rows of the other."""
    d = t.documents.select("doc_id", "lang")
    base, other, h = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), X.salted("swap:", "doc_id")
    return S.swap(base, "doc_id", base.filter("lang = 'fr'").orderBy(h, "doc_id").limit(15), other.filter("lang = 'es'").orderBy(h, "doc_id").limit(15))


# Set operations and dedup


@query("SELECT doc_id AS id, 'document' AS origin, lang FROM documents UNION ALL SELECT item_id, 'benchmark', NULL FROM benchmark")
def union_sources(t: Tables) -> DataFrame:
    a = t.documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), "lang")
    return a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin")), allowMissingColumns=True)


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def overlap_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id"))


SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END"


def with_split(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 10
    return t.documents.withColumn("split", F.when(m < 7, "train").when(m < 9, "val").otherwise("test"))


@query(f"""SELECT doc_id, split FROM (SELECT doc_id, sha256(text) AS k, {SPLIT} AS split FROM documents)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, doc_id) = 1""")
def priority_dedup(t: Tables) -> DataFrame:
    """Of equal texts the one in the protected split stays."""
    return dedup_by_priority(with_split(t), X.raw_key("text"), "split", ["test", "val", "train"], ["doc_id"]).select("doc_id", "split")


@query("""WITH d AS (SELECT doc_id, doc_id // 5 AS g, sha256(text) AS k FROM documents), l AS (SELECT k, min(g) AS g FROM d GROUP BY k), lost AS (SELECT DISTINCT d.g FROM d JOIN l USING (k) WHERE d.g <> l.g)
SELECT doc_id, g FROM d WHERE g NOT IN (SELECT g FROM lost) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""")
def group_dedup(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", F.floor(F.col("doc_id") / 5).alias("g"))
    return drop_shared_groups(d, X.raw_key("text"), "g", ["doc_id"]).select("doc_id", "g")


@query("SELECT sha256(text) AS key, count(*) AS n, count(DISTINCT source) AS n_payloads, CASE WHEN count(DISTINCT source) > 1 THEN 'conflicting' ELSE 'equal' END AS kind FROM documents GROUP BY 1 HAVING count(*) > 1")
def key_conflicts(t: Tables) -> DataFrame:
    return conflicts(t.documents, X.raw_key("text"), F.col("source"))


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) = 1)")
def author_conflict(t: Tables) -> DataFrame:
    """Texts with more than one source go."""
    d = t.documents.select("doc_id", X.raw_key("text").alias("k"), "source")
    return d.join(d.groupBy("k").agg(F.count_distinct("source").alias("n")).filter("n = 1"), "k", "left_semi").select("doc_id")


@query(f"""WITH d AS (SELECT {SPLIT} AS split, sha256(text) AS text_key, source FROM documents)
SELECT 'text_key' AS field, text_key AS value, count(DISTINCT split) AS n_splits FROM d GROUP BY 2 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'source', source, count(DISTINCT split) FROM d GROUP BY 2 HAVING count(DISTINCT split) > 1""")
def leakage_report(t: Tables) -> DataFrame:
    from corpusmill.operators.contracts import leaks

    return leaks(with_split(t).select("split", X.raw_key("text").alias("text_key"), "source"), ["text_key", "source"])


@query("SELECT count(*) AS n_missing FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def nesting(t: Tables) -> DataFrame:
    from corpusmill.operators.contracts import missing

    return missing(t.labels, t.documents, "doc_id").agg(F.count("*").alias("n_missing"))
