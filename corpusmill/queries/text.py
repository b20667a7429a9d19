"""Projections, text functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.queries.registry import Tables, query

CASEFOLD = "replace(lower(text), 'ß', 'ss')"
WORDS = r"regexp_extract_all(text, '\S+')"
FAMILIES = [("promo", "promo"), ("standard", "standard"), ("economy", "economy"), ("small", "small"), ("medium", "medium"), ("large", "large")]
NOTICES = ["all rights reserved", "licensed under", "license", "copyright"]
FOOTER = r"(?i)(?:all rights reserved|licensed under|copyright)"


@query("SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM documents")
def scan_glob(t: Tables) -> DataFrame:
    from corpusmill.sources.readers import read_glob

    return read_glob(t.spark, f"{t.folder}/document[s].parquet").agg(F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace({CASEFOLD}, '\s+', ' ', 'g'))) AS key FROM documents")
def norm_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.norm_key("text").alias("key"))


@query(rf"SELECT doc_id, sha256(coalesce(array_to_string(regexp_extract_all({CASEFOLD}, '[\p{{L}}\p{{N}}_]+'), ' '), '')) AS key FROM documents")
def token_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_key("text").alias("key"))


@query("SELECT doc_id, sha256(text) AS key FROM documents")
def raw_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.raw_key("text").alias("key"))


@query(rf"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n_words FROM documents")
def word_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.word_count("text").alias("n_words"))


@query(rf"""WITH n AS (SELECT doc_id, len({WORDS}) AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN n < 40 THEN NULL WHEN n <= 40 THEN 40 WHEN n <= 80 THEN 80 WHEN n <= 160 THEN 160 WHEN n <= 320 THEN 320 WHEN n <= 640 THEN 640 END AS INT) AS length_bin FROM n""")
def length_bin(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.length_bin(X.word_count("text")).alias("length_bin"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(text, 'https?://\S+', '[URL]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS s, text FROM documents)
SELECT doc_id, sha256(s) AS redacted_key, s <> text AS changed, contains(s, '[EMAIL]') AS excluded FROM r""")
def redact(t: Tables) -> DataFrame:
    """A row with an address is marked for exclusion."""
    d = t.documents.select("doc_id", "text", X.redact("text").alias("s"))
    return d.select("doc_id", F.sha2("s", 256).alias("redacted_key"), (F.col("s") != F.col("text")).alias("changed"), F.contains("s", F.lit("[EMAIL]")).alias("excluded"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(coalesce(array_to_string(s, '|'), '')) AS key FROM s""")
def sentences(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", X.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("key"))


@query(r"SELECT doc_id, md5(regexp_extract(text, '^\s*((?:\S+\s+){0,849}\S+)', 1)) AS prefix_key FROM documents")
def word_prefix(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.word_prefix("text", 850)).alias("prefix_key"))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'plan</think> Sure, here it is:' || chr(10) || chr(10) || text WHEN 1 THEN '**Title: x' || chr(10) || text WHEN 2 THEN text || '</think>rest </think>x' ELSE text END AS s FROM conversations),
a AS (SELECT *, CASE WHEN contains(s, '</think>') THEN trim(substr(s, instr(s, '</think>') + 8)) ELSE s END AS v FROM c), l AS (SELECT *, list_filter(string_split(v, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM a)
SELECT conv_id, turn, trim(regexp_replace(lower(CASE WHEN len(l) > 1 AND regexp_matches(l[1], '^[*# ]*(?:Sure|Here|Abstract|Title|I''m happy to help|Certainly)') THEN array_to_string(l[2:], chr(10)) ELSE v END), '\s+', ' ', 'g')) AS clean FROM l""")
def strip_preamble(t: Tables) -> DataFrame:
    """Turns with the wrappings that the cleaner is for."""
    k = F.col("turn") % 4
    s = F.when(k == 0, F.concat(F.lit("plan</think> Sure, here it is:\n\n"), "text")).when(k == 1, F.concat(F.lit("**Title: x\n"), "text")).when(k == 2, F.concat("text", F.lit("</think>rest </think>x"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", X.strip_preamble(s).alias("clean"))


@query(r"""WITH d AS (SELECT doc_id, lower(text || ' see https://www.' || source || '.example.co.uk:80/x?y=1) and http://u@localhost — snyk-js-a-12345 snyk-x __a_b/- ') AS t FROM documents),
u AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, 'https?://[^\s<>"''`)\]}]+'), lambda u: list_filter(string_split(split_part(list_last(string_split(split_part(substr(u, instr(u, '//') + 2), '/', 1), '@')), ':', 1), '.'), lambda x: x <> '' AND x <> 'www')) AS l FROM d),
w AS (SELECT doc_id, list_transform(l, lambda x: '[' || CASE WHEN len(x) >= 2 THEN x[-2] WHEN len(x) = 1 THEN x[1] ELSE 'link' END || '-url]') || list_transform(range(length(t) - length(replace(t, '—', ''))), lambda x: '—')
  || list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(t, 'https?://[^\s<>"''`)\]}]+', ' ', 'g'), '<[a-z/!][^<>]*>', ' ', 'g'), '[a-z0-9_/-]*[a-z][a-z0-9_/-]*'), lambda x: regexp_replace(regexp_replace(x, '^[_/]+|[_/]+$', '', 'g'), '-+$', '')), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^snyk-.+-\d{4,}$') THEN '[snyk-id]' ELSE x END) AS w FROM u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS key FROM w""")
def lb_tokens(t: Tables) -> DataFrame:
    text = F.concat("text", F.lit(" see https://www."), "source", F.lit(".example.co.uk:80/x?y=1) and http://u@localhost — snyk-js-a-12345 snyk-x __a_b/- "))
    d = t.documents.select("doc_id", X.vocabulary_tokens(text).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("key"))


@query(r"""SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS key FROM documents""")
def split_fold_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.split_fold_key("text").alias("key"))


_GENERATED = "CASE doc_id % 3 WHEN 0 THEN 'A line' || chr(10) || '**Title: of it' || chr(10) || text WHEN 1 THEN '**Abstract**: ' || text || ' Methods: none -' ELSE text END"


@query(rf"""WITH g AS (SELECT doc_id, trim({_GENERATED}) AS s FROM documents), c AS (SELECT doc_id, regexp_replace(s, '(?im)^\s*(?:\*\*)?title\s*[:\-][^\n]*\n?', '') AS s FROM g)
SELECT doc_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\*\*\s*(?:abstract|background|methods?|results?|conclusions?)\s*\*\*\s*[:\-]?', '', 'g'), '(?i)\b(?:abstract|background|methods?|results?|conclusions?)\s*:\s*', '', 'g'), '\s+', ' ', 'g')), '^[ \-]+|[ \-]+$', '', 'g')) AS key FROM c""")
def clean_generated(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    s = F.when(k == 0, F.concat(F.lit("A line\n**Title: of it\n"), "text")).when(k == 1, F.concat(F.lit("**Abstract**: "), "text", F.lit(" Methods: none -"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(X.clean_generated(s)).alias("key"))


@query(r"""WITH p AS (SELECT a.doc_id, len(regexp_extract_all(a.text, '\S+')) AS h, len(regexp_extract_all(b.text, '\S+')) AS g FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0)
SELECT doc_id, CASE WHEN h < 120 OR h > 280 THEN 'length' WHEN g < 80 THEN 'short' WHEN g / h::DOUBLE < 0.6 OR g / h::DOUBLE > 1.6 THEN 'ratio' ELSE 'kept' END AS verdict FROM p""")
def length_ratio(t: Tables) -> DataFrame:
    """Pairs of an even document and the one after it: 120 to 280 words in the first, at least 80 in the second, 0.6 to 1.6 times as many."""
    n = t.documents.select("doc_id", X.word_count("text").alias("n"))
    p = n.filter("doc_id % 2 = 0").select("doc_id", F.col("n").alias("h")).join(n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("g")), "doc_id")
    ratio = F.col("g").cast("double") / F.col("h").cast("double")
    return p.select("doc_id", F.when(~F.col("h").between(120, 280), "length").when(F.col("g") < 80, "short").when(~ratio.between(0.6, 1.6), "ratio").otherwise("kept").alias("verdict"))


@query("""WITH a AS (SELECT event_id, user_id, CASE WHEN user_id % 7 = 0 THEN 'HelperBot' WHEN user_id % 11 = 0 THEN 'Community' ELSE 'user' END || user_id AS name FROM events)
SELECT event_id FROM a WHERE NOT contains(lower(name), 'bot') AND NOT contains(lower(name), 'community')""")
def bot_exclude(t: Tables) -> DataFrame:
    """Rows of accounts whose name holds bot or community go; the accounts are a table of their own."""
    name = F.concat(F.when(F.col("user_id") % 7 == 0, "HelperBot").when(F.col("user_id") % 11 == 0, "Community").otherwise("user"), F.col("user_id").cast("string"))
    bots = t.events.select("user_id", F.lower(name).alias("name")).distinct().filter(F.contains("name", F.lit("bot")) | F.contains("name", F.lit("community")))
    return t.events.join(bots, "user_id", "left_anti").select("event_id")


@query("SELECT column_name AS name, (SELECT count(*) FROM documents) AS n_rows FROM (DESCRIBE documents)")
def schema_probe(t: Tables) -> DataFrame:
    """Names of the columns, and the number of rows from the files' footers."""
    names = t.spark.createDataFrame([(c,) for c in t.documents.columns], "name string")
    return names.crossJoin(F.broadcast(t.documents.agg(F.count("*").alias("n_rows"))))  # one row on the right


@query(r"""SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical FROM pages""")
def canonical_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.canonical_url("url").alias("canonical"))


@query("""SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 'promo') THEN 'promo' WHEN starts_with(lower(p_type), 'standard') THEN 'standard' WHEN starts_with(lower(p_type), 'economy') THEN 'economy'
WHEN starts_with(lower(p_type), 'small') THEN 'small' WHEN starts_with(lower(p_type), 'medium') THEN 'medium' WHEN starts_with(lower(p_type), 'large') THEN 'large' ELSE 'other' END AS family FROM part""")
def prefix_family(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.first_family("p_type", FAMILIES).alias("family"))


@query(r"SELECT doc_id, regexp_matches(lower(substr(text, 1, 2000)), '\b(?:licensed under|all rights reserved|as an ai)\b') AS flagged FROM documents")
def surface_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.lower(F.substring("text", 1, 2000)).rlike(r"\b(?:licensed under|all rights reserved|as an ai)\b").alias("flagged"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'v2.5' WHEN o_orderdate < TIMESTAMP '1996-06-01' THEN 'v3.0' ELSE 'v4.0' END AS licence, CAST(year(o_orderdate) AS INT) AS year FROM orders""")
def bucket_by_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.when(d < F.lit("1994-01-01").cast("timestamp"), "v2.5").when(d < F.lit("1996-06-01").cast("timestamp"), "v3.0").otherwise("v4.0").alias("licence"), F.year(d).alias("year"))


@query(r"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'unknown' END AS s FROM orders)
SELECT o_orderkey, CAST(CASE WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}$') THEN s WHEN regexp_matches(s, '^\d{4}-\d{2}$') THEN s || '-01' WHEN regexp_matches(s, '^\d{4}$') THEN s || '-01-01' END AS DATE) AS day FROM s""")
def parse_dates(t: Tables) -> DataFrame:
    """Missing months and days default to 1; what is no date becomes null."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy")).otherwise("unknown")
    o = t.orders.select("o_orderkey", s.alias("s"))
    part = lambda i: F.regexp_extract("s", r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", i)
    value = lambda i: F.when(part(i) != "", part(i).cast("int"))
    return o.select("o_orderkey", F.when(part(1) != "", F.make_date(value(1), F.coalesce(value(2), F.lit(1)), F.coalesce(value(3), F.lit(1)))).alias("day"))


@query("SELECT event_id, substr(sha256('pseudonym:' || user_id), 1, 16) AS pseudonym FROM events")
def pseudonym(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.pseudonym("pseudonym:", "user_id").alias("pseudonym"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN ' and then' ELSE '' END, '^\s+|\s+$', '', 'g') AS s FROM documents), c AS (SELECT doc_id, s, regexp_extract(s, '(?s)^(.*[.!?])', 1) AS cut FROM r)
SELECT doc_id, md5(CASE WHEN regexp_matches(s, '[.!?”"]$') THEN s WHEN length(cut) > 1 AND length(s) - length(cut) + 1 <= 300 THEN cut ELSE s END) AS key FROM c""")
def trim_tail(t: Tables) -> DataFrame:
    """Whole texts, every other one broken off in a sentence."""
    return t.documents.select("doc_id", F.md5(X.trim_tail(F.concat("text", F.when(F.col("doc_id") % 2 == 0, " and then").otherwise("")))).alias("key"))


@query(r"""WITH s AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS head, substr(text, length(split_part(text, chr(10), 1)) + 2) AS rest FROM documents)
SELECT doc_id, md5(CASE WHEN len(regexp_extract_all(head, '\S+')) <= 14 AND len(regexp_extract_all(rest, '\S+')) >= 250 AND NOT regexp_matches(rtrim(head), '[.!?]$') THEN rest ELSE text END) AS key FROM s""")
def drop_heading(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.drop_heading("text")).alias("key"))


@query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, text, l, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)(?:all rights reserved|licensed under|copyright)')), true), 0) AS pos FROM l),
k AS (SELECT doc_id, text, pos, coalesce(array_to_string(l[1:greatest(pos - 1, 0)], chr(10)), '') AS kept FROM p)
SELECT doc_id, CASE WHEN pos > 0 AND len(regexp_extract_all(kept, '\S+')) >= 60 THEN md5(kept) ELSE md5(text) END AS key, CAST(pos AS BIGINT) AS footer_line FROM k""")
def footer_strip(t: Tables) -> DataFrame:
    at = F.coalesce(F.array_position(F.transform(F.split("text", "\n"), lambda x: x.rlike(FOOTER)), True), F.lit(0))
    return t.documents.select("doc_id", F.md5(X.footer_strip("text", FOOTER, 60)).alias("key"), at.cast("long").alias("footer_line"))


@query("SELECT doc_id, 'Write about ' || CAST(n_chars AS VARCHAR) || ' characters in ' || lang || ' in the style of ' || source || '.' AS prompt FROM documents")
def render_prompt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.format_string("Write about %d characters in %s in the style of %s.", "n_chars", "lang", "source").alias("prompt"))


@query("""SELECT event_id, round(ln(p / (1 - p)), 9) AS logit, round(1 / (1 + exp(-(value / 100))), 9) AS sigmoid, round((1 * p * (1 - p) + 2 * p * p) / 2, 9) AS expected
FROM (SELECT event_id, value, least(greatest(abs(value) / (1 + abs(value)), 1e-6), 1 - 1e-6) AS p FROM events)""")
def score_transforms(t: Tables) -> DataFrame:
    """Clipped logit, logistic, and expected bucket over the probabilities (1-p, p(1-p), p^2)."""
    v = F.col("value")
    e = t.events.select("event_id", "value", F.least(F.greatest(F.abs(v) / (1 + F.abs(v)), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"))
    p = F.col("p")
    buckets = F.array(1 - p, p * (1 - p), p * p)
    expected = F.aggregate(F.zip_with(buckets, F.array(*[F.lit(float(i)) for i in range(3)]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / 2
    return e.select("event_id", F.round(F.ln(p / (1 - p)), 9).alias("logit"), F.round(1 / (1 + F.exp(-v / 100)), 9).alias("sigmoid"), F.round(expected, 9).alias("expected"))


# Filters


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1) AND length(trim(d.text)) >= 100")
def class_filter(t: Tables) -> DataFrame:
    return t.documents.filter(F.length(F.trim("text")) >= 100).join(t.labels.filter(F.col("quality").isin(0, 1)), "doc_id").select("doc_id", "quality")


CASCADE = rf"""CASE WHEN n < 40 THEN 'short' WHEN n > 640 THEN 'long' WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') THEN 'address' WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) > 20 THEN 'symbols' WHEN k > 1 THEN 'repeated' END"""


@query(rf"""WITH d AS (SELECT doc_id, text, len({WORDS}) AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents)
SELECT coalesce({CASCADE}, 'kept') AS reason, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM d GROUP BY 1""")
def reject_cascade(t: Tables) -> DataFrame:
    """The first rule that fails names the reason; a ledger of counts."""
    from corpusmill.operators.contracts import first_reason, ledger
    from corpusmill.operators.dedup import copies

    d = copies(t.documents.select("doc_id", "text", X.word_count("text").alias("n")), X.raw_key("text"), ["doc_id"], "k")
    rules = [
        ("short", F.col("n") < 40), ("long", F.col("n") > 640), ("address", F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")),
        ("symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")) > 20), ("repeated", F.col("k") > 1),
    ]
    return ledger(d.withColumn("reason", first_reason(rules)), [F.count("*").alias("n_docs"), F.sum("n").alias("n_words")])


@query(rf"""WITH d AS (SELECT source, lang, len({WORDS}) AS n FROM documents), p AS (SELECT source, max(CASE WHEN lang = 'en' THEN n END) AS a, max(CASE WHEN lang <> 'en' THEN n END) AS b FROM d GROUP BY source)
SELECT source, a, b FROM (SELECT source, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM p) WHERE greatest(a, b) <= 2 * least(a, b) AND a IS NOT NULL AND b IS NOT NULL""")
def pair_ratio(t: Tables) -> DataFrame:
    """Pairs whose lengths differ by at most two to one."""
    d = t.documents.select("source", "lang", X.word_count("text").alias("n"))
    p = d.groupBy("source").agg(F.max(F.when(F.col("lang") == "en", F.col("n"))).alias("a"), F.max(F.when(F.col("lang") != "en", F.col("n"))).alias("b"))
    return p.filter("a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) <= 2 * least(a, b)")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-12-31' AND regexp_matches(o_orderpriority, '^[1-3]-')")
def date_gate(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderdate") <= F.lit("1995-12-31").cast("timestamp")).filter(F.col("o_orderpriority").rlike("^[1-3]-")).select("o_orderkey")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), 'cheap|casino|adult|bets|spam')")
def blocklist(t: Tables) -> DataFrame:
    return t.pages.filter(~F.lower("url").rlike("cheap|casino|adult|bets|spam")).select("page_id")


@query("""WITH c AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, bool_and(length(text) > 0) AS full_text, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT conv_id, CASE WHEN n <> 2 THEN 'multi_turn' WHEN roles <> 'user>assistant' THEN 'roles' WHEN NOT full_text THEN 'empty' ELSE 'ok' END AS verdict FROM c""")
def two_turn(t: Tables) -> DataFrame:
    """Exactly one user turn and one answer, both with text."""
    c = t.conversations.filter("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s"), F.bool_and(F.length("text") > 0).alias("full_text"))
    roles = F.array_join(F.transform("s", lambda x: x["role"]), ">")
    return c.select("conv_id", F.when(F.col("n") != 2, "multi_turn").when(roles != "user>assistant", "roles").when(~F.col("full_text"), "empty").otherwise("ok").alias("verdict"))


@query("""WITH h AS (SELECT doc_id, lower(substr(text, 1, 1800)) AS h FROM documents)
SELECT doc_id, CAST(contains(h, 'all rights reserved') AS INT) + CAST(contains(h, 'licensed under') AS INT) + CAST(contains(h, 'license') AS INT) + CAST(contains(h, 'copyright') AS INT) AS votes FROM h""")
def boilerplate_vote(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.boilerplate_votes("text", NOTICES).alias("votes"))


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND length(x.text) > 400)")
def group_exclude(t: Tables) -> DataFrame:
    """A whole conversation goes if any turn is over length."""
    c = t.conversations
    return c.join(c.filter(F.length("text") > 400).select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn")


@query("""WITH c AS (SELECT event_type, count(*) FILTER (user_id % 10 < 7) AS train, count(*) FILTER (user_id % 10 = 7 OR user_id % 10 = 8) AS val, count(*) FILTER (user_id % 10 = 9) AS test FROM events GROUP BY 1)
SELECT event_type, train, val, test FROM c WHERE train >= 60 AND val >= 10 AND test >= 10""")
def min_support(t: Tables) -> DataFrame:
    """Labels with enough rows in every split."""
    m = F.col("user_id") % 10
    c = t.events.groupBy("event_type").agg(F.count_if(m < 7).alias("train"), F.count_if((m == 7) | (m == 8)).alias("val"), F.count_if(m == 9).alias("test"))
    return c.filter("train >= 60 AND val >= 10 AND test >= 10")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_block(t: Tables) -> DataFrame:
    """Users with an event of every type (relational division)."""
    kinds = t.events.agg(F.count_distinct("event_type").alias("k"))
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).join(F.broadcast(kinds), F.col("n") == F.col("k")).select("user_id")
