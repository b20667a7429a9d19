import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import pandas_text as P
from corpusmill.operators import metrics as M
from corpusmill.operators import replay as R
from corpusmill.operators import sampling as S
from corpusmill.operators import spans as X
from corpusmill.operators.graph import connected_components


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 10), (7, 7), (20, None)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10}


def test_components_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    got = connected_components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long")).collect()
    assert len(got) == 200 and {r.component for r in got} == {0}


def test_dual_cap_is_greedy(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), rng.randrange(4)) for i in range(60)]
    a, b, want = {}, {}, []
    for i, x, y in rows:
        if a.get(x, 0) < 4 and b.get(y, 0) < 5:
            a[x], b[y] = a.get(x, 0) + 1, b.get(y, 0) + 1
            want.append(i)
    got = S.dual_cap(spark.createDataFrame(rows, "i int, x int, y int"), ["i"], {"x": 4, "y": 5})
    assert sorted(r.i for r in got.collect()) == want


def test_quotas():
    assert sum(S.quota_floor(997, {"a": 0.5, "b": 0.3, "c": 0.2}).values()) == 997
    assert S.quota_largest_remainder(10, {"a": 1, "b": 1, "c": 1}) == {"a": 3, "b": 3, "c": 4}
    assert S.interleave({"a": 2, "b": 1}) == ["a", "b", "a"]
    n = S.feasible_tier(35, 65, 0.35)
    assert n and round(n / 2 * 0.35) <= 35 and n // 2 - round(n / 2 * 0.35) <= 65


def test_windows_cover(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(1, 400), rng.randrange(20, 90), rng.randrange(1, 20)) for _ in range(60)]
    got = spark.createDataFrame(rows, "n int, size int, stride int").withColumn("s", F.expr("sequence(0, 0)"))
    for size, stride in {(b, c) for _, b, c in rows}:
        for r in got.filter((F.col("size") == size) & (F.col("stride") == stride)).select("n", X.window_starts(F.col("n"), size, stride).alias("s")).collect():
            want = sorted({*range(0, max(0, r.n - size) + 1, stride), max(0, r.n - size)})
            assert r.s == want and {i for s in r.s for i in range(s, min(r.n, s + size))} == set(range(r.n))


def test_token_labels(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        cuts = sorted(rng.sample(range(1, 60), 8))
        tokens = [(a, b) for a, b in zip([0, *cuts], cuts, strict=False)]
        ends = sorted(rng.sample(range(1, 70), 4))
        spans = [(a, b, rng.randrange(2)) for a, b in zip([0, *ends], ends, strict=False) if rng.random() < 0.8]
        rows.append((tokens, spans))
    d = spark.createDataFrame(rows, "o array<struct<start:int,end:int>>, s array<struct<start:int,end:int,label:int>>")
    for r in d.select("o", "s", X.token_labels(F.col("o"), F.col("s")).alias("y"), X.tokens_inside(F.col("o"), F.col("s")).alias("k")).collect():
        for (a, b), y in zip(r.o, r.y, strict=True):
            labels = {z for s, e, z in r.s if max(a, s) < min(b, e)}
            assert y == (labels.pop() if len(labels) == 1 else -100)
        assert [tuple(x) for x in r.k] == [(a, b) for a, b in r.o if any(s <= a and b <= e for s, e, _ in r.s)]
    ids, labels = X.repeat_twice(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, (1, 1, 0))))
    assert tuple(spark.range(1).select(ids, labels).first()) == (list("abcabc"), [-100] * 3 + [1, 1, 0])


def test_stitched_scores(spark):
    rng = random.Random(6)
    rows = [(i, [0, 3, 5], [[rng.random() for _ in range(k)] for k in (4, 4, 3)]) for i in range(5)]
    got = spark.createDataFrame(rows, "i int, s array<int>, w array<array<double>>")
    for r in X.stitch_rows(got, "i", "s", "w").collect():
        starts, windows = rows[r.i][1:]
        for pos in range(8):
            own = [w[pos - a] for a, w in zip(starts, windows, strict=True) if a <= pos < a + len(w)]
            assert abs(r.scores[pos] - sum(own) / len(own)) < 1e-12


def event(source, *ops, **more):
    return {"eventName": "text-insert", "eventSource": source, "textDelta": {"ops": list(ops)}, **more}


def session(document, *events):
    """Events numbered in order behind an initial document."""
    first = {"eventName": "system-initialize", "eventSource": "api", "currentDoc": document}
    return [{**e, "eventNum": i} for i, e in enumerate([first, *events])]


def typed(at, text, source="user"):
    return event(source, {"retain": at}, {"insert": text})


def cut(at, n):
    return event("user", {"retain": at}, {"delete": n})


def labels(*events, document="ab"):
    x = R.replay_events(session(document, *events))
    return x["text"], x["labels"], x["edited"]


def test_replay_origins():
    n = None
    assert labels(typed(2, "c"), typed(3, "DE", "api")) == ("abcDE", [n, n, 0, 1, 1], 0)
    assert labels(typed(2, "long")) == ("ablong", [n] * 6, 0)
    # typing between two different suggestions edits neither, within one it does
    assert labels(typed(2, "XY", "api"), typed(4, "Z", "api"), typed(4, "c")) == ("abXYcZ", [n, n, 1, 1, 0, 1], 0)
    assert labels(typed(2, "XY", "api"), typed(3, "c")) == ("abXcY", [n] * 5, 1)
    # a deletion spoils the whole suggestion and what the same event types, another one stays
    one = event("user", {"retain": 2}, {"delete": 3}, {"insert": "q"})
    assert labels(typed(2, "XYZ", "api"), one) == ("abq", [n] * 3, 1)
    assert labels(typed(2, "XY", "api"), typed(4, "VW", "api"), cut(3, 1)) == ("abXVW", [n, n, n, 1, 1], 1)
    # typing beside text that an edit has touched is an edit again; behind clean text it isn't
    assert labels(typed(2, "XY", "api"), typed(3, "c"), typed(5, "d")) == ("abXcYd", [n] * 6, 2)
    assert labels(typed(2, "XY", "api"), typed(4, "d")) == ("abXYd", [n, n, 1, 1, 0], 0)


def test_replay_errors():
    for bad in ([typed(3, "x")], [cut(1, 2)], [typed(1, "x", "other")], [{**typed(0, "x"), "textDelta": None}], [{**typed(0, "x"), "currentCursor": 9}]):
        with pytest.raises(ValueError):
            R.replay_events(session("ab", *bad))
    with pytest.raises(ValueError, match="surrogate"):
        R.replay_events(session("😀", typed(1, "x")))
    for events in ([typed(0, "x")], session("a") + session("b"), [{"eventName": "system-initialize", "currentDoc": None}]):
        with pytest.raises(ValueError):
            R.replay_events(events)
    assert R.replay_events(session("ab", event("user", {"retain": 9})))["text"] == "ab"  # an offset that nothing uses


def test_replay_text_agrees():
    rng = random.Random(5)
    for _ in range(200):
        events, doc = [], "t😀"
        for _ in range(rng.randrange(8)):
            units = [len(doc[:i].encode("utf-16-le")) // 2 for i in range(len(doc) + 1)]
            at = rng.randrange(len(doc) + 1)
            end = rng.randrange(at, len(doc) + 1)
            ops = [{"retain": units[at]}, {"delete": units[end] - units[at]}, {"insert": rng.choice(["a", "😀b", "xyz"])}]
            doc = doc[:at] + ops[2]["insert"] + doc[end:]
            events.append(event(rng.choice(["user", "api"]), *ops))
        events = session("t😀", *events)
        assert R.replay_events(events)["text"] == R.replay_text(events) == doc


def test_html_own_text():
    html = "<h2>Top</h2><p>one <em>two</em> three<p>four<blockquote>five<p>six</p></blockquote><script>var p = '</p>'</script><ul><li>seven<ul><li>eight"
    assert [t for _, t in P.own_blocks(html)] == ["Top", "one two three", "four", "five", "six", "seven", "eight"]
    book = b"<html xmlns='http://www.w3.org/1999/xhtml'><body><nav><p>x</p></nav><p>one <i>two</i></p><blockquote>a<p>b</p>c</blockquote></body></html>"
    assert P.xhtml_blocks(book) == ["one two", "a c", "b"]


def test_tags():
    assert P.parse_tagged("a <b>cd</b> e", "<b>", "</b>") == ("a cd e", [(2, 4)])
    for bad in ("<b>a<b>", "</b>", "<b>a"):
        with pytest.raises(ValueError):
            P.parse_tagged(bad, "<b>", "</b>")


def test_sources_round_trip(spark, tmp_path):
    from corpusmill.sources import readers as RD
    from corpusmill.sources import writers as W

    df = spark.createDataFrame([(1, 'line one\nline "two"', "a"), (2, "ünï", "b")], "id long, text string, split string")
    W.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(RD.read_jsonl(spark, f"{tmp_path}/j", df.schema).collect()) == sorted(df.collect())
    W.write_csv(df, f"{tmp_path}/c")
    back = RD.read_csv(spark, f"{tmp_path}/c", ["id", "text", "split"])
    assert sorted((int(r.id), r.text, r.split) for r in back.collect()) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        RD.read_csv(spark, f"{tmp_path}/c", ["id", "other"])
    W.write_splits(df, f"{tmp_path}/p", "split")
    assert spark.read.parquet(f"{tmp_path}/p/split=a").count() == 1
    with pytest.raises(Exception, match="exist"):
        W.write_splits(df, f"{tmp_path}/p", "split")
    assert W.append_new(df, f"{tmp_path}/new", "id") == 2 and W.append_new(df, f"{tmp_path}/new", "id") == 0
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("s1.jsonl", '{"a":1}\n{"a":2}\n')
        z.writestr("s2.jsonl", '{"a":3}\n')
    lines = RD.read_zip_lines(spark, f"{tmp_path}/x.zip").collect()
    assert sorted((r.member, r.line_no, r.line) for r in lines) == [("s1.jsonl", 1, '{"a":1}'), ("s1.jsonl", 2, '{"a":2}'), ("s2.jsonl", 1, '{"a":3}')]
    (tmp_path / "posts.xml").write_text('<posts><row Id="1" Body="x &amp; y"/><row Id="2" Body="z"/></posts>')
    assert sorted((r.Id, r.Body) for r in RD.read_xml_rows(spark, f"{tmp_path}/posts.xml", ["Id", "Body"]).collect()) == [("1", "x & y"), ("2", "z")]


def test_streaming_dedup(spark, tmp_path):
    from corpusmill.streaming.screens import dedup_stream

    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:01", "a"), (3, "2024-01-01 00:00:02", "b")]
    df = spark.createDataFrame(rows, "id int, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = dedup_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "text", "1 hour")
    q = stream.writeStream.format("memory").queryName("cm_dedup").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cm_dedup").count() == 2


def test_confusion_of_texts_without_words(spark, tmp_path):
    """A text without words has no share to divide; it is above every score, as in the SQL, and a null text has no score."""
    from corpusmill.queries.registry import QUERIES

    rows = [(i, " ".join(["longerwords" if (i * j) % 7 < 3 else "ab" for j in range(1, 9)]), "en", "s", 50) for i in range(100)] + [(100, "", "en", "s", 0), (101, " \n", "en", "s", 2), (103, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(104)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = [1 if i == 101 or i == 100 else sum((i * j) % 7 < 3 for j in range(1, 9)) / 8 for i in range(102)]
    cut = sorted((s + (i == 100) for i, s in enumerate(score) if i % 2 == 0), reverse=True)[1]  # place floor(0.02 * 51)
    alarm = [s + (i >= 100) > cut for i, s in enumerate(score)]
    want = [sum(a == x and i % 2 == y for i, a in enumerate(alarm)) for y, x in ((1, True), (0, True), (1, False), (0, False))]
    r = QUERIES["confusion"](spark, str(tmp_path)).first()
    assert [r.tp, r.fp, r.fn, r.tn] == want
