"""What grows with the tables: no exploded terms or fingerprints in shuffles of ids, and no objects for single words."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_terms_stay_in_their_rows(spark):
    assert "Generate" not in plan(spark, "nn_cosine")
    assert "Generate" not in plan(spark, "similarity_report")


def test_vocabulary_and_nearest_rows(spark, monkeypatch):
    from corpusmill.operators import terms as X

    monkeypatch.setattr(X, "AT_ONCE", 16)  # several slices
    texts = {i: [f"w{(i * k * k + k) % 7}" for k in range(i % 9)] for i in range(40)}
    df = spark.createDataFrame([(i, w) for i, w in texts.items()], "id bigint, w array<string>")
    grams = lambda w: [" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1)]
    total, rows = Counter(g for w in texts.values() for g in grams(w)), Counter(g for w in texts.values() for g in set(grams(w)))
    runs = X.Runs(F.col("w"), (2, 3))
    for most in (5, 20, 10_000):
        want = sorted((g for g in total if rows[g] >= 2), key=lambda g: (-total[g], g))[:most]
        v = X.vocabulary(df, runs, 2, most, in_order=True)
        number, idf = {g: i for i, g in enumerate(sorted(want))}, {g: math.log((1 + len(texts)) / (1 + rows[g])) + 1 for g in want}
        assert sorted(v.at) == list(range(len(want)))
        unit = {}
        for i, w in texts.items():
            raw = {g: (1 + math.log(n)) * idf[g] for g, n in Counter(grams(w)).items() if g in idf}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            unit[i] = {g: x / norm for g, x in raw.items()}
        for r in X.row_weights(df, "id", runs, v).collect():
            assert r["at"] == sorted(number[g] for g in unit[r["id"]])
            assert r["w"] == pytest.approx([w for _, w in sorted((number[g], w) for g, w in unit[r["id"]].items())])
        got = {r["id"]: (r["near"], r["cosine"]) for r in X.nearest_rows(df.filter("id % 4 = 1"), df.filter("id % 4 <> 1").withColumnRenamed("id", "near"), "id", "near", runs, v, block=4).collect()}
        for i in range(1, 40, 4):
            all_ = [(-round(sum(x * unit[j].get(g, 0) for g, x in unit[i].items()), 6), j) for j in texts if j % 4 != 1 and unit[i].keys() & unit[j].keys()]
            assert (i in got) == bool(all_)
            if all_:
                assert got[i] == (min(all_)[1], pytest.approx(-min(all_)[0], abs=1.1e-6))


@pytest.mark.parametrize("name", ["excerpt", "bounded_excerpt", "assemble_docs"])
def test_a_text_is_read_once_for_its_excerpt(spark, name):
    p = plan(spark, name)
    assert p.count("ArrowEvalPython") == 1 and "array<struct<start" not in p


@pytest.mark.parametrize("name", ["predicted_spans", "span_bins", "span_token_label", "tokens_within"])
def test_words_are_no_python_objects(spark, name):
    p = plan(spark, name)
    assert "ArrowEvalPython" in p and "word_offsets" in p
    from corpusmill.operators import spans as S
    from pyspark.util import PythonEvalType

    assert S.word_offsets.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_word_places(spark):
    from corpusmill.operators import spans as S

    rows = [(None,), ("",), (" \t\n",), ("one",), ("  a😀b c \x0b d\r\ne ",)]
    got = [r.o for r in spark.createDataFrame(rows, "t string").select(S.word_offsets("t").alias("o")).collect()]
    assert [[(x.start, x.end) for x in o] for o in got] == [[], [], [], [(0, 3)], [(2, 7), (10, 11), (13, 14)]]


def test_labels_and_tokens_of_spans_in_any_order(spark):
    from corpusmill.operators import spans as S

    words = [(0, 3), (4, 9), (10, 12), (13, 20)]
    cases = [[], [(0, 9, 1), (9, 20, 0)], [(13, 20, 0), (0, 5, 1), (5, 9, 1)], [(0, 5, 1), (5, 20, 0)], [(2, 15, 1), (4, 9, 0)], None]
    df = spark.createDataFrame([(words, c) for c in cases], "o array<struct<start:int,end:int>>, s array<struct<start:int,end:int,label:int>>")
    for r, spans in zip(df.coalesce(1).select(S.token_labels(F.col("o"), F.col("s")).alias("y"), S.tokens_inside(F.col("o"), F.col("s")).alias("k")).collect(), cases, strict=True):
        if spans is None:
            assert r.y is None and r.k is None
            continue
        hits = [{c for a, b, c in spans if a < e and b > s} for s, e in words]
        assert r.y == [next(iter(h)) if len(h) == 1 else S.MASKED for h in hits]
        assert [(x.start, x.end) for x in r.k] == [w for w in words if any(a <= w[0] and b >= w[1] for a, b, _ in spans)]


def test_fingerprints_of_a_text_stay_in_its_row(spark):
    for name in ("shingles", "sampled_shingles"):
        assert "Exchange" not in plan(spark, name)


def test_screen_by_brute_force(spark):
    from corpusmill.operators import overlap as O

    sets = {i: [(i * k) % 11 for k in range(i % 4)] for i in range(30)}
    sets[30] = sets[7]
    df = spark.createDataFrame([(i, sorted(set(s))) for i, s in sets.items()], "id bigint, hs array<bigint>")
    got = O.screen_in_order(df, "id", F.sha2(F.concat((F.col("id") % 10).cast("string"), F.col("id").cast("string")), 256))
    key = lambda i: hashlib.sha256(f"{i % 10}{i}".encode()).hexdigest()
    want = {i for i, s in sets.items() if s and not any(set(s) & set(sets[j]) for j in sets if key(j) < key(i))}
    assert {r.id for r in got.collect()} == want
    assert "md5" not in plan(spark, "greedy_screen")


def test_groups_beyond_one_word_of_bits(spark):
    from corpusmill.operators import overlap as O

    df = spark.createDataFrame([(f"g{i:03}", f"a{i // 2} b c") for i in range(140)] + [(None, "a0 b c")], "g string, text string")
    got = {(r.g_a, r.g_b): r.hits for r in O.shared_between(df, "g", 3).collect()}
    assert got == {(f"g{i:03}", f"g{i + 1:03}"): 1 for i in range(0, 140, 2)}
    assert "md5" not in plan(spark, "source_overlap")


def test_blocks_of_pages_are_arrow_arrays(spark):
    from pyspark.util import PythonEvalType

    from corpusmill.functions import pandas_text as P

    pages = [None, "", *(f"<p>a{i}</p><p>b &amp; c" for i in range(150))]
    got = [[(b.tag, b.text) for b in r.b] for r in spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1).select(P.html_blocks("h").alias("b")).collect()]
    assert got == [[] if p is None else P.own_blocks(p) for p in pages]
    assert P.html_blocks.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_words_are_taken_once_for_all_windows(spark):
    assert plan(spark, "window_mean").count("regexp_extract_all") == 1  # a filter below the windows would take them again for each


def test_titles_of_few_texts_at_a_time(spark):
    from pyspark.util import PythonEvalType

    from corpusmill.functions import pandas_text as P

    rows = [(None, "a"), ("one\ntwo", None), ("", ""), *((f"Title: A study of {i}\n we show {i}\n\n so", f"a Study of {i}" if i % 2 else "x") for i in range(150))]
    got = [r.y for r in spark.createDataFrame(rows, "s string, t string").coalesce(1).select(P.drop_title("s", "t").alias("y")).collect()]
    assert got == [None if s is None else P.without_title(s, t or "") for s, t in rows]
    assert P.drop_title.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_windows_are_stitched_from_arrow_arrays(spark):
    from corpusmill.operators import spans as S

    rows = [(i, list(range(0, i % 7)), [[float(i + k)] * (k % 4) for k in range(i % 7)]) for i in range(150)] + [(150, None, [[1.0]]), (151, [0], None), (152, [0], [[]]), (153, [2], [[3.0]])]
    df = spark.createDataFrame(rows, "i bigint, s array<int>, w array<array<double>>").coalesce(1)
    for r, (_, at, windows) in zip(S.stitch_rows(df, "i", "s", "w").collect(), rows, strict=True):
        if at is None or windows is None:
            assert r.scores is None
            continue
        held = [[x for a, w in zip(at, windows, strict=True) for p, x in enumerate(w, a) if p == pos] for pos in range(max((a + len(w) for a, w in zip(at, windows, strict=True)), default=0))]
        assert r.scores == pytest.approx([sum(h) / len(h) if h else 0 for h in held])
    for name in ("stitch_scores", "span_scores"):
        assert "MapInArrow" in plan(spark, name) and "MapInPandas" not in plan(spark, name)
    assert plan(spark, "span_scores").count("round(") == 2


def test_runs_are_hashed_from_hashed_words(spark):
    from corpusmill.operators import overlap as O

    texts = [None, [], ["a"], *([f"w{(i * k * k + k) % (2 + i % 5)}" for k in range(i % 60)] for i in range(120))]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, w array<string>").coalesce(1)
    for width in (1, 2, 5, 13, 24):
        got = {r.id: r.hs for r in df.select("id", O.runs_of("w", width).alias("hs")).collect()}
        runs = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set() for i, w in enumerate(texts)}
        assert all(len(got[i]) == len(set(got[i])) == len(r) for i, r in runs.items())
        assert len({h for hs in got.values() for h in hs}) == len(set().union(*runs.values()))  # equal runs of different texts have one hash
    assert "xxhash64(slice" not in plan(spark, "near_dup_classes")


def test_shared_fingerprints_by_brute_force(spark, monkeypatch):
    from corpusmill.operators import overlap as O

    monkeypatch.setattr(O, "BLOCK", 50)  # several blocks
    sets = {i: sorted({(i * k * k) % 97 * 2**40 for k in range(i % 9)}) for i in range(90)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()], "id bigint, hs array<bigint>")
    held = Counter(h for s in sets.values() for h in s)
    found = O.shared_fingerprints(df, sum(map(len, sets.values())))
    p = found._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") == 1 and "Generate" not in p  # a row of the shuffle is a block
    assert sorted((r.id, r.h, r.df) for r in found.collect()) == sorted((i, h, held[h]) for i, s in sets.items() for h in s if held[h] > 1)


def test_sets_are_not_shuffled_for_their_classes(spark, monkeypatch):
    from corpusmill.operators import overlap as O

    held = []
    monkeypatch.setattr(O, "materialize", lambda df, name: held.append((name, df._jdf.queryExecution().executedPlan().toString())) or df.persist())
    monkeypatch.setattr(O, "discard", lambda df: None)
    sets = spark.createDataFrame([(i, [i // 2, 100 + i // 4, 7]) for i in range(12)], "id bigint, hs array<bigint>")
    for few in (O.HELD, 0):
        monkeypatch.setattr(O, "HELD", few)
        assert {(r.a, r.b, r.common) for r in O.overlap_pairs(sets, "id", "union", 0.5).collect()} == {(0, 2, 2), (4, 6, 2), (8, 10, 2)}
    assert {n for n, _ in held} >= {"classes", "others", "shared"}
    assert not any("hs" in line for n, p in held if n in ("classes", "others") for line in p.splitlines() if "Exchange" in line)


def test_fingerprints_of_pages_are_shuffled_in_blocks(spark):
    p = plan(spark, "internal_overlap")
    assert "md5" not in p and "Generate" not in p


def test_products_of_few_rows_and_queries_at_a_time(spark, monkeypatch):
    import numpy as np

    from corpusmill.operators import neighbours as N

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(1500, 3)), 1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit[:600] @ unit.T, 6)
    sims[np.arange(600), np.arange(600)] = -2
    got = {r.query_id: (r.id, r.cosine) for r in N.nearest_vectors(df.filter("id < 600"), df, "id", "v").collect()}
    assert {q: c for q, (_, c) in got.items()} == {q: pytest.approx(s.max(), abs=1.1e-6) for q, s in enumerate(sims)}
    assert all(i == s.argmax() for (q, (i, _)), s in zip(sorted(got.items()), sims, strict=True))
    assert N.TILE[0] * N.TILE[1] * 8 <= 1 << 22


def test_sampled_fingerprints_where_they_lie(spark, monkeypatch):
    from corpusmill.functions.text import tokens
    from corpusmill.operators import overlap as O

    texts = [None, "", "Straße ÄB c", *(" ".join(f"w{(i * k) % 31}é" for k in range(i)) for i in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    for width in (2, 24):
        got = df.select("id", F.array_join(tokens("text"), " ").alias("w")).select("id", F.explode(O._sampled("w", F.lit(width))).alias("h"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, O.fingerprints(df, "id", width=width, sampled=True).collect()))
    plans = []
    monkeypatch.setattr(O, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    plan(spark, "intake_report")
    assert len(plans) == 1 and "md5(" not in plans[0] and plans[0].count("regexp_extract_all") == 3  # once for candidates and for each of two references
