"""Operators of the subpackage against brute force, and on awkward tables."""

import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate as D
from corpusmill.llm import html_templates as H
from corpusmill.llm import line_rules as Q
from corpusmill.llm import pu_toxicity as U
from corpusmill.llm import sentencepiece_codec as SP
from corpusmill.llm import shard_lookup as L
from corpusmill.llm import simhash_dedup as SH
from corpusmill.llm import token_counts as C
from corpusmill.llm import token_store as TS
from corpusmill.llm.queries import ORACLES, QUERIES, tokenizer_path
from corpusmill.llm.substring_dedup import COVERS, cover_for, substring_dedup
from corpusmill.llm.words import words

WORDS = [f"w{i}" for i in range(40)]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def awkward():
    """Nulls in every column, empty and blank texts, repeated rows, a repeated id, copies and one long text."""
    rng = random.Random(7)
    base = [text(rng, 60) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(10, base[0], "en", "s", 1), (10, base[0], "en", "s", 1), (11, base[1], "de", None, 2), (11, base[2], "de", None, 2)]
    rows += [(12, None, None, None, None), (13, "", "en", "s", 0), (14, " \n\t ", "en", "s", 0), (None, base[3], "en", "s", None)]
    rows += [(15, "é 😀 中文  x", "en", "t", 9), (16, text(rng, 5000), "en", "t", 1), (17, "x" * 300_000, "en", "t", 1), (18, "a <|endoftext|> b", "en", "t", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def clashing(df):
    """Extra columns with the names that operators add."""
    for c in ("n_words", "n_removed", "kept", "score", "slot", "shard", "ids", "component", "key", "h", "n_pieces", "base_failed", "clean_text"):
        df = df.withColumn(c, F.lit("own"))
    return df


def test_words():
    t = ["a b\n", "", "  é\x0bc\x1fd ", "word"]
    w = words([x.encode() for x in t])
    assert w.counts().tolist() == [2, 0, 2, 1]
    assert [w.buffer[a:b] for a, b in zip(w.start, w.end)] == [x for s in t for x in s.encode().split()]


# 4


def brute_removed(rows, window):
    seen = {}
    for i, w in rows:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            seen[k] = min(seen.get(k, (i, j)), (i, j))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] < (i, j):
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_covers():
    for period, cover in COVERS:
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert [cover_for(w)[0] for w in (20, 8, 3, 1)] == [13, 3, 3, 1] or all(cover_for(w)[2] >= 1 for w in range(1, 40))


@pytest.mark.parametrize("window", [20, 5, 1])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    passages = [text(rng, 30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng, rng.randrange(0, 40), WORDS if window > 1 else [f"u{k}" for k in range(3000)])]
        parts += rng.sample(passages, rng.randrange(3))
        rows.append((i * 7 % 61, " ".join(parts)))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window)
    want = brute_removed(sorted((i, t.split()) for i, t in rows), window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(want)


def test_substring_dedup_awkward(docs, none):
    got = substring_dedup(clashing(docs)).collect()
    assert len(got) == len(awkward())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_removed == 60 and r.text == "" for r in by[10] + by[11])  # later copies go whole
    assert by[None][0].n_removed == 0 and by[3][0].n_removed == 60  # a null id comes first
    assert [by[k][0].n_words for k in (12, 13, 14, 16, 17)] == [0, 0, 0, 5000, 1]
    assert by[0][0].kept == "own" and substring_dedup(none).count() == 0


# 9


def test_position_sets():
    sets = SH.position_sets(4)
    assert all(any(set(s) <= set(c) for s in sets) for c in itertools.combinations(range(8), 4))


def test_fingerprint():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 50):
        t = text(rng, n).title().encode()
        w = t.lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, n - 3))] if n else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert SH.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_links_connect_what_is_near(spark):
    rng = random.Random(4)
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in [rng.getrandbits(64) for _ in range(6)] for _ in range(40)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long")
    from corpusmill.operators.graph import connected_components

    edges = SH.fingerprint_links(df)
    got = dict(connected_components(edges).collect())
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert [got.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]
    assert edges.count() < 20 * 8 * len(fps)


def test_near_duplicates_awkward(docs, none):
    got = SH.near_duplicates(clashing(docs)).collect()
    assert len(got) == len(awkward()) - 1
    by = {r.doc_id: r for r in got}
    assert by[10].component_id == 0 and {by[k].component_id for k in (12, 13, 14)} == {12} and by[12].fingerprint == "0" * 16
    assert SH.near_duplicates(none).count() == 0


# 3


def test_line_rules(spark, docs, none):
    got = Q.line_rules(clashing(docs)).collect()
    assert len(got) == len(awkward())
    by = {r.doc_id: r for r in got}
    assert by[12].n_words == 0 and by[12].base_failed and not by[12].kept and by[0].kept and by[10].kept and by[0].score == "own"
    assert Q.line_rules(none).count() == 0
    rng = random.Random(9)
    rows = [(i, f"Shared  Line of seven words, truly it is\n{text(rng, 60)}", "h") for i in range(30)]
    rows += [(100 + i, "\n".join(["shared line of seven words, truly it is"] * 9 + [f"own{i}"]), "h") for i in range(3)]
    rows += [(200 + i, "\n".join(text(random.Random(k), 30) for k in range(3)), "h") for i in range(40)]  # copies
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for listed in (1000, 0):
        out = {r.doc_id: r for r in Q.line_rules(df, max_docs=20, max_listed=listed).collect()}
        assert all(out[i].n_removed == 8 and out[i].kept and "hared" not in out[i].clean_text for i in range(30))
        assert not any(out[100 + i].kept for i in range(3))
        assert all(out[200 + i].kept and out[200 + i].n_removed == 0 for i in range(40))


def test_lines_shared_by_all_pages_of_a_host(spark):
    rng = random.Random(10)
    shared = [f"shared line {k}: {text(rng, 4)}" for k in range(5)]
    rows = [(i, "\n".join([*shared[:2], text(rng, 60), f"own {i}", *shared[2:]]), "h") for i in range(30)]
    rows += [(100 + i, rows[0][1].replace("own 0", "copied"), "g") for i in range(40)]  # copies count once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for listed in (1000, 0):
        out = {r.doc_id: r for r in Q.line_rules(df, max_docs=20, max_listed=listed).collect()}
        assert all(out[i].n_removed == 35 and out[i].kept and "shared" not in out[i].clean_text for i in range(30))
        assert all(out[100 + i].n_removed == 0 and out[100 + i].kept for i in range(40))


def test_header_and_footer_over_the_limit(spark):
    """150 documents of 100 words, 70 of them in a header and a footer that all share: each is depleted. The SQL says the same."""
    import duckdb

    rng = random.Random(15)
    words = [f"x{i}" for i in range(200)]
    rows = []
    for host in range(6):
        head, foot = text(rng, 35, words), text(rng, 35, words)
        rows += [(1000 * host + i, f"{head}\n{text(rng, 30, words)}\n{foot.upper()}" if i % 2 else f" {head}\n{text(rng, 30, words)}\n{foot}", f"h{host}") for i in range(150)]
        rows += [(1000 * host + 500 + i, f"{head}\n{text(random.Random(host), 90, words)}", f"h{host}") for i in range(200)]  # copies: one document with a frequent header
    rows += [(9000 + i, f"{text(rng, 5, words)}\n{text(rng, 60, words)}", "h0") for i in range(20)] + [(9100 + i, text(random.Random(1), 60, words), "alone") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in Q.line_rules(df).collect()}
    for i, _, host in rows:
        kept = got[i].kept
        assert kept == (i >= 9000 or i % 1000 >= 500), (i, host)
        assert got[i].n_removed == (0 if i >= 9000 else 35 if i % 1000 >= 500 else 70)
    con = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    con.register("documents", documents)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op3_line_frequency']})").fetchall()
    assert sorted(sql) == sorted(tuple(got[i][c] for c in columns) for i, *_ in rows)


def test_repeat_words(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randrange(0, 120), WORDS[:4] if i % 2 else WORDS)) for i in range(80)]
    got = {r.doc_id: r.n_repeat_words for r in Q.base_counts(spark.createDataFrame(rows, "doc_id long, text string"), "text").filter("n_words >= 0").collect()}
    for i, t in rows:
        w = t.split()
        k = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        assert got[i] == len({j + d for j, x in enumerate(k) if k.count(x) > 1 for d in range(3)})


# 5


def test_matcher_is_exact():
    rng = random.Random(11)

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(400):
        p = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 80))]
        q = [x for x in p if rng.random() > 0.08]
        t = [rng.choice("abcdefgh") for _ in range(20)] + q + [rng.choice("abcdefgh") for _ in range(20)]
        m = D.Matcher([(1, p)], 0.15)
        got, best = m.find(t), distance(p, t)
        assert bool(got) == (best <= m.items[0][2])
        if got:
            assert got[0][1] == best == distance(p, t[got[0][2] : got[0][3]])


def test_many_items_against_brute_force(spark):
    rng = random.Random(17)
    items = [(i, text(rng, rng.randrange(1, 40))) for i in range(60)]
    rows = []
    for k in range(60):
        w = items[k][1].split()
        if k % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, text(rng, 20) + " " + " ".join(w if k % 4 else w[:-1]) + " " + text(rng, 20)))
    got = {(r.doc_id, r.item_id): r.distance for r in D.benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000).collect()}
    want = {}
    for i, t in rows:
        for j, item in items:
            p, words_of = item.split(), t.split()
            row = [0] * (len(words_of) + 1)
            for n, x in enumerate(p, 1):
                new = [n]
                for m, y in enumerate(words_of, 1):
                    new.append(min(row[m - 1] + (x != y), row[m] + 1, new[-1] + 1))
                row = new
            if min(row) <= int(0.15 * len(p)):
                want[i, j] = min(row)
    assert got == want and len(want) > 60


def test_benchmark_matches(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(awkward()[2][1].split()[10:40])), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    hits = D.benchmark_matches(clashing(docs), items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in hits) == [(2, 1, 0), (11, 1, 0)]
    assert D.benchmark_matches(clashing(docs), items, block_bytes=60).count() == 2
    for block in (32 << 20, 60):
        left = D.decontaminate(clashing(docs), items, block_bytes=block)
        assert left.count() == len(awkward()) - 2 and left.columns == clashing(docs).columns  # document 2, and the row of id 11 with its text
    short = spark.createDataFrame([(7, "x"), (8, "x")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.benchmark_matches(docs, short).collect()) == [(15, 7), (15, 8)]
    assert D.benchmark_matches(none, items).count() == 0 and D.benchmark_matches(docs, items.limit(0)).count() == 0


# 10


def test_sentencepiece_equals_library(spark, docs, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b ", "\n\n", " \n ", "日本語 😀", "▁ a", "<s> <0x0A>"] + ["".join(rng.choice(" \nabé中thein.") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    codec = SP.Codec(path)
    assert [np.frombuffer(e, "<u4").tolist() for e in codec.encode(texts)] == [sp.encode(t) for t in texts]
    got = SP.encode(clashing(docs), path)
    rows = got.collect()
    assert len(rows) == len(awkward()) and all(r.round_trip in (True, None) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[12].ids is None and by[13].ids == [] and by[16].ids == sp.encode(by[16].text)
    back = SP.decode(got, path).filter("text IS NOT NULL")
    assert back.filter("decoded <> text").count() == 0
    assert SP.encode(none, path).count() == 0


# 1


def test_pu_toxicity(spark, none):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        rows.append((i, text(rng, 40) + (" idiot " + rng.choice(["scum", "moron"]) if toxic else ""), "en", "s", 1))
        if rng.random() < 0.5:
            marks.append((i, int(toxic)))
    truth = {i: "idiot" in t for i, t, *_ in rows}
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "x", "en", "s", 0)]
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    docs = clashing(spark.createDataFrame(rows, DDL))
    got = {r.doc_id: r for r in U.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in truth if got[i].held_out} == set(held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert U.toxicity(none, labels).count() == 0 and U.toxicity(docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("copies", ["clean", "toxic"])
def test_pu_toxicity_with_copies(spark, copies):
    rng = random.Random(16)
    insults = ["scum", "moron", "idiot", "vermin"]
    truth = [i % 10 == 0 for i in range(2000)]
    rows = [(i, text(rng, 40) + (f" {rng.choice(insults)} {rng.choice(insults)}" if toxic else ""), "en", "s", 1) for i, toxic in enumerate(truth)]
    marks = [(i, int(toxic)) for i, toxic in enumerate(truth) if rng.random() < 0.5]
    one = text(rng, 40) + (" scum moron" if copies == "toxic" else "")
    rows += [(10_000 + i, one, "en", "s", 1) for i in range(1000)]
    got = {r.doc_id: r.predicted for r in U.toxicity(spark.createDataFrame(rows, DDL), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    assert np.mean([got[i] for i, toxic in enumerate(truth) if toxic]) > 0.95
    assert np.mean([got[i] for i, toxic in enumerate(truth) if not toxic]) < 0.005
    assert {got[10_000 + i] for i in range(1000)} == {int(copies == "toxic")}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_pu_fit_with_few_positives(n):
    rng = np.random.default_rng(n)
    rows = [np.unique(rng.integers(0, 1 << U.BITS, 30)) for _ in range(400)]
    for prior in (0.0, 0.01, 0.3, 0.9):
        for clean in ([], rows[n : n + 100]):
            m = U.fit(rows[:n], rows, prior, clean)
            assert not m.weights.any() and (m.scores(["", "some words", "more of them"]) < 0.7).all()


# 2


def test_token_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)  # as it comes: a special token in a text is one id
    rng = random.Random(3)
    texts = ["".join(rng.choice([*"ab 's,.\n\t1é中  '", " the", " \n", "ll"]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["x<|endoftext|>y", "<|endoftext|>", " a <|endoftext|>\n", "it's WE'LL 'tis s't", "½x²3 _a_b", "a\u00a0b", "\x85x", "x\x1cy", "\0", "a\0b", "naïve Ǆ ɐ", "ﬁ ٣ १", "-- !!12a3.4", "\r\nfoo\r\nbar"]
    ids, counts = TS.Encoder(path).encode(pa.array(texts))
    ends = np.cumsum(counts).tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert library.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    other = tokenizer_path("word_bpe_49k.json")
    ids, counts = TS.Encoder(other).encode(pa.array(texts))
    plain = Tokenizer.from_file(other)
    assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids] and len(counts) == len(texts)
    where = f"file://{tmp_path}/store"
    TS.write_store(clashing(docs), where, path, average=64, parts=3)
    rows = sorted((r for r in awkward() if r[0] is not None), key=lambda r: r[0])
    got = sorted(TS.verify(spark, where).collect(), key=lambda r: (r.doc_id, r.start))
    ids = {}
    for r in TS.restore(spark, where).collect():
        ids.setdefault(r.doc_id, []).append(r.ids)
    start = 0
    for r in got:
        mine = [x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32]
        assert r.start == start and mine and r.verified
        start += r.n_tokens
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows)
    assert sorted((i, x) for i, y in ids.items() for x in y) == want
    n = spark.read.parquet(f"{where}/data/kind=chunk").count()
    assert n == spark.read.parquet(f"{where}/data/kind=chunk").select("hash").distinct().count()
    TS.write_store(none, f"{where}0", path)
    assert TS.verify(spark, f"{where}0").count() == 0


def test_crc_of_parts():
    rng = random.Random(8)
    parts = [[rng.randbytes(rng.randrange(0, 50)) for _ in range(rng.randrange(0, 6))] for _ in range(50)]
    got = TS.join_crcs([[zlib.crc32(x) for x in p] for p in parts], [[len(x) for x in p] for p in parts])
    assert got.tolist() == [zlib.crc32(b"".join(p)) for p in parts]


# 6, 7


def test_section_tokens(spark, docs, none):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    got = C.section_tokens(clashing(docs), path)
    total = {}
    for r in got.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    enc, _ = C.encoding(path)
    assert total[16] == len(enc.encode_ordinary(awkward()[-3][1])) and 12 not in total and 13 not in total
    assert C.section_tokens(none, path).count() == 0
    spans = spark.createDataFrame([(1, "alpha beta gamma", [(0, 8), (8, 16)]), (2, "ab", [])], "doc_id long, text string, s array<struct<a:int,b:int>>")
    rows = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in C.section_tokens(spans, path, spans_col="s").collect()}
    assert rows[1, 0][0] + rows[1, 1][0] == len(enc.encode_ordinary("alpha beta gamma")) and rows[2, -1][0] == 1
    ends = np.array([2, 6])
    assert C.attribute(ends, np.array([0, 4]), np.array([4, 8]))[0].tolist() == [0, 0]  # a tie goes to the earlier section


def test_lookup_table_against_a_slow_fill():
    for weights, size in (({"a": 1, "b": 2, "c": 1}, 31), (dict.fromkeys("pqrstu", 1), 101)):
        names, table = sorted(weights), {}
        orders = {n: [(L.preference(n, size)[0] + k * L.preference(n, size)[1]) % size for k in range(size)] for n in names}
        assert all(sorted(o) == list(range(size)) for o in orders.values())
        while len(table) < size:
            for n in names:
                for _ in range(weights[n]):
                    if len(table) < size:
                        table[next(s for s in orders[n] if s not in table)] = names.index(n)
        assert L.lookup_table(weights, size).tolist() == [table[s] for s in range(size)]


def test_attribution_against_a_loop():
    rng = random.Random(18)
    for _ in range(300):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(0, 20))])
        cut = sorted(rng.sample(range(0, 60), 8))
        spans = [(a, b) for a, b in zip(cut[::2], cut[1::2], strict=True)]
        section, crossing = C.attribute(ends, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
        begin = 0
        for end, k, x in zip(ends.tolist(), section.tolist(), crossing.tolist(), strict=True):
            held = [min(end, b) - max(begin, a) for a, b in spans]
            best = max(held)
            assert k == (held.index(best) if best > 0 else -1)
            assert best <= 0 or x == (best < end - begin)
            begin = end


def test_unigram_viterbi():
    rng = random.Random(19)
    for _ in range(30):
        c = object.__new__(SP.Codec)
        names = sorted({"".join(rng.choice("▁ab") for _ in range(rng.randrange(1, 4))) for _ in range(12)} | {"▁"})
        c.pieces, c.score, c.bpe = {p: 300 + i for i, p in enumerate(names)}, {300 + i: -rng.random() * 5 for i in range(len(names))}, False
        c.byte, c.longest, c.pairs, c.words = {b: b for b in range(256)}, 3, {}, {}
        keys = sorted({"".join(rng.choice("abz") for _ in range(rng.randrange(1, 7))) for _ in range(20)})
        c.learn(keys)
        for key in keys:
            word = "▁" + key
            best = [(0.0, [])]
            for end in range(1, len(word) + 1):
                found = [(best[at][0] + c.score[c.pieces[word[at:end]]], best[at][1] + [c.pieces[word[at:end]]]) for at in range(end) if word[at:end] in c.pieces]
                best.append(max(found, key=lambda x: x[0]) if found else (best[end - 1][0] - 1e4, best[end - 1][1] + list(word[end - 1].encode())))
            assert np.frombuffer(c.words[key], "<u4").tolist() == best[-1][1]


def test_pu_risk_and_gradient():
    rng = np.random.default_rng(20)
    seen = set()
    for prior in (0.05, 0.3, 0.9):
        for shift in (-3, 0, 3):
            zp, zu = rng.normal(size=7) + shift, rng.normal(size=11) - shift
            value, gp, gu = U.risk(zp, zu, prior)
            loss = lambda z: np.log1p(np.exp(-z))
            negative = lambda a, b: loss(-b).mean() - prior * loss(-a).mean()
            assert np.isclose(value, prior * loss(zp).mean() + max(0, negative(zp, zu)))
            seen.add(below := negative(zp, zu) < 0)
            whole = (lambda a, b: -negative(a, b)) if below else (lambda a, b: prior * loss(a).mean() + negative(a, b))
            for z, g, left in ((zp, gp, True), (zu, gu, False)):
                for i in range(len(z)):
                    up, down = z.copy(), z.copy()
                    up[i] += 1e-6
                    down[i] -= 1e-6
                    numeric = (whole(up, zu) - whole(down, zu) if left else whole(zp, up) - whole(zp, down)) / 2e-6
                    assert np.isclose(numeric, g[i], atol=1e-6)
    assert seen == {True, False}


def test_lookup_table(spark, docs, none):
    names = [f"s{i}" for i in range(7)]
    table = L.lookup_table(names, 1009)
    share = np.bincount(table)
    assert share.max() - share.min() <= 1
    left = L.lookup_table(names[:-1], 1009)
    kept = table != 6
    assert (left[kept] != table[kept]).mean() < 0.2
    heavy = np.bincount(L.lookup_table({"a": 1, "b": 3}, 1009))
    assert abs(heavy[1] - 3 * heavy[0]) <= 4
    with pytest.raises(ValueError):
        L.lookup_table(names, 1000)
    got = L.assign_shards(clashing(docs), names, ["doc_id"], size=1009).collect()
    assert len(got) == len(awkward()) and all(r.shard == names[table[r.slot]] for r in got)
    d = next(r for r in got if r.doc_id == 3)
    assert d.slot == int(hashlib.md5(b"3").hexdigest()[:15], 16) % 1009
    assert L.assign_shards(none, names, ["doc_id"]).count() == 0
    assert L.assign_shards(clashing(docs), names, ["slot"], size=1009).select("shard").distinct().count() == 1


# 8


def ruled(page):
    return H.ruled_text(H.read_page(page)[1])


def test_pages_without_a_template():
    page = """<!DOCTYPE html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a href=x>Menu</a></nav>
    <header>Site</header><div class="ad-box ad">Buy</div><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>th
    ree<p>Four<br>five<div class='comments'><p>First!</p></div><form>Name</form></article><aside>Side</aside><footer>&copy;</footer>"""
    assert ruled(page) == "Title & more One twoth ree Four five"
    assert ruled("") == "" and ruled("<p>a<!-- b --> c") == "a c"
    story = "The story goes on for a while and says what there is to say about it."
    assert ruled(f"<article><p>{story}</p></article><article class='comment'><p>I agree</p></article><article class='reader-comments'><p>{story} {story}</p></article>") == story
    assert ruled(f"<article class='related'><p>A teaser</p></article><div><p>{story}</p></div>") == story
    assert ruled(f"<article><p>A teaser</p></article><div><p>{story}</p></div>") == f"A teaser {story}"
    assert ruled(f"<div class='share-price report'><p>{story}</p></div><div class='share-buttons'>Share this</div>") == story
    assert ruled(f"<form action=x><div><p>{story}</p></div></form><form>Your name</form>") == story
    assert ruled(f"<article><p>{story} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>") == f"{story} x=1 holds"


def plain_page(rng, own, extra=""):
    """A page without names that tell anything: places alone say which part is which."""
    side = "".join(f"<li>{text(rng, 2)}" for _ in range(rng.randrange(2, 6)))
    return f"<body><div><ul>{side}</ul></div><div class=x1><p>{text(rng, 4)}</div><div class=x2><h1>{own[0]}</h1><p>Printed by us<div class=x3>{''.join(f'<p>{o}' for o in own[1:])}</div>{extra}</div><div class=x4><p>{text(rng, 5)}<p>Every page says so</div></body>"


def test_templates_decide(spark):
    rng = random.Random(12)
    own = {i: [text(rng, 5), *(text(rng, rng.randrange(10, 60)) for _ in range(rng.randrange(1, 5)))] for i in range(12)}
    rows = [(i, "https://a.example/x", plain_page(rng, own[i], "<div class=y><a href=z>" + text(rng, 3) + "</a></div>")) for i in own]
    rows += [(50, "https://b.example", f"<p>{text(rng, 30)}"), (51, None, None), (52, "https://a.example/x", ""), (53, "https://a.example/x", "<p>another kind of page")]
    rows += [(60 + i, "https://c.example/x", plain_page(rng, [text(rng, 4), text(rng, 30)]) .replace("class=x2", "class='share-price report'")) for i in range(5)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.lit("own"))
    for held in (10_000, 0):
        got = {r.page_id: r for r in H.extract_main_text(df, held_rows=held).collect()}
        assert len(got) == len(rows)
        for i, o in own.items():
            assert got[i].by_template and got[i].text == " ".join(o), i
            assert got[i].n_chars == len(got[i].text) and got[i].kept == "own"
        assert not got[50].by_template and got[50].text == rows[12][2][3:] and got[51].text == got[52].text == "" and got[53].text == "another kind of page"
        assert all(got[60 + i].by_template and got[60 + i].text for i in range(5))
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_deduction_against_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for host in range(3):
        for i in range(8):
            page = plain_page(rng, [text(rng, 4), text(rng, 30)]) if host else f"<body><div class=a><p>{text(rng, 9)}</div>" + ("<div class=b><p>Now and then<ul><li>x</ul></div>" if i % 2 else "") + "</body>"
            rows += [(host, page)] * rng.choice([1, 1, 2, 4])  # copies count once
    df = spark.createDataFrame(rows, "host long, html string").withColumn("page", F.xxhash64("html"))
    got = {(r.host, r.token): (r.n_pages, r.class_id, r.parent) for r in H.deduce_templates(df).collect()}
    want = {}
    for host in {h for h, _ in rows}:
        pages = sorted({p for h, p in rows if h == host})
        vectors = {}
        for k, p in enumerate(pages):
            for token, x in H.page_tokens(*H.read_page(p)).items():
                vectors.setdefault(token, [0] * len(pages))[k] = x.count
        classes = {}
        for token, v in vectors.items():
            if sum(map(bool, v)) >= max(4, 0.5 * len(pages)):
                classes.setdefault(tuple(v), []).append(H._signed(token))
        for v, tokens in classes.items():
            if len(tokens) >= 3:
                want |= {(host, t): (sum(map(bool, v)), v) for t in tokens}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] for k in want)
    for x, y in itertools.combinations(want, 2):
        if x[0] == y[0]:
            assert (got[x][1] == got[y][1]) == (want[x][1] == want[y][1])
    inner = {got[k][1:] for k in got if k[0] == 0}
    assert len(inner) == 2 and {p for _, p in inner} == {-1, next(c for c, p in inner if p < 0)}  # the part of every other page lies within the whole


def test_templates_with_copies_of_a_page(spark):
    rng = random.Random(13)
    page = lambda own: f"<body><div class=a><p>Welcome to our pages<p>{own}</div><div class=b><p>Kept by us<p>Every page says so</div></body>"
    whole = "<body><div><p>One text<p>two texts<p>three texts<p>four texts</div></body>"
    once = "An article that stands once and is copied by many"
    rows = [(i, "https://a.example/x", page(text(rng, 20))) for i in range(6)] + [(100 + i, "https://a.example/x", page(once)) for i in range(20)]
    rows += [(200 + i, "https://b.example/x", whole) for i in range(8)] + [(300 + i, "https://b.example/x", f"<p>other {i}") for i in range(2)]
    near = [text(rng, 40) for _ in range(6)]
    rows += [(400 + i, "https://c.example/x", "<body><div>" + "".join(f"<p>{n}" for n in near) + f"<p>only {i}</div></body>") for i in range(5)]  # near copies repeat each other
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for held in (1000, 0):
        got = {r.page_id: r.text for r in H.extract_main_text(df, held_copies=held).collect()}
        assert {got[100 + i] for i in range(20)} == {once} and got[0] == rows[0][2].split("<p>")[2].split("</div>")[0]
        assert {got[200 + i] for i in range(8)} == {"One text two texts three texts four texts"} and got[300] == "other 0"
        assert all(got[400 + i] == " ".join([*near, f"only {i}"]) for i in range(5))


def test_long_page():
    page = "<body><article>" + "".join(f"<p>{k} words of a very long page" for k in range(30_000)) + "</article></body>"
    assert len(ruled(page).split()) == 7 * 30_000


def test_registry():
    ten = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert ten == list(range(1, 11)) and set(ORACLES) <= set(QUERIES) and json.dumps(sorted(QUERIES))
