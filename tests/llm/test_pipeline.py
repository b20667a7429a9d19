"""The pipeline against a brute-force version of each stage, with repeated ids, nulls and copies."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline as CP
from corpusmill.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(300)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def quality(rows):
    kept = []
    lines = {}
    norm = lambda line: " ".join(line.split()).lower()
    for _, text, _, source, _ in rows:
        own = frozenset(norm(x) for x in (text or "").split("\n") if norm(x))
        for x in own:
            lines.setdefault((source, x), set()).add(own)
    for i, text, lang, source, _ in rows:
        text = text or ""
        w = text.split()
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = {}
        for x in runs:
            seen[x] = seen.get(x, 0) + 1
        repeated = len({k + d for k, x in enumerate(runs) if seen[x] > 1 for d in range(3)})
        gone = [x for x in text.split("\n") if norm(x) and len(lines[source, norm(x)]) > 100]
        lost = sum(len(x.split()) for x in gone)
        if len(w) < 50 or 100 * repeated > 50 * len(w) or lost > 0.5 * len(w):
            continue
        clean = "\n".join(x for x in text.split("\n") if not (norm(x) and len(lines[source, norm(x)]) > 100)) if gone else text
        kept.append((i, clean, lang, source, len(clean)))
    return kept


def simhash(text):
    w = text.lower().split()
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    bits = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        bits += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def near(rows):
    prints = [simhash(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    best = {}
    for k, r in enumerate(rows):
        g, key = find(k), (r[0] is None, r[0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, r)
    return [r for _, r in best.values()]


def substrings(rows):
    order = lambda r: -(1 << 63) if r[0] is None else r[0]
    first = {}
    for r in rows:
        w = r[1].split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (order(r), k)), (order(r), k))
    out = []
    for r in rows:
        w = r[1].split()
        gone = {k + d for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (order(r), k) for d in range(20)}
        out.append((r[0], [x for k, x in enumerate(w) if k not in gone], r[2], r[3]))
    return out


def edits(a, b):
    row = [0] * (len(b) + 1)  # a match may begin anywhere in b
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def clean(rows, items):
    return [r for r in rows if not any(t.split() and edits(t.split(), r[1]) <= int(0.15 * len(t.split())) for _, t in items if t)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(11)
    rows = []
    texts = [prose(rng, rng.randrange(80, 160)) for _ in range(30)]
    passage = prose(rng, 40)
    items = [(1, prose(rng, 24)), (2, prose(rng, 40)), (3, None), (4, "")]
    for i, t in enumerate(texts):
        if i % 5 == 0:
            t = t + "\n" + passage
        if i == 7:
            t = t + " " + items[0][1]
        if i == 8:
            w = items[1][1].split()
            w[3], w[20] = "other", "words"
            t = " ".join(w) + " " + t
        rows.append((i, t, "en", "s", len(t)))
    rows += [(50 + i, texts[3], "en", "s", 1) for i in range(4)] + [(60, texts[4] + " one more", "de", "s", 1)]  # copies and a near copy
    rows += [rows[2], rows[2], (2, prose(rng, 90), "en", "s", 1), (70, texts[5], "en", "s", 1), (70, prose(rng, 90), "en", "s", 1)]  # repeated rows and ids
    rows += [(None, prose(rng, 90), None, None, None), (None, items[1][1] + " " + prose(rng, 60), "en", "s", 1), (80, None, "en", "s", None), (81, "", "en", "s", 0), (82, prose(rng, 3000), "fr", "s", 1)]
    for i in range(120):  # a host with a header and a footer on each page
        own = prose(rng, 60 if i % 2 else 20)
        rows.append((1000 + i, f"The  Header of the site and all its words here\n{own}\nthe footer line with {' '.join(WORDS[:24])}", "en", "host", 1))
    where = tmp_path_factory.mktemp("tables")
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in rows], kinds), where / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items])}), where / "benchmark.parquet")
    return str(where), rows, items


def test_stages(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tidy = lambda found: sorted(found, key=lambda r: json.dumps(r[:4]))
    got = docs
    for (name, stage), brute in zip(CP.STAGES[:2], (quality, near), strict=True):
        before = [tuple(r) for r in got.select(*COLUMNS).collect()]
        got = CP.materialize(stage(spark, got, folder), "test")
        assert got.columns == COLUMNS
        found, want = [tuple(r) for r in got.collect()], brute(before)
        assert tidy(found) == tidy(want), name
    assert got.count() < len(rows)
    before = [tuple(r) for r in got.collect()]
    got = CP.materialize(CP.substring_stage(spark, got, folder), "test")
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert sorted((str(r.doc_id), r.text.split()) for r in got.collect()) == sorted((str(i), w) for i, w, *_ in substrings(before))
    before = [(r.doc_id, r.text.split()) for r in got.collect()]
    got = CP.materialize(CP.benchmark_stage(spark, got, folder), "test")
    kept = clean(before, items)
    assert sorted((str(r.doc_id), r.text.split()) for r in got.collect()) == sorted((str(i), w) for i, w in kept) and len(kept) < len(before)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in CP.sentencepiece_stage(spark, got, folder).join(got.select("doc_id", "text"), "doc_id").collect():
        ids = sp.encode(r.text)
        if r.ids == ids:
            assert r.n_pieces == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.round_trip
        else:  # a repeated id joins each text
            assert r.doc_id in (2, 70)


def test_run_and_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    assert 0 < CP.run(spark, folder).count() < len(tables[1])
    for name in ("documents", "benchmark"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert CP.run(spark, str(tmp_path)).count() == 0
