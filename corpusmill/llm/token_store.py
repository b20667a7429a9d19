"""Token ids in a content-addressed store.

A rolling hash over `window` ids cuts each document's id stream where it is
divisible by `average` (no chunk is shorter than average / 8 or longer than
8 * average, a document's last chunk apart), so equal passages give equal chunks
wherever they stand. A chunk is named by the SHA-256 of its ids as little-endian
unsigned 32-bit integers and stored once.

Layout, all Parquet:
  data/kind=chunk   hash, n, payload (zstd over the ids as unsigned 16- or 32-bit integers)
  recipes           part, doc_id, n, root, hashes; ranges of ascending doc_id, sorted
  manifest          part, first_doc, last_doc, n_docs, n_ids, root
A document's root is the Merkle root over its chunk hashes; a part's root hashes
its documents' roots in order. `verify` reads the files, checks every chunk
against its name and every recipe against its root, and returns a digest of each
document; `restore` returns the ids.

Encoding happens once. One shuffle moves chunks, after equal ones have been
combined within each task, so hot passages stay cheap. Reading back moves hashes
and lengths only: checksums of chunks are joined to checksums of documents.

Nulls: a null text counts as empty (just the end id); rows with a null doc_id are
left out. Repeated rows are separate documents, one after the other.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.blocks import release
from corpusmill.llm.words import rolling

#: Parts of texts whose ids a Python worker keeps; it bounds memory and changes no result.
CACHE = 200_000
#: Bytes of text that are encoded at once; a longer text is encoded alone.
SLICE = 8 << 20
_SPACE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that go to the library whole: white space at an end or beside other white space, NUL, and characters whose class
#: (letter, number or other) hasn't been the same in all versions of Unicode.
_ODD = rf"^[{_SPACE}]|[{_SPACE}][{_SPACE}]|[{_SPACE}]$|[^\x01-\x{{220}}\x{{222}}-\x{{233}}\x{{391}}-\x{{3a1}}\x{{3a3}}-\x{{3ce}}\x{{401}}-\x{{44f}}\x{{451}}-\x{{45c}}\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{2046}}\x{{20ac}}\x{{3001}}-\x{{3003}}\x{{3041}}-\x{{3094}}\x{{30a1}}-\x{{30fa}}\x{{4e00}}-\x{{9fa5}}\x{{ac00}}-\x{{d7a3}}\x{{ff01}}-\x{{ff5e}}]"
#: Fixed value: how byte-level vocabularies of this kind split a text in which white space stands alone.
_PART = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: How byte-level vocabularies write bytes: printable ones of Latin-1 as themselves, the others, in order, from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_encoders: dict[str, "Encoder"] = {}


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is a range of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin = 0
    while begin < len(size):
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + most, "right")))
        yield begin, end
        begin = end


class Encoder:
    """Byte-level BPE of the tokenizers library over many texts at once.

    The library splits a text into parts and then merges within each part. Where
    it splits in the usual way, the splitting is done here for a whole slice of
    texts, and each distinct part goes to the library's merges once. Texts that
    could be split in another way or hold a special token go to the library
    whole, and so does everything where it splits or normalises differently.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.direct = repr(self.library.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in repr(self.library.pre_tokenizer) and self.library.normalizer is None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype, self.code = ("<u2", "H") if self.library.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, which begin with U+0120 in place of a space."""
        known, merge, code, out = self.known, self.library.model.tokenize, self.code, []
        if len(known) > CACHE:
            known.clear()
        get, keep = known.get, out.append
        for p in parts:
            ids = get(p)
            if ids is None:
                if (p if p[:1] != "\u0120" else p[1:]).isascii() and p.isprintable():
                    letters = p
                elif p[:1] == "\u0120":
                    letters = "\u0120" + p[1:].encode().decode("latin-1").translate(_BYTE_LETTERS)
                else:
                    letters = p.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = known[p] = array(code, [t.id for t in merge(letters)]).tobytes()
            keep(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each text has); texts are strings, not null."""
        width = np.dtype(self.dtype).itemsize
        if not self.direct:
            found = self._library(texts.to_pylist())
            return np.frombuffer(b"".join(found), self.dtype), np.array([len(f) for f in found], np.int64) // width
        whole = pc.match_substring_regex(texts, _ODD)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        split = pc.split_pattern(pc.replace_substring_regex(pc.if_else(whole, "", texts), _PART, "\\0\0"), "\0")
        coded = split.flatten().dictionary_encode()
        names = pc.replace_substring(coded.dictionary, " ", "\u0120")
        ids = self._parts(pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), "\0")[0].as_py().split("\0") if len(names) else [])
        size = np.array([len(x) for x in ids], np.int32) // width
        flat, start = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size, dtype=np.int32) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n, dtype=np.int64)
        out = flat[np.repeat((start[which] - ends + n).astype(np.int32), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        offsets = split.offsets.to_numpy().astype(np.int64)
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        counts = np.diff(bounds)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            pieces, at = [], 0
            for i, found in zip(odd.tolist(), self._library(texts.take(pa.array(odd)).to_pylist()), strict=True):
                own = np.frombuffer(found, self.dtype)
                pieces += [out[at : bounds[i]], own]
                at, counts[i] = bounds[i + 1], len(own)
            out = np.concatenate([*pieces, out[at:]])
        return out, counts


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_marks(ids: np.ndarray, average: int = 1024, window: int = 16) -> np.ndarray:
    """Ends of the windows of ids whose rolling hash is divisible by average."""
    found, step = [np.zeros(0, np.int64)], 1 << 19
    for a in range(0, len(ids) - window + 1, step):
        found.append(np.flatnonzero(rolling(ids[a : a + step + window - 1].astype(np.uint64), window) % np.uint64(average) == 0) + (window + a))
    return np.concatenate(found)


def cuts(n: int, marks: list[int], average: int = 1024) -> list[int]:
    """Ends of the chunks of a stream of n ids with these marks."""
    least, most = max(1, average // 8), average * 8
    ends, at = [], 0
    for c in marks:
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least:
            ends.append(c)
            at = c
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def merkle(hashes: list[bytes]) -> bytes:
    """Root over leaf hashes; an odd one moves up as it is."""
    level = hashes or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# crc32 of a joined stream from those of its parts, over GF(2)
_POLY = np.uint32(0xEDB88320)
_ONE = np.uint32(1 << 31)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the CRC's, bits reflected."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _shift(n_bytes: np.ndarray) -> np.ndarray:
    """x^(8 n) modulo the CRC polynomial."""
    out, base, n = np.full(len(n_bytes), _ONE), np.array([1 << 23], np.uint32), n_bytes.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), _times(out, base), out)
        base, n = _times(base, base), n >> np.uint64(1)
    return out


def join_crcs(crcs: list[list[int]], sizes: list[list[int]]) -> np.ndarray:
    """crc32 of each stream, from those of its parts and their sizes in bytes."""
    count = np.array([len(c) for c in crcs], np.int64)
    first = np.cumsum(count) - count
    part = np.array([x for c in crcs for x in c], np.uint32)
    size, which = np.unique(np.array([x for n in sizes for x in n], np.int64), return_inverse=True)
    shift = _shift(size)[which]  # a few thousand sizes at most
    out = np.zeros(len(crcs), np.uint32)
    for k in range(int(count.max(initial=0))):
        at = np.flatnonzero(count > k)
        i = first[at] + k
        out[at] = _times(shift[i], out[at]) ^ part[i]
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, average: int = 1024, window: int = 16, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encodes docs and writes a new store under path."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            every = pc.fill_null(batch.column(1).cast(pa.string()), "")
            for a, b in text_slices(every, SLICE):
                chunks: dict[bytes, tuple[int, bytes]] = {}
                recipes = []
                found, counts = enc.encode(every.slice(a, b - a))
                stream = np.insert(found, np.cumsum(counts), np.array(end_id, found.dtype))
                ends = np.cumsum(counts + 1)
                wide, marks = stream.astype("<u4"), cut_marks(stream, average, window)
                own = np.searchsorted(marks, np.concatenate([[0], ends]), "right")
                first = np.searchsorted(marks, ends - counts - 1 + window)  # windows that lie within the document
                for i, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    to, begin = int(ends[i]), int(ends[i] - counts[i] - 1)
                    names, at = [], begin
                    for c in cuts(to - begin, (marks[first[i] : own[i + 1]] - begin).tolist(), average):
                        name = hashlib.sha256(wide[at : begin + c].data).digest()
                        if name not in chunks:
                            chunks[name] = (begin + c - at, squeeze.compress(stream[at : begin + c].data))
                        names.append(name)
                        at = begin + c
                    row += 1
                    recipes.append((doc, f"{task:012d}:{row:012d}".encode(), to - begin, merkle(names), b"".join(names)))
                n, m = len(chunks), len(recipes)
                yield pa.record_batch(
                    [
                        pa.array(["chunk"] * n + ["recipe"] * m),
                        pa.array([*chunks, *(r[1] for r in recipes)], pa.binary()),
                        pa.array([None] * n + [r[0] for r in recipes], pa.int64()),
                        pa.array([*(c[0] for c in chunks.values()), *(r[2] for r in recipes)], pa.int64()),
                        pa.array([None] * n + [r[3] for r in recipes], pa.binary()),
                        pa.array([*(c[1] for c in chunks.values()), *(r[4] for r in recipes)], pa.binary()),
                    ],
                    ["kind", "hash", "doc_id", "n", "root", "payload"],
                )
        release()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    rows = own.mapInArrow(run, "kind string, hash binary, doc_id bigint, n bigint, root binary, payload binary")
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("kind", "hash").orderBy(F.lit(0)))).filter("__rn = 1").drop("__rn")
    first.write.partitionBy("kind").parquet(f"{path}/data")
    recipes = _rows(spark, path, "recipe").select("doc_id", F.col("hash").alias("row"), "n", "root", F.col("payload").alias("hashes"))
    order = [F.col("doc_id"), F.col("row")]
    ranged = recipes.repartitionByRange(parts, *order) if parts else recipes.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "*").write.parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "row", "root"))), lambda x: F.hex(x["root"]))
    written.groupBy("part").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n").alias("n_ids"), F.sha2(F.array_join(listed, ""), 256).alias("root")
    ).write.parquet(f"{path}/manifest")


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one kind; only its folder is read, and it may be missing."""
    schema = "hash binary, doc_id bigint, n bigint, root binary, payload binary, kind string"
    return spark.read.schema(schema).parquet(f"{path}/data").filter(F.col("kind") == kind)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "chunk").select("hash", "n", "payload")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document."""
    recipes = spark.read.parquet(f"{path}/recipes")
    return recipes.select("part", "doc_id", "row", "root", F.expr("posexplode(transform(sequence(0, length(hashes) div 32 - 1), i -> substring(hashes, i * 32 + 1, 32)))").alias("at", "hash"))


def _dtype(payload: bytes, n: int) -> str:
    return "<u2" if len(payload) == 2 * n else "<u4"


def verify(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and verified, from the files alone."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            crcs, sound = [], []
            for name, n, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = reader.decompress(payload)
                ids = np.frombuffer(raw, _dtype(raw, n)).astype("<u4").tobytes()
                crcs.append(zlib.crc32(ids))
                sound.append(hashlib.sha256(ids).digest() == name)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), pa.array(sound, pa.bool_())], ["hash", "n", "crc", "sound"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, names, sizes, crcs, sound = (batch.column(i).to_pylist() for i in range(3, 8))
            joined = join_crcs([[c or 0 for c in x] for x in crcs], [[4 * (n or 0) for n in x] for x in sizes])
            fine = [all(x) and merkle(h) == r for x, h, r in zip(sound, names, root, strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([sum(n or 0 for n in x) for x in sizes], pa.int64()), pa.array(joined.astype(np.int64)), pa.array(fine, pa.bool_())],
                ["part", "doc_id", "row", "n_tokens", "ids_crc32", "verified"],
            )

    read = _chunks(spark, path).mapInArrow(digests, "hash binary, n bigint, crc bigint, sound boolean")
    joined = _entries(spark, path).join(read, "hash", "left")
    grouped = joined.groupBy("part", "doc_id", "row", "root").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "n", "crc", "sound"))).alias("items"))
    lists = grouped.select("part", "doc_id", "row", "root", *[F.col(f"items.{c}").alias(c) for c in ("hash", "n", "crc", "sound")])
    docs = lists.mapInArrow(documents, "part int, doc_id bigint, row binary, n_tokens bigint, ids_crc32 bigint, verified boolean")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = spark.read.parquet(f"{path}/manifest").select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("__base") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).alias("start"), "n_tokens", "ids_crc32", "verified")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids): the id stream of each document, rebuilt from its recipe."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for items in batch.column(1).to_pylist():
                raw = [(reader.decompress(i["payload"]), i["n"]) for i in sorted(items, key=lambda i: i["at"])]
                out.append(np.concatenate([np.frombuffer(r, _dtype(r, n)).astype(np.int64) for r, n in raw]))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    joined = _entries(spark, path).join(_chunks(spark, path), "hash")
    grouped = joined.groupBy("part", "doc_id", "row").agg(F.collect_list(F.struct("at", "n", "payload")).alias("items"))
    return grouped.select("doc_id", "items").mapInArrow(rebuild, "doc_id bigint, ids array<bigint>")
