"""SentencePiece encoding and decoding with a shared-prefix Viterbi pass.

Texts are cut into marked words (a word with its leading space marks), which
encode independently: the loader checks that no piece of the vocabulary holds a
space mark behind another character. The distinct words of a slice of texts are
sorted, which lays out their trie in depth-first order; the forward state of
each prefix is kept on a stack and reused by all words that share it.

Forward state. For unigram models it is the best score and last piece of a
prefix. For BPE models it is the last piece of the prefix's encoding: by BPE's
prefix property, dropping the last pieces of an encoding leaves the encoding of
the shorter text, so a prefix has exactly one last piece, the one that is
compatible with the state in front of it (the two, joined and encoded, come out
as these two). So both kinds give what the library gives, which tests check.

Characters outside the vocabulary become byte pieces. Encodings of recent words
are kept in a table of at most `CACHE` words, which bounds memory and doesn't
change results. Files are read by path on each executor.

Nulls: a null text has null ids and decodes to null; the empty text has none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import release
from corpusmill.llm.words import slices

CACHE = 300_000
MARK = "▁"
_RUN = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")
_codecs: dict[str, "Codec"] = {}


def _fields(data: bytes) -> dict[int, list]:
    """Fields of a protobuf message by number; nested messages stay bytes."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


class Codec:
    """Pieces of a model file and the tables that encoding and decoding use."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = _fields(sp.serialized_model_proto())
        trainer, norm = _fields(model[2][0]), _fields(model.get(3, [b""])[0])
        self.bpe = trainer.get(3, [1])[-1] == 2
        if norm.get(2, [b""])[-1] or norm.get(4, [1])[-1] or not norm.get(3, [1])[-1] or not norm.get(5, [1])[-1]:
            raise ValueError("the model normalises texts in a way that this codec doesn't know")
        n = sp.get_piece_size()
        self.byte = {}
        self.pieces: dict[str, int] = {}
        self.score = [sp.get_score(i) for i in range(n)]
        self.output = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.output[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = i
                self.output[i] = piece.replace(MARK, " ").encode()
                if MARK in piece.lstrip(MARK) or "\n" in piece or " " in piece:
                    raise ValueError("a piece of the vocabulary joins words")
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.pieces))
        self.text = {i: p for p, i in self.pieces.items()}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merges(self, text: str) -> list[str]:
        """BPE by definition: join the best-scored adjacent pair, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.pieces.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            x, y = self.text[a], self.text[b]
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merges(x + y) == [x, y]
        return known

    def learn(self, words: list[str]) -> None:
        """Encodes sorted words into the table; each prefix is worked out once."""
        pieces, longest, score, bpe, pairs, compatible = self.pieces, self.longest, self.score, self.bpe, self.pairs, self.compatible
        last, back, total = [-1], [0], [0.0]  # per prefix: last piece (-2: none fits), where it begins, score
        before = ""
        for key in words:
            word = key.replace(" ", MARK) if key[:1] in " \n" and key else MARK + key
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                piece, start, value = -2, end - 1, -1e18
                for at in range(max(0, end - longest), end):
                    k = pieces.get(word[at:end])
                    if k is None:
                        continue
                    if bpe:
                        front = last[at]
                        if front >= 0:
                            fits = pairs.get(front << 32 | k)
                            if fits is None:
                                fits = compatible(front, k)
                            if not fits:
                                continue
                        piece, start = k, at
                        break
                    if total[at] + score[k] > value:
                        piece, start, value = k, at, total[at] + score[k]
                last.append(piece)
                back.append(start)
                total.append(value if piece >= 0 else total[end - 1] - 1e4)
            ids, end = [], len(word)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids += [self.byte[b] for b in reversed(word[end - 1].encode())]
                end = back[end]
            self.words[key] = np.array(ids[::-1], "<u4").tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            marked = t.replace("\n", " \n")
            split.append(marked.split(" ") if marked and "  " not in marked and marked[0] != " " and marked[-1] != " " else _RUN.findall(" " + t) if t else [])
        known = self.words
        new = set().union(*split).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set().union(*split)
        self.learn(sorted(new))
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        get = self.output.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).removeprefix(b" ")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs plus `ids` (array of int, unless keep_ids is off), n_pieces, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) and round_trip: whether the decoded ids are the text."""
    added = [*(["ids"] if keep_ids else []), "n_pieces", "ids_crc32", "round_trip"]
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added or c == text_col], F.col(text_col).cast("string").alias("__text"))
    names = own.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for a, b in slices([t or "" for t in texts]):
                part = texts[a:b]
                ids = c.encode([t or "" for t in part])
                null = [t is None for t in part]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                if keep_ids:
                    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    mask = pa.array([*null, False]) if any(null) else None
                    starts = pa.array(offsets, pa.int32()) if mask is None else pa.array([None if n else int(o) for n, o in zip([*null, False], offsets, strict=True)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                columns.append(pa.array([None if n else len(x) // 4 for n, x in zip(null, ids, strict=True)], pa.int64()))
                columns.append(pa.array([None if n else zlib.crc32(x) for n, x in zip(null, ids, strict=True)], pa.int64()))
                columns.append(pa.array([None if t is None else c.decode(x) == t.encode() for t, x in zip(part, ids, strict=True)], pa.bool_()))
                yield pa.record_batch(columns, [*names, *added])
        release()

    kinds = {"ids": "array<int>", "n_pieces": "bigint", "ids_crc32": "bigint", "round_trip": "boolean"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]), *(f"{n} {kinds[n]}" for n in added)])
    return own.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df plus the text of its ids; bytes that are no UTF-8 become U+FFFD."""
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            out = [None if x is None else c.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, out_col])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{out_col} string"]))
