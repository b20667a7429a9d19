"""Token counts by section, from one encoding of each whole document.

A document is encoded once with tiktoken. The byte lengths of its tokens give
their offsets; sections come as character spans that don't overlap. Tokens and
sections, both in order, are interval-joined by binary search.

Rule for tokens that cross a boundary: a token belongs to the section that holds
most of its bytes, at a tie to the earlier one. A token that touches no section
counts for section -1. So the counts of a document's sections add up to its
tokens. (Cutting first and encoding the parts would give other tokens and sums.)

Nulls: a null text has no rows; an empty section has a row with zero tokens; null
spans are left out. Repeated rows have their rows each. Of the input only the id
appears in the result, so no names clash. Whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict[str, tuple] = {}


def encoding(path: str) -> tuple:
    """The encoding in a rank file, and the byte length of each token."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            sizes[k] = len(token)
        _encodings[path] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _encodings[path]


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary). ends: byte ends of the tokens; starts, stops: sections in order."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(stops, begins, "right")
    last = np.searchsorted(starts, ends, "left") - 1
    out = np.where(first <= last, first, -1)
    crossing = np.zeros(len(ends), bool)
    at = np.flatnonzero(first <= last)
    a, b = first[at], last[at]
    crossing[at] = (a < b) | (starts[a] > begins[at]) | (stops[b] < ends[at])
    for i in np.flatnonzero(crossing):
        a, b = int(first[i]), int(last[i])
        held = np.minimum(ends[i], stops[a : b + 1]) - np.maximum(begins[i], starts[a : b + 1])
        out[i] = a + int(np.argmax(held)) if held.max() > 0 else -1
    return out, crossing


def line_sections(text: str) -> list[tuple[int, int]]:
    """Lines with their line feeds: a partition of the text into character spans."""
    out, at = [], 0
    while (to := text.find("\n", at)) >= 0:
        out.append((at, to + 1))
        at = to + 1
    if at < len(text):
        out.append((at, len(text)))
    return out


def section_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing). spans_col holds an array of (start, end)
    character spans in order; without it, sections are lines."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(spans_col).alias("spans")] if spans_col else [])).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(ranks_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            spans = batch.column(2).to_pylist() if spans_col else None
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                cut = line_sections(text) if spans is None else [tuple(x.values()) for x in spans[k] or [] if x is not None]
                at = np.array(cut, np.int64).reshape(-1, 2)
                if (at[:, 0] > at[:, 1]).any() or (at[1:, 0] < at[:-1, 1]).any():
                    raise ValueError("sections must be in order and must not overlap")
                data = text.encode()
                if len(data) == len(text):
                    places = at
                else:
                    heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                    places = np.append(heads, len(data))[np.minimum(at, len(text))]
                ends = np.cumsum(sizes[enc.encode_ordinary(text)]) if text else np.zeros(0, np.int64)
                section, crossing = attribute(ends, places[:, 0], places[:, 1])
                n = np.bincount(section + 1, minlength=len(at) + 1)
                c = np.bincount(section[crossing] + 1, minlength=len(at) + 1)
                begin = 1 - int(n[0] > 0)  # section -1 has a row only where it has tokens
                for column, values in zip(out, ([doc] * (len(at) + 1), range(-1, len(at)), [None, *at[:, 0].tolist()], [None, *at[:, 1].tolist()], n.tolist(), c.tolist()), strict=True):
                    column.extend(values[begin:])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return own.mapInArrow(run, "doc_id bigint, section bigint, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint")
