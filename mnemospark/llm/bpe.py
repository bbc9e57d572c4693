"""Byte-level BPE by a public vocabulary: a segment tree over the ranks of adjacent pairs (problem 8)."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenizer of the vocabulary (a fixed value of its format).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Unicode white space, as the pre-tokenizer sees it (re's own class has four control characters more).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A pre-token never spans the place before the last white-space character ahead of other text,
# so texts can be taken apart there and the parts remembered.
UNIT = re.compile(f"[{_WS}]?[^{_WS}]+|[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]+")
MEMO_BYTES = 96_000_000
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    Leaf i of the tree holds the rank of the pair that token i begins; a node holds the
    least rank below it. Walking down from the root, left first on ties, gives the
    leftmost pair of lowest rank. Merging it changes two leaves and clears one, each in
    logarithmic time. The end is reached when the root holds no rank.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    start, end = list(range(n)), list(range(1, n + 1))  # of the token that begins at leaf i
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def update(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while (least := tree[1]) != NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != least:
                i += 1
        i -= size
        j = after[i]
        end[i] = end[j]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            update(i, get(piece[start[i] : end[k]], NONE))
        else:
            update(i, NONE)
        update(j, NONE)
        if (h := before[i]) >= 0:
            update(h, get(piece[start[h] : end[i]], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[start[i] : end[i]]])
        i = after[i]
    return out


class Units(dict):
    """Remembers the ids of units, and of the pre-tokens in them, as bytes; each half is emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.held, self.pieces_held = ranks, 0, 0
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        one = self.ranks.get(raw)
        got = array("i", merge(raw, self.ranks) if one is None else [one]).tobytes()
        if len(piece) < 200:
            self.pieces_held += 160 + len(got) + len(raw)
            if self.pieces_held > MEMO_BYTES // 2:
                self.pieces.clear()
                self.pieces_held = 0
            self.pieces[piece] = got
        return got

    def __missing__(self, unit: str) -> bytes:
        known, make = self.pieces.get, self.piece
        got = b"".join([known(p) or make(p) for p in PRETOKEN.findall(unit)])
        if len(unit) < 200:
            self.held += 160 + len(got) + 2 * len(unit)
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[unit] = got
        return got


_units: dict[str, Units] = {}


def units_of(path: str) -> Units:
    """One memo per worker process and vocabulary; workers are reused over tasks."""
    if path not in _units:
        _units[path] = Units(load_ranks(path))
    return _units[path]


def encode(text: str | None, units: Units) -> bytes:
    return b"".join(map(units.__getitem__, UNIT.findall(text))) if text else b""


def _encoded(df: DataFrame, keys: list[str], text: str, path: str, schema: str, counts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(path)
        for batch in batches:
            texts, rest = batch.column(len(keys)), batch.columns[: len(keys)]
            for lo in range(0, max(1, batch.num_rows), 256):
                parts = [encode(t.as_py(), units) for t in texts[lo : lo + 256]]
                sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
                if counts:
                    col = pa.array(sizes)
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*(r[lo : lo + 256] for r in rest), col], names=[*keys, "ids" if not counts else "n_tokens"])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.select(*keys).dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def encode_corpus(df: DataFrame, keys: list[str] | None = None, text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(keys, ids) of every row: the token ids of its whole text, without special tokens.

    A null and an empty text each give an empty list; strings that look like special
    tokens are ordinary text. Rows keep their number; other columns are dropped. A
    narrow map over the scan: no shuffle. The vocabulary is read on each worker from
    `path`, which must be there on every executor.
    """
    keys = keys or ["doc_id"]
    return _encoded(df, keys, text, path, _key_schema(df, keys) + ", ids array<int>", counts=False)


def count_tokens(df: DataFrame, keys: list[str] | None = None, text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(keys, n_tokens) of every row: the length of the list that encode_corpus gives."""
    keys = keys or ["doc_id"]
    return _encoded(df, keys, text, path, _key_schema(df, keys) + ", n_tokens bigint", counts=True)
