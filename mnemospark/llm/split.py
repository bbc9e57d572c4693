"""Splitting oversized texts at natural boundaries (problem 1)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# From coarse to fine; a cut is made behind a match.
LEVELS = [
    re.compile(r"\n[ \t]*\n[ \t]*\n+|\n(?=#{1,6} )|\n(?=[=\-*_]{3,}[ \t]*\n)"),  # sections
    re.compile(r"\n[ \t]*\n+|\r\n\r\n+"),  # paragraphs
    re.compile(r"\r\n|\n|\r"),  # lines
    re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])"),  # sentences
    re.compile(r"\s+"),  # words
]
PIECE = "start_at int, overlap int, text string"


def _joined(text: str, at: int) -> bool:
    """Whether a character belongs to the one before it: a combining mark or part of a joined sign."""
    return bool(unicodedata.combining(text[at])) or text[at] in "‍️︎" or text[at - 1] == "‍"


def boundaries(text: str) -> list[list[int]]:
    """Per level the places, in order, where a unit of it or of a coarser level ends; the end of the text is one of each."""
    out: list[list[int]] = []
    for pattern in LEVELS:
        ends = {m.end() for m in pattern.finditer(text)} | (set(out[-1]) if out else {len(text)})
        out.append(sorted(e for e in ends if 0 < e <= len(text)))
    return out


def _cut(text: str, ends: list[list[int]], fresh: int, limit: int, overlap: int) -> int:
    """Where the piece ends whose own part begins at `fresh`.

    The coarsest level that has a boundary within the limit decides: as many whole units
    of it as leave room for the overlap, or one that fits with a shorter overlap. Where
    no level has one, the cut falls between characters, if possible not before a
    combining mark.
    """
    room, most = fresh + limit - overlap, fresh + limit
    for level in ends:
        i = bisect_right(level, room) - 1
        if i >= 0 and level[i] > fresh:
            return level[i]
        if i + 1 < len(level) and level[i + 1] <= most:
            return level[i + 1]
    cut = room
    while cut > fresh + max(1, (limit - overlap) // 2) and _joined(text, cut):
        cut -= 1
    return cut


def pieces(text: str, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int, str]]:
    """(start, overlap, piece) for a text over the limit: whole units of the coarsest level that fits are packed greedily, and each piece begins with up to `overlap` characters of the one before.

    The overlap begins behind white space where there is some in its reach, and is
    shorter where a unit needs the room. Joining the pieces without their overlaps gives
    the text again.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, 0, text)]
    ends, out, start, fresh = boundaries(text), [], 0, 0
    while fresh < len(text):
        stop = _cut(text, ends, fresh, limit, overlap if fresh else 0)
        if fresh:
            start = max(out[-1][0] + 1, fresh - min(overlap, limit - (stop - fresh)))
            if start < fresh and not text[start - 1].isspace():
                space = re.compile(r"\s+").search(text, start, fresh)
                if space and space.end() < fresh:
                    start = space.end()
            while start < fresh and _joined(text, start):
                start += 1
        out.append((start, fresh - start, text[start:stop]))
        fresh = stop
    return out


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, piece_no, start_at, overlap, text) of every row whose text is longer than `limit` code points.

    The cut goes by section, paragraph, line, sentence, word and character, in that
    order. Texts up to the limit, empty ones and nulls have no rows. Repeated rows come
    out as often as they go in. Other columns are dropped, so their names can't clash.
    No shuffle: the length test runs in the scan's stage and only long texts go to Python.
    """
    long = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.char_length("_text") > limit)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"start_at": a, "overlap": b, "text": c} for a, b, c in pieces(t, limit, overlap)])

    cut = F.pandas_udf(run, f"array<struct<{PIECE.replace(' int', ': int').replace(' string', ': string')}>>")
    return long.select(F.col("_key").alias(key), F.posexplode(cut("_text")).alias("_no", "_p")).select(key, (F.col("_no") + 1).alias("piece_no"), "_p.start_at", "_p.overlap", "_p.text")
