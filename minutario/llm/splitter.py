"""Splitting oversized texts at natural boundaries (problem 4): recursive separators, greedy packing, overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LIMIT, OVERLAP = 1200, 200

#: From coarse to fine. A separator stays with the text before it; what is still too long goes to the next level.
_SEPARATORS = (
    re.compile(r"(?:\r\n|\r|\n)(?=#{1,6} )|(?:(?:\r\n|\r|\n)[ \t]*){3,}"),  # section
    re.compile(r"(?:(?:\r\n|\r|\n)[ \t]*){2,}"),  # paragraph
    re.compile(r"[\r\n]+"),  # line
    re.compile(r"(?<=[.!?…])[\"')\]»”]*[ \t\r\n]+"),  # sentence
    re.compile(r"[ \t\r\n]+"),  # word
)
_BLANK = " \t\r\n"


def _atoms(text: str, start: int, end: int, level: int, limit: int) -> Iterator[tuple[int, int, bool]]:
    """Spans of at most limit characters that cover [start, end) in order; True where one ends inside a long stretch."""
    if end - start <= limit:
        if end > start:
            yield start, end, False
        return
    if level < len(_SEPARATORS):
        at = start
        for m in _SEPARATORS[level].finditer(text, start, end):
            cut = m.end()
            if level == len(_SEPARATORS) - 1 and cut - at > limit and m.start() > at:
                # The word fits but not with its blanks: they go apart.
                yield from _atoms(text, at, m.start(), level + 1, limit)
                at = m.start()
            yield from _atoms(text, at, cut, level + 1, limit)
            at = cut
        yield from _atoms(text, at, end, level + 1, limit)
        return
    blank = text[start] in _BLANK
    for at in range(start, end, limit):
        stop = min(at + limit, end)
        yield at, stop, stop < end and not blank


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """Pieces (start, end, forced) of at most limit characters that cover the whole text in order.

    Consecutive pieces share up to `overlap` characters, begun at a word's start where one is in reach; forced marks a
    piece that ends inside a stretch without blanks, tabs or line ends that is itself longer than the limit. A text
    within the limit, empty or not, is one piece.
    """
    if len(text) <= limit:
        return [(0, len(text), False)]
    pieces: list[tuple[int, int, bool]] = []
    start = end = 0
    hard = False
    for at, stop, cut in _atoms(text, 0, len(text), 0, limit):
        if stop - start > limit:
            pieces.append((start, end, hard))
            start = _resume(text, max(start + 1, end - overlap, stop - limit), end)
        end, hard = stop, cut
    pieces.append((start, end, hard))
    return pieces


def _resume(text: str, least: int, end: int) -> int:
    """The first word's start in [least, end), else end: then the pieces share nothing."""
    for at in range(least, end):
        if text[at] not in _BLANK and (at == 0 or text[at - 1] in _BLANK):
            return at
    return end


def split_pieces(chunks: DataFrame, key: str, text: str = "text", start: str = "char_start", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text: (key, piece, n_chars, from_char, to_char, char_start, char_end, forced, text).

    n_chars is the whole text's length; from_char and to_char count in the text, char_start and char_end in the source
    when the chunk's own start is known, else they are null. Null texts give no piece, empty ones a piece of no
    length. One pass without a shuffle, a batch of texts at a time.
    """
    key_type = chunks.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, piece int, n_chars int, from_char int, to_char int, char_start int, char_end int, forced boolean, text string"
    given = chunks.select(key, text, start)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, s in zip(batch[key], batch[text], batch[start]):
                if t is None:
                    continue
                base = None if s is None or s != s else int(s)
                for n, (a, b, forced) in enumerate(split_text(t, limit, overlap)):
                    rows.append((k, n, len(t), a, b, None if base is None else base + a, None if base is None else base + b, forced, t[a:b]))
            frame = pd.DataFrame(rows, columns=[key, "piece", "n_chars", "from_char", "to_char", "char_start", "char_end", "forced", "text"])
            yield frame.astype({"char_start": "Int32", "char_end": "Int32"})

    return given.mapInPandas(pieces, schema)
