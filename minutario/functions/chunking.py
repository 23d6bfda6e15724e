"""Chunks of bounded size with overlap, cut at the coarsest separator that the text has."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

SEPARATORS = ("\n\n", "\n", " ", "")


Span = tuple[int, int]


def _cut(text: str, span: Span, separator: str) -> list[Span]:
    """Parts that each begin with the separator before them; single characters for the empty separator."""
    start, end = span
    if not separator:
        return [(i, i + 1) for i in range(start, end)]
    marks = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        marks.append(at)
        at = text.find(separator, at + len(separator), end)
    return [(a, b) for a, b in zip(marks, [*marks[1:], end]) if b > a]


def _packed(parts: Sequence[Span], size: int, overlap: int) -> Iterator[Span]:
    """Adjoining parts joined while they fit; a new chunk starts with the last parts that make up at most the overlap."""
    first = 0
    for n, (start, end) in enumerate(parts):
        if n > first and end - parts[first][0] > size:
            yield parts[first][0], start
            while first < n and (start - parts[first][0] > overlap or end - parts[first][0] > size):
                first += 1
    if parts:
        yield parts[first][0], parts[-1][1]


def _pieces(text: str, span: Span, size: int, overlap: int, separators: Sequence[str]) -> Iterator[Span]:
    at = next((i for i, s in enumerate(separators) if s == "" or text.find(s, *span) >= 0), len(separators) - 1)
    small: list[Span] = []
    for part in _cut(text, span, separators[at]):
        if part[1] - part[0] < size or at == len(separators) - 1:
            small.append(part)
            continue
        yield from _packed(small, size, overlap)
        small = []
        yield from _pieces(text, part, size, overlap, separators[at + 1 :])
    yield from _packed(small, size, overlap)


def chunk(text: str, size: int, overlap: int = 0) -> list[tuple[int, str]]:
    """(start, text) of chunks of at most size characters without the white space around them; blank chunks are left out."""
    out = []
    for start, end in _pieces(text, (0, len(text)), size, overlap, SEPARATORS):
        piece = text[start:end]
        bare = piece.strip()
        if bare:
            out.append((start + len(piece) - len(piece.lstrip()), bare))
    return out


def chunked(documents: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """(chunk_id, key, char_start, char_end, text) with ids KEY.c000 ...; null texts have no chunks."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{k}.c{n:03d}", k, a, a + len(c), c) for k, t in zip(batch[key], batch[text]) if t is not None for n, (a, c) in enumerate(chunk(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["chunk_id", key, "char_start", "char_end", "text"])

    return documents.select(key, text).mapInPandas(run, f"chunk_id string, `{key}` {kind}, char_start int, char_end int, text string")
