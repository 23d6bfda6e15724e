"""Where a quote stands in a text, whatever its case and spacing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: marks at a quote's end that don't count.
TRAILING = ".,;:!?"


def folded(text: str) -> tuple[str, np.ndarray]:
    """Case-folded words joined by one blank, and each character's place in the original; blanks around are dropped.

    A blank stands where the white space after the word begins. A letter that folds to several keeps its place in each.
    """
    words, places, end = [], [np.zeros(0, np.int64)], None
    for found in re.finditer(r"\S+", text):
        word = found.group().casefold()
        own = np.arange(found.start(), found.end())
        if len(word) != len(own):
            own = np.repeat(own, [len(c.casefold()) for c in found.group()])
        if end is not None:
            places.append(np.array([end]))
        words.append(word)
        places.append(own)
        end = found.end()
    return " ".join(words), np.concatenate(places)


def locate(text: str, quote: str) -> tuple[int, int, int]:
    """(start, end, occurrences) of the first place, (-1, -1, 0) if there is none or the quote is blank.

    Marks at the quote's end don't count; occurrences don't overlap.
    """
    body, places = folded(text)
    wanted = folded(quote)[0].rstrip(TRAILING)
    if not wanted or (at := body.find(wanted)) < 0:
        return -1, -1, 0
    return int(places[at]), int(places[at + len(wanted) - 1]) + 1, body.count(wanted)


def located(pairs: DataFrame, key: str, text: str, quote: str) -> DataFrame:
    """(key, start, end, occurrences) for quotes in their texts; nulls are found nowhere."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *(locate(t, q) if t is not None and q is not None else (-1, -1, 0))) for k, t, q in zip(batch[key], batch[text], batch[quote])]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "occurrences"])

    return pairs.select(key, text, quote).mapInPandas(run, f"`{key}` {kind}, start int, end int, occurrences int")
