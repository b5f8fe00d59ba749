"""Counts of characters in texts, for whole batches of them at once: one look-up a byte, no regular expressions.

Classes hold ASCII characters only. In UTF-8 a byte under 128 always is such a character, so bytes can be counted for characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 1 << 20  # bytes looked up at once: what a batch takes beyond itself is bounded, also for one long text


def counts(text: Column, classes: dict[str, str], space: str) -> Column:
    """A struct of a long for each class (a name and its characters, eight classes at most), and `words`, the number of runs of
    characters that are not in the class named by `space`. A null text counts as empty."""
    assert len(classes) <= 8 and "".join(classes.values()).isascii()
    table = np.zeros(256, np.uint8)
    for i, characters in enumerate(classes.values()):
        table[[*characters.encode()]] |= 1 << i
    names, gap = [*classes, "words"], 1 << [*classes].index(space)

    def run(texts):
        found = counted(*utf8(texts), table, len(classes), gap)
        return pa.StructArray.from_arrays([pa.array(row) for row in found], names=names)

    return F.arrow_udf(run, ", ".join(f"`{n}` long" for n in names))(F.coalesce(text, F.lit("")))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins, with the end of the last."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8), at.astype(np.int64)


def counted(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, n_classes: int, gap: int) -> np.ndarray:
    """A row for each class and one for words, a column for each text. table: a byte's classes as bits; gap: the bit between words."""
    out, end, before = np.zeros((n_classes + 1, len(offsets) - 1), np.int64), int(offsets[-1]), True
    for a in range(int(offsets[0]), end, BLOCK):
        b = min(a + BLOCK, end)
        kinds = table[data[a:b]]
        # The texts that have bytes in this block, and where they begin and end in it.
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        begins = offsets[first:last]
        edges = np.clip(offsets[first : last + 1], a, b) - a
        between = (kinds & gap) != 0
        after = np.concatenate(([before], between[:-1]))
        after[begins[begins >= a] - a] = True
        for row, mask in zip(out, [*((kinds & (1 << i)) != 0 for i in range(n_classes)), after & ~between], strict=True):
            row[first:last] += np.diff(np.searchsorted(np.flatnonzero(mask), edges))
        before = between[-1]
    return out
