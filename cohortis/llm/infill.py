"""Fill-in-the-middle: texts cut at two unit boundaries and put together anew, found by a table-driven automaton over bytes.

A unit is a run of ASCII letters, or one other code point. The automaton reads classes of bytes; its transitions say where
a unit begins (a continuation byte of UTF-8 begins none) and where a sentinel ends. The first pass counts both, block by
block; the second finds the bytes that two numbers of units end at, in the blocks that hold them.

The automaton is *definite*: what state it is in depends on the last REACH bytes alone (checked when the module is loaded,
by running it from every state). So a block is run as REACH table look-ups of whole arrays, from any state, instead of byte
by byte, and each block gets the state that the one before has ended in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The sentinels, for prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: so many texts are changed, and so many of these have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes that are run through the automaton at once.
BLOCK = 1 << 20

# -- the automaton -----------------------------------------------------------------------------------------------------

_LETTER, _MARK, _OPEN, _CLOSE, _PLAIN, _LEAD, _REST = range(7)  # classes; _MARK: the letters P, S and M
_OTHER, _WORD, _LT, _NAMED, _WIDE = range(5)  # states; _NAMED: after "<" and one of the letters
_BEGINS, _ENDS = 1, 2  # what a transition emits: a unit begins, a sentinel ends


def _classes() -> bytes:
    kind = lambda b: (
        _MARK if chr(b) in "PSM" else _LETTER if chr(b).isascii() and chr(b).isalpha() else _OPEN if b == 0x3C else _CLOSE if b == 0x3E else _PLAIN if b < 0x80 else _REST if b < 0xC0 else _LEAD
    )
    return bytes(map(kind, range(256)))


def _transition(state: int, kind: int) -> tuple[int, int]:
    """The next state, and what is emitted."""
    if kind in (_LETTER, _MARK):
        return _NAMED if kind == _MARK and state == _LT else _WORD, 0 if state in (_WORD, _NAMED) else _BEGINS
    if kind == _REST:
        return _WIDE, 0
    if kind == _CLOSE and state == _NAMED:
        return _OTHER, _BEGINS | _ENDS
    return {_OPEN: _LT, _LEAD: _WIDE}.get(kind, _OTHER), _BEGINS


CLASSES = _classes()
NEXT, EMITS = (np.array([[_transition(s, k)[i] for k in range(8)] for s in range(5)], dtype=np.uint8) for i in (0, 1))


def _after(state: int, kinds: tuple[int, ...]) -> int:
    for k in kinds:
        state = int(NEXT[state, k])
    return state


#: Bytes after which the state no longer depends on where it began.
REACH = next(n for n in range(1, 9) if all(len({_after(s, w) for s in range(5)}) == 1 for w in product(range(7), repeat=n)))
_NEXT, _EMITS = NEXT.ravel(), EMITS.ravel()


def transitions(block: bytes, state: int) -> tuple[np.ndarray, int]:
    """What each byte's transition emits, and the state at the end."""
    kinds = np.frombuffer(block.translate(CLASSES), dtype=np.uint8)
    n = len(kinds)
    before = np.full(n, state, dtype=np.uint8)  # the state that each byte meets
    for back in range(REACH, 0, -1):
        before[back:] = _NEXT[before[back:] << 3 | kinds[: n - back]] if back < n else before[back:]
    # The first bytes of a block depend on the state given.
    for i in range(1, min(REACH, n)):
        before[i] = _NEXT[before[i - 1] << 3 | kinds[i - 1]]
    emitted = _EMITS[before << 3 | kinds]
    return emitted, int(_NEXT[before[-1] << 3 | kinds[-1]]) if n else state


def counted(text: bytes, block: int = BLOCK) -> tuple[list[tuple[int, int]], bool]:
    """First pass: of each block (the state it begins in, the units that begin in it), and whether a sentinel is in the text."""
    blocks, state, marked = [], _OTHER, False
    for at in range(0, len(text), block):
        emitted, after = transitions(text[at : at + block], state)
        blocks.append((state, int(np.count_nonzero(emitted & _BEGINS))))
        marked = marked or bool((emitted & _ENDS).any())
        state = after
    return blocks, marked


def located(text: bytes, blocks: list[tuple[int, int]], units: int, block: int = BLOCK) -> int:
    """Second pass: the byte that so many units end at."""
    seen = 0
    for i, (state, n) in enumerate(blocks):
        if seen + n > units:
            emitted, _ = transitions(text[i * block : (i + 1) * block], state)
            return i * block + int(np.flatnonzero(emitted & _BEGINS)[units - seen])
        seen += n
    return len(text)


def _chars(raw: bytes) -> int:
    """Code points: bytes that don't continue one."""
    return int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80))


def arranged(text: bytes, draws: tuple[int, int, int, int], changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text. draws: four whole numbers that decide the cuts and the form."""
    blocks, marked = counted(text, block)
    n = sum(units for _, units in blocks)
    if not n or marked or draws[2] % 100 >= changed:
        return n, "plain", None, None, text
    a, b = (located(text, blocks, units, block) for units in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if draws[3] % 100 < suffix_first:
        return n, "spm", _chars(prefix), _chars(middle), b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", _chars(prefix), _chars(middle), b"".join([p, prefix, s, suffix, m, middle])


# -- over tables -------------------------------------------------------------------------------------------------------


def draws(doc_id: Column, epoch: int = 1) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of `<epoch>:<doc_id>`, as longs. Without an id: of `<epoch>:`."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output of every row.

    epoch: another one cuts the same documents elsewhere. A null text counts as empty, and an empty one is plain, as is a text
    with a sentinel in it. Rows that repeat an id have the same draws, rows without an id those of `<epoch>:`; very long texts
    are read in blocks; other columns are ignored; an empty table gives an empty result. No shuffle: each row by itself.
    """
    common.ship(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.stack([batch.column(i).to_numpy() for i in range(2, 6)], axis=1).tolist()
            texts = common.text_bytes(batch.column(1))
            for begin, end in common.slices(texts, 4 * BLOCK):
                made = [arranged(texts[i], tuple(hashes[i]), changed, suffix_first) for i in range(begin, end)]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *columns], names)
            common.tidy(thorough=False)
        common.tidy()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *draws(F.col(id_col), epoch))
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields]
    return rows.mapInArrow(run, T.StructType(fields))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. A text with a sentinel is plain, so the sentinels part the others."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    in_order = lambda *at: F.concat(*[F.get(parts, F.lit(i)) for i in at])
    return F.when(form == "psm", in_order(1, 3, 2)).when(form == "spm", in_order(2, 3, 1)).otherwise(output)
