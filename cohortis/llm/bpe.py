"""BPE encoding and decoding with a minimal acyclic transducer of the frequent words.

The corpus' frequent words are compiled into a minimal deterministic acyclic automaton: equal suffixes share states,
and each transition carries how many words sort before those that take it, so the sum along a word's path is the
word's rank. The rank is the transducer's output and selects the word's ids in a packed table. Automaton and table are
one flat file that workers map into memory; a batch's different words walk it together, one array step for each byte.
Words outside it are merged exactly by the tokenizer's own model and kept in a bounded table.

A word here is what stands between two spaces (U+0020). The tokenizers handled this way (a word-level BPE whose
pre-tokenizer drops white space) never let a token, a normalisation or a lower-casing reach across one.
"""

from __future__ import annotations

import json
import mmap
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import byte_characters

#: Frequent words that are compiled. Which they are changes speed only, never a result.
LEXICON_WORDS = 100_000
#: Merged words that a worker keeps: some 30 MB.
MOST_MERGED = 120_000
MAGIC = b"MALX0001"
LITTLE = sys.byteorder == "little"


# -- the automaton ---------------------------------------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The minimal acyclic automaton of sorted, different words (Daciuk et al. 2000, sorted insertion).

    Returns keys (state << 8 | byte, ascending), targets and skips by transition, and final by state; state 0 begins.
    skips: words of the state that come before those that take the transition.
    """
    fresh: list[tuple[int, dict[int, int]]] = []  # frozen states: final, transitions
    known: dict[tuple, int] = {}

    def frozen(node: list) -> int:
        key = (node[0], *node[1].items())
        if (at := known.get(key)) is None:
            at = known[key] = len(fresh)
            fresh.append((node[0], node[1]))
        return at

    path = [[0, {}]]
    last = b""
    for word in words:
        keep = 0
        while keep < min(len(word), len(last)) and word[keep] == last[keep]:
            keep += 1
        for depth in range(len(last), keep, -1):
            path[depth - 1][1][last[depth - 1]] = frozen(path.pop())
        for _ in word[keep:]:
            path.append([0, {}])
        path[-1][0] = 1
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1][last[depth - 1]] = frozen(path.pop())
    root = frozen(path[0])
    # States are frozen children first, so one pass counts the words that each accepts; the root becomes state 0.
    number = lambda at: root - at
    counts: list[int] = []
    keys, targets, skips = [], [], []
    for at, (final, moves) in enumerate(fresh):
        total = final
        for byte, to in sorted(moves.items()):
            keys.append(number(at) << 8 | byte)
            targets.append(number(to))
            skips.append(total)
            total += counts[to]
        counts.append(total)
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    final = np.zeros(len(fresh), dtype=np.uint8)
    for at, (is_final, _) in enumerate(fresh):
        final[number(at)] = is_final
    return np.array(keys, dtype=np.int64)[order], np.array(targets, dtype=np.int32)[order], np.array(skips, dtype=np.int32)[order], final


class Transducer:
    """Sorted words -> their ids, in one flat buffer: MAGIC, counts, then the arrays."""

    TYPES = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint8)  # keys, targets, skips, final, begins, ids

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        sizes = np.frombuffer(data, dtype="<i8", count=7, offset=8)
        place, arrays = 64, []
        for kind, n in zip(self.TYPES, sizes[:6], strict=True):
            arrays.append(np.frombuffer(data, dtype=kind, count=int(n), offset=place))
            place += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.targets, self.skips, self.final, self.begins, self.ids = arrays
        self.longest = int(sizes[6])

    @classmethod
    def packed(cls, words: dict[bytes, bytes]) -> bytes:
        """The flat buffer for a dict of word -> ids as bytes."""
        order = sorted(words)
        keys, targets, skips, final = minimal_automaton(order)
        begins = np.concatenate([[0], np.cumsum([len(words[w]) for w in order], dtype=np.int64)])
        arrays = [keys, targets, skips, final, begins, np.frombuffer(b"".join(words[w] for w in order), dtype=np.uint8)]
        out = [MAGIC, np.array([*map(len, arrays), max(map(len, order), default=0)], dtype="<i8").tobytes()]
        for kind, x in zip(cls.TYPES, arrays, strict=True):
            raw = np.ascontiguousarray(x, dtype=kind).tobytes()
            out += [raw, b"\0" * (-len(raw) % 8)]
        return b"".join(out)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the lexicon, -1 if it is not there."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words or not len(self.keys):
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        begins = np.cumsum(sizes) - sizes
        live = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        state, rank, step = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64), 0
        while len(live):
            want = state << 8 | data[begins[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            live, at = live[ok], at[ok]
            state, rank, step = self.targets[at].astype(np.int64), rank[ok] + self.skips[at], step + 1
            over = sizes[live] == step
            ends = over & (self.final[state] == 1)
            out[live[ends]] = rank[ends]
            live, state, rank = live[~over], state[~over], rank[~over]
        return out

    def output(self, rank: int) -> bytes:
        return self.ids[self.begins[rank] : self.begins[rank + 1]].tobytes()


# -- exact merging ---------------------------------------------------------------------------------------------------


class Merger:
    """Words -> ids by the tokenizers library's own model. Plain Latin words skip its normalisers, which leave them as
    lower() does; every other word goes through the whole library."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        told = json.loads(tokenizer_json)
        kinds = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        pre = [x["type"] for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        added = told.get("added_tokens") or []
        #: Whether a text may be cut at spaces; else the library gets whole texts.
        self.cuts = kinds == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"] and not any(" " in x["content"] or x["single_word"] for x in added)
        #: Latin letters, and then ASCII marks other than an apostrophe, which can begin a contraction.
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
        self.as_characters = dict(enumerate(byte_characters()))
        self.joins = told.get("decoder") is None
        self.strings = [(self.library.id_to_token(i) or "").encode() for i in range(self.library.get_vocab_size())]

    def token(self, word: str) -> list[int]:
        as_bytes = word if word.isascii() else word.encode().decode("latin-1").translate(self.as_characters)
        return [x.id for x in self.model.tokenize(as_bytes)]

    def ids(self, word: str) -> bytes:
        """The ids of a word, as little-endian 32-bit integers."""
        if not word:
            return b""
        if self.cuts and (m := self.plain.fullmatch(word)):
            ids = (self.token(m[1].lower()) if m[1] else []) + (self.token(m[2]) if m[2] else [])
        else:
            ids = self.library.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    def decoded(self, ids: bytes) -> bytes:
        """What the library's decode(ids, skip_special_tokens=False) returns, in UTF-8."""
        ids = np.frombuffer(ids, dtype="<u4").tolist()
        if self.joins:  # no decoder: the tokens with a space between
            return b" ".join(map(self.strings.__getitem__, ids))
        return self.library.decode(ids, skip_special_tokens=False).encode()


_MERGERS: dict[str, Merger] = {}
_CODERS: dict[str, Coder] = {}


def merger(tokenizer_json: str) -> Merger:
    if tokenizer_json not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[tokenizer_json] = Merger(tokenizer_json)
    return _MERGERS[tokenizer_json]


class Coder:
    """Encodes texts with a mapped lexicon and a merger; one for each lexicon and worker process."""

    def __init__(self, words: Transducer, known: Merger):
        self.words, self.merger = words, known
        self.frequent: dict[str, bytes] = {}  # lexicon words that were met, so never more than the lexicon has
        self.ids: dict[str, bytes] = {}  # those, and merged words

    def learn(self, fresh: list[str]) -> None:
        for word, rank in zip(fresh, self.words.ranks([w.encode() for w in fresh]).tolist(), strict=True):
            if rank >= 0:
                self.frequent[word] = self.ids[word] = self.words.output(rank)
            elif self.merger.cuts and (m := self.merger.plain.fullmatch(word)) and m[1] and (m[2] or m[1] != m[1].lower()):
                # Case is lost, and closing marks are a word of their own: each part's ids serve again.
                out = b""
                for part in filter(None, (m[1].lower(), m[2])):
                    if (ids := self.ids.get(part)) is None:
                        ids = self.ids[part] = self.merger.ids(part)
                    out += ids
                self.ids[word] = out
            else:
                self.ids[word] = self.merger.ids(word)

    def forget(self) -> None:
        """At a task's end: the next one learns its words anew, in a fraction of a second."""
        self.frequent, self.ids = {}, {}
        common.tidy()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.merger.cuts:
            return [self.merger.ids(x) for x in texts]
        cut = [x.split(" ") for x in texts]
        met = set().union(*cut)
        if len(self.ids) > MOST_MERGED + len(self.frequent):
            self.ids = dict(self.frequent)
        self.learn([w for w in met if w not in self.ids])
        return [b"".join(map(self.ids.__getitem__, x)) for x in cut]


def coder(name: str, tokenizer_json: str) -> Coder:
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(Transducer.mapped(common.opened_file(name)), merger(tokenizer_json))
    return _CODERS[name]


# -- on tables -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """A compiled lexicon: the file's name on the executors, the tokenizer it belongs to, and its words' number."""

    name: str
    tokenizer: object  # a broadcast of the tokenizer's JSON
    n_words: int


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all whole texts. Cut and counted in the JVM, by task before anything is shuffled, where memory is managed
    and spills; a null text has no words."""
    words = docs.select(F.explode(F.split(F.col(text_col), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer_path: str, n_words: int = LEXICON_WORDS, text_col: str = "text") -> Lexicon:
    """Compile the most frequent words of all texts, n_words at most (words of about equal counts are taken together or
    not at all). Empty tables give an empty lexicon."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    known = Merger(told.value)
    words: dict[bytes, bytes] = {}
    if known.cuts:
        # Counts fall into some hundred steps; the driver gets one row for each, and then the words above the step that
        # keeps them within n_words. No task sends it a list of candidates.
        counted = common.written(count_words(docs, text_col).where("n > 1").withColumn("step", F.floor(8 * F.log2("n"))), "words")
        total, least = 0, None
        for r in counted.groupBy("step").count().orderBy(F.desc("step")).collect():
            total += r["count"]
            if total > n_words:
                break
            least = r["step"]
        if least is not None:
            words = {r.word.encode(): known.ids(r.word) for r in counted.where(F.col("step") >= least).select("word").collect()}
    return Lexicon(common.local_file(spark, [Transducer.packed(words)], "lexicon"), told, len(words))


def encode_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) of every whole text, as the tokenizers library
    encodes it with add_special_tokens=False. A null text counts as empty and has no ids; repeated rows stay; other
    columns are ignored. No shuffle.

    decode: also decoded, as decode_ids() gives it, in the same pass, so one worker a task serves both.
    """
    common.ship(docs.sparkSession)
    name, told = lexicon.name, lexicon.tokenizer

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(name, told.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes = [len(x) for x in texts]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + sizes[end] <= 1 << 20):
                    size += sizes[end]
                    end += 1
                out = known.encode(texts[begin:end])
                columns = {"doc_id": batch.column(0).slice(begin, end - begin), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())}
                if decode:
                    columns["decoded"] = pa.array([known.merger.decoded(x) for x in out], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
                begin = end
        known.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


def decode_ids(encoded: DataFrame, lexicon: Lexicon) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with decoded, the library's decode(ids, skip_special_tokens=False). Null ids: ''."""
    common.ship(encoded.sparkSession)
    told = lexicon.tokenizer

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = merger(told.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [known.decoded(x or b"") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids binary, decoded string")
