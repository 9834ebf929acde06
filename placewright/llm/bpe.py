"""Byte-level BPE by merge replay over an inverted index, and its inverse.

Text is cut into pieces (contractions, words, numbers, other signs, white space) on arrays of code
point classes. The distinct pieces that a block of texts adds to those already
known form one corpus of symbols. An inverted index from pair to the positions
where it stands is then replayed in rank order: a merge takes all its positions at once, and only
the two neighbours of each are entered anew. Documents are put together from the
token runs of their pieces, so a word is merged once per task, not once per use.

Texts never leave their partition: no shuffle, and a lost task is simply run again.
A null text is an empty one, its ids are the empty list. Every row gives one row; repeated rows
repeat, and further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import extended, ragged, range_hashes, release_memory

#: Bytes of text per block, and distinct pieces a task keeps (memory only).
BLOCK_BYTES = 512 << 10
KEPT_PIECES = 400_000

# Letters and numbers that Unicode 16 added, for a Python whose tables are older.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
_NONE = np.int64(1 << 40)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = LETTER
        elif first == "N":
            kinds[code] = NUMBER
    for low, high in NEW_LETTERS:
        kinds[low : high + 1] = LETTER
    for low, high in NEW_NUMBERS:
        kinds[low : high + 1] = NUMBER
    kinds[WHITE] = SPACE
    return kinds


def cut(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start, given code points of texts that start at ``texts``."""
    n = len(points)
    kinds = char_classes()[points]
    start = np.zeros(n + 1, bool)
    start[1:n] = kinds[1:] != kinds[:-1]
    start[texts[texts < n]] = True
    start[n] = True
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[texts] = True
    first_of_text[n] = True
    # the last white space before a sign of the same text stands alone, or leads that sign if a blank
    turn = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE)) if n > 1 else np.zeros(0, np.int64)
    turn = turn[~first_of_text[turn + 1]]
    start[turn] = True
    blank = turn[points[turn] == 0x20]
    start[blank + 1] = False
    # contractions: an apostrophe alone before letters, not led by a blank
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        marks = marks[start[marks] & start[marks + 1] & ~first_of_text[marks + 1]]
        for mark in marks.tolist():
            tail = "".join(map(chr, points[mark + 1 : mark + 3].tolist()))
            for short in CONTRACTIONS:
                if tail.startswith(short):
                    end = mark + 1 + len(short)
                    if not first_of_text[mark + 2 : end].any():
                        start[mark + 1] = False
                        start[end] = True
                        break
    return np.flatnonzero(start)


class Merges:
    """The rank file as lookup arrays."""

    def __init__(self, rank_file: bytes):
        ranks = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        codes, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    codes.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.codes = np.array(codes, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        # ranks whose token goes into a pair of lower rank: such are replayed one place a time
        parts = np.stack([self.codes >> 32, self.codes & 0xFFFFFFFF])
        self.early = set(np.unique(parts[parts > self.merged]).tolist())

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 32 | right
        spot = np.searchsorted(self.codes, code)
        spot[spot == len(self.codes)] = 0
        return np.where(self.codes[spot] == code, self.merged[spot], _NONE)

    def replay(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words given as bytes: all tokens, and their number by word."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        word = np.repeat(np.arange(len(lengths)), lengths)
        symbol = self.single[data]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        end = np.append(word[1:] != word[:-1], True)
        after[end] = -1
        before[1:][end[:-1]] = -1
        rank = np.full(n, _NONE)
        inner = np.flatnonzero(~end)
        rank[inner] = self.pair(symbol[inner], symbol[inner + 1])
        live = np.flatnonzero(rank < _NONE)
        live = live[np.argsort(rank[live], kind="stable")]
        index: dict[int, list] = {}
        if len(live):
            edges = np.flatnonzero(np.diff(rank[live], prepend=-1))
            for group in np.split(live, edges[1:]):
                index[int(rank[group[0]])] = [group]
        waiting = list(index)
        heapq.heapify(waiting)
        while waiting:
            merge = heapq.heappop(waiting)
            held = index.pop(merge, None)
            if held is None:
                continue
            places = held[0] if len(held) == 1 else np.concatenate(held)
            places = places[rank[places] == merge]
            if len(places) > 1:
                places.sort()
                places = places[np.append(True, places[1:] != places[:-1])]
            if not len(places):
                continue
            if len(places) > 1:
                if merge in self.early:
                    first = np.append(True, word[places[1:]] != word[places[:-1]])
                    if not first.all():
                        index[merge] = [places[~first]]
                        heapq.heappush(waiting, merge)
                        places = places[first]
                else:
                    chained = np.append(False, after[places[:-1]] == places[1:])
                    if chained.any():
                        # in a chain of overlapping pairs, every second one from the left
                        heads = np.flatnonzero(~chained)
                        depth = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
                        places = places[depth % 2 == 0]
            taken = after[places]
            following = after[taken]
            symbol[places] = merge
            symbol[taken] = -1
            rank[taken] = _NONE
            rank[places] = _NONE
            after[places] = following
            inside = following >= 0
            before[following[inside]] = places[inside]
            touched = [places[inside]]
            previous = before[places]
            touched.append(previous[previous >= 0])
            changed = np.concatenate(touched)
            if len(changed):
                fresh = self.pair(symbol[changed], symbol[after[changed]])
                rank[changed] = fresh
                order = np.argsort(fresh, kind="stable")
                order = order[: np.searchsorted(fresh[order], _NONE)]
                changed, fresh = changed[order], fresh[order]
                edges = [*np.flatnonzero(np.diff(fresh, prepend=-1)).tolist(), len(fresh)]
                for low, high in zip(edges, edges[1:]):
                    r = int(fresh[low])
                    if r in index:
                        index[r].append(changed[low:high])
                    else:
                        index[r] = [changed[low:high]]
                        heapq.heappush(waiting, r)
        left = symbol >= 0
        return symbol[left], np.bincount(word[left], minlength=len(lengths))


class Encoder:
    """Encodes blocks of texts; keeps the pieces it has met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as unsigned 32-bit integers."""
        if sum(map(len, texts)) <= 2 * BLOCK_BYTES:
            return self._block(texts)
        return [np.concatenate([self._block([part])[0] for part in _parts(text)]) for text in texts]

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        data = np.frombuffer(whole.encode("utf-8"), np.uint8)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        text_starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return [np.zeros(0, np.uint32) for _ in texts]
        starts = cut(points, text_starts)
        by_text = np.searchsorted(starts, text_starts)
        if len(data) != len(points):
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width)])
            starts = at[starts]
        lengths = np.diff(starts)
        starts = starts[:-1]
        keys = range_hashes(data, starts, starts + lengths)
        distinct, example, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_PIECES:
            self._forget()
        spot = np.searchsorted(self.known, distinct)
        spot[spot == len(self.known)] = 0
        new = np.ones(len(distinct), bool) if not len(self.known) else self.known[spot] != distinct
        if new.any():
            take = example[new]
            tokens, counts = self.merges.replay(ragged(data, starts[take], lengths[take]), lengths[take])
            begin = len(self.tokens) + np.cumsum(counts) - counts
            self.tokens = np.concatenate([self.tokens, tokens.astype(np.int32)])
            at = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, at, distinct[new])
            self.starts = np.insert(self.starts, at, begin)
            self.lengths = np.insert(self.lengths, at, counts)
            spot = np.searchsorted(self.known, distinct)
        spot = spot[place]
        counts = self.lengths[spot]
        ids = ragged(self.tokens, self.starts[spot], counts).astype(np.uint32)
        return np.split(ids, np.concatenate([[0], np.cumsum(counts)])[by_text[1:-1]])


@lru_cache(4)
def merges_of(rank_file: bytes) -> Merges:
    return Merges(rank_file)


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts of about ``BLOCK_BYTES``, cut before blanks that
    follow another sign than white space: there a piece always ends."""
    start = 0
    while len(text) - start > BLOCK_BYTES:
        at = text.find(" ", start + BLOCK_BYTES)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_BYTES:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encode(documents: DataFrame, rank_file: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``ids array<int>``, the token ids of each text."""
    rows = documents.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    ranks = documents.sparkSession.sparkContext.broadcast(rank_file)  # one vocabulary file, under 1 MB
    fields = extended(rows.select(*keep).schema, "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(merges_of(ranks.value))
        for batch in batches:
            for start, texts in _blocks(batch.column("__text").to_pylist()):
                ids = coder.block(texts)
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(cuts, np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(start, len(texts)) for k in keep), listed], [*keep, "ids"]
                )

    return rows.mapInArrow(run, fields)


def decode(encoded: DataFrame, rank_file: bytes, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``decoded binary``, the bytes of ``ids array<int>``.

    Null ids give null bytes; an id outside the vocabulary is an error.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(rank_file)
    rows = encoded.select(*keep, "ids")
    fields = extended(rows.select(*keep).schema, "decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = merges_of(ranks.value).tokens.__getitem__
        for batch in batches:
            texts = [None if ids is None else b"".join(map(token, ids.as_py())) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(texts, pa.binary())], [*keep, "decoded"]
            )

    return rows.mapInArrow(run, fields)


def round_trip(documents: DataFrame, rank_file: bytes, keep: list[str], with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Ids are hashed as little-endian unsigned 32-bit integers. Without ``with_ids`` the id arrays stay in the task.
    """
    rows = documents.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    ranks = documents.sparkSession.sparkContext.broadcast(rank_file)
    added = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * with_ids]
    fields = extended(rows.select(*keep).schema, ", ".join(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        coder = Encoder(merges_of(ranks.value))
        token = coder.merges.tokens.__getitem__
        for batch in batches:
            for start, texts in _blocks(batch.column("__text").to_pylist()):
                coded = coder.block(texts)
                counts = np.array([len(ids) for ids in coded])
                one = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in coded]
                two = [hashlib.sha256(b"".join(map(token, ids.tolist()))).hexdigest() for ids in coded]
                arrays = [*(batch.column(k).slice(start, len(texts)) for k in keep), pa.array(counts), pa.array(one), pa.array(two)]
                if with_ids:
                    cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(cuts, np.concatenate(coded).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(arrays, fields.names)

    return rows.mapInArrow(run, fields)
