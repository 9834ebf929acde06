"""Removal of repeated strings by two-stage suffix sorting.

Two equal strings of ``WINDOW`` bytes have the same least hash among their ``GRAM``-byte grams. So a text is cut into pieces of neighbouring
strings with one least hash ("key"). Only pieces whose key occurs again anywhere in the corpus are moved: keys are counted first and
told to the tasks by a bit map of bounded size (a key let through by chance costs its movement, no more). All equal strings meet under
their key. A task puts pieces together into blocks, sorts their suffixes in two stages and
compares neighbours in the order found: only suffixes smaller than their successors are sorted directly (eight bytes a
round, as long as they are tied and differ), all others follow by bucket scans, each written at the place
that its successor's bucket gives it; suffixes with 100 common bytes are one string, and all but its earliest place are repeated.

Pieces equal as a whole are told by their hash (64 bits, below a key of 64 bits) before anything is sorted. A key that
more than ``WIDE`` pieces share is dealt over several tasks; each hands on its different strings by a hash of 128 bits, and the earliest of them
is found by an aggregation. So neither a passage in a third of all documents nor a text of one letter gathers in a task.

Texts stay where they are until the last step: there those with repeated strings meet their spans, all others are digested in place.

A null text is an empty one, a null id counts as the least one. Rows with the same id are one document for the order: of two such rows with the
same string at the same start neither is the earlier one. Texts of any length are read in slices of ``SLICE`` bytes
that overlap. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Stored, in_map, key_map, mixed, ragged, range_hashes, release_memory

WINDOW = 100
GRAM = 32
#: Grams of a window.
SPAN = WINDOW - GRAM + 1
SLICE = 256 << 10
#: Keys that a task counts together.
COUNTED = 400_000
#: Bits of the map of repeated keys: 32 a key, within these bounds (128 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Pieces of a key that go to one task, and bytes sorted together.
WIDE = 4_096
BLOCK = 512 << 10
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_OTHER = np.random.default_rng(12).permutation(256).astype(np.uint8)
_BASE = 0xD1342543DE82EF95


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``GRAM`` bytes."""
    held = _LETTER[data]
    width = 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            held = held[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + held[width:]
            width *= 2
    return mixed(held)


def _sliding(values: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of all runs of ``SPAN`` values."""
    width = 1
    while 2 * width <= SPAN:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = SPAN - width
    return pick(values[:-rest], values[rest:]) if rest else values


class Pieces:
    """Pieces of a block of bytes that holds slices of texts one behind the other.

    ``key`` and, in the block, first byte and number of strings of each piece; ``twice``: keys that
    stand twice within one string's reach, so that a piece may repeat itself.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.key, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.twice = np.zeros(0, np.uint64)
        whole = lengths >= WINDOW
        if not whole.any():
            return
        grams = _grams(data)
        least = _sliding(grams, np.minimum)
        first, strings = starts[whole], lengths[whole] - WINDOW + 1
        places = ragged(np.arange(len(least)), first, strings)
        key = least[places]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (places[1:] != places[:-1] + 1)
        fresh[np.concatenate([[0], np.cumsum(strings)[:-1]])] = True
        heads = np.flatnonzero(fresh)
        run = np.arange(len(places)) - np.repeat(heads, np.diff(np.append(heads, len(places))))
        heads = np.flatnonzero(run % SPAN == 0)
        self.key, self.at = key[heads], places[heads]
        self.count = np.diff(np.append(heads, len(places)))
        padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
        chosen = np.flatnonzero(grams == _sliding(padded, np.maximum))
        near = (grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) < SPAN)
        self.twice = np.unique(grams[chosen[1:][near]])


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about ``SLICE`` bytes: data, and start, length, row and offset in the text of its slices."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    held, rows, shifts, size = [], [], [], 0
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for shift in range(0, max(high - low - WINDOW + 1, 0), SLICE):
            held.append(data[low + shift : min(low + shift + SLICE + WINDOW - 1, high)])
            rows.append(row)
            shifts.append(shift)
            size += len(held[-1])
            if size >= SLICE:
                yield _joined(held, rows, shifts)
                held, rows, shifts, size = [], [], [], 0
    if held:
        yield _joined(held, rows, shifts)


def _joined(held: list, rows: list, shifts: list) -> tuple:
    lengths = np.array([len(x) for x in held])
    return np.concatenate(held), np.cumsum(lengths) - lengths, lengths, np.array(rows), np.array(shifts)


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_memory()
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

    for batch in batches:
        for data, starts, lengths, _, _ in _slices(batch.column("text")):
            pieces = Pieces(data, starts, lengths)
            held += [pieces.key, pieces.twice]
            size += len(pieces.key)
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def _repeated_map(keys: DataFrame) -> tuple[Broadcast, int]:
    """A bit for every repeated key, in a map whose size follows their number within its bounds."""
    wanted = 32 * keys.count()
    bits = min(max(LEAST_BITS, 1 << max(wanted - 1, 1).bit_length()), MOST_BITS)
    spot = F.pmod("key", F.lit(bits)) + 1
    parts = (
        keys.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("position"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("position").alias("bits"))
        .toLocalIterator()  # MOST_BITS in all
    )
    held = np.zeros(bits // 8, np.uint8)
    for part in parts:
        piece = np.frombuffer(bytes(part["bits"]), np.uint8)
        start = (part["bucket"] - 1) * len(piece)
        held[start : start + len(piece)] = piece[: bits // 8 - start]
    return keys.sparkSession.sparkContext.broadcast(held), bits


PIECES = "key bigint, doc bigint, row_key bigint, at int, twice boolean, body binary"


def _wanted(held: Broadcast, bits: int):
    """The pieces whose key is in the map, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            doc, row_key = (batch.column(k).to_numpy() for k in ("doc", "row_key"))
            for data, starts, lengths, rows, shifts in _slices(batch.column("text")):
                pieces = Pieces(data, starts, lengths)
                spot = pieces.key.view(np.int64) % bits
                kept = np.flatnonzero((held.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
                if not len(kept):
                    continue
                key, at = pieces.key[kept], pieces.at[kept]
                size = pieces.count[kept] + WINDOW - 1
                owner = np.searchsorted(starts, at, "right") - 1
                place = at - starts[owner] + shifts[owner]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                body = pa.Array.from_buffers(
                    pa.binary(), len(kept), [None, pa.py_buffer(ends), pa.py_buffer(ragged(data, at, size))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(doc[rows[owner]]), pa.array(row_key[rows[owner]]),
                        pa.array(place.astype(np.int32)), pa.array(np.isin(key, pieces.twice)), body,
                    ],
                    ["key", "doc", "row_key", "at", "twice", "body"],
                )

    return run


def _words(symbols: np.ndarray) -> np.ndarray:
    """Eight symbols from each place as one number, zeros behind the end."""
    held = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        held = (held[:-width] << np.uint64(8 * width)) | held[width:]
    return held[: len(symbols)]


def _sorted_directly(places: np.ndarray, words: np.ndarray, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``places`` by the ``WINDOW`` symbols that begin there, no further than the end of their piece.

    ``left``: symbols up to that end. ``whole``: hashes of all that is compared; places tied in a group of one
    hash are equal and need no further round.
    """
    order = np.argsort(words[places], kind="stable")
    places = places[order]
    first = words[places]
    slots = np.arange(len(places))
    group = np.cumsum(np.append(True, first[1:] != first[:-1])) - 1 if len(places) else slots
    for shift in range(8, WINDOW, 8):
        if not len(slots):
            break
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(heads, len(group)))
        hashes = whole[places[slots]]
        mixed_up = np.minimum.reduceat(hashes, heads) != np.maximum.reduceat(hashes, heads)
        open_ = np.repeat(mixed_up, size)
        slots, group = slots[open_], group[open_]
        if not len(slots):
            break
        here = places[slots]
        ahead = np.minimum(here + shift, len(words) - 1)
        key = np.where(left[here] > shift, words[ahead], 0)
        order = np.lexsort((key, group))
        places[slots] = here[order]
        key = key[order]
        group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))) - 1
    return places


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All places of ``symbols`` in the order of their suffixes, as far as ``WINDOW`` symbols tell.

    Pieces end with a zero, the least symbol; ``left`` counts the symbols before it. Order across a zero is of no meaning.
    """
    n = len(symbols)
    words = _words(symbols)
    # nothing behind the end of a piece is compared
    short = np.flatnonzero(left < 8)
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(left[short], 1).astype(np.uint64)))
    words[left == 0] = 0
    places = np.arange(n)
    whole = range_hashes(symbols, places, places + np.minimum(left, WINDOW))
    # smaller than the successor: the next other symbol is greater
    changes = np.flatnonzero(symbols[1:] != symbols[:-1])
    run_end = np.append(changes, n - 1)[np.searchsorted(changes, places, "left")]
    smaller = np.append(symbols[1:], 0)[run_end] > symbols
    smaller[symbols == 0] = True
    direct = _sorted_directly(np.flatnonzero(smaller), words, left, whole)
    total = np.bincount(symbols, minlength=256)
    begin = np.cumsum(total) - total
    greater = np.bincount(symbols[~smaller], minlength=256)
    direct_cuts = np.concatenate([[0], np.cumsum(np.bincount(symbols[direct], minlength=256))])
    order = np.full(n, -1)
    filled = begin.copy()
    for symbol in range(256):
        if not total[symbol]:
            continue
        # suffixes greater than their successor: those whose successor lies in an earlier bucket are here already
        low, high = int(begin[symbol]), int(filled[symbol])
        while high > low:
            before = order[low:high] - 1
            before = before[(before >= 0) & (symbols[before] == symbol)]
            order[high : high + len(before)] = before
            low, high = high, high + len(before)
        split, end = int(begin[symbol] + greater[symbol]), int(begin[symbol] + total[symbol])
        order[split:end] = direct[direct_cuts[symbol] : direct_cuts[symbol + 1]]
        before = order[begin[symbol] : end] - 1
        before = before[before >= 0]
        before = before[(symbols[before] > symbol) & ~smaller[before]]
        bucket = symbols[before]
        by_bucket = np.argsort(bucket, kind="stable")
        before, bucket = before[by_bucket], bucket[by_bucket]
        number = np.bincount(bucket, minlength=256)
        order[filled[bucket] + np.arange(len(bucket)) - np.repeat(np.cumsum(number) - number, number)] = before
        filled += number
    return order


def same_as_before(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each place shares its first ``WINDOW`` symbols with the one before it in the order."""
    same = np.append(False, np.ones(max(len(order) - 1, 0), bool))[: len(order)]
    for shift in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        left = np.flatnonzero(same)
        same[left] = words[order[left] + shift] == words[order[left - 1] + shift]
    return same


def _spans(piece: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings: piece, first byte, end."""
    by = np.lexsort((offset, piece))
    piece, offset = piece[by], offset[by]
    head = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)))
    last = np.append(head[1:], len(piece)) - 1
    return piece[head], offset[head], offset[last] + WINDOW


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), cuts


FOUND = "doc bigint, row_key bigint, start int, stop int, h1 bigint, h2 bigint"
_FOUND = ["doc", "row_key", "start", "stop", "h1", "h2"]


def _later(doc: np.ndarray, at: np.ndarray, head: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rows behind the first of their group; groups are sorted by (doc, at)."""
    first = head[number]
    return (doc > doc[first]) | ((doc == doc[first]) & (at > at[first]))


def _compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Repeated strings of whole groups of pieces as spans; different strings of wide groups by hash."""
    part, key, doc, row_key, at = (table.column(k).to_numpy() for k in ("part", "key", "doc", "row_key", "at"))
    wide, twice = (table.column(k).to_numpy(zero_copy_only=False) for k in ("wide", "twice"))
    data, cuts = _bytes_of(table.column("body").combine_chunks() if table.num_rows else table.column("body"))
    size = np.diff(cuts)
    whole = range_hashes(data, cuts[:-1], cuts[1:])
    order = np.lexsort((row_key, at, doc, whole, part, key))

    def changed(*columns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), bool)
        out[:1] = True
        for column in columns:
            c = column[order]
            out[1:] |= c[1:] != c[:-1]
        return out

    fresh = changed(key, part, whole)
    number = np.cumsum(fresh) - 1
    copies = _later(doc[order], at[order], np.flatnonzero(fresh), number)
    gone = order[copies]
    none = lambda k: pa.nulls(k, pa.int64())
    if len(gone):
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[gone]), pa.array(row_key[gone]), pa.array(at[gone].astype(np.int32)),
             pa.array((at[gone] + size[gone]).astype(np.int32)), none(len(gone)), none(len(gone))], _FOUND,
        )
    # what is left: one piece of each content, and further rows of the same id and place
    repeat = ~changed(key, part, whole, doc, at, row_key)
    group = np.cumsum(changed(key, part)) - 1
    stay = ~copies & ~repeat
    several = np.bincount(group[stay], minlength=group[-1] + 1 if len(group) else 0) > 1
    stay &= several[group] | twice[order] | wide[order]
    kept = order[stay]
    if not len(kept):
        return
    size, start = size[kept], cuts[:-1][kept]
    ends = np.cumsum(size + 1)
    first = ends - size - 1
    symbols = np.zeros(int(ends[-1]), np.uint8)
    inner = np.ones(len(symbols), bool)
    inner[ends - 1] = False
    # no byte of UTF-8 is above 0xF4, so zero is free for the end of a piece
    symbols[inner] = ragged(data, start, size) + 1
    piece = np.repeat(np.arange(len(kept)), size + 1)
    offset = np.arange(len(symbols)) - first[piece]
    left = size[piece] - offset
    places = suffix_order(symbols, left)
    places = places[left[places] >= WINDOW]
    same = same_as_before(places, _words(symbols))
    group = np.cumsum(~same) - 1
    owner, where = piece[places], at[kept][piece[places]] + offset[places]
    docs = doc[kept][owner]
    by = np.lexsort((where, docs, group))
    head = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))
    later = _later(docs[by], where[by], head, group[by])
    gone = by[later]
    if len(gone):
        owners, low, high = _spans(owner[gone], offset[places[gone]])
        base = at[kept][owners]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[kept][owners]), pa.array(row_key[kept][owners]), pa.array((base + low).astype(np.int32)),
             pa.array((base + high).astype(np.int32)), none(len(owners)), none(len(owners))], _FOUND,
        )
    rest = by[~later]
    rest = rest[wide[kept][owner[rest]]]
    for low in range(0, len(rest), 100_000):
        some = rest[low : low + 100_000]
        spot = places[some]
        h1 = range_hashes(symbols, spot, spot + WINDOW).view(np.int64)
        h2 = range_hashes(_OTHER[symbols], spot, spot + WINDOW).view(np.int64)
        begin = where[some].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[some]), pa.array(row_key[kept][owner[some]]), pa.array(begin),
             pa.array(begin + np.int32(WINDOW)), pa.array(h1), pa.array(h2)], _FOUND,
        )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part), put together into blocks that end with a group."""
    release_memory()
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("body").nbytes
        while size >= BLOCK:
            table = pa.Table.from_batches(held)
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            if not len(cuts):
                held = table.combine_chunks().to_batches()
                break
            ends = np.cumsum(pa.compute.binary_length(table.column("body")).to_numpy())
            cut = int(cuts[min(np.searchsorted(ends[cuts - 1], BLOCK), len(cuts) - 1)])
            yield from _compare(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.column("body").nbytes for b in held)
    if held:
        yield from _compare(pa.Table.from_batches(held))


def repeated_spans(rows: DataFrame, stored: Stored) -> DataFrame:
    """``doc, row_key, start, stop``: bytes of repeated strings of ``rows (doc, row_key, text)``, as runs that may overlap."""
    counts = stored.table(
        rows.select("text").mapInArrow(_key_counts, "key bigint, n int").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"),
        "keys",
    )
    held, bits = _repeated_map(counts.select("key"))
    wide = counts.where(F.col("n") > WIDE).select(F.col("key").alias("k"), F.ceil(F.col("n") / WIDE).alias("parts"))
    pieces = rows.mapInArrow(_wanted(held, bits), PIECES).join(wide, F.col("key") == F.col("k"), "left")
    found = stored.table(
        pieces.select(
            "key", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc", "at"), "parts")).otherwise(0).alias("part"),
            "doc", "row_key", "at", "twice", "body", F.col("parts").isNotNull().alias("wide"),
        )
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
        .mapInArrow(_compared, FOUND),
        "found",
    )
    strings = found.where("h1 is not null")
    first = (
        strings.groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2"))
        .agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    later = (
        strings.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
        .where(F.struct("doc", "start") > F.col("first"))
    )
    columns = ["doc", "row_key", "start", "stop"]
    return found.where("h1 is null").select(*columns).unionByName(later.select(*columns))


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.maximum.accumulate(stop[by])
    head = np.append(True, start[1:] > stop[:-1]) if len(start) else np.zeros(0, bool)
    return start[head], stop[np.append(np.flatnonzero(head)[1:] - 1, len(stop) - 1)] if len(start) else stop


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of texts without their spans."""
    release_memory()
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw = text.as_py().encode() if text.is_valid else b""
            digest, at, removed, count = hashlib.sha256(), 0, 0, 0
            if spans.is_valid:
                start, stop = _merged(*(np.asarray(spans.values.field(k)) for k in (0, 1)))
                for low, high in zip(start.tolist(), stop.tolist()):
                    digest.update(raw[at:low])
                    at, removed, count = high, removed + high - low, count + 1
            digest.update(raw[at:])
            rows.append((len(raw), removed, count, digest.hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            [part.split()[0] for part in RESULT.split(", ")],
        )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    stored = Stored(documents.sparkSession, "suffixes")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"), "text"
    )
    spans = stored.table(
        repeated_spans(rows.select("doc", "row_key", "text"), stored)
        .groupBy("doc", "row_key")
        # as many as a text has room for
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans")),
        "spans",
    )
    touched = key_map(spans.select("row_key"))
    joined = in_map(rows, "row_key", touched).join(
        spans.select(F.col("doc").alias("d"), F.col("row_key").alias("r"), "spans"),
        (F.col("row_key") == F.col("r")) & (F.col("doc") == F.col("d")), "left",
    )
    rest = in_map(rows, "row_key", touched, inside=False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    columns = ["doc_id", "text", "spans"]
    return joined.select(*columns).mapInArrow(_cut, RESULT).unionByName(rest.select(*columns).mapInArrow(_cut, RESULT))
