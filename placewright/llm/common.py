"""What several corpus operators share: words, stored tables, runs, components."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placewright.session import shared_folder

#: A word: what stands between blanks, tabs and the four line separators.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Spark's and DuckDB's regular expressions.
WORD_GAP = r"[\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MASK = (1 << 64) - 1


class Stored:
    """Tables of one operator run, in the folder all executors share.

    A written table cuts the lineage: an executor lost later costs the tasks
    that were running, not the work before.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.base = shared_folder(spark, purpose)

    def table(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory back to the system: a worker is used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64, copy=True)
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return v


#: A text is hashed in pieces of about so many bytes, cut between words. A worker holds some 100 bytes for each.
PIECE = 1 << 18
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER_LOW = _LETTER.copy()
_LETTER_LOW[65:91] = _LETTER[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(steps)


_TABLES = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for ``length`` places at least."""
    if len(_TABLES[0]) < length:
        size = max(PIECE, 1 << (length - 1).bit_length())
        _TABLES[:] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _TABLES[0], _TABLES[1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` of all ranges."""
    up, down = power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_LETTER_LOW if fold else _LETTER)[data] * up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _hash_piece(piece: np.ndarray, cuts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of all words of a piece of bytes; no word crosses a cut."""
    solid = ~_GAP[piece]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(piece))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return range_hashes(piece, starts, ends, fold), starts, ends


def hashed_words(texts: pa.Array, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a text column as 64-bit hashes, a few rows at a time.

    Yields ``(first row, hashes, cuts, starts, ends)``: the words of row
    ``first + k`` are ``hashes[cuts[k]:cuts[k + 1]]``, their bytes
    ``starts`` to ``ends`` of the column's data. ``fold`` hashes A-Z as a-z. A null
    is an empty text. Only bytes are looked at, no Python string is made.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        low, high = int(offsets[row]), int(offsets[stop])
        hashes, starts, ends = [], [], []
        at = low
        while at < high:
            end = min(at + PIECE, high)
            if end < high:
                while end < high and not _GAP[data[end]]:
                    end += 1
            found = _hash_piece(data[at:end], offsets[row : stop + 1] - at, fold)
            hashes.append(found[0])
            starts.append(found[1] + at)
            ends.append(found[2] + at)
            at = end
        if hashes:
            begin = np.concatenate(starts)
            yield row, np.concatenate(hashes), np.searchsorted(begin, offsets[row : stop + 1]), begin, np.concatenate(ends)
        else:
            none = np.zeros(0, np.int64)
            yield row, none.astype(np.uint64), np.zeros(stop - row + 1, np.int64), none, none
        row = stop
    release_memory()


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    return mixed(total)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each value mixed with its occurrence number, so that all are different."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return values
    starts = np.flatnonzero(fresh)
    number = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    out = values.copy()
    with np.errstate(over="ignore"):
        repeat = number > 0
        out[order[repeat]] = mixed(
            ranked[repeat] + number[repeat].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        )
    return out


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start:start + length]`` of all pairs, put together."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` in rows sorted by them, whatever the batches.

    Only for groups whose size is bounded before they are formed.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            changed[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            piece = batch.slice(start, end - start)
            first = tuple(piece.column(key)[0].as_py() for key in keys) if start == 0 else None
            if held and not (start == 0 and first == last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
        last = tuple(batch.column(key)[batch.num_rows - 1].as_py() for key in keys)
    if held:
        yield pa.Table.from_batches(held)


#: Bits of the map that tells which rows can be wanted: 8 MB, whatever the input.
WANTED_BITS = 1 << 26


def key_map(keys: DataFrame) -> Broadcast:
    """A map of hashed keys (one column), of a fixed size, on every worker."""
    spot = F.pmod(F.xxhash64(keys.columns[0]), F.lit(WANTED_BITS)) + 1
    parts = (
        keys.where(F.col(keys.columns[0]).isNotNull())
        .select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("position"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("position").alias("bits"))
        .collect()  # WANTED_BITS in all
    )
    held = np.zeros(WANTED_BITS // 8, np.uint8)
    for part in parts:
        piece = np.frombuffer(bytes(part["bits"]), np.uint8)
        start = (part["bucket"] - 1) * len(piece)
        held[start : start + len(piece)] = piece
    return keys.sparkSession.sparkContext.broadcast(held)


def in_map(rows: DataFrame, key: str, held: Broadcast, inside: bool = True) -> DataFrame:
    """Rows whose key is in the map, or those whose key is not; a null key is not.

    Rows that are in it by chance are for a join to tell, which then moves little else.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(columns)).to_numpy()
            found = (at >= 0) & ((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
            kept = batch.filter(pa.array(found if inside else ~found))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], columns)

    spot = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(WANTED_BITS)))
    return rows.withColumn("__spot", spot).mapInArrow(run, rows.schema)


def only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is in ``wanted`` (one column of another name), the others left where they are."""
    return in_map(rows, key, key_map(wanted)).join(wanted, F.col(key) == F.col(wanted.columns[0]), "left_semi")


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped``; most of them are not moved."""
    held = key_map(dropped)
    unsure = in_map(rows, key, held).join(dropped, F.col(key) == F.col(dropped.columns[0]), "left_anti")
    return in_map(rows, key, held, inside=False).unionByName(unsure)


def components(edges: DataFrame, stored: Stored) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; root is the smallest node.

    Alternating large and small stars: every round hangs the neighbours of a node on
    their smallest member, until all links are stars; a round costs four tables, the look at
    the links only one aggregation. The rounds grow with the logarithm of the longest
    path. Edges stay distributed, and a hub is one row per task in the
    aggregation and a splittable side in the join.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = stored.table(edges.where("a <> b").select(a, b).distinct(), "links")

    def loose(links: DataFrame) -> int:
        """Nodes that hang on two others, or hang on one and carry some: none if all links are stars."""
        ends = F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(1).alias("hangs")))
        nodes = links.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.count(F.lit(1)).alias("n"), F.max("e.hangs").alias("hangs"))
        return nodes.where("hangs = 1 and n > 1").agg(F.count(F.lit(1))).first()[0]

    while loose(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.join(stored.table(least, "least").withColumnRenamed("a", "c"), F.col("a") == F.col("c"))
            .where("b > a and b <> m")
            .select(F.col("m").alias("a"), "b")
        )
        large = stored.table(large.distinct(), "large")
        low = stored.table(large.groupBy("b").agg(F.min("a").alias("m")), "low").withColumnRenamed("b", "c")
        small = large.join(low, F.col("b") == F.col("c")).select(
            F.explode(
                F.array(
                    F.struct(F.col("m").alias("a"), F.col("b")),
                    F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                )
            ).alias("e")
        )
        links = stored.table(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
    # in stars every node that is no centre hangs on one
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
