"""Near-duplicate vectors by sorted projection passes.

In every pass the vectors of a label are ordered by 64 concatenated sign hashes (random
hyperplanes of that pass), and each is compared by exact cosine with the ``WINDOW`` vectors before it and with all
others that share its first ``bits`` hashes, its bucket. Pairs at ``SIMILAR`` or more are united over all passes. A pair at
the threshold shares one sign with chance 1 - acos(``SIMILAR``) / pi, wherever the vectors lie, so ``bits`` alone
gives the number of passes after which it has shared no bucket with chance ``MISSED``. How vectors are
spread changes the work, never the chance.

``bits`` follows from the label: as many as leave ``WINDOW`` vectors a bucket if they are spread evenly. A label whose
buckets, counted in a first pass, are fuller than that (vectors with a common direction) takes the bits of least
cost instead, none included: all its vectors are then one bucket. Buckets of more than ``CELL`` vectors are
compared in cells of two hashed parts, so that no task holds one; all others lie whole in one partition.

Links are then counted exactly within each connected component, in blocks: a link is lost only if no chain of found
pairs joins its ends. Equal vectors of a label are one class from the start. A task hands on at most one link less than it has
vectors (those that join something new), a block of a component one count per vector: no list of pairs is made.

Vectors that are null, zero or hold a null or a non-finite component, rows with a null label or a null id,
and vectors of different length link with nothing. Every row gives one row; rows that repeat an id count as
vectors of their own. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Stored, components, in_map, key_map, runs, without

SIMILAR = 0.93
WINDOW = 48
MISSED = 1e-3
#: Vectors of a component on each side of one counted block.
BLOCK = 512
#: Vectors of an over-full bucket in one part, on average.
CELL = 512
HASHES = 64
MOST_BITS = 48
#: Mean bucket, in windows, above which a label is not spread evenly.
CROWDED = 4
#: Cost of sending a vector once, in comparisons of two vectors.
SEND = 400
_BUCKET = ["turn", "label", "dims", "bucket"]


@lru_cache(64)
def _planes(dims: int, turn: int) -> np.ndarray:
    return np.random.default_rng([10, dims, turn]).standard_normal((dims, HASHES))


def meeting(similar: float = SIMILAR) -> float:
    """Chance that two vectors at ``similar`` lie on one side of a random plane."""
    return 1 - math.acos(similar) / math.pi


def pass_count(bits: int, similar: float = SIMILAR, missed: float = MISSED) -> int:
    """Passes after which a pair at ``similar`` has shared no bucket of ``bits`` signs with chance ``missed``."""
    if not bits:
        return 1
    return math.ceil(math.log(missed) / math.log(1 - meeting(similar) ** bits))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link, as bytes, with a key that equal ones share.

    A vector of single precision is kept and sent in four bytes a component.
    """
    for batch in batches:
        out = []
        for vec_id, label, vector in zip(*(batch.column(k) for k in ("vec_id", "label", "embedding"))):
            if vector.as_py() is None or vector.values is None or vector.values.null_count:
                continue
            values = vector.values.to_numpy().astype(np.float64)
            if not len(values) or not np.isfinite(values).all() or not values.any():
                continue
            narrow = values.astype(np.float32)
            raw = (narrow if (narrow == values).all() else values).tobytes()
            key = hashlib.blake2b(repr((label.as_py(), len(values))).encode() + (values + 0.0).tobytes(), digest_size=16).digest()
            out.append((vec_id.as_py(), label.as_py(), len(values), key, raw))
        if out:
            columns = zip(*out)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["vec_id", "label", "dims", "vec_key", "unit"]
            )


def _units(raw: list[bytes], dims: int) -> np.ndarray:
    """Stored vectors scaled to length one, in double precision."""
    kinds = {4 * dims: np.float32, 8 * dims: np.float64}
    if len({len(r) for r in raw}) == 1:
        values = np.frombuffer(b"".join(raw), kinds[len(raw[0])]).reshape(-1, dims).astype(np.float64)
    else:
        values = np.stack([np.frombuffer(r, kinds[len(r)]).astype(np.float64) for r in raw])
    # the largest component first, so that no square overflows
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values**2).sum(axis=1, keepdims=True))


def _sort_keys(unit: np.ndarray, turn: int) -> np.ndarray:
    bits = np.packbits(unit @ _planes(unit.shape[1], turn) > 0, axis=1)
    return bits.copy().view(">u8").ravel().astype(np.uint64)


def _turns(narrow: bool):
    """Every vector once per pass of its label, with its sort key and bucket of that pass; ``narrow`` leaves the vector out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for size in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == size))
                unit = _units(part.column("unit").to_pylist(), size)
                bits, passes = part.column("bits").to_numpy(), part.column("passes").to_numpy()
                for turn in range(int(passes.max())):
                    at = np.flatnonzero(passes > turn)
                    keys = _sort_keys(unit[at], turn)
                    own = bits[at].astype(np.uint64)
                    # a shift by all 64 places is undefined
                    bucket = np.where(own > 0, keys >> (np.uint64(HASHES) - np.maximum(own, np.uint64(1))), np.uint64(0))
                    rows = part.take(pa.array(at))
                    columns = {
                        "turn": pa.array(np.full(len(at), turn, np.int32)), "label": rows.column("label"), "dims": rows.column("dims"),
                        "bucket": pa.array(bucket.view(np.int64)),
                    }
                    if not narrow:
                        columns |= {"sort_key": pa.array(keys.view(np.int64)), "cls": rows.column("cls"), "unit": rows.column("unit")}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


_NARROW = "turn int, label string, dims int, bucket bigint"
_WIDE = f"{_NARROW}, sort_key bigint, cls bigint, unit binary"


class Union:
    """Which of a task's vectors are joined already."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, node: int) -> int:
        parent = self.parent
        while (above := parent.get(node, node)) != node:
            parent[node] = parent.get(above, above)
            node = above
        return node

    def join(self, one: int, two: int) -> bool:
        one, two = self.top(one), self.top(two)
        if one == two:
            return False
        self.parent[max(one, two)] = min(one, two)
        return True


def _preceding(part: pa.Table) -> np.ndarray:
    """How many rows of its bucket precede each of some sorted rows."""
    fresh = np.zeros(part.num_rows, bool)
    fresh[0] = True
    for key in _BUCKET:
        column = part.column(key).combine_chunks()
        values = column.dictionary_encode().indices.to_numpy() if key == "label" else column.to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(fresh)
    return np.arange(part.num_rows) - np.repeat(starts, np.diff(np.append(starts, part.num_rows)))


def _new_links(joined: Union, found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    links = [(min(a, b), max(a, b)) for a, b in found if joined.join(a, b)]
    if links:
        a, b = zip(*links)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _window_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows with the window before them and with their bucket, those that join something new to the task."""
    joined, held = Union(), None
    for batch in batches:
        for start in range(0, batch.num_rows, 8192):
            part = pa.Table.from_batches([batch.slice(start, 8192)])
            if held is not None:
                part = pa.concat_tables([held, part])
            fresh = 0 if held is None else held.num_rows
            before = _preceding(part)
            # a bucket has at most CELL rows here
            held = part.slice(max(0, part.num_rows - max(WINDOW, int(before[-1]) + 1)))
            found = []
            dims = part.column("dims").to_numpy()
            turns = part.column("turn").to_numpy()
            labels = part.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            names = part.column("cls").to_numpy()
            for size in np.unique(dims).tolist():
                at = np.flatnonzero(dims == size)
                unit = _units(part.column("unit").take(pa.array(at)).to_pylist(), size)
                for back in range(1, min(max(WINDOW, int(before[at].max())), len(at) - 1) + 1):
                    one, two = at[:-back], at[back:]
                    if back <= WINDOW:
                        near = (turns[one] == turns[two]) & (labels[one] == labels[two]) & (two >= fresh)
                    else:
                        near = (before[two] >= back) & (two >= fresh)
                    pick = np.flatnonzero(near)
                    if len(pick):
                        pick = pick[np.einsum("ij,ij->i", unit[pick], unit[pick + back]) >= SIMILAR]
                        found += zip(names[one[pick]].tolist(), names[two[pick]].tolist())
            yield from _new_links(joined, found)


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two parts of an over-full bucket, or within one, that join something new to the task."""
    joined = Union()
    for cell in runs(batches, [*_BUCKET, "i", "j"]):
        unit = _units(cell.column("unit").to_pylist(), cell.column("dims")[0].as_py())
        names = cell.column("cls").to_numpy()
        one = two = np.arange(len(unit))
        if cell.column("i")[0].as_py() != cell.column("j")[0].as_py():
            left = cell.column("left").to_numpy()
            one, two = np.flatnonzero(left), np.flatnonzero(~left)
        x, y = np.nonzero(unit[one] @ unit[two].T >= SIMILAR)
        apart = one[x] < two[y] if one is two else np.ones(len(x), bool)
        yield from _new_links(joined, zip(names[one[x[apart]]].tolist(), names[two[y[apart]]].tolist()))


def _plan(heads: DataFrame, stored: Stored) -> DataFrame:
    """``l, d, bits, passes`` for every label and length of vectors.

    Full buckets are counted for one pass, before any vector moves; candidates are the bits for evenly spread
    vectors, up to 18 more, and none.
    """
    passes = F.element_at(F.array(*(F.lit(pass_count(k)) for k in range(MOST_BITS + 1))), F.col("bits") + 1)
    even = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / WINDOW)))).cast("int")
    sizes = heads.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("size")).select(
        F.col("label").alias("l"), F.col("dims").alias("d"), even.alias("even")
    )
    sizes = stored.table(sizes, "sizes")
    probe = heads.select("label", "dims", "unit", F.lit(HASHES - 1).alias("bits"), F.lit(1).alias("passes")).mapInArrow(
        _turns(narrow=True), _NARROW
    )
    counted = probe.groupBy("label", "dims", "bucket").agg(F.count(F.lit(1)).alias("n"))
    tried = F.array_union(F.array(F.lit(0)), F.sequence(F.col("even"), F.least(F.col("even") + 18, F.lit(MOST_BITS)), F.lit(3)))
    by_bits = (
        counted.join(sizes, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d")))
        .withColumn("bits", F.explode(tried))
        .withColumn("bucket", F.when(F.col("bits") > 0, F.expr(f"shiftrightunsigned(bucket, {HASHES - 1} - bits)")).otherwise(0))
        .groupBy("l", "d", "even", "bits", "bucket")
        .agg(F.sum("n").cast("double").alias("n"))
        .groupBy("l", "d", "even", "bits")
        .agg(
            (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd"),
            F.sum(F.col("n") * (SEND * F.greatest(F.lit(1.0), F.col("n") / CELL) + F.col("n") / 2)).alias("work"),
        )
    )
    return (
        stored.table(by_bits, "by-bits")
        .withColumn("passes", passes)
        .groupBy("l", "d")
        .agg(
            F.max(F.when(F.col("bits") == F.col("even"), F.col("crowd"))).alias("crowd"),
            F.min_by(F.struct("bits", "passes"), F.struct(F.col("work") * F.col("passes"), "bits")).alias("cheap"),
            F.min_by(F.struct("bits", "passes"), F.abs(F.col("bits") - F.col("even"))).alias("plain"),
        )
        .withColumn("chosen", F.when(F.col("crowd") > CROWDED * WINDOW, F.col("cheap")).otherwise(F.col("plain")))
        .select("l", "d", "chosen.bits", "chosen.passes")
    )


def _pass_links(heads: DataFrame, stored: Stored) -> DataFrame:
    """``a, b``: pairs of classes at ``SIMILAR`` or more that join those found in any pass."""
    plan = stored.table(_plan(heads, stored), "plan")
    planned = heads.join(plan, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d"))).select(
        "label", "dims", "cls", "unit", "bits", "passes"
    )
    full = stored.table(
        planned.mapInArrow(_turns(narrow=True), _NARROW)
        .groupBy(*_BUCKET)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > CELL)
        .select(F.xxhash64(*_BUCKET).alias("full_key"), F.ceil(F.col("n") / CELL).cast("int").alias("blocks")),
        "full",
    )
    rows = planned.mapInArrow(_turns(narrow=False), _WIDE).withColumn("key", F.xxhash64(*_BUCKET))
    windows = (
        without(rows, "key", full.select("full_key"))
        .drop("key")
        .repartitionByRange(*_BUCKET)
        .sortWithinPartitions(*_BUCKET, "sort_key", "cls")
        .mapInArrow(_window_links, "a bigint, b bigint")
    )
    own = F.pmod(F.xxhash64("cls"), "blocks").cast("int")
    cells = (
        in_map(rows, "key", key_map(full.select("full_key")))
        .join(full, F.col("key") == F.col("full_key"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            *_BUCKET, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") <= F.col("other")).alias("left"), "cls", "unit",
        )
        .repartition(*_BUCKET, "i", "j")
        .sortWithinPartitions(*_BUCKET, "i", "j")
        .mapInArrow(_cell_links, "a bigint, b bigint")
    )
    return windows.unionByName(cells).distinct()


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the vectors of one component block with those of another, or among themselves."""
    for cell in runs(batches, ["root", "i", "j"]):
        size = cell.column("dims")[0].as_py()
        unit = _units(cell.column("unit").to_pylist(), size)
        copies = cell.column("copies").to_numpy()
        left = cell.column("left").to_numpy()
        if cell.column("i")[0].as_py() == cell.column("j")[0].as_py():
            linked = unit @ unit.T >= SIMILAR
            np.fill_diagonal(linked, False)
            counts = linked @ copies
        else:
            linked = unit[left] @ unit[~left].T >= SIMILAR
            counts = np.zeros(len(unit), np.int64)
            counts[left] = linked @ copies[~left]
            counts[~left] = linked.T @ copies[left]
        yield pa.RecordBatch.from_arrays(
            [cell.column("cls").combine_chunks(), pa.array(counts.astype(np.int64))], ["cls", "n"]
        )


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    spark = embeddings.sparkSession
    stored = Stored(spark, "vectors")
    plain = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    usable = stored.table(
        plain.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(
            _usable, "vec_id bigint, label string, dims int, vec_key binary, unit binary"
        ),
        "usable",
    )
    classes = stored.table(
        usable.groupBy("vec_key").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    heads = stored.table(
        usable.join(classes.select(F.col("vec_key").alias("k"), F.col("cls").alias("vec_id"), "copies"), "vec_id")
        .where("vec_key = k")
        .select(F.col("vec_id").alias("cls"), "copies", "label", "dims", "unit")
        .dropDuplicates(["cls"]),
        "heads",
    )
    links = stored.table(_pass_links(heads, stored), "links")
    roots = stored.table(components(links, stored), "roots")
    counts = _component_counts(heads, roots, stored)
    by_class = stored.table(
        classes.select(F.col("vec_key").alias("k"), "cls", "copies")
        .join(roots, F.col("cls") == F.col("node"), "left")
        .join(counts.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c"), "left")
        .select(
            "k", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("component_id")
        ),
        "by-class",
    )
    linked = usable.select("vec_id", "vec_key").join(by_class, F.col("vec_key") == F.col("k")).select(
        "vec_id", "n_links", "component_id"
    )
    # rows that cannot link: told by the same test, not by their absence, as ids may repeat
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    fit = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(numbers, lambda x: x != 0)
    )
    alone = plain.where(~F.coalesce(fit, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _component_counts(heads: DataFrame, roots: DataFrame, stored: Stored) -> DataFrame:
    """``cls, links``: exact number of vectors linked with each class, its own copies left out."""
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = (
        heads.join(roots, F.col("cls") == F.col("node"))
        .join(stored.table(sizes, "sizes").withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
        .select("root", "cls", "copies", "dims", "unit", "blocks", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("own"))
    )
    cells = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("left"), "cls", "copies", "dims", "unit",
    )
    return (
        cells.repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
        .mapInArrow(_block_counts, "cls bigint, n bigint")
        .groupBy("cls")
        .agg(F.sum("n").alias("links"))
    )
