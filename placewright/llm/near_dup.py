"""Near duplicates of whole texts by order MinHash and banded alignment.

A text is the list of its words (case kept), its shingles are all runs of five
words, each labelled with its occurrence number. A sketch takes, for each of
``BANDS`` hash functions, the ``TAKEN`` shingles of least hash *in the order
of the text*: two texts share a band if they share those shingles in that order. Candidate pairs are then
aligned: the longest common subsequence of their shingles, occurrence numbers left
out, so a passage that one text has twice and the other once meets its like wherever it stands. Shingles that may stay unaligned at
0.8 bound the diagonals that are looked at. The similarity is aligned / (all shingles of both - aligned), and
0.8 or more is a link. Groups are the connected components of links.

Equal word lists are one class from the start, so copies are never paired.
In a bucket every class is first compared with one leader, the class of most copies.
Buckets that still hold several components then compare, in blocks, the
classes outside their main component with all others, so that no pair of a
bucket stays open whose classes are not already in one component. A
signature of 128 MinHash bytes decides there which pairs are aligned.

Nulls and edges: a null or wordless text is in a group of its own (never a
duplicate); texts under five words are one shingle; rows with a null ``doc_id``
are kept as groups of their own; rows repeating a ``doc_id`` get one row each, and if
their texts differ, one of the texts stands for the id in comparisons.
Only ``doc_id`` and ``text`` of the input are read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Stored, components, hashed_words, labelled, mixed, only, ragged, runs, shingles

WIDTH = 5
SIMILAR = 0.8
#: Hash functions of the sketch and shingles taken by each: a pair at 0.8 shares a
#: band with 0.41, and none of 16 with 2 in 10,000.
BANDS = 16
TAKEN = 4
#: MinHash bytes per text; below the floor a pair at 0.8 falls by chance 3 times in 10,000.
SIGNATURE = 128
FLOOR = 0.68
#: Classes of a bucket side in one block comparison.
BLOCK = 1024

_RANDOM = np.random.default_rng(20)
_ODD = (_RANDOM.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RANDOM.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32)

SKETCH = "doc_id bigint, text_key binary, n_shingles int, bands array<bigint>, signature binary"


def text_shingles(texts: pa.Array, labels: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, word hashes and shingles of every text that has a word, labelled or as they are."""
    for first, hashes, cuts, _, _ in hashed_words(texts):
        for k in range(len(cuts) - 1):
            words = hashes[cuts[k] : cuts[k + 1]]
            if len(words):
                found = shingles(words, WIDTH)
                yield first + k, words, labelled(found) if labels else found


def sketch(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and signature of a text's labelled shingles."""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    least = np.empty(SIGNATURE, np.uint32)
    keys = np.empty(BANDS, np.uint64)
    taken = min(TAKEN, len(values))
    step = max(1, 65_536 // len(low))
    with np.errstate(over="ignore"):
        for start in range(0, SIGNATURE, step):
            stop = min(start + step, SIGNATURE)
            hashed = low[None, :] * _ODD[start:stop, None] + _ADD[start:stop, None]
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x2C1B3C6D)
            least[start:stop] = hashed.min(axis=1)
            if start < BANDS:
                rows = min(stop, BANDS) - start
                if taken < len(low):
                    spots = np.argpartition(hashed[:rows], taken - 1, axis=1)[:, :taken]
                    spots.sort(axis=1)
                else:
                    spots = np.tile(np.arange(taken), (rows, 1))
                chosen = values[spots]
                key = np.arange(start, start + rows, dtype=np.uint64)
                for k in range(taken):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k]
                keys[start : start + rows] = mixed(key)
    least ^= least >> np.uint32(16)
    least ^= least >> np.uint32(8)
    return keys.view(np.int64), least.astype(np.uint8).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column("doc_id").to_pylist(), []
        for row, words, values in text_shingles(batch.column("text")):
            key = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
            out.append((ids[row], key, len(values), *sketch(values)))
        if out:
            doc_id, key, n, bands, signature = zip(*out)
            flat = np.concatenate(bands)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_id, pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(n, pa.int32()),
                    pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat),
                    pa.array(signature, pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "bands", "signature"],
            )


def _common(one: np.ndarray, two: np.ndarray, apart: int) -> int:
    """Length of the longest common subsequence, if it leaves at most ``apart`` shingles of both unaligned.

    An alignment that leaves ``d`` shingles out stays within ``d`` diagonals, so a band of that width holds it. Narrow bands come
    first and a band is wide enough once what it leaves out fits in it: the time is the length times the differences over the
    machine word, the memory one bit a diagonal. Beyond ``apart`` the result is some smaller number.
    """
    shift = len(two) - len(one)
    apart = min(apart, len(one) + len(two))
    if abs(shift) > apart:
        return 0
    width = min(apart, abs(shift) + 64)
    while True:
        found = _in_band(one, two, (width - shift) // 2, (width + shift) // 2)
        if width >= apart or len(one) + len(two) - 2 * found <= width:
            return found
        width = min(apart, 4 * width)


def _in_band(one: np.ndarray, two: np.ndarray, below: int, above: int) -> int:
    """Longest common subsequence over places (i, j), those with -below <= j - i <= above included, bit by bit.

    ``row`` has a zero at every place of the window where the length grows; zeros that leave the window are counted in ``passed``.
    The window moves on every ``step`` rows and is that much wider than the band.
    """
    places = np.argsort(two, kind="stable")
    ranked = two[places]
    begin, end = np.searchsorted(ranked, one, "left").tolist(), np.searchsorted(ranked, one, "right").tolist()
    step = 1 + (below + above) // 16
    spread = below + above + step
    whole, entered = (1 << spread) - 1, ((1 << step) - 1) << (spread - step)
    row, passed, start = whole, 0, -below
    often: dict[int, int] = {}
    for i, (a, b) in enumerate(zip(begin, end)):
        if i and i % step == 0:
            passed += step - (row & ((1 << step) - 1)).bit_count()
            row = (row >> step) | entered
            start += step
        if b - a == 1:
            spot = int(places[a]) - start
            at = 1 << spot if 0 <= spot < spread else 0
        else:
            held = places[a:b]
            if 256 * (b - a) >= len(two):
                # at most 256 shingles are this frequent
                if a not in often:
                    often[a] = _mask(held)
                at = (often[a] >> start if start > 0 else often[a] << -start) & whole
            else:
                low, high = np.searchsorted(held, [start, start + spread])
                at = _mask(held[low:high] - start)
        met = row & at
        if met:
            row = ((row + met) | (row - met)) & whole
    return passed + spread - row.bit_count()


def _mask(places: np.ndarray) -> int:
    """An integer with the bits of rising ``places`` set."""
    if not len(places):
        return 0
    bits = np.zeros(int(places[-1]) // 8 + 1, np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "little")


def similarity(one: np.ndarray, two: np.ndarray, at_least: float = SIMILAR) -> float:
    """Similarity by alignment of shingles; 0 if below ``at_least``.

    Where neither text repeats a shingle that both have, the alignment is the longest increasing run of
    the places of one in the order of the other.
    """
    total = len(one) + len(two)
    needed = at_least * total / (1 + at_least) - 1e-9
    if min(len(one), len(two)) < needed:
        return 0.0
    # equal ends are part of some best alignment
    short = min(len(one), len(two))
    differs = np.flatnonzero(one[:short] != two[:short])
    head = int(differs[0]) if len(differs) else short
    one, two, short = one[head:], two[head:], short - head
    differs = np.flatnonzero(one[len(one) - short :][::-1] != two[len(two) - short :][::-1])
    tail = int(differs[0]) if len(differs) else short
    one, two = one[: len(one) - tail], two[: len(two) - tail]
    ends = head + tail
    _, in_one, in_two = np.intersect1d(one, two, return_indices=True)
    held_one, held_two = np.isin(one, one[in_one]), np.isin(two, two[in_two])
    one, two = one[held_one], two[held_two]
    if ends + min(len(one), len(two)) < needed:
        return 0.0
    if len(one) == len(in_one) and len(two) == len(in_two):
        _, at_one, at_two = np.intersect1d(one, two, assume_unique=True, return_indices=True)
        path = at_two[np.argsort(at_one)]
        if len(path) > 1 and (np.diff(path) < 0).any():
            tails: list[int] = []
            for spot in path.tolist():
                where = bisect.bisect_left(tails, spot)
                if where == len(tails):
                    tails.append(spot)
                else:
                    tails[where] = spot
            aligned = ends + len(tails)
        else:
            aligned = ends + len(path)
    else:
        # the shingles that may stay unaligned bound the band
        aligned = ends + _common(one, two, int(np.floor(len(one) + len(two) + 2 * ends - 2 * needed)))
    found = aligned / (total - aligned)
    return found if found >= at_least - 1e-12 else 0.0


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            ones = dict((row, values) for row, _, values in text_shingles(part.column("text_a"), labels=False))
            found = [
                (row, similarity(ones[row], values))
                for row, _, values in text_shingles(part.column("text_b"), labels=False)
            ]
            links = [(row, value) for row, value in found if value]
            if links:
                rows, values = zip(*links)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(pa.array(rows)), part.column("b").take(pa.array(rows)), pa.array(values)],
                    ["a", "b", "similarity"],
                )


def _candidates(cell: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a cell in different components that are alike enough to be aligned.

    A pair that shares several buckets is taken in that of its first shared band only.
    """
    minor = cell.column("minor").to_numpy()
    names = cell.column("cls").to_numpy()
    roots = cell.column("root").to_numpy()
    sizes = cell.column("n_shingles").to_numpy().astype(float)
    bucket = cell.column("bucket")[0].as_py()
    bits = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    rest = np.flatnonzero(~minor)
    for k in np.flatnonzero(minor).tolist():
        near = rest[(roots[rest] != roots[k]) & (names[rest] != names[k])]
        near = near[np.minimum(sizes[near], sizes[k]) >= SIMILAR * np.maximum(sizes[near], sizes[k])]
        if not len(near):
            continue
        alike = (bits[near] == bits[k]).mean(axis=1)
        near, alike = near[alike >= FLOOR], alike[alike >= FLOOR]
        first = (bands[near] == bands[k]).argmax(axis=1)
        mine = bands[k][first] == bucket
        near, alike = near[mine], alike[mine]
        if len(near):
            yield k, near[np.argsort(-alike, kind="stable")]


CELL = "bucket bigint, i int, j int, cls bigint, root bigint, minor boolean, n_shingles int, bands array<bigint>, signature binary"


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of cells that are in some candidate pair."""
    for cell in runs(batches, ["bucket", "i", "j"]):
        used = np.zeros(cell.num_rows, bool)
        for k, near in _candidates(cell):
            used[k] = True
            used[near] = True
        if used.any():
            yield from cell.filter(pa.array(used)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a cell that its links join, each with the least of them; at most one less than it has rows."""
    for cell in runs(batches, ["bucket", "i", "j"]):
        plain = [found for _, _, found in text_shingles(cell.column("text").combine_chunks(), labels=False)]
        # shared labelled shingles count what can be aligned at most
        values = [labelled(found) for found in plain]
        count = np.array([len(v) for v in values])
        starts = np.cumsum(count) - count
        _, number = np.unique(np.concatenate(values), return_inverse=True)
        own = np.zeros(number.max() + 1, bool)
        roots = cell.column("root").to_pylist()
        parent: dict[int, int] = {}

        def top(node: int) -> int:
            while parent.get(node, node) != node:
                parent[node] = parent.get(parent[node], parent[node])
                node = parent[node]
            return node

        for k, near in _candidates(cell):
            mine = number[starts[k] : starts[k] + count[k]]
            own[mine] = True
            held = own[ragged(number, starts[near], count[near])]
            own[mine] = False
            shared = np.add.reduceat(held, np.cumsum(count[near]) - count[near], dtype=np.int64)
            near = near[shared >= SIMILAR * (count[near] + count[k]) / (1 + SIMILAR) - 1e-9]
            for other in near.tolist():
                one, two = top(roots[k]), top(roots[other])
                if one != two and similarity(plain[k], plain[other]):
                    parent[max(one, two)] = min(one, two)
        if parent:
            joined = [top(root) for root in parent]
            yield pa.RecordBatch.from_arrays([pa.array(joined, pa.int64()), pa.array(list(parent), pa.int64())], ["a", "b"])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id, group_id, class_size, kept``.

    ``class_id`` is the least doc_id with the same words, ``group_id`` the least
    of the connected group, ``kept`` true on the row with doc_id = group_id (the first
    of repeated rows of that id is not told apart: all of them are kept).
    """
    spark = documents.sparkSession
    stored = Stored(spark, "near-dup")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stored.table(texts.where("doc_id is not null").mapInArrow(_sketches, SKETCH), "sketches")
    # the same words give the same sketch, whichever row it is taken from
    classes = stored.table(
        sketches.groupBy("text_key").agg(
            F.min("doc_id").alias("cls"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "classes",
    )
    heads = stored.table(
        sketches.join(classes.select(F.col("cls").alias("doc_id"), F.col("text_key").alias("k"), "copies"), "doc_id")
        .where("text_key = k")
        .select(F.col("doc_id").alias("cls"), "copies", "n_shingles", "bands", "signature")
        .dropDuplicates(["cls"]),
        "heads",
    )
    rows = heads.select(F.explode("bands").alias("bucket"), "cls")
    # most buckets hold one class: bare keys tell which do not, before anything else is moved
    full = stored.table(
        rows.groupBy("bucket").agg(F.min("cls").alias("m"), F.max("cls").alias("n")).where("m <> n").select(F.col("bucket").alias("k")),
        "full",
    )
    shared = stored.table(
        rows.join(full, F.col("bucket") == F.col("k"), "left_semi").join(heads.select("cls", "copies", "n_shingles"), "cls"),
        "shared",
    )
    leaders = stored.table(
        shared.groupBy("bucket")
        .agg(F.max(F.struct("copies", (-F.col("cls")).alias("m"), "n_shingles")).alias("lead"))
        .select(F.col("bucket").alias("k"), (-F.col("lead.m")).alias("leader"), F.col("lead.n_shingles").alias("n_leader")),
        "leaders",
    )
    alike = F.least("n_shingles", "n_leader") >= SIMILAR * F.greatest("n_shingles", "n_leader")
    first = (
        shared.join(leaders, F.col("bucket") == F.col("k"))
        .where(F.col("cls") != F.col("leader"))
        .where(alike)
        .select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
    )
    roots = stored.table(components(_verified(first.distinct(), texts, stored), stored), "roots")
    # the second links join whole components, so only their roots are grouped again
    groups = components(_open(shared, heads, roots, texts, stored), stored).select(F.col("node").alias("r"), F.col("root").alias("g"))
    placed = classes.join(roots, F.col("cls") == F.col("node"), "left").select(
        "text_key", "cls", F.coalesce("root", "cls").alias("root"), "copies"
    )
    named = placed.join(groups, F.col("root") == F.col("r"), "left").select(
        F.col("text_key").alias("k"), "cls", F.coalesce("g", "root").alias("group_id"), "copies"
    )
    members = sketches.select("doc_id", "text_key").join(named, F.col("text_key") == F.col("k")).select(
        "doc_id", F.col("cls").alias("class_id"), "group_id", F.col("copies").alias("class_size")
    )
    wordless = texts.where(
        F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("class_size")
    )
    return members.unionByName(wordless).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True))
    )


def _verified(pairs: DataFrame, texts: DataFrame, stored: Stored) -> DataFrame:
    """Pairs that the alignment accepts. Texts of paired classes only are moved."""
    pairs = stored.table(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("wanted_id")).distinct()
    held = stored.table(
        only(texts, "doc_id", wanted).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["doc_id"]),
        "texts",
    )
    with_b = pairs.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(
        _aligned, "a bigint, b bigint, similarity double"
    )


def _open(shared: DataFrame, heads: DataFrame, roots: DataFrame, texts: DataFrame, stored: Stored) -> DataFrame:
    """Links between components within buckets that hold more than one, as pairs of roots.

    Classes outside a bucket's main component are compared with all of the bucket, in cells of
    about ``BLOCK`` classes a side at most. Cells first go through on signatures; texts follow for
    the classes that then have a candidate.
    """
    placed = stored.table(
        shared.select("bucket", "cls")
        .join(roots, F.col("cls") == F.col("node"), "left")
        .select("bucket", "cls", F.coalesce("root", "cls").alias("root")),
        "placed",
    )
    sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed_buckets = stored.table(
        sizes.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
        # a bucket of two classes has been compared in full
        .where("roots > 1 and n > 2")
        .select(
            F.col("bucket").alias("k"),
            F.col("main.root").alias("main"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"),
            F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("minor_blocks"),
        ),
        "mixed",
    )
    inside = placed.join(mixed_buckets, F.col("bucket") == F.col("k")).drop("k")
    spot = F.xxhash64("cls")
    as_all = inside.select(
        "bucket", "cls", "root", F.pmod(spot, "all_blocks").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("j"), F.lit(False).alias("minor"),
    )
    as_minor = inside.where("root <> main").select(
        "bucket", "cls", "root", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("i"),
        F.pmod(spot, "minor_blocks").cast("int").alias("j"), F.lit(True).alias("minor"),
    )
    cells = as_all.unionByName(as_minor).join(heads.select("cls", "n_shingles", "bands", "signature"), "cls")
    wanted = stored.table(_by_cell(cells).mapInArrow(_wanted, CELL), "wanted")
    held = only(texts, "doc_id", wanted.select(F.col("cls").alias("wanted_id")).distinct()).where(
        F.col("text").rlike(r"[^\x20\x09-\x0D]")
    )
    with_text = wanted.join(held.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "d"), F.col("cls") == F.col("d"))
    return _by_cell(with_text, "text").mapInArrow(_linked, "a bigint, b bigint")


def _by_cell(rows: DataFrame, *more: str) -> DataFrame:
    return (
        rows.select("bucket", "i", "j", "cls", "root", "minor", "n_shingles", "bands", "signature", *more)
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )
