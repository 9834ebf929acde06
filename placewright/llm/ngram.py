"""Language-model scores from a log-frequency Bloom filter.

Bigram counts of the training documents are quantised to ``q = 1 + floor(log2 count)``; the filter holds the pairs
(bigram, 1) to (bigram, q) of every bigram, those seen once as well. A worker finds a count again by probing levels until one is
missing; level zero is a bigram never seen. A level stands for its least count, so a pair is never held to be more frequent than its
first word. Scores are log10 probabilities under bigrams with Dirichlet smoothing over
unigrams, a document boundary before the first and after the last word.

The filter grows with the corpus: bits an entry are fixed, so the chance of a false level is the same at every size. It is
built in segments by hash of the bigram. ``FILTER_BYTES`` of segments at a time are broadcast; each such pass reads the texts where they lie and
scores the tokens whose bigram belongs to these segments. The logarithm of a smoothed probability is a term of the pair and its second word less one of the
first word, so every token's share is known in one pass, and only sums by row leave a task. A corpus whose filter fits takes one pass.

Unigram counts are exact. The words of most counts (``FREQUENT`` of them at most, 16 bytes each) go to every
worker; the terms of all other words are joined with the table of counts, for the base score and the model alike.

Words are runs of anything but blanks, tabs and line separators, A-Z as a-z, known by 64-bit
hashes. A null text is an empty one: its only token is the end. Documents without an id train and are not held out.
Repeated rows each give a row and each count in training. An empty training set has N = V = 0 and gives base scores of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Stored, hashed_words, mixed, runs

#: Bytes of the filter that a worker holds at a time.
FILTER_BYTES = 64 << 20
BITS_AN_ENTRY = 10
PROBES = 3
SEGMENT_ROWS = 500_000
#: Tokens that a task counts together before it hands counts on.
COUNTED_TOKENS = 1_500_000
FREQUENT = 1_000_000
#: Weight of the unigrams in the smoothing of bigrams, in counts.
SMOOTHING = 50.0
#: Hash of the end of a document, which is also the context of its first word.
END = np.uint64(0x0B5E55ED0DDBA115)


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, tokens, cuts)``: words and one end of each text, a few rows at a time."""
    for row, hashes, cuts, _, _ in hashed_words(texts, fold=True):
        n = np.diff(cuts)
        ends = np.cumsum(n + 1)
        out = np.empty(len(hashes) + len(n), np.uint64)
        word = np.ones(len(out), bool)
        word[ends - 1] = False
        out[word] = hashes
        out[~word] = END
        yield row, out, np.concatenate([[0], ends])


def bigrams(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first follows an end."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[cuts[:-1]] = END
    with np.errstate(over="ignore"):
        return mixed(before * np.uint64(0x9E3779B97F4A7C15) + values)


def _counted(size: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    found, count = np.unique(np.concatenate(parts), return_counts=True)
    for start in range(0, len(found), 250_000):
        h = found[start : start + 250_000].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h), size, np.int8)), pa.array(h), pa.array(count[start : start + 250_000])],
            ["size", "h", "n"],
        )


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        singles, pairs, held = [], [], 0
        for _, values, cuts in tokens(batch.column("text")):
            singles.append(values)
            pairs.append(bigrams(values, cuts))
            held += len(values)
            if held >= COUNTED_TOKENS:
                yield from _counted(1, singles)
                yield from _counted(2, pairs)
                singles, pairs, held = [], [], 0
        if singles:
            yield from _counted(1, singles)
            yield from _counted(2, pairs)


def _segment(h: np.ndarray, count: int) -> np.ndarray:
    return h.view(np.int64) % count


def _positions(key: np.ndarray, level: np.ndarray | int, probe: int, size: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = key + np.uint64(0xD6E8FEB86659FD93) * (np.asarray(level).astype(np.uint64) * np.uint64(8) + np.uint64(probe + 1))
    return mixed(key) % np.asarray(size).astype(np.uint64)


def _segments(bits_an_entry: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["seg"]):
            h = part.column("h").to_numpy().astype(np.int64).view(np.uint64)
            q = part.column("q").to_numpy()
            size = max(64, int(q.sum() * bits_an_entry) // 8 * 8)
            bits = np.zeros(size, bool)
            for level in range(1, int(q.max()) + 1):
                held = h[q >= level]
                for probe in range(PROBES):
                    bits[_positions(held, level, probe, size)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("seg")[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                ["seg", "bits"],
            )

    return run


class CountFilter:
    """Segments of the filter as one array, and the way to ask it."""

    def __init__(self, segments: dict[int, bytes], count: int, greatest: int = 63, first: int = 0):
        held = sorted(segments)
        sizes = np.zeros(count, np.int64)
        sizes[np.array(held, np.int64) - first] = [len(segments[s]) for s in held]
        self.bits = np.frombuffer(b"".join(segments[s] for s in held), np.uint8)
        self.size, self.start = sizes * 8, np.cumsum(sizes * 8) - sizes * 8
        self.greatest = greatest

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level of each n-gram, by probing from one upwards until a miss or the greatest stored level."""
        return self.probed(_segment(h, len(self.size)), h)

    def probed(self, seg: np.ndarray, key: np.ndarray) -> np.ndarray:
        found = np.zeros(len(key), np.int64)
        if not len(self.bits):
            return found
        left = np.flatnonzero(self.size[seg] > 0)
        level = 1
        while len(left) and level <= self.greatest:
            for probe in range(PROBES):
                at = self.start[seg[left]] + _positions(key[left], level, probe, self.size[seg[left]]).astype(np.int64)
                left = left[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            found[left] = level
            level += 1
        return found


def least_count(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; zero for level zero."""
    return np.where(levels > 0, np.exp2(levels - 1.0), 0.0)


SCORED = (
    "row_key bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, "
    "score double, rare array<struct<h:bigint,level:tinyint,n:int>>"
)


def _sums(values: np.ndarray, cuts: np.ndarray, asked: np.ndarray, held: CountFilter, first: int, count: int, words, room: float):
    """Sums by row over the tokens at ``asked``, and the terms of words that are not among the frequent ones."""
    frequent, counts = words
    size = len(cuts) - 1
    owner = np.repeat(np.arange(size), np.diff(cuts))[asked]
    grams, place = np.unique(bigrams(values, cuts)[asked], return_inverse=True)
    level = held.probed(_segment(grams, count) - first, grams)[place]
    distinct, place = np.unique(values[asked], return_inverse=True)
    if len(frequent):
        spot = np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)
        sure = frequent[spot] == distinct
        exact = np.where(sure, counts[spot], 0)
    else:
        sure, exact = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
    mine = sure[place]
    one = (exact + 1) / room
    # the token's place in its own pair, and what it adds as the word before the next
    term = np.log10(least_count(level) + SMOOTHING * one[place]) - np.log10(exact + SMOOTHING)[place]
    total = lambda x: np.bincount(owner, np.where(mine, x, 0.0), minlength=size).astype(float)
    rest = np.flatnonzero(~mine)
    word = distinct[place[rest]]
    by = np.lexsort([level[rest], word, owner[rest]])
    word, own, lev = word[by], owner[rest][by], level[rest][by]
    fresh = np.append(True, (word[1:] != word[:-1]) | (own[1:] != own[:-1]) | (lev[1:] != lev[:-1]))[: len(by)]
    begin = np.flatnonzero(fresh)
    n = np.diff(np.append(begin, len(by))).astype(np.int32)
    listed = np.concatenate([[0], np.cumsum(np.bincount(own[begin], minlength=size))]).astype(np.int32)
    rare = pa.ListArray.from_arrays(
        listed,
        pa.StructArray.from_arrays(
            [pa.array(word[begin].view(np.int64)), pa.array(lev[begin].astype(np.int8)), pa.array(n)], ["h", "level", "n"]
        ),
    )
    tokens_of = np.bincount(owner, minlength=size)
    known = np.bincount(owner, mine & (exact[place] > 0), minlength=size)
    return tokens_of, known, total(np.log10(one)[place]), total(term), rare


def _scores(part, words, first: int, last: int, count: int, greatest: int, room: float):
    """Shares of the rows in the tokens whose bigram lies in segments ``first`` to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = CountFilter(part.value, max(last - first, 1), greatest, first)
        for batch in batches:
            for row, values, cuts in tokens(batch.column("text")):
                seg = _segment(bigrams(values, cuts), count)
                asked = np.flatnonzero((seg >= first) & (seg < last))
                n, known, base, score, rare = _sums(values, cuts, asked, held, first, count, words.value, room)
                rows = [batch.column(k).slice(row, len(n)) for k in ("row_key", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), rare],
                    ["row_key", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
                )

    return run


def score_documents(documents: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document."""
    spark = documents.sparkSession
    stored = Stored(spark, "ngram")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("row_key", F.xxhash64("doc_id", "text"))
    grams = rows.where("not held_out").select("text").mapInArrow(_gram_counts, "size tinyint, h bigint, n bigint")
    counts = stored.table(grams.groupBy("size", "h").agg(F.sum("n").alias("n")), "counts")
    ones = counts.where("size = 1")
    total, distinct = ones.select(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    room = float(total + distinct + 1)
    levels = counts.where("size = 2").select("h", F.length(F.bin("n")).alias("q"))
    kept, entries, greatest = levels.select(
        F.count(F.lit(1)), F.coalesce(F.sum("q"), F.lit(0)), F.coalesce(F.max("q"), F.lit(0))
    ).first()
    count = max(1, -(-kept // SEGMENT_ROWS))
    built = stored.table(
        levels.withColumn("seg", F.pmod("h", F.lit(count)))
        .repartition(count, "seg")
        .sortWithinPartitions("seg")
        .mapInArrow(_segments(BITS_AN_ENTRY), "seg bigint, bits binary"),
        "filter",
    )
    least = _least_frequent(ones)
    top = ones.where(F.col("n") >= least).select("h", "n").toArrow()  # FREQUENT rows at most
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    words = spark.sparkContext.broadcast((h[order], top.column("n").to_numpy()[order].astype(np.int64)))
    step = max(1, int(count * FILTER_BYTES // max(entries * BITS_AN_ENTRY // 8, 1)))
    shares, passes = None, range(0, count, step)
    for first in passes:
        last = min(first + step, count)
        # about FILTER_BYTES at a time
        part = {r["seg"]: bytes(r["bits"]) for r in built.where((F.col("seg") >= first) & (F.col("seg") < last)).toLocalIterator()}
        held = spark.sparkContext.broadcast(part)
        found = stored.table(rows.mapInArrow(_scores(held, words, first, last, count, greatest, room), SCORED), "shares")
        shares = found if shares is None else shares.unionByName(found)
        held.unpersist()
    term = F.log10(
        F.when(F.col("level") > 0, F.pow(F.lit(2.0), F.col("level") - 1)).otherwise(0.0) + SMOOTHING * (F.col("c") + 1) / room
    ) - F.log10(F.col("c") + SMOOTHING)
    # equal rows share a key and have equal sums, so copies are counted and divided out
    keys = ["row_key", "doc_id", "held_out"]
    rare = (
        shares.select(*keys, F.explode("rare").alias("r"))
        .select(*keys, F.col("r.h").alias("h"), F.col("r.level").alias("level"), F.col("r.n").alias("n"))
        .join(ones.where(F.col("n") < least).select(F.col("h").alias("w"), F.col("n").alias("c0")), F.col("h") == F.col("w"), "left")
        .withColumn("c", F.coalesce("c0", F.lit(0)))
        .select(
            *keys, F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_tokens"),
            F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("known"),
            (F.col("n") * F.log10((F.col("c") + 1) / room)).alias("base"), (F.col("n") * term).alias("score"),
        )
    )
    summed = (
        shares.select(*keys, F.lit(1).cast("long").alias("rows"), "n_tokens", "known", "base", "score")
        .unionByName(rare)
        .groupBy(*keys)
        .agg(*(F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "base", "score")))
        .withColumn("copies", (F.col("rows") / len(passes)).cast("int"))
    )
    return summed.select(
        "doc_id", "held_out", (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def _least_frequent(words: DataFrame) -> int:
    """The least count such that at most ``FREQUENT`` words have it or a higher one."""
    # powers of two and the counts between them in 16 steps: a few hundred rows
    step = F.floor(F.log2("n") * 16).cast("int")
    by_step = words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("s")).collect()
    held, least = 0, 1 << 62
    for r in by_step:
        held += r["words"]
        if held > FREQUENT:
            break
        least = r["least"]
    return least
