"""Spelling variants: words one edit apart, found by walking a trie with joins.

Words and their counts come from runs of letters, counted where the text lies and added up by Spark. The trie is an edge table: one
row per prefix, with the lengths of the words below it and whether it is a word. States (word, place, node, edits) are joined
with it level by level. Along its own path a word needs no look-up, so states without an edit branch off directly, by a
join of the word's prefix with its children; a state with its one edit follows the rest of its word, one equi join a level. A state that has used
up its word at a node that is a word is a pair of neighbours.

The edit of a pair lies in the back half of the two words or, read backwards, in that of the reversed ones. So each word is walked from both ends, and
branches off in its back half only, where few words share its prefix: the wide levels near the root are never entered. A pair is looked for from
one side: the greater letter is put in, or a letter of the longer word is left out. Each level is written before the next one is joined.

Words of more than ``LEVELS`` code points, where a walk would take as many rounds, are paired by hashes of what is left without one code point (linear in the
word) and checked code point by code point; two words that agree but for one place are at most as many as there are letters.

A null text has no words, a null id is read as an empty one. Repeated rows count each. An empty table, or one without a word of ``LEAST_LENGTH`` code
points and ``LEAST_COUNT`` uses, gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Stored, mixed

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Longest words that are walked through the trie.
LEVELS = 48
RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Code points read at a time, and different words a task counts together.
PART = 1 << 20
HELD = 300_000


def _runs(text: str) -> Iterator[list[str]]:
    """Runs of letters, in parts that end between runs."""
    start = 0
    while start < len(text):
        cut = NO_LETTER.search(text, start + PART) if len(text) - start > PART else None
        end = cut.start() if cut else len(text)
        yield RUN.findall(text, start, end)
        start = end


def _counts(sides: int):
    def table(counts: Counter) -> pa.RecordBatch:
        kept = {w: n for w, n in counts.items() if n > 0 and len(w) >= LEAST_LENGTH}
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for head, text in zip(batch.column("head").to_pylist(), batch.column("text")):
                begin = zlib.crc32(head.encode())
                low = text.as_buffer().to_pybytes().translate(SMALL).decode() if text.is_valid else ""
                for words in _runs(low):
                    counts.update(words)
                    for word in set(words):
                        mark = zlib.crc32(word.encode(), begin)
                        if mark % sides == 0:
                            uses, place = words.count(word), mark % len(word)
                            counts[word] -= uses
                            counts[word[:place] + word[place + 1 :]] += uses
                if len(counts) >= HELD:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    return run


def word_counts(documents: DataFrame, sides: int = 97) -> DataFrame:
    """``word, n`` of all words; where the checksum of id and run says so, a run has lost a code point."""
    head = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    rows = documents.select(head.alias("head"), F.col("text").cast("string").alias("text"))
    return (
        rows.mapInArrow(_counts(sides), "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _prefix(length: Column | int) -> Column:
    return F.substring("e", F.lit(1), F.lit(length) if isinstance(length, int) else length)


def _letter(place: Column | int) -> Column:
    """The letter of ``e`` at a place counted from zero."""
    return F.substring("e", (F.lit(place) if isinstance(place, int) else place) + 1, F.lit(1))


def _walked(words: DataFrame, stored: Stored) -> DataFrame:
    """``a, b``: each pair of near words of at most ``LEVELS`` code points, once or twice."""
    both = F.array(
        F.struct(F.lit(False).alias("back"), F.col("word").alias("e")),
        F.struct(F.lit(True).alias("back"), F.reverse("word").alias("e")),
    )
    entries = stored.table(
        words.where(F.length("word") <= LEVELS).select(F.explode(both).alias("x")).select("x.*").withColumn("len", F.length("e")),
        "entries",
    )
    longest = entries.agg(F.max("len")).first()[0] or 0
    # states begin at half a word, so shorter prefixes are never asked for
    least = LEAST_LENGTH // 2 + 1
    folder = f"{stored.base}/edges-{uuid.uuid4().hex[:8]}"
    (
        entries.select("back", "e", "len", F.explode(F.sequence(F.lit(least), "len")).alias("depth"))
        .select("back", "depth", _prefix(F.col("depth")).alias("child"), "len")
        .groupBy("depth", "back", "child")
        .agg(
            F.bit_or(F.expr("shiftleft(1L, len)")).alias("lengths"), F.max(F.col("len") == F.col("depth")).alias("is_word")
        )
        .withColumn("parent", F.expr("substring(child, 1, depth - 1)"))
        .write.partitionBy("depth")
        .parquet(folder)
    )
    edges = words.sparkSession.read.schema(
        "back boolean, child string, lengths bigint, is_word boolean, parent string, depth int"
    ).parquet(folder)
    # can the node still lead to a word of the length that is wanted
    leads = F.expr("shiftright(lengths, len - skipped) & 1 = 1")
    state = ["back", "e", "len", "skipped", F.col("child").alias("node"), "is_word"]
    found, states = [], None
    for depth in range(least, longest + 1):
        place = depth - 1
        level = edges.where(F.col("depth") == depth).select(
            F.col("back").alias("b"), "child", "parent", "lengths", "is_word"
        )
        own = entries.where((F.floor(F.col("len") / 2) <= place) & (F.col("len") > place))
        asked = [
            # a letter is left out, and the one behind it is another
            own.where((F.col("len") > depth) & (_letter(place) != _letter(depth))).select(
                "back", "e", "len", F.lit(1).alias("skipped"), F.concat(_prefix(place), _letter(depth)).alias("next")
            ),
            # the last letter is left out
            entries.where(F.col("len") == depth + 1).select("back", "e", "len", F.lit(1).alias("skipped"), _prefix(depth).alias("next")),
        ]
        if states is not None:
            asked.append(
                states.where(F.col("len") > place + F.col("skipped")).select(
                    "back", "e", "len", "skipped", F.concat("node", _letter(F.lit(place) + F.col("skipped"))).alias("next")
                )
            )
        followed = (
            reduce(DataFrame.unionByName, asked)
            .join(level, (F.col("back") == F.col("b")) & (F.col("next") == F.col("child")))
            .where(leads)
            .select(*state)
        )
        replaced = (
            own.withColumn("skipped", F.lit(0))
            .withColumn("at", _prefix(place))
            .join(level, (F.col("back") == F.col("b")) & (F.col("at") == F.col("parent")))
            .where(leads & (F.substring("child", depth, 1) > _letter(place)))
            .select(*state)
        )
        states = stored.table(followed.unionByName(replaced), f"states-{depth}")
        found.append(states.where(F.col("is_word") & (F.col("len") == depth + F.col("skipped"))).select("back", "e", "node"))
    if not found:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    turned = lambda name: F.when(F.col("back"), F.reverse(name)).otherwise(F.col(name))
    return reduce(DataFrame.unionByName, found).select(turned("e").alias("a"), turned("node").alias("b"))


_SIGNS = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))


def _remainders(word: str) -> tuple[np.ndarray, np.uint64]:
    """Hashes of a word without each of its code points, and of the whole word."""
    data = np.frombuffer(word.encode("latin-1"), np.uint8)
    powers = np.full(len(data), _STEP, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SIGNS[data] * powers)])
        return mixed(sums[:-1] + (sums[-1] - sums[1:]) * _BACK), mixed(sums[-1:])[0]


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "place", "word"]
    for batch in batches:
        for word in batch.column("word"):
            without, whole = _remainders(word.as_py())
            for start in range(0, len(without), 100_000):
                part = without[start : start + 100_000].view(np.int64)
                places = np.arange(start, start + len(part), dtype=np.int32)
                # only hashes and places: the word itself comes back by its own hash
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(places), pa.array(np.full(len(part), np.uint64(whole)).view(np.int64))], names
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.uint64(whole).view(np.int64)], pa.int64()), pa.array([-1], pa.int32()),
                 pa.array([np.uint64(whole).view(np.int64)], pa.int64())], names,
            )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            if len(a) < len(b):
                a, b = b, a
            place = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
            kept.append(a != b and a[place + 1 :] == b[place + (len(a) == len(b)) :])
        yield batch.filter(pa.array(kept, pa.bool_()))


def _hashed(words: DataFrame, stored: Stored) -> DataFrame:
    """``a, b``: near words of which one at least has more than ``LEVELS`` code points."""
    long = words.where(F.length("word") >= LEVELS).select("word")
    if long.isEmpty():
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    keys = stored.table(long.mapInArrow(_long_keys, "key bigint, place int, word bigint"), "long-keys")
    left = keys.where("place >= 0")
    other = keys.select(F.col("key").alias("k"), F.col("place").alias("p"), F.col("word").alias("w"))
    linked = (
        left.join(other, (F.col("key") == F.col("k")) & ((F.col("place") == F.col("p")) | (F.col("p") == -1)))
        .where("word <> w")
        .select("word", "w")
        .distinct()
    )
    numbered = stored.table(
        long.mapInArrow(
            lambda batches: (
                pa.RecordBatch.from_arrays(
                    [pa.array([np.uint64(_remainders(w)[1]).view(np.int64) for w in b.column("word").to_pylist()], pa.int64()), b.column("word")],
                    ["h", "text"],
                )
                for b in batches
            ),
            "h bigint, text string",
        ),
        "long-words",
    )
    one = numbered.select(F.col("h").alias("h1"), F.col("text").alias("a"))
    two = numbered.select(F.col("h").alias("h2"), F.col("text").alias("b"))
    pairs = linked.join(one, F.col("word") == F.col("h1")).join(two, F.col("w") == F.col("h2")).select("a", "b")
    return pairs.mapInArrow(_near, "a string, b string")


def near_words(words: DataFrame, stored: Stored) -> DataFrame:
    """``a, b`` of all ordered pairs of words that one inserted, deleted or replaced code point parts."""
    pairs = _walked(words, stored).unionByName(_hashed(words, stored))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def variants(documents: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words."""
    stored = Stored(documents.sparkSession, "spelling")
    words = stored.table(word_counts(documents), "words")
    near = (
        near_words(words, stored)
        .join(words.select(F.col("word").alias("w"), F.col("n").alias("near_n")), F.col("b") == F.col("w"))
        .groupBy("a")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("b"))).alias("best"))
    )
    taken = -F.col("best.m") >= 2 * F.col("n")
    rows = stored.table(
        words.join(near, F.col("word") == F.col("a"), "left").select(
            "word", F.when(taken, F.col("best.b")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    # a form has twice the count at least, so paths are short and have no rings; each round doubles what is followed
    ways = stored.table(rows.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("w"), F.col("root").alias("far"))
        longer = stored.table(ways.join(ahead, F.col("root") == F.col("w"), "left").select("word", "root", "far"), "longer")
        ways = longer.select("word", F.coalesce("far", "root").alias("root"))
        if longer.where("far is not null").isEmpty():
            break
    ends = ways.select(F.col("word").alias("w"), "root")
    return rows.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
