"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in hash order, are cut into blocks of ``BLOCK_CHARS``
code points. The ``i``-th block of a source of weight ``w`` (share of all slots)
may start at slot ``floor((i - 1) / w)`` and must be done by ``ceil(i / w)``; in every slot, of the
blocks that may start, that of the earliest deadline is taken. With weights in whole
units of ``1 / Q`` the schedule repeats every ``Q`` slots, so one frame of ``Q`` slots, made on the
driver from the weights alone, places every block of every source by arithmetic. Until a source runs
out, every prefix of slots holds each source's share to less than one block.

Given weights are taken as the decimals or fractions they are written as; ``Q`` is the common denominator of their shares, so nothing
is rounded. Shares without a common denominator up to ``MOST_SLOTS`` are rounded to whole ``MOST_SLOTS``-ths: a source is then
off by one more block at most in as many slots.

All documents are placed, each once. Slots of a source that has run out stay empty, the rest go on
in their relative weights; ``in_target`` marks the slots before the first source ran out, where the target
holds for all sources.

Weights default to shares of the square root of source size in whole ``UNITS``-ths; a null source is a source
of its own. A text that is null or empty takes no room but is placed. A document over several blocks
sits in the block it begins in. Ties in hash order go by doc_id; repeated rows are placed side by side.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewright.llm.common import Stored

BLOCK_CHARS = 65_536
#: Least number of slots in a frame; there are at least ten for every source.
UNITS = 1_000
#: Most slots in a frame of given weights.
MOST_SLOTS = 1_000_000
#: Documents of a source that are put in order together, on average.
SLICE_DOCS = 500


def frame_of(units: dict[str, int]) -> dict[str, list[int]]:
    """Slots of one frame by source: earliest deadline first among released blocks.

    ``units`` are whole weights; the frame has as many slots as their sum.
    """
    total = sum(units.values())
    names = sorted(units)
    slots: dict[str, list[int]] = {name: [] for name in names}
    coming = [(0, name, 1) for name in names if units[name]]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, name, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-i * total // units[name]), name, i))
        if not ready:
            continue
        _, name, i = heapq.heappop(ready)
        slots[name].append(slot)
        if i < units[name]:
            heapq.heappush(coming, (i * total // units[name], name, i + 1))
    return slots


def whole_units(weights: dict[str, float], units: int) -> dict[str, int]:
    """Weights as whole numbers that sum to ``units``, by largest remainder, at least 1 each."""
    total = sum(weights.values())
    exact = {name: units * weight / total for name, weight in weights.items()}
    out = {name: max(1, math.floor(value)) for name, value in exact.items()}
    by_rest = sorted(exact, key=lambda name: (math.floor(exact[name]) - exact[name], name))
    spare = units - sum(out.values())
    while spare:
        for name in by_rest if spare > 0 else sorted(out, key=lambda n: (-out[n], n)):
            if spare > 0:
                out[name] += 1
                spare -= 1
            elif spare < 0 and out[name] > 1:
                out[name] -= 1
                spare += 1
            if not spare:
                break
    return out


def exact_units(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """Weights as the whole numbers that have their ratios, if these sum to ``MOST_SLOTS`` or less."""
    parts = {name: weight if isinstance(weight, Fraction) else Fraction(str(weight)) for name, weight in weights.items()}
    if any(part <= 0 for part in parts.values()):
        raise ValueError("target weights have to be positive")
    total = sum(parts.values())
    slots = math.lcm(*((part / total).denominator for part in parts.values()))
    if slots > MOST_SLOTS:
        return whole_units({name: float(part / total) for name, part in parts.items()}, MOST_SLOTS)
    return {name: int(part / total * slots) for name, part in parts.items()}


def mix(documents: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, source, slot, block, place, in_target`` for every document.

    ``slot`` orders the mix, ``block`` counts the blocks of the source from 0, ``place`` is where in the source the text
    begins. Given ``weights`` must name every source that has documents.
    """
    spark = documents.sparkSession
    stored = Stored(spark, "mixing")
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"),
    )
    sized = stored.table(sized.withColumn("h", F.xxhash64("doc_id", F.lit(5))), "sized")
    # hash order is cut into equal ranges, as many as keep a range small: no source is ordered in one task
    slices = max(1, sized.count() // SLICE_DOCS)
    step = (1 << 64) // slices + 1
    number = F.floor((F.col("h").cast("decimal(38,0)") + F.lit(str(1 << 63)).cast("decimal(38,0)")) / F.lit(str(step)).cast("decimal(38,0)"))
    placed = sized.withColumn("slice", number.cast("long"))
    totals = stored.table(
        placed.groupBy("source", "slice").agg(F.sum("size").alias("held")), "totals"
    )
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("from")
    )
    # one row per source: the weights are a setting of the mix, as many as it has sources
    sources = {r["source"]: r["held"] for r in totals.groupBy("source").agg(F.sum("held").alias("held")).collect()}
    names = {name: "" if name is None else f"={name}" for name in sources}
    if weights is None:
        shares = {names[name]: math.sqrt(max(1, held)) for name, held in sources.items()}
        units = whole_units(shares, max(UNITS, 10 * len(sources))) if sources else {}
    else:
        missing = set(sources) - set(weights)
        if missing:
            raise ValueError(f"no target weight for sources: {sorted(map(str, missing))}")
        units = exact_units({names[name]: weights[name] for name in sources}) if sources else {}
    frame = frame_of(units)
    length = sum(units.values())
    blocks = {names[n]: max(1, -(-held // block_chars)) for n, held in sources.items()}
    ends = [_slot(frame[n], units[n], length, blocks[n]) for n in blocks]
    horizon = min(ends, default=0)
    table = spark.createDataFrame(
        [(None if not n else n[1:], slots, units[n], blocks[n] - 1) for n, slots in frame.items()],
        "w string, slots array<int>, units int, last bigint",
    )
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))
    )
    # at most MOST_SLOTS numbers, or ten for every source
    return (
        begun.withColumn("place", F.col("from") + F.col("within"))
        .join(F.broadcast(table), F.col("source").eqNullSafe(F.col("w")))
        .withColumn("block", F.least(F.floor(F.col("place") / block_chars), F.col("last")).cast("long"))
        .select(
            "doc_id", "source",
            (
                F.floor(F.col("block") / F.col("units")) * length
                + F.element_at("slots", (F.pmod("block", "units") + 1).cast("int"))
            ).cast("long").alias("slot"),
            "block", "place",
        )
        .withColumn("in_target", F.col("slot") < horizon)
    )


def _slot(slots: list[int], units: int, length: int, block: int) -> int:
    return block // units * length + slots[block % units]
