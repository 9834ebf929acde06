"""Many skills in many texts: each text is read once, where it lies.

The different skills of all candidates are numbered and put into an automaton that finds all of them in one pass over a text. What
leaves the text is a short list of numbers, so pairs of candidates and postings are judged without
any text above a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.predicates import lower_text
from placewright.sources.tables import materialized

#: Bytes of skills that are sent to the workers at a time; an automaton takes some fifty times as much.
SKILL_BYTES = 4 << 20


def number_skills(people: DataFrame, skills: str = "must_have_skills") -> DataFrame:
    """``skill_no, skill``: the different skills in lower case, written once so that numbers stay."""
    named = people.select(F.explode(skills).alias("skill")).where("skill IS NOT NULL").select(F.lower("skill").alias("skill"))
    numbered = named.distinct().select(F.monotonically_increasing_id().alias("skill_no"), "skill")
    return materialized(numbered, "skills")


def with_needs(people: DataFrame, numbered: DataFrame, key: str = "candidate_id", skills: str = "must_have_skills") -> DataFrame:
    """People with ``needs``, the numbers of their skills; NULL where there are none.

    A NULL among the skills is not known and so asks for nothing.
    """
    named = people.select(key, F.explode(skills).alias("skill")).select(key, F.lower("skill").alias("skill"))
    # one list per person, as long as the person's own
    needs = named.join(numbered, "skill").groupBy(key).agg(F.collect_set("skill_no").alias("needs"))
    return people.join(needs, key, "left")


def _found(numbered: list[tuple[int, str]], width: int):
    """Numbers of the skills in a lower-case text, the last of ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        everywhere = [no for no, skill in numbered if not skill]
        for no, skill in numbered:
            if skill:
                automaton.add_word(skill, no)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            lists = [
                sorted({*everywhere, *(no for _, no in automaton.iter(text))} if len(automaton) else everywhere)
                for text in batch.column(width - 1).to_pylist()
            ]
            names = batch.schema.names[: width - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: width - 1], pa.array(lists, pa.list_(pa.int64()))], [*names, "found"]
            )

    return run


def skill_index(postings: DataFrame, numbered: DataFrame, keep: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """The ``keep`` columns of postings and ``found``, the numbers of skills in their text, ascending.

    Skills beyond ``SKILL_BYTES`` are looked for in further passes over the texts; ``keep`` must then name each posting.
    """
    count, size = numbered.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("skill")), F.lit(0))).first()
    passes = max(1, -(-size // SKILL_BYTES))
    rows = postings.select(*keep, lower_text(F.col("description")).alias("__text"))
    schema = postings.select(*keep, F.lit(None).cast("array<bigint>").alias("found")).schema
    found = None
    for number in range(passes):
        part = numbered.where(F.pmod(F.xxhash64("skill"), F.lit(passes)) == number)
        held = [(r["skill_no"], r["skill"]) for r in part.toLocalIterator()]  # SKILL_BYTES
        one = rows.mapInArrow(_found(held, len(keep) + 1), schema)
        found = one if found is None else found.unionByName(one)
    if passes > 1:
        found = found.groupBy(*keep).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return found


def has_all(found: Column, needs: Column) -> Column:
    """Every needed skill was found; nothing needed is always met."""
    return F.coalesce(F.size(F.array_except(needs, found)) == 0, F.lit(True))
