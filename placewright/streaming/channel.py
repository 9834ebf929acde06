"""Message channel of a thread as streaming state.

Turns of a stage are appended to its channel; a hand-off closes the stage: its summary (the last non-empty assistant turn
of the channel) is handed on and the channel is cleared, so that the next stage starts from typed rows only.

The channel of a thread is dealt by spans of ``SPAN`` turns over ``PARTS`` state keys, so a thread that holds much of a stream
is not one task's work and one of fewer turns is one key. A hand-off goes to the parts that earlier turns may lie in. Each part
tells what it has of a stage; readers fold the parts. Order comes from ``turn``, not from arrival within a batch. A turn that arrives after the hand-off that closed its
stage is no longer in any channel: it is counted as ``late`` for that thread. Rows without a thread or a turn belong to no channel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from placewright.sources.tables import read_table, write_batch
from placewright.streaming.incremental import run_available

HANDOFF = "handoff"
PARTS = 8
#: Turns in a row that share a part. A checkpoint belongs to the values of PARTS and SPAN it was made with.
SPAN = 16
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CLOSED = "thread_id BIGINT, handoff_turn BIGINT, spoken_turn BIGINT, spoken STRING, messages BIGINT, late BIGINT"


class Channel(StatefulProcessor):
    """One part of a thread's channel."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn BIGINT, role STRING, text STRING")
        self.cleared = handle.getValueState("cleared", "turn BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.cleared.get()
        cleared = held[0] if held is not None else None
        ends: list[int] = []
        late = 0
        for part in rows:
            mark = part["role"] == HANDOFF
            ends += part.loc[mark, "turn"].tolist()
            fresh = part[~mark]
            if cleared is not None:
                late += int((fresh["turn"] <= cleared).sum())
                fresh = fresh[fresh["turn"] > cleared]
            if len(fresh):
                texts = ((int(t), r, x) for t, r, x in zip(fresh["turn"], fresh["role"], fresh["text"]))
                self.turns.appendList([(t, *(v if isinstance(v, str) else None for v in rest)) for t, *rest in texts])
        ends = sorted({int(e) for e in ends if cleared is None or e > cleared})
        if ends:
            yield self._close(key, ends, late)
        elif late:
            yield self._rows([(key[0], None, None, None, 0, late)])

    def _close(self, key, ends: list[int], late: int) -> pd.DataFrame:
        """Hand on every closed stage and clear its turns."""
        spoken: list[tuple | None] = [None] * len(ends)
        counts = [0] * len(ends)
        left = []
        for turn, role, text in self.turns.get():
            stage = bisect_left(ends, turn)
            if stage == len(ends):
                left.append((turn, role, text))
                continue
            counts[stage] += 1
            if role == "assistant" and text and (spoken[stage] is None or (turn, text) > spoken[stage]):
                spoken[stage] = (turn, text)
        self.turns.clear()
        if left:
            self.turns.put(left)
        self.cleared.update((ends[-1],))
        return self._rows(
            [(key[0], end, *(said or (None, None)), n, late if k == 0 else 0) for k, (end, said, n) in enumerate(zip(ends, spoken, counts))]
        )

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["thread_id", "handoff_turn", "spoken_turn", "spoken", "messages", "late"])
        return out.astype({name: "Int64" for name in ("thread_id", "handoff_turn", "spoken_turn", "messages", "late")})

    def close(self) -> None:
        pass


def incremental_handoffs(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Close the stages that hand-offs among new rows end.

    stream: ``thread_id BIGINT, turn BIGINT, role STRING, text STRING``; a row of role ``HANDOFF`` ends the stage after its turn.
    """
    spark = stream.sparkSession
    # part k has no turn below k * SPAN
    span = F.floor(F.greatest("turn", F.lit(0)) / SPAN)
    parts = F.when(F.col("role") == HANDOFF, F.sequence(F.lit(0), F.least(span, F.lit(PARTS - 1)).cast("int"))).otherwise(
        F.array((span % PARTS).cast("int"))
    )
    closed = (
        stream.where("thread_id IS NOT NULL AND turn IS NOT NULL")
        .select(F.col("thread_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
        .withColumn("part", F.explode(parts))
        .groupBy("thread_id", "part")
        .transformWithStateInPandas(Channel(), _CLOSED, outputMode="append", timeMode="none")
    )
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STORE)
    try:
        run_available(
            closed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
                lambda batch, batch_id: write_batch(batch, table, batch_id)
            )
        )
    finally:
        spark.conf.set(setting, before)


def handoffs(spark: SparkSession, table: str) -> DataFrame:
    """``thread_id, handoff_turn, summary, messages`` of every closed stage; NULL where the assistant said nothing."""
    return (
        read_table(spark, table, _CLOSED)
        .where("handoff_turn IS NOT NULL")
        .groupBy("thread_id", "handoff_turn")
        .agg(
            F.max(F.struct("spoken_turn", "spoken")).getField("spoken").alias("summary"),
            F.sum("messages").alias("messages"),
        )
    )


def late_turns(spark: SparkSession, table: str) -> DataFrame:
    """``thread_id, late``: turns that came after their stage had been closed."""
    return read_table(spark, table, _CLOSED).groupBy("thread_id").agg(F.sum("late").alias("late")).where("late > 0")
