from pyspark.sql import functions as F

from placewright.sources.tables import read_table
from placewright.streaming.channel import handoffs, incremental_handoffs, late_turns
from placewright.streaming.incremental import (
    current_status,
    incremental_ingest,
    incremental_status,
    posting_table,
)

POSTING = "job_id STRING, title STRING, company STRING, description STRING"
EVENT = "candidate_id BIGINT, job_id STRING, seq BIGINT, status STRING, notes STRING"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_ingest_takes_each_file_once(spark, tmp_path):
    landed = str(tmp_path / "landed")

    def run():
        stream = spark.readStream.schema(POSTING).json(landed)
        incremental_ingest(
            stream, f"{tmp_path}/postings", f"{tmp_path}/rejects", f"{tmp_path}/progress",
            POSTING, [F.col("title")],
        )
        rows = posting_table(spark, f"{tmp_path}/postings", POSTING).read().collect()
        return sorted((r.job_id, r.title) for r in rows)

    land(spark, landed, [("1", "b", "c", "d"), ("1", "a", "c", "d"), ("2", "x", None, "d")], POSTING)
    assert run() == [("1", "a")]
    assert run() == [("1", "a")]
    land(spark, landed, [("1", "0", "c", "d"), ("2", "y", "c", "d")], POSTING)
    assert run() == [("1", "a"), ("2", "y")]
    rejects = read_table(spark, f"{tmp_path}/rejects", POSTING + ", missing STRING").collect()
    assert [(r.job_id, r.missing) for r in rejects] == [("2", "company")]


def test_status_keeps_the_latest(spark, tmp_path):
    landed = str(tmp_path / "events")

    def run():
        stream = spark.readStream.schema(EVENT).json(landed)
        incremental_status(stream, f"{tmp_path}/status", f"{tmp_path}/progress")
        rows = current_status(spark, f"{tmp_path}/status").collect()
        return sorted((r.candidate_id, r.job_id, r.seq, r.status, r.notes) for r in rows)

    land(spark, landed, [(1, "a", 1, "shortlisted", "n"), (1, "a", 3, "tailored", None)], EVENT)
    assert run() == [(1, "a", 3, "tailored", None)]
    # a late, older event changes nothing; a newer one and a new key do
    land(spark, landed, [(1, "a", 2, "expired", "late"), (2, "a", 1, "skipped", None)], EVENT)
    assert run() == [(1, "a", 3, "tailored", None), (2, "a", 1, "skipped", None)]
    land(spark, landed, [(1, "a", 9, "applied", "ok")], EVENT)
    assert run() == [(1, "a", 9, "applied", "ok"), (2, "a", 1, "skipped", None)]
    assert run() == [(1, "a", 9, "applied", "ok"), (2, "a", 1, "skipped", None)]


TURN = "thread_id BIGINT, turn BIGINT, role STRING, text STRING"


def test_handoff_hands_on_the_summary_and_clears_the_channel(spark, tmp_path):
    landed, table = str(tmp_path / "turns"), f"{tmp_path}/closed"

    def run():
        incremental_handoffs(spark.readStream.schema(TURN).json(landed), table, f"{tmp_path}/progress")
        return sorted(tuple(r) for r in handoffs(spark, table).collect())

    # no hand-off yet: everything stays in the channel
    land(spark, landed, [(1, 0, "user", "hello"), (1, 1, "assistant", "first"), (2, 0, "assistant", "")], TURN)
    assert run() == []
    # the channel outlives the run; rows of a batch come in any order
    land(spark, landed, [(1, 3, "handoff", None), (1, 2, "assistant", "second"), (1, 4, "assistant", "of the next stage"), (2, 1, "handoff", None)], TURN)
    assert run() == [(1, 3, "second", 3), (2, 1, None, 1)]
    assert run() == [(1, 3, "second", 3), (2, 1, None, 1)]
    # the next stage knows nothing of the first; a late turn is counted, not mixed in
    land(spark, landed, [(1, 5, "user", "and?"), (1, 2, "assistant", "late"), (1, 9, "handoff", None), (None, 1, "user", "x"), (3, None, "user", "x")], TURN)
    assert run() == [(1, 3, "second", 3), (1, 9, "of the next stage", 2), (2, 1, None, 1)]
    assert [tuple(r) for r in late_turns(spark, table).collect()] == [(1, 1)]


def test_many_turns_of_one_thread_and_many_stages(spark, tmp_path):
    landed, table = str(tmp_path / "turns"), f"{tmp_path}/closed"
    rows = [(7, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(3_000)] + [(7, t, "handoff", None) for t in range(99, 3_000, 100)]
    land(spark, landed, rows, TURN)
    incremental_handoffs(spark.readStream.schema(TURN).json(landed), table, f"{tmp_path}/progress")
    want = [(7, h, f"t{h if h % 3 else h - 1}", 100) for h in range(99, 3_000, 100)]
    assert sorted(tuple(r) for r in handoffs(spark, table).collect()) == want


def test_a_short_thread_is_one_state_key(spark, tmp_path):
    landed, table = str(tmp_path / "turns"), f"{tmp_path}/closed"
    land(spark, landed, [(t, n, "user", "x") for t in range(5) for n in range(8)] + [(t, n, "handoff", None) for t in range(5) for n in (3, 7)], TURN)
    incremental_handoffs(spark.readStream.schema(TURN).json(landed), table, f"{tmp_path}/progress")
    # every key tells once of every stage it knows of
    assert read_table(spark, table, "thread_id BIGINT, handoff_turn BIGINT").count() == 10


def test_stages_over_all_spans(spark, tmp_path):
    """Turns below zero, hand-offs far from their turns, and turns left for a later run."""
    landed, table = str(tmp_path / "turns"), f"{tmp_path}/closed"
    turns = {5: [*range(-20, 300, 3)], 6: [0, 15, 16, 31, 32, 127, 128, 129, 5_000], 7: [10**17 + n for n in range(40)]}
    ends = {5: [-1, 0, 100, 101, 290], 6: [16, 128, 4_999], 7: [10**17 + 1, 10**17 + 38]}
    for run in (0, 1):
        rows = [(k, t, "assistant", f"t{t}") for k in turns for t in turns[k]] if run == 0 else []
        rows += [(k, e, "handoff", None) for k in ends for e in (ends[k][:-1], ends[k][-1:])[run]]
        land(spark, landed, rows, TURN)
        incremental_handoffs(spark.readStream.schema(TURN).json(landed), table, f"{tmp_path}/progress")
    want = []
    for k in turns:
        for before, end in zip([-(10**18), *ends[k]], ends[k]):
            of_stage = [t for t in turns[k] if before < t <= end]
            want.append((k, end, f"t{of_stage[-1]}" if of_stage else None, len(of_stage)))
    assert sorted(tuple(r) for r in handoffs(spark, table).collect()) == sorted(want)
    assert late_turns(spark, table).count() == 0
