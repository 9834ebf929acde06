"""Bucket tables: versions, sketches, repeated and broken batches."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placewright.sources.buckets import BucketTable

SCHEMA = "job_id STRING, seq INT, note STRING"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def newest(rows):
    order = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "table"), SCHEMA, buckets=8)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "job_id STRING")


def test_batches_add_up_and_repeat(spark, table):
    assert content(table) == [] and table.segments() == []
    table.append(frame(spark, [("a", 1, "x"), ("b", 1, None), (None, 1, "null key")]), 0)
    table.append(frame(spark, [("a", 2, "y")]), 1)
    table.append(frame(spark, [("a", 3, "z")]), 1)  # batch 1 again, with other rows
    assert content(table) == sorted([("a", 1, "x"), ("a", 3, "z"), ("b", 1, None), (None, 1, "null key")], key=repr)
    table.append(frame(spark, []), 2)
    assert len(table.read().collect()) == 4


def test_a_merge_rewrites_the_buckets_of_its_keys_only(spark, table):
    first = [(str(k), 0, "old") for k in range(200)]
    table.append(frame(spark, first), 0)
    before = set(table.segments())
    assert len(before) == 8
    table.merge(frame(spark, [("7", 1, "new"), ("new key", 1, "new"), ("9", -1, "late")]), 1, newest)
    after = set(table.segments())
    touched = {s.bucket for s in after - before}
    assert 1 <= len(touched) <= 3 and {s.bucket for s in before - after} <= touched | {s.bucket for s in before}
    got = {r.job_id: (r.seq, r.note) for r in table.read().collect()}
    assert got == {**{k: (0, "old") for k, _, _ in first}, "7": (1, "new"), "new key": (1, "new")}
    plan = table.read([s for s in after if s.bucket in touched])._jdf.queryExecution().toString()
    assert all(f"bucket={s.bucket}" not in plan for s in after if s.bucket not in touched)
    # the same batch again changes nothing
    table.merge(frame(spark, [("7", 1, "new"), ("new key", 1, "new"), ("9", -1, "late")]), 1, newest)
    assert {r.job_id: (r.seq, r.note) for r in table.read().collect()} == got


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, table, monkeypatch):
    table.append(frame(spark, [("a", 1, "x"), ("b", 1, "x")]), 0)
    want = content(table)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", crash)
        with pytest.raises(RuntimeError):
            table.merge(frame(spark, [("a", 2, "y")]), 1, newest)
        with pytest.raises(RuntimeError):
            table.append(frame(spark, [("c", 2, "y")]), 1)
    assert content(table) == want
    table.merge(frame(spark, [("a", 2, "y")]), 1, newest)
    assert content(table) == [("a", 2, "y"), ("b", 1, "x")]


def test_compaction_leaves_one_segment_a_bucket(spark, table):
    for batch in range(4):
        table.append(frame(spark, [(str(k), batch, f"v{batch}") for k in range(30 + batch)]), batch)
    assert len(table.segments()) > 3 * 8 - 8
    assert table.compact(3, newest, more_than=10) == 0
    assert table.compact(3, newest, more_than=1) == len({s.bucket for s in table.segments()})
    want = [(str(k), 3, "v3") for k in range(33)]
    assert content(table) == sorted(want)
    assert len(table.segments()) == len({s.bucket for s in table.segments()})
    assert table.compact(3, newest, more_than=1) >= 0 and content(table) == sorted(want)
    assert table.vacuum() > 0 and content(table) == sorted(want)
    table.append(frame(spark, [("z", 9, "n")]), 4)
    assert content(table) == sorted([*want, ("z", 9, "n")])


def test_sketches_name_the_segments_to_open(spark, table):
    for batch in range(5):
        table.append(frame(spark, [(f"{batch}-{k}", 0, "x" * 50) for k in range(400)]), batch)
    one = keys(spark, "3-17")
    assert [s.version for s in table.candidates(one)].count(6) == 1
    # of the 5 segments of that bucket the others are left out but for a chance of some hundredths
    assert len(table.candidates(one)) <= 2
    assert [tuple(r) for r in table.lookup(keys(spark, "3-17", "nowhere")).collect()] == [("3-17", 0, "x" * 50)]
    many = spark.range(1000).select(F.concat(F.lit("2-"), F.col("id")).alias("job_id"))
    opened = {s.version for s in table.candidates(many.where("id < 400"))}
    assert 4 in opened
    missing = {r.job_id for r in table.missing(many).collect()}
    assert missing == {f"2-{k}" for k in range(400, 1000)}
    every = table.read().select("job_id")
    assert table.missing(every).isEmpty()
    unknown = spark.range(2000).select(F.concat(F.lit("u"), F.col("id")).alias("job_id"))
    words = table.candidates(unknown.limit(20))
    assert len(words) < len(table.segments()) / 2


def test_a_null_key_is_missing(spark, table):
    table.append(frame(spark, [(None, 1, "a"), ("k", 1, "b")]), 0)
    got = table.missing(keys(spark, None, "k", "l")).collect()
    assert {r.job_id for r in got} == {None, "l"}
