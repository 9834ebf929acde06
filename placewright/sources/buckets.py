"""Tables dealt into buckets by key, with versions and key sketches.

Rows of a batch lie in ``rows/version=<v>/bucket=<b>``: a *segment*. A manifest, one small file per version, names the segments
that are the table. Writing ends with that file, so a reader sees the version before or the one after, and a batch that
is run again after a crash replaces what it left. ``append`` adds segments, ``merge`` folds a batch into the buckets of its own keys only, ``compact`` folds the
segments of a bucket into one.

Each segment has a sketch of its keys: words of 64 bits, a key sets ``PROBES`` bits of one of them. Keys that
are looked up are joined with the words by (bucket, block), and only segments that may hold one of
them are opened; which they do hold, a join on the keys says.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.session import delete_folder

#: Bits a key sets in its word, and keys a word is meant for (some 16 bits a key).
PROBES = 6
KEYS_A_WORD = 4
#: Segments of a bucket that a compaction leaves alone.
SEGMENTS = 4

Fold = Callable[[DataFrame], DataFrame]


class Segment(NamedTuple):
    bucket: int
    version: int
    #: Words of the segment's sketch.
    blocks: int


class BucketTable:
    """A table below ``path``; ``schema`` as DDL, ``key``: columns whose hash deals rows out.

    ``buckets`` is fixed for the life of the table: some GB of rows a bucket at the size it will reach. ``files`` splits the rows of a bucket over so many tasks and
    files. Versions follow the batch numbers of the caller, which only grow.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, key: Sequence[str] = ("job_id",), buckets: int = 16, files: int = 1
    ) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.buckets, self.files = list(key), buckets, files

    # ---- places --------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _part(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version}"

    def segments(self, before: int | None = None) -> list[Segment]:
        """Segments of the newest version, or of the newest one below ``before``: a few numbers per bucket."""
        try:
            rows = self.spark.read.schema("bucket INT, segment BIGINT, blocks INT, version BIGINT").parquet(
                f"{self.path}/manifest"
            )
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return []
        if before is not None:
            rows = rows.where(F.col("version") < before)
        newest = rows.agg(F.max("version")).first()[0]
        if newest is None:
            return []
        named = rows.where((F.col("version") == newest) & (F.col("bucket") >= 0)).collect()
        return [Segment(r["bucket"], r["segment"], r["blocks"]) for r in named]

    def read(self, segments: Sequence[Segment] | None = None) -> DataFrame:
        """All rows, or those of some segments; other files are not even listed."""
        segments = self.segments() if segments is None else segments
        if not segments:
            return self._empty()
        paths = [f"{self._part('rows', s.version)}/bucket={s.bucket}" for s in segments]
        return self.spark.read.schema(self.schema).parquet(*paths)

    # ---- writing ---------------------------------------------------------------

    def _write(self, rows: DataFrame, version: int) -> list[Segment]:
        """Rows and sketches of a version; its segments."""
        place = [F.col("bucket")]
        if self.files > 1:
            place.append(F.pmod(F.xxhash64(*self.key, F.lit("file")), F.lit(self.files)))
        columns = self._empty().columns
        dealt = rows.select(*columns).withColumn("bucket", self._bucket())
        dealt.repartition(*place).write.mode("overwrite").partitionBy("bucket").parquet(self._part("rows", version))
        written = self._written(version)
        if written is None:
            return []
        count = written.groupBy("bucket").count().collect()  # a row per bucket
        fullest = max(r["count"] for r in count)
        blocks = 1 << max(0, (-(-fullest // KEYS_A_WORD) - 1).bit_length())
        self._sketched(written, F.lit(blocks)).groupBy("bucket", "block").agg(F.bit_or("mask").alias("bits")).write.mode(
            "overwrite"
        ).parquet(self._part("sketches", version))
        return [Segment(r["bucket"], version, blocks) for r in count]

    def _written(self, version: int) -> DataFrame | None:
        """Keys and buckets of what a version wrote; None if that was nothing."""
        fields = self._empty().select(*self.key).schema
        try:
            rows = self.spark.read.schema(fields).parquet(f"{self._part('rows', version)}/bucket=*")
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return None
        return rows.withColumn("bucket", self._bucket())

    def _sketched(self, keys: DataFrame, blocks: Column) -> DataFrame:
        """``bucket, blocks, block, mask`` of keys."""
        h = F.col("h")
        mask = F.lit(0).cast("long")
        for probe in range(PROBES):
            # upper bits choose places in the word, lower ones the word
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 28 + 6 * probe).bitwiseAND(F.lit(63)).cast("int")))
        return keys.select("bucket", blocks.alias("blocks"), F.xxhash64(*self.key, F.lit("sketch")).alias("h")).select(
            "bucket", "blocks", F.pmod(h, F.col("blocks")).alias("block"), mask.alias("mask")
        )

    def _publish(self, version: int, segments: Sequence[Segment]) -> None:
        """The manifest of a version, in one file: it is there or it is not."""
        # an empty version is one too
        rows = [tuple(s) for s in segments] or [(-1, -1, 0)]
        frame = self.spark.createDataFrame(rows, "bucket INT, segment BIGINT, blocks INT")
        frame.coalesce(1).write.mode("overwrite").parquet(self._part("manifest", version))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch; a batch that is repeated replaces itself."""
        version = 2 * batch_id
        held = self.segments(before=version)
        self._publish(version, [*held, *self._write(rows, version)])

    def merge(self, rows: DataFrame, batch_id: int, fold: Fold) -> None:
        """Replace the buckets that a batch has keys in by ``fold(old rows and new ones)``.

        ``fold`` must decide by key. Other buckets stay as they are.
        """
        version = 2 * batch_id
        held = self.segments(before=version)
        arrived = self._part("arriving", version)
        rows.select(*self._empty().columns).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(arrived)
        staged = self.spark.read.schema(f"{self.schema}, bucket INT").parquet(arrived)
        touched = {r["bucket"] for r in staged.select("bucket").distinct().collect()}
        old = self.read([s for s in held if s.bucket in touched])
        new = self._write(fold(old.unionByName(staged.drop("bucket"))), version)
        self._publish(version, [*(s for s in held if s.bucket not in touched), *new])
        delete_folder(self.spark, arrived)

    def compact(self, batch_id: int, fold: Fold, more_than: int = SEGMENTS) -> int:
        """Fold buckets of more than ``more_than`` segments into one each; returns their number.

        Follows the batch of that number and may be repeated.
        """
        version = 2 * batch_id + 1
        held = self.segments(before=version)
        count: dict[int, int] = {}
        for s in held:
            count[s.bucket] = count.get(s.bucket, 0) + 1
        full = {b for b, n in count.items() if n > more_than}
        if full:
            new = self._write(fold(self.read([s for s in held if s.bucket in full])), version)
            self._publish(version, [*(s for s in held if s.bucket not in full), *new])
        return len(full)

    def vacuum(self) -> int:
        """Delete what the newest version does not name; for when no older one is read any more."""
        live = self.segments()
        keep = {(s.version, s.bucket) for s in live}
        newest = None
        gone = 0
        for kind in ("manifest", "sketches", "rows"):
            for version in self._listed(kind):
                path = self._part(kind, version)
                if kind == "manifest":
                    newest = max(newest or version, version)
                elif version not in {s.version for s in live}:
                    gone += delete_folder(self.spark, path)
                elif kind == "rows":
                    for bucket in self._buckets_of(version):
                        if (version, bucket) not in keep:
                            gone += delete_folder(self.spark, f"{path}/bucket={bucket}")
        for version in self._listed("manifest"):
            if version != newest:
                gone += delete_folder(self.spark, self._part("manifest", version))
        return gone

    def _folders(self, path: str, mark: str) -> list[int]:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        names = [f.getPath().getName() for f in files.listStatus(place)]
        return [int(n.removeprefix(mark)) for n in names if n.startswith(mark)]

    def _listed(self, kind: str) -> list[int]:
        return self._folders(f"{self.path}/{kind}", "version=")

    def _buckets_of(self, version: int) -> list[int]:
        return self._folders(self._part("rows", version), "bucket=")

    # ---- asking ------------------------------------------------------------------

    def candidates(self, keys: DataFrame, before: int | None = None) -> list[Segment]:
        """Segments that may hold one of ``keys``, told by their sketches."""
        held = self.segments(before)
        if not held:
            return []
        sizes = sorted({s.blocks for s in held})  # powers of two, so a few dozen at most
        asked = keys.select(*self.key).withColumn("bucket", self._bucket())
        asked = self._sketched(asked, F.explode(F.array(*map(F.lit, sizes)))).distinct()
        of_version = {s.version: s.blocks for s in held}
        sketches = self.spark.read.schema("bucket INT, block BIGINT, bits BIGINT, version BIGINT").option(
            "basePath", f"{self.path}/sketches"
        ).parquet(*(self._part("sketches", v) for v in of_version))
        versions = self.spark.createDataFrame(list(of_version.items()), "version BIGINT, blocks INT")
        words = sketches.join(versions, "version")
        hit = (
            asked.join(words, ["bucket", "blocks", "block"])
            .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
            .select("version", "bucket")
            .distinct()
            .collect()  # segments
        )
        found = {(r["bucket"], r["version"]) for r in hit}
        return [s for s in held if (s.bucket, s.version) in found]

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of the given keys; segments without any are not opened."""
        wanted = keys.select(*self.key).distinct()
        return self.read(self.candidates(wanted, before)).join(wanted, self.key, "left_semi")

    def missing(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """``rows`` whose key the table does not have; a null key is never there."""
        known = self.read(self.candidates(rows, before)).select(*self.key).distinct()
        return rows.join(known, self.key, "left_anti")
