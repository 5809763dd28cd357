"""The message log: one table of all chats' messages, partitioned by day and run.

Every append is a *run* with a name. Its rows go to ``day=<date>/run=<name>`` partitions, and writing a run again replaces
exactly the partitions of that run (dynamic partition overwrite; days that the run no longer has are deleted), so a job that
failed half-way or is repeated leaves one copy. Readers name days, and other days' files are not opened.

A run takes positions behind all other runs' messages. Repeat the latest run, or accept that an
earlier one, repeated, comes after what was appended since.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeflow.operators import chatlog as C
from recipeflow.session import read_table_if_any

#: Columns of a log besides the partition columns ``day`` and ``run``.
COLUMNS = ("chat_id", "seq", "ts", "role", "content", "meta")


def meta_of(payload_json: Column) -> Column:
    """The message's ``meta`` from the JSON that jobs give."""
    return F.from_json(payload_json, C.META)


class MessageLog:
    """A log at ``path`` in shared storage; ``chat_type`` is the type of chat ids."""

    def __init__(self, spark: SparkSession, path: str, chat_type: str = "bigint"):
        self.spark, self.path, self.chat_type = spark, path, chat_type

    def read(self, since: datetime.date | None = None, until: datetime.date | None = None, without_run: str | None = None) -> DataFrame:
        """(chat_id, seq, ts, role, content, meta, day, run) of the days from ``since`` to ``until``, either included."""
        rows = read_table_if_any(self.spark, self.path)
        if rows is None:
            meta = C.META.simpleString()
            schema = f"chat_id {self.chat_type}, seq bigint, ts timestamp, role string, content string, meta {meta}, day date, run string"
            rows = self.spark.createDataFrame([], schema)
        else:  # names such as 7 or 2025-09-06 are read as they were written
            rows = self.spark.read.schema(f"{rows.drop('day', 'run').schema.toDDL()}, day date, run string").parquet(self.path)
        if since is not None:
            rows = rows.where(F.col("day") >= F.lit(since))
        if until is not None:
            rows = rows.where(F.col("day") <= F.lit(until))
        if without_run is not None:
            rows = rows.where(F.col("run") != without_run)
        return rows

    def write(self, rows: DataFrame, run: str, at=None) -> None:
        """Store message rows (chat_id, seq, role, content; ``ts`` and ``meta`` or ``payload_json`` if they have them) as ``run``.

        ``at`` is the time of rows without one, by default now; if none has one, all are of one day and need not be moved. ``rows`` must not read this log lazily: stage them first.
        """
        if not run or not all(c.isalnum() or c in "-_." for c in run):
            raise ValueError(f"a run's name consists of letters, digits and -_. : {run!r}")
        default = F.lit(at).cast("timestamp") if at is not None else F.lit(datetime.datetime.now(datetime.timezone.utc))
        ts = F.coalesce(F.col("ts").cast("timestamp"), default) if "ts" in rows.columns else default
        if "meta" in rows.columns and rows.schema["meta"].dataType == C.META:
            meta = F.col("meta")
        elif "meta" in rows.columns:
            meta = meta_of(F.to_json("meta"))  # a struct of fewer fields is no cast
        else:
            meta = meta_of(F.col("payload_json")) if "payload_json" in rows.columns else F.lit(None).cast(C.META)
        out = rows.select(
            F.col("chat_id").cast(self.chat_type).alias("chat_id"), F.col("seq").cast("bigint").alias("seq"), ts.alias("ts"), "role", "content", meta.alias("meta")
        )
        out = out.withColumn("day", F.to_date("ts")).withColumn("run", F.lit(run))
        before = self._days(run)
        one_day = "ts" not in rows.columns
        # rows of one day are spread by chat and position: a hot chat is more than one task, a day more than one file
        placed = out if one_day else out.repartition("day", F.xxhash64("chat_id", "seq") % 32)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(self.path)
        # days that still have files of before were not written; the rows are not made again to name their days
        after = self._days(run) if before else {}
        for day in before:
            if after.get(day, set()) == before[day]:
                self._delete(f"day={day}/run={run}")

    def _days(self, run: str) -> dict[datetime.date, set[str]]:
        """The days that ``run`` has and the names of their files, which no two writes share."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        days: dict[datetime.date, set[str]] = {}
        for files in ("", "/part-*"):
            pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/day=*/run={run}{files}")
            for s in pattern.getFileSystem(conf).globStatus(pattern) or []:
                path = s.getPath()
                day = (path.getParent() if files else path).getParent().getName().removeprefix("day=")
                names = days.setdefault(datetime.date.fromisoformat(day), set())
                if files:
                    names.add(path.getName())
        return days

    def _delete(self, part: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
