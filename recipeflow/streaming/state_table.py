"""The latest row per key, kept by a stream: one snapshot and the open deltas.

``<path>/delta/<batch>``     the batch's newest row per key; a batch that is retried replaces its own
``<path>/snapshot/<batch>``  the state after that batch

A row wins by its ``order`` value, not by when it arrived: late and repeated batches change nothing, and of equal
values the later batch's row holds.  A row may be a tombstone (``deleted``): it takes part in the order, so an older row that
comes late doesn't bring the key back, and readers don't see it.

Deltas are folded into the next snapshot once they hold ``fold_share`` of its bytes (or are ``most_open``), so the state
is rewritten a bounded number of times per byte that arrives.  A snapshot counts when it is complete; the one before
it and its deltas stay until the next fold, for readers that are under way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, DELETED = "_batch", "_deleted"


class StateTable:
    """State rows of ``schema`` at ``path`` in shared storage, one per ``key``."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str, fold_share: float = 0.5, most_open: int = 64
    ):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.fold_share, self.most_open = fold_share, most_open
        self._stored = T.StructType(schema.fields + [T.StructField(DELETED, T.BooleanType()), T.StructField(BATCH, T.LongType())])

    # -- files
    def _fs(self, path: str):
        hp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hp

    def _done(self, kind: str) -> list[int]:
        """The batches of the complete folders of ``kind``, oldest first."""
        fs, pattern = self._fs(f"{self.path}/{kind}/*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(pattern) or [])

    def _bytes(self, kind: str, batch: int) -> int:
        fs, hp = self._fs(f"{self.path}/{kind}/{batch}")
        return fs.getContentSummary(hp).getLength()

    def _parts(self) -> tuple[int, list[int]]:
        """(batch of the snapshot or -1, batches of the deltas behind it)."""
        snapshots = self._done("snapshot")
        upto = snapshots[-1] if snapshots else -1
        return upto, [b for b in self._done("delta") if b > upto]

    # -- rows
    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = F.struct(*[c for c in rows.columns if c != self.key])
        one = rows.groupBy(self.key).agg(F.max_by(rest, F.struct(self.order, BATCH)).alias("_s"))
        return one.select(self.key, "_s.*").select(*self._stored.names)

    def _state(self) -> DataFrame:
        """The newest row per key, tombstones included."""
        upto, open_ = self._parts()
        paths = [f"{self.path}/snapshot/{upto}"] * (upto >= 0) + [f"{self.path}/delta/{b}" for b in open_]
        rows = self.spark.read.schema(self._stored).parquet(*paths) if paths else self.spark.createDataFrame([], self._stored)
        return self._newest(rows)

    def read(self) -> DataFrame:
        """The rows that are not deleted."""
        return self._state().where(~F.col(DELETED)).select(*self.schema.names)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Take in the rows of ``batch`` (with a boolean column ``deleted`` if they may be tombstones)."""
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in rows.columns else F.lit(False)
        rows = rows.select(*self.schema.names, deleted.alias(DELETED), F.lit(batch).cast("bigint").alias(BATCH))
        self._newest(rows).write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")
        upto, open_ = self._parts()
        held = self._bytes("snapshot", upto) if upto >= 0 else 0
        if open_ and (len(open_) >= self.most_open or sum(self._bytes("delta", b) for b in open_) >= self.fold_share * held):
            self.fold()

    def fold(self) -> None:
        """The next snapshot; what the one before it replaced is deleted."""
        before, open_ = self._parts()
        if not open_:
            return
        self._state().write.mode("overwrite").parquet(f"{self.path}/snapshot/{open_[-1]}")
        for kind, limit in (("snapshot", before - 1), ("delta", before)):
            for batch in self._done(kind):
                if batch <= limit:
                    fs, hp = self._fs(f"{self.path}/{kind}/{batch}")
                    fs.delete(hp, True)
