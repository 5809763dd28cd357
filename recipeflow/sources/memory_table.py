"""The memory of earlier answers: a bucketed table with a Bloom pre-filter and compaction.

``<path>/<version>/rows``    (key, value), bucketed and sorted by key: a join on the key reads it without an exchange, the
                             keys that are looked up move to its buckets
``<path>/<version>/filter``  a blocked Bloom filter as rows (slot, word): a key sets :data:`BITS` bits of one 64-bit word.
                             Every append adds the words of its own keys; readers OR them together

A version's name says its number, buckets and slots (``v3-b64-s1048576``), so a table is read as it was written; the
numbers given to the constructor hold for a new table and from the next compaction on.

A lookup first asks the filter (at most ``slots`` words, so its broadcast has a bound); a key that it rules out never
moves.  The filter only saves work: beyond some six keys a slot it rules out little, and the results are the same.

Appends may repeat: a key that is stored twice has the larger value, in every lookup.  :meth:`MemoryTable.compact` writes
the next version with one row per key and one file per bucket, and removes the version before the one it replaces.
One writer at a time; readers of the replaced version can finish.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that a key sets in its word.
BITS = 4
#: Words of the filter: 2**20 words are 8 MB, the most that is broadcast.
MOST_SLOTS = 1 << 20


class Version(NamedTuple):
    number: int
    buckets: int
    slots: int


def _mask(*key: str) -> Column:
    """The bits of ``key`` in its word."""
    digest = F.xxhash64(*key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):  # six bits of the digest name one of 64
        place = F.shiftrightunsigned(digest, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def _slot(slots: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots))


def filter_words(keys: DataFrame, *key: str, slots: int = MOST_SLOTS) -> DataFrame:
    """(slot, word) of the ``keys``, at most ``slots`` rows."""
    return keys.groupBy(_slot(slots, *key).alias("slot")).agg(F.bit_or(_mask(*key)).alias("word"))


def maybe_among(rows: DataFrame, words: DataFrame, *key: str, slots: int = MOST_SLOTS) -> DataFrame:
    """The ``rows`` whose key the filter ``words`` doesn't rule out, where they are; a NULL in a key is a value like any other."""
    words = F.broadcast(words.select(F.col("slot").alias("_slot"), F.col("word").alias("_word")))  # at most ``slots`` rows
    mask = _mask(*key)
    hit = (_slot(slots, *key) == F.col("_slot")) & (F.col("_word").bitwiseAND(mask) == mask)
    return rows.join(words, hit, "left_semi")


class MemoryTable:
    """A memory at ``path`` in shared storage: ``key`` and ``value`` name its two string columns."""

    def __init__(self, spark: SparkSession, path: str, key: str, value: str, buckets: int = 64, slots: int = MOST_SLOTS):
        if not 0 < slots <= MOST_SLOTS:
            raise ValueError(f"slots must be 1 to {MOST_SLOTS}: {slots}")
        self.spark, self.path, self.key, self.value = spark, path.rstrip("/"), key, value
        self.buckets, self.slots = buckets, slots

    # -- versions
    def _fs(self, path: str):
        hp = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hp

    def _versions(self) -> list[Version]:
        """The complete versions, oldest first."""
        fs, pattern = self._fs(f"{self.path}/v*/_COMPLETE")
        names = [s.getPath().getParent().getName() for s in fs.globStatus(pattern) or []]
        return sorted(Version(*(int(part[1:]) for part in name.split("-"))) for name in names)

    def _folder(self, version: Version) -> str:
        return f"{self.path}/v{version.number}-b{version.buckets}-s{version.slots}"

    def _table(self, version: Version) -> str:
        """The session's name for the rows of a version; the files are the data, the name can be made again at any time."""
        folder = self._folder(version)
        name = "recipeflow_memory_" + hashlib.sha256(folder.encode()).hexdigest()[:24]
        fs, rows = self._fs(f"{folder}/rows")
        fs.mkdirs(rows)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (`{self.key}` STRING, `{self.value}` STRING) USING parquet "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {version.buckets} BUCKETS LOCATION '{folder}/rows'"
        )
        return name

    def _complete(self, version: Version) -> None:
        fs, mark = self._fs(f"{self._folder(version)}/_COMPLETE")
        fs.create(mark, True).close()

    def _current(self) -> Version:
        """The newest complete version; the first one is made here."""
        versions = self._versions()
        if versions:
            return versions[-1]
        first = Version(0, self.buckets, self.slots)
        self._table(first)
        self._complete(first)
        return first

    # -- rows
    def read(self) -> DataFrame:
        """All stored rows, repeated keys included."""
        name = self._table(self._current())
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _insert(self, version: Version, rows: DataFrame) -> None:
        """Each task writes one bucket: the exchange is the table's own bucketing."""
        placed = rows.select(self.key, self.value).where(F.col(self.key).isNotNull()).repartition(version.buckets, self.key)
        placed.write.insertInto(self._table(version))

    def _add_words(self, version: Version, keys: DataFrame) -> None:
        words = filter_words(keys.where(F.col(self.key).isNotNull()), self.key, slots=version.slots)
        words.write.mode("append").parquet(f"{self._folder(version)}/filter")

    def append(self, rows: DataFrame) -> None:
        """Store ``rows`` (key, value); a NULL key is no key.  ``rows`` is read twice: stage it first.

        The filter is written first: a failure in between leaves bits without a row, which costs a lookup and loses nothing.
        """
        version = self._current()
        self._add_words(version, rows)
        self._insert(version, rows)

    def compact(self) -> None:
        """The next version: one row per key, one file per bucket, the filter's words put together."""
        versions = self._versions() or [self._current()]
        old, new = versions[-1], Version(versions[-1].number + 1, self.buckets, self.slots)
        fs, unfinished = self._fs(self._folder(new))
        fs.delete(unfinished, True)  # an attempt that failed
        self._insert(new, self._one_per_key(self.read()))
        if new.slots == old.slots:
            words = self._filter(old)
            if words is not None:
                words.write.mode("overwrite").parquet(f"{self._folder(new)}/filter")
        else:
            self._add_words(new, self.read())
        self._complete(new)
        for gone in versions[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(gone)}")
            fs.delete(self._fs(self._folder(gone))[1], True)

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max(self.value).alias(self.value))

    # -- lookups
    def _filter(self, version: Version) -> DataFrame | None:
        """(slot, word) of a version, one row per slot."""
        folder = f"{self._folder(version)}/filter"
        fs, hp = self._fs(folder)
        if not fs.exists(hp):
            return None
        words = self.spark.read.schema("slot bigint, word bigint").parquet(folder)
        return words.groupBy("slot").agg(F.bit_or("word").alias("word"))

    def maybe_held(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the filter doesn't rule out: all that are stored, and a few others."""
        version = self._current()
        words = self._filter(version)
        if words is None:
            return rows.limit(0)
        return maybe_among(rows, words, self.key, slots=version.slots)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, value) of those ``keys`` that are stored, one row each. ``keys`` are distinct (repeated ones change nothing but the work).

        Only keys move, and only those that the filter lets through; the stored rows are read in their buckets.
        """
        asked = self.maybe_held(keys.select(self.key)).repartition(self._current().buckets, self.key)
        asked = asked.groupBy(self.key).agg(F.lit(1).alias("_asked")).select(self.key)
        return self._one_per_key(self.read().join(asked.hint("shuffle_hash"), self.key))
