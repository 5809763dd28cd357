"""Asset audit: is every object of a manifest present, large enough and intact?

Re-aimed from a local downloader to a lake-object audit.  ``manifest``
(key, path, sha256) is left-joined to ``objects`` (path, size, content) on
``path``; a ``when`` ladder names the first failing check:

``missing``       no object at the path
``too_small``     size <= 1024 bytes
``hash_mismatch`` a sha256 is given and differs (compared case-insensitively)
``ok``            otherwise

``audit_files`` does the same over the files of a folder: sizes come from their status alone, and only files
whose manifest row gives a hash are read.

The hash is checked whenever one is given.  ``sha2`` runs JVM-side on the
object bytes in the same stage as the scan; only (path, size, digest) cross
the exchange of the join, never the content.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeflow.functions import constants as K


#: Up to this many distinct names of hashed files the listing is cut to them, so that no other file is opened;
#: beyond it every file over the least size is read. The result is the same.
MOST_NAMES = 10_000


def _status(present: Column, given: Column, min_bytes: int) -> Column:
    return (
        F.when(~present, F.lit("missing"))
        .when(F.col("size") <= min_bytes, F.lit("too_small"))
        .when(given & ~F.col("_digest").eqNullSafe(F.lower("sha256")), F.lit("hash_mismatch"))
        .otherwise(F.lit("ok"))
    )


def _hash_given() -> Column:
    return F.coalesce(F.col("sha256"), F.lit("")) != ""


def audit_manifest(manifest: DataFrame, objects: DataFrame, min_bytes: int = K.ASSET_MIN_BYTES) -> DataFrame:
    digests = objects.select("path", F.col("size").cast("bigint").alias("size"), F.sha2("content", 256).alias("_digest"))
    j = manifest.join(digests, "path", "left")
    return j.select("key", "path", "size", _status(F.col("_digest").isNotNull(), _hash_given(), min_bytes).alias("status"))


def audit_files(manifest: DataFrame, folder: str, min_bytes: int = K.ASSET_MIN_BYTES) -> DataFrame:
    """(key, path, size, status) of ``manifest`` (key, path, sha256) against the files below ``folder``, to which its paths are
    relative. A file is one cell, so files to be hashed must be under 2 GB; sizes have no bound. Spark doesn't list a file of
    0 bytes: it is ``missing``."""
    spark = manifest.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.substr("path", F.lit(len(root) + 2)).alias("path")
    sizes = files.select(relative, F.col("length").alias("size"))  # no content: nothing is opened
    asked = manifest.where(_hash_given()).select("path").distinct()
    names = asked.select(F.element_at(F.split("path", "/"), -1).alias("name")).where("name is not null").distinct()
    names = [r["name"] for r in names.limit(MOST_NAMES + 1).collect()]
    read = files.where(F.col("length") > min_bytes)  # pushed to the source
    if len(names) <= MOST_NAMES and all(re.fullmatch(r"[\w.-]+", n, re.ASCII) for n in names):  # others are listed in an encoded form
        read = read.where(F.col("_metadata.file_name").isin(names))  # cuts the listing
    digests = read.select(relative, F.sha2("content", 256).alias("_digest"))
    j = manifest.join(sizes, "path", "left")
    plain = j.where(~_hash_given()).withColumn("_digest", F.lit(None).cast("string"))
    hashed = j.where(_hash_given()).join(digests, "path", "left")
    both = plain.select("key", "path", "sha256", "size", "_digest").unionByName(hashed.select("key", "path", "sha256", "size", "_digest"))
    return both.select("key", "path", "size", _status(F.col("size").isNotNull(), _hash_given(), min_bytes).alias("status"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: overall ok flag and counts per status (a global partial aggregate)."""
    s = F.col("status")
    return audited.agg(
        F.bool_and(s == "ok").alias("all_ok"),
        F.count(F.lit(1)).alias("n_assets"),
        F.count(F.when(s == "ok", 1)).alias("n_ok"),
        F.count(F.when(s == "missing", 1)).alias("n_missing"),
        F.count(F.when(s == "too_small", 1)).alias("n_too_small"),
        F.count(F.when(s == "hash_mismatch", 1)).alias("n_hash_mismatch"),
    )
