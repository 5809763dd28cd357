"""Exact de-duplication with a heavy-hitter split (DataFrame functions only).

A few texts may make up a third of all rows.  Grouping by digest would put each
of them into one task, so the frequent digests are split off first:

1. every row's digest is written once as a narrow stage (id, digest, row);
2. a Misra-Gries summary (``approx_top_k``, a frequent-items sketch of bounded
   size; summaries are merged by adding their counters) names every digest that holds more than about
   ``1 / tracked`` of the rows;
3. those candidates are verified by an exact count over the stage, and their
   winners - at most ``tracked`` rows, whatever the size of the input - are
   broadcast: their copies are decided map-side, without a shuffle;
4. the remaining digests, none of them frequent, are shuffled as usual.

Defined results: a NULL text counts as empty; all empty texts are equal.  Of equal
texts the smallest id stays, NULL ids come last; among repeated rows (same id
and text) exactly one stays.  An empty table gives an empty result.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recipeflow.llm.common import boxed, key_bitmap, with_maybe
from recipeflow.session import stage

#: A run of these is one space when texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """sha256 (lower-case hex) of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " "), 256)


def frequent_values(df: DataFrame, col: str, tracked: int) -> DataFrame:
    """At most ``tracked`` values of ``col``, among them every one that holds more
    than ``1 / (0.75 * tracked)`` of the rows (Misra-Gries summaries, merged by adding counters)."""
    kept = tracked * 3 // 4
    partial = df.where(F.col(col).isNotNull()).groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("_g")).agg(
        F.expr(f"approx_top_k({col}, {kept}, {tracked})").alias("_s")
    )
    counters = partial.select(F.explode("_s").alias("_t")).groupBy(F.col("_t.item").alias(col)).agg(F.sum("_t.count").alias("_n"))
    return counters.orderBy(F.desc("_n"), col).limit(kept).select(col)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    keyed = stage(
        docs.select(
            F.col(id_col).alias("_id"),
            text_digest(F.col(text_col)).alias("_digest"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "exact-digests",
    )
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    candidates = frequent_values(keyed, "_digest", tracked)
    winners = stage(
        keyed.join(F.broadcast(candidates), "_digest")
        .groupBy("_digest")
        .agg(F.min(rank).alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1"),
        "exact-winners",
    )
    heavy = keyed.join(F.broadcast(winners), "_digest")
    same = Window.partitionBy("_digest")
    rest = keyed.join(F.broadcast(winners), "_digest", "left_anti").select(
        "*", F.min(rank).over(same).alias("_keep"), F.count(F.lit(1)).over(same).alias("_n")
    )
    return heavy.select(*rest.columns).unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.col("_keep.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_keep.row")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 1024) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    The decisions travel as (id, digest) of the rows to drop.  A bitmap of them, bounded and broadcast, passes most rows
    that stay; only rows that it can't rule out are shuffled to the decisions.  Rows repeated in whole
    (same id and text) are told apart by a last ``dropDuplicates`` over those rows only.
    """
    keys = stage(
        exact_classes(docs, id_col, text_col, tracked)
        .groupBy(F.col(id_col).alias("_kid"), F.col("text_sha256").alias("_kdigest"))
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
        .where("not _kept or _n > 1"),
        "exact-dropped",
    )
    marked = boxed(docs, _id=F.col(id_col), _digest=text_digest(F.col(text_col)))
    same = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_digest") == F.col("_kdigest"))
    bitmap = stage(key_bitmap(keys, "_kid", "_kdigest"), "exact-dropped-bits")
    marked = with_maybe(marked, bitmap, F.col("_id"), F.col("_digest"))
    kept, marked = marked.where("not _maybe"), marked.where("_maybe")
    out = kept.unionByName(marked.join(keys, same, "left_anti"))
    repeated = keys.where("_kept")
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates(["_id", "_digest"]))
    return out.select("_doc.*")
