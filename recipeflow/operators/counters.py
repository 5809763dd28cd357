"""Run counters: what the application logged per request, as aggregates.

``observed``         named counters of a frame, taken in the pass of the job that consumes it
``run_counters``     the queryable form, a partial ``groupBy`` aggregate
``counter_sketches`` counters that can be merged: sums, and sketches of distinct texts and of text lengths; store them per
                     day or run, and ``merge_counters`` puts any of them together without reading a text again
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recipeflow.functions.parse import split_lines
from recipeflow.functions.text import blank_to_empty, safe_lang_code

#: Shares of the texts whose greatest length is reported.
SHARES = (0.5, 0.9, 0.99)


def _length(text: str) -> Column:
    return F.char_length(blank_to_empty(F.col(text)))


def observed(df: DataFrame, text: str, counters: Observation | None) -> DataFrame:
    """``df``, whose rows, NULL texts, characters, distinct texts (about 5 %) and lengths by :data:`SHARES` ``counters`` reports
    once an action has read it; None leaves it as it is.  An action that stops early, such as a limit, counts what it read."""
    if counters is None:
        return df
    return df.observe(
        counters,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(text).isNull()).alias("nulls"),
        F.coalesce(F.sum(_length(text)), F.lit(0)).alias("chars"),
        F.approx_count_distinct(text).alias("distinct"),
        F.percentile_approx(_length(text), F.array(*[F.lit(s) for s in SHARES])).alias("lengths"),
    )


def _keys(lang: str, task: str | None) -> list[Column]:
    return [safe_lang_code(F.col(lang)).alias("lang")] + ([F.col(task).alias("task")] if task is not None else [])


def run_counters(df: DataFrame, text: str, lang: str, task: str | None = None) -> DataFrame:
    """Per (language, task): requests, characters and non-blank lines."""
    t = blank_to_empty(F.col(text))
    return df.groupBy(*_keys(lang, task)).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(F.char_length(t).cast("bigint")).alias("n_chars"),
        F.sum(F.size(split_lines(t)).cast("bigint")).alias("n_lines"),
    )


def counter_sketches(df: DataFrame, text: str, lang: str, task: str | None = None, part: str | None = None) -> DataFrame:
    """Per (language, task) and ``part`` (a day or run): n_requests, n_chars and the sketches ``texts`` (distinct texts, NULL
    as empty, about 1 %) and ``lengths`` (quantiles of their characters)."""
    t = blank_to_empty(F.col(text))
    return df.groupBy(*_keys(lang, task), *([part] if part else [])).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(F.char_length(t).cast("bigint")).alias("n_chars"),
        F.hll_sketch_agg(t, 14).alias("texts"),
        F.kll_sketch_agg_bigint(F.char_length(t).cast("bigint")).alias("lengths"),
    )


def merge_counters(sketches: DataFrame, *keys: str) -> DataFrame:
    """Counters of the groups of ``keys`` from stored sketches: n_requests, n_chars, n_texts (estimated distinct texts) and
    p50, p90, p99 (estimated lengths)."""
    lengths = F.kll_merge_agg_bigint("lengths")
    return (
        sketches.groupBy(*keys)
        .agg(
            F.sum("n_requests").alias("n_requests"),
            F.sum("n_chars").alias("n_chars"),
            F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("n_texts"),
            lengths.alias("_lengths"),
        )
        .select("*", *[F.kll_sketch_get_quantile_bigint("_lengths", F.lit(s)).alias(f"p{int(s * 100)}") for s in SHARES])
        .drop("_lengths")
    )
