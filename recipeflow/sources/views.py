"""Derived input views V1-V9 (see FIXTURES.md §2).

Each view is derived by Spark from the driver tables, so its size grows with
them.  Every view has a DuckDB twin in :mod:`recipeflow.plans.oracle_views`;
the two must stay in step.

Scale notes
-----------
* V2/V3 (one answer text per order) join ``lineitem`` to ``part`` and group
  by order.  The join is left to the optimizer (``part`` is broadcast only
  when its estimated size is under ``spark.sql.autoBroadcastJoinThreshold``,
  otherwise sort-merge; AQE may switch at runtime with real sizes).
  De-duplication, ordering and numbering of an order's items happen in ONE
  aggregate: ``sort_array(collect_set(struct(...)))`` - partial aggregation
  de-duplicates map-side before the single exchange on ``l_orderkey``.
* Everything else is a narrow projection of one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeflow.functions import constants as K
from recipeflow.functions.render import SYSTEM_PROMPT
from recipeflow.sources.tables import load

TS_BASE = "2025-09-06 08:35:52"

# V8: 1:1 letter pairs used to put ASCII names into other scripts (our own
# choice; covers multi-letter and unmapped outputs of the romanisers).
LATIN_LOWER = "abcdefghijklmnopqrstuvwxyz"
LATIN_UPPER = LATIN_LOWER.upper()
CYR_LOWER = "абцдёфгхийклмнопщрстувюъыж"
CYR_UPPER = "АБЦДЁФГХИЙКЛМНОПЩРСТУВЮЪЫЖ"
GREEK_LOWER = "αβψδεφγηιξκλμνοπθρστύωςχζζ"
GREEK_UPPER = "ΑΒΨΔΕΦΓΗΙΞΚΛΜΝΟΠΘΡΣΤΥΩΣΧΖΖ"
KANA_SYLLABLES = (
    "す", "し", "カ", "レ", "ー", "と", "う", "ふ", "ガ", "き",
    "ゃ", "べ", "つ", "み", "そ", "ラ", "ン", "ぱ", "ヴ", "の",
)

assert len(CYR_LOWER) == 26 and len(CYR_UPPER) == 26
assert len(GREEK_LOWER) == 26 and len(GREEK_UPPER) == 26


# --------------------------------------------------------------------------
# V1 messages
# --------------------------------------------------------------------------


def v1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chat message, with ``meta.payload.recipe_detail`` on some
    assistant turns and both timestamp formats."""
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    ts = F.to_timestamp(F.lit(TS_BASE)) + F.make_dt_interval(secs=(F.col("turn") / 2).cast("int"))
    ts_raw = F.when(
        F.col("conv_id") % 2 == 0, F.date_format(ts, K.TS_FORMAT_CURRENT)
    ).otherwise(F.date_format(ts, K.TS_FORMAT_OLDER))
    has_recipe = (F.col("role") == "assistant") & (F.col("conv_id") % 4 != 0)
    turn_s = F.col("turn").cast("string")
    ing = F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("item "), turn_s, F.lit("a")), F.concat(F.lit("item "), turn_s, F.lit("b")))
    )
    steps = F.when(F.col("conv_id") % 10 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("cook "), F.col("conv_id").cast("string"), F.lit("-"), turn_s))
    )
    recipe = F.struct(
        F.concat(F.lit("Recipe "), F.col("conv_id").cast("string"), F.lit("-"), turn_s).alias("title"),
        ing.alias("ingredients"),
        steps.alias("steps"),
    )
    meta = F.when(
        has_recipe,
        F.struct(
            F.struct(
                recipe.alias("recipe_detail"),
                F.lit(None).cast("struct<filters:array<string>,text:string>").alias("health_check"),
            ).alias("payload")
        ),
    )
    return c.select(
        F.col("conv_id").alias("chat_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        ts_raw.alias("ts_raw"),
        meta.alias("meta"),
    )


# --------------------------------------------------------------------------
# V2 / V3: model answers built from an order's items
# --------------------------------------------------------------------------


def _order_items(spark: SparkSession, sf_dir: str, extra: str) -> DataFrame:
    """(l_orderkey, items) with items = sorted distinct (l_linenumber, p_name, extra)."""
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    part = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    third = (F.col("l_quantity").cast("bigint") if extra == "q" else F.col("p_type")).alias(extra)
    item = F.struct(F.col("l_linenumber"), F.col("p_name"), third)
    return j.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(item)).alias("items"))


def v2_title_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulleted title lists in three styles (line, inline ' * ', quoted + preface)."""
    g = _order_items(spark, sf_dir, "p_type")
    k3 = F.col("l_orderkey") % 3
    bold = F.transform("items", lambda x: F.concat(F.lit("- **"), x["p_name"], F.lit("**: "), x["p_type"]))
    quoted = F.transform("items", lambda x: F.concat(F.lit('- "'), x["p_name"], F.lit('"')))
    text = (
        F.when(k3 == 1, F.array_join(bold, " * "))
        .when(k3 == 2, F.concat(F.lit("Here are some recipes:\n"), F.array_join(quoted, "\n")))
        .otherwise(F.array_join(bold, "\n"))
    )
    return g.select(F.col("l_orderkey").alias("answer_id"), text.alias("text"))


def v3_recipe_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe answers in four layouts (headings, bullets, 'Method:', none)."""
    g = _order_items(spark, sf_dir, "q")
    m = F.col("l_orderkey") % 5
    ing_lines = F.transform(
        "items",
        lambda x: F.concat(
            F.when(m == 1, F.lit("• ")).otherwise(F.lit("- ")), x["q"].cast("string"), F.lit(" "), x["p_name"]
        ),
    )
    step_lines = F.transform(
        "items",
        lambda x, i: F.concat(
            F.when(m == 3, F.lit("")).otherwise(F.concat((i + 1).cast("string"), F.lit(". "))),
            F.lit("Add the "),
            x["p_name"],
        ),
    )
    text = F.concat(
        F.when(m == 3, F.lit("")).otherwise(F.lit("Ingredients:\n")),
        F.array_join(ing_lines, "\n"),
        F.when(m == 3, F.lit("\n"))
        .when(m == 2, F.lit("\n\nMethod:\n"))
        .otherwise(F.lit("\n\nSteps:\n")),
        F.array_join(step_lines, "\n"),
        F.when(m == 4, F.lit("\nEnjoy")).otherwise(F.lit("")),
    )
    return g.select(F.col("l_orderkey").alias("recipe_id"), text.alias("text"))


# --------------------------------------------------------------------------
# V4 queries, V5 profiles, V6 pointers
# --------------------------------------------------------------------------


def v4_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    k = F.col("doc_id") % 7
    lang = (
        F.when(k == 1, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
        .when(k == 2, F.lit("el"))
        .when(k == 3, F.lit(None).cast("string"))
        .when(k == 4, F.lit("zh-cn"))
        .when(k == 5, F.lit("te"))
        .otherwise(F.col("lang"))
    )
    return d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("raw"), lang.alias("display_lang"))


def v5_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    flags = [((F.col("c_custkey") * (i + 3)) % 7 < 2).alias(f) for i, f in enumerate(K.PROFILE_FLAGS)]
    k3 = F.col("c_custkey") % 3
    allergies = (
        F.when(k3 == 0, F.array().cast("array<string>"))
        .when(k3 == 1, F.array(F.col("c_mktsegment")))
        .otherwise(F.array(F.col("c_mktsegment"), F.lit("Soy")))
    )
    return c.select(F.col("c_custkey").alias("profile_id"), *flags, allergies.alias("allergies"))


def v6_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "user_id").distinct()
    k3 = F.col("user_id") % 3
    chat = (
        F.when(k3 == 0, (F.col("user_id") / 3).cast("bigint"))
        .when(k3 == 1, F.col("user_id") + 1_000_000)
        .otherwise(F.lit(None).cast("bigint"))
    )
    return e.select("user_id", chat.alias("chat_id"))


# --------------------------------------------------------------------------
# V7 manifest / objects, V8 scripts, V9 requests
# --------------------------------------------------------------------------


def v7_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", "doc_id", "text")
    h = F.sha2(F.col("text"), 256)
    sha = (
        F.when(F.col("doc_id") % 17 == 0, F.lit(""))
        .when(F.col("doc_id") % 11 == 0, F.sha2(F.concat(F.col("text"), F.lit("#")), 256))
        .when(F.col("doc_id") % 2 == 0, F.upper(h))
        .otherwise(h)
    )
    return d.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("key"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        sha.alias("sha256"),
    )


def v7_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", "doc_id", "text").where(F.col("doc_id") % 13 != 0)
    return d.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("text").alias("content"),
    )


def v8_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_name")
    cap = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 30))
    syl = F.array(*[F.lit(s) for s in KANA_SYLLABLES])
    n = len(KANA_SYLLABLES)
    k = F.col("p_partkey")

    def pick(e):
        return F.element_at(syl, (e % n).cast("int") + 1)

    kana = F.concat(pick(k), pick((k / n).cast("bigint")), pick((k / (n * n)).cast("bigint")), pick(k * 7))
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.translate(cap, LATIN_LOWER + LATIN_UPPER, CYR_LOWER + CYR_UPPER).alias("cyr"),
        F.translate(cap, LATIN_LOWER + LATIN_UPPER, GREEK_LOWER + GREEK_UPPER).alias("greek"),
        kana.alias("kana"),
    )


TASKS = ("suggest", "detail", "nutrition", "health", "other")


def v9_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", "doc_id", "text")
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS]), (F.col("doc_id") % len(TASKS)).cast("int") + 1)
    return d.select(
        F.col("doc_id").alias("request_id"),
        task.alias("task"),
        F.lit(SYSTEM_PROMPT).alias("system"),
        F.col("text").alias("prompt"),
    )
