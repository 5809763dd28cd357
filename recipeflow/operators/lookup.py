"""Fixed dimension tables as DataFrames, for explicit broadcast joins.

Each table has a proven size bound (it is built from a literal of at most a
few dozen rows), which is what makes ``broadcast`` safe here regardless of the
size of the fact side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeflow.functions import constants as K


def task_params_df(spark: SparkSession) -> DataFrame:
    rows = [(t, float(temp), int(mx)) for t, temp, mx in K.TASK_PARAMS]
    return spark.createDataFrame(rows, "task string, temperature double, max_tokens bigint")


def with_task_params(requests: DataFrame, task: str = "task") -> DataFrame:
    """Sampling parameters per task; unknown tasks get the defaults.

    Broadcast left join on a 4-row literal table (bounded by construction).
    """
    spark = requests.sparkSession
    params = F.broadcast(task_params_df(spark)).withColumnRenamed("task", "_ptask")
    temp, mx = K.DEFAULT_TASK_PARAMS
    return (
        requests.join(params, requests[task] == params["_ptask"], "left")
        .drop("_ptask")
        .withColumn("temperature", F.coalesce("temperature", F.lit(float(temp))))
        .withColumn("max_tokens", F.coalesce("max_tokens", F.lit(int(mx)).cast("bigint")))
        .withColumn("top_p", F.lit(K.TOP_P))
        .withColumn("repeat_penalty", F.lit(K.REPEAT_PENALTY))
        .withColumn("seed", F.lit(K.SEED).cast("bigint"))
    )


def languages_df(spark: SparkSession) -> DataFrame:
    """(code, name, mt_ok, ing_label, step_label) for every supported code."""
    rows = []
    for c in K.SUPPORTED_LANGS:
        ing, st = K.SECTION_LABELS.get(c, K.DEFAULT_SECTION_LABELS)
        rows.append((c, K.LANG_NAMES.get(c, "English"), c in K.MT_LANGS, ing, st))
    return spark.createDataFrame(rows, "code string, name string, mt_ok boolean, ing_label string, step_label string")


def filter_labels_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.FILTER_LABELS.items()), "tag string, label string")
