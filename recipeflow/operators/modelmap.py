"""Batch model map: one completion per *distinct* request.

The model is a callable supplied by the user through a factory that is called
once per partition inside ``mapInPandas`` (weights load once per Python
worker, never per row).  A model is either

* a callable ``model(request: dict) -> str``, or
* an object with ``complete_batch(pdf: pandas.DataFrame) -> (texts, errors)``
  for vectorised back ends.

Per-row exceptions are captured into an ``error`` column; they never fail the
task, and failed rows are never written to a memory table.

Plan (and why)
--------------
1. ``req_key = sha2(task | system | prompt)`` - a fixed-width key; the wide
   prompt text travels through an exchange only once.
2. ``distinct`` over key and fields - a hash aggregate that collapses duplicate
   prompts map-side, so a prompt repeated by a third of all rows costs one
   row per map task (skew-safe).
3. optional ``left_anti`` against earlier answers; with a memory table, keys that its filter lets
   through are looked up in its buckets (the table itself is not shuffled).
4. model tasks are the tasks of that ``distinct``'s exchange, balanced by request count; its
   partitions are not coalesced, so small-in-bytes but expensive-to-compute batches still fan
   out, and prompts move once (:func:`answered`).
5. ``mapInPandas`` (Arrow batches) runs the model.
6. the answers are written once as a parquet stage in the shared checkpoint
   folder and read back: the model runs exactly once even when the answers
   feed several outputs, and a lost executor does not re-run finished calls.
7. the answers are joined back to every request on ``req_key`` (broadcast
   when AQE sees them small at runtime, else sort-merge with skew splitting);
   rows without a prompt do not move.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeflow.operators.lookup import with_task_params
from recipeflow.session import work_dir
from recipeflow.sources.memory_table import MemoryTable

KEY_SEP = "\u001f"
ANSWER_SCHEMA = "req_key string, text string, error string"
REQUEST_FIELDS = ("task", "system", "prompt", "temperature", "max_tokens", "top_p", "repeat_penalty", "seed")


def request_key(*cols) -> Column:
    """sha256 over the fields that determine an answer."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.sha2(F.concat_ws(KEY_SEP, *parts), 256)


def _error_text(e: BaseException) -> str:
    return str(e) or type(e).__name__


def run_model_batches(factory: Callable, key: str, fields: tuple[str, ...], out_schema_cols=("text", "error")):
    """The function handed to ``mapInPandas``."""

    def fn(batches):
        model = factory()
        batch_fn = getattr(model, "complete_batch", None)
        for pdf in batches:
            if batch_fn is not None:
                try:
                    texts, errors = batch_fn(pdf[list(fields)])
                except Exception as e:  # noqa: BLE001 - a failing batch fails its rows, not the task
                    texts, errors = [None] * len(pdf), [_error_text(e)] * len(pdf)
            else:
                texts, errors = [], []
                for rec in pdf[list(fields)].to_dict("records"):
                    try:
                        texts.append(model(rec))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - per-row error capture
                        texts.append(None)
                        errors.append(_error_text(e))
            yield pd.DataFrame({key: pdf[key].values, out_schema_cols[0]: texts, out_schema_cols[1]: errors})

    return fn


#: Whether Spark puts small partitions of an exchange together.
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def answered(uniq: DataFrame, key: str, run: Callable, schema: str, partitions: int | None, checkpoint: bool) -> DataFrame:
    """The answers of ``run`` (a function for ``mapInPandas``) to the distinct requests ``uniq``.

    Staged answers (``checkpoint``) are computed in as many tasks as the exchange of the ``distinct`` has partitions, of
    whatever size: another exchange to spread them would only move the texts again.  With a number of ``partitions``, or
    unstaged, they are spread by ``key``.
    """
    if partitions is not None or not checkpoint:
        n = partitions or int(uniq.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
        return materialize(uniq.repartition(n, key).mapInPandas(run, schema), checkpoint)
    conf = uniq.sparkSession.conf
    before = conf.get(COALESCE, None)
    conf.set(COALESCE, "false")
    try:
        return materialize(uniq.mapInPandas(run, schema))
    finally:
        if before is None:
            conf.unset(COALESCE)
        else:
            conf.set(COALESCE, before)


def materialize(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Write ``df`` once as parquet into the shared checkpoint folder and read
    it back.

    This cuts lineage like a reliable ``checkpoint()`` (and survives the loss
    of executors), but computes ``df`` exactly once: an eager checkpoint of a
    frame that is not persisted runs its plan a second time to write the
    files - for a model map, a second round of model calls.
    """
    if not enabled:
        return df
    spark = df.sparkSession
    path = work_dir(spark, "stage")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def distinct_requests(requests: DataFrame, fields=("task", "system", "prompt")) -> DataFrame:
    """One row per distinct request key, with the fields it is made of.

    The key fixes the fields (NULL reads as empty, as in the key), so a plain
    ``distinct`` does: a hash aggregate, where a first() per key would sort whole prompts.
    """
    return requests.select(request_key(*fields).alias("req_key"), *[F.coalesce(c, F.lit("")).alias(c) for c in fields]).distinct()


def answer_requests(
    uniq: DataFrame,
    model_factory: Callable,
    fields: tuple[str, ...] = REQUEST_FIELDS,
    partitions: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """(req_key, text, error) for unique requests, computed once."""
    run = run_model_batches(model_factory, "req_key", fields)
    return answered(uniq.select("req_key", *fields), "req_key", run, ANSWER_SCHEMA, partitions, checkpoint)


def map_model(
    requests: DataFrame,
    model_factory: Callable,
    memory: DataFrame | None = None,
    partitions: int | None = None,
    checkpoint: bool = True,
    memory_path: str | None = None,
) -> DataFrame:
    """Answer every request row: adds ``req_key``, ``text``, ``error``.

    ``requests`` needs ``task``, ``system`` and ``prompt``; sampling parameters
    come from the task table.  Rows whose prompt is NULL are not sent to the
    model (text and error stay NULL).  ``memory`` (req_key, text) holds
    earlier successful answers that are reused instead of calling the model.
    ``memory_path`` names a :class:`MemoryTable` in shared storage: what it holds is
    reused, and new successful answers are appended to it.
    """
    if memory is not None:
        memory = memory.select("req_key", "text").dropDuplicates(["req_key"])
    key = F.when(F.col("prompt").isNotNull(), request_key("task", "system", "prompt"))  # no prompt, no request
    req = requests.withColumn("req_key", key)
    todo = with_task_params(distinct_requests(requests.where(F.col("prompt").isNotNull()).select("task", "system", "prompt")))
    if memory is not None:
        todo = todo.join(memory.select("req_key"), "req_key", "left_anti")
    no_error = F.lit(None).cast("string").alias("error")
    if memory_path is None:
        answers = answer_requests(todo, model_factory, REQUEST_FIELDS, partitions, checkpoint)
    else:
        store = MemoryTable(requests.sparkSession, memory_path, "req_key", "text")
        keys = req.where(F.col("req_key").isNotNull()).select("req_key")
        if memory is not None:
            keys = keys.join(memory.select("req_key"), "req_key", "left_anti")
        todo, held = split_held(todo, keys, store)
        answers = held.select("req_key", "text", no_error)
        if todo is not None:
            new = answer_requests(todo, model_factory, REQUEST_FIELDS, partitions)  # read twice: always staged
            store.append(successful_answers(new))
            answers = new.unionByName(answers)
    if memory is not None:
        answers = answers.unionByName(memory.select("req_key", "text", no_error))
    asked, added = F.col("req_key").isNotNull(), ("req_key", "text", "error")
    called = req.where(asked).join(answers, "req_key", "left").select(*requests.columns, *added)
    # rows without a request stay where they are
    none = F.lit(None).cast("string")
    others = requests.where(F.col("prompt").isNull()).select("*", *[none.alias(c) for c in added])
    return called.unionByName(others)


def split_held(todo: DataFrame, keys: DataFrame, store: MemoryTable) -> tuple[DataFrame | None, DataFrame]:
    """(requests that ``store`` has no answer to, or None if there is none; (key, value) of the others).

    ``todo`` are distinct requests, ``keys`` their keys, repeated or not. Keys alone are looked up; the wide rows are read for the misses only, and not
    at all if everything is held.
    """
    keys = materialize(keys.select(store.key).distinct())
    held = materialize(store.lookup(keys))
    misses = materialize(keys.join(held.select(store.key), store.key, "left_anti"))
    return (None if misses.isEmpty() else todo.join(misses, store.key)), held


def successful_answers(answered: DataFrame) -> DataFrame:
    """Rows fit for a memory table: errors are not memorised."""
    return answered.where(F.col("error").isNull() & F.col("text").isNotNull()).select("req_key", "text").dropDuplicates(
        ["req_key"]
    )
