"""Machine translation over whole tables, with a reusable translation memory.

The translator is a user-supplied callable built by a factory once per
partition: ``translator(text, src, tgt) -> str`` (or an object with
``complete_batch(pdf[text, src, tgt]) -> (texts, errors)``).

Semantics (per call of the application's cached translator):

* codes go through ``safe_lang_code``; if the target or the source cannot be
  translated (``auto`` included) the text is returned unchanged, without a
  model call;
* otherwise the model is asked once per distinct (text, src, tgt); answers
  found in the memory table are reused; failures are reported per row and
  are never memorised.

Plan: gate (narrow) -> distinct keys (partial aggregate, skew-safe) ->
``left_anti`` memory -> ``mapInPandas`` in that aggregate's tasks ->
checkpoint -> join back on the key, for the rows that have one (the others
do not move).  Arrays are exploded with their position,
translated as items and re-assembled per row key (``array_sort`` over
``collect_list(struct(pos, value))``: one row's own items, never a hot group).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeflow.functions.text import blank_to_empty, can_translate, col, normalize_query, safe_lang_code, strip
from recipeflow.operators.modelmap import KEY_SEP, answered, materialize, run_model_batches, split_held
from recipeflow.sources.memory_table import MemoryTable

MEMORY_SCHEMA = "mt_key string, text string, src string, tgt string, translated string"


def mt_key(text, src, tgt) -> Column:
    return F.sha2(F.concat_ws(KEY_SEP, col(src), col(tgt), blank_to_empty(text)), 256)


def _answer(uniq: DataFrame, factory: Callable, partitions: int | None, checkpoint: bool) -> DataFrame:
    def call_factory():
        fn = factory()
        if hasattr(fn, "complete_batch"):
            return fn
        return lambda r: fn(r["text"], r["src"], r["tgt"])

    run = run_model_batches(call_factory, "mt_key", ("text", "src", "tgt"), ("translated", "mt_error"))
    uniq = uniq.select("mt_key", "text", "src", "tgt")
    return answered(uniq, "mt_key", run, "mt_key string, translated string, mt_error string", partitions, checkpoint)


def translate_texts(
    df: DataFrame,
    text: str,
    src,
    tgt,
    translator_factory: Callable,
    memory: DataFrame | None = None,
    out: str = "translated",
    gate: bool = True,
    partitions: int | None = None,
    checkpoint: bool = True,
    memory_path: str | None = None,
) -> DataFrame:
    """Adds ``out`` (translation, or the text when not translatable), ``out_error``
    (the model's error, NULL otherwise) and ``out_called`` (model consulted).

    With ``gate=False`` (raw mode) every row with non-blank text goes to the
    model, codes are used as given and a missing source means 'en'.  ``memory_path``
    names a :class:`MemoryTable` in shared storage: what it holds is reused, and new
    successful translations are appended to it.
    """
    if gate:
        s_code, t_code = safe_lang_code(src), safe_lang_code(tgt)
        go = can_translate(t_code) & can_translate(s_code)
    else:
        s_code = F.coalesce(F.nullif(col(src), F.lit("")), F.lit("en"))
        t_code = col(tgt)
        go = strip(blank_to_empty(col(text))) != ""
    base = (
        df.withColumn("_src", s_code)
        .withColumn("_tgt", t_code)
        .withColumn("_go", go)
        .withColumn("mt_key", F.when(F.col("_go"), mt_key(col(text), F.col("_src"), F.col("_tgt"))))
    )
    todo = (
        base.where(F.col("_go"))
        .select("mt_key", blank_to_empty(col(text)).alias("text"), F.col("_src").alias("src"), F.col("_tgt").alias("tgt"))
        .distinct()  # the key fixes the fields
    )
    if memory is not None:
        todo = todo.join(memory.select("mt_key"), "mt_key", "left_anti")
    if memory_path is None:
        answers = _answer(todo, translator_factory, partitions, checkpoint)
    else:
        store = MemoryTable(df.sparkSession, memory_path, "mt_key", "translated")
        keys = base.where(F.col("_go")).select("mt_key")
        if memory is not None:
            keys = keys.join(memory.select("mt_key"), "mt_key", "left_anti")
        todo, held = split_held(todo, keys, store)
        answers = held.select("mt_key", "translated", F.lit(None).cast("string").alias("mt_error"))
        if todo is not None:
            new = _answer(todo, translator_factory, partitions, True)  # read twice: always staged
            store.append(new.where(F.col("mt_error").isNull() & F.col("translated").isNotNull()))
            answers = new.unionByName(answers)
    if memory is not None:
        answers = answers.unionByName(
            memory.select("mt_key", "translated", F.lit(None).cast("string").alias("mt_error")).dropDuplicates(
                ["mt_key"]
            )
        )
    called = base.where(F.col("_go")).join(answers, "mt_key", "left").select(
        *df.columns, F.col("translated").alias(out), F.col("mt_error").alias(out + "_error"), F.lit(True).alias(out + "_called")
    )
    # rows without a request keep their text where they are
    others = base.where(~F.col("_go")).select(
        *df.columns, col(text).alias(out), F.lit(None).cast("string").alias(out + "_error"), F.lit(False).alias(out + "_called")
    )
    return called.unionByName(others)


def memory_rows(translated: DataFrame, text: str, src, tgt, out: str = "translated") -> DataFrame:
    """Successful model answers as translation-memory rows (errors are skipped)."""
    s_code, t_code = safe_lang_code(src), safe_lang_code(tgt)
    return (
        translated.where(F.col(out + "_called") & F.col(out + "_error").isNull())
        .select(
            mt_key(col(text), s_code, t_code).alias("mt_key"),
            col(text).alias("text"),
            s_code.alias("src"),
            t_code.alias("tgt"),
            F.col(out).alias("translated"),
        )
        .dropDuplicates(["mt_key"])
    )


def translate(df, text, src, tgt, translator_factory, memory=None, out="translated", **kw) -> DataFrame:
    """Gated, memoised translation; failures leave ``out`` NULL with the error."""
    r = translate_texts(df, text, src, tgt, translator_factory, memory, out, **kw)
    return r.withColumn(out, F.when(F.col(out + "_error").isNull(), F.col(out)))


def translate_block(df, text, src, tgt, translator_factory, memory=None, out="translated", **kw) -> DataFrame:
    """Whole text in one call; a failure returns the original text."""
    r = translate_texts(df, text, src, tgt, translator_factory, memory, out, **kw)
    return r.withColumn(out, F.when(F.col(out + "_error").isNull(), F.col(out)).otherwise(col(text)))


def translate_raw(df, text, src, tgt, translator_factory, out="translated", **kw) -> DataFrame:
    """No support gate and no memory: blank text passes through, a missing
    source means 'en', and unknown codes surface as errors."""
    r = translate_texts(df, text, src, tgt, translator_factory, None, out, gate=False, **kw)
    return r.withColumn(out, F.when(F.col(out + "_error").isNull(), F.col(out)))


def back_translate_title(df, title, lang, translator_factory, memory=None, out="title_en", **kw) -> DataFrame:
    """UI-language title -> English; any failure keeps the title.  English
    titles are never sent to the model."""
    src = F.when(safe_lang_code(lang) != "en", safe_lang_code(lang)).otherwise(F.lit("auto"))
    r = translate_texts(df, title, src, F.lit("en"), translator_factory, memory, out, **kw)
    return r.withColumn(out, F.when(F.col(out + "_error").isNull(), F.col(out)).otherwise(col(title)))


def translate_array(
    df: DataFrame,
    key: str,
    arr: str,
    src,
    tgt,
    translator_factory: Callable,
    memory: DataFrame | None = None,
    out: str = "translated",
    unique_key: bool = False,
    **kw,
) -> DataFrame:
    """Item-wise translation of an array column.

    Each item is stripped and translated; a failed item keeps its original
    (unstripped) text; if the pair of codes is not translatable the array is
    returned unchanged.  Rows are staged with numbers of their own, so a repeated ``key`` merges nothing;
    with ``unique_key`` the caller says that ``key`` identifies the rows already.
    """
    if not unique_key:
        df = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
        key = "_row"
    go = can_translate(safe_lang_code(tgt)) & can_translate(safe_lang_code(src))
    items = df.where(go).select(
        key, col(src).alias("_s"), col(tgt).alias("_t"), F.posexplode(arr).alias("_pos", "_item")
    )
    items = items.withColumn("_clean", strip(F.col("_item")))
    tr = translate_texts(items, "_clean", "_s", "_t", translator_factory, memory, "_tr", **kw)
    tr = tr.withColumn("_val", F.when(F.col("_tr_error").isNull(), F.col("_tr")).otherwise(F.col("_item")))
    back = tr.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_val"))).alias("_pairs"))
    back = back.select(key, F.transform("_pairs", lambda x: x["_val"]).alias("_arr"))
    # rows without items to translate stay where they are; of the others the array itself need not be moved
    asked = F.coalesce(go & (F.size(arr) > 0) & F.col(key).isNotNull(), F.lit(False))
    called = df.where(asked).join(back, key, "left").withColumnRenamed("_arr", out)
    joined = called.unionByName(df.where(~asked).withColumn(out, col(arr)))
    return joined if unique_key else joined.drop("_row")


def query_to_english(df, text, lang, translator_factory, memory=None, out="query_en", **kw) -> DataFrame:
    """Prefer a translation to English (when it contains an ASCII letter),
    else the transliteration / accent folding of ``normalize_query``."""
    code = safe_lang_code(lang)
    d = df.withColumn("_q", strip(blank_to_empty(col(text)))).withColumn(
        "_qsrc", F.when((code != "en") & can_translate(code) & (F.col("_q") != ""), code).otherwise(F.lit("auto"))
    )
    r = translate_texts(d, "_q", "_qsrc", F.lit("en"), translator_factory, memory, "_qen", **kw)
    use_mt = F.col("_qen_called") & F.col("_qen_error").isNull() & F.col("_qen").rlike("[A-Za-z]")
    res = F.when(F.col("_q") == "", F.lit("")).when(use_mt, F.col("_qen")).otherwise(normalize_query(F.col("_q"), code))
    return r.withColumn(out, res).drop("_q", "_qsrc", "_qen", "_qen_error", "_qen_called")
