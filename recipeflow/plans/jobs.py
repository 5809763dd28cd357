"""The four user-visible jobs (rows 55-58), each over a whole table.

suggest   queries  -> normalised query -> prompt -> model (default titles on
          failure) -> titles -> translated titles -> rendered list ->
          user + assistant message rows
recipe    titles   -> English title -> prompt -> model -> parsed recipe
          (default recipe on failure, untranslated) -> caps -> translated
          lists -> rendered recipe -> message rows with payload
nutrition lists    -> items -> empty guard -> prompt -> model -> stripped text
health   messages + saved filters -> latest recipe per chat -> guard
          (rejected chats are a side output) -> prompt -> model -> translated
          block -> check block message with payload

``counters`` takes a job's counters (:func:`recipeflow.operators.counters.observed`) in the pass that reads its rows.

Model calls go through :func:`recipeflow.operators.modelmap.map_model` (one
call per distinct request, answers checkpointed) and translations through
the translation-memory operators; everything else is narrow column work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeflow.functions import constants as K
from recipeflow.functions import parse as P
from recipeflow.functions import render as R
from recipeflow.functions import text as X
from recipeflow.operators import chatlog as C
from recipeflow.operators.counters import observed
from recipeflow.operators.modelmap import map_model, materialize
from recipeflow.sources.message_log import MessageLog, meta_of
from recipeflow.operators.translate import back_translate_title, translate_array, translate_block
from recipeflow.session import is_stage


def _carried(df: DataFrame) -> list[str]:
    """The chat columns of a job's input, which its messages keep."""
    return [c for c in ("chat_id", "ts") if c in df.columns]


def _stored(memory_path: str | None, kind: str) -> str | None:
    return None if memory_path is None else f"{memory_path}/{kind}"


def append_to_log(rows: DataFrame, key: str, log: DataFrame | MessageLog, run: str | None = None, at=None) -> DataFrame:
    """A job's message rows (with ``chat_id``) at the next positions of their chats in ``log``, in the order
    of ``key``, the user's message first.

    A :class:`MessageLog` is written too, as ``run`` of the time ``at``; a repeated run takes the place of the one before.
    """
    new = rows.withColumn("_order", F.struct(key, "seq")).drop("seq")
    stored = isinstance(log, MessageLog)
    out = C.append_messages(log.read(without_run=run) if stored else log, new, "_order").drop("_order")
    if stored:
        out = materialize(out)
        log.write(out, run, at)
    return out


def _with_positions(rows: DataFrame, key: str, log: DataFrame | MessageLog | None, run: str | None) -> DataFrame:
    """A job's input rows with the positions of their two messages, as :func:`append_to_log` gives them; numbered before
    the messages are made, so no text is sorted.  Without a ``log`` they are 0 and 1."""
    if log is None:
        return rows.withColumn("seq_user", F.lit(0).cast("bigint")).withColumn("seq_assistant", F.lit(1).cast("bigint"))
    then = tuple(c for c in rows.columns if c not in (key, "chat_id"))  # the same positions whenever they are made
    if isinstance(log, MessageLog):  # staged: what is stored later must not read the log
        log = materialize(C.last_positions(log.read(without_run=run)))
    return C.exchange_positions(log, rows, key, then)


def _message(role: str, seq: str, content, payload_json, meta) -> Column:
    return F.struct(
        F.lit(role).alias("role"), content.alias("content"), payload_json.alias("payload_json"), F.col(seq).alias("seq"), meta.alias("meta")
    )


def _delivered(rows: DataFrame, kept: list[str], log: DataFrame | MessageLog | None, run: str | None, at) -> DataFrame:
    """Message rows as a job returns them; a :class:`MessageLog` stores them, as ``run`` of the time ``at``."""
    if isinstance(log, MessageLog):
        log.write(rows.drop("payload_json"), run, at)
    fields = ("seq", "role", "content", "payload_json") if log is None else ("role", "content", "payload_json", "seq")
    return rows.select(*kept, *fields)


def suggest_job(
    queries: DataFrame,
    generator: Callable,
    translator: Callable,
    key: str = "query_id",
    memory: DataFrame | None = None,
    log: DataFrame | MessageLog | None = None,
    memory_path: str | None = None,
    run: str | None = None,
    at=None,
    counters: Observation | None = None,
) -> DataFrame:
    """queries(key, raw, display_lang) -> message rows (key, seq, role, content, payload_json).

    With ``chat_id`` (and ``ts``) in ``queries`` and a message ``log``, the rows take the next positions of
    their chats; a :class:`MessageLog` stores them as ``run``, with the time ``at`` where a row has none.  Answers and translations of earlier runs are reused from ``memory_path``.
    """
    q = queries.select(
        key,
        *_carried(queries),
        X.strip(X.blank_to_empty(F.col("raw"))).alias("raw"),
        X.safe_lang_code("display_lang").alias("code"),
    )
    q = materialize(q.withColumn("_row", F.monotonically_increasing_id()))  # read several times below
    kept = [key, *_carried(q)]
    placed = _with_positions(q.select(*kept, "_row"), key, log, run)
    # the prompt is made where it is needed; a query's text goes straight to its own message
    req = q.select(
        "_row", "code", F.lit("suggest").alias("task"), F.lit(R.SYSTEM_PROMPT).alias("system"),
        R.suggest_prompt(X.normalize_query("raw", "code")).alias("prompt"),
    )
    ans = map_model(req, generator, memory_path=_stored(memory_path, "answers"))
    t = materialize(ans.select("_row", "code", P.extract_titles(P.titles_text_or_default("text", "error")).alias("titles")))
    tgt = F.when(F.col("code") != "en", F.col("code")).otherwise(F.lit("auto"))
    t = translate_array(
        t.withColumn("_tgt", tgt), "_row", "titles", F.lit("en"), "_tgt", translator, memory, out="titles_loc",
        unique_key=True, memory_path=_stored(memory_path, "translations"),
    )
    texts = q.select("_row", F.col("raw").alias("content"), F.lit("user").alias("role"))
    texts = texts.unionByName(t.select("_row", R.render_titles("titles_loc").alias("content"), F.lit("assistant").alias("role")))
    seq = F.when(F.col("role") == "user", F.col("seq_user")).otherwise(F.col("seq_assistant"))
    none = F.lit(None).cast("string").alias("payload_json")
    rows = texts.join(placed, "_row").select(*kept, "role", "content", none, seq.alias("seq"), F.lit(None).cast(C.META).alias("meta"))
    return _delivered(observed(rows, "content", counters), kept, log, run, at)


def recipe_job(
    titles: DataFrame,
    generator: Callable,
    translator: Callable,
    key: str = "title_id",
    memory: DataFrame | None = None,
    log: DataFrame | MessageLog | None = None,
    memory_path: str | None = None,
    run: str | None = None,
    at=None,
    counters: Observation | None = None,
) -> DataFrame:
    """titles(key, title, display_lang) -> message rows with the recipe payload; ``log`` and ``memory_path``
    as in :func:`suggest_job`.

    A recipe and its messages depend on the title and the language alone: they are made once for each pair, and a row
    gets those of its pair.
    """
    t = titles.select(
        key,
        *_carried(titles),
        X.strip(X.blank_to_empty(F.col("title"))).alias("title"),
        X.safe_lang_code("display_lang").alias("code"),
    )
    if not is_stage(titles):
        t = materialize(t)  # read several times below, computed once
    kept = [key, *_carried(t)]
    placed = _with_positions(t, key, log, run)
    recipes = _recipes(materialize(t.select("title", "code").distinct()), generator, translator, memory, memory_path)
    none, title = F.lit(None).cast("string"), F.concat(F.lit(K.SELECTED_RECIPE_PREFIX), F.col("title"))
    pair = F.array(
        _message("user", "seq_user", title, none, F.lit(None).cast(C.META)),
        _message("assistant", "seq_assistant", F.col("_content"), F.col("_payload_json"), F.col("_meta")),
    )
    rows = placed.join(recipes, ["title", "code"]).select(*kept, F.explode(pair).alias("_m")).select(*kept, "_m.*")
    return _delivered(observed(rows, "content", counters), kept, log, run, at)


def _recipes(pairs: DataFrame, generator: Callable, translator: Callable, memory: DataFrame | None, memory_path: str | None) -> DataFrame:
    """(title, code, _content, _payload_json, _meta) of distinct (title, code) pairs, staged."""
    translations = _stored(memory_path, "translations")
    t = back_translate_title(pairs, "title", "code", translator, memory, out="title_en", memory_path=translations)
    req = (
        t.withColumn("task", F.lit("detail"))
        .withColumn("system", F.lit(R.SYSTEM_PROMPT))
        .withColumn("prompt", R.detail_prompt("title_en"))
    )
    ans = map_model(req, generator, memory_path=_stored(memory_path, "answers"))
    r = P.with_recipe(ans.select("title", "code", "error", "text"), "text", error="error")
    r = materialize(r.drop("text").withColumn("_row", F.monotonically_increasing_id()))
    # ingredients and steps are translated in one pass as one array, then split
    tgt = F.when(F.col("error").isNull() & (F.col("code") != "en"), F.col("code")).otherwise(F.lit("auto"))
    r = r.withColumn("_tgt", tgt).withColumn(
        "_all", F.concat(F.col("recipe.ingredients"), F.col("recipe.steps"))
    ).withColumn("_n_ing", F.size("recipe.ingredients"))
    r = translate_array(
        r, "_row", "_all", F.lit("en"), "_tgt", translator, memory, out="_all_loc", unique_key=True, memory_path=translations
    )
    r = r.withColumn("ingredients", F.slice("_all_loc", 1, F.col("_n_ing"))).withColumn(
        "steps", F.slice("_all_loc", F.col("_n_ing") + 1, F.size("_all_loc"))
    )
    payload = F.to_json(R.recipe_payload(F.col("title"), F.col("ingredients"), F.col("steps")))
    return materialize(
        r.select(
            "title", "code", R.render_recipe("ingredients", "steps", "code").alias("_content"), payload.alias("_payload_json"),
            meta_of(payload).alias("_meta"),
        )
    )


def nutrition_job(
    lists: DataFrame, generator: Callable, key: str = "list_id", items: str = "items", memory_path: str | None = None,
    counters: Observation | None = None,
) -> DataFrame:
    """lists(key, items: comma list or array of strings) -> (key, text, error).

    An empty list is answered with a fixed text and never reaches the model.
    """
    is_array = isinstance(lists.schema[items].dataType, T.ArrayType)
    cleaned = P.clean_items(items) if is_array else P.split_item_list(items)
    li = materialize(lists.select(key, R.nutrition_prompt(cleaned).alias("prompt")))
    ans = map_model(
        li.withColumn("task", F.lit("nutrition")).withColumn("system", F.lit(R.SYSTEM_PROMPT)), generator,
        memory_path=_stored(memory_path, "answers"),
    )
    # an empty list has no prompt and so no request
    text = F.when(F.col("req_key").isNull(), F.lit(K.NO_INGREDIENTS_TEXT)).otherwise(X.strip("text"))
    return observed(ans.select(key, text.alias("text"), "error"), "text", counters)


def health_job(
    messages: DataFrame | MessageLog,
    filters: DataFrame,
    langs: DataFrame,
    generator: Callable,
    translator: Callable,
    memory: DataFrame | None = None,
    memory_path: str | None = None,
    run: str | None = None,
    at=None,
) -> tuple[DataFrame, DataFrame]:
    """(checks, rejected).

    ``filters(chat_id, health_filters)``, ``langs(chat_id, display_lang)``.
    checks: (chat_id, status 'ok'|'error', seq, role, content, payload_json); a check that succeeded is the
    assistant's message at the next position of its chat, the others have no seq.  A :class:`MessageLog` as
    ``messages`` is read and the checks that succeeded are stored in it as ``run``.
    """
    log = messages if isinstance(messages, MessageLog) else None
    if log is not None:
        messages = log.read(without_run=run)
    newest = materialize(C.newest_positions(messages))  # where each chat ends, and where its recipe is, come from one pass
    latest = materialize(C.latest_payload(messages, newest=newest))  # and so do accepted and rejected chats
    last = newest.select("chat_id", "_last")
    ok, rejected = C.eligible_for_check(latest)
    d = F.col("recipe_detail")
    j = (
        C.join_null_safe(
            C.join_null_safe(C.join_null_safe(ok, filters, "chat_id", how="left"), langs, "chat_id", how="left"), last, "chat_id"
        )
        .select(
            "chat_id",
            (F.col("_last") + 1).alias("seq"),
            d["title"].alias("title"),
            F.coalesce("health_filters", F.array().cast("array<string>")).alias("health_filters"),
            R.health_prompt(d["ingredients"], d["steps"], F.col("health_filters")).alias("prompt"),
            X.safe_lang_code("display_lang").alias("code"),
        )
    )
    req = materialize(j).withColumn("task", F.lit("health")).withColumn("system", F.lit(R.SYSTEM_PROMPT))
    ans = map_model(req, generator, memory_path=_stored(memory_path, "answers")).withColumn("text_en", X.strip("text"))
    tgt = F.when(F.col("code") != "en", F.col("code")).otherwise(F.lit("auto"))
    tr = translate_block(
        ans.withColumn("_tgt", tgt), "text_en", F.lit("en"), "_tgt", translator, memory, out="text_loc",
        memory_path=_stored(memory_path, "translations"),
    )
    failed = F.col("error").isNotNull()
    checks = tr.select(
        "chat_id",
        F.when(failed, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.when(~failed, F.col("seq")).cast("bigint").alias("seq"),
        F.when(~failed, F.lit("assistant")).alias("role"),
        F.when(~failed, R.render_check_block("title", "text_loc")).alias("content"),
        F.when(~failed, F.to_json(R.check_payload(F.col("health_filters"), F.col("text_loc")))).alias("payload_json"),
    )
    if log is not None:
        checks = materialize(checks)
        log.write(checks.where("seq is not null").drop("status"), run, at)
    return checks, rejected.select("chat_id")
