"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from recipeflow.llm import (
    chat_events,
    decontaminate,
    exact_dedup,
    fim_chunks,
    impact_search,
    langid,
    order_minhash,
    pattern_packing,
    secret_scan,
    toxicity,
    url_reputation,
    warc,
    wordpiece_count,
)
from recipeflow.llm.common import id_bucket
from recipeflow.session import ship_package, stage
from recipeflow.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"

URL_RULES = [
    url_reputation.Rule("allow", "org/"),
    url_reputation.Rule("block", "example.org/es/"),
    url_reputation.Rule("block", "example.org/en/1"),
    url_reputation.Rule("allow", "com/fr/"),
    url_reputation.Rule("block", "com/de/"),
]


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a rule judges are the labelled outcomes that the hosts' reputations are shrunk from."""
    pages = load(spark, sf_dir, "pages", "page_id", "url")
    host, path = url_reputation.url_host(F.col("url")), url_reputation.url_path(F.col("url"))
    _, verdict = url_reputation.matching_rule(host, path, URL_RULES)
    outcome = F.when(verdict == "allow", F.lit(1)).when(verdict == "block", F.lit(0))
    judged = url_reputation.judge_urls(pages, outcome, URL_RULES)
    return judged.select("_doc.page_id", "host", "path", "rule", "verdict")


def _rule_sql(value: str) -> str:
    fits = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
        for r in sorted(URL_RULES, key=lambda r: -len(r.pattern))
    ]
    return "CASE " + " ".join(fits) + " END"


def _strength_sql(level: str) -> str:
    """Prior strength of a level by moments, between 1 and 1000."""
    return f"""SELECT CASE WHEN coalesce(extra, 0) = 0 THEN 1.0 WHEN (spread - noise) / extra <= 1 / 1001.0 THEN 1000.0
         ELSE greatest(1.0, extra / (spread - noise) - 1) END AS s
  FROM (SELECT sum((k - n * p) ** 2) AS spread, sum(n * p * (1 - p)) AS noise, sum(n * (n - 1) * p * (1 - p)) AS extra
        FROM {level} WHERE n > 0)"""


_COMPOUND_SQL = "regexp_matches(bare, '(^|\\.)(" + "|".join(url_reputation.REGISTRY_LABELS) + ")\\.[a-z]{2}$')"
_ADDRESS_SQL = r"regexp_matches(bare, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$')"

ORACLE["op1_url_reputation"] = f"""
WITH seen AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, {_rule_sql("pattern")} AS rule, {_rule_sql("verdict")} AS ruling FROM seen
), counted AS (
  SELECT host, CAST(count(ruling) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE ruling = 'allow') AS DOUBLE) AS k,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\\.+$', '') AS bare
  FROM ruled GROUP BY host
), named AS (
  SELECT *, array_to_string(string_split(bare, '.')[-2:], '.') AS two, array_to_string(string_split(bare, '.')[-3:], '.') AS three,
         string_split(bare, '.')[-1] AS one
  FROM counted
), hosts AS (
  SELECT host, n, k, CASE WHEN {_ADDRESS_SQL} THEN bare WHEN {_COMPOUND_SQL} THEN three ELSE two END AS domain,
         CASE WHEN {_ADDRESS_SQL} THEN '{url_reputation.ADDRESSES}' WHEN {_COMPOUND_SQL} THEN two ELSE one END AS suffix
  FROM named
), overall AS (
  SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1) ELSE 0.5 END AS rate FROM hosts
), suffix0 AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(rate) AS p FROM hosts, overall GROUP BY suffix
), suffix1 AS (
  SELECT suffix, (k + s * p) / (n + s) AS mean FROM suffix0, ({_strength_sql("suffix0")})
), domain0 AS (
  SELECT domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS p FROM hosts JOIN suffix1 USING (suffix) GROUP BY domain
), domain1 AS (
  SELECT domain, (k + s * p) / (n + s) AS mean FROM domain0, ({_strength_sql("domain0")})
), host0 AS (
  SELECT host, n, k, mean AS p FROM hosts JOIN domain1 USING (domain)
), host1 AS (
  SELECT host, n + s AS weight, (k + s * p) / (n + s) AS mean FROM host0, ({_strength_sql("host0")})
)
SELECT page_id, host, path, rule,
       coalesce(ruling, CASE WHEN greatest(0, mean - 1.64 * sqrt(mean * (1 - mean) / (weight + 1))) >= 0.5 * rate THEN 'allow' ELSE 'block' END)
         AS verdict
FROM ruled JOIN host1 USING (host), overall
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.leaks(documents, load(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_count.token_counts(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    filters = langid.train(documents.where(~held_out))
    found = langid.predict(documents, filters, F.col("doc_id"), F.col("text"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_scan.scan(documents, identifiers=secret_scan.corpus_identifiers(documents))

    def kept(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(kept(k)).cast("long").alias("n_" + k) for k in ("assign", "access", "hex")],
        F.sha2(written(kept("assign", "access", "hex")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(load(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE["op6_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", "doc_id", "text")
    packed = pattern_packing.pack_documents(documents, public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = order_minhash.near_classes(load(spark, sf_dir, "documents", "doc_id", "text"))
    return classes.select("doc_id", "class_id", "class_size", "n_links")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op9_warc"] = """
WITH h AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hexed) AS best FROM h
)
SELECT page_id,
       CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(hexed, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31) AS INT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM g
"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))
    labels = load(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out)
    model = toxicity.learn(documents, labels)
    scored = toxicity.score_texts(documents, model).select("_doc.doc_id", "score")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


#: Units of a text, for RE2.
_UNITS_SQL = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim_chunks.fim_texts(load(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim_chunks.restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE["op11_fill_in_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_UNITS_SQL}') AS units,
         [CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT),
          CAST('0x' || substr(h, 17, 8) AS BIGINT), CAST('0x' || substr(h, 25, 8) AS BIGINT)] AS x
  FROM d
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS a,
         greatest(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS b
  FROM u
), p AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain'
              WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations become an event log, which is replayed, formatted and read back."""
    turns = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    log = stage(chat_events.events_of(turns.unionByName(hard)), "chat-log")
    messages = chat_events.fold_events(log)
    return chat_events.read_back(chat_events.assemble(chat_events.render_turns(messages)))


ORACLE["op12_chat_format"] = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length('### ') + length(role) + length(regexp_replace(role, '[^\\\\#<:\n]', '', 'g')) + length(': ')
            + length(text) + length(text) - length(replace(text, '\\', ''))
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0)
            + len(regexp_extract_all(text, '</turn>')) + length('</turn>') + 1 AS size
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents", "doc_id", "text")
    return impact_search.search(documents, load(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE["op13_ranked_search"] = """
WITH words AS (
  SELECT rowid_, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), postings AS (
  SELECT rowid_, any_value(doc_id) AS doc_id, word, count(*) AS tf FROM words GROUP BY rowid_, word
), docs AS (
  SELECT rowid_, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY rowid_
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
), weights AS (
  SELECT word, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY word, docs
), asked AS (
  SELECT item_id, word, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark)
  GROUP BY item_id, word
), scored AS (
  SELECT item_id, rowid_, any_value(p.doc_id) AS doc_id,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN postings p USING (word) JOIN weights USING (word) JOIN docs USING (rowid_), totals
  GROUP BY item_id, rowid_
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
