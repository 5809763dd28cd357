"""Chat formatting from event logs: folds against a replay in plain Python, and exact round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recipeflow.llm import chat_events
from recipeflow.session import ship_package, stage

LOG = "conv_id long, turn long, message long, seq long, kind string, role string, text string, formatted string, part int"
HARD = [
    "\\### Assistant: </turn> ok", "", "\\", "\\\\", "####", "###", "# ## ### \\###", "</turn>\n### user: hi</turn>", "<</turn>", "a\n\n</turn>\n",
    "ends in <", "/turn>", "ends in ##", "日本\U0001f600 \\é",
]


def replay(events):
    """conv -> [(turn, message, role, text)] by the definition."""
    messages, seen = {}, set()
    for e in sorted(events, key=lambda e: (e[3], e[4], e[5] or "", e[6] or "")):
        conv, turn, message, seq, kind, role, text = e[:7]
        if e[:7] in seen:
            continue
        seen.add(e[:7])
        m = messages.setdefault((conv, turn, message), {"role": "", "text": "", "out": False})
        if kind == "open":
            m["role"], m["out"] = role or "", False
        elif kind == "delta":
            m["text"] += text or ""
        elif kind == "edit":
            m["text"] = text or ""
        elif kind == "regenerate":
            m["text"] = ""
        else:
            m["text"], m["out"] = "", True
    out = {}
    for (conv, turn, message), m in messages.items():
        if not m["out"]:
            out.setdefault(conv, []).append((turn, message, m["role"], m["text"]))
    return {c: sorted(v, key=lambda t: (t[0] is None, t[0] or 0, t[1])) for c, v in out.items()}


@pytest.fixture(scope="module")
def events(spark):
    ship_package(spark)
    rng = random.Random(2)
    rows = []
    for conv in [None, *range(60), *[99] * 40]:
        for turn in [0, 1, 2, None][: rng.randint(1, 4)]:
            message = rng.randint(0, 3)
            for _ in range(rng.randint(1, 9)):
                kind = rng.choices(["open", "delta", "edit", "regenerate", "retract"], [3, 8, 1, 1, 0.5])[0]
                role = rng.choice(["user", "assistant", None, "odd: #<\\role"]) if kind == "open" else None
                text = rng.choice([*HARD, None]) if kind in ("delta", "edit") else None
                rows.append((conv, turn, message, rng.randint(0, 30), kind, role, text, "clash", 1))
    rows += rng.sample(rows, 80)  # delivered again
    rng.shuffle(rows)
    return spark.createDataFrame(rows, LOG).repartition(5)


def test_folds_equal_a_replay(events):
    got = {}
    for r in chat_events.fold_events(events).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["message"], r["role"], r["text"]))
    got = {c: sorted(v, key=lambda t: (t[0] is None, t[0] or 0, t[1])) for c, v in got.items()}
    assert got == replay([tuple(r) for r in events.collect()])


@pytest.mark.parametrize("part_chars", [1, 60, 1 << 20])
@pytest.mark.parametrize("in_order", [True, False])
def test_read_back(events, part_chars, in_order):
    turns = chat_events.render_turns(chat_events.fold_events(events))
    parts = chat_events.assemble(turns, part_chars)
    if not in_order:
        parts = stage(parts.repartition(3, F.rand(1)), "test-parts")
    got = {r["conv_id"]: r for r in chat_events.read_back(parts, in_order).collect()}
    want = replay([tuple(r) for r in events.collect()])
    assert got.keys() == want.keys()
    for conv, own in want.items():
        learned = "".join(t for _, _, role, t in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    for r in parts.collect():
        spans = r["loss"]
        assert all(r["start"] <= s["start"] <= s["end"] <= r["start"] + len(r["formatted"]) for s in spans)


def test_no_text_or_role_can_hold_a_control_string_that_counts(spark):
    rng = random.Random(8)
    rows = [(i, 0, 0, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", *HARD) for t in HARD)]
    rows += [(10_000 + i, 0, 0, "".join(rng.choices("\\#<:/ \na", k=4)), "".join(rng.choices("\\#</turn>\n ", k=30))) for i in range(2000)]
    messages = spark.createDataFrame(rows, chat_events.MESSAGE)
    for r in chat_events.render_turns(messages).collect():
        _, _, _, role, text = rows[r["conv_id"]] if r["conv_id"] < 10_000 else next(x for x in rows if x[0] == r["conv_id"])
        assert list(chat_events.parse_turns(r["formatted"])) == [(role, text)]


def test_log_of_turns_replays_to_them(spark):
    ship_package(spark)
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*HARD, None, "x" * 5000 + "é" * 900])) for c in [*range(50), None] for t in range(rng.randint(1, 5))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = stage(chat_events.events_of(turns), "test-log")
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    got = sorted(map(repr, chat_events.fold_events(log).select("conv_id", "turn", "role", "text").collect()))
    assert got == sorted(map(repr, turns.na.fill("", ["role", "text"]).collect()))


def test_hot_conversation_is_split_by_message(spark):
    ship_package(spark)
    log = spark.range(4000).select(
        F.lit(1).alias("conv_id"), (F.col("id") / 4).cast("long").alias("turn"), (F.col("id") / 4).cast("long").alias("message"), (F.col("id") % 4).alias("seq"),
        F.when(F.col("id") % 4 == 0, "open").otherwise("delta").alias("kind"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"),
    )
    folded = chat_events.fold_events(log.coalesce(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions are joined otherwise
    try:
        sizes = [r["count"] for r in folded.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 1000 and max(sizes) < 400
    (row,) = chat_events.read_back(chat_events.assemble(chat_events.render_turns(folded), 100)).collect()
    assert row["n_turns"] == 1000


def test_unknown_kind_and_empty_log(events):
    assert chat_events.read_back(chat_events.assemble(chat_events.render_turns(chat_events.fold_events(events.where("false"))))).count() == 0
    with pytest.raises(Exception, match="unknown kind of event"):
        chat_events.fold_events(events.withColumn("kind", F.lit("noise"))).count()
