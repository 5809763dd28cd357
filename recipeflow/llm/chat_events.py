"""Chat formatting by event-sourced reconstruction.

A log holds what happened to each message, one event a row:

* ``open``: the message begins, with a role and empty text (an ``open`` of an open message changes its role only);
* ``delta``: text is appended, as an answer is streamed;
* ``edit``: the whole text is replaced;
* ``regenerate``: the text so far is dropped, and deltas begin anew;
* ``retract``: the message is withdrawn, unless a later ``open`` brings it back.

1. :func:`fold_events` partitions the log by conversation and message, sorts by sequence and folds each message's events in one
   streaming pass. A task holds the text of one message at a time, and a conversation with a third of all events is split by message.
2. :func:`render_turns` writes a message as ``### role: text</turn>`` and a line feed. In texts a backslash goes before each
   backslash, each ``#`` that two more follow and each ``<`` that ``/turn>`` follows, and in roles before each backslash, ``#``, ``<``,
   ``:`` and line feed, so no text can hold a control string that counts, and dropping one backslash each gives it back exactly.
3. :func:`assemble` brings a conversation's turns together in order, as parts of whole turns of about ``PART_CHARS``
   characters with the spans that the loss covers; nearly all conversations are one part.
4. :func:`read_back` parses the parts and gives counts and digests. A digest of a whole conversation has to be taken in order,
   so its parts stream through one task, of which one part is held at a time.

Defined results: a NULL text is empty, as is a NULL role; rows with a NULL conversation are a conversation of their own; an event that is delivered
more than once (equal in sequence, kind, role and text) counts once; events of one sequence number are taken by kind, role and text; a message without
``open`` has an empty role; messages of one turn come by message id; unknown kinds are errors; an empty log gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeflow.llm.common import batch_of, column, lean

#: Characters of formatted text in a part, about; a longer turn is a part of its own.
PART_CHARS = 1 << 20
#: Characters of a streamed delta in :func:`events_of`.
DELTA_CHARS = 400
TURN_END = "</turn>\n"
LEARNED_ROLE = "assistant"

MESSAGE = "conv_id long, turn long, message long, role string, text string"
PART = "conv_id long, part long, start long, formatted string, loss array<struct<start: long, end: long>>"


# ---------------------------------------------------------------- the log


def events_of(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log (conv_id, turn, message, seq, kind, role, text) that leads to ``turns`` (conv_id, turn, role, text).

    Each text is streamed in deltas. By a hash of its place, one message in four is first streamed as a draft and then
    regenerated, and one in eight is opened with a draft that an edit replaces, so that replaying the log needs all kinds of events.
    Write the result once: ids and sequence numbers follow the rows' order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")), F.lit(8))
    draft = F.substring(F.reverse(text), 1, delta_chars)

    def event(name: str, value: Column = F.lit("")) -> Column:
        return F.struct(F.lit(name).alias("kind"), value.alias("text"))

    def deltas(value: Column) -> Column:
        pieces = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
        return F.transform(pieces, lambda p: event("delta", p))

    steps = (
        F.when(kind < 2, F.concat(F.array(event("open")), deltas(draft), F.array(event("regenerate")), deltas(text)))
        .when(kind == 2, F.array(event("open"), event("delta", draft), event("edit", text)))
        .otherwise(F.concat(F.array(event("open")), deltas(text)))
    )
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("message"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        steps.alias("_steps"),
    )
    rows = rows.select("conv_id", "turn", "message", "role", F.posexplode("_steps").alias("seq", "_step"))
    return rows.select(
        "conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), F.col("_step.kind").alias("kind"),
        F.when(F.col("_step.kind") == "open", F.col("role")).alias("role"), F.col("_step.text").alias("text"),
    )


class Message:
    """The state of one message while its events are folded."""

    def __init__(self):
        self.role, self.pieces, self.withdrawn = "", [], False

    def apply(self, kind: str, role: str, text: str) -> None:
        if kind == "open":
            self.role, self.withdrawn = role, False
        elif kind == "delta":
            self.pieces.append(text)
        elif kind == "edit":
            self.pieces = [text]
        elif kind == "regenerate":
            self.pieces = []
        elif kind == "retract":
            self.withdrawn, self.pieces = True, []
        else:
            raise ValueError(f"unknown kind of event: {kind!r}")


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, turn, message, role, text): the final messages of a log (conv_id, turn, message, seq, kind, role, text)."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("message", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    )

    def run(batches):
        at, state, last = None, Message(), None
        done: list[tuple] = []
        held = 0

        def flush():
            return batch_of(schema, **dict(zip(schema.names, map(list, zip(*done, strict=True)), strict=True)))

        def close():
            nonlocal held
            if at is not None and not state.withdrawn:
                done.append((*at, state.role, "".join(state.pieces)))
                held += len(done[-1][-1])

        for batch in batches:
            names = ("conv_id", "turn", "message", "seq", "kind", "role", "text")
            for conv, turn, message, *event in zip(*[column(batch, c) for c in names], strict=True):
                if (conv, turn, message) != at:
                    close()
                    at, state, last = (conv, turn, message), Message(), None
                    if held > PART_CHARS or len(done) > 4096:
                        yield flush()
                        done, held = [], 0
                if event != last:  # else it was delivered again
                    state.apply(event[1], event[2] or "", event[3] or "")
                    last = event
        close()
        if done:
            yield flush()

    read = log.select(
        *[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn", "message", "seq")],
        *[F.col(c).cast("string").alias(c) for c in ("kind", "role", "text")],
    )
    # by message, not by conversation alone: a hot conversation is split
    dealt = read.repartition("conv_id", "message").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "message", "seq", "kind", "role", "text"
    )
    return dealt.mapInArrow(lean(run), MESSAGE)


# ---------------------------------------------------------------- the template


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|#(?=##)|<(?=/turn>)", r"\\$0")


def render_turns(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, turn, message, formatted, loss_from, loss_to): each message in the template, and which of its characters the loss
    covers (both NULL where the role is another)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit("### "), F.regexp_replace(role, r"[\\#<:\n]", r"\\$0"), F.lit(": "))
    rows = messages.select("conv_id", "turn", "message", (role == learned_role).alias("_learned"), head.alias("_head"), escaped(text).alias("_body"))
    begin = F.length("_head").cast("long")
    return rows.select(
        "conv_id", "turn", "message", F.concat("_head", "_body", F.lit(TURN_END)).alias("formatted"),
        F.when(F.col("_learned"), begin).alias("loss_from"),
        F.when(F.col("_learned"), begin + F.length("_body")).alias("loss_to"),
    )


def assemble(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, start, formatted, loss): conversations of rendered ``turns`` in parts, which come in order, all of a conversation in one
    partition. ``start`` and the spans of ``loss`` count code points from the beginning of the conversation."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("part", pa.int64()),
            ("start", pa.int64()),
            ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches):
        conv, part, start, end = None, -1, 0, 0
        pieces: list[str] = []
        loss: list[dict] = []
        done: list[tuple] = []
        held = 0

        def close():
            nonlocal pieces, loss, held
            done.append((conv, part, start, "".join(pieces), loss))
            held += end - start
            pieces, loss = [], []

        def flush():
            return batch_of(schema, **dict(zip(schema.names, map(list, zip(*done, strict=True)), strict=True)))

        for batch in batches:
            rows = zip(*[column(batch, c) for c in ("conv_id", "formatted", "loss_from", "loss_to")], strict=True)
            for own, formatted, first, last in rows:
                if part < 0 or own != conv:
                    if part >= 0:
                        close()
                    conv, part, start, end = own, 0, 0, 0
                elif end - start >= part_chars:
                    close()
                    part, start = part + 1, end
                if held >= part_chars:
                    yield flush()
                    done, held = [], 0
                pieces.append(formatted)
                if first is not None:
                    loss.append({"start": end + first, "end": end + last})
                end += len(formatted)
        if part >= 0:
            close()
        if done:
            yield flush()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "message")
    return dealt.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(lean(run), PART)


# ---------------------------------------------------------------- reading back

_ESCAPE = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:\\.|[^\\#<:\n])*): ", re.S)
#: What ends a text, or a backslash with what it protects.
_STOP = re.compile(r"\\.|" + re.escape(TURN_END), re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of each turn of a formatted part."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if not head:
            raise ValueError("a turn without a head")
        end = next((s.start() for s in _STOP.finditer(formatted, head.end()) if s.group() == TURN_END), None)
        if end is None:
            raise ValueError("a turn without an end")
        yield unescaped(head.group(1)), unescaped(formatted[head.end() : end])
        at = end + len(TURN_END)


def read_back(parts: DataFrame, in_order: bool = True) -> DataFrame:
    """One row per conversation of ``parts``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``in_order`` says that the parts come as :func:`assemble` gives them; parts that were written and read again do not.
    """
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def run(batches):
        conv, begun, done = None, False, []
        n = loss_chars = chars = 0
        turns, learned = hashlib.sha256(), hashlib.sha256()

        def close():
            done.append((conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars))

        def flush():
            return batch_of(schema, **dict(zip(schema.names, map(list, zip(*done, strict=True)), strict=True)))

        for batch in batches:
            for own, start, formatted, loss in zip(*[column(batch, c) for c in ("conv_id", "start", "formatted", "loss")], strict=True):
                if not begun or own != conv:
                    if begun:
                        close()
                    conv, begun, n, loss_chars, chars = own, True, 0, 0, 0
                    turns, learned = hashlib.sha256(), hashlib.sha256()
                for role, text in parse_turns(formatted):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = unescaped(formatted[span["start"] - start : span["end"] - start])
                    loss_chars += len(text)
                    learned.update(text.encode("utf-8", "surrogatepass"))
                chars += len(formatted)
            if len(done) > 4096:
                yield flush()
                done = []
        if begun:
            close()
        if done:
            yield flush()

    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(
        lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
