"""Chat formatting from an event log.

A log row is (conv, message, seq, kind, role, body).  ``start`` opens a message
with its role, ``delta`` appends to it, ``edit`` replaces what it holds,
``regenerate`` empties it for the deltas that follow.  The log is partitioned
by conversation and message, sorted by sequence and folded: the last edit or
regeneration wins and later deltas are appended.  A conversation of any length
is so spread over its messages; only one message's events meet.

Messages are rendered as ``### {role}: {text}</turn>`` and a line end.  Control
strings within roles and texts are escaped with a backslash, so the marks occur
nowhere else and the output can be read back (``parse_turn``).  The loss mask is
the assistant's text between the marks, in code points.

The output has one row per turn: a conversation's formatted text is its pieces
in order, so none has to fit in memory.  ``digests`` streams them, sorted within
partitions, through one running hash per conversation: a hash of a whole
conversation is sequential, its task holds one turn at a time.

Defined cases: null body = empty text; null role = empty role; null conversation
ids form one conversation; events with equal seq are taken by kind, then body;
messages whose first events tie go by message id; equal rows are equal messages
unless the caller gives them one message id; deltas before any start open a
message without a role; empty log, empty output; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "### ", "</turn>\n"
#: Control strings and what stands for them inside texts; the backslash first.
ESCAPES = (("\\", "\\\\"), ("###", "\\#\\#\\#"), ("</turn>", "\\<\\/turn>"))
ROLE_ESCAPES = ESCAPES + ((":", "\\:"), ("\n", "\\\n"))
#: Roles whose text the loss covers.
LOSS_ROLES = ("assistant",)

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _escaped(c: Column, pairs) -> Column:
    for plain, safe in pairs:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def parse_turn(piece: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    m = _TURN.fullmatch(piece)
    if m is None:
        raise ValueError(f"not a turn: {piece[:80]!r}")
    return _ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])


def log_of(rows: DataFrame, chunk: int = 500) -> DataFrame:
    """The event log that streaming the turns of (conv_id, turn, role, text)
    would leave: a start, then deltas of ``chunk`` characters.  Rows that share
    a turn are told apart by (role, text) and a running number."""
    k = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"), k.alias("k"))
    text = F.coalesce("text", F.lit(""))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(text) / chunk).cast("int")),
        lambda i: F.struct(F.lit("delta").alias("kind"), (i + 1).alias("step"),
                           F.substring(text, i * chunk + 1, F.lit(chunk)).alias("body")))
    start = F.array(F.struct(F.lit("start").alias("kind"), F.lit(0).alias("step"), F.lit("").alias("body")))
    events = rows.select("conv_id", "turn", "k", "role", F.explode(F.concat(start, parts)).alias("e"))
    return events.select(
        F.col("conv_id").alias("conv"), F.struct("turn", "k").alias("message"),
        F.struct("turn", "k", F.col("e.step").alias("step")).alias("seq"),
        F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "start", F.col("role")).alias("role"),
        F.col("e.body").alias("body"))


def fold(log: DataFrame) -> DataFrame:
    """(conv, message, first, role, text): final messages; ``first`` is the
    message's first sequence and orders it in its conversation."""
    own = W.partitionBy("conv", "message")
    resets = F.col("kind").isin("start", "edit", "regenerate")
    order = F.struct("seq", F.array_position(
        F.array(*map(F.lit, ("start", "regenerate", "edit", "delta"))), F.col("kind")).alias("o"))
    log = log.withColumn("at", order).withColumn("last", F.max(F.when(resets, F.col("at"))).over(own))
    live = (F.col("kind").isin("edit", "delta")) & (F.col("last").isNull() | (F.col("at") >= F.col("last")))
    parts = F.collect_list(F.when(live, F.struct("at", F.coalesce("body", F.lit("")).alias("body"))))
    first_role = F.min(F.when(F.col("kind") == "start", F.struct("at", "role")))
    return log.groupBy("conv", "message").agg(
        F.min("seq").alias("first"), first_role["role"].alias("role"),
        F.array_join(F.transform(F.sort_array(parts), lambda x: x["body"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv, first, message, piece, loss_start, loss_end) per message; the
    loss span, null where the role has none, counts from the piece's start."""
    role = _escaped(F.coalesce("role", F.lit("")), ROLE_ESCAPES)
    text = _escaped(F.col("text"), ESCAPES)
    head = F.concat(F.lit(START), role, F.lit(": "))
    loss = F.coalesce(F.col("role").isin(list(LOSS_ROLES)), F.lit(False))
    return messages.select(
        "conv", "first", "message", F.concat(head, text, F.lit(END)).alias("piece"),
        F.when(loss, F.length(head)).alias("loss_start"),
        F.when(loss, F.length(head) + F.length(text)).alias("loss_end"))


def format_conversations(log: DataFrame) -> DataFrame:
    return render(fold(log))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted output reads back as, per conversation: (conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    def run(batches):
        state = None
        for b in batches:
            out = []
            for conv, piece, a, z in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    masked = _ESCAPED.sub(r"\1", piece[a:z])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
            yield batch(out)
        if state is not None:
            yield batch([state])

    def batch(rows):
        conv, n, turns, chars, loss, size = zip(*rows) if rows else ([],) * 6
        return pa.record_batch(
            [pa.array(conv, conv_type), pa.array(n, pa.int64()),
             pa.array([h.hexdigest() for h in turns], pa.string()), pa.array(chars, pa.int64()),
             pa.array([h.hexdigest() for h in loss], pa.string()), pa.array(size, pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(formatted.schema["conv"].dataType)
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.repartition(parts, "conv").sortWithinPartitions("conv", "first", "message") \
        .select("conv", "piece", "loss_start", "loss_end")
    return rows.mapInArrow(run, f"conv_id {formatted.schema['conv'].dataType.simpleString()}, n_turns long, "
                                "turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
