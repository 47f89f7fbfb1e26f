"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, whose context is all turns before
it and whose loss mask covers that reply only.

A turn is written as ``### Assistant: text</turn>`` and a line feed.  ``###``, ``</turn>`` and the backslash are control strings:
inside a text each gets a backslash before it, so a text can neither open nor close a turn, and ``parse`` gives it back unchanged.

The examples of a conversation are prefixes of one formatted text, so that text is written once, a row per turn, and an example is a
row that refers to it: the number of turns and of code points of its context, and the span under the mask.  Output thus grows with
the input also where one conversation holds a large part of all turns; ``render`` spells the examples out where that is wanted.
Turns are sorted and streamed by conversation: a task holds a running position, never a conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLOSE = "</turn>\n"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}  # other roles are written as JSON strings
TARGET = "assistant"
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
HEAD = re.compile(r'### (?:(System|User|Assistant)|("(?:\\.|[^"\\])*")): ', re.S)
ROLES = {name: role for role, name in NAMES.items()}
TURNS = "conv_id bigint, position bigint, start bigint, piece string, example bigint, context_turns bigint, context_chars bigint, loss_start bigint, loss_end bigint"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    """The opening mark of a turn."""
    return f"### {NAMES[role]}: " if role in NAMES else f"### {json.dumps(role).replace('#', chr(92) + 'u0023').replace('<', chr(92) + 'u003c')}: "


def turn(role: str, text: str) -> str:
    return f"{head(role)}{escape(text)}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of the turns of a formatted text; start and end span the text as it is written there."""
    out, at = [], 0
    while at < len(formatted):
        opening = HEAD.match(formatted, at)
        if not opening:
            raise ValueError(f"no turn opens at {at}")
        begin = opening.end()
        for mark in re.compile(r"\\(?:\\|###|</turn>)|</turn>\n").finditer(formatted, begin):
            if mark[0] == CLOSE:
                break
        else:
            raise ValueError(f"the turn at {at} is not closed")
        role = ROLES[opening[1]] if opening[1] else json.loads(opening[2])
        out.append((role, unescape(formatted[begin:mark.start()]), begin, mark.start()))
        at = mark.end()
    return out


def _runs(batches: Iterator[pa.RecordBatch], fresh: Callable, step: Callable, finish: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by their first column; ``step(state, row)`` and ``finish(key, state)`` give output rows or None."""
    key, state, begun = None, None, False
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if not begun or row[0] != key:
                if begun:
                    out.append(finish(key, state))
                key, state, begun = row[0], fresh(), True
            out.append(step(state, row))
        yield _batch(out, names)
    if begun:
        yield _batch([finish(key, state)], names)


def _batch(rows: list[tuple | None], names: list[str]) -> pa.RecordBatch:
    rows = [r for r in rows if r is not None]
    kinds = [pa.string() if n in ("piece", "turns_sha256", "loss_sha256") else pa.int64() for n in names]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def step(state: dict, row: tuple) -> tuple:
        conv, role, text = row
        role, text = role or "", text or ""
        piece, opening = turn(role, text), len(head(role))
        position, start = state["turns"], state["chars"]
        state["turns"], state["chars"] = position + 1, start + len(piece)
        if role != TARGET:
            return conv, position, start, piece, None, None, None, None, None
        state["examples"] += 1
        return conv, position, start, piece, state["examples"] - 1, position, start, start + opening, start + len(piece) - len(CLOSE)

    names = [part.split()[0] for part in TURNS.split(", ")]
    yield from _runs(batches, lambda: {"turns": 0, "chars": 0, "examples": 0}, step, lambda key, state: None, names)


def expand(conversations: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, position, start, piece``, and for every assistant turn its example: ``example`` (from 0),
    ``context_turns, context_chars`` (all turns before it) and the masked span ``loss_start, loss_end`` in the example's text.

    Positions count code points from 0 in the formatted conversation.  Turns go by ``order``, null first; ties, repeated rows
    included, by role and text, and every row stays.  A null or empty text is an empty text, a null role an empty role, and rows
    with a null id form one conversation with a null id.  A conversation without assistant turns has no example.  An empty table
    gives an empty one.  Other columns do not matter, whatever their names.
    """
    rows = conversations.select(F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.col(f"`{order}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    placed = rows.repartition(common.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(_format, TURNS)


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: the examples spelled out, each with its whole context.

    The result grows with the square of a conversation's length, as the written-out method does; select examples first.
    """
    examples = turns.where("example is not null").select("conv_id", "example", F.col("position").alias("target"), "loss_start", "loss_end")
    parts = turns.select(F.col("conv_id").alias("of"), "position", "piece")
    joined = examples.join(parts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("position") <= F.col("target")))
    whole = joined.groupBy("conv_id", "example", "loss_start", "loss_end").agg(F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("p"))
    return whole.select("conv_id", "example", F.concat_ws("", F.col("p.piece")).alias("text"), "loss_start", "loss_end")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fresh() -> dict:
        return {"turns": 0, "loss": 0, "chars": 0, "all": hashlib.sha256(), "masked": hashlib.sha256()}

    def step(state: dict, row: tuple) -> None:
        _, position, start, piece, context_turns, context_chars, loss_start, loss_end = row
        ((role, text, _, _),) = parse(piece)
        if (position, start) != (state["turns"], state["chars"]):
            raise ValueError("turns are missing or out of order")
        state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss_start is not None:
            if (context_turns, context_chars) != (position, start):
                raise ValueError("an example's context is not all turns before it")
            masked = unescape(piece[loss_start - start:loss_end - start])
            state["masked"].update(masked.encode("utf-8", "surrogatepass"))
            state["loss"] += len(masked)
        state["turns"], state["chars"] = position + 1, start + len(piece)

    def finish(key: int | None, state: dict) -> tuple:
        return key, state["turns"], state["all"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"]

    yield from _runs(batches, fresh, step, finish, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns alone: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    placed = turns.repartition(common.partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position")
    fields = placed.select("conv_id", "position", "start", "piece", "context_turns", "context_chars", "loss_start", "loss_end")
    return fields.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


# fixed values: the conversation that the contract adds
ADDED = (-7, r"\### Assistant: </turn> ok")

SQL = rf"""with every as (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select {ADDED[0]}, 0, 'user', '{ADDED[1]}' union all select {ADDED[0]}, 1, 'assistant', '{ADDED[1]}'),
marked as (select *, '### ' || case role when 'system' then 'System' when 'user' then 'User' when 'assistant' then 'Assistant' end || ': '
    || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) as piece from every),
told as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn) as spoken,
    coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '') as masked, cast(sum(length(piece)) as bigint) as formatted_chars
    from marked group by conv_id)
select conv_id, n_turns, sha256(spoken) as turns_sha256, length(masked) as loss_chars, sha256(masked) as loss_sha256, formatted_chars from told"""


@common.query("op12_prefix_target_chat", SQL)
def op12_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(ADDED[0], 0, "user", ADDED[1]), (ADDED[0], 1, "assistant", ADDED[1])], "conv_id bigint, turn bigint, role string, text string")
    every = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return digest(common.settled(expand(every), "chat", compression="zstd"))
