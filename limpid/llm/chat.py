"""Chat logs as events, folded into final messages and rendered for training.

An event has a conversation, a sequence number, a kind, a turn, a role and a text:
``message`` starts or replaces the text of a turn, ``delta`` appends to it,
``edit`` replaces it, ``regenerate`` drops the turn and all later ones that came
before the event and starts the turn again. The fold is two windows (running
minimum of regenerated turns over later events; last replacing event of a turn)
and one aggregation per message, so no task holds a whole conversation.

A rendered message is ``<|start|>role<|message|>text<|end|>``. Inside role and
text every ``<|`` gets a backslash in between, and a run of backslashes there one
more, so control strings cannot occur and the original can be read back. The loss
mask covers the text of assistant messages.

Defined cases: null texts and roles are empty; events of unknown kinds are an
error; equal sequence numbers are ordered by turn, kind and text; repeated rows of
a table of turns are messages each; an empty table gives an empty result; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

KINDS = ("message", "delta", "edit", "regenerate")
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
LOSS_ROLE = "assistant"


def events_of_turns(rows: DataFrame) -> DataFrame:
    """One ``message`` event per row of (conv_id, turn, role, text), in the order of turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return rows.select("conv_id", at.alias("seq"), F.lit("message").alias("kind"), at.alias("turn"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages that stand when all events are applied."""
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))))
    e = events.select("conv_id", "seq", kind.alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq"), F.col("turn"), F.col("kind"), F.col("text")]
    later = Window.partitionBy("conv_id").orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    again = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    alive = e.withColumn("_again", again).where(F.col("_again").isNull() | (F.col("turn") < F.col("_again")))
    place = F.struct("seq", "kind", "text")
    replaces = F.col("kind") != "delta"
    whole = Window.partitionBy("conv_id", "turn")
    named = F.max(F.when(F.col("role") != "", F.struct("seq", "role"))).over(whole)
    kept = alive.withColumn("_named", named["role"]).withColumn("_base", F.max(F.when(replaces, place)).over(whole)).where(F.col("_base").isNull() | (place >= F.col("_base")))
    return kept.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), "").alias("text"),
        F.coalesce(F.max("_named"), F.lit("")).alias("role"),
    ).select("conv_id", "turn", "role", "text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_from, loss_chars): a conversation's text is its segments by turn; the mask is in code points."""
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MESSAGE))
    learnt = F.col("role") == LOSS_ROLE
    return messages.select(
        "conv_id", "turn", F.concat(head, escape(F.col("text")), F.lit(END)).alias("segment"),
        F.when(learnt, F.char_length(head)).cast("long").alias("loss_from"),
        F.when(learnt, F.char_length(escape(F.col("text")))).cast("long").alias("loss_chars"),
    )


_ESCAPED = re.compile(r"<\\(\\*)\|")
_SEGMENT = re.compile(re.escape(START) + "(.*?)" + re.escape(MESSAGE) + "(.*?)" + re.escape(END), re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation, or of any run of its segments."""
    return [(unescape(r), unescape(t)) for r, t in _SEGMENT.findall(formatted)]


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation, from rendered segments alone, streamed in the order of turns."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = segments.select("conv_id", "turn", "segment", "loss_from", "loss_chars").repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, out = None, []

        def close() -> None:
            if state is not None:
                out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, text, at, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_chars"))):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                if at is not None:
                    masked = unescape(text[at:at + n])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=names)

    return ordered.mapInArrow(run, schema)
