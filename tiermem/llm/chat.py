"""Chat formatting by event-sourced reconstruction: a log of starts, streamed deltas, edits and regenerations is folded into final messages, then rendered.

Log: conv_id, msg (order of the message in its conversation), copy, seq, kind, role, text. Kinds: "start" (sets the role), "delta" (appends text),
"edit" (replaces the whole text), "regenerate" (drops what the message held; deltas that follow build the new text). An event that is delivered again
(equal in all columns) counts once; unlike deltas of one seq are appended in order of their text. The log is partitioned by message, so that a conversation of any length is spread over tasks; only digests, which are sequential by nature, walk a whole conversation,
and they keep no more than the message at hand.

Template: <|im_start|>ROLE\\nTEXT<|im_end|>\\n for each message. Inside texts each "<", any backslashes, "|" gets one more backslash after the "<",
so no text can hold a control string, and taking one backslash away gives the text back.

Defined cases: null role or text counts as empty; rows with equal conv_id and turn are messages of their own, ordered by role and text; null turn
comes first; null conv_id is a conversation; a message without a start has an empty role, one with several the last; events of null kind, and deltas
and edits of null seq, are left out; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Code points of one delta when whole messages are turned into a log.
DELTA_CHARS = 4096
#: Code points of a wrong draft.
DRAFT_CHARS = 24
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<\\" in text else text


def log_of(rows: DataFrame, delta_chars: int = DELTA_CHARS, revisions: bool = False) -> DataFrame:
    """The log that streaming the given messages (conv_id, turn, role, text) leaves: a start and the deltas of each.

    revisions: each message is begun wrongly first (DRAFT_CHARS characters, turned round); learned ones are then regenerated, the others edited into
    their first delta's text, and the last event of every message is delivered twice. So the fold has to undo all of it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("msg"), role.alias("role"), text.alias("text"))
    one = one.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "msg").orderBy("role", "text")))
    event = lambda seq, kind, said: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    part = f"substring(text, i * {delta_chars} + 1, {delta_chars})"
    deltas = lambda first: F.expr(f"transform(filter(sequence(0, cast((length(text) - 1) div {delta_chars} as int)), i -> i >= {first}), i -> struct(i + 3 as seq, 'delta' as kind, {part} as text))")
    start = event(0, "start", F.lit(""))
    if revisions:
        draft = event(1, "delta", F.reverse(F.substring("text", 1, DRAFT_CHARS)))
        again = F.concat(F.array(start, draft, event(2, "regenerate", F.lit(""))), deltas(0))
        fixed = F.concat(F.array(start, draft, event(2, "edit", F.substring("text", 1, delta_chars))), deltas(1))
        events = F.when(F.col("role") == LEARNED, again).otherwise(fixed)
        events = F.concat(events, F.slice(events, -1, 1))
    else:
        events = F.concat(F.array(start), deltas(0))
    return one.select("conv_id", "msg", "copy", "role", F.explode(events).alias("e")).select("conv_id", "msg", "copy", "e.seq", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, msg, copy, role, text of every message: what stands after its events in order of seq."""
    steps = F.sort_array(F.collect_set(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    last = "coalesce(array_max(transform(filter(steps, e -> e.kind in ('edit', 'regenerate')), e -> e.seq)), -1)"
    return (
        log.groupBy("conv_id", "msg", "copy")
        .agg(steps.alias("steps"))
        .withColumn("reset", F.expr(last))
        .select("conv_id", "msg", "copy", F.expr("coalesce(try_element_at(transform(filter(steps, e -> e.kind = 'start'), e -> e.role), -1), '')").alias("role"), F.expr("array_join(transform(filter(steps, e -> (e.seq > reset and e.kind = 'delta') or (e.seq = reset and e.kind = 'edit')), e -> e.text), '')").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """The messages with formatted (string; a conversation's output is these in order of msg, copy) and the code points [loss_start, loss_end) of it that are learned."""
    head = F.concat(F.lit(START), F.regexp_replace(F.regexp_replace(escaped(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n"), F.lit("\n"))
    body = escaped(F.col("text"))
    learned = F.col("role") == LEARNED
    return messages.withColumn("formatted", F.concat(head, body, F.lit(END))).withColumn("loss_start", F.when(learned, F.length(head))).withColumn("loss_end", F.when(learned, F.length(head) + F.length(body)))


def parsed(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted message."""
    if not formatted.startswith(START) or not formatted.endswith(END):
        raise ValueError("not a formatted message")
    head, _, body = formatted[len(START) : -len(END)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
    return unescaped(role), unescaped(body)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    begun, now, out = False, None, []

    def closed() -> tuple:
        return now, n, turns.hexdigest(), learned, loss.hexdigest(), chars

    for batch in batches:
        for conv, text, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if not begun or conv != now:
                if begun:
                    out.append(closed())
                begun, now, n, learned, chars, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, said = parsed(text)
            n += 1
            chars += len(text)
            turns.update(f"{role}\n{said}\n".encode())
            if a is not None:
                mask = unescaped(text[a:b])
                learned += len(mask)
                loss.update(mask.encode())
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if begun:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from the output of each conversation, in order of msg and copy."""
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "copy").select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digests, DIGEST)
