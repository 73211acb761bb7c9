"""Chat formatting by event-sourced reconstruction.

A log of events (conversation, sequence, kind, message, role, text) is partitioned by conversation, sorted by sequence and
folded into final messages:

    message     a whole message; of a known message, it replaces role and text
    open        an empty message of a role, to be streamed
    delta       text appended to a message (opened without a role if need be)
    edit        a message's new text
    regenerate  a message's text is dropped and streamed anew; later messages of the conversation go, as they answered the old text
    delete      the message goes

Messages keep the order in which they first appeared. The final messages are then rendered:

    [INST]user[/INST]  <s>assistant</s>  [SYS]system[/SYS]  [TURN name]other[/TURN]

A control string inside a text or a name gets a backslash before it, with any backslashes that already stand there (or
at the text's end) doubled, so the rendering can be read back exactly. The loss mask covers the assistant texts.

A conversation's events come sorted from the shuffle and are folded as they stream by, so a task holds one conversation at a
time, whose rendering is one value of the result anyway; a conversation with a large share of all rows takes one task as
long as its own events take.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import map_rows

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
CONTROL = r"\[INST\]|\[/INST\]|<s>|</s>|\[SYS\]|\[/SYS\]|\[TURN |\[/TURN\]|\]"
ESCAPED = re.compile(rf"(?<!\\)(\\*+)({CONTROL}|\Z)")
OPENERS = {start: role for role, (start, _) in MARKS.items()}


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def _until(text: str, at: int, close: str) -> tuple[str, int]:
    """The escaped text up to the closing control string, and where that ends."""
    out, start = [], at
    for m in ESCAPED.finditer(text, at):
        slashes = len(m[1])
        out += [text[start : m.start()], "\\" * (slashes // 2)]
        start = m.end()
        if slashes % 2:
            out.append(m[2])
        elif m[2] == close:
            return "".join(out), m.end()
        elif m[2]:
            raise ValueError(f"{m[2]!r} inside a turn at {m.start()}")
    raise ValueError(f"no {close!r}")


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans in it: the escaped assistant texts)."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        start, end = MARKS.get(role) or (f"[TURN {escape(role)}]", "[/TURN]")
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(start), at + len(start) + len(body)))
        parts += [start, body, end]
        at += len(start) + len(body) + len(end)
    return "".join(parts), mask


def read(formatted: str) -> list[tuple[str, str]]:
    """The messages that render() wrote."""
    out, at = [], 0
    while at < len(formatted):
        start = next((s for s in OPENERS if formatted.startswith(s, at)), None)
        if start:
            role, close = OPENERS[start], MARKS[OPENERS[start]][1]
            at += len(start)
        elif formatted.startswith("[TURN ", at):
            role, at = _until(formatted, at + 6, "]")
            close = "[/TURN]"
        else:
            raise ValueError(f"no turn at {at}")
        text, at = _until(formatted, at, close)
        out.append((role, text))
    return out


def fold(events: Iterator[tuple[str, object, str | None, str | None]]) -> list[tuple[str, str]]:
    """events: (kind, message, role, text) by sequence. Unknown kinds are an error; null roles and texts are empty."""
    held: dict[object, list] = {}
    for kind, name, role, text in events:
        if kind in ("message", "open"):
            held[name] = [role or "", [text or ""]]
        elif kind == "delta":
            held.setdefault(name, [role or "", []])[1].append(text or "")
        elif kind == "edit":
            held.setdefault(name, [role or "", []])[1][:] = [text or ""]
        elif kind == "regenerate":
            if name in held:
                names = list(held)
                for later in names[names.index(name) + 1 :]:
                    del held[later]
                held[name][1][:] = [text or ""]
        elif kind == "delete":
            held.pop(name, None)
        else:
            raise ValueError(f"unknown kind of event: {kind!r}")
    return [(role, "".join(parts)) for role, parts in held.values()]


def events_of_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log of whole messages, one of each row, by turn; rows with one turn come by role, then text. Repeated rows are messages too."""
    return df.select(F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("message"), F.col(role).alias("role"), F.col(text).alias("text"))


def streamed_log(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log that a chat server would have written on the way to these turns, partitioned by conversation: by turn messages come whole,
    are edited and edited back, are regenerated and streamed in two deltas, or get a delta that an edit takes away; after every third, another
    message is opened, streamed and deleted. Its fold gives the turns: by turn, rows with one turn by role, then text; repeated rows too."""
    rows = df.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conversation").orderBy("turn", "role", "text"))
    rows = rows.withColumn("at", at.cast("long")).drop("turn")
    name, half = F.col("at").cast("string"), F.floor(F.char_length("text") / 2).cast("int")
    nothing = F.lit(None).cast("string")

    def event(step: int, kind: str, body: Column, of: Column = name, by: Column = nothing) -> Column:
        return F.struct((F.col("at") * 16 + step).alias("seq"), F.lit(kind).alias("kind"), of.alias("message"), by.alias("role"), body.alias("text"))

    whole = event(0, "message", F.col("text"), by=F.col("role"))
    ways = [
        F.array(whole),
        F.array(whole, event(1, "edit", F.concat("text", F.lit(" (sic)"))), event(2, "edit", F.col("text"))),
        F.array(event(0, "open", nothing, by=F.col("role")), event(1, "delta", F.lit("an answer that is not wanted")), event(2, "regenerate", nothing), event(3, "delta", F.substr("text", F.lit(1), half)), event(4, "delta", F.substr("text", half + 1))),
        F.array(whole, event(1, "delta", F.lit(" and more")), event(2, "edit", F.col("text"))),
    ]
    way = F.when(F.col("at") % 4 == 0, ways[0]).when(F.col("at") % 4 == 1, ways[1]).when(F.col("at") % 4 == 2, ways[2]).otherwise(ways[3])
    other = F.concat(name, F.lit("x"))
    gone = F.array(event(8, "open", nothing, other, F.lit("user")), event(9, "delta", F.lit("never mind"), other), event(10, "delete", nothing, other))
    told = F.when(F.col("at") % 3 == 0, F.concat(way, gone)).otherwise(way)
    return rows.select("conversation", F.inline(told))


def reconstruct(events: DataFrame, partitioned: bool = False) -> DataFrame:
    """(conversation, formatted, mask) of every conversation of an event log; mask: array of (start, end), code points.

    A null message name makes its event a message of its own. Events with equal sequence come by kind, message, role and
    text (nulls first), so results do not depend on how rows were dealt. Rows without a conversation form one of their own.
    A conversation whose messages were all deleted has an empty rendering; texts of any length are rendered whole; further columns are not
    read, whatever their names; an empty log gives no rows. `partitioned` says that each conversation's events are in one partition already.
    """
    kind = events.schema["conversation"].dataType.simpleString()
    columns = ["conversation", "kind", "message", "role", "text"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = None
        now: list = []
        current: object = None

        def out() -> pa.RecordBatch:
            formatted, mask = render(fold(iter(now)))
            spans = pa.array([[{"start": a, "end": b} for a, b in mask]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([current], typed), pa.array([formatted], pa.string()), spans], names=["conversation", "formatted", "mask"])

        for batch in batches:
            typed = batch.schema.field(0).type
            for name, k, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and name != current:
                    yield out()
                    now = []
                current = name
                now.append((k, object() if message is None else message, role, text))
        if now:
            yield out()

    parted = events.select("conversation", "seq", "kind", F.col("message").cast("string").alias("message"), "role", "text")
    if not partitioned:
        parted = parted.repartition("conversation")
    return parted.sortWithinPartitions("conversation", "seq", "kind", "message", "role", "text").select(*columns).mapInArrow(over, f"conversation {kind}, formatted string, mask array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the rendering and its mask alone."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, loss, said, chars = read(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    said.update(f"{role}\n{body}\n".encode())
                for span in mask:
                    body, _ = _until(text[span["start"] : span["end"]] + "</s>", 0, "</s>")
                    loss.update(body.encode())
                    chars += len(body)
                rows.append((len(turns), said.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        return work

    kind = formatted.schema["conversation"].dataType.simpleString()
    return map_rows(formatted, ["conversation", "formatted", "mask"], make, f"conversation {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same rows in DuckDB over `conversations` and the planted conversation.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '(\\*)(\[INST\]|\[/INST\]|<s>|</s>|\[SYS\]|\[/SYS\]|\[TURN |\[/TURN\]|\])', '\1\1\\\2', 'g')) + length(regexp_extract(text, '\\*$')) AS body,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 14 + length(role) END AS marks
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
