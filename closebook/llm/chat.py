"""Chat formatting by event-sourced reconstruction.

Input is an event log: (conv_id, turn, msg, seq, kind, role, payload).  Kinds:
``start`` opens a message, ``delta`` appends, ``regenerate`` drops what was
streamed so far, ``edit`` replaces the text, ``end`` closes.  Events of one
message are folded by ``seq`` (an event delivered twice counts once); a hot
conversation is spread over its messages in this step.  Then the final
messages are sorted by turn within their conversation and rendered in a
streaming pass.  A conversation of more than ``CHUNK_CHARS`` leaves as several
rows of whole messages, rendered by several tasks; its text is that of its
rows in the order (part, piece).  Long messages of one conversation, turn and
role that begin with the same ``HEAD_CHARS`` code points meet in one task,
which sorts them on disk and streams them.

Template: ``<|start|>role\\ntext<|end|>\\n`` per message.  In roles and texts
a backslash is doubled, and a backslash goes behind the first character of
every control string, of this and of other usual templates; ``unescape``
drops one backslash and keeps the next character, so the text comes back
exactly.  The loss mask lists (start, length) of the assistant texts in code
points of the output row.

Defined results.  Null text or role: empty.  Null turn: after the others.
Equal turns: by role, then text; rows repeated exactly are messages of their
own.  A message without ``start`` has an empty role.  Null conv_id: one
conversation.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.arrow_words import pieces
from closebook.llm.common import stored

EVENTS = "conv_id long, turn long, msg string, seq int, kind string, role string, payload string"
START, END = "<|start|>", "<|end|>\n"
#: Control strings that must not appear inside texts.
CONTROL = re.compile(r"<\||\[/?INST\]|</?s>|<</?SYS>>")
ASSISTANT = "assistant"
CHUNK_CHARS = 1 << 16
HEAD_CHARS = 1000


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def events_of(conversations: DataFrame) -> DataFrame:
    """An event log whose final state is the given conversations.

    Every row becomes a streamed message: assistant texts in three deltas,
    some after a first attempt that is regenerated; some other texts as a
    draft that an edit completes.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    n = F.char_length("text")
    a, b = (n / 3).cast("int"), (n * 2 / 3).cast("int")
    cut = lambda lo, hi: F.substr(F.col("text"), lo + 1, hi - lo)
    kind = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(3))
    zero = F.lit(0)

    def ev(seq: int, kind: str, payload):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), payload.alias("payload"))

    streamed = [ev(5, "delta", cut(zero, a)), ev(6, "delta", cut(a, b)), ev(7, "delta", cut(b, n))]
    again = [ev(1, "delta", cut(zero, b)), ev(2, "regenerate", F.lit(""))]
    draft = [ev(1, "delta", cut(zero, a)), ev(9, "edit", F.col("text"))]
    opened, closed = ev(0, "start", F.lit("")), ev(10, "end", F.lit(""))
    log = (F.when((F.col("role") == ASSISTANT) & (kind == 0), F.array(opened, *again, *streamed, closed))
           .when((F.col("role") != ASSISTANT) & (kind == 1), F.array(opened, *draft, closed))
           .otherwise(F.array(opened, *streamed, closed)))
    msg = F.concat_ws(":", F.col("role"), F.sha2(F.col("text").cast("binary"), 256), F.col("copy").cast("string"))
    return (c.select("conv_id", "turn", msg.alias("msg"), "role", F.explode(log).alias("e"))
            .select("conv_id", "turn", "msg", "e.seq", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.payload"))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, role, text): the final state of every message.

    Partitioned by message and sorted by seq, then folded in one pass; state
    is one message.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, role, text = None, None, "", []
        for f in frames:
            done = []
            f = f.astype(object).where(f.notna(), None)
            for conv, turn, msg, seq, kind, who, payload in f.itertuples(index=False, name=None):
                if key != (conv, turn, msg):
                    if key is not None:
                        done.append((*key, role, "".join(text)))
                    key, last, role, text = (conv, turn, msg), None, "", []
                if (seq, kind) == last:
                    continue  # delivered twice
                last = (seq, kind)
                if kind == "start":
                    role = who or ""
                elif kind == "delta":
                    text.append(payload or "")
                elif kind == "regenerate":
                    text = []
                elif kind == "edit":
                    text = [payload or ""]
            yield frame(done)
        if key is not None:
            yield frame([(*key, role, "".join(text))])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=["conv_id", "turn", "msg", "role", "text"], dtype=object)
        return f.astype({"conv_id": "Int64", "turn": "Int64"})

    keyed = events.select("conv_id", "turn", "msg", "seq", "kind", "role", "payload").repartition("conv_id", "turn", "msg")
    return (keyed.sortWithinPartitions("conv_id", "turn", "msg", "seq", "kind")
            .mapInPandas(fold, "conv_id long, turn long, msg string, role string, text string"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, part, piece, whole, formatted, loss_mask): the formatted rows
    of every conversation, in the order (part, piece).

    Conversations are measured first.  One of at most ``CHUNK_CHARS`` goes to
    one task and is one row.  The messages of longer ones are dealt by ranges
    of their order, so that several tasks render one conversation, and leave
    in rows of at most twice ``CHUNK_CHARS`` (escapes) or of one message.
    """
    messages = stored(messages.withColumn("size", F.char_length("role") + F.char_length("text") + len(START) + len(END) + 1), "chat-messages")
    sizes = messages.groupBy("conv_id").agg(F.sum("size").alias("chars"))
    long = sizes.where(F.col("chars") > CHUNK_CHARS).select(F.col("conv_id").alias("long_id"))
    if long.isEmpty():
        return in_rows(messages.repartition("conv_id"), True)
    long = stored(long, "chat-long")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = messages.join(long, same, "left_anti").repartition("conv_id")
    head = F.substring("text", 1, HEAD_CHARS)
    more = F.char_length("text") > HEAD_CHARS
    # rises with (turn, role, text, msg); the driver samples heads, not whole texts
    ranges = messages.join(long, same, "left_semi").repartitionByRange(
        "conv_id", F.col("turn").asc_nulls_last(), "role", head, more, F.when(~more, F.col("msg")))
    return in_rows(short, True).unionByName(in_rows(ranges, False))


def in_rows(dealt: DataFrame, whole: bool) -> DataFrame:
    """The rows of dealt messages.  ``whole``: a task has all messages of a
    conversation, which become one row."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0 if whole else TaskContext.get().partitionId()
        conv, piece, out, mask, at, ready, held = None, 0, [], [], 0, [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("whole", pa.bool_()), ("formatted", pa.string()),
                            ("loss_mask", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

        def one() -> dict:
            return {"conv_id": conv, "part": part, "piece": piece, "whole": whole, "formatted": "".join(out), "loss_mask": mask}

        for b in pieces(batches):
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                head, body = START + escape(role).replace("\n", "\\\n") + "\n", escape(text)
                size = len(head) + len(body) + len(END)
                if out and (c != conv or (not whole and at + size > CHUNK_CHARS)):
                    ready.append(one())
                    held += at
                    piece = piece + 1 if c == conv else 0
                    out, mask, at = [], [], 0
                    if held > CHUNK_CHARS:
                        yield pa.RecordBatch.from_pylist(ready, schema)
                        ready, held = [], 0
                conv = c
                if role == ASSISTANT:
                    mask.append({"start": at + len(head), "length": len(body)})
                out += [head, body, END]
                at += size
        if out:
            yield pa.RecordBatch.from_pylist([*ready, one()], schema)

    by = dealt.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text", "msg").select("conv_id", "role", "text")
    return by.mapInArrow(render, "conv_id long, part int, piece long, whole boolean, formatted string, loss_mask array<struct<start:long,length:long>>")


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of an output; inside texts no START or END is left unescaped."""
    turns = []
    for part in formatted.split(START)[1:]:
        head = re.match(r"(?:[^\\\n]|\\.)*", part, re.S)[0]
        turns.append((unescape(head), unescape(part[len(head) + 1:-len(END)])))
    return turns


def plain(formatted: str, mask: list[dict]) -> tuple[int, bytes, int, bytes, int]:
    """(turns, their texts, code points under the mask, their text, code
    points of the output) of a row."""
    turns = parsed(formatted)
    loss = [unescape(formatted[m["start"]:m["start"] + m["length"]]) for m in mask or []]
    return (len(turns), "".join(f"{role}\n{body}\n" for role, body in turns).encode(), sum(map(len, loss)), "".join(loss).encode(), len(formatted))


def read_back(output: DataFrame) -> DataFrame:
    """Digest of written conversations, parsed from their text and mask.

    Rows are parsed where they are read.  Only the parts of long conversations
    are then brought together, and their bytes run in order through two hash
    states; a digest of a whole conversation leaves no other way.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    result = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def frame(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "formatted"):
            rows = []
            for conv, text, mask in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_mask"))):
                n, turns, chars, loss, size = plain(text, mask)
                rows.append((conv, n, hashlib.sha256(turns).hexdigest(), chars, hashlib.sha256(loss).hexdigest(), size))
            yield frame(rows, names, kinds)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ["conv_id", "part", "piece", "n", "turns", "chars", "loss", "size"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
        for b in pieces(batches, "formatted"):
            yield frame([(conv, part, piece, *plain(text, mask)) for conv, part, piece, text, mask in
                         zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "piece", "formatted", "loss_mask")))], cols, types)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums, states = None, None, None
        for b in pieces(batches, "turns"):
            done = []
            for c, n, turns, chars, loss, size in zip(*(b.column(x).to_pylist() for x in ("conv_id", "n", "turns", "chars", "loss", "size"))):
                if sums is None or c != conv:
                    if sums is not None:
                        done.append((conv, sums[0], states[0].hexdigest(), sums[1], states[1].hexdigest(), sums[2]))
                    conv, sums, states = c, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [sums[0] + n, sums[1] + chars, sums[2] + size]
                states[0].update(turns)
                states[1].update(loss)
            yield frame(done, names, kinds)
        if sums is not None:
            yield frame([(conv, sums[0], states[0].hexdigest(), sums[1], states[1].hexdigest(), sums[2])], names, kinds)

    parts = (output.where(~F.col("whole"))
             .mapInArrow(opened, "conv_id long, part int, piece long, n long, turns binary, chars long, loss binary, size long")
             .repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece"))
    return output.where("whole").mapInArrow(digest, result).unionByName(parts.mapInArrow(joined, result))


def format_log(events: DataFrame) -> DataFrame:
    return rendered(folded(events))
