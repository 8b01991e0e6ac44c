"""Chat formatting from event logs.

A log holds events (conversation, turn, seq, kind, role, text). Logs are dealt out by conversation and sorted by turn
and seq; one pass folds a turn's events into its final message and renders it, holding one message at a time:

- message: opens a message of that role with that text (a second one in a turn opens another message);
- delta: appends to the turn's last message; a delta that comes first opens one with the event's role;
- edit: replaces the message's text so far;
- regenerate: empties the message, and withdraws what later turns had got before that moment.

The template is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts a backslash becomes two and `<|` becomes `<\\|`, so no
text can hold a control string, and `unescape` gives the text back. In roles a newline becomes `\\n` as well.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
PIECES = "conv_id long, position int, piece string, loss_from int, loss_to int"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message in the template, and the span of it (code points) that carries loss: an assistant's text."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body) * (role == LEARNED)


class Parts(list):
    """Text gathered from deltas."""

    def text(self) -> str:
        return "".join(self)


def folded(rows):
    """Sorted events -> (conversation, role, text) of each final message, in order."""
    conversation, turn, opened = object(), None, []
    cut = turn_cut = None  # events of later turns from before this seq are withdrawn
    for conv, at, seq, kind, role, text in rows:
        if kind not in ("message", "delta", "edit", "regenerate"):
            continue
        text = text or ""
        if conv != conversation or at != turn:
            for r, parts in opened:
                yield conversation, r, parts.text()
            opened = []
            cut = None if conv != conversation else max((x for x in (cut, turn_cut) if x is not None), default=None)
            turn_cut = None
            conversation, turn = conv, at
        if cut is not None and seq is not None and seq < cut:
            continue
        if kind == "message" or not opened:
            opened.append((role or "", Parts([text] if kind != "regenerate" else [])))
        elif kind == "delta":
            opened[-1][1].append(text)
        elif kind == "edit":
            opened[-1][1][:] = [text]
        elif kind == "regenerate":
            opened[-1][1].clear()
        if kind == "regenerate" and seq is not None:
            turn_cut = seq if turn_cut is None else max(turn_cut, seq)
    for r, parts in opened:
        yield conversation, r, parts.text()


def _events(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows, names, types, size=2000, most=8 << 20):
    held, weight = [], 0
    schema = pa.schema(list(zip(names, types, strict=True)))
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=schema)


def _render(batches):
    def rows():
        last, position = object(), 0
        for conv, role, text in folded(_events(batches)):
            position = position + 1 if conv == last else 0
            last = conv
            yield conv, position, *render(role, text)

    yield from _batches(rows(), ["conv_id", "position", "piece", "loss_from", "loss_to"], [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()])


def format_events(events: DataFrame, conv: str = "conv_id", turn: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Event log -> one row for each final message: conv_id, position (from 0), piece, and the piece's loss span.

    A conversation's formatted text is its pieces in order of position. Null text and null role count as empty; null
    conversation ids make one conversation; null turns and seqs come first. Events that tie in turn and seq are
    ordered by kind, role and text; repeated events count each time; events of a kind other than message, delta, edit and
    regenerate, or of none, are passed over. Ids are numbers or strings of them. Only the named columns are read. An empty log
    gives no rows. Rows of one conversation meet in one task, which streams them: it never holds more than a turn.
    """
    flat = events.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(seq).cast("long").alias("seq"),
        F.col(kind).alias("kind"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    )
    # the order within a partition is the operator's: it must stay that of the sort up to the reader
    return flat.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text").mapInArrow(_render, PIECES)


def messages_as_events(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of finished messages as a log: each row opens a message."""
    return messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(turn).alias("seq"), F.lit("message").alias("kind"), F.col(role).alias("role"), F.col(text).alias("text"),
    )


def conversations(pieces: DataFrame) -> DataFrame:
    """Pieces -> one row for each conversation: conv_id, formatted, and loss_spans (code points) over it."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "piece", "loss_from", "loss_to")))
    whole = pieces.groupBy("conv_id").agg(ordered.alias("p"))

    def shifted() -> Column:
        at = F.aggregate(
            "p",
            F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("s")),
            lambda acc, x: F.struct(
                (acc["n"] + F.length(x["piece"])).alias("n"),
                F.when(x["loss_to"] > x["loss_from"], F.concat(acc["s"], F.array(F.struct((acc["n"] + x["loss_from"]).alias("a"), (acc["n"] + x["loss_to"]).alias("b"))))).otherwise(acc["s"]).alias("s"),
            ),
        )
        return at["s"]

    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), shifted().alias("loss_spans"))


MESSAGE = re.compile(re.escape(START) + r"(?P<role>[^\n]*)\n(?P<text>.*?)" + re.escape(END), re.S)


def _digest(batches):
    def rows():
        last, state = object(), None

        def done():
            n, turns, chars, loss, total = state
            return last, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            for conv, _, piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != last or state is None:
                    if state is not None:
                        yield done()
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = MESSAGE.fullmatch(piece)
                state[0] += 1
                state[1].update(f"{unescape(found['role'])}\n{unescape(found['text'])}\n".encode())
                learned = unescape(piece[a:b])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(piece)
        if state is not None:
            yield done()

    yield from _batches(rows(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])


def digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from the output of format_events, in the same stage: the pieces come in order."""
    return pieces.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
