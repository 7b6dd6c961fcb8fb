"""Conversations rebuilt from event logs, and rendered with reversible escapes.

The log is dealt by conversation and sorted by sequence; one pass over each partition folds events
into messages, holding the messages of one conversation at a time. Rendering marks turns with
control strings that cannot occur inside an escaped text, so the output can be read back.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm import arrays as A

# The template. A turn is OPEN role NEWLINE text CLOSE NEWLINE.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEARNED = "assistant"

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escape(text: str) -> str:
    """`<|` never occurs in the result, and `unescape` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


class Messages:
    """The messages of one conversation while its events come in order.

    message: a new turn. delta: text at the end of the last message of that role, else a new turn.
    edit: the text of the turn that `target` names is replaced. regenerate: the last message of
    that role and all after it go, and the event's text, if any, begins it anew. An edit of a turn
    that is not there, and a kind that is not known, change nothing.
    """

    def __init__(self):
        self.turns: list[list[str]] = []

    def fold(self, kind: str, role: str, text: str, target: int | None) -> None:
        if kind == MESSAGE:
            self.turns.append([role, text])
        elif kind == DELTA:
            if self.turns and self.turns[-1][0] == role:
                self.turns[-1][1] += text
            else:
                self.turns.append([role, text])
        elif kind == EDIT:
            if target is not None and 0 <= target < len(self.turns):
                self.turns[target][1] = text
        elif kind == REGENERATE:
            for at in range(len(self.turns) - 1, -1, -1):
                if self.turns[at][0] == role:
                    del self.turns[at:]
                    break
            self.turns.append([role, text])

    def render(self) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans of learned texts in it, in code points."""
        parts, spans, at = [], [], 0
        for role, text in self.turns:
            head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
            if role == LEARNED:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        return "".join(parts), spans


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"


def event_log(rows: DataFrame, seq: Column, kind: Column, target: Column | None = None) -> DataFrame:
    """The columns that `format_conversations` reads, from a table with conv_id, role and text."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        seq.cast("long").alias("seq"),
        kind.alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.lit(None) if target is None else target).cast("long").alias("target"),
    )


def format_conversations(log: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted and loss_spans, from conv_id, seq, kind, role, text, target.

    Events count by seq; ties go by kind, role and text, null seq comes first, and repeated
    events count each. Null roles and texts are empty; rows with a null conv_id are one
    conversation. A table without rows gives none. A conversation is folded by one task, as its
    result is one row; the task holds that conversation's messages only.
    """
    order = ["conv_id", "seq", "kind", "role", "text"]
    dealt = A.small_batches(log).select(*order, "target").repartition("conv_id").sortWithinPartitions(*order)

    def run(batches):
        open_id, messages, some = None, None, False
        done: list[tuple] = []
        held = 0

        def close():
            text, spans = messages.render()
            done.append((open_id, text, [{"start": s, "end": e} for s, e in spans]))
            return len(text)

        def out():
            ids, texts, spans = zip(*done, strict=True)
            return pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["conv_id", "formatted", "loss_spans"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "target")]
            for conv_id, kind, role, text, target in zip(*columns, strict=True):
                if not some or conv_id != open_id:
                    if some:
                        held += close()
                        if held > 4 << 20:
                            yield out()
                            done, held = [], 0
                    open_id, messages, some = conv_id, Messages(), True
                messages.fold(kind, role, text, target)
        if some:
            close()
        if done:
            yield out()

    return dealt.mapInArrow(run, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def read_back(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns (role and text), loss_text and formatted_chars, read from the output alone."""
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for piece in A.pieces(batches, "formatted", 2 << 20):
            texts = [t or "" for t in piece.column("formatted").to_pylist()]
            spans = [s or [] for s in piece.column("loss_spans").to_pylist()]
            turns = [[{"role": r, "text": x} for r, x in read_turns(t)] for t in texts]
            learned = ["".join(unescape(t[s["start"] : s["end"]]) for s in mine) for t, mine in zip(texts, spans, strict=True)]
            yield pa.record_batch(
                [piece.column("conv_id"), pa.array(turns, turn), pa.array(learned, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["conv_id", "turns", "loss_text", "formatted_chars"],
            )

    return conversations.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"
    )
