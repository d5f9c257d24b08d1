"""Prefix-target expansion of conversations into training examples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates give a meaning.
CONTROL = [TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
CONTROL_RE = re.compile("|".join(f"({re.escape(c)})" for c in sorted(CONTROL, key=len, reverse=True)))
TURN_RE = re.compile(f"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.DOTALL)
EXAMPLE = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long"
#: Characters of examples in one Arrow batch, about.
BATCH_CHARS = 4 << 20


def escape(s: str) -> str:
    """``s`` with no control string left in it: backslashes doubled, and one put after the first character of each control string."""
    s = s.replace("\\", "\\\\")
    while m := CONTROL_RE.search(s):  # a second round is needed only where control strings overlap
        s = CONTROL_RE.sub(lambda m: m[0][0] + "\\" + m[0][1:], s)
    return s


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL) if "\\" in s else s


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted example."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN_RE.finditer(text)]


def expand(turns: Iterator[tuple[str, str]]) -> Iterator[tuple[int, int, str, int, int]]:
    """Examples of one conversation: number, turns, text, and the span that is trained on.

    Turns after the last reply make one more example without a span, so that no turn is lost.
    """
    done, n, k, open_turns = "", 0, 0, False
    for role, text in turns:
        piece, a, b = render(role, text)
        at, done, n, open_turns = len(done), done + piece, n + 1, True
        if role == "assistant":
            yield k, n, done, at + a, at + b
            k, open_turns = k + 1, False
    if open_turns:
        yield k, n, done, -1, -1


def examples(df: DataFrame) -> DataFrame:
    """Examples (conv_id, example, n_turns, text, loss_start, loss_end) of conversations given as rows (conv_id, turn, role, text).

    Every assistant turn makes one example: all turns before it as context, and it as the only
    text under the loss, at [loss_start, loss_end) in code points of the formatted text. Rows are dealt by
    conversation and sorted, then streamed: memory is one conversation's text and a batch, whatever the number of
    conversations or turns. The output itself grows with the square of a conversation's turns, as the method has it.

    Turns come in the order of turn, then role, then text (nulls first); repeated rows are turns of their own.
    Null role or text: ''. Null conv_id: one conversation. Control strings in roles and texts are escaped and can
    be recovered. Other columns are not read; empty input gives no examples.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def flat():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        out, held = [], 0
        for conv, group in groupby(flat(), key=lambda r: r[0]):
            for e in expand((r or "", t or "") for _, r, t in group):
                out.append((conv, *e))
                held += len(e[2])
                if held > BATCH_CHARS:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, EXAMPLE)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in EXAMPLE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``examples`` wrote, read from its text: one row per conversation.

    Examples of a conversation follow each other in one partition, so this streams over them and
    shuffles nothing. Turns are parsed from the last example, which has them all, and the trained text from each span.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def flat():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True)

        out = []
        for conv, group in groupby(flat(), key=lambda r: r[0]):
            loss, chars, total, k, last = hashlib.sha256(), 0, 0, 0, ""
            for _, text, a, b in group:
                if a >= 0:
                    trained = unescape(text[a:b])
                    chars += len(trained)
                    loss.update(trained.encode())
                total, k, last = total + len(text), k + 1, text
            turns = parse(last)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": digest, "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total, "n_examples": k})
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return formatted.mapInArrow(run, schema)
