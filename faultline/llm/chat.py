"""Chat formatting with one training example per assistant turn.

``expand`` writes, for every assistant turn of a conversation, an example that holds
all turns before it as context and ends with that turn. The loss mask of an example is the
range of its last reply, so a reply is trained once. Turns after the last reply would be
lost, so a conversation that does not end with one gets a closing example without a
mask. The template marks a turn as ``<|role|>text<|end|>`` and a line feed.
Marks of this and of common templates inside texts and roles are escaped with a
backslash and come back whole.

Null texts and roles count as empty, a null id is a conversation of its own. Turns with
equal number are ordered by role and text, so reruns agree. Other columns are not used. A task reads its conversations turn by
turn in order and holds one example at a time. The output of a conversation grows with the square of its
turns, which is what the expansion is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The first character of every control string, before the rest of it (fixed values):
# <| |> <s> </s> [INST] [/INST] <<SYS>> <</SYS>>
_CONTROL = re.compile(r"(<(?=\||/?s>|</?SYS>>)|\|(?=>)|\[(?=/?INST\]))")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|(.*?)\|>(.*?)<\|end\|>\n", re.DOTALL)
_END = "<|end|>\n"
ASSISTANT = "assistant"
# Characters of examples that are gathered before they leave a task.
_OUTPUT_CHARS = 1 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted example."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, example, target turn, text, loss start, loss end, closing) in order."""
    missing = object()
    conv, parts, size, example, waiting = missing, [], 0, 0, False

    def closing():
        return (conv, example, None, "".join(parts), None, None)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")]
        for key, turn, role, text in zip(*columns, strict=True):
            if key != conv:
                if waiting:
                    yield closing()
                conv, parts, size, example = key, [], 0, 0
            head, body = f"<|{escape(role or '')}|>", escape(text or "")
            parts = ["".join(parts) + head + body + _END] if role == ASSISTANT else [*parts, head + body + _END]
            start = size + len(head)
            size = start + len(body) + len(_END)
            waiting = role != ASSISTANT
            if not waiting:
                yield conv, example, turn, parts[0], start, start + len(body)
                example += 1
    if waiting:
        yield closing()


def expand(conversations: DataFrame) -> DataFrame:
    """The examples of all conversations.

    Columns: conv_id, example (from 0), target_turn, text, loss_start and loss_end (code
    points of ``text``, end exclusive). A closing example has no target and no mask.
    The rows of a conversation lie in one partition, in order.
    """
    fields = {f.name: f.dataType for f in conversations.schema}
    schema = T.StructType(
        [
            T.StructField("conv_id", fields["conv_id"]),
            T.StructField("example", T.IntegerType()),
            T.StructField("target_turn", fields["turn"]),
            T.StructField("text", T.StringType()),
            T.StructField("loss_start", T.LongType()),
            T.StructField("loss_end", T.LongType()),
        ]
    )

    def run(batches):
        rows, chars = [], 0
        for row in _examples(batches):
            rows.append(row)
            chars += len(row[3])
            if chars >= _OUTPUT_CHARS:
                yield _batch(rows, schema)
                rows, chars = [], 0
        if rows:
            yield _batch(rows, schema)

    turns = conversations.select("conv_id", "turn", "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read from their text and masks.

    ``examples`` must come from ``expand``. Columns: conv_id, n_turns, turns_sha256 (role,
    line feed, text, line feed per turn), loss_chars, loss_sha256 (replies under the
    mask, unescaped), formatted_chars (of all examples) and n_examples.
    """
    kind = next(f.dataType for f in examples.schema if f.name == "conv_id")
    schema = T.StructType(
        [
            T.StructField("conv_id", kind),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
            T.StructField("n_examples", T.LongType()),
        ]
    )

    def run(batches):
        def whole(conv, last, state):
            turns = parse(last)
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            return conv, len(turns), digest.hexdigest(), state[0], state[1].hexdigest(), state[2], state[3]

        missing = object()
        conv, last, state = missing, "", [0, hashlib.sha256(), 0, 0]
        for batch in batches:
            done = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "text", "loss_start", "loss_end")]
            for key, text, start, end in zip(*columns, strict=True):
                if key != conv:
                    if conv is not missing:
                        done.append(whole(conv, last, state))
                    conv, state = key, [0, hashlib.sha256(), 0, 0]
                last = text
                if start is not None:
                    reply = unescape(text[start:end])
                    state[0] += len(reply)
                    state[1].update(reply.encode())
                state[2] += len(text)
                state[3] += 1
            if done:
                yield _batch(done, schema)
        if conv is not missing:
            yield _batch([whole(conv, last, state)], schema)

    return examples.mapInArrow(run, schema)
