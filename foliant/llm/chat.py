"""Operator 6: chat formatting by a compiled template, with generation markers and reversible escapes.

Rows are dealt by conversation and sorted by turn; each task renders one conversation after the other, turn by turn, through the
closures of ``templates``. What is formatted goes out in parts of whole turns, of about ``part_chars`` signs in longer conversations;
nearly all have one part. So no task holds more than a part and a turn, also where one id (or no id) has a third of all
rows; such a conversation is still one stream of one task, since its turns and digests follow each other.

Inside texts and roles, a control string gets a backslash after its first sign (and one more if backslashes stand
there already), so no text can open or close a turn; ``unescape`` takes exactly that one away. ``read_back`` parses
formatted text into roles and texts again.

Defined cases: a null text is empty; a null role is the empty role; turns of any length are formatted whole; rows of a conversation with equal or null turns
are ordered (nulls first) by turn, role, text; a null conversation id is a conversation; equal rows are turns of
their own; other columns are ignored; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import Output, compile_steps

#: The strings that structure formatted text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE] {{ m.role | escape }} [TEXT] {{ m.text | escape }} [/ROLE]{% endif %}"
    "{% endfor %}"
)
_RESTS = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True))
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*)(?={_RESTS})"), re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def read_back(formatted: str, begins: bool = True) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, or of a part of one."""
    if begins and not formatted.startswith("<s>"):
        raise ValueError("not a formatted conversation")
    out, at = [], 3 if begins else 0
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            end = formatted.index(" [/INST]", at + 7)
            out.append(("user", unescape(formatted[at + 7 : end])))
            at = end + 8
        elif formatted.startswith("[ROLE] ", at):
            middle = formatted.index(" [TEXT] ", at + 7)
            end = formatted.index(" [/ROLE]", middle + 8)
            out.append((unescape(formatted[at + 7 : middle]), unescape(formatted[middle + 8 : end])))
            at = end + 8
        else:
            end = formatted.index("</s>", at)
            out.append(("assistant", unescape(formatted[at:end])))
            at = end + 4
    return out


def _dealt(turns: DataFrame, id_col: str) -> DataFrame:
    source = turns.select(F.col(id_col).alias("id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return source.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", part_chars: int = 4 << 20) -> DataFrame:
    """Formatted conversations in parts: id, part (from 0), n_turns, formatted, and the spans of formatted that are to be learned.

    The parts of a conversation are rows that follow each other.
    """
    kind = turns.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, done, size = compile_steps(template, {"escape": escape}), [], 0
        first = next(batches, None)
        if first is None:
            return
        id_type, span = first.schema.field(0).type, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def batch() -> pa.RecordBatch:
            ids, parts, n, texts, spans = zip(*done)
            return pa.record_batch([pa.array(ids, id_type), pa.array(parts, pa.int32()), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], span)], names=[id_col, "part", "n_turns", "formatted", "learned"])

        rows = (r for b in chain([first], batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        for key, own in groupby(rows, key=lambda r: r[0]):
            out, part, seen = Output(), 0, [0]

            def messages(own: Iterator = own, seen: list[int] = seen) -> Iterator[dict[str, str]]:
                for _, role, text in own:
                    seen[0] += 1
                    yield {"role": role or "", "text": text or ""}

            for _ in render({"messages": messages()}, out):
                if out.size > part_chars:
                    done.append((key, part, seen[0], out.text(), out.spans))
                    size += out.size
                    out.clear()
                    part, seen[0] = part + 1, 0
                    if size > 8 << 20:
                        yield batch()
                        done, size = [], 0
            if out.size or not part:
                done.append((key, part, seen[0], out.text(), out.spans))
                size += out.size
            if len(done) >= 256 or size > 8 << 20:
                yield batch()
                done, size = [], 0
        if done:
            yield batch()

    return _dealt(turns, id_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, part int, n_turns long, formatted string, learned array<struct<start: long, stop: long>>")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of conversations, taken from formatted text and its spans alone.

    The parts of a conversation must follow each other, as ``format_conversations`` makes them; stored ones are sorted by id and
    part within partitions before. Parts in another order are an error.
    """
    kind = formatted.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, expected = [], None, 0
        n, chars, learned_chars, turns, learned = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def batch(id_type: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done)
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for own, part, text, spans in zip(*(b.column(k).to_pylist() for k in range(4))):
                if part == 0:
                    if expected:
                        done.append((key, n, turns.hexdigest(), learned_chars, learned.hexdigest(), chars))
                    key, expected, n, chars, learned_chars, turns, learned = own, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                elif part != expected or own != key:
                    raise ValueError("parts of a conversation must follow each other")
                expected += 1
                for role, said in read_back(text, part == 0):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    plain = unescape(text[s["start"] : s["stop"]])
                    learned.update(plain.encode())
                    learned_chars += len(plain)
                chars += len(text)
            if len(done) > 1000:
                yield batch(id_type)
                done = []
        if expected:
            done.append((key, n, turns.hexdigest(), learned_chars, learned.hexdigest(), chars))
        if done:
            yield batch(id_type)

    return formatted.select(id_col, "part", "formatted", "learned").mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
