"""Chat formatting with a grammar that is read back and compared.

A conversation is a run of turns ``<s> role [INST] text [/INST]</s>``. The four control strings
never occur inside a role or text: where reading a turn back does not give its source, the
conflicting strings get a backslash after their first character (one more if they already have
some), which the parser takes off again. The loss mask covers the text fields of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
BEGIN, MIDDLE, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED_ROLE = "assistant"

_CONTROL = re.compile(r"</?s>|\[/?INST\]")
_ESCAPABLE = re.compile(r"<(?=\\*/?s>)|\[(?=\\*/?INST\])")
_ESCAPED = re.compile(r"([<])\\(?=\\*/?s>)|(\[)\\(?=\\*/?INST\])")
_LONGEST = max(map(len, (BEGIN, MIDDLE, CLOSE, END)))


def escape(field: str) -> str:
    return _ESCAPABLE.sub(lambda m: m.group() + "\\", field)


def unescape(field: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1) or m.group(2), field)


class Parser:
    """Reads turns from a rendered conversation, given in pieces of any size."""

    def __init__(self) -> None:
        self._rest, self._want, self._fields = "", [BEGIN], []

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Turns that are complete after this piece."""
        text = self._rest + piece
        at = 0
        for found in _CONTROL.finditer(text):
            expected = {0: BEGIN, 1: MIDDLE, 2: CLOSE, 3: END}[len(self._fields)]
            between = text[at : found.start()]
            if found.group() != expected or (expected in (BEGIN, END) and between):
                raise ValueError(f"{found.group()} where {expected} was due")
            at = found.end()
            self._fields.append(between)
            if expected == END:
                _, role, body, _ = self._fields
                self._fields = []
                yield unescape(role), unescape(body)
        self._rest = text[at:]

    def finish(self) -> None:
        if self._rest or self._fields:
            raise ValueError("the last turn is cut off")


def render(role: str, text: str) -> str:
    return f"{BEGIN}{role}{MIDDLE}{text}{CLOSE}{END}"


def _reads_back(piece: str, role: str, text: str) -> bool:
    parser = Parser()
    try:
        turns = list(parser.feed(piece))
        parser.finish()
    except ValueError:
        return False
    return turns == [(role, text)]


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """Rendered turn and the bounds of its text in it; conflicts are escaped until it reads back."""
    fields = role, text
    while not _reads_back(piece := render(*fields), role, text):
        fields = escape(fields[0]), escape(fields[1])
    start = len(BEGIN) + len(fields[0]) + len(MIDDLE)
    return piece, start, start + len(fields[1])


FORMATTED = "conv_id long, seq long, piece string, start long, loss_start long, loss_end long"


def format_chats(turns: DataFrame) -> DataFrame:
    """One rendered piece per turn, in order within each conversation.

    ``piece`` strings joined by ``seq`` are the formatted conversation; ``start`` is where the
    piece begins in it, ``loss_start`` and ``loss_end`` bound the trained text (null: none), all
    in code points. Rows are ordered by turn, then role, then text; null turns come first, null
    roles and texts are empty, rows without a conversation id form one conversation, repeated
    rows are turns of their own. A conversation is streamed through one task in order and never
    held whole, so a very long one costs time but no memory.
    """
    ordered = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, seq, at = none, 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for c, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, seq, at = c, 0, 0
                piece, low, high = format_turn(role, text)
                trained = role == TRAINED_ROLE
                loss = (at + low, at + high) if trained else (None, None)
                for column, value in zip(out, (c, seq, piece, at, *loss)):
                    column.append(value)
                seq, at = seq + 1, at + len(piece)
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3]
            names = [part.split()[0] for part in FORMATTED.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds)], names=names
            )

    return ordered.mapInArrow(run, FORMATTED)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and trained text, parsed from the pieces of ``format_chats``.

    Expects the pieces in the order and partitions in which ``format_chats`` gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, state = none, None
        done: list[tuple] = []

        def close() -> None:
            parser, turns, loss, figures = state
            parser.finish()
            done.append(
                (conv, figures[0], turns.hexdigest(), figures[1], loss.hexdigest(), figures[2])
            )

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [part.split()[0] for part in DIGESTS.split(", ")]
            columns = zip(*done) if done else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(x), k) for x, k in zip(columns, kinds)], names=names
            )

        for batch in batches:
            for c, piece in zip(batch["conv_id"].to_pylist(), batch["piece"].to_pylist()):
                if c != conv:
                    if state:
                        close()
                    conv, state = c, (Parser(), hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
                parser, turns, loss, figures = state
                figures[2] += len(piece)
                for role, text in parser.feed(piece):
                    figures[0] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == TRAINED_ROLE:
                        figures[1] += len(text)
                        loss.update(text.encode())
            yield flush()
            done.clear()
        if state:
            close()
            yield flush()

    return formatted.mapInArrow(run, DIGESTS)
