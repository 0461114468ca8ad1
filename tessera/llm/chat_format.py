"""Chat formatting (2): a template whose output a deterministic grammar reads back.

    conversation = turn*
    turn         = START role NEWLINE body END NEWLINE
    role         = text without newline; body = text; neither holds a control string

A turn is rendered as it is and parsed; if the parser's turn is not the source's, or it finds
a control string inside, the content is escaped and rendered again until they are identical.
An escaped control string has one more backslash after its first character; the parser
takes one away from every one that has any. So texts without control strings are never
touched, and escaping is reversible at any depth.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, and others that tokenizers treat as special.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = ("im_start", "im_end", "endoftext", "startoftext")

_BARE = re.compile(r"<(\\*)\|(" + "|".join(CONTROL) + r")\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(" + "|".join(CONTROL) + r")\|>")
_ROLE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _BARE.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class GrammarError(ValueError):
    pass


def parse_turn(text: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """Role, body, where the body stands in ``text``, and where the turn ends."""
    if not text.startswith(START, at):
        raise GrammarError(f"no turn at {at}")
    line = text.find("\n", at)
    stop = _control(text, line + 1)
    if line < 0 or stop is None or not text.startswith(END + "\n", stop):
        raise GrammarError(f"the turn at {at} has no end")
    role = text[at + len(START) : line]
    if _control(role, 0) is not None:
        raise GrammarError(f"a control string in the role at {at}")
    return _unescape_role(role), unescape(text[line + 1 : stop]), (line + 1, stop), stop + len(END) + 1


def _control(text: str, at: int) -> int | None:
    """Where the next control string without backslashes starts."""
    for m in _BARE.finditer(text, at):
        if not m[1]:
            return m.start()
    return None


def parse(text: str) -> list[tuple[str, str, tuple[int, int]]]:
    """All turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        role, body, span, at = parse_turn(text, at)
        out.append((role, body, span))
    return out


class Reader:
    """Reads a formatted conversation from pieces of any size: what it knows of turns and spans is from the text alone.

    ``feed`` returns the turns that are complete: role, body, and where the body stands in the
    whole text. Only the turn that is not complete is held.
    """

    def __init__(self):
        self.held, self.at, self.scanned = "", 0, 0

    def feed(self, piece: str) -> list[tuple[str, str, tuple[int, int]]]:
        self.held += piece
        out, begin = [], 0
        while True:
            # In a body the string is escaped, so the first one with a newline ends the turn.
            stop = self.held.find(END + "\n", max(begin, self.scanned))
            if stop < 0:
                break
            role, body, (a, b), end = parse_turn(self.held, begin)
            if end != stop + len(END) + 1:
                raise GrammarError(f"the turn at {self.at + begin} has no end")
            out.append((role, body, (self.at + a, self.at + b)))
            begin = end
            self.scanned = end
        self.held, self.at = self.held[begin:], self.at + begin
        self.scanned = max(0, len(self.held) - len(END))
        return out

    def close(self) -> int:
        """How long the conversation was; text after the last turn is an error."""
        if self.held:
            raise GrammarError(f"the turn at {self.at} has no end")
        return self.at


def _reads_back(segment: str, role: str, text: str) -> bool:
    try:
        got_role, got_text, _, stop = parse_turn(segment)
    except GrammarError:
        return False
    return (got_role, got_text, stop) == (role, text, len(segment))


def render_turn(role: str, text: str) -> str:
    """The turn as the template has it; what conflicts with the grammar is escaped until it reads back."""
    shown_role, shown = role, text
    for _ in range(3):
        segment = f"{START}{shown_role}\n{shown}{END}\n"
        if _reads_back(segment, role, text):
            return segment
        if not _reads_back(f"{START}\n{shown}{END}\n", "", text):
            shown = escape(text)
        if not _reads_back(f"{START}{shown_role}\n{END}\n", role, ""):
            shown_role = _escape_role(role)
    raise GrammarError(f"cannot be rendered: {role!r}")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn -> one segment a row."""
    conv, place, begun = None, 0, False
    for batch in batches:
        places, segments, starts, stops = [], [], [], []
        for c, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if not begun or c != conv:
                conv, place, begun = c, 0, True
            segment = render_turn(role, text)
            places.append(place)
            segments.append(segment)
            loss = parse_turn(segment)[2] if role == LOSS_ROLE else (None, None)
            starts.append(loss[0])
            stops.append(loss[1])
            place += 1
        yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(places, pa.int64()), pa.array(segments, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["conv_id", "place", "segment", "loss_start", "loss_stop"])


LOSS_ROLE = "assistant"


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments in order: conv_id, place, segment, loss_start, loss_stop (of an assistant's body in its segment).

    A conversation is its segments joined. Its rows are dealt by conv_id and streamed in
    order, so a task holds one batch however long a conversation is. Defined cases: a null
    text or role counts as empty; null conv_ids are one conversation; a null turn comes
    first; equal turns are ordered by role and text; repeated rows are turns of their own;
    texts and conversations may be of any length; an empty table gives an empty table; other
    columns are not read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, "conv_id long, place long, segment string, loss_start long, loss_stop long")


def whole_conversations(segments: DataFrame) -> DataFrame:
    """conv_id and formatted: the segments of each conversation joined.

    For conversations that fit a row; null conv_ids are one conversation, an empty table gives
    an empty table.
    """
    parts = F.array_sort(F.collect_list(F.struct("place", "segment")))
    return segments.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda x: x["segment"])).alias("formatted"))


def loss_text(formatted: str) -> str:
    """What a formatted conversation trains on, unescaped: each assistant text once, in order."""
    return "".join(unescape(formatted[a:b]) for role, _, (a, b) in parse(formatted) if role == LOSS_ROLE)


class _Tally:
    """Digests of what the reader finds in one conversation."""

    def __init__(self, conv):
        self.conv, self.reader, self.turns, self.loss_chars = conv, Reader(), 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, mask: tuple[int, int] | None) -> None:
        begin, spans = self.reader.at + len(self.reader.held), []
        for role, body, (a, b) in self.reader.feed(segment):
            self.turns += 1
            self.all.update(f"{role}\n{body}\n".encode())
            if role == LOSS_ROLE:
                spans.append((a - begin, b - begin))
                self.loss_chars += len(body)
                self.loss.update(body.encode())
        if spans != ([mask] if mask else []):
            raise GrammarError(f"conversation {self.conv}: the loss mask {mask} is not what the text says: {spans}")

    def row(self) -> tuple:
        chars = self.reader.close()
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), chars


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    tally = None
    for batch in batches:
        done = []
        for conv, segment, start, stop in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_stop")), strict=True):
            if tally is None or conv != tally.conv:
                if tally is not None:
                    done.append(tally.row())
                tally = _Tally(conv)
            tally.feed(segment, None if start is None else (start, stop))
        yield _rows(done, names, types)
    if tally is not None:
        yield _rows([tally.row()], names, types)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation of what the grammar reads from the text of its segments, joined in the order of ``format_turns``.

    Roles, texts, turn bounds and loss spans all come from the text; a loss mask that differs
    from the spans found, and text that the grammar does not read, are a GrammarError. An empty
    table gives an empty table.
    """
    return segments.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
