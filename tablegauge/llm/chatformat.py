"""Chat formatting by a grammar round trip.

The template: a user turn is `[INST] text [/INST]`, a system turn `[SYS] text [/SYS]`, an
assistant turn ` text</s>`, and a turn of any other role `[ROLE] role [/ROLE] text</s>`. The
parser is deterministic: what comes next decides the kind of turn, and a text ends at the next
control string, whatever that is.

Rows are rendered as they are and parsed again. Where the turns found differ from the turns
given, the texts that conflict are escaped, rendered and parsed anew, until both are identical.
Escaping puts a backslash behind the first character of every control string in the text, and
one more where there are some; reading takes one away.

Rows are dealt into ranges of (conversation, turn), so a conversation with many rows goes to
many tasks, and are packed into parts of bounded size in order. A part holds whole turns and is
parsed alone. Conversations of one part are read where they are; the parts of the others are
brought together in order and read as a stream, whatever their number. Tasks hold one part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import whole, written

# control strings, with backslashes as escaped ones have them
CONTROL = r"<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE)\]"
_CONTROL = re.compile(CONTROL)
_BARE = re.compile(r"</?s>|\[/?(?:INST|SYS|ROLE)\]")
# opening and closing of the roles that have their own
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}
TRAINED = "assistant"
# characters of text after which a part is closed
PART_CHARS = 1 << 20

Turn = tuple[str, str]


class NotInGrammar(ValueError):
    """The text is not what the template gives."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(what stands for the turn, start and end of the text in it)."""
    before, after = MARKS.get(role) or (f"[ROLE] {escape(role)} [/ROLE] ", "</s>")
    return before + text + after, len(before), len(before) + len(text)


def _content(text: str, at: int, closing: str) -> tuple[str, int]:
    """(the text from `at` up to the next control string, which must be `closing`, the place after it)."""
    m = _BARE.search(text, at)
    gap = len(closing) - len(closing.lstrip())
    if m is None or m[0] != closing[gap:] or m.start() - gap < at or text[m.start() - gap : m.start()] != closing[:gap]:
        raise NotInGrammar(f"no {closing!r} after place {at}")
    return unescape(text[at : m.start() - gap]), m.end()


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of a part; the text unescaped, its place as it stands."""
    at = 0
    while at < len(text):
        for role, (before, after) in MARKS.items():
            if text.startswith(before, at):
                start = at + len(before)
                break
        else:
            if not text.startswith("[ROLE] ", at):
                raise NotInGrammar(f"no turn starts at place {at}")
            role, start = _content(text, at + len("[ROLE] "), " [/ROLE]")
            if role in MARKS or text[start : start + 1] != " ":
                raise NotInGrammar(f"no turn starts at place {at}")
            start, after = start + 1, "</s>"
        found, at = _content(text, start, after)
        yield role, found, start, at - len(after)


def _recovers(turns: list[Turn], escaped: list[bool]) -> bool:
    pieces = (render_turn(role, escape(text) if e else text)[0] for (role, text), e in zip(turns, escaped))
    try:
        return [t[:2] for t in parse("".join(pieces))] == turns
    except NotInGrammar:
        return False


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """(the turns as text, the places of the trained texts in it).

    Escapes the texts that keep the rendered text from being read back, and no others.
    """
    escaped = [False] * len(turns)
    while not _recovers(turns, escaped):
        conflicting = [not e and not _recovers([t], [e]) for t, e in zip(turns, escaped)]
        if not any(conflicting):  # no text conflicts alone: all that are left give way
            conflicting = [not e for e in escaped]
        if not any(conflicting):
            raise NotInGrammar("escaped turns can't be read back")
        escaped = [e or c for e, c in zip(escaped, conflicting)]
    pieces, places, at = [], [], 0
    for (role, text), e in zip(turns, escaped):
        piece, start, end = render_turn(role, escape(text) if e else text)
        if role == TRAINED:
            places.append((at + start, at + end))
        pieces.append(piece)
        at += len(piece)
    return "".join(pieces), places


LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pack(limit: int) -> Callable:
    """Rows in order to parts; `alone` says that the conversation is this part and no other.

    The first and the last conversation of a task may go on in other tasks, so they are not alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = conv = task = None
        turns: list[Turn] = []
        size = number = 0
        inside = fresh = False  # not the task's first conversation; no part of this conversation yet

        def part(alone: bool) -> pa.RecordBatch:
            nonlocal number, turns, size, fresh
            text, places = render(turns)
            loss = pa.array([[{"start": a, "end": b} for a, b in places]], LOSS)
            columns = [pa.array([conv], kind), pa.array([(task << 33) + number], pa.int64()), pa.array([alone]), pa.array([text]), loss]
            number, turns, size, fresh = number + 1, [], 0, False
            return pa.RecordBatch.from_arrays(columns, names=["conv", "part", "alone", "text", "loss"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for own, row_task, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "task", "role", "text"))):
                if task is None:
                    conv, task = own, row_task
                elif own != conv:
                    yield part(inside and fresh)
                    conv, inside, fresh = own, True, True
                elif size >= limit:
                    yield part(False)
                turns.append((role, text))
                size += len(text)
        if turns:
            yield part(False)

    return run


def format_chats(
    chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS,
) -> DataFrame:
    """The formatted conversations in parts: conv, part, alone, text, loss.

    The texts of a conversation's parts, by part, make its text; `loss` are the places of the
    assistant texts in a part's text, in code points, end exclusive. Rows come by turn, null
    first, then by role and text; null roles and texts are read as empty. Rows without a
    conversation are one conversation. Repeated rows are turns of their own. An empty table
    gives no parts; other columns are left out, whatever their names. Rows with the same turn of
    one conversation meet in one task, other rows of it don't have to.
    """
    kind = chats.schema[conv].dataType.simpleString()
    rows = chats.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), whole(f"`{role}`").alias("role"), whole(f"`{text}`").alias("text"))
    dealt = rows.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    ordered = dealt.select("conv", F.spark_partition_id().cast("long").alias("task"), "role", "text")
    schema = f"conv {kind}, part long, alone boolean, text string, loss array<struct<start:int,end:int>>"
    return written(ordered.mapInArrow(_pack(part_chars), schema), "chats")


DIGESTS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order to one row per conversation."""
    for conv, kind, parts in _conversations(batches):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        for text, places in parts:
            for role, said, _, _ in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for place in places:
                trained = unescape(text[place["start"] : place["end"]])
                loss.update(trained.encode())
                loss_chars += len(trained)
            chars += len(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([loss_chars], pa.int64()),
             pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())], names=["conv", *DIGESTS])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its type, its parts as they come) for parts in order."""
    rows = (
        (own, batch.schema.field("conv").type, (text, places))
        for batch in batches
        for own, text, places in zip(*(batch.column(c).to_pylist() for c in ("conv", "text", "loss")))
    )
    for _, group in groupby(rows, key=lambda row: (row[0] is None, row[0])):
        first = next(group)
        yield first[0], first[1], chain([first[2]], (row[2] for row in group))


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation of `format_chats`, read back: conv, n_turns, turns_sha256 (of role, line
    end, text, line end per turn), loss_chars and loss_sha256 (of all text at the loss places,
    unescaped), formatted_chars.

    A conversation of several parts is read by one task, part by part, since its digests are
    those of one long text.
    """
    kind = parts.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = ["conv", "text", "loss"]
    several = parts.where("not alone").repartition("conv").sortWithinPartitions("conv", "part").select(*read)
    return parts.where("alone").select(*read).mapInArrow(_digest, schema).unionByName(several.mapInArrow(_digest, schema))
