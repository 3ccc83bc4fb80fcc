"""Chat formatting checked by a grammar round trip.

The template renders a conversation as ``<s>`` and its turns: a user's text stands between
``[INST]`` and ``[/INST]``, a system text between ``<<SYS>>`` and ``<</SYS>>``, an
assistant's between ``[ANS]`` and ``</s>``, and any other role is named in
``[TURN] role [:] text [/TURN]``. A deterministic parser reads the result back. Where the
turns it recovers differ from the source, the turns that hold control strings are escaped
(a backslash before each) and rendered again, until they are identical.

A backslash run of length k before a control string means k - 1 backslashes and the string
as text, so escaping is reversible whatever a text holds; texts without conflicts are
left alone. Turns stream through sorted by conversation and turn, in pieces of about
PIECE_CHARS, so a conversation of any length is formatted in bounded memory.

Defined results: a null text or role is empty; turns with equal numbers are ordered by role
and text, a null number comes first; repeated rows are repeated turns; a null conv_id is a
conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 18
BEGIN = "<s>"
#: opening and closing strings of a role; other roles use OTHER
ROLES = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[ANS]", "</s>")}
OTHER, NAMED = ("[TURN]", "[/TURN]"), "[:]"
CONTROLS = [BEGIN, NAMED, *OTHER, *(x for pair in ROLES.values() for x in pair)]
_CONTROL = re.compile(r"(\\*)(" + "|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)) + ")")
_OPEN = {pair[0]: (role, pair[1]) for role, pair in ROLES.items()} | {OTHER[0]: (None, OTHER[1])}
FORMATTED = "conv_id long, piece long, n_turns long, text string, loss array<struct<start:long,stop:long>>"
READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class Ungrammatical(ValueError):
    """The text is no sequence of turns."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[1:] if m.group(1) else m.group(), text)


def render(turns: list[tuple[str, str]], escaped: list[bool], begin: bool) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns and, under the loss mask, where the assistant's texts lie."""
    out, at, loss = [], 0, []

    def put(s: str) -> None:
        nonlocal at
        out.append(s)
        at += len(s)
    if begin:
        put(BEGIN)
    for (role, text), quoted in zip(turns, escaped):
        first, last = ROLES.get(role, OTHER)
        put(first + " ")
        if role not in ROLES:
            put((escape(role) if quoted else role) + " " + NAMED + " ")
        start = at
        put(escape(text) if quoted else text)
        if role == "assistant":
            loss.append((start, at))
        put(" " + last)
    return "".join(out), loss


def parse(text: str, begin: bool) -> list[tuple[str, str]]:
    """The turns of a rendered text: one pass over its unescaped control strings."""
    marks = [(m.group(2), m.start(2), m.end(2)) for m in _CONTROL.finditer(text) if not m.group(1)]
    turns, at, i = [], 0, 0

    def expect(want: str) -> tuple[int, int]:
        nonlocal i
        if i >= len(marks) or marks[i][0] != want:
            raise Ungrammatical(f"{want} expected")
        i += 1
        return marks[i - 1][1], marks[i - 1][2]

    def content(start: int, stop: int) -> str:
        if stop - start < 2 or text[start] != " " or text[stop - 1] != " ":
            raise Ungrammatical("a space expected")
        return unescape(text[start + 1:stop - 1])
    if begin:
        start, at = expect(BEGIN)
        if start:
            raise Ungrammatical("text before the beginning")
    while i < len(marks):
        kind, start, stop = marks[i]
        if kind not in _OPEN or start != at:
            raise Ungrammatical("a turn expected")
        role, closing = _OPEN[kind]
        i += 1
        if role is None:
            name_end, name_stop = expect(NAMED)
            role, stop = content(stop, name_end), name_stop
        end, at = expect(closing)
        turns.append((role, content(stop, end)))
    if at != len(text):
        raise Ungrammatical("text after the last turn")
    return turns


def format_turns(turns: list[tuple[str, str]], begin: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """Renders, reparses and compares; escapes what conflicts until the turns come back identical."""
    escaped = [False] * len(turns)
    while True:
        text, loss = render(turns, escaped, begin)
        try:
            back = parse(text, begin)
        except Ungrammatical:
            back = None
        if back == turns:
            return text, loss
        if back is None or len(back) != len(turns):
            conflict = [not e and bool(_CONTROL.search(t) or _CONTROL.search(r)) for (r, t), e in zip(turns, escaped)]
        else:
            conflict = [not e and a != b for a, b, e in zip(turns, back, escaped)]
        if not any(conflict):
            raise Ungrammatical("the template cannot hold these turns")
        escaped = [e or c for e, c in zip(escaped, conflict)]


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per piece of a conversation (nearly always one): conv_id, piece, n_turns, text and
    loss, the spans of the piece's text (in code points) that hold assistants' texts."""
    turns = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        import pyarrow as pa
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        ready, conv, piece, held, size = [], (), 0, [], 0

        def flush():
            text, loss = format_turns(held, begin=piece == 0)
            ready.append((conv[0], piece, len(held), text, [{"start": a, "stop": b} for a, b in loss]))
        for batch in batches:
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if conv != (c,):
                    if held:
                        flush()
                    conv, piece, held, size = (c,), 0, [], 0
                elif size >= PIECE_CHARS:
                    flush()
                    piece, held, size = piece + 1, [], 0
                held.append((role, text))
                size += len(text)
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*ready), types)],
                                                 names=["conv_id", "piece", "n_turns", "text", "loss"])
                ready.clear()
        if held:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*ready), types)],
                                             names=["conv_id", "piece", "n_turns", "text", "loss"])
    return turns.mapInArrow(run, FORMATTED)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: its turns' and its loss mask's digests and sizes.
    Pieces stream through in order; digests are carried along, texts are not."""
    pieces = formatted.select("conv_id", "piece", "text", "loss")
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches):
        import pyarrow as pa
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in READ_BACK.split(", ")]
        ready, conv, state = [], (), None

        def close():
            n, turns, chars, loss, total = state
            ready.append((conv[0], n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*ready), types)], names=names)
            ready.clear()
            return made
        for batch in batches:
            for c, piece, text, spans in zip(*(x.to_pylist() for x in batch.columns)):
                if conv != (c,):
                    if state is not None:
                        close()
                    conv, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text, begin=piece == 0):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8"))
                for span in spans:
                    said = unescape(text[span["start"]:span["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8"))
                state[4] += len(text)
            if ready:
                yield out()
        if state is not None:
            close()
            yield out()
    return pieces.mapInArrow(run, READ_BACK)
