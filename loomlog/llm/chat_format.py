"""Chat formatting from an event log.

A conversation is stored as events: a message, the streamed deltas of a message, an edit
that replaces it, a regeneration that starts it anew, or a deletion. Logs are partitioned
by conversation and sorted by turn, message and sequence number; one pass folds the events
of a message into its final form and renders it, so a task holds one message at a time,
however long its conversation is. Two streams within a turn are told apart by their message.

A turn is rendered as ``### role: text </turn>`` and a newline. Inside role and text a
backslash goes before each backslash, each ``#``, each ``</turn>`` and, in roles, each
colon; ``read_back`` undoes this.

Defined cases: null texts are empty; null roles are empty roles; events with equal turn
and sequence keep a fixed order (kind, role, text); a log without message numbers has one
stream a turn, in which every ``message`` event begins another message; deltas without a
message before them begin one; repeated rows are messages of their own; a null conversation id is a
conversation of its own; other columns are ignored; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
_SPECIAL = re.compile(r"\\|#|</turn>")
_SPECIAL_ROLE = re.compile(r"\\|#|</turn>|:")
_MARK = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_SPECIAL_ROLE if role else _SPECIAL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _MARK.sub(r"\1", text)


def render_turn(role: str, text: str) -> str:
    return f"{START}{escape(role, True)}{MIDDLE}{escape(text)}{END}"


def _plain(text: str, what: str, at: int) -> int:
    """Where `what` next stands without a backslash of its own before it."""
    while (i := text.index(what, at)) >= 0:
        j = i
        while j > 0 and text[j - 1] == "\\":
            j -= 1
        if (i - j) % 2 == 0:
            return i
        at = i + 1
    return -1


def read_back(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a rendered conversation; start and end bound the escaped text."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        colon = _plain(rendered, MIDDLE, at + len(START))
        begin = colon + len(MIDDLE)
        # END begins with a blank, which is never escaped; its < must not be
        end = begin
        while True:
            end = rendered.index(END, end)
            if rendered[end + 1] == "<":
                break
            end += 1
        yield unescape(rendered[at + len(START) : colon]), unescape(rendered[begin:end]), begin, end
        at = end + len(END)


EVENTS = ("conv_id", "turn", "message", "seq", "kind", "role", "text")
#: Characters of a streamed piece.
PIECE = 256
TURNS = "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long"
_TURNS_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def events_of(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """A plain (conv_id, turn, role, text) table as the log that it came from: an assistant's row is an empty message and its text
    streamed in deltas, any other row one message. Rows of one turn are numbered by role and text."""
    text, streamed = F.coalesce("text", F.lit("")), F.col("role") == LOSS_ROLE
    w = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), text)
    rows = conversations.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("message"), "role", "text")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(piece)))
    deltas = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.struct(F.lit("delta").alias("kind"), F.substring(text, i, F.lit(piece)).alias("text")))
    whole = lambda x: F.array(F.struct(F.lit("message").alias("kind"), x.alias("text")))
    made = F.when(streamed, F.concat(whole(F.lit("")), deltas)).otherwise(whole(text))
    return rows.select("conv_id", "turn", "message", "role", F.posexplode(made).alias("seq", "e")).select("conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), "e.kind", "role", "e.text")


def ordered(events: DataFrame) -> DataFrame:
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "message" not in events.columns:
        events = events.withColumn("message", F.lit(0).cast("long"))
    return events.select(*EVENTS).repartition(n, "conv_id").sortWithinPartitions(*EVENTS)


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted events -> (conv_id, turn, role, text) of final messages, in order."""
    at, role, pieces = None, "", None
    for conv, turn, message, _, kind, who, text in rows:
        text = text or ""
        if (conv, turn, message) != at or kind == "message":
            if pieces is not None:
                yield (*at[:2], role, "".join(pieces))
            at, role, pieces = (conv, turn, message), who or "", None
        if kind in ("message", "edit", "regenerate"):
            pieces, role = [text], who or role
        elif kind == "delta":
            pieces = pieces or []
            pieces.append(text)
            role = role or who or ""
        elif kind == "delete":
            pieces = None
    if pieces is not None:
        yield (*at[:2], role, "".join(pieces))


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in EVENTS), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20):
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 100 + sum(len(x) for x in row if isinstance(x, str))
        if weight >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def render(events: DataFrame) -> DataFrame:
    """Final messages with their rendered form; a conversation is its ``rendered`` joined by turn.

    loss_start and loss_end bound the trained text inside ``rendered`` (code points; null for other roles).
    """

    def run(batches):
        def rows():
            for conv, turn, role, text in fold(_rows(batches)):
                out = render_turn(role, text)
                lo = len(START) + len(escape(role, True)) + len(MIDDLE)
                mask = (lo, len(out) - len(END)) if role == LOSS_ROLE else (None, None)
                yield (conv, turn, role, text, out, *mask)

        yield from _batches(rows(), _TURNS_ARROW)

    return ordered(events).mapInArrow(run, TURNS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(events: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered turns as they pass."""

    def run(batches):
        def rows():
            at, state = None, None

            def done():
                n, turns, chars, loss, size = state
                return (at[0], n, turns.hexdigest(), chars, loss.hexdigest(), size)

            for conv, _, role, text in fold(_rows(batches)):
                if at != (conv,):
                    if at:
                        yield done()
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                out = render_turn(role, text)
                for who, said, lo, hi in read_back(out):
                    state[0] += 1
                    state[1].update(f"{who}\n{said}\n".encode())
                    if who == LOSS_ROLE:
                        trained = unescape(out[lo:hi])
                        state[2] += len(trained)
                        state[3].update(trained.encode())
                state[4] += len(out)
            if at:
                yield done()

        yield from _batches(rows(), _DIGEST_ARROW)

    return ordered(events).mapInArrow(run, DIGEST)
