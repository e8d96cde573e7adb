"""Chat formatting from event logs: fold, render, write, read back.

A log has one row per event: conv_id, seq, turn, kind, role, text. Kinds:

* ``open``: message ``turn`` begins with ``role`` and ``text``; it and all later
  turns known so far are gone (a resent or rewritten turn starts a new branch).
* ``delta``: ``text`` is appended to the message.
* ``edit``: ``text`` replaces the message's text; later turns stay.
* ``regenerate``: the message is emptied, all later turns are gone.

The log is partitioned by ranges of (conv_id, seq) and sorted, so a conversation
lies in one task unless it crosses the end of a range or holds more than
``HELD`` characters; a hot one lies in many. Each task folds its events in order.
What a stretch of events does to the messages before it is small (from which
turn on they are gone), so the conversations that cross are put together from
their stretches by (conv_id, turn), and no task needs a whole one.

Rendering: ``### role:``, the text, ``</turn>``. In texts a backslash, a ``#``
that two more follow and a ``<`` that begins ``</turn>`` get a backslash before
them, in roles line breaks too; so control strings stand only where the template
puts them, and taking the backslashes away gives the text back. The loss mask
marks the assistant's texts, as character ranges.

Files hold rows of whole turns: conv_id, row_no (the row's first turn), whole
(the only row of its conversation), formatted, loss (start, stop, start, ...).

Rules for odd input: events without turn or of another kind do nothing, nor do
deltas and edits of messages that don't exist; a regenerate of a missing message
still removes later turns; a null role or text is ''; a null seq comes first;
events alike in seq go by turn, kind, role, text; events alike in all columns
count once (a log may be delivered twice); null conv_ids are one conversation;
a conversation without messages has no row; an empty log gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seekrank.llm import common
from seekrank.operators.numbering import dense_ids

#: Characters of messages that a folding task holds; a conversation with more is cut into stretches.
HELD = 8 << 20
#: Characters of one written row, about: a conversation with more has several rows.
ROW_CHARS = 4 << 20
LEARNED = "assistant"
_LOG = ("conv_id", "seq", "turn", "kind", "role", "text")
_ROWS = "conv_id long, row_no long, whole boolean, formatted string, loss array<long>"
_PARTS = "turn long, chunk long, opened boolean, fresh boolean, role string, text string, cut long"
_END = "</turn>\n"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TEXT_STOP = re.compile(r"\\.|</turn>\n", re.DOTALL)
_ROLE_STOP = re.compile(r"\\.|\n", re.DOTALL)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass
class Message:
    opened: bool  # its beginning lies in this stretch
    fresh: bool  # nothing of its text before this stretch stays
    role: str | None
    parts: list[str] = field(default_factory=list)


class Stretch:
    """Events of one conversation, folded in order."""

    def __init__(self):
        self.messages: dict[int, Message] = {}
        self.turns: list[int] = []  # sorted
        self.cut: int | None = None  # messages from before this stretch are gone from this turn on
        self.held = 0

    def _drop(self, turn: int) -> None:
        at = bisect.bisect_left(self.turns, turn)
        for t in self.turns[at:]:
            self.held -= sum(map(len, self.messages.pop(t).parts))
        del self.turns[at:]
        self.cut = turn if self.cut is None else min(self.cut, turn)

    def _put(self, turn: int, message: Message) -> Message:
        bisect.insort(self.turns, turn)
        self.messages[turn] = message
        return message

    def take(self, turn: int | None, kind: str | None, role: str | None, text: str | None) -> None:
        if turn is None:
            return
        if kind == "open":
            self._drop(turn)
            self._put(turn, Message(True, True, role or "", [text or ""]))
            self.held += len(text or "")
        elif kind in ("delta", "edit", "regenerate"):
            message = self.messages.get(turn)
            gone = message is None and self.cut is not None and turn >= self.cut
            if kind == "regenerate":
                self._drop(turn + 1)
            if gone:
                return
            message = message or self._put(turn, Message(False, False, None))
            if kind != "delta":
                self.held -= sum(map(len, message.parts))
                message.fresh, message.parts = True, []
            if kind != "regenerate" and text:
                message.parts.append(text)
                self.held += len(text)


def render(turns: Iterator[tuple[int, str, str]]) -> Iterator[tuple[int, str, list[int]]]:
    """Rows (first turn, formatted text, loss ranges) of messages (turn, role, text) in order."""
    first, out, loss, at = None, [], [], 0
    for turn, role, text in turns:
        if out and at >= ROW_CHARS:
            yield first, "".join(out), loss
            first, out, loss, at = None, [], [], 0
        first = turn if first is None else first
        head, body = f"### {escape(role, _ROLE_CONTROL)}:\n", escape(text)
        if role == LEARNED:
            loss += [at + len(head), at + len(head) + len(body)]
        out += [head, body, _END]
        at += len(head) + len(body) + len(_END)
    if out:
        yield first, "".join(out), loss


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Messages (role, text) of a formatted row."""
    at = 0
    while at < len(formatted):
        stop = next(m for m in _ROLE_STOP.finditer(formatted, at + 4) if m[0] == "\n")
        end = next(m for m in _TEXT_STOP.finditer(formatted, stop.end()) if m[0] == _END)
        yield unescape(formatted[at + 4:stop.start() - 1]), unescape(formatted[stop.end():end.start()])
        at = end.end()


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    names = [f.split(" ", 1) for f in fields.split(", ")]
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), names)], [n for n, _ in names])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered rows of conversations that lie inside this task; states of stretches of those that may cross its ends."""
    chunk, conv, now, before = TaskContext.get().partitionId() << 24, None, None, None
    edge, out, size = True, [], 0  # the first conversation may have begun in the range before

    def close(crosses: bool) -> Iterator[tuple]:
        own = [(t, now.messages[t]) for t in now.turns]
        if crosses:
            yield (conv, None, False, None, None, None, chunk, None, None, None, None, now.cut)
            for t, m in own:
                yield (conv, None, False, None, None, t, chunk, m.opened, m.fresh, m.role, "".join(m.parts), now.cut)
        else:
            rows = list(render((t, m.role, "".join(m.parts)) for t, m in own if m.opened))
            for first, text, loss in rows:
                yield (conv, first, len(rows) == 1, text, loss, *[None] * 7)

    for b in batches:
        for event in zip(*(b.column(c).to_pylist() for c in _LOG)):
            if now is None or event[0] != conv:
                if now is not None:
                    out += close(edge)
                    edge = False
                conv, now, chunk = event[0], Stretch(), chunk + 1
            elif event == before:
                continue
            elif now.held > HELD:
                out += close(True)
                size += now.held
                now, chunk, edge = Stretch(), chunk + 1, True
            before = event
            now.take(*event[2:])
            if len(out) >= 2000 or size > HELD:
                yield _batch(out, f"{_ROWS}, {_PARTS}")
                out, size = [], 0
    if now is not None:
        out += close(True)  # the last one may go on in the next range
    if out:
        yield _batch(out, f"{_ROWS}, {_PARTS}")


def _merge(folded: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) of the conversations that cross ranges."""
    parts = folded.filter("chunk is not null")
    later = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a few rows per range
    cuts = parts.filter("turn is null").select("conv_id", "chunk", F.min("cut").over(later).alias("later_cut"))
    rows = parts.filter("turn is not null").alias("p").join(
        cuts.alias("c"), F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("p.chunk") == F.col("c.chunk")))
    alive = rows.filter("later_cut is null or turn < later_cut").select("p.*")
    own = alive.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("chunk", "opened", "fresh", "role", "text"))).alias("x"))
    from_chunk = F.array_max(F.transform(F.filter("x", lambda p: p["fresh"]), lambda p: p["chunk"]))
    return own.withColumns({"role": F.filter("x", lambda p: p["opened"]), "since": from_chunk}).filter(F.size("role") > 0).select(
        "conv_id", "turn", F.col("role")[0]["role"].alias("role"),
        F.array_join(F.transform(F.filter("x", lambda p: p["chunk"] >= F.col("since")), lambda p: p["text"]), "").alias("text"))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted messages; a conversation may go on in the next task, so none is marked whole."""
    conv, own, size = None, [], 0
    for b in batches:
        for c, *message in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text"))):
            if own and (c != conv or size >= ROW_CHARS):
                yield _batch([(conv, first, False, text, loss) for first, text, loss in render(own)], _ROWS)
                own, size = [], 0
            conv, size = c, size + len(message[2])
            own.append(message)
    if own:
        yield _batch([(conv, first, False, text, loss) for first, text, loss in render(own)], _ROWS)


def write_chats(log: DataFrame, path: str) -> None:
    """Fold and render the log; rows of whole turns into the folder ``path``."""
    n = common.partitions(log.sparkSession)
    rows = (log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"),
                       F.col("turn").cast("long").alias("turn"), "kind", "role", "text")
            .repartitionByRange(n, "conv_id", "seq").sortWithinPartitions(*_LOG))
    folded = common.staged(rows.mapInArrow(_fold, f"{_ROWS}, {_PARTS}"), "folded")
    crossing = _merge(folded).repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").mapInArrow(_render, _ROWS)
    names = [f.split(" ")[0] for f in _ROWS.split(", ")]
    folded.filter("chunk is null").select(*names).unionByName(crossing).write.parquet(path)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose rows come one after the other; each row is read and let go."""
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    conv, state = None, None

    def row():
        n, turns, chars, loss, size = state
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)
    for b in batches:
        out = []
        for c, text, loss in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss"))):
            if state is None or c != conv:
                if state is not None:
                    out.append(row())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for start, stop in zip(loss[::2], loss[1::2]):
                said = unescape(text[start:stop])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if out:
            yield _batch(out, fields)
    if state is not None:
        yield _batch([row()], fields)


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, from written rows: turns, their digest, the text under the loss mask, formatted length.

    Conversations of one row are a map; the few others are sorted and read row
    by row, as a running digest has to be.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    cols = ("conv_id", "formatted", "loss")
    several = rows.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "row_no").select(*cols)
    return rows.filter("whole").select(*cols).mapInArrow(_digest, schema).unionByName(several.mapInArrow(_digest, schema))


def as_log(conversations: DataFrame) -> DataFrame:
    """A log whose fold is the given rows (conv_id, turn, role, text), each a message in the order of its turn.

    The messages arrive in three deltas; of every four one is streamed straight,
    one regenerated after a false start, one edited on the way, and one
    regenerated after a later turn that it takes away again. Rows of one turn
    are messages of their own, in the order of role and text.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    rows = dense_ids(rows, ["conv_id", "turn", "role", "text"], F.lit(0).cast("long"), "g").drop("turn")
    third = F.expr("cast(length(text) div 3 as int)")
    a, b, c = F.substr("text", F.lit(1), third), F.substr("text", third + 1, third), F.substr("text", 2 * third + 1, F.length("text"))
    none = F.lit(None).cast("string")

    def event(kind: str, text: Column = none, later: int = 0) -> Column:
        return F.struct((2 * F.col("g") + later).alias("turn"), F.lit(kind).alias("kind"),
                        (F.col("role") if kind == "open" and not later else F.lit(LEARNED) if kind == "open" else none).alias("role"), text.alias("text"))
    stream = [event("delta", a), event("delta", b), event("delta", c)]
    ways = [[event("open"), *stream],
            [event("open"), event("delta", F.reverse("text")), event("regenerate"), *stream],
            [event("open"), event("delta", b), event("edit", F.concat(a, b)), event("delta", c)],
            [event("open"), event("delta", c), event("open", b, 1), event("delta", a, 1), event("regenerate"), *stream]]
    events = F.array(*ways[0])
    for k in (1, 2, 3):
        events = F.when(F.pmod("g", F.lit(4)) == k, F.array(*ways[k])).otherwise(events)
    return rows.select("conv_id", "g", F.posexplode(events).alias("k", "e")).select("conv_id", (F.col("g") * 16 + F.col("k")).alias("seq"), "e.*")


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
f AS (SELECT *, len(text) - len(replace(text, '\', '')) + len(list_filter(range(1, len(text) + 1), lambda i: substr(text, i, 3) = '###'))
             + (len(text) - len(replace(text, '</turn>', ''))) // 7 AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(len('### ') + len(role) + len(':') + 1 + len(text) + marks + len('</turn>') + 1)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
