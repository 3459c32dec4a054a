"""Chat formatting by incremental black-box rendering (operator 10).

A template is any function from messages to a string.  It is rendered for
successive prefixes of a conversation; what a prefix adds to the one before is
the new turn's span, and a prefix whose output does not start with the one
before it shows that the template rewrites history.  A conversation that is
rewritten has no spans that hold: its formatted text is the last rendering,
whole, its spans are null.  The place of a turn's text
inside its span comes from two further renderings with probe texts: what they
share before and after is the turn's header and tail.

A black box is rendered for every prefix, whole, whatever the length: that
costs the square of a conversation's length, in one task.  Only a template that
is known to be local, one whose rendering of a turn depends on no more than
``context`` turns before it and not on its place, is spared that: the library's
own (which joins its turns), or one for which the caller states ``context``.
Its turns are dealt in chunks of ``CHUNK`` consecutive ones, each rendered
behind the context before it, so a conversation of any length is spread over
tasks; only the digests of a whole conversation stream through one.

The library's template marks turns with control strings and escapes those that
occur in texts: every ``<`` that backslashes and ``|`` follow gets one more
backslash, so texts never hold a control string and unescaping is exact.

Defined cases: null roles and texts are empty; rows of equal turn are ordered
by role and text; null conversation ids form one conversation, null turns come
first; repeated rows are turns of their own; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.llm._common import slices

CHUNK, CONTEXT = 256, 32
Messages = list[tuple[str, str]]
NAMES = ["conv_id", "chunk", "formatted", "turn_begins", "loss_begins", "loss_ends", "rewrites"]
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(messages: Messages) -> str:
    """The library's template."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in messages)


def read_back(formatted: str) -> Messages:
    """Roles and texts of a formatted string."""
    out, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError(f"text between turns at {at}")
        at = found.end()
        out.append((unescape_role(found[1]), unescape(found[2])))
    if at != len(formatted):
        raise ValueError(f"text after the last turn at {at}")
    return out


def _shared_tail(a: str, b: str) -> int:
    return len(os.path.commonprefix([a[::-1], b[::-1]]))


def locate(template: Callable[[Messages], str], messages: Messages, skip: int = 0):
    """(added, begin, end, rewrites) of every turn after the first ``skip``:
    the string it adds, its text's place in that string, and whether its
    rendering changed what stood before."""
    before = template(messages[:skip]) if skip else ""
    for i in range(skip, len(messages)):
        role, _ = messages[i]
        whole = template(messages[:i + 1])
        probes = [template([*messages[:i], (role, mark)]) for mark in ("\x01", "\x02")]
        rewrites = not whole.startswith(before)
        base = len(os.path.commonprefix([whole, before])) if rewrites else len(before)
        header = max(len(os.path.commonprefix(probes)) - base, 0)
        tail = _shared_tail(*probes)
        added = whole[base:]
        yield added, header, max(header, len(added) - tail), rewrites
        before = whole


#: Turns that are numbered together are those of one range of so many turn values.
RANGE = 1024


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds ``place``, a turn's number in its conversation.  Turns are counted by
    ranges of their values and numbered inside a range, so a conversation of any
    length is sorted in many tasks."""
    turns = turns.withColumn("range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-2 ** 62)))
    counts = turns.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("conv_id").alias("__conv"), F.col("range").alias("__range"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
    own = turns.withColumn("place", F.row_number().over(inside) - 1)
    return own.join(before, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("range") == F.col("__range"))).select(
        "conv_id", "turn", "role", "text", (F.col("place") + F.col("before")).alias("place"))


def format_conversations(rows: DataFrame, template: Callable[[Messages], str] = render,
                         trained: tuple[str, ...] = ("assistant",), context: int | None = None) -> DataFrame:
    """conv_id, chunk, formatted, turn_begins (code points), loss_begins,
    loss_ends, rewrites (turns that changed what stood before); the chunks of a
    conversation, in order, are its formatted text.  A rewritten conversation
    (a rewritten chunk, where ``context`` is given) is one row: its last whole
    rendering, without spans.

    ``context``: how many turns back (at most CHUNK) a template looks that is
    known to be local; without it, templates other than the library's are
    rendered behind the whole conversation before each turn.
    """
    if context is None and template is render:
        context = CONTEXT
    if context is not None and not 0 <= context <= CHUNK:
        raise ValueError(f"context must be between 0 and {CHUNK}")
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = _numbered(turns)
    if context is None:
        dealt = turns.withColumn("chunk", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    else:
        chunk = F.floor(F.col("place") / CHUNK)
        near_end = F.pmod(F.col("place"), F.lit(CHUNK)) >= CHUNK - context
        # the last turns of a chunk are also the context of the next one
        dealt = turns.withColumn("chunk", F.explode(
            F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))).withColumn("own", F.col("chunk") == chunk)

    def run(batches):
        now, messages, skip = None, [], 0

        def made():
            """A row for every CHUNK turns; none for the context of a chunk that does not exist."""
            spans = locate(template, messages, skip)
            if template is not render:
                spans = list(spans)
                if rewrites := sum(changed for *_, changed in spans):
                    ints = pa.array([None], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([template(messages)], pa.string()),
                         ints, ints, ints, pa.array([rewrites], pa.int32())], NAMES)
                    return
                spans = iter(spans)
            for chunk, at in enumerate(range(skip, len(messages), CHUNK), now[1]):
                yield written(chunk, zip(messages[at:at + CHUNK], spans))

        def written(chunk, turns):
            parts, begins, losses, ends, rewrites, at = [], [], [], [], 0, 0
            for (role, _), (added, b, e, changed) in turns:
                begins.append(at)
                rewrites += changed
                if role in trained:
                    losses.append(at + b)
                    ends.append(at + e)
                parts.append(added)
                at += len(added)
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([chunk], pa.int64()), pa.array(["".join(parts)], pa.string()),
                 pa.array([begins], ints), pa.array([losses], ints), pa.array([ends], ints), pa.array([rewrites], pa.int32())],
                NAMES)

        def gathered(stream, least=256):
            held = []
            for batch in stream:
                held.append(batch)
                if len(held) >= least:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        def each():
            nonlocal now, messages, skip
            for batch in batches:
                for conv, part, role, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                    if (conv, part) != now:
                        if messages:
                            yield from made()
                        now, messages, skip = (conv, part), [], 0
                    messages.append((role, text))
                    skip += not own
            if messages:
                yield from made()

        yield from gathered(each())

    return (dealt.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "place")
            .select("conv_id", "chunk", "role", "text", "own")
            .mapInArrow(run, "conv_id long, chunk long, formatted string, turn_begins array<int>, "
                             "loss_begins array<int>, loss_ends array<int>, rewrites int"))


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewrites of every conversation, read back from the
    formatted text and its loss spans; chunks stream through one digest.  A
    rewritten conversation has null digests and counts."""

    def run(batches):
        now, state, rows = None, None, []

        def closed():
            turns, digest, chars, loss, size, rewrites = state
            if turns is None:
                return (now[0], None, None, None, None, size, rewrites)
            return (now[0], turns, digest.hexdigest(), chars, loss.hexdigest(), size, rewrites)

        def batch_of():
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

        for batch in slices(batches):
            for conv, text, begins, ends, rewrites in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(closed())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[4] += len(text)
                state[5] += rewrites
                if begins is None or state[0] is None:
                    state[0] = None
                    continue
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for b, e in zip(begins, ends):
                    said = unescape(text[b:e])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
            if len(rows) >= 4096:
                yield batch_of()
                rows = []
        if now is not None:
            rows.append(closed())
        if rows:
            yield batch_of()

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
            .select("conv_id", "formatted", "loss_begins", "loss_ends", "rewrites")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                             "formatted_chars long, rewrites long"))
