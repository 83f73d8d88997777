r"""Chat formatting with a grammar that gives the turns back.

A conversation is written turn by turn::

    ### Assistant: <text>
    </turn>

Roles without a label of their own are written as ``### Role "<JSON string>": ``. A deterministic parser reads this
back: a header, the text up to the first mark that is not escaped, which has to be the end mark on a line of its
own, and so on. ``\`` before a mark escapes it; reading takes away one ``\`` of those before a mark.

Text goes in as it stands. What has been rendered is parsed again and compared with the source; the turns that do not come back
are escaped, and that is repeated until all of them do. A turn that comes back alone also does so among others, since it begins
with a header and is ended by the first bare mark, so turns are tried one by one, and a conversation of any length is cut into
chunks of whole turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photofold.llm.common import small_batches, task_count
from photofold.llm.words import lean
from photofold.session import run_folder

LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ROLES = {label: role for role, label in LABELS.items()}
TRAINED = "assistant"
END = "</turn>"
CHUNK_CHARS = 1 << 20

_BARE = r'</turn>|### (?:(?:%s): |Role ")' % "|".join(ROLES)
_MARK = re.compile(rf"(\\*)({_BARE})")
_HEADER = re.compile(r'### (?:(%s)|Role ("(?:[^"\\]|\\.)*")): ' % "|".join(ROLES))

CHUNKS = (
    "part int, chunk long, conv_id long, continued boolean, continues boolean, n_turns long, text string, "
    "mask array<struct<start:long,end:long>>"
)


class ChatSyntaxError(ValueError):
    """The text is not made by the grammar."""


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    #: Where the text stands in what was parsed, escapes included.
    start: int = 0
    end: int = 0


def header(role: str) -> str:
    if role in LABELS:
        return f"### {LABELS[role]}: "
    quoted = json.dumps(role).replace("<", "\\u003c").replace("#", "\\u0023")
    return f"### Role {quoted}: "


def escape(text: str) -> str:
    return _MARK.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1][1:] + m[2], text)


def parse(text: str) -> list[Turn]:
    """The turns of a text of the grammar."""
    turns, at = [], 0
    while at < len(text):
        head = _HEADER.match(text, at)
        if head is None:
            raise ChatSyntaxError(f"no header at {at}")
        role = ROLES[head[1]] if head[1] else json.loads(head[2])
        for mark in _MARK.finditer(text, head.end()):
            if not mark[1]:
                break
        else:
            raise ChatSyntaxError("a turn has no end")
        stop = mark.start() - 1
        if mark[2] != END or stop < head.end() or text[stop] != "\n" or text[mark.end() : mark.end() + 1] != "\n":
            raise ChatSyntaxError(f"a mark inside a turn at {mark.start()}")
        turns.append(Turn(role, unescape(text[head.end() : stop]), head.end(), stop))
        at = mark.end() + 1
    return turns


def _comes_back(rendered: str, role: str, text: str) -> bool:
    try:
        turns = parse(rendered)
    except ChatSyntaxError:
        return False
    return len(turns) == 1 and turns[0].role == role and turns[0].text == text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that the parser gives back, and where its text begins and ends in it."""
    head, body = header(role), text
    while True:
        rendered = f"{head}{body}\n{END}\n"
        if _comes_back(rendered, role, text):
            return rendered, len(head), len(head) + len(body)
        conflicting, body = body, escape(text)
        if body == conflicting:
            raise ChatSyntaxError("a turn does not come back")


def write_chats(turns: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> None:
    """Format conversations (``conv_id``, ``turn``, ``role``, ``text``) and write them as a Parquet table of chunks.

    Turns are in order of ``turn``, null first; turns of one number by role and text, and repeated rows are repeated turns. A null text
    or role is empty. Rows without ``conv_id`` are one conversation. Other columns are ignored; an empty table
    writes no chunks. A chunk has whole turns, of some ``chunk_chars`` characters together or one turn that is longer, and tells the spans of its
    text that count for the loss. Rows are range-partitioned by conversation and turn, so a conversation of any length is spread over tasks.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("role", "text"))
    ordered = rows.repartitionByRange(task_count(turns), "conv_id", "turn", "role", "tie").sortWithinPartitions("conv_id", "turn", "role", "tie", "text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [("part", pa.int32()), ("chunk", pa.int64()), ("conv_id", pa.int64()), ("continued", pa.bool_()), ("continues", pa.bool_()),
         ("n_turns", pa.int64()), ("text", pa.string()), ("mask", pa.list_(span))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, made, size, some = TaskContext.get().partitionId(), 0, [], 0, False
        texts, mask, at, now, continued = [], [], 0, None, False

        def close(continues: bool) -> None:
            nonlocal number, at, size
            text = "".join(texts)
            made.append({
                "part": part, "chunk": number, "conv_id": now, "continued": continued, "continues": continues, "n_turns": len(texts),
                "text": text, "mask": [{"start": a, "end": b} for a, b in mask],
            })
            number, size, at = number + 1, size + len(text), 0
            texts.clear()
            mask.clear()

        for batch in batches:
            for name, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if some and name != now:
                    close(False)
                    continued = False
                elif at >= chunk_chars:
                    close(True)
                    continued = True
                some, now = True, name
                rendered, start, end = render(role, text)
                if role == TRAINED:
                    mask.append((at + start, at + end))
                texts.append(rendered)
                at += len(rendered)
                if size >= chunk_chars:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made, size = [], 0
        if some:
            close(False)
            yield pa.RecordBatch.from_pylist(made, schema)

    ordered.select("conv_id", "role", "text").mapInArrow(lean(run), CHUNKS).write.parquet(path)


def _streams(turns: list[Turn], text: str, mask: list[dict]) -> tuple[bytes, str]:
    """The bytes that a conversation's digest is of, and all text under the loss mask."""
    said = "".join(f"{t.role}\n{t.text}\n" for t in turns)
    return said.encode(), "".join(unescape(text[m["start"] : m["end"]]) for m in mask)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (f.split() for f in READ.split(", "))])


def _digest_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations whose chunks arrive in order; of each a running state is held only."""
    now, some, numbers, digests = None, False, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]

    def row() -> dict:
        return dict(zip(_READ.names, (now, numbers[0], digests[0].hexdigest(), numbers[1], digests[1].hexdigest(), numbers[2])))

    for batch in batches:
        made = []
        for name, text, mask in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if some and name != now:
                made.append(row())
                numbers, digests = [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
            some, now = True, name
            turns = parse(text)
            said, loss = _streams(turns, text, mask)
            digests[0].update(said)
            digests[1].update(loss.encode())
            numbers = [a + b for a, b in zip(numbers, (len(turns), len(loss), len(text)))]
        if made:
            yield pa.RecordBatch.from_pylist(made, _READ)
    if some:
        yield pa.RecordBatch.from_pylist([row()], _READ)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation, from the written chunks alone: ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line feed, text, line
    feed of each turn), ``loss_chars`` and ``loss_sha256`` (the text under the mask, unescaped), ``formatted_chars``.

    Conversations of one chunk are read in place. The chunks of others are sorted: a digest is one chain over a whole conversation,
    so such a conversation passes one task, as a stream.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    # At a border between two tasks a conversation may go on; there are as many borders as tasks.
    ends = chunks.groupBy("part").agg(F.min(F.struct("chunk", "conv_id")).alias("first"), F.max(F.struct("chunk", "conv_id")).alias("last"))
    crossing = (
        ends.select("part", F.explode(F.array("first.conv_id", "last.conv_id")).alias("conv_id"))
        .groupBy("conv_id").agg(F.countDistinct("part").alias("parts")).filter("parts > 1").select(F.col("conv_id").alias("_cut"))
    )
    marked = chunks.join(F.broadcast(crossing.withColumn("_several", F.lit(True))), F.col("conv_id").eqNullSafe(F.col("_cut")), "left")
    several = F.coalesce(F.col("_several"), F.lit(False)) | F.col("continued") | F.col("continues")
    columns = ["conv_id", "text", "mask"]
    whole = marked.filter(~several).select(*columns).mapInArrow(lean(_digest_sorted), READ)
    cut = marked.filter(several).repartition(task_count(chunks), "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return whole.unionByName(cut.select(*columns).mapInArrow(lean(_digest_sorted), READ))


def round_trip(turns: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Write to a new folder below the session's shared one and read back."""
    path = run_folder(turns.sparkSession, "chats")
    write_chats(turns, path, chunk_chars)
    return read_chats(turns.sparkSession, path)
