"""Chat formatting at token level.

``assemble`` turns conversation rows into token segments, one per turn:
the texts are encoded on their own and the reserved ids that mark a turn are
spliced around them, so no text can form a mark.  The loss mask of a turn
(its assistant text) and its place in the conversation come from prefix
sums over segment lengths.  ``read_back`` goes the other way: it splits ids
at the marks, decodes, and takes the escapes out again.

Texts that contain a control string are escaped reversibly before encoding,
so the rendered text cannot be misread either: a backslash goes behind the
string's first character, and a string that already has backslashes there
gets one more.

Turns go by ``turn``, then role and ids; null ids and turns come first,
null roles and texts count as empty.  Any role is allowed: roles other than
system, user and assistant carry their name in the segment.  Repeated rows
are turns of their own.  Other columns are not read.  Nothing gathers a
conversation: encoding is per turn, the prefix sum and the reader go through
sorted rows one at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaylens.llm.caches import claim
from relaylens.llm.ship import partitions, ship
from relaylens.llm.tokens import BYTE_LEVEL, encoder, load_tokenizer

#: The control strings, in the order of their reserved ids,
#: which follow the vocabulary's last.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, ROLE_END = range(len(CONTROL))
FRAMES = {"system": (SYS, SYS_END), "user": (INST, INST_END), "assistant": (BOS, EOS)}
LOSS_ROLE = "assistant"

_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_DECODERS: dict[str, list[bytes]] = {}

SEGMENTS = "conv_id long, turn long, role string, ids array<int>, n_ids long, loss_from long, loss_to long"


def _shift(more: bool):
    def swap(m: re.Match) -> str:
        head, slashes, tail = (g for g in m.groups() if g is not None)
        return head + ("\\" + slashes if more else slashes[1:]) + tail

    return swap


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` undoes it."""
    return _ESCAPE.sub(_shift(True), text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(_shift(False), text)


def vocabulary(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    if path not in _DECODERS:
        tok = load_tokenizer(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte = {chr(b if b in plain else next(spare)): b for b in range(256)}
        out = [b""] * tok.get_vocab_size()
        for piece, i in tok.get_vocab().items():
            out[i] = bytes(map(byte.__getitem__, piece)) if all(c in byte for c in piece) else piece.encode()
        _DECODERS[path] = out
    return _DECODERS[path]


def segment(role: str, text: np.ndarray, name: np.ndarray, reserved: int) -> tuple[np.ndarray, int, int]:
    """Ids of one turn, from those of its text and of its role's name, and
    the span of the text in them."""
    begin, end = FRAMES.get(role, (BOS, EOS))
    head = [reserved + begin]
    if role not in FRAMES:
        head = [reserved + ROLE, *name.tolist(), reserved + ROLE_END, reserved + begin]
    edges = np.cumsum([len(head), len(text)])
    return np.concatenate([head, text, [reserved + end]]).astype(np.int32), int(edges[0]), int(edges[1])


def render(ids: list[int], pieces: list[bytes]) -> str:
    """Ids as the formatted text, marks as their control strings."""
    marks = [c.encode() for c in CONTROL]
    return b"".join(pieces[i] if i < len(pieces) else marks[i - len(pieces)] for i in ids).decode()


def assemble(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row per turn: ids with the marks, its place ``start`` in the
    conversation's ids, and the span [loss_start, loss_end) under the loss
    mask there (empty unless it is an assistant's)."""
    spark = conversations.sparkSession
    ship(spark)
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("ids", pa.list_(pa.int32()))]
        + [(c, pa.int64()) for c in ("n_ids", "loss_from", "loss_to")]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        enc = encoder(tokenizer, BYTE_LEVEL)
        reserved = len(vocabulary(tokenizer))
        # a few thousand turns at a time: ids take more room than texts
        for batch in (b.slice(a, 2_000) for b in batches for a in range(0, b.num_rows, 2_000)):
            roles, shown = batch.column(2).to_pylist(), [escape(t) for t in batch.column(3).to_pylist()]
            texts = [np.frombuffer(p, enc.dtype) for p in enc.encode_column(pa.array(shown, pa.large_string()))]
            names = [np.frombuffer(p, enc.dtype) for p in enc.encode(["" if r in FRAMES else escape(r) for r in roles])]
            rows = [segment(r, t, n, reserved) for r, t, n in zip(roles, texts, names)]
            sizes = [len(ids) for ids, _, _ in rows]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([ids for ids, _, _ in rows])))
            cols = [sizes, [a for _, a, _ in rows], [b if r == LOSS_ROLE else a for r, (_, a, b) in zip(roles, rows)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids, *(pa.array(c, pa.int64()) for c in cols)], schema=schema)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "ids").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    return rows.mapInArrow(task, SEGMENTS).select(
        "conv_id",
        "turn",
        "role",
        "ids",
        start.alias("start"),
        (start + F.col("loss_from")).alias("loss_start"),
        (start + F.col("loss_to")).alias("loss_end"),
    )


class Reader:
    """Digests of one conversation, fed turn by turn from its ids."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.reserved = pieces, len(pieces)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode()

    def feed(self, ids: np.ndarray, start: int, loss_start: int, loss_end: int) -> None:
        marks = np.flatnonzero(ids >= self.reserved)
        kinds = (ids[marks] - self.reserved).tolist()
        shown = [self.text(ids[a + 1 : b]) for a, b in zip(marks[:-1], marks[1:])]
        role = next((r for r, frame in FRAMES.items() if frame == (kinds[0], kinds[-1])), None)
        if kinds[0] == ROLE:
            role = unescape(shown[0])
        body = unescape(shown[-1])
        self.turns.update(f"{role}\n{body}\n".encode())
        masked = ids[loss_start - start : loss_end - start]
        lost = unescape(self.text(masked[masked < self.reserved]))
        self.loss.update(lost.encode())
        self.loss_chars += len(lost)
        self.chars += sum(map(len, shown)) + sum(len(CONTROL[k]) for k in kinds)
        self.n += 1

    def row(self, key: int | None) -> tuple:
        return key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from the ids alone: conv_id, n_turns, turns_sha256
    (role, newline, text, newline per turn), loss_chars and loss_sha256 (the
    text under the mask), formatted_chars (of the rendering)."""
    spark = segments.sparkSession
    ship(spark)
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(tokenizer)
        key, reader, done = None, None, []
        for batch in batches:
            ids = batch.column(4)
            for i, (conv, start, a, b) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)))):
                if reader is None or conv != key:
                    if reader:
                        done.append(reader.row(key))
                    key, reader = conv, Reader(pieces)
                reader.feed(ids[i].values.to_numpy(zero_copy_only=False), start, a, b)
            if len(done) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
                done = []
        if reader:
            done.append(reader.row(key))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

    rows = segments.select("conv_id", "start", "loss_start", "loss_end", "ids")
    dealt = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "start")
    return dealt.mapInArrow(
        task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
