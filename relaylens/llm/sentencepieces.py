"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; ``parse`` reads the pieces with scores and
kinds, the algorithm, byte fallback and the normaliser straight from its
wire format.  ``Codec`` rebuilds what they describe:

* normaliser: the compiled character map, removal of extra spaces, the dummy
  prefix, and the metaspace marker U+2581 for each space;
* unigram models: pieces with their log-probability scores; merge models:
  every split of a piece into two pieces, ranked by the piece's score;
* byte fallback for characters outside the vocabulary.

Control pieces are never produced by text.  Batches are encoded by the
library's own threads (``threads`` per Python worker).

``parity`` says of each whole document whether the sentencepiece library with
the unmodified model agrees: its normaliser gives the same marked text, it
gives the same ids for every chunk (each distinct chunk when it is first met),
and it gives the same ids for the whole document at once.  All three hold for
every document.  ``digest`` adds that the library decodes the ids to the same
text.

Null text counts as empty (no ids); rows keep their order within a
partition; repeated rows are encoded as often as they occur; other columns
are carried along by ``encode`` under their own names unless one is called
``ids`` or ``parity``, which it replaces.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.caches import claim, register
from relaylens.llm.ship import ship, small, whole_text
from relaylens.llm.tokens import CACHE_CHUNK_CHARS, CACHE_CHUNKS, METASPACE, ODD, SLICE_CHARS, ChunkEncoder, binary, buffers, slices

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What the reference decoder prints for an unknown piece.
UNKNOWN_TEXT = " ⁇ "
#: A second normaliser entry that turns the dummy prefix and the removal of
#: spaces off; later scalar fields win when a message is merged.
PLAIN = b"\x1a\x04\x18\x00\x20\x00"
#: Chunks given to the tokenizers library as one text.
JOINED = 100
#: What ``Codec.whole`` goes by; ``parity`` asks neither it nor these.
WHOLE_EVERY = 16
#: Control characters, odd white space, combining marks, the marker itself
#: and whatever lies outside the basic plane.
UNUSUAL = re.compile(ODD.pattern[:-1] + "\x00-\x09\x0b-\x1f\x7f-\x9f\u0300-\u036f\u2581\ufffd\U00010000-\U0010ffff]")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    raw: bytes
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True


def parse(raw: bytes) -> Model:
    """The parts of a model file that encoding and decoding need."""
    m = Model(raw)
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.kinds.append(kind)
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.algorithm = v
                elif n == 24 and v:
                    raise ValueError("models with white space as a suffix are not supported")
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra = bool(v)
                elif n == 5 and not v:
                    raise ValueError("models that leave spaces unmarked are not supported")
        elif number == 5 and any(n == 2 and v for n, v in fields(value)):
            raise ValueError("models with a denormaliser are not supported")
    if m.algorithm not in (UNIGRAM, BPE):
        raise ValueError("only unigram and merge models are supported")
    if USER_DEFINED in m.kinds:
        raise ValueError("models with user-defined pieces are not supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two, best-scored piece first."""
    ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == NORMAL}
    ranked = []
    for p, i in ids.items():
        for cut in range(1, len(p)):
            if p[:cut] in ids and p[cut:] in ids:
                ranked.append((-m.scores[i], i, ids[p[:cut]], ids[p[cut:]], p[:cut], p[cut:]))
    ranked.sort()
    return [(r[4], r[5]) for r in ranked]


def chunkable(m: Model) -> bool:
    """True if no piece runs past the start of a space or across a line end,
    so that ids never depend on what lies on the other side."""
    normal = [p for p, k in zip(m.pieces, m.kinds) if k == NORMAL]
    return m.byte_fallback and not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in normal)


def mark_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of ``METASPACE`` begin in these texts: at a run of
    markers, at a line end and after one."""
    mark, line = np.zeros(len(data), bool), data == 10
    # the marker is three bytes, of which the first begins a character
    mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    begins = mark | line
    begins[3:] &= ~(mark[3:] & mark[:-3])
    begins[1:] |= line[:-1]
    begins[offsets[offsets < len(data)]] = True
    return np.flatnonzero(begins)


class PieceEncoder(ChunkEncoder):
    """Where chunks are those of ``METASPACE``, a slice is cut on its bytes and
    each of its distinct chunks looked up once."""

    slice_chars = 4 * SLICE_CHARS

    def _slice(self, texts: list[str]) -> list[bytes]:
        if self.split != METASPACE.findall:
            return super()._slice(texts)
        offsets, data = buffers(pa.array(texts, pa.large_string()))
        begins = mark_starts(data, offsets)
        chunks = binary(data, np.append(begins, len(data))).dictionary_encode()
        strings = chunks.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.cache.get, strings))
        missing = [i for i, p in enumerate(parts) if p is None]
        if missing:
            for i, packed in zip(missing, self.pack([strings[i] for i in missing])):
                parts[i] = packed
            room = CACHE_CHUNKS - len(self.cache)
            if room > 0:
                kept = [i for i in missing if len(strings[i]) <= CACHE_CHUNK_CHARS][:room]
                self.cache.update((strings[i], parts[i]) for i in kept)
        at, packed = buffers(pa.array(parts, pa.large_binary()).take(chunks.indices))
        packed, cuts = packed.tobytes(), at[np.searchsorted(begins, offsets)].tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


class Codec:
    """Encoder and decoder of one model, with the parity check."""

    def __init__(self, path: str, threads: int = 2):
        with open(path, "rb") as f:
            self.model = m = parse(f.read())
        self.threads = threads
        self.differs: set[str] = set()
        self.surface = [self._surface(p, k) for p, k in zip(m.pieces, m.kinds)]
        self.surfaces = pa.array(self.surface, pa.large_binary())

    @cached_property
    def encoder(self) -> ChunkEncoder:
        chunk = METASPACE if chunkable(self.model) else re.compile("(?s).+")
        return PieceEncoder(self._encode_chunks, chunk, 4, odd=None)

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if self.threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(self.threads))
        from tokenizers import Tokenizer, models

        m = self.model
        # a control piece's name is ordinary text in a document
        names = [p if k in (NORMAL, UNKNOWN, BYTE) else f"\uffff{i}" for i, (p, k) in enumerate(zip(m.pieces, m.kinds))]
        unk = m.kinds.index(UNKNOWN)
        if m.algorithm == UNIGRAM:
            return Tokenizer(models.Unigram(list(zip(names, m.scores)), unk_id=unk, byte_fallback=m.byte_fallback))
        vocab = {p: i for i, p in enumerate(names)}
        return Tokenizer(models.BPE(vocab, merges(m), unk_token=names[unk], fuse_unk=True, byte_fallback=m.byte_fallback))

    @cached_property
    def charsmap(self):
        from tokenizers import normalizers

        return normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None

    @cached_property
    def reference(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model.raw + PLAIN)

    @cached_property
    def unmodified(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model.raw)

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return UNKNOWN_TEXT.encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    @cached_property
    def line_end(self) -> int | None:
        """The id that a line end gets and nothing else does, nor joins with;
        None where that is not sure."""
        m = self.model
        return m.pieces.index("<0x0A>") if m.algorithm == BPE and chunkable(m) and "<0x0A>" in m.pieces else None

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk by the tokenizers library, which takes many
        chunks with line ends between them faster than one by one."""
        if self.line_end is None:
            return self._library(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= CACHE_CHUNK_CHARS and "\n" not in c]
        rest = sorted(set(range(len(chunks))).difference(short))
        out: list[list[int]] = [[]] * len(chunks)
        for i, ids in zip(rest, self._library([chunks[i] for i in rest])):
            out[i] = ids
        groups = [short[a : a + JOINED] for a in range(0, len(short), JOINED)]
        for where, ids in zip(groups, self._library(["\n".join([chunks[i] for i in g]) for g in groups])):
            at = 0
            for i, cut in zip(where, [*np.flatnonzero(np.array(ids) == self.line_end).tolist(), len(ids)], strict=True):
                out[i] = ids[at:cut]
                at = cut + 1
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        ids = self._joined(chunks)
        expected = self.reference.encode([c.replace(MARK, " ") for c in chunks], num_threads=1)
        self.differs.update(c for c, a, b in zip(chunks, ids, expected) if a != b)
        return ids

    def normalise(self, text: str) -> str:
        """The text as the model sees it, spaces not yet marked."""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        return text

    def marked(self, text: str) -> str:
        text = self.normalise(text)
        return (" " * (self.model.dummy_prefix and text != "") + text).replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.encoder.encode([self.marked(t) for t in texts])]

    def whole(self, text: str) -> bool:
        """Whether a text is unusual or one of a sample.  ``parity`` does not
        ask: it takes every text at once.  Kept for the tests that name it."""
        if zlib.crc32(text.encode()) % WHOLE_EVERY == 0 or UNUSUAL.search(text):
            return True
        return self.charsmap is not None and self.charsmap.normalize_str(text) != text

    def parity(self, text: str, ids: np.ndarray) -> bool:
        """After ``encode`` gave ``ids``: the reference library agrees, also
        on the whole text at once."""
        marked = self.marked(text)
        if self.unmodified.normalize(text) != marked:
            return False
        if self.differs and not self.differs.isdisjoint(self.encoder.split(marked)):
            return False
        return np.array_equal(self.unmodified.encode_as_numpy(text), ids.astype(np.int32, copy=False))

    def decode(self, ids: list[int]) -> str:
        return self._text(b"".join(map(self.surface.__getitem__, ids)))

    def _text(self, surface: bytes) -> str:
        text = surface.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode_column(self, ids: pa.Array) -> list[str]:
        """``decode`` of every list of an Arrow column; null is empty."""
        at, surface = buffers(self.surfaces.take(ids.flatten()))
        cuts = at[list_bounds(ids)].tolist()
        return [self._text(surface[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]

    def decoding_parity(self, ids: np.ndarray, decoded: str) -> bool:
        """The reference library decodes these ids to the same text."""
        return self.unmodified.decode(ids) == decoded


def list_bounds(lists: pa.Array) -> np.ndarray:
    """Where each list of a column begins and the last one ends in the
    flattened column."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


_CODECS: dict[tuple[str, int], Codec] = {}
register("pieces", _CODECS.clear)


def codec(path: str, threads: int = 2) -> Codec:
    """One codec per model and Python worker."""
    if (path, threads) not in _CODECS:
        _CODECS[path, threads] = Codec(path, threads)
    return _CODECS[path, threads]


def encode(docs: DataFrame, model: str, text: str = "text", threads: int = 2) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``parity``."""
    ship(docs.sparkSession)
    kept = docs.select(*[docs[c] for c in docs.columns if c not in ("ids", "parity")])
    rows = kept.withColumn(text, whole_text(text))
    at = rows.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        c = codec(model, threads)
        for batch in small(batches):
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts, PieceEncoder.slice_chars):
                ids = c.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids).astype(np.int32)
                parity = pa.array([c.parity(t, i) for t, i in zip(texts[a:b], ids)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), parity],
                    names=[*batch.schema.names, "ids", "parity"],
                )

    schema = rows.select("*", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("boolean").alias("parity")).schema
    return rows.mapInArrow(task, schema)


def decode(encoded: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """Adds ``decoded`` (the text of ``ids``; null ids give an empty text)."""
    ship(encoded.sparkSession)
    rows = encoded.drop("decoded")
    at = rows.columns.index("ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        c = codec(model, threads)
        for batch in small(batches):
            texts = c.decode_column(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(task, rows.withColumn("decoded", F.lit("").cast("string")).schema)


def digest(encoded: DataFrame, model: str) -> DataFrame:
    """Decodes and compares: doc_id, n_tokens, ids_crc32 (of the ids as
    little-endian 32-bit integers), parity (of the encoding and of the
    decoding), and round_trip: the decoded text is the normalised one (a
    marker character in a text reads back as a space).  ``encoded`` has
    doc_id, text, ids and parity."""
    ship(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("parity", pa.bool_()), ("round_trip", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        c = codec(model)
        for batch in small(batches):
            bounds = list_bounds(batch.column(2)).tolist()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4")
            ids = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
            decoded = c.decode_column(batch.column(2))
            agrees = pa.array([c.decoding_parity(i, d) for i, d in zip(ids, decoded)], pa.bool_())
            n, crc = pa.array(map(len, ids), pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64())
            same = pa.array([d == c.normalise(t) for d, t in zip(decoded, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, crc, pc.and_(batch.column(3), agrees), same], schema=schema)

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ids", "parity")
    return rows.mapInArrow(task, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
