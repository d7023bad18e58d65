"""Token counts by field or section, from one encoding of the whole text.

Fields are joined to one text per document (``record``), which is encoded
once; every token keeps the characters it came from, and a sorted interval
join gives it to sections.  Counting fields on their own would miscount the
tokens at their borders; here the counts of a document add up to its length.

A token that crosses a border goes by an explicit rule:

``majority``  the section with most of its characters; the earlier on ties
``start``     the section of its first character

Characters outside all sections (separators) count for the null section.
Sections must not overlap.  Null fields are empty sections; an empty text
has no tokens but keeps its sections with zero counts; repeated rows are
counted as often as they occur; no column of the input is carried along, so
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm.caches import claim, register
from relaylens.llm.ship import ship, small
from relaylens.llm.tokens import ByteLevelEncoder, id_width, load_tokenizer, slices

SECTIONS = "array<struct<name:string,start:int,end:int>>"
COUNTS = "doc_id long, section string, n_chars long, n_tokens long, n_crossing long, doc_tokens long"
RULES = ("majority", "start")
TOKEN_BYTES = 8
_ENCODERS: dict[str, "SpanEncoder"] = {}
register("spans", _ENCODERS.clear)


class SpanEncoder(ByteLevelEncoder):
    """Whole texts to the character spans of their tokens.

    Each id of a byte-level vocabulary stands for a known number of bytes,
    so the running total gives every token's bytes, and those its
    characters; a token with part of a character spans all of it."""

    def pack(self, strings: list[str]) -> list[bytes]:
        packed = super().pack(strings)
        counts = np.array([len(p) for p in packed]) // self.width
        sizes = self.sizes[np.frombuffer(b"".join(packed), self.dtype)]
        ends = np.cumsum(sizes)
        raw = np.frombuffer("".join(strings).encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        lengths = np.array([len(s) for s in strings])
        base = np.repeat(np.cumsum(lengths) - lengths, counts)
        spans = np.column_stack([char[ends - sizes] - base, char[ends - 1] + 1 - base]).astype("<i4").tobytes()
        cuts = (np.cumsum(counts) * TOKEN_BYTES).tolist()
        return [spans[a:b] for a, b in zip([0, *cuts], cuts)]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """Per text an array of (start, end), one per token, as the library
        gives for the whole text."""
        out = []
        for a, b in slices(texts):
            for chunks, parts in self.parts(texts[a:b]):
                spans = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2).astype(np.int64)
                # a chunk's spans count from its first character
                sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
                counts = np.fromiter(map(len, parts), np.int64, len(parts)) // TOKEN_BYTES
                out.append(spans + np.repeat(np.cumsum(sizes) - sizes, counts)[:, None])
        return out


def span_encoder(path: str) -> SpanEncoder:
    if path not in _ENCODERS:
        tok = load_tokenizer(path)
        _ENCODERS[path] = SpanEncoder(tok, id_width(tok.get_vocab_size()))
    return _ENCODERS[path]


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section index of every token (-1: none), and whether it crosses a
    border.  ``starts`` ascend and sections do not overlap."""
    a, b = spans[:, 0], spans[:, 1]
    if not len(starts):
        return np.full(len(a), -1), np.zeros(len(a), bool)
    first = np.searchsorted(starts, a, "right") - 1
    inside = (first >= 0) & (a < ends[np.maximum(first, 0)])
    whole = inside & (b <= ends[np.maximum(first, 0)])
    owner = np.where(inside, first, -1)
    last = np.searchsorted(starts, b, "left") - 1
    crossing = ~whole & (inside | (last > first))
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            k = np.arange(max(first[t], 0), last[t] + 1)
            share = np.minimum(ends[k], b[t]) - np.maximum(starts[k], a[t])
            outside = (b[t] - a[t]) - np.maximum(share, 0).sum()
            best = int(np.argmax(share))
            owner[t] = k[best] if share[best] > 0 and share[best] >= outside else -1
    return owner, crossing


def record(docs: DataFrame, fields: list[tuple[str, Column]], separator: str = "\n") -> DataFrame:
    """One text per document from its fields, with their places in it."""
    values = [F.coalesce(c.cast("string"), F.lit("")) for _, c in fields]
    places, at = [], F.lit(0)
    for (name, _), v in zip(fields, values):
        end = at + F.length(v)
        places.append(F.struct(F.lit(name).alias("name"), at.alias("start"), end.alias("end")))
        at = end + len(separator)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat_ws(separator, *values).alias("text"),
        F.array(*places).cast(SECTIONS).alias("sections"),
    )


def token_counts(records: DataFrame, tokenizer: str, rule: str = "majority") -> DataFrame:
    """Per document and section (and the null section): characters, tokens,
    tokens of it that cross a border, and the document's tokens.

    ``records`` has doc_id, text and sections; ``record`` makes it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(records.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("section", pa.string())] + [(c, pa.int64()) for c in ("n_chars", "n_tokens", "n_crossing", "doc_tokens")]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("spans")
        enc = span_encoder(tokenizer)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cols: list[list] = [[] for _ in schema]
            for key, text, sections, spans in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), enc.spans(texts)):
                places = sorted(sections or [], key=lambda s: (s["start"], s["end"]))
                starts = np.array([s["start"] for s in places], np.int64)
                ends = np.array([s["end"] for s in places], np.int64)
                owner, crossing = attribute(spans, starts, ends, rule)
                n = np.bincount(owner + 1, minlength=len(places) + 1)
                x = np.bincount(owner[crossing] + 1, minlength=len(places) + 1)
                chars = [len(text) - int((ends - starts).sum()), *(ends - starts).tolist()]
                names = [None, *(s["name"] for s in places)]
                for row in zip([key] * len(names), names, chars, n.tolist(), x.tolist(), [len(spans)] * len(names)):
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    rows = records.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("sections").cast(SECTIONS).alias("sections"))
    return rows.mapInArrow(task, COUNTS)
