"""Quality rules on repetition inside a text: characters inside duplicated
word n-grams of several lengths and inside duplicated lines.

Words are ``[^\\x20\\x09-\\x0D]+``.  Each word of a text gets a number, a
rolling hash turns every run of n words into 64 bits (run n from run n - 1 by
one multiply and add over the whole array), and sorting the hashes finds
runs that occurred before.  A word is covered if a repeated run holds it, so
overlapping runs count once; coverage is the share of word characters.  A
text without repeated runs of one length has none of a longer one.

A text is kept unless

* it has fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PERCENT``
  percent of its words lie in 5-word runs found twice or more, the first
  included (``base_failed``);
* repeats (the first not included) of n-word runs cover more than
  ``NGRAM_LIMITS[n]`` of its word characters, for some n;
* repeated lines hold more than ``LINE_LIMIT`` of its word characters.

A null text has no words.  Repeated rows are measured each; null ids stay;
columns of the input other than doc_id and text are not read by ``measure``
and kept untouched by ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.caches import claim
from relaylens.llm.ship import ship, small, whole_text
from relaylens.llm.tokens import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Largest share of characters in repeats, by n-gram length.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
#: Odd multiplier of the rolling hash and the mixer of word numbers.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

COLUMNS = (
    ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    + ["base_failed", "kept", "dup_line_share"]
    + [f"dup_share_{n}" for n in NGRAM_LIMITS]
)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, " + ", ".join(f"dup_share_{n} double" for n in NGRAM_LIMITS)
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if ODD.search(text) else text.split()


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words a run of ``n`` from one of ``starts`` holds."""
    edge = np.zeros(total + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return np.cumsum(edge[:total]) > 0


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of runs that occurred earlier, and of all runs that occur
    twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    later = order[1:][same]
    return later, np.union1d(later, order[:-1][same])


def line_repeats(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their word
    characters."""
    if "\n" not in text:
        return 0, 0
    seen: set[str] = set()
    n = chars = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
            chars += sum(map(len, words_of(line)))
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return n, chars


def measure_text(text: str) -> tuple:
    """The values of ``COLUMNS`` for one text."""
    words = words_of(text)
    total = len(words)
    lengths = np.fromiter(map(len, words), np.int64, total)
    chars = int(lengths.sum())
    shares = dict.fromkeys(NGRAM_LIMITS, 0.0)
    n_repeat = 0
    if total > WINDOW:
        numbers: dict[str, int] = {}
        code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, total)
        code = (code + np.uint64(1)) * MIX
        code ^= code >> np.uint64(29)
        run = code
        for n in range(2, min(total, max(NGRAM_LIMITS)) + 1):
            run = run[:-1] * BASE + code[n - 1 :]
            if n < WINDOW:
                continue
            later, both = repeats(run)
            if not len(later):
                break
            if n == WINDOW:
                n_repeat = int(covered(both, n, total).sum())
            if n in shares:
                shares[n] = float(lengths[covered(later, n, total)].sum()) / chars
    n_lines, line_chars = line_repeats(text)
    line_share = line_chars / chars if chars else 0.0
    base_failed = total < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * total
    kept = not base_failed and line_share <= LINE_LIMIT and all(shares[n] <= limit for n, limit in NGRAM_LIMITS.items())
    symbols = sum(map(text.count, SYMBOLS))
    return (total, chars, symbols, n_lines, n_repeat, base_failed, kept, line_share, *shares.values())


def measure(docs: DataFrame) -> DataFrame:
    """Measures and verdict per document (row-local: no shuffle)."""
    ship(docs.sparkSession)
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(NGRAM_LIMITS))
    schema = pa.schema([("doc_id", pa.int64()), *zip(COLUMNS, types)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rules")
        with np.errstate(over="ignore"):
            for batch in small(batches):
                rows = [measure_text(t) for t in batch.column(1).to_pylist()]
                cols = zip(*rows) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(task, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns as they were."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rules")
        with np.errstate(over="ignore"):
            for batch in small(batches):
                verdict = [measure_text(t or "")[6] for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(verdict, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
