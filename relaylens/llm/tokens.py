"""Whole-text encoding with the tokenizers library at corpus speed.

A pre-tokenizer that never lets a token cross a white-space boundary makes
the ids of a text the concatenation of the ids of its white-space chunks.
Most chunks of a corpus are words seen before, so each Python worker encodes
every distinct chunk once with the library and keeps its ids as packed
little-endian bytes; a document is then a split, a lookup and one join.  The
result equals the library's on the whole text (tests compare them).  Texts
with white space whose class differs between regular-expression engines are
encoded whole by the library.

A byte-level column (``encode_column``) is cut on its bytes, many documents at
once: Arrow numbers the distinct chunks of a slice, and those are cut once
more into the pieces of the pre-tokenizer, so that Python and the library see
each distinct piece of a slice once, and none of the rest.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from relaylens.llm import caches

#: White space and separators that engines class differently.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Chunks of a byte-level pre-tokenizer: one leading space goes with its word.
BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Chunks of a pre-tokenizer that drops white space.
WORDS = re.compile(r"\S+")
#: Chunks of a metaspace vocabulary, on the marked text.
METASPACE = re.compile("\u2581+[^\u2581\n]*|[^\u2581\n]+|\n")

#: A chunk of visible ASCII characters and Latin letters up to U+00FF: no white
#: space, no marks that combine, lower-cased letter by letter.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Distinct chunks kept per Python worker; further ones are encoded each
#: time, so the limit bounds memory and never the result.
CACHE_CHUNKS = 400_000
CACHE_CHUNK_CHARS = 64
SLICE_CHARS = 1_000_000
#: Bytes of a column whose distinct chunks are found at once.
SLICE_BYTES = 8 << 20

_ENCODERS: dict[tuple, "ChunkEncoder"] = {}
caches.register("tokens", _ENCODERS.clear)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` characters, one text at least."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= limit:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class ChunkEncoder:
    """Texts to packed ids.  ``encode_chunks`` gives the ids of each string
    by the library; ``chunk`` splits a text where that is exact."""

    slice_chars = SLICE_CHARS

    def __init__(self, encode_chunks, chunk: re.Pattern, width: int, odd: re.Pattern | None = ODD):
        # str.split goes by the same white space as \S in a pattern
        split = str.split if chunk is WORDS else chunk.findall
        self.encode_chunks, self.split, self.odd, self.width = encode_chunks, split, odd, width
        self.dtype = np.dtype(f"<u{width}")
        self.cache: dict[str, bytes] = {}

    def pack(self, strings: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        return [array(code, ids).tobytes() for ids in self.encode_chunks(strings)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, packed."""
        out: list[bytes] = []
        # millions of short-lived strings and no cycles: the collector would
        # walk them again and again
        was = gc.isenabled()
        gc.disable()
        try:
            for a, b in slices(texts, self.slice_chars):
                out += self._slice(texts[a:b])
        finally:
            if was:
                gc.enable()
        return out

    def _slice(self, texts: list[str]) -> list[bytes]:
        return [b"".join(parts) for _, parts in self.parts(texts)]

    def parts(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """Each text's chunks and their packed ids; a text that cannot be
        split is one chunk."""
        get, out, missing = self.cache.get, [], {}
        for text in texts:
            chunks = [text] if self.odd and self.odd.search(text) else self.split(text)
            parts = list(map(get, chunks))
            if None in parts:
                missing.update(dict.fromkeys(c for c, p in zip(chunks, parts) if p is None))
            out.append((chunks, parts))
        if missing:
            new = dict(zip(missing, self.pack(list(missing))))
            for chunks, parts in out:
                if None in parts:
                    parts[:] = [new[c] if p is None else p for c, p in zip(chunks, parts)]
            room = CACHE_CHUNKS - len(self.cache)
            if room > 0:
                kept = [c for c in new if len(c) <= CACHE_CHUNK_CHARS][:room]
                self.cache.update((c, new[c]) for c in kept)
        return out


class ByteLevelEncoder(ChunkEncoder):
    """Encodes new chunks of a byte-level vocabulary many at a time: spaced
    words are joined to one text, and each id's byte length tells where one
    chunk's ids end."""

    JOINED = 2_000

    def __init__(self, tok, width: int):
        super().__init__(lambda s: [e.ids for e in tok.encode_batch_fast(s, add_special_tokens=False)], BYTE_LEVEL, width)
        self.tok, self.model, self.cuts, self.letters = tok, tok.model, cuts_pieces(tok), piece_letters()
        self.sizes = np.ones(tok.get_vocab_size(), np.int64)
        for piece, i in tok.get_vocab().items():
            # one character of a byte-level piece stands for one byte
            self.sizes[i] = len(piece)

    def pack(self, strings: list[str]) -> list[bytes]:
        spaced = [i for i, s in enumerate(strings) if len(s) > 1 and s[0] == " " and not s[1].isspace() and len(s) <= CACHE_CHUNK_CHARS]
        rest = sorted(set(range(len(strings))).difference(spaced))
        out = [b""] * len(strings)
        for i, packed in zip(rest, super().pack([strings[i] for i in rest])):
            out[i] = packed
        for a in range(0, len(spaced), self.JOINED):
            part = [strings[i] for i in spaced[a : a + self.JOINED]]
            ids = np.array(self.tok.encode("".join(part), add_special_tokens=False).ids, dtype=self.dtype)
            ends = np.cumsum([len(s.encode()) for s in part])
            cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1
            packed, at = ids.tobytes(), 0
            for i, cut in zip(spaced[a : a + self.JOINED], (cuts * self.width).tolist()):
                out[i] = packed[at:cut]
                at = cut
        return out

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text of an Arrow column, packed; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy()
        ends = np.cumsum(sizes)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + SLICE_BYTES, "right")))
            yield from self._column(texts.slice(a, b - a))
            a = b

    def _column(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, self.odd.pattern)
        strange = {}
        if pc.any(odd).as_py():
            where = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
            # texts that cannot be split are chunks of their own
            strange = dict(zip(where, self.encode([texts[i].as_py() for i in where])))
            texts = pc.if_else(odd, "", texts)
        offsets, data = buffers(texts)
        begins = chunk_starts(data, offsets)
        chunks = binary(data, np.append(begins, len(data))).dictionary_encode()
        at, packed = buffers(self._chunks(chunks.dictionary).take(chunks.indices))
        packed, at = packed.tobytes(), at[np.searchsorted(begins, offsets)].tolist()
        for i, (a, b) in enumerate(zip(at, at[1:])):
            yield strange[i] if i in strange else packed[a:b]

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """The packed ids of each of these chunks."""
        if not self.cuts or not len(chunks):
            return pa.array(self._pieces(chunks), pa.large_binary())
        offsets, data = buffers(chunks)
        begins = piece_starts(data, offsets)
        pieces = binary(data, np.append(begins, len(data))).dictionary_encode()
        ids = pa.array(self._pieces(pieces.dictionary), pa.large_binary())
        at, packed = buffers(ids.take(pieces.indices))
        return binary(packed, at[np.searchsorted(begins, offsets)])

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        strings = pieces.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.cache.get, strings))
        missing = [i for i, p in enumerate(out) if p is None]
        if missing:
            plain = [i for i in missing if self.cuts and PIECE.fullmatch(strings[i])]
            rest = sorted(set(missing).difference(plain))
            for some, new in ((plain, self.model_ids([strings[i] for i in plain])), (rest, self.pack([strings[i] for i in rest]))):
                for i, packed in zip(some, new):
                    out[i] = packed
            room = CACHE_CHUNKS - len(self.cache)
            if room > 0:
                kept = [i for i in missing if len(strings[i]) <= CACHE_CHUNK_CHARS][:room]
                self.cache.update((strings[i], out[i]) for i in kept)
        return out

    def model_ids(self, pieces: list[str]) -> Iterator[bytes]:
        """Whole pieces, to which the model alone is left to apply."""
        code, ids = "H" if self.width == 2 else "I", self.model.tokenize
        shown = self.letters[np.frombuffer("\n".join(pieces).encode(), np.uint8)].tobytes().decode("utf-16-le")
        for p in shown.split("\n") if pieces else []:
            yield array(code, [t.id for t in ids(p)]).tobytes()


#: A piece of a plain chunk: letters, digits or other visible characters, and
#: the space before them.  Apostrophes are left out, since they may begin a
#: piece of their own ('s, 'll).
PIECE = re.compile(" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
#: Classes of the bytes of plain chunks: 0 the space, 1 letters (0xc3 and the
#: byte after it are one of U+00C0 to U+00FF), 2 digits, 3 others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[32] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_CLASS[48:58] = 2
#: Bytes of no plain chunk.
_BAD = np.ones(256, bool)
_BAD[[32, *range(33, 39), *range(40, 127), *range(0x80, 0xC0), 0xC3]] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of a large string or binary column."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64, copy=False)), pa.py_buffer(data)]
    )


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of ``BYTE_LEVEL`` begin in texts without odd white
    space: at a run of white space, at its last character if a word follows,
    and at a word that no space precedes."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    # no word follows the last character of a text
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = True
    begins = space & ~(before & after)
    begins[1:] |= ~space[1:] & before[1:] & (data[:-1] != 32)
    begins[offsets[offsets < len(data)]] = True
    return np.flatnonzero(begins)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of these chunks begin: in plain chunks where the class
    of characters changes; any other chunk is one piece."""
    kind, bad = _CLASS[data], _BAD[data]
    # the signs of multiplication and division among the letters
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    whole = np.repeat(np.logical_or.reduceat(bad, offsets[:-1]), np.diff(offsets))
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (data[:-1] != 32) & ~whole[1:]
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins)


def piece_letters() -> np.ndarray:
    """The letter that the library puts for each byte of a piece, as UTF-16;
    line ends stay."""
    from tokenizers.pre_tokenizers import ByteLevel

    letters, out = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str, np.arange(256).astype("<u2")
    for c in map(chr, [*range(32, 127), *range(0xC0, 0x100)]):
        out[list(c.encode())] = list(map(ord, letters(c)[0][0]))
    return out


def cuts_pieces(tok) -> bool:
    """Whether the tokenizer applies its model to the pieces of ``PIECE`` in
    plain chunks, and does nothing else to a text."""
    made = json.loads(tok.to_str())
    cut = {k: v for k, v in (made["pre_tokenizer"] or {}).items() if k != "trim_offsets"}
    as_bytes = cut == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    return as_bytes and made["normalizer"] is None and all(t["special"] for t in made["added_tokens"])


class WordEncoder(ChunkEncoder):
    """Encodes new chunks of a vocabulary that drops white space many at a
    time: they are joined with a mark that is one id of its own, and chunks
    that hold the mark are left out of that.

    Where the tokenizer lower-cases and cuts by a pattern whose pieces lie
    within the chunk (``word_pattern``), a plain chunk is cut here, and only
    words not seen before go to the library: a corpus has far fewer of them
    than of their spellings with capitals, marks and digits."""

    JOINED, MARK = 2_000, "|"

    def __init__(self, tok, width: int):
        super().__init__(lambda s: [e.ids for e in tok.encode_batch_fast(s, add_special_tokens=False)], WORDS, width)
        self.tok, self.model = tok, tok.model
        mark = tok.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.pattern = word_pattern(tok)
        self.words: dict[str, bytes] = {}
        if self.pattern:
            from tokenizers.pre_tokenizers import ByteLevel

            # visible ASCII characters stand for themselves
            self.letters = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def pack(self, strings: list[str]) -> list[bytes]:
        if self.pattern is None:
            return self.joined(strings)
        get, cut, plain = self.words.get, self.pattern.findall, PLAIN.fullmatch
        out, rest, late, missing = [b""] * len(strings), [], [], {}
        for i, s in enumerate(strings):
            if len(s) > CACHE_CHUNK_CHARS or not plain(s):
                rest.append(i)
                continue
            words = cut(s.lower())
            parts = list(map(get, words))
            if None in parts:
                late.append((i, words))
                missing.update(dict.fromkeys(w for w, p in zip(words, parts) if p is None))
            else:
                out[i] = b"".join(parts)
        if missing:
            new = dict(zip(missing, self.model_ids(missing)))
            for i, words in late:
                out[i] = b"".join([new[w] if w in new else get(w) for w in words])
            room = CACHE_CHUNKS - len(self.words)
            self.words.update(list(new.items())[: max(0, room)])
        for i, packed in zip(rest, self.joined([strings[i] for i in rest])):
            out[i] = packed
        return out

    def model_ids(self, words: Iterable[str]) -> Iterator[bytes]:
        """Whole words, to which the model alone is left to apply."""
        code, ids, letters = "H" if self.width == 2 else "I", self.model.tokenize, self.letters
        for w in words:
            yield array(code, [t.id for t in ids(w if w.isascii() else letters(w)[0][0])]).tobytes()

    def joined(self, strings: list[str]) -> list[bytes]:
        if self.mark is None:
            return super().pack(strings)
        plain = [i for i, s in enumerate(strings) if s and self.MARK not in s and len(s) <= CACHE_CHUNK_CHARS]
        rest = sorted(set(range(len(strings))).difference(plain))
        out = [b""] * len(strings)
        for i, packed in zip(rest, super().pack([strings[i] for i in rest])):
            out[i] = packed
        for a in range(0, len(plain), self.JOINED):
            where = plain[a : a + self.JOINED]
            text = f" {self.MARK} ".join([strings[i] for i in where])
            # the batch call leaves out character offsets, which nothing here reads
            (got,) = self.tok.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(got.ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.mark)
            packed, at = ids.tobytes(), 0
            for i, cut in zip(where, [*(cuts * self.width).tolist(), len(packed)]):
                out[i] = packed[at:cut]
                at = cut + self.width
        return out


#: Fixed value: how a tokenizer may cut lower-cased text into words (the
#: pattern of the CLIP tokenizer); its classes of letters and digits are
#: these in plain text.
CUT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_pattern(tok) -> re.Pattern | None:
    """The pattern that cuts a lower-cased plain chunk as the tokenizer does,
    or None if the tokenizer is not of that kind."""
    made = json.loads(tok.to_str())
    normal = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    cut = {"type": "Split", "pattern": {"Regex": CUT_WORDS}, "behavior": "Removed", "invert": True}
    steps = (made["pre_tokenizer"] or {}).get("pretokenizers") or [None, {}]
    as_bytes = {k: v for k, v in steps[-1].items() if k != "trim_offsets"} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    same = made["normalizer"] == normal and len(steps) == 2 and steps[0] == cut and as_bytes
    if not same or not all(t["special"] for t in made["added_tokens"]):
        return None
    return re.compile(CUT_WORDS.replace(r"\p{L}", "a-z\u00df-\u00f6\u00f8-\u00ff").replace(r"\p{N}", "0-9"))


def load_tokenizer(path: str):
    """A tokenizer that takes control strings in a text as ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def id_width(n_ids: int) -> int:
    """Bytes per id: two while every id fits, else four."""
    return 2 if n_ids <= 1 << 16 else 4


def encoder(path: str, chunk: re.Pattern, width: int | None = None) -> ChunkEncoder:
    """The encoder of a tokenizer file, one per Python worker."""
    key = (path, chunk.pattern, width)
    if key not in _ENCODERS:
        tok = load_tokenizer(path)
        width = width or id_width(tok.get_vocab_size())
        _ENCODERS[key] = {BYTE_LEVEL: ByteLevelEncoder, WORDS: WordEncoder}[chunk](tok, width)
    return _ENCODERS[key]
