"""Elias-Fano lists: non-decreasing integers in close to the fewest bits.

A value below ``u`` among ``n`` keeps its ``l = floor(log2(u / n))`` low bits
in a packed array and its high part in unary (value ``i`` sets bit
``high + i``), about ``2 + l`` bits each.  A sample of every 256th set bit
lets ``select`` find one value without decoding the list.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 256


class EliasFano:
    """``n`` values from packed ``low``, unary ``high`` and ``samples``."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.bits = n, bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, (int(v[-1]) + 1) // n).bit_length() - 1
        bits = max(0, bits)
        low = b""
        if bits:
            weight = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> weight) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        flags = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").tobytes()
        return cls(n, bits, low, high, ones[::SAMPLE].astype("<u4").tobytes())

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes

    def _low(self, start: int, count: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(count, dtype=np.int64)
        first = start * self.bits
        raw = self.low[first // 8 : ((start + count) * self.bits + 7) // 8]
        flat = np.unpackbits(raw, bitorder="little")[first % 8 :][: count * self.bits]
        return flat.reshape(count, self.bits).astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value ``i``: from the sample before it, count set bits onwards."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        want, byte = i % SAMPLE, at // 8
        skip = at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:])
            if len(ones) > want:
                position = byte * 8 + skip + int(ones[want])
                break
            want, byte, skip = want - len(ones), byte + 64, 0
        return ((position - i) << self.bits) | int(self._low(i, 1)[0])

    def run(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop - 1``, decoded between two samples."""
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        first, after = start // SAMPLE, -(-stop // SAMPLE)
        byte = int(self.samples[first]) // 8
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little")) + byte * 8
        ones = ones[ones >= int(self.samples[first])][start - first * SAMPLE :][: stop - start]
        return ((ones - np.arange(start, stop)) << self.bits) | self._low(start, stop - start)

    def values(self) -> np.ndarray:
        """All values."""
        return self.run(0, self.n)
