"""Word and sequence hashes in numpy, shared by the line and n-gram operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two sequence hashes (modulo 2**64).
BASES = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, kept as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


class Sequence:
    """Hashes of any stretch of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, powers: Powers):
        self.up, self.down = powers.upto(len(values) + 2)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]


#: The lowest 0 to 8 bytes of a 64-bit value.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one at a time.
_SHORT = 16


class ByteWords:
    """Hashes of the words (runs other than space and 0x09-0x0D) of a byte string.

    No sum of powers: a word's bytes are mixed, not added up, so that no two words agree by the way they are built.
    """

    def __init__(self) -> None:
        self.space = np.zeros(256, dtype=np.int8)
        self.space[[9, 10, 11, 12, 13, 32]] = 1

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        codes = np.frombuffer(data + bytes(_SHORT), dtype=np.uint8)
        edge = np.diff(self.space[codes[: len(data)]], prepend=np.int8(1), append=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = ends - starts
        eight = np.lib.stride_tricks.as_strided(codes[:8].view("<u8"), shape=(len(codes) - 7,), strides=(1,))
        low, high = eight[starts] & _LOW[np.minimum(n, 8)], eight[starts + 8] & _LOW[np.clip(n - 8, 0, 8)]
        found = mix(mix(low ^ np.uint64(BASES[0])) + mix(high ^ np.uint64(BASES[1])) * np.uint64(0x9FB21C651E98DF25) + n.astype(np.uint64))
        for i in np.flatnonzero(n > _SHORT).tolist():
            found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
        return found, starts


def stretch_ids(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128-bit hashes, as two columns, of stretches of a sequence of 64-bit values."""
    whole = np.ascontiguousarray(values).tobytes()
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(whole[x:y]) for x, y in zip((a * 8).tolist(), (b * 8).tolist(), strict=True)]), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
