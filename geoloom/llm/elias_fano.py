"""Elias-Fano coded groups of increasing numbers over memory-mapped bytes, with vectorised look-ups."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ONE = U64(1)
#: Every STEP-th clear bit has its word noted.
STEP = 32

_BYTE = np.arange(256)
#: Position of the k-th set bit of a byte, at 8 * byte + k.
IN_BYTE = np.zeros(2048, np.uint8)
for _bit in range(7, -1, -1):
    _has = (_BYTE >> _bit) & 1 == 1
    IN_BYTE[(8 * _BYTE + np.bitwise_count(_BYTE & ((1 << _bit) - 1)))[_has]] = _bit


def select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word, which has that many."""
    k = k.astype(np.uint64)
    s = words - ((words >> U64(1)) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + ((s >> U64(2)) & U64(0x3333333333333333))
    s = ((s + (s >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * U64(0x0101010101010101)
    low = U64(0x8080808080808080)
    whole = np.bitwise_count((((k * U64(0x0101010101010101)) | low) - s) & low).astype(np.uint64) * U64(8)
    whole = np.minimum(whole, U64(56))
    k = k - (((s << U64(8)) >> whole) & U64(255))
    return whole.astype(np.int64) + IN_BYTE[(((words >> whole) & U64(255)) << U64(3) | k).astype(np.int64)]


class EliasFano:
    """Groups of increasing numbers, each group below a universe of its own.

    A group of n numbers below u keeps the low floor(log2(u / n)) bits of each
    packed and the rest in unary, after those of the groups before it; monotone
    pointers tell where its numbers, its unary part and its low bits begin. So
    each group is as dense as any other, and a successor search looks at one or
    two numbers.
    """

    def __init__(self, n: int, pointers: np.ndarray, high_at: np.ndarray, low_at: np.ndarray, low_bits: np.ndarray, lows: np.ndarray, highs: np.ndarray, before: np.ndarray, notes: np.ndarray):
        self.n, self.pointers, self.high_at, self.low_at, self.low_bits = n, pointers, high_at, low_at, low_bits
        self.lows, self.highs, self.before, self.notes = lows, highs, before, notes

    @classmethod
    def encode(cls, values: np.ndarray, sizes: np.ndarray, universe: np.ndarray) -> EliasFano:
        """values: increasing within each group; sizes and universe: of each group."""
        n, sizes, universe = len(values), sizes.astype(np.int64), universe.astype(np.int64)
        low_bits = np.maximum(0, np.frexp((universe // np.maximum(sizes, 1)).astype(np.float64))[1] - 1)
        before = lambda x: np.concatenate([[0], np.cumsum(x)])
        pointers, low_at = before(sizes), before(sizes * low_bits)
        high_at = before(np.where(sizes > 0, (universe >> low_bits) + 1, 0))
        if max(low_at[-1], high_at[-1] + n) >> 32:
            raise ValueError("over 2**32 bits in one sequence")
        group = np.repeat(np.arange(len(sizes)), sizes)
        own, rank = low_bits[group], np.arange(n) - pointers[group]
        lows = pack(values & ((1 << own) - 1), own, low_at[group] + rank * own, int(low_at[-1]))
        bits = np.zeros(-(-(int(high_at[-1]) + n + 1) // 64) * 64, np.uint8)
        bits[high_at[group] + (values >> own) + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little").view("<u8")
        ones = before(np.bitwise_count(highs).astype(np.int64))
        clear = np.arange(len(ones)) * 64 - ones
        notes = np.minimum(np.searchsorted(clear, np.arange(0, int(clear[-1]), STEP), "right") - 1, len(highs) - 1)
        return cls(n, *[x.astype("<u4") for x in (pointers, high_at, low_at)], low_bits.astype(np.uint8), lows, highs, ones.astype("<u4"), notes.astype("<u4"))

    def start(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a lesser unary part: those before its last clear bit."""
        k = np.maximum(high - 1, 0)
        at = self.notes[k // STEP].astype(np.int64)
        for _ in range(2):
            at += ((at + 1) << 6) - self.before[at + 1] <= k
        todo = np.flatnonzero(((at + 1) << 6) - self.before[at + 1] <= k)
        while len(todo):
            at[todo] += 1
            todo = todo[((at[todo] + 1) << 6) - self.before[at[todo] + 1] <= k[todo]]
        bit = (at << 6) + select_in_word(~self.highs[at], k - ((at << 6) - self.before[at]))
        return np.where(high > 0, bit + 1 - high, 0)

    def find(self, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number of the group that is no less than each value, and whether it is equal."""
        low_bits = self.low_bits[group].astype(np.int64)
        high = self.high_at[group] + (value >> low_bits)
        low = value & ((1 << low_bits) - 1)
        low_at = self.low_at[group] - self.pointers[group].astype(np.int64) * low_bits
        index = np.where(self.pointers[group] < self.pointers[group + 1], self.start(high), self.pointers[group])
        equal = np.zeros(len(value), bool)
        todo = np.flatnonzero(self.pointers[group] < self.pointers[group + 1])
        while len(todo):
            at, bits = index[todo], low_bits[todo]
            bit = at + high[todo]
            inside = (self.highs[bit >> 6] >> (bit & 63).astype(np.uint64)) & ONE == ONE
            own = np.where(inside, unpack(self.lows, bits, np.where(inside, low_at[todo] + at * bits, 0)), np.int64(1) << 62)
            mine = low[todo]
            equal[todo] = own == mine
            todo = todo[own < mine]
            index[todo] += 1
        return index, equal

    def values(self) -> tuple[np.ndarray, np.ndarray]:
        """Group and value of every number."""
        group = np.repeat(np.arange(len(self.low_bits)), np.diff(self.pointers))
        bits = self.low_bits[group].astype(np.int64)
        at = np.flatnonzero(np.unpackbits(self.highs.view(np.uint8), bitorder="little"))
        high = at - np.arange(self.n) - self.high_at[group]
        rank = np.arange(self.n) - self.pointers[group]
        return group, high << bits | unpack(self.lows, bits, self.low_at[group] + rank * bits)

    def dump(self) -> bytes:
        """In whole 8-byte words."""
        small = np.concatenate([self.pointers, self.high_at, self.low_at, self.before, self.notes]).astype("<u4").tobytes() + self.low_bits.tobytes()
        head = np.array([self.n, len(self.low_bits), len(self.lows), len(self.highs), len(self.notes)], "<u8")
        return b"".join([head.tobytes(), self.lows.astype("<u8").tobytes(), self.highs.astype("<u8").tobytes(), small, bytes(-len(small) % 8)])

    @classmethod
    def load(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """Views of the bytes from `at` on, and where they end."""
        n, groups, lows, highs, notes = map(int, data[at : at + 40].view("<u8"))
        at, parts = at + 40, []
        for size, kind in ((lows, "<u8"), (highs, "<u8"), *[(groups + 1, "<u4")] * 3, (highs + 1, "<u4"), (notes, "<u4"), (groups, "<u1")):
            parts.append(data[at : at + size * int(kind[2])].view(kind))
            at += size * int(kind[2])
        low, high, pointers, high_at, low_at, before, noted, bits = parts
        return cls(n, pointers, high_at, low_at, bits, low, high, before, noted), -(-at // 8) * 8


def pack(values: np.ndarray, widths: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of given widths at increasing bit positions, in 64-bit words with one to spare."""
    words = np.zeros(-(-bits // 64) + 1, np.uint64)
    some = np.flatnonzero(widths > 0)
    if len(some):
        values, widths, at = values[some].astype(np.uint64), widths[some], at[some]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # Values don't overlap, so the parts that meet in a word can be added up.
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[start]] = np.add.reduceat(values << shift, start)
        over = (at & 63) + widths > 64
        words[word[over] + 1] += values[over] >> (U64(64) - shift[over])
    return words


def unpack(words: np.ndarray, widths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of given widths (below 63) at bit positions."""
    word, shift = at >> 6, at & 63
    out = words[word] >> shift.astype(np.uint64)
    over = np.flatnonzero(shift + widths > 64)
    out[over] |= words[word[over] + 1] << (64 - shift[over]).astype(np.uint64)
    return out.astype(np.int64) & ((1 << widths) - 1)
