"""Words of texts as 64-bit hashes, without a Python object a word, and the vocabulary's files.

A word's hash is the sum of its bytes times odd random numbers, one for each
place, finished by a mixer. Two given words share a hash with a chance below
2**-56, and words that do are counted as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import files
from geoloom.llm.runs import key_runs

U64 = np.uint64
#: Bytes hashed together, tokens gathered before they are counted, rows of a shuffled piece.
BLOCK, GATHERED, PIECE = 1 << 16, 2_000_000, 4096
#: Slots of a worker's table of words seen; a word that falls on a used slot takes its place.
SLOTS = 1 << 19
#: Bytes of pieces that a worker hands over at once.
HANDED = 4 << 20
#: Splits of the input for each file of the vocabulary.
SPLITS_A_FILE, LEAST_BITS = 4, 4

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + U64(1)
_LOWER[65:91] += U64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def places(low: int, high: int) -> np.ndarray:
    return mix(np.arange(low, high, dtype=np.uint64) + U64(0x9E3779B97F4A7C15)) | U64(1)


_PLACES = places(0, 4096)


def finish(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(total + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def _long_word(data: np.ndarray) -> int:
    total = 0
    for low in range(0, len(data), BLOCK):
        part = data[low : low + BLOCK]
        total += int((_LOWER[part] * places(low, low + len(part))).sum(dtype=np.uint64))
    return int(finish(np.array([total % (1 << 64)], U64), np.array([len(data)]))[0])


def _block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin and their hashes; no word goes on across one of the cuts."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    code, at = _LOWER[data[inside]], np.flatnonzero(first)
    if not len(at):
        return at, np.zeros(0, U64)
    begin = np.flatnonzero(first[inside])
    length = np.diff(begin, append=len(code))
    place = np.arange(len(code)) - np.repeat(begin, length)
    longest = int(length.max())
    table = _PLACES if longest <= len(_PLACES) else places(0, longest)
    return at, finish(np.add.reduceat(code * table[place], begin), length)


END = int(finish(_LOWER[[10]] * _PLACES[:1], np.ones(1))[0])


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row and the number of tokens of each text; a null text is empty.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; an
    end token follows each text.
    """
    held = texts.cast(pa.large_string()).fill_null("")
    if not len(held):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    buffer = held.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    at, n, starts, hashes = 0, len(data), [], []
    while at < n:
        end = min(at + BLOCK, n)
        if end < n and not _SPACE[data[end]] and not _SPACE[data[end - 1]]:
            blank = np.flatnonzero(_SPACE[data[at:end]])
            cut = max(at + int(blank[-1]) + 1 if len(blank) else at, int(bounds[np.searchsorted(bounds, end, "right") - 1]))
            if cut <= at:
                # One word fills the block: hash it alone, up to the next blank or text.
                stop = int(bounds[np.searchsorted(bounds, at, "right")])
                while end < stop and not (blank := np.flatnonzero(_SPACE[data[end : end + BLOCK]])).size:
                    end += BLOCK
                end = min(stop, end + int(blank[0]) if end < stop else stop)
                starts.append(np.array([at]))
                hashes.append(np.array([_long_word(data[at:end])], U64))
                at = end
                continue
            end = cut
        inner = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, end, "left")] - at
        own, h = _block(data[at:end], inner)
        starts.append(own + at)
        hashes.append(h)
        at = end
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    lengths = np.diff(np.searchsorted(start, bounds)) + 1
    out = np.empty(int(lengths.sum()), U64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(lengths) - 1] = True
    out[last] = U64(END)
    if hashes:
        out[~last] = np.concatenate(hashes)
    return out, lengths


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of text, of one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group, low = np.cumsum(size) // most, 0
    for high in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
        if high > low:
            yield batch.slice(low, high - low)
        low = high


def piece_batches(pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The pieces in batches of about HANDED bytes."""
    parts, blobs, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "piece"])

    for part, blob in pieces:
        parts.append(part)
        blobs.append(blob)
        size += len(blob)
        if size >= HANDED:
            yield batch()
            parts, blobs, size = [], [], 0
    if parts:
        yield batch()


def buffers(pieces: pa.ChunkedArray) -> list[pa.Buffer]:
    """The pieces' bytes, not copied."""
    return [x.as_buffer() for x in pieces]


def by_part(pieces: DataFrame, parts: int) -> DataFrame:
    """The pieces in order of part, the parts dealt in turn to spark.sql.shuffle.partitions tasks."""
    tasks = min(parts, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")


def counted(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """(part, piece): hashes and counts of the words of all texts, dealt by the top bits of the hash."""

    def pieces(held: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        hashes, n = every[start], np.diff(start, append=len(every))
        del every, start
        part = (hashes >> U64(64 - bits)).astype(np.int64)
        cuts = np.union1d(np.flatnonzero(np.diff(part)) + 1, np.arange(0, len(part), PIECE))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
            yield int(part[a]), np.concatenate([hashes[a:b], n[a:b].astype(U64)]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                held.append(token_hashes(part.column(0))[0])
                size += len(held[-1])
                if size > GATHERED:
                    yield from piece_batches(pieces(held))
                    size = 0
        if size:
            yield from piece_batches(pieces(held))

    return docs.select(text).mapInArrow(run, "part long, piece binary")


def write_vocabulary(docs: DataFrame, text: str, root: str) -> list[tuple]:
    """Files of hashes in unsigned order, their counts and the running sums of those; (part, file, words, tokens) of each."""
    splits = docs.select(text).rdd.getNumPartitions()
    bits = max(LEAST_BITS, (splits // SPLITS_A_FILE).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in key_runs(batches, 1):
            part = shard.column(0)[0].as_py()
            pieces = [np.frombuffer(x, "<u8").reshape(2, -1) for x in buffers(shard.column(1))]
            every, n = np.concatenate([x[0] for x in pieces]), np.concatenate([x[1] for x in pieces])
            order = np.argsort(every)
            every, n = every[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            hashes, n = every[first], np.add.reduceat(n, first)
            name = f"words-{part:06d}-{uuid.uuid4().hex}"
            with files.create(f"{root}/{name}") as f:
                for x in (hashes.astype("<u8"), n.astype("<i8"), (np.cumsum(n) - n).astype("<i8")):
                    f.write(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["part", "file", "words", "tokens"])

    schema = "part long, file string, words long, tokens long"
    by_part(counted(docs, text, bits), 1 << bits).mapInArrow(run, schema).write.parquet(f"{root}/words")
    found = docs.sparkSession.read.schema(schema).parquet(f"{root}/words").collect()
    return [(bits, *r) for r in sorted(tuple(r) for r in found)]


class Vocabulary:
    """Words to ids, counts and places in the row of all tokens by id, over mapped files; unknown words have the id after the last."""

    def __init__(self, root: str, shards: list[tuple]):
        self.bits = shards[0][0] if shards else LEAST_BITS
        self.root, self.shards, self.opened = root, shards, {}
        self.parts = {s[1]: k for k, s in enumerate(shards)}
        self.first = np.concatenate([[0], np.cumsum([s[3] for s in shards], dtype=np.int64)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum([s[4] for s in shards], dtype=np.int64)]).astype(np.int64)
        self.size, self.tokens = int(self.first[-1]), int(self.before[-1])
        self.slot_hash = np.zeros(SLOTS, U64)
        self.slots = np.zeros((SLOTS, 3), np.int64)
        self.slots[:, 0] = self.size
        # Zero is a hash as well: its slot starts with what it stands for.
        self.slots[0] = self.find(np.zeros(1, U64))[0]

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.opened:
            n, data = self.shards[k][3], files.mapped(f"{self.root}/{self.shards[k][2]}")
            self.opened[k] = (data[: 8 * n].view("<u8"), data[8 * n : 16 * n].view("<i8"), data[16 * n :].view("<i8"))
        return self.opened[k]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """(id, count, tokens of lesser ids) of each hash, which are sorted."""
        out = np.zeros((len(hashes), 3), np.int64)
        out[:, 0] = self.size
        part = (hashes >> U64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(part)]):
            if high > low and int(part[low]) in self.parts:
                k = self.parts[int(part[low])]
                held, n, before = self.shard(k)
                at = np.minimum(np.searchsorted(held, hashes[low:high]), len(held) - 1)
                hit = np.flatnonzero(held[at] == hashes[low:high])
                at = at[hit]
                out[low + hit] = np.stack([self.first[k] + at, n[at], self.before[k] + before[at]], axis=1)
        return out

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id, count and tokens of lesser ids of each hash."""
        slot = (hashes & U64(SLOTS - 1)).astype(np.int64)
        out = self.slots[slot]
        missed = np.flatnonzero(self.slot_hash[slot] != hashes)
        if len(missed):
            new, back = np.unique(hashes[missed], return_inverse=True)
            found = self.find(new)
            out[missed] = found[back]
            to, one = np.unique((new & U64(SLOTS - 1)).astype(np.int64), return_index=True)
            self.slot_hash[to], self.slots[to] = new[one], found[one]
        return out[:, 0], out[:, 1], out[:, 2]

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known ids."""
        out = np.zeros(len(ids), np.int64)
        if len(ids):
            k = np.searchsorted(self.first, ids, "right") - 1
            for part in np.unique(k).tolist():
                own = np.flatnonzero(k == part)
                out[own] = self.shard(part)[1][ids[own] - self.first[part]]
        return out

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of (count + 1) / (tokens + words + 1)."""
        return np.log10((counts + 1) / (self.tokens + self.size + 1))

    def end(self) -> tuple[int, int, int]:
        return tuple(int(x[0]) for x in self.look_up(np.array([END], U64)))


