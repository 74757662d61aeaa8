"""Language-model scoring with an Elias-Fano n-gram trie (operator 6).

A trigram model by interpolated absolute discounting over add-one unigrams,
learned from all training texts. All words and bigrams are kept, and trigrams
seen KEPT times or more; the mass of the others backs off. Words are numbered in
order of a 64-bit hash.

The trie is read from the nearest word outwards. A shard covers a range of
middle words, with three levels: a middle word's successors (bigrams), the words
seen before it (contexts of kept trigrams) and, for each such context, its
successors as ranks among the successors of the middle word, which take few bits.
Each level is Elias-Fano coded in groups by parent, delimited by monotone
pointers, and a look-up is a successor search in the parent's group. Log probabilities and
backoff weights are 16-bit codes. All files are mapped into memory, so what a
worker holds doesn't grow with the model where the shared folder is mounted;
elsewhere it reads the shards whole.

Shards are cut by the number of tokens that follow their middle words, from the
vocabulary's running sums. A middle word with more than one shard's worth goes to
several: its contexts by a hash of the word before, its bigrams by a hash of the
word after. N-grams are counted per worker before they are shuffled.

A text is scored as its words and one end token, in windows of WINDOW tokens,
starting from two end tokens as context.

Defined cases: null text is the empty text (the end token alone); repeated rows
are each counted and scored; without training texts every unigram has
probability one; a null doc_id counts as training; texts are read whole, words
of any length; other columns are ignored; two words whose hashes are equal count
as one; 2**32 distinct words or more are refused with an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import files
from geoloom.llm.common import crc_mod, scratch, table
from geoloom.llm.elias_fano import EliasFano
from geoloom.llm.lm_words import PIECE, Vocabulary, buffers, by_part, mix, piece_batches, slices, token_hashes, write_vocabulary
from geoloom.llm.runs import key_runs
from geoloom.llm.worker import held

#: Least count of a trigram that is kept.
KEPT = 2
#: Tokens of a shard.
SHARD_TOKENS = 1_000_000
#: Tokens scored or counted together.
WINDOW = 500_000
#: Open shards of a worker.
OPEN = 4096
#: Log probabilities are coded in steps of FLOOR / 65535 below 0.
FLOOR = -16.0
BIG = 0xFFFFFFFF
U64 = np.uint64


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10p / FLOOR * 65535), 0, 65535).astype("<u2")


def unpacked(codes: np.ndarray) -> np.ndarray:
    return codes * (FLOOR / 65535)


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))


def dealt(first: np.ndarray, shards: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The shard of a middle word (its first shard and the number of them) and another word of the n-gram."""
    out = first.astype(np.int64)
    many = np.flatnonzero(shards > 1)
    if len(many):
        out[many] += (mix(other[many].astype(U64)) % shards[many].astype(U64)).astype(np.int64)
    return out


def shard_of(before: np.ndarray, counts: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """The shard of a middle word (its tokens of lesser ids and its count) and another word of the n-gram."""
    return dealt(before // most, -(-counts // most), other)


class Windows:
    """N-grams of a run of texts, in windows of tokens."""

    def __init__(self, words: Vocabulary, texts: pa.Array):
        self.words = words
        self.hashes, self.lengths = token_hashes(texts)
        self.end = words.end()

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """first token, end, and (id, count, tokens before) rows of each window's words before last, last and own."""
        starts = np.cumsum(self.lengths) - self.lengths
        for low in range(0, len(self.hashes), WINDOW):
            high = min(low + WINDOW, len(self.hashes))
            yield low, high, *self._window(low, high, starts)

    def _window(self, low: int, high: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        from_ = max(0, low - 2)
        found = np.stack(self.words.look_up(self.hashes[from_:high]))
        at = np.arange(low, high) - from_
        place = np.arange(low, high) - starts[np.searchsorted(starts, np.arange(low, high), "right") - 1]
        end = np.array(self.end)[:, None]
        last = np.where(place > 0, found[:, np.maximum(at - 1, 0)], end)
        first = np.where(place > 1, found[:, np.maximum(at - 2, 0)], end)
        return first, last, found[:, at]


def vocabulary(root: str, shards: list[tuple]) -> Vocabulary:
    return held(f"lm {root}", "words", lambda: Vocabulary(root, shards))


def narrowed(first: np.ndarray, last: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """A window in 20 bytes a token: ids of the word before, the middle word and the word, the middle word's first shard and number of shards."""
    return np.stack([x.astype("<u4") for x in (first[0], last[0], own[0], last[2] // most, -(-last[1] // most))])


def gram_pieces(tokens: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, piece) of the distinct trigrams of narrowed windows, and of the bigrams of middle words with several shards.

    A piece is four rows of 32-bit numbers: middle word, word, word before (BIG in
    a bigram), count. Keys are sorted in place, and what is no longer needed is let
    go, as a worker's memory has its peak here.
    """
    before, middle, own, first, shards = tokens
    key = middle.astype(U64) << U64(32) | own
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(new)
    key, lead, times = key[start], order[start], np.diff(start, append=len(order))
    first, shards = first[lead], shards[lead]
    whole = (np.cumsum(new) - 1).view(U64)
    whole <<= U64(32)
    whole |= before[order]
    del order, new, start, lead, before, middle, own, tokens
    whole.sort()
    start = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    n = np.diff(start, append=len(whole))
    whole = whole[start]
    del start
    pair = (whole >> U64(32)).astype(np.int64)
    many = np.flatnonzero(shards > 1)
    to = (key[many] & U64(BIG)).astype(np.int64)
    rows = np.empty((4, len(pair) + len(many)), "<u4")
    rows[0, : len(pair)], rows[0, len(pair) :] = (key >> U64(32))[pair], key[many] >> U64(32)
    rows[1, : len(pair)], rows[1, len(pair) :] = (key & U64(BIG))[pair], to
    rows[2, : len(pair)], rows[2, len(pair) :] = whole & U64(BIG), BIG
    rows[3, : len(pair)], rows[3, len(pair) :] = n, times[many]
    del whole, n, key, times
    part = np.concatenate([dealt(first[pair], shards[pair], rows[2, : len(pair)]), dealt(first[many], shards[many], to)])
    del pair
    if np.any(part[1:] < part[:-1]):
        order = np.argsort(part, kind="stable")
        part, rows = part[order], rows[:, order]
    cuts = np.union1d(np.flatnonzero(np.diff(part)) + 1, np.arange(0, len(part), PIECE))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
        yield int(part[a]), rows[:, a:b].tobytes()


def grams(docs: DataFrame, text: str, root: str, shards: list[tuple], most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(root, shards)
        gathered, size = [], 0

        def taken() -> np.ndarray:
            tokens = np.concatenate(gathered, axis=1)
            gathered.clear()
            return tokens

        for batch in batches:
            for part in slices(batch, 0):
                for low, high, *three in Windows(words, part.column(0)):
                    gathered.append(narrowed(*three, most))
                    size += high - low
                    del three
                    if size > 2 * WINDOW:
                        yield from piece_batches(gram_pieces(taken()))
                        size = 0
        if size:
            yield from piece_batches(gram_pieces(taken()))

    return docs.select(text).mapInArrow(run, "part long, piece binary")


class Shard:
    """Structure of a shard: three levels of Elias-Fano groups, then counts of the n-grams.

    successors: by middle word, the words after it; befores: by middle word, the
    words before it that are contexts; ranks: by context, ranks of its successors
    among those of its middle word.
    """

    def __init__(self, data: np.ndarray):
        self.first, self.contexts, at = *map(int, data[:16].view("<i8")), 16
        self.successors, at = EliasFano.load(data, at)
        self.befores, at = EliasFano.load(data, at)
        self.ranks, at = EliasFano.load(data, at)
        self.rest = data[at:]

    @staticmethod
    def dump(first: int, contexts: int, levels: list[EliasFano], rest: bytes) -> bytes:
        return np.array([first, contexts], "<i8").tobytes() + b"".join(x.dump() for x in levels) + rest

    def find(self, level: EliasFano, middle: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index at the level of each pair, and whether it is stored."""
        c = middle - self.first
        inside = (c >= 0) & (c < self.contexts)
        if not inside.all():
            at, found = level.find(np.where(inside, c, 0), word)
            return at, found & inside
        return level.find(c, word)

    def trigram(self, middle: np.ndarray, context: np.ndarray, bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the trigram of a stored context and a stored bigram of one middle word."""
        return self.ranks.find(context, bigram - self.successors.pointers[middle - self.first])


@dataclass
class Counts:
    """Counts beside a shard's structure: of bigrams (0: counted in another shard), contexts, kept trigrams."""

    bigrams: np.ndarray
    contexts: np.ndarray
    trigrams: np.ndarray

    def dump(self) -> bytes:
        """Bigrams in 16 bits, and those that don't fit listed."""
        large = np.flatnonzero(self.bigrams >= 65535)
        head = np.array([len(self.bigrams), len(large), len(self.contexts), len(self.trigrams)], "<i8").tobytes()
        wide = np.concatenate([large, self.bigrams[large], self.contexts, self.trigrams]).astype("<i8").tobytes()
        return head + wide + np.minimum(self.bigrams, 65535).astype("<u2").tobytes()

    @classmethod
    def load(cls, data: np.ndarray) -> Counts:
        n, large, contexts, trigrams = map(int, data[:32].view("<i8"))
        wide = data[32 : 32 + 8 * (2 * large + contexts + trigrams)].view("<i8")
        small = data[32 + 8 * len(wide) :][: 2 * n].view("<u2").astype(np.int64)
        small[wide[:large]] = wide[large : 2 * large]
        return cls(small, wide[2 * large : 2 * large + contexts], wide[2 * large + contexts :])


def count_shard(pieces: list[pa.Buffer], words: Vocabulary, most: int) -> tuple[bytes, np.ndarray, list[int], list[int]]:
    """A shard's structure and counts; how many bigrams and trigrams occur once and twice; middle words with several shards and their bigrams here."""
    rows = np.concatenate([np.frombuffer(x, "<u4").reshape(4, -1) for x in pieces], axis=1).astype(np.int64)
    first = int(rows[0].min())
    middle, n = rows[0] - first, rows[3]
    size = int(middle.max()) + 1
    pairs, pair = np.unique(middle << 32 | rows[1], return_inverse=True)
    tri = rows[2] != BIG
    context_of = pairs >> 32
    several = words.count_of(first + np.arange(size)) > most
    counted_here = ~tri | ~several[middle]
    bigrams = np.bincount(pair, weights=n * counted_here, minlength=len(pairs)).astype(np.int64)
    contexts, context = np.unique((middle << 32 | rows[2])[tri], return_inverse=True)
    triples, triple = np.unique(context << 32 | pair[tri], return_inverse=True)
    trigrams = np.bincount(triple, weights=n[tri], minlength=len(triples)).astype(np.int64)
    seen = np.bincount(context, weights=n[tri], minlength=len(contexts)).astype(np.int64)
    stats = np.array([np.sum(bigrams == 1), np.sum(bigrams == 2), np.sum(trigrams == 1), np.sum(trigrams == 2)], np.int64)

    kept = np.flatnonzero(trigrams >= KEPT)
    used, slot = np.unique(triples[kept] >> 32, return_inverse=True)
    contexts, seen = contexts[used], seen[used]
    middle_of = contexts >> 32
    kinds = np.bincount(context_of, minlength=size)
    pointers = np.cumsum(kinds) - kinds
    whole = np.full(size, words.size + 1)
    levels = [
        EliasFano.encode(pairs & BIG, kinds, whole),
        EliasFano.encode(contexts & BIG, np.bincount(middle_of, minlength=size), whole),
        EliasFano.encode((triples[kept] & BIG) - pointers[middle_of[slot]], np.bincount(slot, minlength=len(contexts)), kinds[middle_of]),
    ]
    own = np.flatnonzero(several)
    mine = np.bincount(context_of[bigrams > 0], minlength=size)[own]
    body = Shard.dump(first, size, levels, Counts(bigrams, seen, trigrams[kept]).dump())
    return body, stats, (first + own).tolist(), mine.tolist()


GRAMS = "part long, file string, stats array<long>, several array<long>, kinds array<long>"


def write_counts(pieces: DataFrame, root: str, shards: list[tuple], most: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(root, shards)
        for group in key_runs(batches, 1):
            part = group.column(0)[0].as_py()
            name = f"counts-{part:07d}-{uuid.uuid4().hex}"
            body, stats, several, kinds = count_shard(buffers(group.column(1)), words, most)
            with files.create(f"{root}/{name}") as f:
                f.write(body)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([stats.tolist()], many), pa.array([several], many), pa.array([kinds], many)], names=["part", "file", "stats", "several", "kinds"])

    tokens = sum(s[4] for s in shards)
    by_part(pieces, (tokens - 1) // most + 1).mapInArrow(run, GRAMS).write.parquet(f"{root}/grams")


@dataclass
class Model:
    """Handle of a written model: its folder, the names of its files, and what is known of it as a whole."""

    root: str
    shards: list[tuple]
    grams: dict[int, str]
    codes: dict[int, str]
    discounts: tuple[float, float]
    #: Middle words with several shards, in order, and the number of their successors.
    several: np.ndarray
    kinds: np.ndarray
    most: int

    @property
    def tokens(self) -> int:
        return sum(s[4] for s in self.shards)


class Reader:
    """A model, opened."""

    def __init__(self, model: Model):
        self.model, self.words = model, vocabulary(model.root, model.shards)
        self.opened: dict[int, tuple] = {}
        gamma = model.discounts[0] * model.kinds / np.maximum(1, self.words.count_of(model.several))
        self.several_backoff = quantise(np.log10(np.clip(gamma, 1e-300, 1)))

    def open(self, part: int) -> tuple | None:
        """(shard, codes of bigrams, of middle words, of contexts, of trigrams)"""
        if part not in self.model.grams:
            return None
        if part not in self.opened:
            if len(self.opened) >= OPEN:
                self.opened.clear()
            shard = Shard(files.mapped(f"{self.model.root}/{self.model.grams[part]}"))
            parts = [np.zeros(0, "<u2")] * 4
            if part in self.model.codes:
                data = files.mapped(f"{self.model.root}/{self.model.codes[part]}").view("<u2")
                ends = np.cumsum([shard.successors.n, shard.contexts, shard.befores.n, shard.ranks.n])
                parts = [data[b - n : b] for b, n in zip(ends, np.diff(ends, prepend=0))]
            self.opened[part] = (shard, *parts)
        return self.opened[part]

    def groups(self, parts: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each shard that there is, with the rows that go to it."""
        order = np.argsort(parts, kind="stable")
        cuts = np.flatnonzero(np.diff(parts[order])) + 1
        for own in np.split(order, cuts):
            if len(own) and (shard := self.open(int(parts[own[0]]))):
                yield shard, own

    def bigram_counts(self, middle: np.ndarray, counts: np.ndarray, before: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = np.zeros(len(to), np.int64)
        for (shard, *_), own in self.groups(shard_of(before, counts, to, self.model.most)):
            at, found = shard.find(shard.successors, middle[own], to[own])
            out[own[found]] = Counts.load(shard.rest).bigrams[at[found]]
        return out

    def codes(self, part: int) -> bytes:
        """Codes of a shard's bigrams, middle words, contexts and trigrams."""
        shard, words, model = self.open(part)[0], self.words, self.model
        d2, d3 = model.discounts
        n = Counts.load(shard.rest)
        middles = shard.first + np.arange(shard.contexts)
        total = words.count_of(middles)
        pointers = shard.successors.pointers.astype(np.int64)
        kinds = np.diff(pointers)
        place = np.minimum(np.searchsorted(model.several, middles), max(0, len(model.several) - 1))
        several = model.several[place] == middles if len(model.several) else np.zeros(len(middles), bool)
        kinds_all = np.where(several, model.kinds[place], kinds) if len(model.several) else kinds
        gamma = np.where(kinds > 0, np.minimum(1, d2 * kinds_all / np.maximum(1, total)), 1.0)
        of, to = shard.successors.values()
        unigram = (words.count_of(to) + 1) / (words.tokens + words.size + 1)
        count = n.bigrams
        elsewhere = np.flatnonzero(count == 0)
        if len(elsewhere):
            before = shard_tokens_before(words, middles[of[elsewhere]])
            count[elsewhere] = self.bigram_counts(middles[of[elsewhere]], total[of[elsewhere]], before, to[elsewhere])
        p2 = np.maximum(count - d2, 0) / np.maximum(1, total[of]) + gamma[of] * unigram

        middle_of = shard.befores.values()[0]
        slot, rank = shard.ranks.values()
        taken = np.bincount(slot, weights=n.trigrams - d3, minlength=len(middle_of))
        rest = np.clip(1 - taken / np.maximum(1, n.contexts), 1e-9, 1)
        p3 = (n.trigrams - d3) / n.contexts[slot] + rest[slot] * p2[pointers[middle_of[slot]] + rank]
        return b"".join(quantise(np.log10(np.maximum(x, 1e-300))).tobytes() for x in (p2, gamma, rest, p3))

    def score_window(self, first: np.ndarray, last: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's unigram probability and of its probability after the two before."""
        words, most = self.words, self.model.most
        uni = words.log_unigram(own[1])
        out = uni.copy()
        known = np.flatnonzero(last[1] > 0)
        middle, count, before = last[:, known]
        to, ahead = own[0, known], first[0, known]
        score = uni[known]
        several, stored = count > most, np.zeros(len(known), bool)
        for (shard, c2, g2, g3, c3), rows in self.groups(shard_of(before, count, to, most)):
            at, found = shard.find(shard.successors, middle[rows], to[rows])
            hit, miss = rows[found], rows[~found]
            score[hit] = unpacked(c2[at[found]])
            stored[hit] = True
            c = middle[miss] - shard.first
            inside = (c >= 0) & (c < shard.contexts)
            score[miss[inside]] += unpacked(g2[c[inside]])
            single = ~several[rows]
            self._above(shard, g3, c3, rows[single], at[single], found[single], middle, ahead, score)
        rows = np.flatnonzero(several)
        if len(rows):
            # A bigram that isn't stored has its middle word's own weight, whatever shard was asked.
            missing = rows[~stored[rows]]
            at = np.searchsorted(self.model.several, middle[missing])
            score[missing] = uni[known[missing]] + unpacked(self.several_backoff[at])
            for (shard, _, _, g3, c3), some in self.groups(shard_of(before[rows], count[rows], ahead[rows], most)):
                some = rows[some]
                at, found = shard.find(shard.successors, middle[some], to[some])
                self._above(shard, g3, c3, some, at, found, middle, ahead, score)
        out[known] = score
        return uni, out

    @staticmethod
    def _above(shard: Shard, g3: np.ndarray, c3: np.ndarray, rows: np.ndarray, bigram: np.ndarray, has: np.ndarray, middle: np.ndarray, ahead: np.ndarray, score: np.ndarray) -> None:
        """Put the trigram level on top of the scores of rows."""
        if not len(rows) or not shard.befores.n:
            return
        context, found = shard.find(shard.befores, middle[rows], ahead[rows])
        own = np.flatnonzero(found)
        score[rows[own]] += unpacked(g3[context[own]])
        own = own[has[own]]
        at, found = shard.trigram(middle[rows[own]], context[own], bigram[own])
        score[rows[own[found]]] = unpacked(c3[at[found]])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base score, score of each text."""
        windows = Windows(self.words, texts)
        n = len(windows.lengths)
        of = np.repeat(np.arange(n), windows.lengths)
        sums = np.zeros((3, n))
        for low, high, first, last, own in windows:
            uni, full = self.score_window(first, last, own)
            at = of[low:high]
            for total, x in zip(sums, (own[1] > 0, uni, full)):
                total += np.bincount(at, weights=x, minlength=n)
        return windows.lengths, sums[0].astype(np.int64), sums[1], sums[2]


def shard_tokens_before(words: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Tokens of lesser ids than each."""
    out = np.zeros(len(ids), np.int64)
    k = np.searchsorted(words.first, ids, "right") - 1
    for part in np.unique(k).tolist():
        own = np.flatnonzero(k == part)
        out[own] = words.before[part] + words.shard(part)[2][ids[own] - words.first[part]]
    return out


def reader(model: Model) -> Reader:
    """The model as a worker keeps it; one with codes is another than one without."""
    return held(f"lm {model.root}", len(model.codes), lambda: Reader(model))


def write_codes(spark: SparkSession, model: Model) -> dict[int, str]:
    """Second pass over the shards, when discounts and successors of all of them are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(model)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                name = f"codes-{part:07d}-{uuid.uuid4().hex}"
                with files.create(f"{model.root}/{name}") as f:
                    f.write(own.codes(part))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name])], names=["part", "file"])

    parts = spark.createDataFrame([(p,) for p in sorted(model.grams)], "part long").repartition(max(1, len(model.grams)), "part")
    parts.mapInArrow(run, "part long, file string").write.parquet(f"{model.root}/codes")
    return {r["part"]: r["file"] for r in spark.read.schema("part long, file string").parquet(f"{model.root}/codes").collect()}


def train(docs: DataFrame, root: str, text: str = "text", most: int = SHARD_TOKENS) -> Model:
    """The model of docs' texts, below the URI root."""
    spark = docs.sparkSession
    files.make_folder(root)
    shards = write_vocabulary(docs, text, root)
    none = np.zeros(0, np.int64)
    if not shards:
        return Model(root, [], {}, {}, (0.5, 0.5), none, none, most)
    if sum(s[3] for s in shards) >= BIG:
        raise ValueError("2**32 distinct words or more")
    write_counts(grams(docs, text, root, shards, most), root, shards, most)
    found = spark.read.schema(GRAMS).parquet(f"{root}/grams").collect()
    once2, twice2, once3, twice3 = np.sum([r["stats"] for r in found], axis=0).tolist()
    kinds: dict[int, int] = {}
    for r in found:
        for word, n in zip(r["several"], r["kinds"]):
            kinds[word] = kinds.get(word, 0) + n
    several = np.array(sorted(kinds), np.int64)
    model = Model(root, shards, {r["part"]: r["file"] for r in found}, {}, (discount_of(once2, twice2), discount_of(once3, twice3)), several, np.array([kinds[w] for w in several.tolist()], np.int64), most)
    model.codes = write_codes(spark, model)
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_tokens, n_known, base_score, score of every row."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(model)
        for batch in batches:
            for part in slices(batch, len(keep)):
                n, known, base, score = own.score(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 7) == 2, F.lit(False))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")).select("text"), scratch(spark, "lm"))
    scored = score_documents(docs, model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
