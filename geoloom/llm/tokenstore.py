"""Token ids in binary shards, with a minimal perfect hash index (operator 7).

Documents are sorted by key over range partitions; each partition encodes its
texts and appends the ids to one shard file. A shard is raw ids, two bytes each
if the vocabulary allows it and else four. Index files map a document key to
(shard, offset, length): keys are dealt to index files by one hash, and inside a
file a minimal perfect hash (levels of bit arrays over a second hash, positions
counted by rank) gives each key its own slot, where a fingerprint from a third
hash tells a stored key from a stranger. Access to a document takes a constant
number of reads. A file name holds the partition and a random part, and only the
files of tasks that finished are listed, so a lost executor leaves at most
unlisted files.

Defined cases: null text is the empty text; rows that repeat a key are all
kept, numbered 0, 1, ... in order of a text hash, and indexed as (key, number);
a null key sorts first and is indexed like any other; an empty table gives a
store without shards; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm import files
from geoloom.llm.common import scratch, table
from geoloom.llm.worker import held

END_ID = 1
KEYS_PER_INDEX = 500_000
MAX_WORDS, LONG_WORD = 1_000_000, 200
GAMMA = 2.0
MAX_LEVELS = 48

MIX = 0x9E3779B97F4A7C15


#: Latin letters with ASCII marks after them, apostrophes apart: the model's rules split such a word into its letters, in lower case, and the marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder(dict):
    """A tokenizers model behind a cache: word -> its packed ids.

    Tokens never cross ASCII white space and no rule of the model looks past it,
    so a text's ids are those of its words in a row. The model's added tokens,
    which hold no white space, are found in texts as the library finds them. The
    letters and the marks of a plain word are asked of the library one by one, so
    letters seen before with other marks aren't asked for again, and letters of
    ASCII, which no rule changes or splits, are asked of its merges directly.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = re.compile(r"[^\x20\x09-\x0D]+").findall
        self.merges = self.model.model
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([END_ID], self.dtype).tobytes()

    def ids_of(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            ids = [t.id for t in self.merges.tokenize(word)]
        else:
            ids = self.model.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain and (plain[2] or word != word.lower()):
            packed = self[plain[1].lower()] + (self[plain[2]] if plain[2] else b"")
        else:
            packed = self.ids_of(word)
        if len(word) < LONG_WORD:
            self[word] = packed
        return packed

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        if len(self) > MAX_WORDS:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, self.words(x or ""))) + self.end for x in texts]


def encoder(path: str) -> WordEncoder:
    return held("words", path, lambda: WordEncoder(path))


def mix(h: np.ndarray, level: int) -> np.ndarray:
    """A further hash of 64-bit hashes for each level."""
    x = h ^ np.uint64((level + 1) * MIX & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of the first set bit that it hits.

    A bit is set where exactly one of the level's keys falls; the others go on to
    the next level. Keys that no level parts (equal 64-bit hashes) are listed.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = []
        total = 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.concatenate([[0], np.cumsum(counts)[:-1]]))
            total += int(counts.sum())
        self.placed = total

    @classmethod
    def build(cls, hashes: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        levels, left = [], hashes
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            levels.append(bits)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A slot for each hash, -1 for hashes that were never built in and show it."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = mix(hashes[todo], level) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.ranks[level][word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.searchsorted(self.rest, hashes[todo])
            ok = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == hashes[todo])
            out[todo[ok]] = self.placed + at[ok]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], "<u8")
        return b"".join([head.tobytes(), *[x.tobytes() for x in self.levels], self.rest.astype("<u8").tobytes()])

    @classmethod
    def load(cls, data: np.ndarray) -> tuple[PerfectHash, int]:
        """The hash and the number of bytes it takes."""
        n, rest = map(int, data[:16].view("<u8"))
        sizes = data[16 : 16 + 8 * n].view("<u8").astype(np.int64)
        at, levels = 16 + 8 * n, []
        for size in sizes:
            levels.append(data[at : at + 8 * size].view("<u8"))
            at += 8 * int(size)
        return cls(levels, data[at : at + 8 * rest].view("<u8")), at + 8 * rest


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def key_hashes(key: str, number: str) -> list[Column]:
    """Three hashes of (key, number): to deal keys, to place them, and to tell them apart."""
    return [F.xxhash64(F.lit(salt), F.col(f"`{key}`"), F.col(number)) for salt in ("deal", "place", "print")]


def write_shards(docs: DataFrame, root: str, tokenizer: str, shards: int, key: str, text: str) -> DataFrame:
    """Write the shard files; (key, number, shard, file, offset, n) of each document, where offset counts ids.

    number: how many rows of the same key precede it in its shard.
    """
    picked = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    ordered = picked.repartitionByRange(shards, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))
    schema = picked.select("key").schema.add("number", "long").add("shard", "integer").add("file", "string").add("offset", "long").add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids{8 * own.dtype.itemsize}"
        out, at, last, number = None, 0, object(), -1
        try:
            for batch in batches:
                out = out or files.create(f"{root}/{name}")
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                numbers, offsets, counts = [], [], []
                for low in range(0, len(texts), 256):
                    for packed in own.encode(texts[low : low + 256]):
                        k = keys[len(counts)]
                        number = number + 1 if k == last else 0
                        last = k
                        numbers.append(number)
                        offsets.append(at)
                        counts.append(len(packed) // own.dtype.itemsize)
                        at += counts[-1]
                        out.write(packed)
                rows = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(numbers, pa.int64()), pa.array([shard] * rows, pa.int32()), pa.array([name] * rows), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())],
                    names=["key", "number", "shard", "file", "offset", "n"],
                )
        finally:
            if out:
                out.close()

    return ordered.mapInArrow(run, schema)


def number_across(entries: DataFrame) -> DataFrame:
    """entries with number counted over all shards.

    Only a shard's first key can have rows in earlier shards, where it is the last
    key; so one row a shard tells how far each first key has been counted.
    """
    ends = entries.groupBy("shard").agg(F.min_by("key", "offset").alias("first"), F.max_by("key", "offset").alias("last"), (F.max_by("number", "offset") + 1).alias("last_n"))
    earlier = ends.select(F.col("shard").alias("before"), F.col("last").alias("last_key"), F.col("last_n").alias("last_count"))
    known = ends.join(earlier, ends["first"].eqNullSafe(earlier["last_key"]) & (F.col("before") < F.col("shard")))
    shift = known.groupBy("shard", "first").agg(F.sum("last_count").alias("shift")).select(F.col("shard").alias("at_shard"), F.col("first").alias("at_key"), "shift")
    joined = entries.join(shift, (F.col("shard") == F.col("at_shard")) & F.col("key").eqNullSafe(F.col("at_key")), "left")
    return joined.select("key", (F.col("number") + F.coalesce("shift", F.lit(0))).alias("number"), "shard", "file", "offset", "n")


def write_index(entries: DataFrame, root: str, per_file: int = KEYS_PER_INDEX) -> DataFrame:
    """Write the index files; (deal, index_file, keys) of each."""
    spark = entries.sparkSession
    parts = max(1, -(-entries.count() // per_file))
    deal, place, mark = key_hashes("key", "number")
    rows = entries.select(F.pmod(deal, F.lit(parts)).alias("deal"), place.alias("place"), mark.alias("mark"), "shard", "offset", "n")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = pdf["place"].to_numpy(np.int64).view(np.uint64)
        placed = PerfectHash.build(hashes)
        slots = np.zeros(len(pdf), SLOT)
        to = placed.slots(hashes)
        if len(placed.rest):
            tied = np.flatnonzero(to >= placed.placed)
            to[tied[np.argsort(to[tied], kind="stable")]] = placed.placed + np.arange(len(tied))
        slots["fingerprint"][to] = pdf["mark"].to_numpy(np.int64).view(np.uint64).astype(np.uint32)
        for c in ("shard", "offset", "n"):
            slots[c][to] = pdf[c].to_numpy()
        name = f"index-{int(pdf['deal'].iloc[0]):06d}-{uuid.uuid4().hex}.mph"
        with files.create(f"{root}/{name}") as f:
            f.write(placed.dump())
            f.write(slots.tobytes())
        return pd.DataFrame({"deal": [pdf["deal"].iloc[0]], "index_file": [name], "keys": [len(pdf)], "parts": [parts]})

    path = f"{root}/index"
    rows.groupBy("deal").applyInPandas(build, "deal long, index_file string, keys long, parts long").write.parquet(path)
    return spark.read.schema("deal long, index_file string, keys long, parts long").parquet(path)


class Index:
    """One index file, opened for look-ups."""

    def __init__(self, uri: str):
        data = files.mapped(uri)
        self.hash, at = PerfectHash.load(data)
        self.slots = data[at:].view(SLOT)

    def find(self, place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are stored, and the slots of those. Keys with equal hashes are told apart by fingerprint."""
        place, mark = place.view(np.uint64), mark.view(np.uint64).astype(np.uint32)
        at = self.hash.slots(place)
        tied = np.flatnonzero(at >= self.hash.placed)
        for k in tied:
            while at[k] + 1 < len(self.slots) and self.slots["fingerprint"][at[k]] != mark[k] and self.hash.rest[at[k] + 1 - self.hash.placed] == place[k]:
                at[k] += 1
        found = at >= 0
        found[found] = self.slots["fingerprint"][at[found]] == mark[found]
        return found, self.slots[at[found]]


def write_store(docs: DataFrame, root: str, tokenizer: str, shards: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Write shards, index and manifests below the URI root.

    shards: by default one for each split of the input, so that a shard grows no
    larger than what a split's texts give, and no fewer than shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select(F.col(f"`{text}`")).rdd.getNumPartitions())
    files.make_folder(root)
    written = write_shards(docs, root, tokenizer, shards, key, text)
    written.write.parquet(f"{root}/entries")
    entries = spark.read.schema(written.schema).parquet(f"{root}/entries")
    sizes = entries.groupBy("shard", "file").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("first_id", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{root}/shards")
    write_index(number_across(entries), root)


def look_up(keys: DataFrame, root: str) -> DataFrame:
    """(key, number) rows -> those with shard, offset and n, for the keys that the index has."""
    spark = keys.sparkSession
    index = spark.read.schema("deal long, index_file string, keys long, parts long").parquet(f"{root}/index")
    parts = max(1, index.count())
    deal, place, mark = key_hashes("key", "number")
    asked = keys.select("key", "number", F.pmod(deal, F.lit(parts)).alias("deal"), place.alias("place"), mark.alias("mark"))
    asked = asked.join(index.select("deal", "index_file"), "deal")
    schema = keys.select("key", "number").schema.add("shard", "integer").add("offset", "long").add("n", "long")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, Index] = {}
        for pdf in batches:
            for name, part in pdf.groupby("index_file", sort=False):
                if name not in open_:
                    open_[name] = Index(f"{root}/{name}")
                found, slots = open_[name].find(part["place"].to_numpy(np.int64), part["mark"].to_numpy(np.int64))
                yield part.loc[found, ["key", "number"]].assign(shard=slots["shard"].astype(np.int32), offset=slots["offset"].astype(np.int64), n=slots["n"].astype(np.int64))

    return asked.mapInPandas(find, schema)


def read_documents(located: DataFrame, root: str) -> DataFrame:
    """Located keys -> key, start (ids before the document in the whole store), n_tokens, ids_crc32 from the shard files."""
    spark = located.sparkSession
    shards = spark.read.schema("shard int, file string, ids long, first_id long").parquet(f"{root}/shards")
    rows = located.join(shards.select("shard", "file", "first_id"), "shard")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "offset")
    schema = located.select("key").schema.add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, data = None, None
        for pdf in batches:
            crcs = []
            for file, offset, n in zip(pdf["file"], pdf["offset"], pdf["n"]):
                if file != name:
                    name, data, kind = file, files.Ranges(f"{root}/{file}"), np.dtype("<u2" if file.endswith("16") else "<u4")
                crcs.append(zlib.crc32(data.read(offset * kind.itemsize, n * kind.itemsize).view(kind).astype("<u4")))
            yield pd.DataFrame({"key": pdf["key"], "start": pdf["first_id"] + pdf["offset"], "n_tokens": pdf["n"], "ids_crc32": crcs})

    return rows.select("key", "file", "first_id", "offset", "n").mapInPandas(read, schema)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and store every document, then read each back through the index."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "token-store")
    write_store(docs, root, public_tokenizers.path("word_bpe_49k.json"))
    copies = docs.groupBy(F.col("doc_id").alias("key")).count()
    keys = copies.select("key", F.explode(F.expr("sequence(0L, count - 1)")).alias("number"))
    back = read_documents(look_up(keys, root), root)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
