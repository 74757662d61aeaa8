"""N-gram Jaccard join by chosen paths (operator 1).

Links all documents whose sets of five-word shingles have Jaccard similarity of
0.8 or more. Equal sets form a class and are joined once. Classes go down random
trees: at each node the same one or two min-hash coordinates (1 / threshold on
average) are sampled for everyone there, and a set follows each to the child
named by its min-hash, a shingle that it shares with all who take that branch.
Small buckets are compared by brute force on sketches, larger ones split again,
and as many trees are grown as the target recall asks for, from the recurrence
of a pair's survival. Buckets that stay large at the last level are cut into
blocks and every pair of blocks is compared, so no bucket is capped.

Pairs that the sketches leave are joined into candidate components; a pair is in
one component, so links are counted once and no pair becomes a row. Small
components are verified on exact shingle sets as they are. Large ones, which
texts that share boilerplate may chain together, are cut into blocks: sketches of
all pairs of blocks are compared, and the shingle sets of a block's members go
only to the blocks in which a sketch is near theirs. Memory is bounded by two
blocks.

Result: one row per document with class_id (the least doc_id linked to it,
directly or through others), n_copies (documents with its shingle set) and
n_links (classes linked to its own).

Defined cases: null, empty and blank texts have no shingles and link to nothing;
a text of one to four words has one shingle, all its words; repeated rows and
texts that differ in white space only are copies; rows that share a doc_id are
judged by their texts; a null doc_id takes part and is never a class_id unless
all its class has none; other columns are ignored. Sets are compared by 64-bit
hashes of shingles, classes are named by 64 bits of a digest and kept apart by
128.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, quoted, table
from geoloom.llm.graph import components
from geoloom.llm.runs import key_runs
from geoloom.llm.worker import held
from geoloom.operators.hubs import hub_join, hubs_of

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
COORDINATES = 128
BUCKET = 512
DEPTH = 3
BLOCK = 256
BLOCK_SHINGLES = 300_000
#: Blocks of sketches that are compared at once.
BLOCKS_AT_ONCE = 4
#: Sketches are far apart if they agree less than a pair at the threshold by this many standard deviations, among candidates and in blocks.
DEVIATIONS, BLOCK_DEVIATIONS = 5, 7
MAX_WORDS = 500_000

U64 = np.uint64
_rng = np.random.default_rng(7)
_ODD = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_PLACE = _rng.integers(0, 1 << 62, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, n: int = N):
        import xxhash

        self.n, self.hash = n, xxhash.xxh64_intdigest
        self.words = re.compile(r"[^\x20\x09-\x0D]+").findall
        self.known: dict[str, int] = {}

    def word_hashes(self, text: str) -> np.ndarray:
        words, known = self.words(text), self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), U64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, U64)
        h = self.word_hashes(text)
        n = min(self.n, len(h))
        if not n:
            return h
        total = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            total += mix(h[k : len(h) - n + 1 + k] * _PLACE[k])
        return np.unique(mix(total + U64(n)))


def shingler(n: int) -> Shingler:
    return held("shingles", n, lambda: Shingler(n))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    low, high = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
    return int(low), int(high)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES min-hashes of a set, as unsigned 32-bit integers."""
    x, best = (shingles >> U64(32)).astype(np.uint32), np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 4096):
        best = np.minimum(best, (x[None, low : low + 4096] * _ODD[:, None] + _ADD[:, None]).min(axis=1))
    return best


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Two bits of each min-hash, packed: (rows, COORDINATES) -> (rows, COORDINATES / 32) unsigned 64-bit."""
    two = ((hashes * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8)
    bits = np.stack([two & 1, two >> 1], axis=-1).reshape(len(hashes), -1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def most_differing(threshold: float, deviations: float) -> int:
    """Coordinates in which the sketches of a pair with that similarity differ, at most; a coordinate agrees by chance in a quarter of cases."""
    p = threshold + (1 - threshold) / 4
    return math.ceil(COORDINATES * (1 - p) + deviations * math.sqrt(COORDINATES * p * (1 - p)))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each sketch of a differs from each of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        out += np.bitwise_count((x | (x >> U64(1))) & U64(0x5555555555555555))
    return out


def unpacked(sketches: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), "<u8").reshape(len(sketches), -1)


def survival(similarity: float, depth: int, children: float) -> float:
    """Chance that a pair of that similarity is together in some bucket at that depth of one tree."""
    whole, part = int(children), children - int(children)
    s = 1.0
    for _ in range(depth):
        miss = 1 - similarity * s
        s = 1 - miss**whole * (1 - part + part * miss)
    return s


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth, 1 / threshold))))


def children(paths: np.ndarray, hashes: np.ndarray, fan_out: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths of the children that each set goes to, and the row that each belongs to.

    What is sampled depends on the path alone. The second coordinate of a node
    that has one is never the first.
    """
    whole, rows = int(fan_out), np.arange(len(paths))
    out, own, first = [], [], None
    for k in range(whole + 1):
        draw = mix(paths ^ U64(0xA5A5 + k * 0x10001))
        at = (draw % U64(COORDINATES)).astype(np.int64) if k == 0 else (first + 1 + (draw % U64(COORDINATES - 1)).astype(np.int64) + k - 1) % COORDINATES
        first = at if k == 0 else first
        take = np.ones(len(paths), bool) if k < whole else (mix(draw + U64(1)) >> U64(11)).astype(np.float64) / float(1 << 53) < fan_out - whole
        out.append(mix(mix(paths + U64(k + 1)) ^ (hashes[rows, at].astype(U64) * _PLACE[9]))[take])
        own.append(rows[take])
    return np.concatenate(out), np.concatenate(own)


def signatures(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """key, digest (of the text), f1, f2 (digest of the shingle set), size, hashes (packed min-hashes) of each row."""
    named = docs.select(F.col(f"`{key}`").alias("key"), text_digest(text).alias("digest"), F.col(f"`{text}`").alias("text"))
    schema = named.drop("text").schema.add("f1", "long").add("f2", "long").add("size", "long").add("hashes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(n)
        for batch in batches:
            f1, f2, size, hashes = [], [], [], []
            for x in batch.column(2).to_pylist():
                s = own.shingles(x)
                a, b = fingerprint(s)
                f1.append(a)
                f2.append(b)
                size.append(len(s))
                hashes.append(min_hashes(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(size, pa.int64()), pa.array(hashes, pa.binary())], names=schema.names)

    return named.mapInArrow(run, schema)


def text_digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def plant(classes: DataFrame, runs: int, fan_out: float) -> DataFrame:
    """(f1, hashes) -> path, f1, sketch: the first split of every class in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            marks, ids = sketch(own), batch.column(0).to_numpy(zero_copy_only=False)
            for r in range(runs):
                root = mix(np.full(1, 0x5EED + r, U64))[0]
                to, row = children(np.full(len(ids), root, U64), own, fan_out)
                yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(ids[row]), packed(marks[row])], names=["path", "f1", "sketch"])

    return classes.select("f1", "hashes").mapInArrow(run, "path long, f1 long, sketch binary")


def split(rows: DataFrame, classes: DataFrame, fan_out: float) -> DataFrame:
    """The next level below the paths of (path, f1) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            to, row = children(batch.column(0).to_numpy(zero_copy_only=False).view(U64), own, fan_out)
            yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(batch.column(1).to_numpy(zero_copy_only=False)[row]), packed(sketch(own)[row])], names=["path", "f1", "sketch"])

    return rows.select("path", "f1").join(classes.select("f1", "hashes"), "f1").select("path", "f1", "hashes").mapInArrow(run, "path long, f1 long, sketch binary")


def packed(rows: np.ndarray) -> pa.Array:
    data, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * 8
    return pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    near = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pair_edges(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (path, f1, sketch) rows -> edges that connect each bucket's candidate components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for bucket in key_runs(batches, 1):
            if bucket.num_rows < 2:
                continue
            ids, marks = bucket.column(1).to_numpy(), unpacked(bucket.column(2))
            root = local_roots(differing(marks, marks) <= most)
            own = root != np.arange(len(ids))
            a.append(ids[own])
            b.append(ids[root[own]])
            if len(a) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def in_blocks(rows: DataFrame, blocks: str, group: str, member: str) -> DataFrame:
    """rows with bucket columns k1, i, j: every pair of a group's members is in exactly one (group, i, j).

    A member of block x of n goes to the n pairs of blocks with x in them.
    """
    own = F.pmod(F.xxhash64(member), F.col(blocks))
    out = rows.withColumn("_x", own).withColumn("_y", F.explode(F.expr(f"sequence(0L, {blocks} - 1)")))
    return out.withColumn("i", F.least("_x", "_y")).withColumn("j", F.greatest("_x", "_y")).withColumn("own", F.col("_x")).drop("_x", "_y").withColumnRenamed(group, "k1")


def candidate_edges(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges that connect every class to those that the trees bring it together with."""
    fan_out, found = 1 / threshold, None
    rows = materialize(plant(classes, runs_for(recall, threshold), fan_out), "paths")
    for depth in range(1, DEPTH + 1):
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = rows.join(counts, "path")
        leaves = sized.where(f"n <= {BUCKET}").select("path", "f1", "sketch")
        large = sized.where(f"n > {BUCKET}")
        if depth == DEPTH:
            cut = in_blocks(large.withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")), "blocks", "path", "f1")
            leaves = leaves.unionByName(cut.select(F.xxhash64("k1", "i", "j").alias("path"), "f1", "sketch"))
        dealt = leaves.repartition("path").sortWithinPartitions("path")
        edges = dealt.mapInArrow(pair_edges(most_differing(threshold, DEVIATIONS)), "a long, b long").distinct()
        found = edges if found is None else found.unionByName(edges)
        if depth < DEPTH:
            below = materialize(split(large, classes, fan_out), "paths")
            if below.isEmpty():
                break
            rows = below
    return found


def exact_links(ids: np.ndarray, own: np.ndarray, sets: list[np.ndarray], across: bool, threshold: float) -> np.ndarray:
    """Symmetric matrix of the pairs with similarity of at least the threshold; across: only between the two blocks."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        shared = np.array([[0, x := len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [x, 0]])
    else:
        row = np.repeat(np.arange(m), size)
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = times[at] > 1
        row, at = row[keep], np.unique(at[keep], return_inverse=True)[1]
        shared, width = np.zeros((m, m), np.float32), 8192
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        cuts = np.searchsorted(at, np.arange(0, (at[-1] if len(at) else 0) + width + 1, width))
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                dense = np.zeros((m, width), np.float32)
                dense[row[low:high], at[low:high] % width] = 1
                shared += dense @ dense.T
    union = size[:, None] + size[None, :] - shared
    linked = shared >= threshold * union - 1e-9
    if across:
        linked &= own[:, None] != own[None, :]
    np.fill_diagonal(linked, False)
    return linked


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(k1, i, j, own, f1, shingles) -> f1, links (verified in this bucket), root (least linked member here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, 3):
            ids, first = np.unique(group.column("f1").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            packed_sets = group.column("shingles")
            sets = [np.frombuffer(packed_sets[int(k)].as_py(), U64) for k in first]
            across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            linked = exact_links(ids, group.column("own").to_numpy()[first], sets, across, threshold)
            links = linked.sum(axis=1)
            has = links > 0
            if has.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has].astype(np.int64)), pa.array(ids[local_roots(linked)][has])], names=["f1", "links", "root"])

    dealt = rows.select("k1", "i", "j", "own", "f1", "shingles").repartition("k1", "i", "j").sortWithinPartitions("k1", "i", "j")
    return dealt.mapInArrow(run, "f1 long, links long, root long")


def near_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(f1, root, blocks, hashes) of large components -> (k1, i, j, own, f1): the pairs of blocks in which a member has a near sketch."""
    most, schema = most_differing(threshold, BLOCK_DEVIATIONS), "k1 long, i long, j long, own long, f1 long"

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(sketch(own))], names=["f1", "root", "blocks", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, 3):
            k1, low, high = (group.column(k)[0].as_py() for k in range(3))
            block, ids, marks = group.column("own").to_numpy(), group.column("f1").to_numpy(), unpacked(group.column("sketch"))
            held = {x: np.flatnonzero(block == x) for x in np.unique(block).tolist()}
            for i in held:
                for j in held:
                    if i > j or {i // BLOCKS_AT_ONCE, j // BLOCKS_AT_ONCE} != {low, high}:
                        continue
                    near = differing(marks[held[i]], marks[held[j]]) <= most
                    if i == j:
                        np.fill_diagonal(near, False)
                    kept = [held[i][near.any(axis=1)], *([held[j][near.any(axis=0)]] if i < j else [])]
                    for x, at in zip((i, j), kept):
                        if len(at):
                            same = lambda v: pa.array(np.full(len(at), v, np.int64))  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays([same(k1), same(i), same(j), same(x), pa.array(ids[at])], names=["k1", "i", "j", "own", "f1"])

    marked = members.select("f1", "root", "blocks", "hashes").mapInArrow(sketched, "f1 long, root long, blocks long, sketch binary")
    marked = marked.withColumn("own", F.pmod(F.xxhash64("f1"), F.col("blocks"))).withColumn("_x", F.expr(f"own div {BLOCKS_AT_ONCE}"))
    marked = marked.withColumn("_y", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {BLOCKS_AT_ONCE})")))
    dealt = marked.select(F.col("root").alias("k1"), F.least("_x", "_y").alias("si"), F.greatest("_x", "_y").alias("sj"), "own", "f1", "sketch")
    return dealt.repartition("k1", "si", "sj").sortWithinPartitions("k1", "si", "sj").mapInArrow(run, schema)


def candidate_sets(docs: DataFrame, wanted: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """wanted (key, digest, f1, f2, ...) with the shingles of the row that has that key, which may be null, and text."""
    own = wanted.withColumnRenamed("key", "_w_key").withColumnRenamed("digest", "_w_digest")
    texts = docs.select(F.col(f"`{key}`").alias("key"), text_digest(text).alias("digest"), F.col(f"`{text}`").alias("text"))
    texts = texts.join(own, F.col("key").eqNullSafe(F.col("_w_key")) & (F.col("digest") == F.col("_w_digest")))
    texts = texts.select("text", *[c for c in wanted.columns if c not in ("key", "digest")])
    schema = texts.drop("text").schema.add("shingles", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(n)
        for batch in batches:
            sets = [own.shingles(x) for x in batch.column(0).to_pylist()]
            f1, f2 = batch.column("f1").to_pylist(), batch.column("f2").to_pylist()
            same = [k for k, s in enumerate(sets) if fingerprint(s) == (f1[k], f2[k])]
            at = pa.array(same, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[1:]], pa.array([sets[k].tobytes() for k in same], pa.binary())], names=schema.names)

    return texts.mapInArrow(run, schema)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, n_copies, n_links, root (names the class; null without shingles), text_digest of every row of docs."""
    sig = materialize(signatures(docs, n, key, text), "signatures")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest")).alias("k")
    classes = sig.where("size > 0").groupBy("f1", "f2").agg(first, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("hashes").alias("hashes"))
    classes = materialize(classes.select("f1", "f2", "k.key", "k.digest", "copies", "size", "hashes"), "classes")
    grouped = components(candidate_edges(classes, threshold, recall), "candidates").withColumnRenamed("node", "f1")
    members = materialize(classes.select("key", "digest", "f1", "f2", "size", "hashes").join(grouped, "f1"), "members")
    extent = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    extent = extent.select("root", F.expr(f"greatest((n + {BLOCK - 1}) div {BLOCK}, (total + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES})").alias("blocks"))
    large = extent.where("blocks > 1")
    sized = hub_join(members, large, "root", hubs_of(members, ["root"], members.count())[0], "left")
    wanted = ["key", "digest", "f1", "f2", "root"]
    small = candidate_sets(docs, sized.where("blocks is null").select(*wanted), n, key, text)
    rows = small.select(F.col("root").alias("k1"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("own"), "f1", "shingles")
    if not large.isEmpty():
        sized = materialize(sized.where("blocks is not null"), "large")
        near = materialize(near_blocks(sized, threshold), "near")
        sets = candidate_sets(docs, sized.select(*wanted).join(near.select("f1").distinct(), "f1", "left_semi"), n, key, text)
        rows = rows.unionByName(near.join(sets.select("f1", "shingles"), "f1").select("k1", "i", "j", "own", "f1", "shingles"))
    checked = materialize(verify(rows, threshold), "links")
    links = checked.groupBy("f1").agg(F.sum("links").alias("n_links"))
    linked = components(checked.select(F.col("f1").alias("a"), F.col("root").alias("b")), "linked").withColumnRenamed("node", "f1")
    named = classes.select("f1", "f2", "key", "copies").join(links, "f1", "left").join(linked, "f1", "left")
    named = materialize(named.select("f1", "f2", "key", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "f1").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("key").alias("class_id"))
    named = hub_join(named, least, "root", hubs_of(named, ["root"], named.count())[0]).select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "class_id", "copies", "n_links", "root")
    whole = sig.select("key", "digest", "f1", "f2", "size").join(named, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left")
    return whole.select(
        F.col("key").alias(key),
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("key")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "root",
        F.col("digest").alias("text_digest"),
    )


def keep_first(docs: DataFrame, joined: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class, that of the least key (null last), then of the least digest of its text.

    A text without shingles is a class of its own, so all rows with one stay. Of
    rows equal in key and text one stays.
    """
    # One key of the join and of what follows it, so that texts are shuffled once.
    named = lambda k, digest: F.struct(F.coalesce(k.cast("string"), F.lit("")).alias("key"), k.isNull().alias("none"), digest.alias("digest"))
    least = F.min(F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.col("text_digest").alias("digest"))).alias("k")
    kept = joined.where("root is not null").groupBy("root").agg(least).select(named(F.col("k.key"), F.col("k.digest")).alias("at"))
    with_words = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(with_words).select(named(F.col(f"`{key}`"), text_digest(text)).alias("at"), F.struct(*quoted(docs.columns)).alias("doc"))
    one = rows.join(kept, "at").dropDuplicates(["at"])
    return one.select(*[F.col(f"doc.`{c}`") for c in docs.columns]).unionByName(docs.where(~with_words))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("root", "text_digest")
