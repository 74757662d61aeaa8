"""Byte-level BPE encoding and decoding (operator 4).

Encoding runs a transducer over the bytes of each piece that the split pattern
yields. Three facts make it possible: the encoding of a prefix ends in exactly
one token; the encoding of prefix i is that of prefix j plus token t if t spans
j..i and no merge would cross from the token that ends at j into t; and only
positions whose following bytes begin some token can matter later. A state is
thus the set of such live positions, each with its place in the token trie, the
token that ends there and the tokens not yet emitted. Tokens that all live
positions share are emitted, so output lags input by the bytes still in doubt.
States are made when first reached and kept up to a limit, then dropped.

Decoding joins token bytes and cuts the stream at character ends with an
incremental UTF-8 machine, so a chunk never ends inside a character.

Defined cases: null text encodes as the empty text (no ids); repeated rows
encode alike; a text is encoded whole, whatever its length; other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.common import table
from geoloom.llm.worker import held

MAX_STATES = 280_000
MAX_PIECES = 300_000
CHUNK = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Merges:
    """Token bytes, how each token was last merged, and whether two tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.last_merge: dict[int, tuple[int, int]] = {}
        self.reachable = set()
        for token, i in ranks.items():
            parts = self.merge(token, stop=2)
            if len(parts) == 1 or (len(parts) == 2 and ranks.get(parts[0] + parts[1]) == i):
                self.reachable.add(i)
                if len(parts) == 2:
                    self.last_merge[i] = (ranks[parts[0]], ranks[parts[1]])

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Plain BPE: merge the pair of least rank, the leftmost of equals, until `stop` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            least, at = min(((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1)))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def adjacent(self, a: int, b: int) -> bool:
        """Whether BPE of a's bytes followed by b's bytes is a, b.

        Goes back through the merges that made a's right edge and b's left edge,
        the later one first. A pair that faced each other across the border would
        have merged if its rank came before the merges that consumed its halves;
        on equal ranks the one further left comes first.
        """
        a_next = b_next = 1 << 60
        while True:
            crossing = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if crossing is not None and crossing < a_next and crossing <= b_next:
                return False
            whole_a, whole_b = a not in self.last_merge, b not in self.last_merge
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                a_next, a = a, self.last_merge[a][1]
            else:
                b_next, b = b, self.last_merge[b][0]


class State:
    __slots__ = ("final", "live", "moves")

    def __init__(self, live: tuple, final: tuple):
        self.live, self.final, self.moves = live, final, {}


class Transducer:
    """bytes -> token ids, determinised on the way."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in merges.ranks.items():
            if i in merges.reachable:
                node = 0
                for b in token:
                    if b not in self.trie[node]:
                        self.trie[node][b] = len(self.trie)
                        self.trie.append({})
                        self.token_at.append(-1)
                    node = self.trie[node][b]
                self.token_at[node] = i
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(((0, -1, ()),), ())

    def state(self, live: tuple, final: tuple) -> State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State(live, final)
        return found

    def move(self, state: State, byte: int) -> tuple[State, tuple]:
        """The next state, and the tokens that are now certain."""
        live, ended = [], None
        for node, last, pending in state.live:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and ended is None and (last < 0 or self.merges.adjacent(last, token)):
                ended = (0, token, (*pending, token))
            if self.trie[child]:
                live.append((child, last, pending))
        live.append(ended)
        # What all ways agree on; mostly the first has nothing decided yet, or is the only one.
        sure = live[0][2]
        for _, _, p in live:
            if not sure:
                break
            if p[: len(sure)] != sure:
                n = 0
                while n < len(p) and n < len(sure) and p[n] == sure[n]:
                    n += 1
                sure = sure[:n]
        if sure:
            n = len(sure)
            live = [(node, last, p[n:]) for node, last, p in live]
        to = self.state(tuple(live), live[-1][2])
        state.moves[byte] = (to, sure)
        return to, sure

    def encode(self, piece: bytes) -> list[int]:
        whole = self.merges.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        state, out = self.start, []
        for byte in piece:
            step = state.moves.get(byte)
            state, sure = step if step is not None else self.move(state, byte)
            if sure:
                out.extend(sure)
        out.extend(state.final)
        return out


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 64:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.merges = Merges(load_ranks(ranks_path))
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(Transducer(self.merges))

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; special tokens are ordinary text."""
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))

    def decode(self, packed: bytes, chunk: int = CHUNK) -> Iterator[bytes]:
        """Pieces of the text's bytes that end at character ends."""
        ids = memoryview(packed).cast("I").tolist() if packed else []
        get, step = self.merges.bytes_of.__getitem__, max(1, chunk // 8)
        return stream_characters((b"".join(map(get, ids[k : k + step])) for k in range(0, len(ids), step)), chunk)


#: UTF-8: first and last lead byte, and the ranges of the bytes that must follow.
ANY = (0x80, 0xBF)
LEADS = (
    (0xC2, 0xDF, (ANY,)), (0xE0, 0xE0, ((0xA0, 0xBF), ANY)), (0xE1, 0xEC, (ANY, ANY)), (0xED, 0xED, ((0x80, 0x9F), ANY)), (0xEE, 0xEF, (ANY, ANY)),
    (0xF0, 0xF0, ((0x90, 0xBF), ANY, ANY)), (0xF1, 0xF3, (ANY, ANY, ANY)), (0xF4, 0xF4, ((0x80, 0x8F), ANY, ANY)),
)
AFTER_LEAD = {byte: need for low, high, need in LEADS for byte in range(low, high + 1)}


class Utf8Machine:
    """Incremental: its state is what the character begun still needs, and is kept from one piece of bytes to the next."""

    def __init__(self):
        self.need: tuple = ()
        self.begun = 0

    def step(self, byte: int) -> None:
        """A byte that the character begun can't have ends that one, whose bytes then stand alone, and may begin another."""
        if self.need and self.need[0][0] <= byte <= self.need[0][1]:
            self.need, self.begun = self.need[1:], self.begun + 1
        else:
            self.need = AFTER_LEAD.get(byte, ())
            self.begun = 1
        if not self.need:
            self.begun = 0

    def feed(self, data: bytes) -> int:
        """How many bytes of data there are up to the end of the last whole character, or byte that stands alone.

        A byte that no character goes on with leads to the same state from any, so
        of a long piece only what follows the last of those is stepped through.
        """
        start = 0
        for k in range(len(data) - 1, max(-1, len(data) - 5), -1):
            if not 0x80 <= data[k] <= 0xBF:
                start = k
                self.need, self.begun = (), 0
                break
        else:
            if len(data) > 4:
                # Four such bytes or more: the last of them stands alone, whatever was before.
                start = len(data)
                self.need, self.begun = (), 0
        for byte in data[start:]:
            self.step(byte)
        return max(0, len(data) - self.begun)


def stream_characters(tokens: Iterable[bytes], chunk: int = CHUNK) -> Iterator[bytes]:
    """Join token bytes and yield them in parts of about `chunk` bytes cut at character ends."""
    machine, tail, held, size = Utf8Machine(), b"", [], 0
    for token in tokens:
        held.append(token)
        size += len(token)
        if size >= chunk:
            data = b"".join(held)
            cut = machine.feed(data)
            # The tail is of a character begun before; it goes as soon as that is whole, or found not to be one.
            if cut or machine.begun < len(tail) + len(data):
                part = tail + data
                end = len(part) - machine.begun
                yield part[:end]
                tail = part[end:]
            else:
                tail += data
            held, size = [], 0
    if rest := tail + b"".join(held):
        yield rest


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return held("bpe", (ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (packed little-endian unsigned 32-bit integers)."""
    schema = docs.select(key).schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            ids = pa.array([own.encode(x) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids): encode, then decode the ids as a stream."""
    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = schema.add("ids", "binary") if with_ids else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for x in batch.column(1).to_pylist():
                packed = own.encode(x)
                decoded = hashlib.sha256()
                for part in own.decode(packed):
                    decoded.update(part)
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(decoded.hexdigest())
                if with_ids:
                    ids.append(packed)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if with_ids else columns, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    """Path of the multi-language rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), *vocabulary())
