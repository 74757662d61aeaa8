"""Matroska media columns (operator 5).

The writer stores a payload as 8-bit PCM samples in one audio track: blocks of
laced frames inside clusters, with a cue for each cluster. The reader walks EBML
elements of any size and order, undoes Xiph, EBML and fixed-size lacing, and
gives a packet table: track, timestamp, key flag and byte range of each frame.
The frames of a laced block follow each other by the track's frame duration, or
by equal parts of the block's where only that is known. A block of a group is a
key block unless it refers to another. A range of time is read from the cluster
that the cues name.
One row is one file, and files are handled one at a time, so memory is bounded
by the longest text.

Defined cases: null text is the empty text, stored as 64 zero bytes; equal texts
give equal files; a damaged or null file gives no packets and a null feature;
unknown-size segments and clusters end at the next element of their level; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.common import table

#: Element ids of the format.
EBML, DOC_TYPE, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH, LACING = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, BLOCK_DURATION, FRAME_NS = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B, 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK, INFO, AUDIO, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE = 8000
SCALE_NS = 125_000
FRAME = 1024
LACE = 8
BLOCKS = 3
PAD = 64
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6


def size_bytes(n: int) -> bytes:
    """A length as a variable-length integer of the least width."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_size(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < (1 << 7 * width - 1):
        width += 1
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frame count and sizes as the lacing kind writes them, then the frames."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0]) + b"".join(signed_size(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, per_block: int = LACE, per_cluster: int = BLOCKS) -> bytes:
    """A complete file; a function of the payload alone."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, number(TIMESTAMP_SCALE, SCALE_NS) + element(DURATION, struct.pack(">d", len(payload))) + element(MUXER, b"geoloom") + element(WRITER, b"geoloom"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING, 1) + number(FRAME_NS, frame * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for low in range(0, len(frames), per_block * per_cluster):
        blocks = []
        for k in range(low, min(low + per_block * per_cluster, len(frames)), per_block):
            group = frames[k : k + per_block]
            kind = NO_LACING if len(group) == 1 else FIXED if len(group[0]) == len(group[-1]) else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (k - low) * frame) + bytes([0x80 | kind]) + lace(group, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, low * frame) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, number(CLUSTER_TIME, low * frame) + b"".join(blocks)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, key, offset, size); cues: (time in ns, track, offset of the cluster)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    blocks: int = 0


class Damaged(ValueError):
    pass


def read_size(data: bytes, at: int, marked: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 is the unknown size. marked: keep the length mark (element ids)."""
    if at >= len(data) or not data[at]:
        raise Damaged("bad integer")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged("cut off")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    if marked:
        return raw, at + width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body); an unknown size reaches to `end`."""
    while at < end:
        name, at = read_size(data, at, True)
        n, at = read_size(data, at)
        stop = end if n < 0 else at + n
        if stop > end:
            raise Damaged("an element is longer than its parent")
        yield name, at, stop
        at = stop


def cluster_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: before the next top-level element."""
    while at < end:
        name, body = read_size(data, at, True)
        if name in TOP:
            return at
        n, body = read_size(data, body)
        at = body + max(n, 0)
    return end


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames in a block's body."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACING:
        size, at = read_size(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            raw, at = read_size(data, at)
            raw = (1 << 7 * (at - start)) - 1 if raw < 0 else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * (at - start) - 1) - 1))
        sizes = sizes[: n - 1]
    else:
        if (end - at) % n:
            raise Damaged("frames of unequal size")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged("bad lacing")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def top_level(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(id, offset in the segment, start of body, end of body) of the segment's elements."""
    segment = next(((at, end) for name, at, end in elements(data, 0, len(data)) if name == SEGMENT), None)
    if segment is None:
        raise Damaged("no segment")
    at, end = segment
    while at < end:
        start = at
        name, at = read_size(data, at, True)
        n, at = read_size(data, at)
        stop = (cluster_end(data, at, end) if name == CLUSTER else end) if n < 0 else at + n
        if stop > end:
            raise Damaged("an element is longer than its parent")
        yield name, start - segment[0], at, stop
        at = stop


def parse(data: bytes, low_ns: int | None = None, high_ns: int | None = None) -> Media:
    """Raises Damaged where the bytes are not a well-formed file.

    With a range of time, clusters before the last cue at or before it and those
    that begin after it are skipped, and only packets that begin in it are given.
    """
    media, clusters = Media(), []
    for name, start, at, stop in top_level(data):
        if name == CLUSTER:
            media.clusters.append(start)
            clusters.append((at, stop))
        elif name == INFO:
            for k, a, b in elements(data, at, stop):
                if k == TIMESTAMP_SCALE:
                    media.scale = int.from_bytes(data[a:b], "big")
                elif k == DURATION:
                    media.duration = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
        elif name == TRACKS:
            for k, a, b in elements(data, at, stop):
                if k == TRACK:
                    media.tracks.append(read_track(data, a, b))
        elif name == CUES:
            for k, a, b in elements(data, at, stop):
                if k == CUE_POINT:
                    read_cue(data, a, b, media)
    media.cues = [(time * media.scale, track, at) for time, track, at in media.cues]
    steps = {t.get("number"): t["frame_ns"] for t in media.tracks if t.get("frame_ns")}
    from_ = max((at for time, _, at in media.cues if low_ns is not None and time <= low_ns), default=0)
    for start, (at, stop) in zip(media.clusters, clusters):
        if start >= from_:
            if not read_cluster(data, at, stop, media, steps, high_ns):
                break
    if low_ns is not None or high_ns is not None:
        inside = lambda t: (low_ns is None or t >= low_ns) and (high_ns is None or t < high_ns)
        media.packets = [p for p in media.packets if inside(p[1])]
    return media


def read_track(data: bytes, at: int, end: int) -> dict:
    out = {}
    for k, a, b in elements(data, at, end):
        if k in (TRACK_NUMBER, TRACK_TYPE):
            out["number" if k == TRACK_NUMBER else "type"] = int.from_bytes(data[a:b], "big")
        elif k == FRAME_NS:
            out["frame_ns"] = int.from_bytes(data[a:b], "big")
        elif k == CODEC:
            out["codec"] = data[a:b].decode("ascii", "replace")
        elif k == AUDIO:
            for j, c, d in elements(data, a, b):
                if j == FREQUENCY:
                    out["rate"] = struct.unpack(">d" if d - c == 8 else ">f", data[c:d])[0]
                elif j in (CHANNELS, BIT_DEPTH):
                    out["channels" if j == CHANNELS else "bits"] = int.from_bytes(data[c:d], "big")
    return out


def read_cue(data: bytes, at: int, end: int, media: Media) -> None:
    time = 0
    for k, a, b in elements(data, at, end):
        if k == CUE_TIME:
            time = int.from_bytes(data[a:b], "big")
        elif k == CUE_POSITIONS:
            own = {j: int.from_bytes(data[c:d], "big") for j, c, d in elements(data, a, b)}
            media.cues.append((time, own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, -1)))


def read_cluster(data: bytes, at: int, end: int, media: Media, steps: dict[int, int], high_ns: int | None = None) -> bool:
    """Add a cluster's packets; False, and none, where it begins at high_ns or after."""
    base = 0
    for k, a, b in elements(data, at, end):
        if k == CLUSTER_TIME:
            base = int.from_bytes(data[a:b], "big")
            if high_ns is not None and base * media.scale >= high_ns:
                return False
        elif k == SIMPLE_BLOCK:
            read_block(data, a, b, base, media, steps, None, 0)
        elif k == BLOCK_GROUP:
            own = {j: (c, d) for j, c, d in elements(data, a, b)}
            long = own.get(BLOCK_DURATION, (0, 0))
            if BLOCK in own:
                read_block(data, *own[BLOCK], base, media, steps, REFERENCE not in own, int.from_bytes(data[long[0] : long[1]], "big"))
    return True


def read_block(data: bytes, at: int, end: int, base: int, media: Media, steps: dict[int, int], key: bool | None, duration: int) -> None:
    """key: None where the block's own flag tells."""
    track, at = read_size(data, at)
    if at + 3 > end:
        raise Damaged("cut off")
    time, flags = (base + struct.unpack(">h", data[at : at + 2])[0]) * media.scale, data[at + 2]
    media.blocks += 1
    frames = unlace(data, at + 3, end, flags & 6)
    step = steps.get(track) or duration * media.scale // len(frames)
    for k, (offset, size) in enumerate(frames):
        media.packets.append((track, time + k * step, bool(flags & 0x80) if key is None else key, offset, size))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's bytes, padded with zeros to a positive multiple of PAD, and their number before that."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % PAD if raw else PAD)


def read_packets(media: bytes | None, low_ns: int | None = None, high_ns: int | None = None) -> tuple[Media, bytes] | None:
    """The packet table and the track's bytes in packet order; None for a null or damaged file."""
    if media is None:
        return None
    try:
        found = parse(media, low_ns, high_ns)
    except (Damaged, IndexError, struct.error):
        return None
    return found, b"".join(media[o : o + n] for _, _, _, o, n in found.packets)


def feature(found: Media, samples: bytes) -> str:
    """Structure and level of the track, in whole numbers."""
    indexed = sum(c[2] in found.clusters for c in found.cues)
    last = found.packets[-1][1] // 1_000_000 if found.packets else 0
    total = sum(samples)
    return (
        f"codec={found.tracks[0].get('codec') if found.tracks else ''};tracks={len(found.tracks)};clusters={len(found.clusters)};cues={indexed};blocks={found.blocks};"
        f"packets={len(found.packets)};last_ms={last};samples={len(samples)};mean={total // max(1, len(samples))};peak={max(samples, default=0)};zeros={samples.count(0)}"
    )


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each text as one Matroska file."""
    schema = docs.select(key).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                own = [payload_of(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in own], pa.int64()), pa.array([mux(p) for _, p in own], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, schema)


def packet_table(stored: DataFrame, media: str = "media", key: str = "doc_id", low_ns: int | None = None, high_ns: int | None = None) -> DataFrame:
    """One row per frame (that begins in the range of time): key, track, timestamp_ns, is_key, offset, size."""
    schema = stored.select(key).schema.add("track", "long").add("timestamp_ns", "long").add("is_key", "boolean").add("offset", "long").add("size", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = read_packets(batch.column(1)[row].as_py(), low_ns, high_ns)
                if found and found[0].packets:
                    track, time, is_key, offset, size = zip(*found[0].packets)
                    own = batch.column(0).take(pa.array([row] * len(track)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(track, pa.int64()), pa.array(time, pa.int64()), pa.array(is_key, pa.bool_()), pa.array(offset, pa.int64()), pa.array(size, pa.int64())], names=[key, "track", "timestamp_ns", "is_key", "offset", "size"])

    return stored.select(key, media).mapInArrow(run, schema)


def digest(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media -> digests of the payload that the packets give back, of the file, and its feature."""
    schema = stored.select(key, "n_bytes").schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                media = value.as_py()
                found = read_packets(media)
                stored_form = (len(media), hashlib.sha256(media).hexdigest()) if media is not None else (None, None)
                if found is None:
                    rows.append((None, None, None, *stored_form, None))
                else:
                    data = found[1]
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), *stored_form, feature(found[0], data)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return stored.select(key, "n_bytes", "media").mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents")))
