"""Media columns from ISO base media files (MP4 and its kin).

``inspect`` walks the nested boxes of a file, decodes the sample tables and
gives codec, duration and the byte ranges of the keyframes; no payload is
decoded. ``build`` writes such a file around given bytes, as unsigned 8-bit
audio samples, 64 to a table entry.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import ship

#: Bytes of one sample-table entry; payloads are padded to a multiple of it.
BLOCK = 64
#: Table entries in a chunk; the first of each chunk is marked as a sync sample.
CHUNK = 16
#: 8-bit samples a second.
RATE = 8000
#: Boxes that only hold other boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta")

IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def build(payload: bytes) -> bytes:
    """An ISO media file with one audio track of unsigned 8-bit samples that are ``payload``."""
    if len(payload) % BLOCK:
        raise ValueError("the payload must be padded")
    entries = len(payload) // BLOCK
    chunks = -(-entries // CHUNK)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom", b"mp41")

    def movie(first: int) -> bytes:
        offsets = [first + i * CHUNK * BLOCK for i in range(chunks)]
        wide = bool(offsets) and offsets[-1] >= 1 << 32
        runs = [(1, min(CHUNK, entries), 1)] if chunks == 1 or not entries % CHUNK else [(1, CHUNK, 1), (chunks, entries % CHUNK, 1)]
        sound = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), sound),
            _full(b"stts", struct.pack(">III", 1, entries, BLOCK)),
            _full(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, entries + 1, CHUNK))),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", BLOCK, entries)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        length = len(payload)
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"bytes\0"),
            info,
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), IDENTITY, bytes(8), version=1, flags=7), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, length, 0x10000, 0x100), IDENTITY, bytes(24), struct.pack(">I", 2), version=1), track)

    large = len(payload) + 8 >= 1 << 32
    first = len(head) + len(movie(1 << 32 if large else 0)) + (16 if large else 8)
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((head, movie(first), mdat, payload))


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes at one level; stops at a box that is cut off."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                return
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def _walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    for n, (kind, a, b) in enumerate(boxes(data, start, end)):
        here = (*path, (kind, n))
        yield here, a, b
        if kind in CONTAINERS and len(path) < 16:
            yield from _walk(data, a, b, here)


def _table(data: bytes, a: int, b: int, form: str, at: int = 4) -> list[tuple]:
    """The rows of a full box's table: a count at ``at``, then rows of ``form``."""
    (count,) = struct.unpack_from(">I", data, a + at)
    width = struct.calcsize(">" + form)
    count = min(count, (b - a - at - 4) // width)
    return list(struct.iter_unpack(">" + form, data[a + at + 4 : a + at + 4 + count * width]))


def _sizes(data: bytes, kind: bytes, a: int, b: int) -> tuple[list[int] | None, int, int]:
    """(sizes or None, the common size, the number of samples)."""
    if kind == b"stz2":
        bits, count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        raw = data[a + 12 : b]
        if bits == 4:
            sizes = [x for v in raw for x in (v >> 4, v & 15)][:count]
        else:
            sizes = [x for (x,) in struct.iter_unpack(">B" if bits == 8 else ">H", raw[: count * bits // 8])]
        return sizes, 0, len(sizes)
    common, count = struct.unpack_from(">II", data, a + 4)
    if common:
        return None, common, count
    sizes = [x for (x,) in _table(data, a, b, "I", at=8)]
    return sizes, 0, len(sizes)


def _track(data: bytes, parts: dict[bytes, tuple[int, int]]) -> dict:
    out = {"handler": None, "codec": None, "timescale": None, "duration": None, "samples": 0, "keyframes": [], "ranges": [], "error": None}
    if b"hdlr" in parts:
        a = parts[b"hdlr"][0]
        out["handler"] = data[a + 8 : a + 12].decode("latin-1")
    if b"mdhd" in parts:
        a = parts[b"mdhd"][0]
        out["timescale"], units = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        out["duration"] = units / out["timescale"] if out["timescale"] else None
    if b"stsd" in parts:
        a, b = parts[b"stsd"]
        out["codec"] = next((k.decode("latin-1") for k, _, _ in boxes(data, a + 8, b)), None)
    sized = next((k for k in (b"stsz", b"stz2") if k in parts), None)
    placed = next((k for k in (b"stco", b"co64") if k in parts), None)
    if b"stts" in parts and out["timescale"]:
        out["duration"] = sum(n * d for n, d in _table(data, *parts[b"stts"], "II")) / out["timescale"]
    if not (sized and placed and b"stsc" in parts):
        return out
    sizes, common, count = _sizes(data, sized, *parts[sized])
    offsets = [x for (x,) in _table(data, *parts[placed], "I" if placed == b"stco" else "Q")]
    runs = _table(data, *parts[b"stsc"], "III")
    spans, done = [], 0
    # a table may claim any number of samples; a file has no more of them than bytes
    if count > len(data):
        out["error"], count = "more samples than bytes", len(data)
    for i, (first, each, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
        for at in offsets[max(0, first - 1) : last]:
            for _ in range(min(each, count - done)):
                size = common if sizes is None else sizes[done]
                spans.append((at, at + size))
                at += size
                done += 1
    if any(end > len(data) for _, end in spans):
        out["error"] = out["error"] or "samples lie beyond the end of the file"
    sync = [x - 1 for (x,) in _table(data, *parts[b"stss"], "I")] if b"stss" in parts else range(len(spans))
    return out | {"samples": len(spans), "ranges": spans, "keyframes": [spans[i] for i in sync if 0 <= i < len(spans)]}


def inspect(data: bytes | None) -> dict:
    """brand, tracks, error of a file; tables that are cut off or missing leave nulls and an error, never an exception.

    Samples beyond the file's end are given as its tables have them, and named
    in ``error``; of more samples than bytes only so many are read, so work is
    in proportion to the file.
    """
    out: dict = {"brand": None, "tracks": [], "error": None}
    if not data:
        return out | {"error": "empty"}
    tracks: dict[tuple, dict[bytes, tuple[int, int]]] = {}
    for path, a, b in _walk(data):
        kind = path[-1][0]
        if kind == b"ftyp":
            out["brand"] = data[a : a + 4].decode("latin-1")
        if kind == b"trun":
            out["error"] = "fragments: samples of moof boxes are not read"
        owner = next((path[: i + 1] for i, (k, _) in enumerate(path) if k == b"trak"), None)
        if owner is not None:
            tracks.setdefault(owner, {}).setdefault(kind, (a, b))
    for parts in tracks.values():
        try:
            out["tracks"].append(track := _track(data, parts))
            out["error"] = out["error"] or track["error"]
        except (struct.error, IndexError) as e:
            out["error"] = f"broken track: {e}"
    if not out["tracks"] and not out["error"]:
        out["error"] = "no track"
    return out


def read_back(data: bytes) -> bytes:
    """The bytes of the first track's samples, in order, by its sample tables."""
    found: list[tuple[int, int]] = []
    for a, b in inspect(data)["tracks"][0]["ranges"]:
        if found and found[-1][1] == a:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return b"".join(data[a:b] for a, b in found)


COLUMNS = (
    "struct<brand: string, tracks: array<struct<codec: string, handler: string, duration: double, samples: bigint, "
    "keyframes: array<struct<begin: bigint, end: bigint>>>>, error: string>"
)


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with a struct column ``media`` of its binary column: brand, and of every track
    codec, handler, duration in seconds, samples and keyframe byte ranges [begin, end).

    Null or empty content, and files that are not ISO media, are cut off or keep
    samples in movie fragments, say so in ``error``; what their tables hold is
    given all the same. An existing column ``media`` is replaced.
    """
    ship(df.sparkSession)
    track = pa.struct(
        [
            ("codec", pa.string()),
            ("handler", pa.string()),
            ("duration", pa.float64()),
            ("samples", pa.int64()),
            ("keyframes", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        ]
    )
    kind = pa.struct([("brand", pa.string()), ("tracks", pa.list_(track)), ("error", pa.string())])

    @F.arrow_udf(COLUMNS)
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for x in column:
            found = inspect(x.as_py())
            tracks = [{k: t[k] for k in ("codec", "handler", "duration", "samples")} | {"keyframes": [{"begin": a, "end": b} for a, b in t["keyframes"]]} for t in found["tracks"]]
            rows.append({"brand": found["brand"], "tracks": tracks, "error": found["error"]})
        return pa.array(rows, kind)

    return df.withColumn("media", of(F.col(content)))


def encode_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, content): each whole text in UTF-8, padded, as an ISO media file; null counts as empty."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                raw = [b or b"" for b in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([build(padded(b)) for b in raw], pa.binary())], ["doc_id", "n_bytes", "content"]
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(encode, f"doc_id {kind}, n_bytes long, content binary")


def _parts(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes, so that memory follows bytes and not rows."""
    step = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def digests(files: DataFrame) -> DataFrame:
    """Per file of ``encode_texts``: what is read back from its stored bytes, and its features.

    keyframe_ranges are the byte ranges [begin, end) of the keyframes in the
    stored file. Equal files get equal rows; null ids are kept; extra columns
    are left out; no file, no row.
    """
    ship(files.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration", "keyframes", "feature", "keyframe_ranges"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for x in batch.column(2):
                data = x.as_py()
                track = inspect(data)["tracks"][0]
                payload = read_back(data)
                keys = track["keyframes"]
                feature = f"{track['handler']}/{track['codec'].strip()} {track['duration']:.6f}s {track['samples']} samples {len(keys)} keyframes {keys[0][0]}-{keys[-1][1]}"
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), track["codec"], track["duration"], len(keys), feature, [{"begin": a, "end": b} for a, b in keys])
                )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "n_bytes", "content").mapInArrow(
        measure,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, codec string, duration double, keyframes long, feature string, keyframe_ranges array<struct<begin: bigint, end: bigint>>",
    )
