"""Media columns: ISO media containers written and read by their boxes."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import others

#: Bytes of a sample of the containers that ``contain`` writes: mono 8-bit PCM, this many bytes a sample.
SAMPLE = 192
TIMESCALE = 8000
#: Every so many samples one is marked as a keyframe.
KEYFRAME_EVERY = 8
#: Samples of a chunk: what the offset table points to.
CHUNK = 32
#: Boxes that hold boxes.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def contain(payload: bytes) -> bytes:
    """An ISO media file with ``payload``, a positive multiple of SAMPLE bytes, as 8-bit PCM samples, byte for byte."""
    n = len(payload) // SAMPLE
    n_chunks = -(-n // CHUNK)
    keys = range(1, n + 1, KEYFRAME_EVERY)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, CHUNK), (n_chunks, n % CHUNK)] if n_chunks > 1 else [(1, n)]
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def moov(first: int) -> bytes:
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", at, each, 1) for at, each in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64", struct.pack(">I", n_chunks), struct.pack(f">{n_chunks}Q", *(first + i * CHUNK * SAMPLE for i in range(n_chunks)))),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * SAMPLE, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE), bytes(16), matrix, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n * SAMPLE), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = len(head) + len(moov(0)) + 16
    return head + moov(first) + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload


#: Levels of boxes within boxes, at most; the tables of a track lie six deep.
DEEPEST = 32


def walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of content, end) of each box from ``at`` on; 64-bit sizes and boxes that run to the end included."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1:
            if at + 16 > end:
                return
            size, start = struct.unpack_from(">Q", data, start)[0], at + 16
        stop = end if size == 0 else at + size
        if stop > end or stop < start:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        yield kind, start, stop
        at = stop


def tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """The leaf boxes of each track by kind."""
    found: list[dict] = []

    def down(at: int, end: int, held: dict | None, depth: int) -> None:
        if depth > DEEPEST:
            raise ValueError(f"boxes are nested more than {DEEPEST} deep")
        for kind, start, stop in walk(data, at, end):
            if kind == b"trak":
                found.append(own := {})
                down(start, stop, own, depth + 1)
            elif kind in NESTED:
                down(start, stop, held, depth + 1)
            elif held is not None:
                held[kind] = (start, stop)

    down(0, len(data), None, 0)
    return found


def table(data: bytes, at: tuple[int, int] | None, form: str) -> list[tuple]:
    """Entries of a sample table: a count, then so many of ``form``."""
    if at is None:
        return []
    count = struct.unpack_from(">I", data, at[0] + 4)[0]
    each = struct.calcsize(form)
    if at[0] + 8 + count * each > at[1]:
        raise ValueError("a sample table is shorter than its count")
    return list(struct.iter_unpack(form, data[at[0] + 8:at[0] + 8 + count * each]))


def sample_sizes(data: bytes, boxes: dict) -> list[int]:
    """Bytes of each sample: one size for all, 32 bits each, or the compact table's 4, 8 or 16 bits each."""
    if b"stsz" in boxes:
        start, stop = boxes[b"stsz"]
        one, n = struct.unpack_from(">II", data, start + 4)
        if n * one > len(data) or not one and start + 12 + 4 * n > stop:
            raise ValueError("more samples than the file can hold")
        return [one] * n if one else [x[0] for x in struct.iter_unpack(">I", data[start + 12:start + 12 + 4 * n])]
    start, stop = boxes[b"stz2"]
    bits, n = data[start + 7], struct.unpack_from(">I", data, start + 8)[0]
    if bits not in (4, 8, 16):
        raise ValueError(f"compact sample sizes of {bits} bits")
    if start + 12 + (n * bits + 7) // 8 > stop:
        raise ValueError("more samples than the file can hold")
    held = data[start + 12:start + 12 + (n * bits + 7) // 8]
    if bits == 4:
        return [x for byte in held for x in (byte >> 4, byte & 15)][:n]
    return list(held) if bits == 8 else [x[0] for x in struct.iter_unpack(">H", held)]


def samples(data: bytes, boxes: dict) -> list[tuple[int, int]]:
    """(offset, bytes) of each sample, from the size, chunk and offset tables, which have to agree; all lie in the file."""
    sizes = sample_sizes(data, boxes)
    offsets = [x[0] for x in (table(data, boxes.get(b"co64"), ">Q") or table(data, boxes.get(b"stco"), ">I"))]
    runs = table(data, boxes.get(b"stsc"), ">III")
    found, k = [], 0
    for i, (first, each, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
        if not (1 if i == 0 else first) == first < last <= len(offsets) + 1:
            raise ValueError("the runs of chunks don't follow each other")
        for chunk in range(first, last):
            at = offsets[chunk - 1]
            for size in sizes[k:k + each]:
                if at + size > len(data):
                    raise ValueError("a sample leaves the file")
                found.append((at, size))
                at += size
            k += each
    if k != len(sizes):
        raise ValueError(f"the chunks have {k} samples, the size table {len(sizes)}")
    return found


def describe(data: bytes) -> dict:
    """codec, timescale, duration, n_samples, the byte ranges of keyframes and of all samples of the first track with samples."""
    if any(kind == b"moof" for kind, _, _ in walk(data, 0, len(data))):
        raise ValueError("a fragmented file: the tables of its fragments aren't read")
    for boxes in tracks(data):
        if b"stsz" not in boxes and b"stz2" not in boxes:
            continue
        at = boxes[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        held = samples(data, boxes)
        keys = [x[0] for x in table(data, boxes.get(b"stss"), ">I")] if b"stss" in boxes else range(1, len(held) + 1)
        if not all(1 <= k <= len(held) for k in keys):
            raise ValueError("a keyframe that is no sample")
        codec = data[boxes[b"stsd"][0] + 12:boxes[b"stsd"][0] + 16].decode("latin-1")
        return {"codec": codec, "timescale": scale, "duration": duration, "n_samples": len(held), "keyframes": [held[k - 1] for k in keys], "samples": held}
    return {"codec": None, "timescale": None, "duration": None, "n_samples": 0, "keyframes": [], "samples": []}


def read_back(data: bytes, held: list[tuple[int, int]]) -> bytes:
    """The samples' bytes in order, copied as they lie: neighbours in one piece, nothing decoded."""
    parts, at, end = [], None, None
    for offset, size in [*held, (None, 0)]:
        if offset is None or offset != end:
            if at is not None:
                parts.append(data[at:end])
            at, end = offset, offset
        if offset is not None:
            end += size
    return b"".join(parts)


def _each(batches, cols: list[str], types: dict[str, pa.DataType], make) -> Iterator[pa.RecordBatch]:
    """``make`` on the last column; output in pieces of a few MB whatever the batch."""
    for batch in batches:
        held, weight, at = [], 0, 0
        for i in range(batch.num_rows):
            held.append(make(batch.column(batch.num_columns - 1)[i].as_py()))
            weight += len(held[-1].get("media") or b"") + 200
            if weight > 4 << 20 or i + 1 == batch.num_rows:
                rest = [batch.column(j).slice(at, len(held)) for j in range(len(cols))]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array([h[k] for h in held], t) for k, t in types.items())], names=[*cols, *types])
                held, weight, at = [], 0, i + 1


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``media`` (binary), an ISO media file, and n_bytes of the text in UTF-8.

    The bytes are filled with spaces to a positive multiple of SAMPLE, so a null or empty text is one sample of spaces.
    Equal texts give equal files. Columns named media or n_bytes are replaced. No rows: no rows.
    """
    cols = others(docs, text_col, "media", "n_bytes")

    def one(text):
        raw = (text or "").encode()
        return {"n_bytes": len(raw), "media": contain(raw + b" " * (max(SAMPLE, -(-len(raw) // SAMPLE) * SAMPLE) - len(raw)))}

    kind = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols), "n_bytes bigint", "media binary"])
    return docs.select(*[F.col(f"`{c}`") for c in cols], text_col).mapInArrow(lambda b: _each(b, cols, {"n_bytes": pa.int64(), "media": pa.binary()}, one), kind)


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with the container replaced by what its boxes tell, payload not decoded.

    Adds codec, timescale, duration (in units of the timescale), n_samples, keyframes (array of offset and bytes),
    payload_bytes, payload_sha256, tail_crc32 (of the last 16 payload bytes, read through the sample tables),
    media_bytes, media_sha256, feature (JSON of the first five in short) and error. A null, empty or damaged container
    has nulls there, no keyframes, and the reason in ``error``.
    """
    types = {
        "codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "keyframes": pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())])),
        "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string(),
    }
    sql = "codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<offset:bigint,bytes:bigint>>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"
    cols = others(media, media_col, *types)

    def one(data):
        out = dict.fromkeys(types) | {"keyframes": []}
        if not data:
            return out | {"error": "no container"}
        try:
            d = describe(data)
            back = read_back(data, d["samples"])
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return out | {"error": f"damaged: {e}"[:200], "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        frames = d["keyframes"]
        digest = hashlib.sha256(b"".join(struct.pack("<QQ", *k) for k in frames)).hexdigest()[:16]
        feature = json.dumps({"codec": d["codec"], "duration": d["duration"], "timescale": d["timescale"], "samples": d["n_samples"], "keyframes": len(frames), "ranges": digest})
        return out | {
            "codec": d["codec"], "timescale": d["timescale"], "duration": d["duration"], "n_samples": d["n_samples"], "keyframes": [{"offset": o, "bytes": n} for o, n in frames], "payload_bytes": len(back),
            "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature,
        }

    kind = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in cols), sql])
    return media.select(*[F.col(f"`{c}`") for c in cols], media_col).mapInArrow(lambda b: _each(b, cols, types, one), kind)
