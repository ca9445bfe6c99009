"""Operator 8: media columns as ISO base media files.

``store`` writes a payload as one track of uncompressed 8-bit samples; ``describe`` walks the nested boxes of any such file, decodes its
sample tables and gives codec, duration and the byte range of every key frame without decoding a payload. ``samples`` reads the
stored bytes back through the same tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

#: Fixed values of the file format: boxes that hold boxes, and the size of a sample entry's common part by handler.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"}

#: What ``store`` writes: bytes a sample, samples a chunk, every how many samples a key frame, ticks a second, ticks a sample.
FRAME, PER_CHUNK, KEY_EVERY, TIMESCALE, TICKS = 576, 16, 12, 8000, 576


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end of its body) of each box between two places; sizes 0 (to the end) and 1 (64 bits) are known."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a wrong size {size}")
        yield kind, start + head, start + size
        start += size


def find(data: memoryview, start: int, end: int, *path: bytes) -> list[tuple[int, int]]:
    """The bodies of all boxes with this path of types."""
    out = [(a, b) for kind, a, b in boxes(data, start, end) if kind == path[0]]
    return out if len(path) == 1 else [x for a, b in out for x in find(data, a, b, *path[1:])]


def _table(data: memoryview, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at)
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=kind, count=n * columns, offset=at + 4).reshape(n, columns).astype(np.int64) if n * columns * width else np.zeros((0, columns), np.int64)


def tracks(data: memoryview) -> list[dict]:
    """Codec, timescale, duration and the sample tables of every track, from the boxes alone."""
    out = []
    for trak in find(data, 0, len(data), b"moov", b"trak"):
        (mdhd,) = find(data, *trak, b"mdia", b"mdhd")
        (hdlr,) = find(data, *trak, b"mdia", b"hdlr")
        (stbl,) = find(data, *trak, b"mdia", b"minf", b"stbl")
        body = {kind: a for kind, a, _ in boxes(data, *stbl)}
        if data[mdhd[0]]:
            timescale, duration = struct.unpack_from(">IQ", data, mdhd[0] + 20)
        else:
            timescale, duration = struct.unpack_from(">II", data, mdhd[0] + 12)
        entries = struct.unpack_from(">I", data, body[b"stsd"] + 4)[0]
        codec = bytes(data[body[b"stsd"] + 12 : body[b"stsd"] + 16]).decode("latin-1") if entries else ""
        fixed, n = struct.unpack_from(">II", data, body[b"stsz"] + 4)
        sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, body[b"stsz"] + 12).astype(np.int64)
        chunks = (_table(data, body[b"stco"] + 4, 1) if b"stco" in body else _table(data, body[b"co64"] + 4, 1, ">u8"))[:, 0]
        runs = _table(data, body[b"stsc"] + 4, 3)
        #: Each run holds from its first chunk to the next run's.
        per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        chunk = np.repeat(np.arange(len(chunks)), per)[:n]
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, np.arange(len(chunks)))
        offsets = chunks[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
        times = _table(data, body[b"stts"] + 4, 2)
        keys = _table(data, body[b"stss"] + 4, 1)[:, 0] - 1 if b"stss" in body else np.arange(n)
        out.append(
            {
                "handler": bytes(data[hdlr[0] + 8 : hdlr[0] + 12]).decode("latin-1"),
                "codec": codec,
                "timescale": timescale,
                "duration": duration,
                "ticks": int((times[:, 0] * times[:, 1]).sum()),
                "sizes": sizes,
                "offsets": offsets,
                "keys": keys,
            }
        )
    return out


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def store_bytes(payload: bytes) -> bytes:
    """An ISO media file with the payload, a multiple of FRAME bytes, as 8-bit samples of one sound track."""
    n, extra = divmod(len(payload), FRAME)
    if extra:
        raise ValueError(f"a payload is a multiple of {FRAME} bytes")
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    chunks = -(-n // PER_CHUNK)
    start = len(head) + 16
    offsets = start + np.arange(chunks, dtype=np.int64) * PER_CHUNK * FRAME
    wide = start + len(payload) > 0xFFFFFFFF
    table = offsets.astype(">u8" if wide else ">u4").tobytes()
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1 or last == PER_CHUNK) + [(chunks, last, 1)] * (last != PER_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, TICKS)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), table),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
    )
    long_ = n * TICKS > 0xFFFFFFFF
    span = struct.pack(">QQIQ", 0, 0, TIMESCALE, n * TICKS) if long_ else struct.pack(">IIII", 0, 0, TIMESCALE, n * TICKS)
    version = b"\1\0\0\0" if long_ else b"\0\0\0\0"
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), stbl)
    mdia = _box(b"mdia", _box(b"mdhd", version, span, struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), minf)
    track = struct.pack(">QQIIQ", 0, 0, 1, 0, n * TICKS) if long_ else struct.pack(">IIIII", 0, 0, 1, 0, n * TICKS)
    tkhd = _box(b"tkhd", (b"\1" if long_ else b"\0") + b"\0\0\7", track, bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), unity, bytes(8))
    mvhd = _box(b"mvhd", version, span, struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
    moov = _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))
    return b"".join([head, struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16), payload, moov])


def samples(data: memoryview, track: dict) -> bytes:
    """The stored bytes of a track, by its sample tables; adjacent samples are read as one range."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    cuts = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts = offsets[np.append(0, cuts)]
    ends = (offsets + sizes)[np.append(cuts - 1, len(offsets) - 1)]
    return b"".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every text: UTF-8 bytes with 255 appended up to a positive multiple of FRAME, as a media file.

    A null text counts as empty, so its payload is FRAME bytes of 255. Repeated rows give repeated files; extra columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            # Few rows a batch: files stand beside their texts in memory.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, media = [], []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode()
                    n.append(len(raw))
                    media.append(store_bytes(raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return texts_of(df, df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


#: Columns that ``describe`` adds for the first track of each file.
DESCRIPTION = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,length:long>>"


def describe(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, codec, timescale, duration, n_samples, keyframes) of every media file, without touching a payload.

    A null file has null results. Key frames are byte ranges of the file in sample order.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                media = batch.column(1)[k]
                found = tracks(memoryview(media.as_buffer())) if media.is_valid else []
                if not found:
                    rows.append((None, None, None, None, None))
                    continue
                t = found[0]
                ranges = [{"start": a, "length": b} for a, b in zip(t["offsets"][t["keys"]].tolist(), t["sizes"][t["keys"]].tolist())]
                rows.append((t["codec"], t["timescale"], t["duration"], len(t["sizes"]), ranges))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "codec", "timescale", "duration", "n_samples", "keyframes"])

    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(run, f"id {kind}, {DESCRIPTION}").withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digests of what ``store`` returned: payload as read back by the sample tables, stored file, and a feature string.

    The feature names codec, timescale, duration, samples, key frames and a checksum of the key frames' byte ranges.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data = memoryview(batch.column(2)[k].as_buffer())
                (t,) = tracks(data)
                payload = samples(data, t)
                at, size = t["offsets"][t["keys"]], t["sizes"][t["keys"]]
                ranges = zlib.crc32(np.stack([at, size], 1).astype("<i8").tobytes())
                feature = f"codec={t['codec']};handler={t['handler']};timescale={t['timescale']};duration={t['duration']};samples={len(t['sizes'])};keyframes={len(at)};ranges={ranges:08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    out = df.select(df[id_col].alias("id"), "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
