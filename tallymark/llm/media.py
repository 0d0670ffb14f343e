"""Media columns from ISO base media containers.

``media_columns`` walks the nested boxes of a container and decodes the sample
tables of each track: codec, duration, sample sizes and offsets, and the byte
ranges of key frames.  Payloads are located, never decoded.  ``wrap`` is the
writer: it stores bytes as the samples of one track of raw 8-bit audio.

Defined results: a null, empty or foreign binary has no tracks (an empty list)
and the error text says why; damaged boxes end the walk with an error; 64-bit
box sizes and chunk offsets are read; of a container with movie fragments, the tracks
list the samples outside them and the error says that they are not all; ties cannot
occur; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymark.llm.common import add_columns, texts_of

#: Bytes of one sample and samples of a second in what ``wrap`` writes.
SAMPLE, RATE = 576, 8000
#: Samples of one chunk.
CHUNK = 64

RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
TRACK = T.StructType(
    [
        T.StructField("track_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("keyframes", T.ArrayType(RANGE)),
        T.StructField("runs", T.ArrayType(RANGE)),
    ]
)
RANGE_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
TRACK_ARROW = pa.list_(
    pa.struct(
        [
            ("track_id", pa.int64()),
            ("kind", pa.string()),
            ("codec", pa.string()),
            ("duration_s", pa.float64()),
            ("n_samples", pa.int64()),
            ("n_bytes", pa.int64()),
            ("keyframes", RANGE_ARROW),
            ("runs", RANGE_ARROW),
        ]
    )
)


class Damaged(ValueError):
    """The bytes are not a container that can be walked."""


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of each box between two offsets, not of those inside."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Damaged(f"a box header is cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Damaged(f"a box header is cut off at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise Damaged(f"the box {kind!r} at {start} runs over its parent")
        yield kind, body, start + size
        start += size


def find(data, start: int, end: int, *path: bytes) -> list[tuple[int, int]]:
    """Bodies of all boxes reached by a path of kinds."""
    at = [(start, end)]
    for kind in path:
        at = [(b, e) for s, t in at for k, b, e in walk(data, s, t) if k == kind]
    return at


def _table(data, at: tuple[int, int], kind: str, columns: int, skip: int = 8) -> np.ndarray:
    """Rows of a full box whose count stands before them."""
    (n,) = struct.unpack_from(">I", data, at[0] + skip - 4)
    if at[0] + skip + n * columns * np.dtype(kind).itemsize > at[1]:
        raise Damaged("a sample table is cut off")
    return np.frombuffer(data, kind, n * columns, at[0] + skip).reshape(n, columns).astype(np.int64)


def _sizes(data, at: tuple[int, int]) -> np.ndarray:
    one, n = struct.unpack_from(">II", data, at[0] + 4)
    if one:
        if n * one > len(data):
            raise Damaged("samples run over the end")
        return np.full(n, one, np.int64)
    return _table(data, at, ">u4", 1, 12)[:, 0]


def _offsets(data, stbl: tuple[int, int], sizes: np.ndarray) -> np.ndarray:
    """First byte of each sample, from the chunk offsets and the samples of each chunk."""
    if not len(sizes):
        return sizes
    small, large = find(data, *stbl, b"stco"), find(data, *stbl, b"co64")
    chunks = _table(data, small[0], ">u4", 1)[:, 0] if small else _table(data, large[0], ">i8", 1)[:, 0]
    runs = _table(data, find(data, *stbl, b"stsc")[0], ">u4", 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    if per.sum() != len(sizes):
        raise Damaged("chunks and samples do not add up")
    chunk_of = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    starts = chunks[chunk_of] + before - before[first[chunk_of]]
    if (starts + sizes).max() > len(data):
        raise Damaged("samples run over the end")
    return starts


def _runs(starts: np.ndarray, sizes: np.ndarray) -> list[dict]:
    """Byte ranges of samples, with neighbours that touch joined."""
    if not len(starts):
        return []
    new = np.append(True, starts[1:] != starts[:-1] + sizes[:-1])
    first = np.flatnonzero(new)
    return [{"start": int(s), "length": int(n)} for s, n in zip(starts[first], np.add.reduceat(sizes, first))]


def _track(data, trak: tuple[int, int]) -> dict:
    tkhd, mdhd = find(data, *trak, b"tkhd")[0], find(data, *trak, b"mdia", b"mdhd")[0]
    handler = find(data, *trak, b"mdia", b"hdlr")[0]
    stbl = find(data, *trak, b"mdia", b"minf", b"stbl")[0]
    (track_id,) = struct.unpack_from(">I", data, tkhd[0] + (20 if data[tkhd[0]] else 12))
    scale, length = struct.unpack_from(*((">IQ", data, mdhd[0] + 20) if data[mdhd[0]] else (">II", data, mdhd[0] + 12)))
    entries = list(walk(data, find(data, *stbl, b"stsd")[0][0] + 8, find(data, *stbl, b"stsd")[0][1]))
    sizes = _sizes(data, find(data, *stbl, b"stsz")[0])
    starts = _offsets(data, stbl, sizes)
    times = find(data, *stbl, b"stts")
    if not length and times:  # some writers leave the header at 0
        length = int(np.prod(_table(data, times[0], ">u4", 2), axis=1).sum())
    sync = find(data, *stbl, b"stss")  # without this table, every sample is a key frame
    keys = _table(data, sync[0], ">u4", 1)[:, 0] - 1 if sync else np.arange(len(sizes))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise Damaged("a key frame is not among the samples")
    return {
        "track_id": track_id,
        "kind": bytes(data[handler[0] + 8 : handler[0] + 12]).decode("latin-1"),
        "codec": entries[0][0].decode("latin-1") if entries else None,
        "duration_s": length / scale if scale else None,
        "n_samples": len(sizes),
        "n_bytes": int(sizes.sum()),
        "keyframes": _runs(starts[keys], sizes[keys]),
        "runs": _runs(starts, sizes),
    }


def tracks(data: bytes | None) -> tuple[list[dict], str | None]:
    """The tracks of a container and, where it cannot be walked, why."""
    if not data:
        return [], "empty"
    try:
        found = [_track(data, t) for t in find(data, 0, len(data), b"moov", b"trak")]
        fragments = len(find(data, 0, len(data), b"moof"))
        return found, f"{fragments} fragments hold samples that are not listed" if fragments else None
    except Damaged as e:
        return [], str(e)
    except (IndexError, struct.error, ValueError) as e:
        return [], f"a box is missing or cut off: {e}"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


#: The unit matrix of track and movie headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes, sample: int = SAMPLE, rate: int = RATE, every: int = CHUNK) -> bytes:
    """A container with the payload as raw 8-bit audio, ``sample`` bytes to a sample.

    The same payload always gives the same bytes: no dates, names or ids go in.
    """
    if not payload or len(payload) % sample:
        raise ValueError("the payload must be a positive multiple of the sample size")
    n = len(payload) // sample
    n_chunks = -(-n // every)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    length = n * sample
    runs = [(1, min(every, n))] + ([(n_chunks, n - (n_chunks - 1) * every)] if n_chunks > 1 and n % every else [])

    def moov(data_at: int) -> bytes:
        entry = struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, rate << 16)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", struct.pack(">III", 1, n, sample)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
            _full(b"stsz", struct.pack(">II", sample, n)),
            _full(
                b"stco",
                struct.pack(">I", n_chunks),
                (data_at + np.arange(n_chunks) * (every * sample)).astype(">u4").tobytes(),
            ),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, length, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">4x4s12x", b"soun"), b"\0"),
            minf,
        )
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xhhhxx", 0, 0, 1, 0, length, 0, 0, 0x100), MATRIX, bytes(8), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIh10x", 0, 0, rate, length, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    at = len(head) + len(moov(0)) + 8
    if at + length >= 1 << 32:
        raise ValueError("payloads of 4 GB and more do not fit one row")
    return b"".join((head, moov(at), struct.pack(">I4s", 8 + length, b"mdat"), payload))


def wrap_texts(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add each text (null: empty) as a container: its UTF-8 bytes, filled up with bytes 255."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        made = []
        for t in texts_of(batch, text):
            data = t.encode()
            made.append(wrap(data + b"\xff" * ((-len(data)) % SAMPLE or (0 if data else SAMPLE))))
        return [pa.array(made, pa.binary())]

    return add_columns(df, [T.StructField(out, T.BinaryType(), False)], make)


def media_columns(df: DataFrame, media: str = "media", out: str = "tracks", error: str = "media_error") -> DataFrame:
    """Add the tracks of each container and, where it cannot be walked, the reason."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [tracks(x) for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
        return [pa.array([t for t, _ in found], TRACK_ARROW), pa.array([e for _, e in found], pa.string())]

    fields = [T.StructField(out, T.ArrayType(TRACK), False), T.StructField(error, T.StringType(), True)]
    return add_columns(df, fields, make)


def read_back(df: DataFrame, media: str = "media", found: str = "tracks") -> DataFrame:
    """Add size, SHA-256 and tail CRC of the first track's bytes, read where its tables say, and of the container."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        index = batch.schema.get_field_index
        rows = []
        for data, ts in zip(batch.column(index(media)).to_pylist(), batch.column(index(found)).to_pylist()):
            runs = ts[0]["runs"] if ts else []
            payload = b"".join(data[r["start"] : r["start"] + r["length"]] for r in runs)
            whole = data or b""
            rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(whole), sha256(whole).hexdigest()))
        size, digest, tail, total, whole_digest = zip(*rows) if rows else ((),) * 5
        return [
            pa.array(size, pa.int64()),
            pa.array(digest, pa.string()),
            pa.array(tail, pa.int64()),
            pa.array(total, pa.int64()),
            pa.array(whole_digest, pa.string()),
        ]

    fields = [
        T.StructField("payload_bytes", T.LongType(), False),
        T.StructField("payload_sha256", T.StringType(), False),
        T.StructField("tail_crc32", T.LongType(), False),
        T.StructField("media_bytes", T.LongType(), False),
        T.StructField("media_sha256", T.StringType(), False),
    ]
    return add_columns(df, fields, make, drop=(media,))
