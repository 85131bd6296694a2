"""Binary payloads as PNG columns, with low-frequency cosine-transform hashes.

A payload of a multiple of 64 bytes is an image of 8-bit grey samples, 64 wide.
It is stored as a PNG in a binary column: signature, IHDR, IDAT chunks of at most
``CHUNK`` bytes of one zlib stream, IEND, each chunk with its CRC-32.  Every row has
the filter of the least sum of absolute differences among those that numpy undoes
for all rows of an image at once (none, left, above).  Reading back tests every
chunk's checksum, inflates, and undoes the row filters, all five kinds, with numpy.
The feature is a 64-bit hash of the image: means of a 32 x 32 grid, cosine
transform, and for the 8 x 8 lowest frequencies whether each is above their median.

Defined cases: null text is empty; an empty text is one row of zeros; equal texts
have equal images and features; an image with all frequencies equal has the hash zero.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import shared_path, typed

WIDTH = 64
CHUNK = 1 << 16
LEVEL = 6
GRID, LOW = 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: filter types of a row.
NONE, SUB, UP, AVERAGE, PAETH = range(5)
#: Filters that are undone for all rows of an image at once.
RUNS = (NONE, SUB, UP)
#: Rows of an image that are filtered at a time.
TOGETHER = 1 << 16


def payload(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of the width."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def paeth(a, b, c):
    """The neighbour (left, above, corner) nearest to left + above - corner."""
    a16, b16, c16 = (np.asarray(x, np.int16) for x in (a, b, c))
    to_a, to_b, to_c = np.abs(b16 - c16), np.abs(a16 - c16), np.abs(a16 + b16 - 2 * c16)
    return np.where((to_a <= to_b) & (to_a <= to_c), a16, np.where(to_b <= to_c, b16, c16)).astype(np.uint8)


def residual(samples: np.ndarray, row_filter: int) -> np.ndarray:
    """Rows of samples less what a filter guesses for them."""
    if row_filter == NONE:
        return samples
    left, up = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], up[1:] = samples[:, :-1], samples[:-1]
    if row_filter == SUB:
        return samples - left
    if row_filter == UP:
        return samples - up
    if row_filter == AVERAGE:
        return samples - ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(samples)
    corner[1:, 1:] = samples[:-1, :-1]
    return samples - paeth(left, up, corner)


def filtered(samples: np.ndarray, filters: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(filter, residual) of every row: of ``filters`` that of the least sum of absolute differences, the first of equals."""
    tried = np.stack([residual(samples, f) for f in filters])
    best = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return np.asarray(filters, np.uint8)[best], tried[best, np.arange(len(samples))]


def encode_png(samples: np.ndarray, filters: Sequence[int] = RUNS) -> bytes:
    """Rows of 8-bit grey samples as a PNG; each row's filter is one of ``filters``."""
    height, width = samples.shape
    rows = np.empty((height, width + 1), np.uint8)
    for at in range(0, height, TOGETHER):
        # The row above goes along, so that parts of a long image are filtered like the whole.
        above = min(at, 1)
        kinds, made = filtered(samples[at - above : at + TOGETHER], filters)
        rows[at : at + TOGETHER, 0], rows[at : at + TOGETHER, 1:] = kinds[above:], made[above:]
    data = zlib.compress(rows.tobytes(), LEVEL)
    parts = [_chunk(b"IDAT", data[at : at + CHUNK]) for at in range(0, len(data), CHUNK)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG; ValueError for damage or another kind."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if len(data) < at + 12 + length or struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r} at {at}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if rows.size != height * (width + 1):
        raise ValueError("size")
    rows = rows.reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters.  A row that needs no other is summed along itself, and rows
    that add to the one above are summed down their run; both for all such rows at once."""
    if (kinds > PAETH).any():
        raise ValueError(f"filter {kinds.max()}")
    if not kinds.any():
        return rows
    out = rows.copy()
    sub = kinds == SUB
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    mixed = np.nonzero(kinds >= AVERAGE)[0]
    begin = 0
    for first, last in zip(mixed[np.diff(mixed, prepend=-2) > 1].tolist(), mixed[np.diff(mixed, append=len(kinds) + 1) > 1].tolist()):
        _down_runs(kinds, out, begin, first)
        _by_diagonals(kinds, rows, out, first, last + 1)
        begin = last + 1
    _down_runs(kinds, out, begin, len(kinds))
    return out


def _down_runs(kinds: np.ndarray, out: np.ndarray, a: int, b: int) -> None:
    """Undo UP in the rows [a, b), where all other rows are final already, as is the row above ``a``."""
    if not (kinds[a:b] == UP).any():
        return
    above = min(a, 1)
    part = out[a - above : b]
    starts = kinds[a - above : b] != UP
    starts[0] = True
    run = np.maximum.accumulate(np.where(starts, np.arange(len(part)), 0))
    sums = np.cumsum(part, axis=0, dtype=np.uint8)  # sums wrap around, and so do their differences
    before = np.concatenate([np.zeros((1, part.shape[1]), np.uint8), sums])[run]
    out[a:b] = (sums - before)[above:]


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, out: np.ndarray, a: int, b: int) -> None:
    """Undo AVERAGE and PAETH in the rows [a, b), which have no other filters: samples whose
    places add up to the same number need none of each other."""
    height, width = b - a, rows.shape[1]
    held = np.zeros((height + 1, width + 1), np.uint8)  # a column of zeros before, the row above on top
    if a:
        held[0, 1:] = out[a - 1]
    average = kinds[a:b] == AVERAGE
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = held[y + 1, x], held[y, x + 1], held[y, x]
        guess = np.where(average[y], (left.astype(np.int16) + up) >> 1, paeth(left, up, corner)).astype(np.uint8)
        held[y + 1, x + 1] = rows[a + y, x] + guess
    out[a:b] = held[1:, 1:]


@functools.cache
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


def _means(samples: np.ndarray) -> np.ndarray:
    """Means of ``GRID`` bands of rows; with fewer rows a row serves several bands."""
    n = len(samples)
    if n < GRID:
        return samples[np.arange(GRID) * n // GRID].astype(np.float64)
    edges = np.arange(GRID + 1) * n // GRID
    sums = np.add.reduceat(samples, edges[:-1], axis=0, dtype=np.int64)
    return sums / np.diff(edges)[:, None]


def feature(samples: np.ndarray) -> str:
    """64 bits as hexadecimal digits."""
    grid = _means(_means(samples).T).T
    low = _cosines() @ grid @ _cosines().T
    bits = low.round(6) > np.median(low.round(6))
    return np.packbits(bits.ravel()).tobytes().hex()


def images(texts: DataFrame, carry: str = "doc_id") -> DataFrame:
    """``carry``, n_bytes and image, the PNG of every text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, made, at = [], [], 0
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                sizes.append(len(text))
                made.append(encode_png(np.frombuffer(payload(text), np.uint8).reshape(-1, WIDTH)))
                if len(made) == 500 or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(made)), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "image"])
                    at, sizes, made = k + 1, [], []

    return texts.select(carry, "text").mapInArrow(run, f"{typed(texts, carry, 'doc_id')}, n_bytes long, image binary")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(stored: DataFrame) -> DataFrame:
    """What the stored images (doc_id, n_bytes, image) hold, decoded from their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column(2):
                data = image.as_py()
                samples = decode_png(data)
                held = samples.tobytes()
                rows.append((len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "image").mapInArrow(run, f"{typed(stored, 'doc_id')}, {FEATURES}")


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) as an image, then describe what is stored."""
    path = path or shared_path(docs.sparkSession, "media")
    # An image is packed already: the table's own compression would only cost time.
    made = images(docs)
    made.write.option("compression", "none").parquet(path)
    return described(docs.sparkSession.read.schema(made.schema).parquet(path))
