"""Dropping lines that many documents share, with two Bloom filters.

1. Every task hashes the distinct line keys of each of its documents into a filter
   of hashes seen once and, where all bits were there already, into a filter of
   hashes seen twice.  Filters are cut into segments, a hash lies in one segment,
   and the tasks' segments are merged: seen twice is what either side saw twice,
   or what both saw.  A merged filter has every hash of two documents.
2. Lines whose hash is in the filter of twice-seen hashes are suspects; only they
   shuffle, counted per task first, for exact confirmation by the whole key.
3. Confirmed lines are dropped from the texts.  Few enough (a checked count) go to
   the tasks as a set of digests; beyond that suspects' digests meet the confirmed
   ones in a join, keyed by the digest of the text, and no document is left out.

The filters' size follows the number of lines up to ``MOST_BITS``.  With more lines
no task could hold whole filters, so step 1 is dealt: counted hashes, 8 bytes a line,
shuffle by segment, each segment's task has the two filters of its own hashes, counts
those that come a third time, and keeps hashes of enough documents; the filter of
suspects is made of these alone.  The results are the same.

Defined cases: null or empty text is one empty line; an empty key is never
dropped; equal rows are documents of their own; a line repeated within one
document counts that document once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import drop, materialised, own, shared_path

#: Documents that must share a key for its lines to go, and the shortest such key.
SHARED_BY, SHORTEST = 10, 1
#: Bits for each line, bits at most in a whole filter, and bits of a segment.
BITS_PER_LINE, MOST_BITS, SEGMENT_BITS = 12, 1 << 28, 1 << 20
PROBES = 4
#: Lines of a segment where the filters are dealt, and hashes that a task gathers before it deals them out.
SEGMENT_LINES, GATHERED = 2_000_000, 1_000_000
#: Confirmed keys that go to the tasks as a set; about 100 bytes each there.
SET_UP_TO = 500_000
#: Keys that a task counts before it hands them on.
COUNTED = 100_000

SPACE = b" \t\n\x0b\x0c\r"
_SEGMENT = "segment int, once binary, twice binary"


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """(lines, their keys) of a whole text."""
    lines = text.split(b"\n")
    return lines, [x.strip(SPACE).lower() for x in lines]


def _candidates(text: bytes, shortest: int) -> set[bytes]:
    keys = set(line_keys(text)[1])
    return {k for k in keys if k and (shortest <= 1 or len(k.decode()) >= shortest)}


class Filter:
    """A Bloom filter in segments; a hash has all its bits in one segment."""

    def __init__(self, segments: int):
        self.segments = segments
        self.bitmap = np.zeros(segments * SEGMENT_BITS >> 3, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Bits of each hash, a column for each probe."""
        first, mixed = hashes % np.uint64(self.segments), hashes // np.uint64(self.segments)
        step = (mixed >> np.uint64(20)) | np.uint64(1)
        bits = (mixed[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)
        return (first[:, None] * np.uint64(SEGMENT_BITS) + bits).astype(np.int64)

    def add(self, bits: np.ndarray) -> None:
        bits = bits.ravel()
        np.bitwise_or.at(self.bitmap, bits >> 3, (1 << (bits & 7)).astype(np.uint8))

    def has(self, bits: np.ndarray) -> np.ndarray:
        return (self.bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).all(axis=1)

    def segment(self, k: int) -> np.ndarray:
        return self.bitmap[k * SEGMENT_BITS >> 3 : (k + 1) * SEGMENT_BITS >> 3]


class SeenTwice:
    """Once-seen and twice-seen hashes of the documents of one task."""

    def __init__(self, segments: int):
        self.once, self.twice = Filter(segments), Filter(segments)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of the keys of several documents, a hash once for each document."""
        known, counts = np.unique(hashes, return_counts=True)
        bits = self.once.places(known)
        self.twice.add(bits[self.once.has(bits) | (counts > 1)])
        self.once.add(bits)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.binary()))


def often_seen(texts: DataFrame, lines: int, shared_by: int, shortest: int) -> DataFrame:
    """(hash) of line keys that about ``shared_by`` rows of ``texts`` (text) have: none is missed, few are too many."""
    segments, enough = -(-lines // SEGMENT_LINES), min(3, shared_by)
    dealt_schema = pa.schema([("segment", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def dealt() -> pa.RecordBatch:
            known, counts = np.unique(np.concatenate(waiting), return_counts=True)
            order = np.argsort(known % np.uint64(segments), kind="stable")
            known, counts = known[order], counts[order].astype("<u4")
            names, starts = np.unique(known % np.uint64(segments), return_index=True)
            parts = list(zip(names.tolist(), starts, [*starts[1:], len(known)]))
            return pa.RecordBatch.from_pylist([{"segment": s, "hashes": known[a:b].tobytes(), "counts": counts[a:b].tobytes()} for s, a, b in parts], schema=dealt_schema)

        for batch in batches:
            for text in _texts(batch):
                waiting.append(_hashes(list(_candidates(text, shortest))))
                n += len(waiting[-1])
                if n > GATHERED:
                    yield dealt()
                    waiting, n = [], 0
        if n:
            yield dealt()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, often = None, None, {}

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array([h for h, n in often.items() if n >= shared_by], np.uint64).view(np.int64))], ["hash"])

        for batch in batches:
            for s, hashes, counts in zip(*(batch.column(k) for k in range(3))):
                if s.as_py() != at:
                    if at is not None:
                        yield found()
                    at, often = s.as_py(), {}
                    held = SeenTwice(-(-SEGMENT_LINES * BITS_PER_LINE // SEGMENT_BITS))
                hashes, counts = np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                # Hashes of a segment leave one remainder: the quotients are what tells them apart.
                bits = held.once.places(hashes // np.uint64(segments))
                again = held.once.has(bits)
                so_far = counts + np.where(again & held.twice.has(bits), 2, again)
                held.twice.add(bits[so_far > 1])
                held.once.add(bits)
                put = so_far >= enough
                for h, n, total in zip(hashes[put].tolist(), counts[put].tolist(), so_far[put].tolist()):
                    often[h] = often[h] + n if h in often else total
        if at is not None:
            yield found()

    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments)
    parts = texts.select("text").mapInArrow(deal, "segment int, hashes binary, counts binary")
    return parts.repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(tell, "hash long")


def seen_twice(texts: DataFrame, segments: int, shortest: int = SHORTEST) -> DataFrame:
    """(segment, once, twice) of all ``texts`` (text), or of hashes (hash) that all count as
    seen twice: compressed bitmaps, merged."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    column = "hash" if "hash" in texts.columns else "text"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = SeenTwice(segments), [], 0
        for batch in batches:
            if column == "hash":
                held.add(np.repeat(np.asarray(batch.column(0)).view(np.uint64), 2))
                continue
            for text in _texts(batch):
                waiting.append(_hashes(list(_candidates(text, shortest))))
                n += len(waiting[-1])
                if n > 200_000:
                    held.add(np.concatenate(waiting))
                    waiting, n = [], 0
        if n:
            held.add(np.concatenate(waiting))
        pack = zstandard.ZstdCompressor(level=1)
        for s in range(segments):
            once, twice = held.once.segment(s), held.twice.segment(s)
            if once.any():
                yield pa.RecordBatch.from_pylist([{"segment": s, "once": pack.compress(once.tobytes()), "twice": pack.compress(twice.tobytes())}], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by segment: two bitmaps are held at a time, however many tasks sent some.
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        bitmap = lambda data: np.frombuffer(unpack.decompress(data), np.uint8)
        at, once, twice = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"segment": at, "once": pack.compress(once.tobytes()), "twice": pack.compress(twice.tobytes())}], schema=schema)

        for batch in batches:
            for s, o, t in zip(*(batch.column(k) for k in range(3))):
                o, t, s = bitmap(o.as_py()), bitmap(t.as_py()), s.as_py()
                if s != at:
                    if at is not None:
                        yield row()
                    at, once, twice = s, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        if at is not None:
            yield row()

    parts = texts.select(column).mapInArrow(build, _SEGMENT)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "segment").sortWithinPartitions("segment").mapInArrow(merge, _SEGMENT)


def shared_lines(texts: DataFrame, shared_by: int = SHARED_BY, shortest: int = SHORTEST, most_bits: int = MOST_BITS):
    """(keys that at least ``shared_by`` rows of ``texts`` (text) have, the suspects' filter)."""
    if shared_by < 2:
        raise ValueError("a line is shared by two documents at least")
    spark = texts.sparkSession
    breaks = F.expr("length(text) - length(replace(text, '\n', '')) + 1")
    lines = texts.agg(F.coalesce(F.sum(breaks), F.lit(0))).first()[0]
    hashed = texts
    if lines * BITS_PER_LINE > most_bits:
        hashed = materialised(often_seen(texts, lines, shared_by, shortest), at := shared_path(spark, "often"))
        lines = hashed.count()
    segments = max(1, -(-min(lines * BITS_PER_LINE, most_bits) // SEGMENT_BITS))
    rows = seen_twice(hashed, segments, shortest).select("segment", "twice").collect()  # at most most_bits / 8 bytes
    if hashed is not texts:
        drop(spark, at)
    sent = spark.sparkContext.broadcast([(s, bytes(t)) for s, t in rows])
    keys = pa.schema([("key", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspected, counts = received(sent, segments), Counter()
        for batch in batches:
            for own, _ in suspects_of(batch, suspected, shortest):
                counts.update(own)
            if len(counts) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=keys)
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=keys)

    counted = texts.select("text").mapInArrow(count, "key binary, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {shared_by}").select("key"), sent, segments


def received(sent, segments: int) -> Filter:
    held, unpack = Filter(segments), zstandard.ZstdDecompressor()
    for k, twice in sent.value:
        held.segment(k)[:] = np.frombuffer(unpack.decompress(twice), np.uint8)
    return held


def suspects_of(batch: pa.RecordBatch, suspected: Filter, shortest: int) -> Iterator[tuple[list[bytes], bytes]]:
    """(suspected keys, text) of each document; the filter is asked for many documents at once."""
    def ask(texts: list[bytes], keys: list[list[bytes]]) -> Iterator[tuple[list[bytes], bytes]]:
        flat = [k for own in keys for k in own]
        there, at = suspected.has(suspected.places(_hashes(flat))).tolist(), 0
        for text, own in zip(texts, keys):
            yield [k for k, x in zip(own, there[at : at + len(own)]) if x], text
            at += len(own)

    texts, keys, n = [], [], 0
    for text in _texts(batch):
        texts.append(text)
        keys.append(list(_candidates(text, shortest)))
        n += len(keys[-1])
        if n > 50_000:
            yield from ask(texts, keys)
            texts, keys, n = [], [], 0
    if texts:
        yield from ask(texts, keys)


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _kept(text: bytes, gone) -> tuple[bytes, int, int]:
    """(text without the lines whose key's digest is in ``gone``, lines, lines dropped)."""
    lines, keys = line_keys(text)
    kept = [x for x, k in zip(lines, keys) if not k or digest(k) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


_MADE = [T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def drop_shared_lines(docs: DataFrame, carry: list[str], shared_by: int = SHARED_BY, shortest: int = SHORTEST, set_up_to: int = SET_UP_TO, most_bits: int = MOST_BITS) -> DataFrame:
    """Per row of ``docs``: ``row``, a struct of the columns ``carry``; kept, the text
    without the lines that at least ``shared_by`` rows share; n_lines and n_dropped."""
    spark, at = docs.sparkSession, shared_path(docs.sparkSession, "lines")
    keys, sent, segments = shared_lines(docs.select("text"), shared_by, shortest, most_bits)
    keys = materialised(keys, f"{at}/keys")
    packed = docs.select(F.struct(*own(carry)).alias("row"), "text")
    if keys.count() <= set_up_to:
        gone = spark.sparkContext.broadcast({digest(bytes(r.key)) for r in keys.toLocalIterator()})
        drop(spark, at)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _cut_batch(batch, [gone.value] * batch.num_rows)

        return packed.mapInArrow(cut, T.StructType([packed.schema["row"], *_MADE]))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspected = received(sent, segments)
        for batch in batches:
            found = set()
            for own, text in suspects_of(batch, suspected, shortest):
                name = digest(text)
                found.update((name, digest(k)) for k in own)
            texts, lines = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(lines, pa.binary())], ["name", "line"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([digest(k.as_py()) for k in batch.column(0)], pa.binary())], ["line"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([digest(t) for t in _texts(batch)], pa.binary()), batch.column("row"), batch.column("text")], ["name", "row", "text"])

    def cut_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut_batch(batch, [set(x or ()) for x in batch.column("lines").to_pylist()])

    shared = docs.select("text").mapInArrow(pairs, "name binary, line binary").distinct()
    shared = shared.join(keys.mapInArrow(digests, "line binary"), "line", "left_semi").groupBy("name").agg(F.collect_set("line").alias("lines"))
    # Written down it is a plain scan: texts that very many rows share are split over tasks in the join.
    shared = materialised(shared, f"{at}/shared")
    shape = T.StructType([T.StructField("name", T.BinaryType()), packed.schema["row"], packed.schema["text"]])
    out = packed.mapInArrow(named, shape).join(shared, "name", "left").select("row", "text", "lines")
    return out.mapInArrow(cut_own, T.StructType([packed.schema["row"], *_MADE]))


def _cut_batch(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
    kept, n_lines, n_dropped = zip(*(_kept(t, g) for t, g in zip(_texts(batch), gone))) if batch.num_rows else ((), (), ())
    made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    return pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", "kept", "n_lines", "n_dropped"])


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    made = drop_shared_lines(docs, ["doc_id"], **options)
    return made.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
