"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A fingerprint has 64 bits from the XXH64 values (seed 42) of all word 3-shingles,
repeats included.  Fingerprints of at most two differing bits link, and a
component is what links connect.

Candidates.  The 64 bits are cut into three segments.  With two errors at most,
for one of the cyclic pairs of segments (1,2), (2,3), (3,1) the first segment has
no error and the second at most one.  The second is decoded with the perfect
binary Golay code [23,12,7]: a segment and each of its one-bit neighbours decode
to one of one to six codeword indices, and two segments at distance one share an
index.  So a key is (pair, exact segment, codeword index): 34 to 35 bits that
random fingerprints rarely share.  Candidates are verified by the number of
differing bits.

No bucket is expanded into all pairs without bound: equal fingerprints are one
node; buckets of up to ``PAIRS_UP_TO`` fingerprints are joined with themselves;
in larger ones every fingerprint names the 65 points at distance one or less,
and all that name a point are tied to the smallest of them.  Two fingerprints
are at most two bits apart exactly if they share a point, so this loses no link
and costs the same for each fingerprint however many there are.

Defined cases: null text and text without words have the fingerprint zero, and
link like any other; shorter texts than three words have one shingle, the whole
sequence; doc_id names a document, repeated rows of one id are one document; a
null doc_id is never the smallest unless a component has no other; then its rows
are told apart by text.  doc_id may have any type that can be ordered.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialised, own, shared_path, typed

SHINGLE, SEED, MOST_BITS = 3, 42, 2
PAIRS_UP_TO = 128
#: (first bit, bits) of the segments, and the pairs (exact segment, decoded segment).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
#: The Golay code's length, data bits and generator polynomial.
LENGTH, DATA, GENERATOR = 23, 12, 0b110001110101
CHECK = LENGTH - DATA
_SLICE = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of a whole text in UTF-8, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        part = slice(at, at + _SLICE)
        values = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[part], ends[part])], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and a digest of the text, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(2)], ["doc_id", "fp", "digest"])

    return docs.select("doc_id", "text", _digest().alias("digest")).mapInArrow(run, f"{typed(docs, 'doc_id')}, fp long, digest long")


def _digest():
    return F.xxhash64("text")


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of each data word; the error pattern of each syndrome."""
    check = np.zeros(1 << DATA, np.int64)
    for data in range(1 << DATA):
        rest = data << CHECK
        for k in range(LENGTH - 1, CHECK - 1, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - CHECK)
        check[data] = rest
    errors = np.full(1 << CHECK, -1, np.int64)
    patterns = np.array([sum(1 << k for k in c) for n in range(4) for c in itertools.combinations(range(LENGTH), n)])
    errors[(patterns & ((1 << CHECK) - 1)) ^ check[patterns >> CHECK]] = patterns
    return check, errors


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Index (data bits) of the one codeword within three bits of each 23-bit word."""
    check, errors = golay_tables()
    return (words ^ errors[(words & ((1 << CHECK) - 1)) ^ check[words >> CHECK]]) >> CHECK


def codeword_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) without repeats: the codewords that words of so many bits and their one-bit neighbours decode to."""
    codes = np.sort(nearest_codeword(words[:, None] ^ np.array([0, *(1 << k for k in range(bits))])), axis=1)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    rows, at = np.nonzero(new)
    return rows, codes[rows, at]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: all keys of each fingerprint, without repeats."""
    values, keys, owners = fps.view(np.uint64), [], []
    cut = [((values >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    for pair, (exact, decoded) in enumerate(PAIRS):
        rows, codes = codeword_indices(cut[decoded], SEGMENTS[decoded][1])
        keys.append((cut[exact][rows] << (DATA + 2)) | (codes << 2) | pair)
        owners.append(fps[rows])
    return np.concatenate(keys), np.concatenate(owners)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, owners = bucket_keys(np.asarray(batch.column(0)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (u > v) that connect what is linked, from distinct fingerprints (fp).
    Small buckets give every pair within the limit, large ones stars of the same reach."""
    spark, at = fps.sparkSession, shared_path(fps.sparkSession, "simhash-keys")
    keys = materialised(fps.select("fp").mapInArrow(_emit_keys, "key long, fp long"), f"{at}/all")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialised(keys.join(sizes, "key"), f"{at}/shared")
    drop(spark, f"{at}/all")
    small, large = shared.where(f"n <= {PAIRS_UP_TO}"), shared.where(f"n > {PAIRS_UP_TO}")
    pairs = small.alias("a").join(small.alias("b"), F.expr(f"a.key = b.key and a.fp > b.fp and bit_count(a.fp ^ b.fp) <= {MOST_BITS}"))
    ball = F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")
    points = large.select("fp").distinct().select("fp", F.explode(ball).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = points.join(least, "point").where("fp > v").select(F.col("fp").alias("u"), "v")
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that it reaches.

    Large-star and small-star rounds, each a few joins and aggregations on the
    edges; every round is written down, so a lost executor costs one round.
    Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    path = shared_path(spark, "components")
    at, done, rounds = materialised(edges.where("u != v").select("u", "v"), path), None, 0
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written down, the least neighbours are a plain scan, so that the join with the edges of a hub can be split.
        least = materialised(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{path}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        path, old = shared_path(spark, "components"), path
        at = materialised(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), path)
        drop(spark, old, f"{old}-least")
        state = tuple(at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == done:
            break
        done, rounds = state, rounds + 1
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp (signed long), component_id, and the text's digest."""
    rows = materialised(with_fingerprint(docs), f"{shared_path(docs.sparkSession, 'simhash')}/rows")
    return grouped(rows, links)


def grouped(rows: DataFrame, edges) -> DataFrame:
    """doc_id, fp, component_id and digest of ``rows`` (doc_id, fp, digest); ``edges`` gives the links (u, v) of distinct fingerprints (fp)."""
    at = shared_path(rows.sparkSession, "simhash")
    fps = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), f"{at}/fps")
    roots = components(edges(fps))
    tied = fps.join(roots, F.col("fp") == F.col("node"), "left").where("root is not null or n > 1")
    tied = tied.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    tied = materialised(tied.join(smallest, "root").select(F.col("fp").alias("tied_fp"), "component_id"), f"{at}/tied")
    out = rows.join(tied, F.col("fp") == F.col("tied_fp"), "left")
    return out.select("doc_id", "fp", F.when(F.col("tied_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "digest")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, groups=near_duplicates) -> DataFrame:
    """``docs`` with one document of each component of ``groups``, that of the smallest doc_id.  Where a
    component has no doc_id at all, one row for each of its different texts stays.

    What stays grows with the documents, so the texts meet it in a sort-merge join at every size."""
    names = docs.columns
    kept = groups(docs).where("doc_id <=> component_id").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    kept = materialised(kept, shared_path(docs.sparkSession, "simhash-kept"))
    whole = docs.select(F.col("doc_id"), _digest().alias("digest"), F.struct(*own(names)).alias("row"))
    out = whole.alias("d").join(kept.alias("k").hint("merge"), F.expr("d.doc_id <=> k.doc_id and d.digest = k.digest")).select("d.doc_id", "d.digest", "row")
    repeated = kept.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1")
    if repeated.limit(1).count():
        out = out.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("digest"))).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.select("row.*")
