"""Near-copies by word shingles: texts whose shingle sets have at least a given Jaccard similarity.

The method is that of ``simhash.py``: a fingerprint has a bit set where over half of the
shingles' hashes have it set, its segments are decoded with the Golay code, and candidates share
an exact part and a codeword index, are verified, and tie components.  What differs is what
a similarity of 0.8 needs.  There 15 % of the bits differ, so 64 bits cannot tell copies
from random texts, and 22 equal ones are rare.  So a fingerprint has ``BANDS`` segments of 23 bits, the
code's whole length; a segment shares an index with that of a text at 0.8 six times in ten.  Its exact
part is ``ROWS`` least hash values of the shingles, which are equal at 0.8 in 64 % and hardly ever
in unlike texts.  Every candidate is verified by the shingle sets themselves.  A pair at 0.8 shares
no key with probability 2e-5 (4e-4 where it has but four and five shingles), a pair at 0.9 with 1e-10.

Keys of up to ``PAIRS_UP_TO`` texts are joined with themselves.  In larger ones
every text is first compared with one hub: of the texts near it that hold most of a key's
texts in their own keys, the one that holds most.  Then only
texts that are not yet in one component are compared with each other, so no link
between components is passed over and a large group of copies costs about one
comparison for each text and key.  Four bits of each least value, compared in the
join, keep pairs far below the limit away from verification; they lose a pair at
0.8 with probability 3e-5.

Defined cases: texts of equal words are one node; a text shorter than a shingle
has one, the whole sequence; texts without words (and null) are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.storage import drop, materialised, shared_path, typed

SHINGLE, LEAST = 5, 0.8
#: Hash functions of a sketch; bands of so many of the first of them, each with a segment of the fingerprint.
HASHES, ROWS, BANDS = 512, 2, 22
#: Numbers of 64 bits that hold the fingerprint's segments.
WORDS = -(-BANDS * simhash.LENGTH // 64)
PARTS = HASHES // 16
_SKETCH = [f"s{k}" for k in range(PARTS)]
_BANDS = ["exact", "segments"]
PAIRS_UP_TO = 16
_SLICE, _TOGETHER = 1 << 12, 1 << 9
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _RANDOM.integers(0, 1 << 63, WORDS, np.uint64)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-shingles."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - n].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64))


def least_values(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    found, least = (found >> np.uint64(32)).astype(np.uint32), np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), _SLICE):
        least = np.minimum(least, (found[at : at + _SLICE] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    return least


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits whose bits all depend on all of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(found: np.ndarray) -> np.ndarray:
    """The fingerprint of the shingles, in segments as long as the Golay code."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), _SLICE):
        part = mixed(found[at : at + _SLICE, None] ^ _SEEDS)
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(found))[: BANDS * simhash.LENGTH]
    return bits.reshape(BANDS, simhash.LENGTH) @ (1 << np.arange(simhash.LENGTH))


def golay_keys(exact: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): all keys of the rows of ``exact`` parts and segments, one column for each band."""
    at, codes = simhash.codeword_indices(words.ravel(), simhash.LENGTH)
    return mixed(exact.ravel()[at] ^ (codes.astype(np.uint64) << np.uint64(52))).view(np.int64), at // BANDS


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            fps, exact, words = batch.slice(at, _TOGETHER).columns
            exact, words = (np.array(x.flatten()).reshape(-1, BANDS) for x in (exact, words))
            keys, rows = golay_keys(exact.view(np.uint64), words)
            yield pa.RecordBatch.from_arrays([pa.array(keys), fps.take(pa.array(rows))], ["key", "fp"])


def most_apart(least: float) -> int:
    """Bits of two sketches that may differ for a pair at the limit, four deviations above the
    mean: of the four bits of a least value that differs, two do so on average."""
    share = 1 - least
    return int(2 * HASHES * share + 4 * (HASHES * share * (1 + 4 * (1 - share))) ** 0.5)


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (of the words), digest (of the text), sketch (four bits of each least value), and of each band the exact part and the segment, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            fps = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split())) for t in texts], np.uint64).view(np.int64)
            found = [shingles(t, shingle) for t in texts]
            least = np.array([least_values(x) for x in found], np.uint32).reshape(-1, HASHES)
            words = np.array([segments(x) for x in found], np.int32).ravel()
            four = ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
            sketch = (four[:, ::2] << 4 | four[:, 1::2]).view(np.int64)
            bands = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            exact = (((bands * _MIX) ^ (bands * _MIX >> np.uint64(29))) * _MIX).sum(axis=2, dtype=np.uint64).view(np.int64).ravel()
            ends = pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (exact, words)]
            columns = [batch.column(0), pa.array(fps), batch.column(2), *(pa.array(sketch[:, k].copy()) for k in range(PARTS)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest", *_SKETCH, *_BANDS])

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return named.mapInArrow(run, f"{typed(docs, 'doc_id')}, fp long, digest long, {', '.join(f'{s} long' for s in _SKETCH)}, exact array<long>, segments array<int>")


def apart(a: str, b: str) -> str:
    """SQL for the number of bits in which the sketches ``a`` and ``b`` differ."""
    return " + ".join(f"bit_count({a}.{s} ^ {b}.{s})" for s in _SKETCH)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: float, at: str) -> DataFrame:
    """Those of ``pairs`` (u, v) whose shingle sets are similar enough."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            grams = pa.array([shingles(t.as_py() or b"", shingle).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["fp", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = 0
                if min(len(a), len(b)) >= least * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both / (len(a) + len(b) - both) >= least)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    of = nodes.join(needed, "fp", "left_semi").select("fp", "of.doc_id", "of.digest")
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    texts = texts.alias("d").join(of.alias("k").hint("merge"), F.expr("d.doc_id <=> k.doc_id and d.digest = k.digest")).select("fp", "text")
    grams = materialised(texts.mapInArrow(sets, "fp long, grams binary").dropDuplicates(["fp"]), f"{at}/grams")
    a, b = (grams.select(F.col("fp").alias(x), F.col("grams").alias(f"grams_{x}")) for x in ("u", "v"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "grams_u", "grams_v")
    out = materialised(both.mapInArrow(run, "u long, v long"), f"{at}/links")
    drop(docs.sparkSession, f"{at}/grams")
    return out


def links(docs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges (u > v) whose components are those of all similar candidates."""
    spark, at = docs.sparkSession, shared_path(docs.sparkSession, "near-copies")
    close = f"{apart('a', 'b')} <= {most_apart(least)}"
    one = [F.first(c).alias(c) for c in (*_SKETCH, *_BANDS)]
    nodes = materialised(rows.groupBy("fp").agg(*one, F.min(F.struct("doc_id", "digest")).alias("of")), f"{at}/nodes")
    sketches = nodes.select("fp", F.struct("fp", *_SKETCH).alias("a"))
    keys = nodes.select("fp", *_BANDS).mapInArrow(_emit_keys, "key long, fp long")
    sizes = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = materialised(keys.withColumn("n", sizes).where("n > 1"), f"{at}/shared")
    of_text, of_key = Window.partitionBy("fp"), Window.partitionBy("key")
    large = shared.where(f"n > {PAIRS_UP_TO}").select("key", "fp", F.sum("n").over(of_text).alias("met"), F.collect_list("key").over(of_text).alias("bands"))
    large = materialised(large.join(sketches, "fp").select("key", "fp", "met", "bands", "a"), f"{at}/large")
    ends = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    hubs = large.groupBy("key").agg(F.max_by("a", F.struct("met", "fp")).alias("b"), F.max("met").alias("reach"))
    stars = large.select("key", "a").join(hubs, "key").where(f"a.fp != b.fp and {close}")
    stars = stars.groupBy("a.fp").agg(F.max_by("b.fp", F.struct("reach", "b.fp")).alias("hub")).select(*ends("fp", "hub"))
    small = shared.where(f"n <= {PAIRS_UP_TO}").join(sketches, "fp").select("key", "a")
    pairs = small.join(small.withColumnRenamed("a", "b"), "key").where(f"a.fp > b.fp and {close}").select(*ends("a.fp", "b.fp"))
    first = materialised(pairs.unionByName(stars).distinct(), f"{at}/first")
    found = verified(docs, nodes, first, shingle, least, f"{at}/1")
    if large.limit(1).count():
        roots = simhash.components(found)
        known = large.join(roots, F.col("fp") == F.col("node"), "left")
        known = known.select("key", "bands", "a", F.coalesce("root", "fp").alias("root"))
        # Only keys whose texts are in several components go on; each row learns that from its own key's rows.
        known = known.withColumn("x", F.min("root").over(of_key)).withColumn("y", F.max("root").over(of_key)).where("x != y")
        known = materialised(known.drop("x", "y"), f"{at}/known")
        other = known.select("key", F.col("bands").alias("theirs"), F.col("a").alias("b"), F.col("root").alias("other"))
        # A pair that meets in several bands comes out of the least of them alone.
        once = "key = array_min(array_intersect(bands, theirs))"
        rest = known.join(other, "key").where(f"a.fp > b.fp and root != other and {close} and {once}")
        rest = rest.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
        rest = materialised(rest.join(first, ["u", "v"], "left_anti"), f"{at}/rest")
        found = found.unionByName(verified(docs, nodes, rest, shingle, least, f"{at}/2"))
    drop(spark, *(f"{at}/{x}" for x in ("nodes", "shared", "large", "first", "known", "rest")))
    return found


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp (of the words), component_id, and the text's digest."""
    at = shared_path(docs.sparkSession, "near-copies-rows")
    rows = materialised(sketched(docs, shingle), at)
    return simhash.grouped(rows, lambda _: links(docs, rows, shingle, least))
