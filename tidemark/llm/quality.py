"""Quality classifier: a factorisation machine.

A text is a sparse vector: hashed words (counts, of length one), and for each
structure statistic and each figure about the whole text the one bin it falls in.
The machine has a bias, a weight for each feature, and a vector of ``RANK``
numbers for each; pairs interact by the product of their vectors.  The sum over
pairs costs linear time: half of (square of the sum less sum of the squares).

Fitting reads a bounded sample: the ``SAMPLE`` different (doc_id, label) that come
first by a hash of doc_id, whose features the driver gathers.  Scoring reads every
whole text.

Defined cases: null or empty text is scored by its structure alone; with no
labels, or one kind only, every score is the share of label 1 (0.5 with none); a
document labelled several times counts once for each different label; of several
rows of one doc_id the text that comes first by its hash is learned from, so the
model is the same whatever the rows' order and partitions.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import own, typed

SAMPLE = 6_000
WORDS, RANK = 1024, 8
#: Texts scored as one sparse product.
TOGETHER = 256
EPOCHS, BATCH, RATE, SHRINK, SEED = 24, 128, 0.08, 2e-5, 7
#: Bounds of the bins of each statistic: shares of bytes, of words or of lines; logarithms.
SHARES = (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7)
LOGS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)
STATISTICS = (
    ("upper", SHARES), ("digit", SHARES), ("symbol", SHARES), ("mark", SHARES), ("bar", SHARES), ("break", SHARES), ("beyond_ascii", SHARES),
    ("repeated_words", SHARES), ("top_word", SHARES), ("repeated_lines", SHARES), ("short_words", SHARES), ("long_words", SHARES),
    ("log_words", LOGS), ("log_bytes", LOGS), ("mean_word", (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0)), ("log_lines", LOGS),
)
BINS = 9
DIMENSIONS = WORDS + BINS * len(STATISTICS)


def _bytes(of: str) -> np.ndarray:
    table = np.zeros(256)
    table[list(of.encode())] = 1
    return table


_UPPER, _DIGIT, _SYMBOL = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789"), _bytes("#$%&*@^~_=+<>{}[]\\/")
_MARK, _BAR, _BREAK = _bytes("!?.,;:"), _bytes("|"), _bytes("\n")
_BEYOND = (np.arange(256) >= 128).astype(float)
_KINDS = np.stack([_UPPER, _DIGIT, _SYMBOL, _MARK, _BAR, _BREAK, _BEYOND], axis=1)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a whole text."""
    words = text.lower().split()
    counts = Counter(words)
    lines = text.split(b"\n")
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS / max(len(text), 1)
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    held = len(counts)
    values = [
        *kinds, 1 - held / n if words else 0.0, max(counts.values(), default=0) / n, 1 - len(set(lines)) / len(lines),
        (lengths <= 2).sum() / n, (lengths > 14).sum() / n, np.log1p(len(words)), np.log1p(len(text)), lengths.sum() / n, np.log1p(len(lines)),
    ]
    bins = [WORDS + BINS * k + int(np.searchsorted(bounds, v, "right")) for k, ((_, bounds), v) in enumerate(zip(STATISTICS, values))]
    buckets = np.fromiter((zlib.crc32(w) % WORDS for w in counts), np.int64, held)
    weights = np.bincount(buckets, np.fromiter(counts.values(), np.float64, held), WORDS) if held else np.zeros(WORDS)
    own = np.nonzero(weights)[0]
    weights = weights[own] / np.sqrt((weights[own] ** 2).sum()) if held else weights[own]
    return np.concatenate([own, bins]), np.concatenate([weights, np.ones(len(bins))])


def probability(model: dict, at: np.ndarray, x: np.ndarray) -> float:
    """Of label 1, of one text."""
    return float(probabilities(model, [(at, x)])[0])


def probabilities(model: dict, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of label 1, of several texts at once; the pairs' part by the sum-of-squares identity.
    No row is empty: every text has its statistics."""
    at, x = (np.concatenate([r[k] for r in rows]) for k in range(2))
    starts = np.cumsum([0, *(len(a) for a, _ in rows[:-1])])
    v = model["v"][at] * x[:, None]
    pairs = (np.add.reduceat(v, starts, axis=0) ** 2 - np.add.reduceat(v**2, starts, axis=0)).sum(axis=1)
    total = model["bias"] + np.add.reduceat(model["w"][at] * x, starts) + 0.5 * pairs
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> dict:
    """Logistic loss, adaptive steps, in a fixed order of rows."""
    random = np.random.default_rng(SEED)
    share = float(labels.mean()) if len(labels) else 0.5
    model = {"bias": 0.0, "w": np.zeros(DIMENSIONS), "v": random.normal(0, 0.05, (DIMENSIONS, RANK))}
    if not len(rows) or not 0 < share < 1:
        return {"bias": float(np.log((share + 1e-9) / (1 - share + 1e-9))), "w": np.zeros(DIMENSIONS), "v": np.zeros((DIMENSIONS, RANK))}
    model["bias"] = float(np.log(share / (1 - share)))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, (at, values) in enumerate(rows):
        x[k, at] = values
    seen = {"bias": 1e-8, "w": np.full(DIMENSIONS, 1e-8), "v": np.full((DIMENSIONS, RANK), 1e-8)}
    for _ in range(EPOCHS):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
            b = x[part].astype(np.float64)
            sums = b @ model["v"]
            total = model["bias"] + b @ model["w"] + 0.5 * (sums**2 - (b**2) @ (model["v"] ** 2)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[part]) / len(part)
            slope = {
                "bias": error.sum(), "w": b.T @ error + SHRINK * model["w"],
                "v": b.T @ (error[:, None] * sums) - (b**2).T @ error[:, None] * model["v"] + SHRINK * model["v"],
            }
            for name, g in slope.items():
                seen[name] = seen[name] + g**2
                model[name] = model[name] - RATE * g / np.sqrt(seen[name])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col("quality").cast("int").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py() or b"") for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))], ["doc_id", "label", "at", "x"])

    # At most ``sample`` rows of two small columns, whatever the corpus; then one row for each of them.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label")
    rows = rows.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", "label", "first.text")
    got = rows.mapInArrow(run, f"{typed(docs, 'doc_id')}, label int, at array<int>, x array<float>").toArrow()
    order = sorted(range(got.num_rows), key=lambda k, ids=got["doc_id"].to_pylist(), ls=got["label"].to_pylist(): (ids[k], ls[k]))
    y, (at, x, ends) = got["label"].to_numpy()[order].astype(np.float64), _flat(got)
    return fit([(at[ends[k] : ends[k + 1]], x[ends[k] : ends[k + 1]]) for k in order], y)


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' features and values, and where each row's begin; no number becomes an object."""
    at, x = (pa.concat_arrays([pa.array([], rows.schema.field(c).type.value_type), *(part.flatten() for part in rows[c].chunks)]).to_numpy() for c in ("at", "x"))
    lengths = [part.value_lengths().to_numpy() for part in rows["at"].chunks]
    return at, x, np.cumsum(np.concatenate([[0], *lengths])).astype(np.int64)


def score(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """Per row of ``docs`` (text): ``row``, a struct of the columns ``carry``, and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carried = "text" in carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field("text") if carried else batch.column("text")
            scores, texts = [], texts.cast(pa.binary())
            for at in range(0, len(texts), TOGETHER):
                scores.append(probabilities(sent.value, [features(t.as_py() or b"") for t in texts.slice(at, TOGETHER)]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate([[], *scores]), pa.float64())], ["row", "score"])

    packed = docs.select(F.struct(*own(carry)).alias("row"), *([] if carried else ["text"]))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    scored = scored.select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    return score(docs, train(docs, labels), docs.columns).where("score >= 0.5").select("row.*")
