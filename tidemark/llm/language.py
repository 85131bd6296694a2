"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order ``ORDER`` over lower-case letters and single
spaces.  Tables are arrays of 64-bit gram hashes in sorted order, searched by
bisection: for every order the probabilities of the grams seen, and the weight
that each context gives to the next lower order.  The hash is a bijection of up
to four 16-bit units, so grams never collide.  A text's language is that of
lowest cross-entropy per unit; the score is a softmax of the entropies whose
temperature is fitted on sample rows kept out of the counts, and so is the
entropy per language above which a text is rejected (column ``rejected``).

Fitting reads a bounded sample: about ``PER_LANGUAGE`` rows of each language,
chosen by a hash of doc_id.  Prediction reads every whole text.

Defined cases: null text, or text without a letter, is ``und`` with score 0; with
nothing to learn from every text is; equal entropies go to the first language by
code point; letters outside the basic plane count as one and the same letter; a
doc_id of any type is returned as it is.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import typed

ORDER = 4
PER_LANGUAGE = 3_000
#: Languages at most; each has a model in every scoring task.
MOST_LANGUAGES = 1_000
#: One sample row in so many calibrates instead of being counted.
CALIBRATE = 8
UNDETERMINED = "und"
#: Symbols that a model without any evidence would tell apart.
SYMBOLS = 1 << 16
ACCEPTED = 0.999
_UNITS = 1 << 20
_KNOWN = 1 << 20
_ODD, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ASTRAL = 0xFFFE


@functools.cache
def _letters() -> np.ndarray:
    table = np.fromiter((chr(c).isalpha() for c in range(SYMBOLS)), bool, SYMBOLS)
    table[_ASTRAL] = True
    return table


def units(text: str) -> np.ndarray:
    """Lower-case letters, with one space between and around words; empty without letters."""
    low = text.lower()
    data = low.encode("utf-16-le", "surrogatepass")
    if len(data) > 2 * len(low):  # letters beyond the basic plane
        low = "".join(c if c <= "\uffff" else chr(_ASTRAL) if c.isalpha() else " " for c in low)
        data = low.encode("utf-16-le", "surrogatepass")
    raw = np.frombuffer(data, np.uint16)
    letter = _letters()[raw]
    if not letter.any():
        return np.empty(0, np.uint16)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, raw, np.uint16(32))[keep]
    return out


def grams(sequence: np.ndarray) -> np.ndarray:
    """The gram that ends at each unit; spaces stand before the first."""
    padded = np.concatenate([np.full(ORDER - 1, 32, np.uint64), sequence.astype(np.uint64)])
    out = np.zeros(len(sequence), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | padded[k : k + len(sequence)]
    return out


def pieces(sequence: np.ndarray) -> Iterator[np.ndarray]:
    """Grams of a sequence, a bounded number at a time."""
    for at in range(0, len(sequence), _UNITS):
        ahead = min(at, ORDER - 1)
        yield grams(sequence[at - ahead : at + _UNITS])[ahead:]


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << 16 * order) - 1) if order < 4 else keys


def fit(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of one language from its grams of the highest order and their counts."""
    by_order = {ORDER: (keys, counts.astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):  # how many different units stand before each gram
        by_order[n] = tuple(np.unique(_low(by_order[n + 1][0], n), return_counts=True))
    tables: dict[str, np.ndarray] = {}
    below_keys = below = None
    for n in range(1, ORDER + 1):
        grams_n, c = by_order[n][0], np.asarray(by_order[n][1], np.float64)
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, of = np.unique(grams_n >> np.uint64(16), return_inverse=True)
        total, types = np.bincount(of, c), np.bincount(of)
        weight = discount * types / total
        if n == 1:
            lower = np.full(len(grams_n), 1.0 / SYMBOLS)
        else:
            lower = below[np.searchsorted(below_keys, _low(grams_n, n - 1))]
        p = np.maximum(c - discount, 0) / total[of] + weight[of] * lower
        below_keys, below = grams_n, p
        for name, ks, values in ((f"gram{n}", grams_n, p), (f"context{n}", contexts, weight)):
            hashed = ks * _ODD
            order = np.argsort(hashed)
            tables[name], tables[name + "p"] = hashed[order], values[order].astype(np.float32)
    return tables


def _find(table: dict, name: str, keys: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    hashed, known = keys * _ODD, table[name]
    at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
    return np.where(known[at] == hashed, table[name + "p"][at], other)


def log_probability(table: dict, keys: np.ndarray) -> np.ndarray:
    """Of the last unit of each gram after the units before it."""
    p = _find(table, "gram1", _low(keys, 1), _find(table, "context1", np.zeros(1, np.uint64), 1.0)[0] / SYMBOLS)
    for n in range(2, ORDER + 1):
        own = _low(keys, n)
        p = _find(table, f"gram{n}", own, _find(table, f"context{n}", own >> np.uint64(16), 1.0) * p)
    return np.log(p)


class Scorer:
    """Cross-entropies of many texts; what it found for a gram it remembers."""

    def __init__(self, models: dict[str, bytes]):
        self.languages = sorted(models)
        self.tables = [dict(np.load(io.BytesIO(models[x]))) for x in self.languages]
        self.known = np.empty(0, np.uint64)
        self.logs = np.empty((0, len(self.tables)), np.float32)

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = keys if not len(self.known) else keys[self.known[at] != keys]
        if len(new):
            if len(self.known) > _KNOWN:
                self.known, self.logs = self.known[:0], self.logs[:0]
                new = keys
            logs = np.stack([log_probability(t, new) for t in self.tables], axis=1).astype(np.float32)
            merged = np.concatenate([self.known, new])
            order = np.argsort(merged, kind="stable")
            self.known, self.logs = merged[order], np.concatenate([self.logs, logs])[order]
        return self.logs[np.searchsorted(self.known, keys)]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per unit of each text and language, units of each text)."""
        sums, n = np.zeros((len(texts), len(self.tables))), np.zeros(len(texts), np.int64)
        waiting, owners, held = [], [], 0

        def settle() -> None:
            keys, inverse = np.unique(np.concatenate(waiting), return_inverse=True)
            starts = np.cumsum([0, *(len(x) for x in waiting[:-1])])
            np.add.at(sums, owners, np.add.reduceat(self._logs(keys)[inverse], starts, axis=0, dtype=np.float64))

        for k, text in enumerate(texts):
            sequence = units(text) if text else ()
            n[k] = len(sequence)
            for part in pieces(sequence):
                waiting.append(part)
                owners.append(k)
                held += len(part)
                if held >= _UNITS:
                    settle()
                    waiting, owners, held = [], [], 0
        if waiting:
            settle()
        return -sums / np.maximum(n, 1)[:, None], n


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(rows: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text, calibrates): about ``per_language`` rows (doc_id, text, lang) of each language."""
    rows = rows.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return rows.select("lang", "text", F.lit(False).alias("calibrates"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # Each row is drawn where it is; only the sample moves.
    rows = rows.where(draw * F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")] < per_language)
    return rows.select("lang", "text", (F.pmod(F.xxhash64(F.lit("c"), "doc_id", "text"), F.lit(CALIBRATE)) == 0).alias("calibrates"))


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The models and their calibration, from rows (doc_id, text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}

            def counted(lang: str) -> pa.RecordBatch:
                keys, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in pieces(units(text.as_py())):
                    waiting.setdefault(lang, []).append(part)
                    if sum(map(len, waiting[lang])) > 2 * _UNITS:
                        yield counted(lang)
            for lang in list(waiting):
                yield counted(lang)

    def fitted(table: pa.Table) -> pa.Table:
        keys = table["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        out = io.BytesIO()
        np.savez(out, **fit(keys[order], table["n"].to_numpy()[order]))
        return pa.table({"lang": [table["lang"][0].as_py()], "model": pa.array([out.getvalue()], pa.binary())})

    drawn = sample(rows, per_language)
    counts = drawn.where("not calibrates").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    models = {r.lang: bytes(r.model) for r in counts.groupBy("lang").applyInArrow(fitted, "lang string, model binary").collect()}
    calibration = {"temperature": 1.0, "most": {}}
    if models:
        sent = drawn.sparkSession.sparkContext.broadcast(models)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(sent.value)
            for batch in batches:
                entropy, n = scorer.entropies(batch.column(1).to_pylist())
                some = n > 0
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(list(entropy[some]), pa.list_(pa.float64()))], ["lang", "entropy"])

        told = drawn.where("calibrates").select("lang", "text").mapInArrow(measure, "lang string, entropy array<double>").collect()
        calibration = calibrate(sorted(models), [(r.lang, r.entropy) for r in told])
    return {"models": models, **calibration}


def calibrate(languages: list[str], told: list[tuple[str, list[float]]]) -> dict:
    """The softmax temperature of the least loss, and the largest entropy that is accepted."""
    told = [(languages.index(x), e) for x, e in told if x in languages]
    if not told:
        return {"temperature": 1.0, "most": {}}
    right, entropy = np.array([x for x, _ in told]), np.array([e for _, e in told])
    lowest = entropy.min(axis=1, keepdims=True)

    def loss(t: float) -> float:
        scaled = (lowest - entropy) * t
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(right)), right]).mean())

    best = min((2.0 ** (k / 2) for k in range(-4, 15)), key=loss)
    most = {languages[x]: float(np.quantile(entropy[right == x, x], ACCEPTED)) for x in np.unique(right).tolist()}
    return {"temperature": best, "most": most}


PREDICTED = "lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = Scorer(model["models"])
        limits = np.array([model["most"].get(x, np.inf) for x in scorer.languages])
        for batch in batches:
            if not len(limits):
                names, score, rejected = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            else:
                entropy, n = scorer.entropies(batch.column(1).to_pylist())
                best = entropy.argmin(axis=1)
                least = entropy[np.arange(len(best)), best]
                score = np.where(n > 0, 1 / np.exp((least[:, None] - entropy) * model["temperature"]).sum(axis=1), 0.0)
                names = [scorer.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist())]
                rejected = (n == 0) | (least > limits[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{typed(docs, 'doc_id')}, {PREDICTED}")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, then predict all of them."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
