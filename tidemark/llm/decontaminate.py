"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items go into one suffix automaton.  The words of a
document are streamed through it once; at each word the automaton knows the
longest stretch, ending there, that some item contains.  Where that is at least
a window (13 words, or a whole shorter item), the words of the window are hit,
and the state names the items.

The automaton is sent to the executors, so its size is bounded: items are dealt by
a hash into as many blocks as it takes for ``BLOCK_WORDS`` words each, and every
block is a job of its own over all documents, so a worker holds one automaton at a
time, and keeps it for its later tasks.  With several blocks a job writes the spans
of the texts that it hits, keyed by the text's digest; these are brought together by
digest, and the documents meet them in a join.  No item or document is cut or left out.

Defined cases: null text has no words and no hits; an item without words matches
nothing, one without an id is hit but not named; equal items match together; an
empty benchmark leaves all clean; equal texts have equal hits.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import drop, materialised, own, shared_path

WINDOW = 13
#: A document is contaminated if one word in so many is hit.
COVERAGE = 20
#: Words of the items of one automaton; about 300 bytes each on an executor.
BLOCK_WORDS = 500_000

#: A word of a text as it stands; after A-Z become a-z this is the same.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Letters a-z, digits and all bytes of non-ASCII characters make words; A-Z become a-z.
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items]
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        #: Items by the state and length of a window that they contain.
        self.named: dict[int, dict[int, set[str]]] = {}
        for name, sequence in coded:
            size, state, matched = min(window, len(sequence)), 0, 0
            for word in sequence:
                state, matched = self.next[state][word], matched + 1
                while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                    state = self.link[state]
                    matched = self.length[state]
                matched = min(matched, self.length[state])
                if size and matched >= size:
                    self.named.setdefault(state, {}).setdefault(size, set()).add(name)
        #: The shortest window, and each state's nearest states with windows, itself first.
        self.shortest = min((size for x in self.named.values() for size in x), default=window)
        self.heirs: dict[int, tuple[int, ...]] = {}

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, known, word)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        made, at = len(self.next) - 1, last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = made
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[made] = known if self.length[known] == self.length[at] + 1 else self._split(at, known, word)
        return made

    def _split(self, at: int, known: int, word: int) -> int:
        clone = self._copy(known, self.length[at] + 1)
        self.link[known] = clone
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def windows_above(self, state: int) -> tuple[int, ...]:
        """The state and its suffixes' states that name items."""
        found = self.heirs.get(state)
        if found is None:
            above, at = [], state
            while at > 0:
                if at in self.named:
                    above.append(at)
                at = self.link[at]
            found = self.heirs[state] = tuple(above)
        return found

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans [a, b) of the words, merged and in order, and the items found."""
        spans: list[list[int]] = []
        items: set[str] = set()
        link, length, follow = self.link, self.length, self.next
        state, matched, shortest = 0, 0, self.shortest
        for at, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = matched = 0
                continue
            while (to := follow[state].get(word)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= shortest:
                widest = 0
                for named in self.windows_above(state):
                    for size, names in self.named[named].items():
                        if size <= matched:
                            items |= names
                            widest = max(widest, size)
                if widest:
                    a = at + 1 - widest
                    while spans and spans[-1][0] >= a:
                        spans.pop()
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = at + 1
                    else:
                        spans.append([a, at + 1])
        return spans, items


def item_blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``most`` words, each with an item more than that at
    most; the driver holds one block at a time.  Rows of equal name and text are one item."""
    words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0))
    rows = items.select(F.col("item_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("text"), words.alias("n")).where("n > 0").dropDuplicates(["name", "text"])
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("text", "name"), F.lit(n)) == k)
        yield [(r.name, bytes(r.text)) for r in block.select("name", "text").orderBy("name", "text").collect()]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


#: The one automaton of this worker, and the block that it was made of.
_held: dict[str, Automaton] = {}


def _automaton(name: str, block: list[tuple[str | None, bytes]], window: int) -> Automaton:
    if name not in _held:
        _held.clear()
        _held[name] = Automaton([(item, words_of(text)) for item, text in block], window)
    return _held[name]


SPANS = "array<struct<a:int,b:int>>"


def find(docs: DataFrame, items: DataFrame, carry: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``row``, a struct of the columns in ``carry``, with n_words,
    spans (hit words, [a, b), merged) and items (ids of the items found, as sorted strings).
    With the text in ``carry``, ``rest`` is the text without the spans, null where there are none."""
    spark, separate = docs.sparkSession, "text" not in carry
    packed = docs.select(F.struct(*own(carry)).alias("row"), *([F.col("text").alias("body")] if separate else []))
    blocks = item_blocks(items, block_words)
    sent, block = spark.sparkContext.broadcast(next(blocks)), next(blocks, None)
    if block is None:
        return packed.mapInArrow(_whole(sent, window, separate, None), _found(packed, separate))
    at, k, texts = shared_path(spark, "hits"), 0, docs.select("text")
    while True:
        texts.mapInArrow(_hits(sent, window, k), _HITS).write.mode("append").parquet(f"{at}/blocks")
        sent.destroy()
        if block is None:
            break
        sent, block, k = spark.sparkContext.broadcast(block), next(blocks, None), k + 1
    # Equal texts bring equal rows; one row for each text and block goes on.
    found = spark.read.schema(_HITS).parquet(f"{at}/blocks").groupBy("digest", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    found = found.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = materialised(found, f"{at}/texts")
    drop(spark, f"{at}/blocks")
    text = F.col("body") if separate else F.col("row.text")
    both = packed.withColumn("digest", F.unhex(F.sha2(text, 256))).join(found, "digest", "left").drop("digest")
    return both.mapInArrow(_whole(None, window, separate, "known"), _found(packed, separate))


_HITS = f"digest binary, block int, spans {SPANS}, items array<string>"


def _found(packed: DataFrame, separate: bool) -> T.StructType:
    span = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    made = [("spans", T.ArrayType(span)), ("items", T.ArrayType(T.StringType())), ("n_words", T.LongType())]
    made += [] if separate else [("rest", T.StringType())]
    return T.StructType([packed.schema["row"], *(T.StructField(n, t) for n, t in made)])


def _structs(spans: list[list[int]]) -> list[dict]:
    return [{"a": a, "b": b} for a, b in spans]


def _hits(sent, window: int, block: int):
    """The hits of one block: a row for each text that has some."""
    name = uuid.uuid4().hex
    schema = pa.schema([("digest", pa.binary()), ("block", pa.int32()), ("spans", _ARROW_SPANS), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(name, sent.value, window)
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()):
                text = text.as_py() or b""
                spans, items = machine.search(words_of(text))
                if spans:
                    rows.append({"digest": hashlib.sha256(text).digest(), "block": block, "spans": _structs(spans), "items": sorted(items - {None})})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _whole(sent, window: int, separate: bool, known: str | None):
    """Spans, items, number of words and rest of every row: by the only automaton, or
    from what the blocks' jobs have found."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None if known else _automaton(name, sent.value, window)
        for batch in batches:
            texts = batch.column("body") if separate else batch.column("row").field("text")
            told = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()) if known else itertools.repeat((None, None))
            spans, items, counts, rests = [], [], [], []
            for text, (s, i) in zip(texts.cast(pa.binary()), told):
                text = text.as_py() or b""
                words = words_of(text)
                own_spans, found = machine.search(words) if machine else ([[x["a"], x["b"]] for x in s or ()], set(i or ()))
                own_spans = _merged(own_spans)
                spans.append(_structs(own_spans))
                items.append(sorted({*found} - {None}))
                counts.append(len(words))
                rests.append(without_spans(text.decode(), own_spans) if own_spans and not separate else None)
            made = {"row": batch.column("row"), "spans": pa.array(spans, _ARROW_SPANS), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(counts, pa.int64())}
            made |= {} if separate else {"rest": pa.array(rests, pa.string())}
            yield pa.RecordBatch.from_pydict(made)

    return run


_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _hit():
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)")


def report(docs: DataFrame, items: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, items, ["doc_id"])
    found = found.select(F.col("row.doc_id").alias("doc_id"), "n_words", _hit().alias("n_hit"), "items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.expr(f"n_hit > 0 and {coverage} * n_hit >= n_words").alias("contaminated"),
    )


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in re.finditer(_WORD, text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join([*out, text[end:]])


def clean(docs: DataFrame, items: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """``docs`` without contaminated documents.  Documents under the coverage limit
    stay, without the hit spans, each of which is as long as a window; their n_chars follows."""
    found = find(docs, items, docs.columns).withColumn("n_hit", _hit()).where(f"not (n_hit > 0 and {coverage} * n_hit >= n_words)")
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    field = lambda n: F.col("row").getField(n)
    return found.select(*[(F.when(F.col("rest").isNotNull(), new[n]).otherwise(field(n)) if n in new else field(n)).alias(n) for n in docs.columns])
