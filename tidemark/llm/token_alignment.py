"""Alignment of two tokenizers over a corpus, by its distinct segments.

A text is taken with a space before it.  ``A`` is a byte-level tokenizer (a file of the
tokenizers library), ``B`` a sentencepiece model that adds that space itself.  Where tokens
of both end at one byte, a group ends; all A tokens of a group are linked to all its B tokens.

1. Segments.  A text is cut before runs of white space that begin with a space.  No token
   can span such a cut, and that is proved from the vocabularies (``Cuts``): every merge
   makes an entry, and no entry of either has the character before the cut followed by a
   space.  A byte-level tokenizer's own pattern never joins a word to white space behind it.
2. Chunks.  Texts of about ``CHUNK`` characters share a dictionary of their segments; a
   text is a list of numbers in it.  A segment, however frequent, is one row of a chunk.
3. The dictionaries' rows are dealt by segment, and every distinct segment is tokenised and
   aligned once.  Its tokens, in order of groups, go back to the chunks that have it.
4. A chunk's documents are composed from its segments' alignments: digests, numbers of
   tokens, groups and links, and each document's distinct id pairs.
5. An id pair's documents are added up over all chunks; what the pairs count goes back to
   the chunks, which add it up for their documents.

Memory: a task holds a chunk (or one text, if that is longer), its dictionary and the pairs
of ``SLICE`` segments.  Chunks are made and written once, so a task that runs again finds the
same ones.  Nothing passes through the driver, and nothing is broadcast.

Defined cases: null and empty texts, and texts whose tokens of A or B do not join to the
text's bytes, have no tokens; strings of special tokens are plain text; repeated rows are
documents of their own; doc_id may have any type; other columns play no part; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialised, shared_path

CHUNK = 8 << 20
#: A chunk's segments, and so the place of one in it, stay below this.
MOST_SEGMENTS = 1 << 26
#: Characters of segments that a tokenizer gets in one call; segments whose pairs are expanded at a time.
CALL, SLICE = 1 << 16, 1 << 19
#: Aligned segments that a task gathers before it sends them to their chunks.
HELD = 200_000
#: Links of a group beyond which its ids are counted before they are paired.
LARGE = 1 << 12
_ID = 32
_MARK = "▁"


class ByteLevel:
    """A byte-level BPE tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["model"].get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        at = self.bytes_of_characters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for text, k in vocabulary.items():
            self.entries[k] = bytes(at[c] for c in text) if all(c in at for c in text) else text.encode()

    @staticmethod
    def bytes_of_characters() -> dict[str, int]:
        """Bytes that print stand for themselves; the others for the characters from 256 on."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.entries = [bytes([int(piece(k)[3:5], 16)]) if self.model.is_byte(k) else piece(k).replace(_MARK, " ").encode() for k in range(self.model.get_piece_size())]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:], num_threads=1)


def _tokenizer(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class Cuts:
    """Where no token of given tokenizers can span: before a space whose character before it is
    not white space and precedes a space in no entry."""

    def __init__(self, *tokenizers: ByteLevel | Pieces):
        found = {e[:k] for t in tokenizers for e in t.entries for k in range(1, len(e)) if e[k : k + 1] == b" "}
        self.never = {x.decode()[-1] for x in found if self._decodes(x)}
        # Part of a character may end many characters.
        self.bytes = {x[-1] for x in found if not self._decodes(x)}
        if any(b < 128 for b in self.bytes):
            raise ValueError("an entry that is no text has a space within")
        self._odd = re.compile(r"[\s%s] |^ | $" % re.escape("".join(sorted(self.never - {" "}))))

    @staticmethod
    def _decodes(x: bytes) -> bool:
        try:
            return bool(x.decode())
        except UnicodeDecodeError:
            return False

    def closed(self, text: str) -> bool:
        """Whether a space after ``text`` begins a segment."""
        last = text[-1]
        return not (last.isspace() or last in self.never or last.encode(errors="replace")[-1] in self.bytes)

    def segments(self, text: str) -> list[str]:
        """Segments of a text with a space before it; each begins with a space, and none is only that."""
        pieces = text.split(" ")
        if not self.bytes and not self._odd.search(text):
            return pieces
        out = [pieces[0]]
        for p in pieces[1:]:
            if self.closed(" " + out[-1]):
                out.append(p)
            else:
                out[-1] += " " + p
        if len(out) > 1 and not out[-1]:
            out.pop()
            out[-1] += " "
        return out


class Aligner:
    """Tokens of segments in order of groups, as numbers 2 * id (A) and 2 * id + 1 (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.tokenizers = _tokenizer(path_a), _tokenizer(path_b)
        self.cuts = Cuts(*self.tokenizers)
        self.entries = [np.array(t.entries, object) for t in self.tokenizers]
        self.lengths = [np.fromiter(map(len, t.entries), np.int64, len(t.entries)) for t in self.tokenizers]

    def _encode(self, k: int, segments: list[str], data: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """(ids, tokens of each segment or -1); segments that close are tokenised as one text."""
        ids = np.asarray(self.tokenizers[k].encode("".join(segments)), np.int64)
        ends = np.cumsum(self.lengths[k][ids])
        want = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        at = np.searchsorted(ends, want)
        if len(ids) and at[-1] == len(ids) - 1 and (ends[at] == want).all() and b"".join(self.entries[k][ids].tolist()) == b"".join(data):
            return [ids], np.diff(at, prepend=-1).tolist()
        if len(segments) == 1:
            return [], [-1]
        half = len(segments) // 2
        left, right = self._encode(k, segments[:half], data[:half]), self._encode(k, segments[half:], data[half:])
        return left[0] + right[0], left[1] + right[1]

    def streams(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all numbers, how many of each segment); -1 where A or B does not give the segment's bytes."""
        data = [s.encode() for s in segments]
        calls, held = [[]], 0
        for n, s in enumerate(segments):
            calls[-1].append(n)
            held += len(s)
            if held > CALL or not self.cuts.closed(s):
                calls.append([])
                held = 0
        ids, counts = ([], []), ([], [])
        for call in filter(None, calls):
            one, own = [segments[n] for n in call], [data[n] for n in call]
            for k in (0, 1):
                got = self._encode(k, one, own)
                ids[k].extend(got[0])
                counts[k].extend(got[1])
        counts = [np.array(c, np.int64) for c in counts]
        ids = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids]
        good = (counts[0] >= 0) & (counts[1] >= 0)
        # A segment that only one of the two gives is left out.
        ids = [x[np.repeat(good[c >= 0], c[c >= 0])] for x, c in zip(ids, counts)]
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, ids)]
        both = np.intersect1d(*ends, assume_unique=True)
        keys = [2 * np.searchsorted(both, e) + k for k, e in enumerate(ends)]
        order = np.argsort(np.concatenate(keys), kind="stable")
        return np.concatenate([2 * ids[0], 2 * ids[1] + 1])[order], np.where(good, counts[0] + counts[1], -1)


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """32-bit numbers as one binary value for each count, null for -1."""
    ends = np.concatenate([[0], np.cumsum(4 * np.maximum(counts, 0))]).astype(np.int32)
    made = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.astype("<i4").tobytes())])
    return pc.if_else(pa.array(counts >= 0), made, pa.scalar(None, pa.binary()))


def _table(schema: pa.Schema, n: int, columns: dict) -> pa.Table:
    """``n`` rows with the given columns (arrays, or plain values), null in the others."""
    made = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, schema)], schema=schema)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _chunker(path_a: str, path_b: str, chunk: int, kind: pa.DataType):
    """(doc_id, text) to chunks: a row of documents, and one for each segment of the dictionary."""
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("segment", pa.string()), ("ids", pa.list_(kind)), ("sizes", pa.binary()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = aligner(path_a, path_b).cuts
        number = TaskContext.get().partitionId() << 12
        ids, codes, known, held = [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(c) for c in codes], "<i4")
            row = {"chunk": [number], "sizes": [_packed(sizes)], "codes": [_packed(np.concatenate(codes))]}
            row["ids"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids))
            yield from _table(schema, 1, row).to_batches()
            segments = list(known)
            for at in range(0, len(segments), 50_000):
                part = segments[at : at + 50_000]
                yield from _table(schema, len(part), {"place": np.arange(at, at + len(part)) + number * MOST_SEGMENTS, "segment": part}).to_batches()

        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                ids.append(batch.column(0).slice(k, 1))
                text = text.as_py()
                found = cuts.segments(text) if text else ()
                code = known.setdefault
                codes.append(np.fromiter((code(s, len(known)) for s in found), "<i4", len(found)))
                held += len(text or "")
                if held >= chunk or len(ids) >= chunk // 16:
                    yield from flush()
                    ids, codes, known, held, number = [], [], {}, 0, number + 1
        if ids:
            yield from flush()

    return run


def _aligned(path_a: str, path_b: str):
    """(place, segment), equal segments behind each other, to (chunk, entries): each different
    one is aligned once; what a task has for a chunk travels as one packed value."""
    schema = pa.schema([("chunk", pa.int64()), ("entries", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, places, held = None, None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            place, aligned = np.concatenate(places), pa.concat_arrays(held)
            order = np.argsort(place)
            place, aligned = place[order], aligned.take(pa.array(order))
            sizes = np.asarray(pc.fill_null(pc.binary_length(aligned), -4)).astype("<i4") // 4
            data = np.frombuffer(b"".join(x.as_buffer() for x in aligned if x.is_valid), "<i4")
            chunk, code, ends = place // MOST_SEGMENTS, (place % MOST_SEGMENTS).astype("<i4"), np.cumsum(np.maximum(sizes, 0))
            begins = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
            for a, b in zip(begins, [*begins[1:], len(chunk)]):
                own = data[ends[a] - max(sizes[a], 0) : ends[b - 1]]
                packed = _packed(np.concatenate([np.array([b - a], "<i4"), np.diff(code[a:b], prepend=0), sizes[a:b], own]).astype("<i4"))
                yield _table(schema, 1, {"chunk": chunk[a : a + 1], "entries": [packed]}).to_batches()[0]

        for batch in batches:
            runs = batch.column(1).dictionary_encode()
            segments = runs.dictionary.to_pylist()
            new = segments[1:] if segments and segments[0] == last else segments
            own = _binaries(*aligner(path_a, path_b).streams([" " + s for s in new])) if new else pa.array([], pa.binary())
            if len(new) < len(segments):
                own = pa.concat_arrays([tokens, own])
            if segments:
                last, tokens = segments[-1], own.slice(len(own) - 1)
            places.append(np.asarray(batch.column(0)))
            held.append(own.take(runs.indices))
            if sum(map(len, places)) >= HELD:
                yield from flush()
                places, held = [], []
        if places:
            yield from flush()

    return run


class Entries:
    """A chunk's segments by code: their tokens and what follows from these."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray):
        """``sizes`` has the tokens of each, -1 where there is no alignment."""
        order, self.n = np.argsort(codes), len(codes)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        starts, sizes = starts[order], sizes[order]
        self.bad, sizes = sizes < 0, np.maximum(sizes, 0)
        self.tokens = tokens[_ranges(starts, sizes)]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.is_b = self.tokens & 1
        # A group begins at an A token behind a B token, or at a segment's begin.
        first = np.zeros(len(self.tokens) + 1, bool)
        first[1:-1] = (self.is_b[:-1] == 1) & (self.is_b[1:] == 0)
        first[self.starts] = True
        self.begins = np.flatnonzero(first[:-1])
        self.groups = self._sum(first[:-1])
        long = np.append(self.begins, len(self.tokens))
        self.group_b = np.add.reduceat(self.is_b, self.begins, dtype=np.int64) if len(self.begins) else self.begins
        self.group_a = np.diff(long) - self.group_b
        self.n_b = self._sum(self.is_b)
        self.n_a = sizes - self.n_b
        # Groups lie one behind the other, as segments do.
        links, ends = np.concatenate([[0], np.cumsum(self.group_a * self.group_b)]), np.cumsum(self.groups)
        self.links = links[ends] - links[ends - self.groups]

    @classmethod
    def unpacked(cls, packed: list[bytes]) -> Entries:
        parts = [(np.zeros(0, "<i4"),) * 3]
        for x in packed:
            values = _unpacked(x, "<i4")
            n = int(values[0])
            parts.append((np.cumsum(values[1 : n + 1]), values[n + 1 : 2 * n + 1], values[2 * n + 1 :]))
        return cls(*map(np.concatenate, zip(*parts)))

    def _sum(self, values: np.ndarray) -> np.ndarray:
        """Sums of the tokens' values over each segment."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.ends] - total[self.starts]

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each segment."""
        before = np.concatenate([[0], self.is_b[:-1]]) if len(self.is_b) else self.is_b
        between = np.where(before == self.is_b, 1, np.where(self.is_b == 1, 2, 3)).astype(np.int64)
        between[self.starts[self.starts < self.ends]] = 0
        keys = (self.tokens >> 1).astype(np.int64) * 4 + between
        marks = (b"", b",", b"|", b";")
        shown = {k: marks[k & 3] + str(k >> 2).encode() for k in np.unique(keys).tolist()}
        parts = [shown[k] for k in keys.tolist()]
        return [b"".join(parts[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, links, end): id pairs of the segments one after the other, and where each segment's end."""
        many = self.group_a * self.group_b > LARGE
        of = np.searchsorted(self.ends, self.begins, "right")  # the groups' segments
        small = np.flatnonzero(~many)
        a, b, begin = self.group_a[small], self.group_b[small], self.begins[small]
        n = a * b
        group = np.repeat(np.arange(len(small)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = self.tokens[begin[group] + place // b[group]].astype(np.int64)
        right = self.tokens[begin[group] + a[group] + place % b[group]].astype(np.int64)
        pair, links, owner = [((left >> 1) << _ID) + (right >> 1)], [np.ones(len(left), np.int64)], [of[small][group]]
        for g in np.flatnonzero(many):
            at, mid = self.begins[g], self.begins[g] + self.group_a[g]
            ids_a, times_a = np.unique(self.tokens[at:mid] >> 1, return_counts=True)
            ids_b, times_b = np.unique(self.tokens[mid : mid + self.group_b[g]] >> 1, return_counts=True)
            pair.append(((ids_a[:, None].astype(np.int64) << _ID) + ids_b).ravel())
            links.append((times_a[:, None] * times_b).ravel())
            owner.append(np.full(len(pair[-1]), of[g]))
        pair, links, owner = map(np.concatenate, (pair, links, owner))
        order = np.argsort(owner, kind="stable")
        return pair[order], links[order], np.cumsum(np.bincount(owner, minlength=self.n)) if self.n else np.zeros(0, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of given starts and sizes, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _document_pairs(entries: Entries, sizes: np.ndarray, codes: np.ndarray):
    """(pair ids, documents of each, pairs of each document, pair numbers, links) of a chunk's documents."""
    pair, links, ends = entries.pairs()
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    ids, number = np.unique(pair, return_inverse=True)
    doc_ends = np.cumsum(sizes)
    in_docs, counts, numbers, times = np.zeros(len(ids), np.int64), np.zeros(len(sizes), np.int64), [], []
    at = 0
    while at < len(sizes):
        base = doc_ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(doc_ends, base + SLICE, "right")))
        own = codes[base : doc_ends[to - 1]].astype(np.int64)
        doc = np.repeat(np.arange(at, to), sizes[at:to])
        key, repeats = np.unique(doc * max(entries.n, 1) + own, return_counts=True)
        doc, own = key // max(entries.n, 1), key % max(entries.n, 1)
        n = ends[own] - starts[own]
        where = _ranges(starts[own], n)
        key = np.repeat(doc, n) * max(len(ids), 1) + number[where]
        order = np.argsort(key, kind="stable")
        key, time = key[order], (links[where] * np.repeat(repeats, n))[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, time = key[new], np.add.reduceat(time, new) if len(new) else time
        doc, found = key // max(len(ids), 1), key % max(len(ids), 1)
        in_docs += np.bincount(found, minlength=len(ids))
        counts += np.bincount(doc, minlength=len(sizes))
        numbers.append(found.astype("<i4"))
        times.append(time)
        at = to
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return ids, in_docs, counts, join(numbers, "<i4"), join(times, np.int64)


def _documents(chunk: pa.Table, words: pa.Table) -> tuple[Entries, np.ndarray, np.ndarray]:
    """A chunk's segments, and its documents' sizes and codes; documents with a segment that does not align have none."""
    entries = Entries.unpacked(words["entries"].to_pylist())
    sizes, codes = _unpacked(chunk["sizes"][0].as_py(), "<i4").astype(np.int64), _unpacked(chunk["codes"][0].as_py(), "<i4")
    if entries.bad.any():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.bincount(owner, entries.bad[codes], len(sizes)) > 0
        codes, sizes = codes[~bad[owner]], np.where(bad, 0, sizes)
    return entries, sizes, codes


_STATS = ("n_a", "n_b", "n_groups", "n_links")


def _composer(kind: pa.DataType):
    """A chunk's documents with their segments' alignments, to a row of results and one for each id pair."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(kind)), *((c, pa.binary()) for c in (*_STATS, "counts", "numbers", "times")), ("digests", pa.list_(pa.string())), ("number", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64())])

    def run(chunk: pa.Table, words: pa.Table) -> pa.Table:
        entries, sizes, codes = _documents(chunk, words)
        ends = np.cumsum(sizes)
        total = lambda values: (lambda t: t[ends] - t[ends - sizes])(np.concatenate([[0], np.cumsum(values[codes])]))
        found = [total(v) for v in (entries.n_a, entries.n_b, entries.groups, entries.links)]
        texts, listed, digests = entries.texts(), codes.tolist(), []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            digests.append(hashlib.sha256(b";".join([texts[c] for c in listed[a:b]])).hexdigest() if b > a else "")
        ids, in_docs, counts, numbers, times = _document_pairs(entries, sizes, codes)
        columns = {"chunk": [chunk["chunk"][0].as_py()], "ids": chunk["ids"].combine_chunks(), "digests": [digests]}
        columns |= {c: [_packed(v)] for c, v in zip((*_STATS, "counts", "numbers", "times"), (*found, counts, numbers, times))}
        own = {"chunk": np.full(len(ids), columns["chunk"][0]), "number": np.arange(len(ids)), "pair": ids, "docs": in_docs}
        return pa.concat_tables([_table(schema, 1, columns), _table(schema, len(ids), own)])

    return run


def _summer(kind: pa.DataType):
    """A chunk's results with what its id pairs count, to documents."""
    schema = pa.schema([("doc_id", kind), *((c, pa.int64()) for c in (*_STATS, "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(pairs["number"]))
        count, best = np.asarray(pairs["n"]).astype(np.int64)[order], np.asarray(pairs["best"]).astype(np.int64)[order]
        get = lambda c, kind="<i8": _unpacked(chunk[c][0].as_py(), kind)
        counts, numbers, times = get("counts"), get("numbers", "<i4"), get("times")
        ends = np.cumsum(counts)
        total = lambda values: (lambda t: t[ends] - t[ends - counts])(np.concatenate([[0], np.cumsum(values[numbers] * times)]))
        columns = [chunk["ids"].combine_chunks().flatten(), *map(get, _STATS), total(best), total(count), chunk["digests"].combine_chunks().flatten()]
        return _table(schema, len(counts), dict(zip(schema.names, columns)))

    return run


def _chunks(docs: DataFrame, path_a: str, path_b: str, chunk: int, at: str) -> tuple[DataFrame, DataFrame, str, pa.DataType]:
    """(chunks, their segments aligned, doc_id's type as SQL and for Arrow)."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    name, kind = id_type.simpleString(), to_arrow_type(id_type)
    made = docs.select("doc_id", "text").mapInArrow(_chunker(path_a, path_b, chunk, kind), f"chunk long, place long, segment string, ids array<{name}>, sizes binary, codes binary")
    made = materialised(made, f"{at}/chunks", compression="zstd")
    words = made.where("segment is not null").select("place", "segment")
    aligned = words.repartition("segment").sortWithinPartitions("segment").mapInArrow(_aligned(path_a, path_b), "chunk long, entries binary")
    return made.where("segment is null").select("chunk", "ids", "sizes", "codes"), aligned, name, kind


def report(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, at = docs.sparkSession, shared_path(docs.sparkSession, "alignment")
    chunks, words, name, kind = _chunks(docs, path_a, path_b, chunk, at)
    binary = ", ".join(f"{c} binary" for c in (*_STATS, "counts", "numbers", "times"))
    composed = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        _composer(kind), f"chunk long, ids array<{name}>, {binary}, digests array<string>, number int, pair long, docs long"
    )
    composed = materialised(composed, f"{at}/composed", compression="zstd")
    drop(spark, f"{at}/chunks")
    pairs = composed.where("pair is not null").select("chunk", "number", "pair", "docs")
    counted = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", _ID)))  # an id's pairs: no more than the other vocabulary has ids
    counted = materialised(counted.select("pair", "n", (F.col("n") == most).alias("best")), f"{at}/counts")
    told = pairs.join(counted, "pair").select(F.col("chunk").alias("of"), "number", "n", "best")
    results = composed.where("pair is null").drop("number", "pair", "docs")
    stats = ", ".join(f"{c} long" for c in (*_STATS, "n_best", "count_sum"))
    return results.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_summer(kind), f"doc_id {name}, {stats}, groups_sha256 string")


def alignments(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and its groups, an array of (a, b): ids of A and of B that cover the same bytes."""
    chunks, words, name, kind = _chunks(docs, path_a, path_b, chunk, shared_path(docs.sparkSession, "alignment"))
    group = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
    schema = pa.schema([("doc_id", kind), ("groups", pa.list_(group))])

    def run(chunk: pa.Table, words: pa.Table) -> pa.Table:
        entries, sizes, codes = _documents(chunk, words)
        ids, ends, out = chunk["ids"].combine_chunks().flatten(), np.cumsum(sizes), []
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        group_end = np.cumsum(entries.groups)
        for k, (a, b) in enumerate(zip(ends - sizes, ends)):
            own = codes[a:b].astype(np.int64)
            tokens = entries.tokens[_ranges(entries.starts[own], entries.ends[own] - entries.starts[own])]
            of = _ranges((group_end - entries.groups)[own], entries.groups[own])
            sides = [pa.ListArray.from_arrays(offsets(n[of]), pa.array((tokens[tokens % 2 == k] >> 1).astype(np.int32))) for k, n in enumerate((entries.group_a, entries.group_b))]
            groups = pa.StructArray.from_arrays(sides, fields=list(group))
            out.append(pa.table([ids.slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), groups)], schema=schema))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(run, f"doc_id {name}, groups array<struct<a: array<int>, b: array<int>>>")
