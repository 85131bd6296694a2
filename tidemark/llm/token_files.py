"""Token ids in bit-plane files.

A shard is one file: a magic word, then blocks of ``BLOCK`` ids.  The ids of a
block, as little-endian unsigned 32-bit integers, are transposed into four byte
planes (all low bytes, then the next, and so on) and each plane is compressed
with zstandard alone: high planes are nearly constant and vanish, low planes
compress better together.  The footer has the chunk index (offset, ids and plane
lengths of each block) and the document index (doc_id, ids of each document, as an
Arrow stream); the last 16 bytes give its length and the magic word again.

Shards follow each other in ascending doc_id order, and so do documents within a
shard; a shard ends after ``SHARD_DOCS`` documents.  Documents of one doc_id stand by
text.  A null doc_id comes first; a null text is empty and gives the end id alone; an
empty table has no shard; doc_id may have any type that can be ordered.

A tokenizer whose own file says that it works word by word (``splits_at_spaces``) has
its words' ids remembered; any other gets every whole text in one call.
"""

from __future__ import annotations

import functools
import io
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import CommittedFile, filesystem, shared_path, typed

MAGIC = b"TMPLANE2"
BLOCK = 1 << 16
PLANES = 4
#: Words a tokenizer remembers in one worker, and the longest that it remembers.
REMEMBERED, LONGEST = 600_000, 48
#: A split that is known to keep runs together, and a run of Latin letters with a run of marks after it.  Letters
#: up to U+017F but for the dotted capital I have one letter as lower case, and no other normal form.
SPLIT_BY_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RUNS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-&(-/:-@[-`{-~]*)")

#: Documents of a shard at most; their ids and lengths stay in memory until it is closed.
SHARD_DOCS = 500_000

MANIFEST = "shard long, path string, n_docs long, n_ids long, n_bytes long"
PER_DOCUMENT = "start long, n_tokens long, ids_crc32 long"


class WholeTokenizer:
    """Any tokenizer: every text is encoded as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer's file makes sure that ids are those of a text's pieces between
    blanks and line breaks, in a row, and that A-Z count as a-z: it lower-cases, keeps to
    words that hold no white space, splits a comma or full stop from letters before it, and
    adds, cuts or pads nothing."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = lambda x, many: x.get(many, [x]) if x else []
    normal, pre = parts(spec.get("normalizer"), "normalizers"), parts(spec.get("pre_tokenizer"), "pretokenizers")
    kinds = [n["type"] for n in normal]
    if "Lowercase" not in kinds or set(kinds) - {"NFC", "Lowercase", "Replace"}:
        return False
    if any(n["type"] == "Replace" and (n["pattern"], n["content"]) != ({"Regex": "\\s+"}, " ") for n in normal):
        return False
    if not pre or pre[0]["type"] != "Split" or (pre[0]["behavior"], pre[0]["invert"]) != ("Removed", True):
        return False
    if any(p["type"] != "ByteLevel" or p["add_prefix_space"] or p["use_regex"] for p in pre[1:]):
        return False
    if any(spec.get(k) for k in ("post_processor", "truncation", "padding")) or spec["model"].get("dropout"):
        return False
    plain = lambda t: t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not all(map(plain, spec["added_tokens"])):
        return False
    from tokenizers import Tokenizer

    spaces = " \n"
    probe = "".join(f"a{c}b{c}{c}1{c}.{c}" for c in spaces) + "word, word."
    found = [probe[a:b] for _, (a, b) in Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(probe)]
    return not any(c in piece for piece in found for c in spaces) and found[-4:] == ["word", ",", "word", "."]


def splits_by_runs(path: str) -> bool:
    """Whether a tokenizer that splits at spaces makes one word of every run of letters, and of
    every run of marks but apostrophes, and hands both to a byte-level model in lower case."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"].get("pretokenizers", [])
    return len(pre) == 2 and pre[0]["pattern"] == {"Regex": SPLIT_BY_RUNS} and pre[1]["type"] == "ByteLevel" and spec["model"]["type"] == "BPE"


class WordTokenizer(WholeTokenizer):
    """A tokenizer that drops white space, with its words' ids remembered.

    No token of such a tokenizer spans a space or a line break, so a text's ids
    are its pieces' ids in a row; each piece is encoded once and looked up after.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.known = Pieces(self.tokenizer, splits_by_runs(path))

    def encode(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


class Pieces(dict):
    """Ids of pieces without blanks; one that is not there yet is encoded when it is asked for.

    ``by_runs``: the tokenizer's file shows that a run of letters is one word for its model, and
    a run of marks behind it another.  Then Latin letters, in lower case, go straight to the model,
    and all spellings of a word are encoded once.
    """

    def __init__(self, tokenizer, by_runs: bool):
        super().__init__()
        self.tokenizer, self.model, self.by_runs = tokenizer, tokenizer.model, by_runs
        self.as_bytes = {}
        if by_runs:
            from tokenizers.pre_tokenizers import ByteLevel

            level = ByteLevel(add_prefix_space=False, use_regex=False)
            self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x180) if _RUNS.fullmatch(chr(c))}

    def __missing__(self, piece: str) -> bytes:
        runs = _RUNS.fullmatch(piece) if self.by_runs else None
        if runs is None:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        elif runs[2]:
            found = self[runs[1].lower()] + self[runs[2]]
        elif (word := piece.lower()) != piece:
            found = self[word]
        else:
            made = self.model.tokenize(word if word.isascii() else word.translate(self.as_bytes))
            found = struct.pack(f"<{len(made)}I", *[t.id for t in made])
        if len(piece) <= LONGEST:
            self[piece] = found
        return found


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WholeTokenizer:
    """One per worker and file: what it remembers serves the worker's later tasks."""
    return WordTokenizer(path) if splits_at_spaces(path) else WholeTokenizer(path)


class ShardWriter:
    def __init__(self, folder: str, name: str, id_type: pa.DataType = pa.int64()):
        self.id_type = id_type
        self.file = CommittedFile(folder, name)
        self.file.write(MAGIC)
        self.waiting, self.held = [], 0
        self.blocks: list[tuple[int, ...]] = []
        self.docs: list[tuple[object, int]] = []
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK:
            self._flush(whole_only=True)

    def _flush(self, whole_only: bool) -> None:
        data = b"".join(self.waiting)
        end = len(data) - len(data) % (4 * BLOCK) if whole_only else len(data)
        for at in range(0, end, 4 * BLOCK):
            ids = np.frombuffer(data, np.uint8, min(4 * BLOCK, end - at), at).reshape(-1, PLANES)
            planes = [self.pack.compress(np.ascontiguousarray(ids[:, k]).tobytes()) for k in range(PLANES)]
            where = self.file.write(b"".join(planes))
            self.blocks.append((where, len(ids), *map(len, planes)))
        self.waiting, self.held = [data[end:]], len(data) - end

    def close(self) -> None:
        self._flush(whole_only=False)
        chunk_index = np.asarray(self.blocks, "<i8").reshape(-1, 2 + PLANES)
        doc_index = pa.record_batch({"doc_id": pa.array([d for d, _ in self.docs], self.id_type), "n": pa.array([n for _, n in self.docs], pa.int64())})
        stream = io.BytesIO()
        with pa.ipc.new_stream(stream, doc_index.schema) as out:
            out.write_batch(doc_index)
        footer = self.pack.compress(struct.pack("<q", len(chunk_index)) + chunk_index.tobytes() + stream.getvalue())
        self.file.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.file.commit()


class ShardReader:
    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if self.file.read_at(8, 0) != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        (length,) = struct.unpack("<q", tail[:8])
        unpack = self.unpack = zstandard.ZstdDecompressor()
        footer = unpack.decompress(self.file.read_at(length, size - 16 - length))
        (n_blocks,) = struct.unpack_from("<q", footer)
        self.chunk_index = np.frombuffer(footer, "<i8", n_blocks * (2 + PLANES), 8).reshape(-1, 2 + PLANES)
        self.doc_index = pa.ipc.open_stream(footer[8 + self.chunk_index.nbytes :]).read_all()

    def block(self, k: int) -> bytes:
        where, n, *lengths = map(int, self.chunk_index[k])
        data, ids, at = self.file.read_at(sum(lengths), where), np.empty((n, PLANES), np.uint8), 0
        for plane, length in enumerate(lengths):
            ids[:, plane] = np.frombuffer(self.unpack.decompress(data[at : at + length]), np.uint8)
            at += length
        return ids.tobytes()

    def documents(self) -> Iterator[tuple[object, Iterable[bytes], int]]:
        """(doc_id, parts of its ids, number of ids) in order; a document may span blocks."""
        k, data, at = -1, b"", 0
        for doc_id, n in zip(self.doc_index["doc_id"].to_pylist(), self.doc_index["n"].to_pylist()):
            parts, missing = [], 4 * n
            while missing:
                if at == len(data):
                    k, at = k + 1, 0
                    data = self.block(k)
                took = min(missing, len(data) - at)
                parts.append(data[at : at + took])
                at, missing = at + took, missing - took
            yield doc_id, parts, n


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode and write all of ``docs`` (doc_id, text) below ``folder``; returns the
    manifest, one row per shard.  One shuffle, of the texts, by ranges of doc_id."""
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, part, out = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            out.close()
            row = {"shard": (task << 20) + part, "path": f"{folder}/{out.file.name}", "n_docs": len(out.docs), "n_ids": sum(n for _, n in out.docs), "n_bytes": out.file.size}
            return pa.RecordBatch.from_pylist([row], schema=manifest_schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is not None and len(out.docs) == shard_docs:
                    yield closed()
                    out, part = None, part + 1
                if out is None:
                    out = ShardWriter(folder, f"shard-{task:06d}-{part:04d}.tokens", batch.schema.field(0).type)
                out.add(doc_id, words.encode(text.as_py() or "") + end)
        if out is not None:
            yield closed()

    manifest_schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id"))
    made = rows.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/_manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with ``base``: the ids of all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, id_type: str = "doc_id long") -> DataFrame:
    """Per document, from the stored files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, rows, start = ShardReader(path), [], base
                schema = pa.schema([shard.doc_index.schema.field("doc_id"), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
                for doc_id, parts, n in shard.documents():
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part, crc)
                    rows.append((doc_id, start, n, crc))
                    start += n
                    if len(rows) == 10_000:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "base").repartition(n).mapInArrow(read, f"{id_type}, {PER_DOCUMENT}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and describe every document from the files."""
    folder = folder or shared_path(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, tokenizer_path, end_id, folder), typed(docs, "doc_id"))
