"""Token files: short documents compressed each on its own, with one shared dictionary.

A file holds the documents of a range of doc_id:

    b"BTOK1\\n" | JSON header line: dictionary (SHA-256), documents, first_id, id_bytes
    one zstandard frame per document, its ids as little-endian unsigned integers
    index: doc_id, end of the frame, ids so far, each documents * int64
    int64: how many of the first documents have no doc_id
    int64: where the index begins

So one document is read with the index and one range.  The dictionary lies beside the files,
named by its SHA-256.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, pieces, texts_of
from .tokenizing import encoder

MAGIC = b"BTOK1\n"
_SHORT = 1 << 16  # bytes of a text that the dictionary may be trained on


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def train_dictionary(documents: DataFrame, tokenizer: str, dtype: str, sample: int, size: int) -> bytes:
    """A zstandard dictionary from the id arrays of at most `sample` documents of up to 64 KiB, drawn by a hash of doc_id; it serves short documents."""
    texts = documents.where(F.octet_length("text") <= _SHORT)
    share = int(min(1.0, 1.5 * sample / max(1, texts.count())) * (1 << 30))
    rows = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).limit(sample).collect()
    if not rows:
        return b""
    ids, begins = encoder(tokenizer).encode([r.text for r in rows])
    arrays = [ids[a:b].astype(dtype).tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_tokens(documents: DataFrame, tokenizer: str, path: str, end_id: int = 1, sample: int = 1000, dictionary_bytes: int = 64 << 10, files: int | None = None) -> DataFrame:
    """Encode documents (doc_id, text) and write them in ascending doc_id order; the manifest, one row per file, comes back.

    Null texts are empty; rows with a null doc_id come first; repeated rows are each written, in
    the order of their ids; an empty table gives an empty manifest.  `sample` bounds the documents that the dictionary is trained on.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    files = files or partitions(spark)
    vocabulary = encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    raw = train_dictionary(documents, tokenizer, dtype, sample, dictionary_bytes)
    name = hashlib.sha256(raw).hexdigest()
    fs, top = store(path)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/{name}.zdict") as f:
        f.write(raw)
    cuts = documents.where("doc_id is not null").approxQuantile("doc_id", [k / files for k in range(1, files)], 0.1 / files) if files > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=False)
        end = np.array([end_id], dtype)
        for batch in pieces(batches, "text"):
            ids, begins = own_encoder.encode(texts_of(batch))
            ids = ids.astype(dtype)
            docs = np.asarray(batch.column("doc_id").fill_null(np.iinfo(np.int64).min), np.int64)
            frames = [packer.compress(np.concatenate([ids[a:b], end]).tobytes()) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds, docs, "right").astype(np.int32)), batch.column("doc_id"), pa.array(np.diff(begins) + 1), pa.array(frames, pa.binary())], ["shard", "doc_id", "n", "frame"]
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(path)
        out, now, index = None, None, []

        def close():
            docs, nulls, sizes, ns = (np.concatenate(c) for c in zip(*index, strict=True))
            header = len(MAGIC) + header_size
            out.write(docs.tobytes() + (header + np.cumsum(sizes)).tobytes() + np.cumsum(ns).tobytes() + np.int64(nulls.sum()).tobytes() + np.int64(header + sizes.sum()).tobytes())
            out.close()
            return pa.RecordBatch.from_pydict({"shard": [now], "file": [file], "documents": [len(docs)], "tokens": [int(ns.sum())], "dictionary": [name]}, schema=manifest)

        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if now != int(shards[a]):
                    if out:
                        yield close()
                    now, index = int(shards[a]), []
                    file = f"part-{now:06d}-{uuid.uuid4().hex}.btok"  # an attempt that fails leaves a file that no manifest names
                    out = fs.open_output_stream(f"{top}/{file}")
                    header_size = out.write(MAGIC + json.dumps({"dictionary": name, "id_bytes": int(dtype[-1])}).encode() + b"\n") - len(MAGIC)
                part = batch.slice(a, b - a)
                frames = part.column("frame").to_pylist()
                out.write(b"".join(frames))
                index.append((np.asarray(part.column("doc_id").fill_null(0), np.int64), np.asarray(part.column("doc_id").is_null()), np.fromiter(map(len, frames), np.int64, len(frames)), np.asarray(part.column("n"), np.int64)))
        if out:
            yield close()

    manifest = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("dictionary", pa.string())])
    encoded = documents.mapInArrow(encode, "shard int, doc_id long, n long, frame binary")
    dealt = encoded.repartitionById(files, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"))  # a file a task
    rows = dealt.mapInArrow(write, "shard int, file string, documents long, tokens long, dictionary string").collect()  # a row per file
    return spark.createDataFrame(sorted(rows), "shard int, file string, documents long, tokens long, dictionary string")


def _opened(fs, top: str, file: str, kept: dict):
    f = fs.open_input_file(f"{top}/{file}")
    size = f.size()
    at = int(np.frombuffer(f.read_at(8, size - 8), np.int64)[0])
    head = f.read_at(min(4096, at), 0)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{file} isn't a token file")
    line = head[len(MAGIC) :].split(b"\n", 1)[0]
    header = json.loads(line)
    tail = np.frombuffer(f.read_at(size - 8 - at, at), np.int64)
    docs, ends, tokens = tail[:-1].reshape(3, -1)
    if (name := header["dictionary"]) not in kept:
        raw = fs.open_input_file(f"{top}/{name}.zdict").read()
        if hashlib.sha256(raw).hexdigest() != name:
            raise ValueError(f"the dictionary {name} was changed")
        kept[name] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    return f, docs, int(tail[-1]), np.concatenate([[len(MAGIC) + len(line) + 1], ends]), np.concatenate([[0], tokens]), kept[name], f"<u{header['id_bytes']}"


def read_document(path: str, file: str, row: int) -> np.ndarray:
    """The ids of one document of a file: its index, then one range."""
    fs, top = store(path)
    f, _, _, ends, _, unpacker, dtype = _opened(fs, top, file, {})
    return np.frombuffer(unpacker.decompress(f.read_at(int(ends[row + 1] - ends[row]), int(ends[row]))), dtype)


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it, over all files), n_tokens, ids_crc32 and, with keep_ids, ids_le32 (the ids, 32-bit little-endian)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids_le32 binary" * keep_ids
    rows, start, before = sorted(manifest.collect()), 0, []  # a row per file
    for r in rows:
        before.append((r.file, start))
        start += r.tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = store(path)
        kept: dict = {}
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                f, docs, nulls, ends, tokens, unpacker, dtype = _opened(fs, top, file, kept)
                lo = 0
                while lo < len(docs):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (4 << 20), "right")) - 1)
                    raw = f.read_at(int(ends[hi] - ends[lo]), int(ends[lo]))
                    ids = [np.frombuffer(unpacker.decompress(raw[ends[k] - ends[lo] : ends[k + 1] - ends[lo]]), dtype).astype("<u4") for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[lo:hi], mask=np.arange(lo, hi) < nulls),
                            pa.array(base + tokens[lo:hi]),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            *([pa.array([x.tobytes() for x in ids], pa.binary())] if keep_ids else []),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids_le32"][: 4 + keep_ids],
                    )
                    lo = hi

    if not before:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(before, "file string, base long").repartition(len(before))
    return listed.mapInArrow(read, schema)
