"""Token ids in Arrow IPC files of equal-length sequences.

A file holds record batches with two fixed-size-list columns: ``ids`` (uint16 where the
vocabulary allows, else uint32) and ``mask`` (one bit an id; false in the padding at a file's
end).  All documents of a file follow each other without gaps, each ended by an end id.  Since
lists have one length and buffers aren't compressed, sequence k of a memory-mapped file is a
slice at a computed place: no parsing and no copying.  A second file beside it holds doc_id and
n_tokens in the same order.

Files are range-partitioned by doc_id, so their names, in order, give the corpus order.  A task
writes under a name of its own and reports it; a repeated attempt writes another file, and files
that no row reports are never read.

Cases: a null or empty text is the end id alone; repeated doc_ids follow each other by their
text; a text may span many sequences; an empty table writes no file and gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import fresh_folder
from tidelog.llm.textbytes import Words, slices, strings

CACHE_WORDS = 1_200_000
BATCH_SEQUENCES = 256


class Encoder:
    """Ids of texts by a ``tokenizers`` file whose pre-tokenizer never joins across white space.

    Distinct words are encoded once; a text is the concatenation of its words' ids.  Known words
    are kept as arrays: the 64-bit hash of the word, in order, and where its ids lie.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 20, self.dtype), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words; ``hashes`` are in order and new."""
        start, size = [], []
        for low in range(0, len(words), 4096):
            coded = [e.ids for e in self.tokenizer.encode_batch(words[low : low + 4096], add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), np.int32, len(coded))
            total = int(sizes.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + total] = np.fromiter((i for x in coded for i in x), self.dtype, total)
            start.append(self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            size.append(sizes)
            self.used += total
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, np.concatenate(start))
        self.size = np.insert(self.size, at, np.concatenate(size))

    def _places(self, pieces: Words) -> np.ndarray:
        """The index of each piece among the known words, all of which are known afterwards."""
        distinct, first, inverse = np.unique(pieces.hashes, return_index=True, return_inverse=True)
        fresh = np.ones(len(distinct), bool)
        if len(self.known):
            fresh = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct
        if fresh.any():
            if len(self.known) + fresh.sum() > CACHE_WORDS:
                self._forget()
                fresh[:] = True
            self._learn(distinct[fresh], [pieces.text(k) for k in first[fresh].tolist()])
        return np.searchsorted(self.known, distinct)[inverse]

    def encode(self, texts: pa.LargeStringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        words = Words.of(texts)
        starts, ends, data = words.starts, words.ends, words.data
        rows = np.repeat(np.arange(len(texts)), words.counts)
        if not len(starts):
            return np.full(len(texts), end, self.dtype), np.ones(len(texts), np.int64)
        # A full stop or comma after an ASCII letter or digit is a token of its own in any case.
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        tail = ((last == 0x2E) | (last == 0x2C)) & (ends - starts > 1)
        tail &= ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A) | (before >= 0x30) & (before <= 0x39)
        times = 1 + tail
        piece = np.repeat(np.arange(len(starts)), times)
        second = np.zeros(len(piece), bool)
        second[np.cumsum(times)[tail] - 1] = True
        p_starts = np.where(second, ends[piece] - 1, starts[piece])
        p_ends = np.where(tail[piece] & ~second, ends[piece] - 1, ends[piece])
        rows = rows[piece]
        place = self._places(words.cut(p_starts, p_ends))
        low, size = self.start[place], self.size[place].astype(np.int64)
        counts = np.bincount(rows, size, len(texts)).astype(np.int64) + 1
        out = np.empty(counts.sum(), self.dtype)
        finish = np.cumsum(counts) - 1
        inner = np.ones(len(out), bool)
        inner[finish] = False
        shift = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        out[inner] = self.ids[shift + np.arange(len(shift))]
        out[finish] = end
        return out, counts


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them, a batch of sequences at a time."""

    def __init__(self, filesystem: fs.FileSystem, path: str, length: int, dtype: type, pad: int):
        self.length, self.dtype, self.pad, self.held, self.n_held = length, dtype, pad, [], 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = filesystem.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        step = self.length * BATCH_SEQUENCES
        if self.n_held >= step:
            held = np.concatenate(self.held)
            for low in range(0, len(held) - step + 1, step):
                self._batch(held[low : low + step], np.ones(step, bool))
            rest = held[len(held) // step * step :].copy()
            self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        if self.n_held:
            padded = np.full(-(-self.n_held // self.length) * self.length, self.pad, self.dtype)
            padded[: self.n_held] = np.concatenate(self.held)
            self._batch(padded, np.arange(len(padded)) < self.n_held)
        self.writer.close()
        self.sink.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, length: int = 2048) -> list[tuple[int, str, int, int]]:
    """Encode the texts of ``docs`` (doc_id, text) into files under ``folder`` in ascending order of doc_id.

    Returns (partition, file, documents, ids) of each file, in order.  That list has a row per
    file; no ids pass the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = index = None
        documents = total = 0
        coder = encoder(tokenizer)
        filesystem, base = fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            texts, ids = strings(batch.column("text")), batch.column("doc_id").cast(pa.int64())
            for low, high in slices(texts):
                tokens, counts = coder.encode(texts.slice(low, high - low), end)
                if out is None:
                    filesystem.create_dir(base, recursive=True)
                    out = SequenceWriter(filesystem, f"{base}/{name}.arrow", length, coder.dtype, end)
                    sink = filesystem.open_output_stream(f"{base}/{name}.docs.arrow")
                    index = pa.ipc.new_file(sink, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
                out.add(tokens)
                index.write_batch(pa.record_batch([ids.slice(low, high - low), pa.array(counts)], ["doc_id", "n_tokens"]))
                documents, total = documents + len(counts), total + len(tokens)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([documents], pa.int64()), pa.array([total], pa.int64())], ["part", "file", "documents", "ids"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange("doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "text", "_row")
    files = ordered.select("doc_id", "text").mapInArrow(run, "part int, file string, documents long, ids long").collect()
    return sorted((r["part"], r["file"], r["documents"], r["ids"]) for r in files)


def read(spark, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, file and place in the file.

    A task reads a file batch by batch (memory-mapped where the folder is local).
    """
    rows, base = [], 0
    for part, name, _, ids in files:
        rows.append((part, name, base))
        base += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, file_start long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = fs.FileSystem.from_uri(folder)
        local = isinstance(filesystem, fs.LocalFileSystem)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with filesystem.open_input_file(f"{top}/{name}.docs.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                if not len(index):
                    continue
                counts = index["n_tokens"].to_numpy()
                sums = documents_crc32(pa.memory_map(f"{top}/{name}.arrow") if local else filesystem.open_input_file(f"{top}/{name}.arrow"), counts)
                own = np.concatenate([[0], np.cumsum(counts)[:-1]])
                yield pa.record_batch(
                    [index["doc_id"].combine_chunks(), pa.array(start + own), pa.array(counts), pa.array(sums, pa.int64()), pa.array([name] * len(counts)), pa.array(own)],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "file", "file_start"],
                )

    manifest = spark.createDataFrame(rows, "part int, file string, base long")
    return manifest.repartition(len(rows), "part").mapInArrow(run, schema)


def documents_crc32(source: pa.NativeFile, counts: np.ndarray) -> list[int]:
    """crc32 of each document's ids as little-endian 32-bit integers, one batch of sequences in memory."""
    out, current, left, k = [], 0, int(counts[0]), 0
    with source:
        reader = pa.ipc.open_file(source)
        for b in range(reader.num_record_batches):
            batch = reader.get_batch(b)
            ids = batch.column("ids").flatten().to_numpy()
            mask = batch.column("mask").flatten()
            ids = ids[: pc.sum(mask.cast(pa.int64())).as_py()].astype("<u4")
            data, at = memoryview(ids).cast("B"), 0
            while at < len(ids) and k < len(counts):
                step = min(left, len(ids) - at)
                current = zlib.crc32(data[4 * at : 4 * (at + step)], current)
                at, left = at + step, left - step
                if left == 0:
                    out.append(current)
                    current, k = 0, k + 1
                    left = int(counts[k]) if k < len(counts) else 0
    return out


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a local file; the ids are a view of the mapped file."""
    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source)
        batch = reader.get_batch(k // BATCH_SEQUENCES)
        row = k % BATCH_SEQUENCES
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = 2048) -> DataFrame:
    """Write the files to a new folder of the shared folder and read them back."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "tokens")
    return read(spark, folder, write(docs, folder, tokenizer, end, length))
