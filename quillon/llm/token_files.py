"""Token ids as flat unsigned-integer files with 64-bit document offsets.

Format, one pair of files per shard ``s`` of documents in ascending id order:

* ``ids-<s>.bin``: ids as little-endian uint16 (uint32 if the vocabulary needs it);
* ``docs-<s>.bin``: little-endian int64; the document ids, then for each 1 if
  its id is null (and given as 0), then the offsets of their first ids within
  the shard, then the shard's length.

On a local or mounted file system both are memory-mapped on reading; from
another store documents are read in ranges.  A shard's base, the number of ids in all
shards before it, is a prefix sum over the counts that its writer returns.
Writers put a file under a name of their own and rename it, so repeated or
speculative tasks leave whole files.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F, types as T

from . import common
from .splits import PLAIN, L, N, S, specials, tokenizer, word_ids

#: The split of the byte-level tokenizer over plain characters.
WORDS = rf" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Words that a worker remembers; beyond that it starts afresh.
CACHED_WORDS = 800_000
#: Documents that a reader holds at once.
READ_DOCS = 1000


class ByteEncoder:
    """Encodes as the tokenizers library does, each word once as long as it is remembered."""

    def __init__(self, path: str, dtype: str):
        self.tok, self.dtype = tokenizer(path), dtype
        ids, self.special = specials(self.tok)
        self.words = re.compile(WORDS).findall
        self.known = Known(self._word)
        self.ids = {w: self._bytes([i]) for w, i in ids.items()}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        return self._bytes(word_ids(self.tok, word))

    def __call__(self, text: str | None, end: int) -> bytes:
        tail = self._bytes([end])
        if not text:
            return tail
        if not PLAIN.match(text):
            return self._bytes(self.tok.encode(text, add_special_tokens=False).ids) + tail
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if "<|" not in text:
            return b"".join(map(self.known.__getitem__, self.words(text))) + tail
        out: list[bytes] = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.ids[part]] if i % 2 else map(self.known.__getitem__, self.words(part))
        return b"".join(out) + tail


class Known(dict):
    """Words seen so far; a new one is encoded on its first use."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.encode(word)
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> ByteEncoder:
    """One encoder per worker, whose words outlive a task."""
    return ByteEncoder(path, dtype)


def _encode(path: str, dtype: str, end: int):
    def run(batches):
        encode = encoder(path, dtype)
        for b in batches:
            ids = pa.array([encode(t, end) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], ["shard", "id", "ids"])

    return run


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder, local or remote."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    return pafs.FileSystem.from_uri(folder)


def _put(store: pafs.FileSystem, path: str, parts) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for x in parts:
            f.write(x)
    store.move(own, path)


def _write(folder: str, dtype: str):
    """Write one shard's pair of files; rows come in the order of their ids."""

    def run(key, batches):
        store, path = _place(folder)
        shard, width = key[0].as_py(), np.dtype(dtype).itemsize
        store.create_dir(path, recursive=True)
        own, names, nulls, sizes = f"{path}/ids-{shard:06d}.bin.{uuid.uuid4().hex}", [], [], []
        with store.open_output_stream(own) as f:
            for b in batches:
                nulls.append(b.column("id").is_null().to_numpy(zero_copy_only=False).astype("<i8"))
                names.append(b.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                blobs = b.column("ids").to_pylist()
                sizes.append(np.fromiter((len(x) // width for x in blobs), np.int64, len(blobs)))
                f.write(b"".join(blobs))
        store.move(own, f"{path}/ids-{shard:06d}.bin")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        _put(store, f"{path}/docs-{shard:06d}.bin", [np.concatenate(names).tobytes(), np.concatenate(nulls).tobytes(), offsets.tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([len(offsets) - 1], pa.int64()), "ids": pa.array([int(offsets[-1])], pa.int64())})

    return run


class Flat:
    """A flat file of numbers: mapped if the folder is local, else read in ranges."""

    def __init__(self, store: pafs.FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        self.size = store.get_file_info(path).size // self.dtype.itemsize
        local = isinstance(store, pafs.LocalFileSystem)
        self.file = None if local else store.open_input_file(path)
        self.mapped = np.memmap(path, dtype, "r") if local and self.size else np.zeros(0, dtype)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.file is None:
            return self.mapped[span]
        start, stop, _ = span.indices(self.size)
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(stop - start, 0) * width, start * width), self.dtype)


class Shard:
    """A shard's documents: how many, and a range of their ids, null marks, offsets and token ids."""

    def __init__(self, folder: str, shard: int, dtype: str = "<u2"):
        store, path = _place(folder)
        self.docs, self.ids = Flat(store, f"{path}/docs-{shard:06d}.bin", "<i8"), Flat(store, f"{path}/ids-{shard:06d}.bin", dtype)
        self.n = (self.docs.size - 1) // 3

    def span(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        stop = min(stop, self.n)
        at = self.docs[2 * self.n + start : 2 * self.n + stop + 1]
        return self.docs[start:stop], self.docs[self.n + start : self.n + stop] > 0, at, self.ids[int(at[0]) : int(at[-1])]


def _read(folder: str, dtype: str):
    def run(batches):
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist()):
                held = Shard(folder, shard, dtype)
                for i in range(0, held.n, READ_DOCS):
                    names, null, at, ids = held.span(i, i + READ_DOCS)
                    ends = np.array(at) - at[0]
                    crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(ends[:-1], ends[1:])]
                    yield pa.RecordBatch.from_pydict({"id": pa.array(np.array(names), mask=np.array(null)), "start": pa.array(np.array(at[:-1]) + base), "n": pa.array(np.diff(ends)), "crc": pa.array(crc, pa.int64())})

    return run


def write_token_files(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    shards: int | None = None,
) -> DataFrame:
    """Write the files of ``docs`` to ``folder`` and return (shard, docs, ids, base) of each shard.

    Documents are cut into ``shards`` (by default from the estimated size of
    ``docs``) ranges of ids by approximate quantiles of the id column (its only
    pass besides the encoding one), encoded where they are read, and their ids
    shuffled to the shards.  Ids are whole numbers or null; nulls sort first.
    Null and empty texts hold only the end id.  Rows of equal ids keep one
    entry each, by the bytes of their ids; an empty table gives no shard.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} holds no whole numbers")
    shards = shards or common.partitions(docs)
    dtype = "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
    key = F.col(id_col).cast("long")
    cuts = docs.select(key.cast("double").alias("id")).approxQuantile("id", [i / shards for i in range(1, shards)], 0.1 / shards)
    cuts = sorted({int(x) for x in cuts})
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key)) if cuts else F.lit(0)
    coded = docs.select(shard.cast("int").alias("shard"), key.alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _encode(path, dtype, end_id), "shard int, id long, ids binary"
    )
    dealt = coded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "id", "ids")
    done = common.saved(dealt.mapInArrow(_shards(folder, dtype), "shard int, docs long, ids long"), common.scratch(spark), "shards")
    # one row per shard: its base is the sum of the shards before it
    counts, base, rows = sorted(map(tuple, done.collect())), 0, []
    for s, n, ids in counts:
        rows.append((s, n, ids, base))
        base += ids
    return spark.createDataFrame(rows, "shard int, docs long, ids long, base long")


def _shards(folder: str, dtype: str):
    """Feed each run of rows with one shard number to its writer."""
    write = _write(folder, dtype)

    def run(batches):
        batches = iter(batches)
        held = [next(batches, None)]

        def of(shard):
            while (b := held[0]) is not None:
                if not b.num_rows:
                    held[0] = next(batches, None)
                    continue
                same = int(np.searchsorted(b.column("shard").to_numpy(), shard, "right"))
                if not same:
                    return
                held[0] = b.slice(same) if same < b.num_rows else next(batches, None)
                yield b.slice(0, same)

        while held[0] is not None:
            if not held[0].num_rows:
                held[0] = next(batches, None)
                continue
            key = held[0].column("shard")[0]
            yield from write([key], of(key.as_py()))

    return run


def read_token_files(index: DataFrame, folder: str, path: str) -> DataFrame:
    """(id, start, n, crc) of every document from the files of ``folder``; one task reads a few shards."""
    dtype = "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
    n = max(1, index.count())
    return index.select("shard", "base").repartitionById(n, "shard").mapInArrow(_read(folder, dtype), "id long, start long, n long, crc long")
