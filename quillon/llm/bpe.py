"""BPE encoding and decoding through a table of distinct words.

A first pass splits every text into the words that the tokenizer would merge
one by one and writes each document as positions in the word list of its block
of documents.  Word lists are cut by word hash into packed pieces, so that the
pieces of one hash bucket from all blocks pass through one task, which encodes
a distinct word when it is first met and answers piece by piece.  A join on the
block then brings ids back to each position.  Decoding joins the ids with the
id-to-piece table, whose size the vocabulary fixes.  Position arrays are written
once, bucketed by block, and stay where they are; packed pieces are all that is
shuffled, and a frequent word is sent once per block however often it occurs.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, pre_tokenizers

from . import common
from .splits import PLAIN, L, N, S, specials, tokenizer, word_ids

#: The pattern by which the word tokenizer splits; a fixed value of its file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of text whose words share a list.
BLOCK_CHARS = 8 << 20


class WordSplitter:
    """Cuts a text into the words the tokenizer merges on their own, and its special tokens."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.special = specials(self.tok)[1]
        self.plain = re.compile(rf"[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{S}{L}{N}]+").findall
        self.exact = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)

    def piece(self, text: str) -> list[str]:
        if PLAIN.match(text):
            return self.plain(text.lower())
        return [w for w, _ in self.exact.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text:
            return self.piece(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.piece(part)
        return out


def _pack(values: np.ndarray) -> bytes:
    """Little-endian uint32 values, all low bytes first, deflated."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


NAMES = ["block", "id", "at", "bucket", "nth", "words"]
#: Words that a packed piece of a list holds at most, and that an encoding task remembers before it starts afresh.
PIECE_WORDS, KNOWN_WORDS = 20_000, 1_000_000


def _lists(block: int, seen: dict[str, int], buckets: int, kind: pa.DataType) -> pa.RecordBatch:
    """The words of a block by hash bucket: sorted, packed in pieces, with their places in the block's list."""
    by: dict[int, list[str]] = {}
    for w in seen:
        by.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
    bucket, nth, words = [], [], []
    for k, group in by.items():
        group.sort()
        for i in range(0, len(group), PIECE_WORDS):
            some = group[i : i + PIECE_WORDS]
            bucket.append(k)
            nth.append(_pack(np.fromiter((seen[w] for w in some), np.uint32, len(some))))
            words.append(zlib.compress("\n".join(some).encode(), 1))  # words hold no white space
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(bucket, pa.int32()), pa.array(nth, pa.binary()), pa.array(words, pa.binary())], NAMES
    )


def _split(path: str, block_chars: int, buckets: int):
    """Rows of two kinds: documents as places in their block's word list, and the list itself."""

    def run(batches):
        split = WordSplitter(path)
        seen: dict[str, int] = {}
        block, size, kind = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            kind, at, blocks, full = b.column(0).type, [], [], []
            for t in b.column(1).to_pylist():
                words = split.words(t)
                at.append(_pack(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words))))
                blocks.append(block)
                size += len(t or "")
                if size >= block_chars:
                    full.append(_lists(block, seen, buckets, kind))
                    seen, block, size = {}, block + 1, 0
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), b.column(0), pa.array(at, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], NAMES
            )
            yield from full
        if seen:
            yield _lists(block, seen, buckets, kind)

    return run


def _encode(path: str):
    """Answer the packed pieces of the task's buckets one by one; a word is encoded when it is first met."""

    def run(batches):
        tok, known = tokenizer(path), {}
        special = specials(tok)[0]
        for b in batches:
            counts, flat = [], []
            for packed in b.column("words"):
                words = zlib.decompress(packed.as_py()).decode().split("\n")
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = [special[w]] if w in special else word_ids(tok, w)
                ids = [known[w] for w in words]
                counts.append(_pack(np.fromiter(map(len, ids), np.uint32, len(ids))))
                flat.append(_pack(np.fromiter((i for x in ids for i in x), np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("nth"), pa.array(counts, pa.binary()), pa.array(flat, pa.binary())], ["block", "nth", "counts", "ids"])

    return run


@functools.lru_cache(maxsize=4)
def piece_table(path: str) -> pa.Array:
    """The piece of every id of the vocabulary, by id."""
    pieces = {i: p for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}
    return pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.string())


def _joined(path: str):
    """Join the ids of a block's words, and the pieces of these ids, back by position."""

    def run(_, docs: pa.Table, lists: pa.Table) -> pa.Table:
        cols = [[_unpack(x) for x in lists.column(c).to_pylist()] for c in ("nth", "counts", "ids")]
        nth, lengths, flat = (np.concatenate(c) if c else np.zeros(0, np.uint32) for c in cols)
        start, length = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
        start[nth], length[nth] = np.cumsum(lengths, dtype=np.int64) - lengths, lengths
        pieces, blobs, decoded, counts = piece_table(path), [], [], []
        for packed in docs.column("at").to_pylist():
            at = _unpack(packed)
            n = length[at]
            total = int(n.sum())
            ids = flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(total)].astype("<u4")
            counts.append(total)
            blobs.append(ids.tobytes())
            one = pa.ListArray.from_arrays(pa.array([0, total], pa.int32()), pieces.take(pa.array(ids)))
            decoded.append(pc.binary_join(one, " ")[0])
        return pa.table({"id": docs.column("id"), "n": pa.array(counts, pa.int64()), "ids": pa.array(blobs, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    return run


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
    buckets: int | None = None,
) -> DataFrame:
    """(id, n, ids, decoded): ids as little-endian uint32 bytes and the text decoded from them.

    One row per row of ``docs``, repeated ids included; an empty table gives
    none.  Null and empty texts have no ids and decode to the empty string.
    What a task holds is bounded by ``block_chars`` and the longest text, and by
    ``KNOWN_WORDS``.  ``buckets`` (by default from the estimated size of
    ``docs``) deal words and blocks.  ``path`` names a tokenizer file without a
    decoder, which joins pieces by a space.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    buckets = buckets or common.partitions(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    split = common.bucketed(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _split(path, block_chars, buckets), f"block long, id {kind}, at binary, bucket int, nth binary, words binary"
        ),
        common.scratch(spark), "split", "block", buckets,
    )
    lists = split.where("bucket IS NOT NULL").select("bucket", F.col("block").alias("of"), "nth", "words")
    dealt = lists.repartitionById(buckets, "bucket").select(F.col("of").alias("block"), "nth", "words")
    coded = dealt.mapInArrow(_encode(path), "block long, nth binary, counts binary, ids binary")
    texts = split.where("bucket IS NULL").select("block", "id", "at")
    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        _joined(path), f"id {kind}, n long, ids binary, decoded string"
    )
