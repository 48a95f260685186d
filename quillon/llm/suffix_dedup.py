"""Exact removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every string of ``length`` bytes is dealt by the least hash among its 32-byte
grams (its anchor), so equal strings always meet.  Anchors that occur once in
the corpus are dropped; the text runs around the others are gathered, equal
runs kept once with their number.  Blocks of whole anchor groups are suffix
sorted and transformed; a breadth-first backward extension of all intervals
then finds common prefixes by increasing length and stops at ``length``:
suffixes that are still undivided share that many bytes with a neighbour.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common

LENGTH = 200
GRAM = 32
ODD = 0x9E3779B97F4A7C15
CHUNK = 1 << 16
#: Strings that a run between two cuts may hold.
RUN = 256
#: Bytes of distinct runs in a block, few enough to stay in a core's cache.
BLOCK_BYTES = 1 << 16
#: Bytes of a batch to or from a worker; a single row may exceed them.
BATCH_BYTES = 4 << 20
#: An anchor with more bytes of distinct runs goes by its strings' own hashes.
GROUP_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_UP, _DOWN = _powers(ODD, CHUNK + 4096), _powers(pow(ODD, -1, 1 << 64), CHUNK + 4096)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest of every ``width`` consecutive values, by doubling."""
    p = 1
    while 2 * p <= width:
        x = pick(x[:-p], x[p:])
        p *= 2
    rest = width - p
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, length: int = LENGTH):
    """(first string, gram hashes, anchor of each string) by chunks of a text's strings."""
    for s in range(0, len(raw) - length + 1, CHUNK):
        part = raw[s : s + CHUNK + length - 1]
        x = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * _UP[: len(part)])])
        h = (x[GRAM:] - x[:-GRAM]) * _DOWN[: len(part) - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        yield s, h, _slide(h, length - GRAM + 1, np.minimum)


def anchor_counts(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text and at how many places each is one, or more."""
    found = [np.zeros(0, np.uint64)]
    width = length - GRAM + 1
    for _, h, least in anchors(raw, length):
        pad = np.zeros(width - 1, np.uint64)
        found.append(h[h == _slide(np.concatenate([pad, least, pad]), width, np.maximum)])
    return np.unique(np.concatenate(found), return_counts=True)


def runs(raw: np.ndarray, wanted: np.ndarray, length: int = LENGTH):
    """(anchor, first string, number of strings) of the runs whose anchor is among the sorted ``wanted``."""
    if not len(wanted):
        return
    for s, _, least in anchors(raw, length):
        cut = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
        value = least[cut[:-1]]
        hit = wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value
        for i in np.flatnonzero(hit).tolist():
            for a in range(int(cut[i]), int(cut[i + 1]), RUN):
                yield int(value[i].view(np.int64)), s + a, min(RUN, int(cut[i + 1]) - a)


def repeated(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, which of its strings of ``length`` bytes start anywhere else in the contents."""
    n_sep = len(contents)
    sizes = np.fromiter(map(len, contents), np.int64, n_sep)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    code = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int64) + n_sep
    code[starts[1:] - 1] = np.arange(n_sep)  # every content ends in a mark of its own
    n = len(code)
    order = _sorted(code, length)
    # the transform; row ``step[j]`` has one byte more in front than row ``j``
    last = code[order - 1]
    back = np.argsort(last.astype(np.uint16) if last.max() < 1 << 16 else last, kind="stable")
    step = np.empty(n, np.int64)
    step[back] = np.arange(n)
    edge = np.ones(n, bool)
    edge[1:] = last[back[1:]] != last[back[:-1]]
    before = np.empty(n, np.int64)  # the row above with the same byte in front
    before[back[1:]] = back[:-1]
    before[back[0]] = -1
    fresh = np.flatnonzero(edge)
    for _ in range(length - 1):  # one more byte in front of every interval that was divided last
        if not len(fresh):
            break
        ends = np.append(np.flatnonzero(edge), n)
        size = ends[np.searchsorted(ends, fresh, "right")] - fresh
        total = int(size.sum())
        if 2 * total > n:
            group = np.cumsum(edge, dtype=np.int32)
            open_ = np.flatnonzero(~edge)
            fresh = open_[group[back[open_]] != group[back[open_ - 1]]]
        else:
            rows = np.repeat(fresh - (np.cumsum(size) - size), size) + np.arange(total)
            first = before[rows] < np.repeat(fresh, size)
            fresh = step[rows[first]]
            fresh = np.sort(fresh[~edge[fresh]])
        edge[fresh] = True
    left = np.flatnonzero(~edge)
    hit = np.zeros(n + 1, bool)
    hit[order[left]] = True
    hit[order[left - 1]] = True
    return [hit[s : s + max(k - length + 1, 0)] for s, k in zip(starts.tolist(), sizes.tolist())]


def _sorted(code: np.ndarray, length: int) -> np.ndarray:
    """The suffixes ordered by their first ``length`` symbols at least, by doubling those still equal."""
    n, bits = len(code), int(code.max()).bit_length()
    pack = max(1, 62 // bits)
    padded = np.concatenate([code, np.zeros(pack, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(pack):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key)
    rank = np.zeros(2 * n + 1, np.int64)  # the place of a suffix's first equal; beyond the end 0
    slots, ordered, h = np.arange(n), key[order], pack
    here = order
    while True:
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        heads = np.flatnonzero(new)
        rank[here] = slots[np.repeat(heads, np.diff(np.append(heads, len(here))))]
        if h >= length:
            return order
        alone = new & np.append(new[1:], True)
        slots, here = slots[~alone], here[~alone]
        if not len(here):
            return order
        key = rank[here] * (n + 1) + rank[here + h] + 1
        by = np.argsort(key)
        here, ordered = here[by], key[by]
        order[slots] = here
        h *= 2


def _ranges(flags: np.ndarray, length: int) -> np.ndarray:
    """Byte ranges (start, end) of runs of flagged strings, flat int32."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return np.stack([edge[::2], edge[1::2] + length - 1], 1).astype("<i4")


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _anchor_rows(length: int):
    def run(batches):
        for b in batches:
            at, values, counts = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                u, c = anchor_counts(_raw(t), length)
                at.append(np.full(len(u), i))
                values.append(u)
                counts.append(c)
            take = pa.array(np.concatenate(at).astype(np.int64) if at else np.zeros(0, np.int64))
            cat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
            values = [v.view(np.int64) for v in values]
            yield pa.RecordBatch.from_arrays([cat(values, np.int64), b.column(0).take(take), b.column(1).take(take), cat(counts, np.int32)], ["anchor", "id", "th", "c"])

    return run


def _packed(batches):
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["id", "th", "packed"])


def _run_rows(length: int, batch_bytes: int = BATCH_BYTES):
    """A row for each run around a repeated anchor; its bytes only the first time a task sees them.

    The runs of a text hold its bytes several times over, so they go out before their batch ends.
    """
    names = ("anchor", "c1", "c2", "at", "start", "n", "bytes")

    def flush(b, rows):
        out = dict(zip(names, zip(*rows) if rows else ((),) * len(names)))
        at = pa.array(out["at"], pa.int64())
        long = lambda k: pa.array(out[k], pa.int64())
        return pa.RecordBatch.from_arrays(
            [long("anchor"), long("c1"), long("c2"), b.column("id").take(at), b.column("th").take(at), long("start"), pa.array(out["n"], pa.int32()), pa.array(out["bytes"], pa.binary())],
            ["anchor", "c1", "c2", "id", "th", "start", "n", "bytes"],
        )

    def run(batches):
        z, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            rows, size = [], 0
            for i, (packed, wanted) in enumerate(zip(b.column("packed"), b.column("anchors"))):
                if not wanted.is_valid:
                    continue
                text = z.decompress(packed.as_py())
                held = np.sort(wanted.values.to_numpy().view(np.uint64))
                for anchor, start, n in runs(np.frombuffer(text, np.uint8), held, length):
                    content = text[start : start + n + length - 1]
                    digest = xxhash.xxh3_128_digest(content)
                    if new := digest not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(digest)
                    rows.append((anchor, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), i, start, n, content if new else None))
                    size += 64 + len(content) * new
                    if size >= batch_bytes:
                        yield flush(b, rows)
                        rows, size = [], 0
            yield flush(b, rows)

    return run


def _marks(rows: list[tuple], flags: list[np.ndarray], length: int) -> pa.RecordBatch | None:
    out = []
    for (a, c1, c2, cnt, content), f in zip(rows, flags):
        if cnt > 1:
            f = np.ones(len(content) - length + 1, bool)
        if f.any():
            out.append((a, c1, c2, _ranges(f, length).tobytes()))
    a, c1, c2, r = zip(*out) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(r, pa.binary())], ["anchor", "c1", "c2", "ranges"])


def _transform(length: int, block_bytes: int):
    """Collect whole anchor groups to blocks and expand the intervals of each block.

    A group of one distinct run that occurs several times is repeated as a
    whole; there is nothing in it to expand.
    """

    def flush(rows):
        return _marks(rows, repeated([r[4] for r in rows], length), length)

    def run(batches):
        block, whole, group, size = [], [], [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and row[0] != group[0][0]:
                    (whole if len(group) == 1 and group[0][3] > 1 else block).extend(group)
                    group = []
                    size = sum(len(r[4]) for r in block) if size >= block_bytes else size
                    if size >= block_bytes:
                        yield flush(block)
                        block, size = [], 0
                    if len(whole) >= 5000:
                        yield _marks(whole, [np.zeros(0, bool)] * len(whole), length)
                        whole = []
                group.append(row)
                size += len(row[4])
        (whole if len(group) == 1 and group[0][3] > 1 else block).extend(group)
        if whole:
            yield _marks(whole, [np.zeros(0, bool)] * len(whole), length)
        if block:
            yield flush(block)

    return run


def _strings(length: int):
    """One row for each string of a run, by the hash of its bytes."""

    def run(batches):
        for b in batches:
            for a, c1, c2, cnt, content in zip(*(c.to_pylist() for c in b.columns)):
                n = len(content) - length + 1
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(content[i : i + length]) for i in range(n)), "<i8").reshape(n, 2)
                full = lambda v: pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), full(a), full(c1), full(c2), pa.array(np.arange(n, dtype=np.int32)), full(cnt)], ["w1", "w2", "anchor", "c1", "c2", "off", "cnt"])

    return run


def _cut(batches):
    """Sum up and hash what is left of each text."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for packed, marks in zip(b.column("packed").to_pylist(), b.column("marks").to_pylist()):
            text = z.decompress(packed)
            spans = merged(marks or [])
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s]))
        n, r, k, sha, spans = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def merged(marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes from the marked ranges of a text's runs."""
    spans = [np.frombuffer(m["ranges"], "<i4").reshape(-1, 2).astype(np.int64) + m["start"] for m in marks]
    if not spans:
        return []
    x = np.concatenate(spans)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    first = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(x) - 1]])
    return list(zip(x[first, 0].tolist(), reach[last].tolist()))


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that starts
    anywhere else in the table, in the same text included; ``spans`` are flat
    (start, end) byte offsets.  Null and empty texts, and texts shorter than
    ``length``, lose nothing.  Repeated rows are copies of each other; of equal
    strings none is kept.  An empty table gives none.
    """
    if length < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes have no anchor")
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    common.bounded_batches(spark, size=BATCH_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    each = common.saved(rows.mapInArrow(_anchor_rows(length), f"anchor long, id {kind}, th long, c int"), folder, "anchors")
    many = each.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select("anchor")
    wanted = each.join(many, "anchor", "left_semi").groupBy("id", "th").agg(F.collect_set("anchor").alias("anchors"))
    packed = rows.mapInArrow(_packed, f"id {kind}, th long, packed binary")
    met = _with(packed, wanted, "anchors")
    found = common.saved(
        met.select("id", "th", "packed", "anchors").mapInArrow(
            _run_rows(length), f"anchor long, c1 long, c2 long, id {kind}, th long, start long, n int, bytes binary"
        ),
        folder, "runs",
    )
    distinct = common.saved(
        found.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("cnt"), F.first("bytes", ignorenulls=True).alias("bytes")),
        folder, "distinct",
    )
    marks = common.saved(_marked(distinct, length, block_bytes, group_bytes), folder, "marks")
    for name in ("anchors", "distinct"):  # the result reads the others
        common.removed(spark, f"{folder}/{name}")
    places = found.select("anchor", "c1", "c2", "id", "th", "start").join(marks, ["anchor", "c1", "c2"])
    listed = places.groupBy("id", "th").agg(F.collect_list(F.struct("start", "ranges")).alias("marks"))
    return _with(packed, listed, "marks").select("id", "packed", "marks").mapInArrow(
        _cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    )


def _with(packed: DataFrame, other: DataFrame, column: str) -> DataFrame:
    a, b = packed.alias("a"), other.alias("b")
    met = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")), "left")
    return met.select("a.*", f"b.{column}")


def _marked(distinct: DataFrame, length: int, block_bytes: int, group_bytes: int) -> DataFrame:
    """(anchor, c1, c2, ranges) of distinct runs with repeated strings.

    An anchor whose distinct runs exceed ``group_bytes`` (a line before or
    after very many different texts) is not expanded in one task.  Its strings are
    dealt one by one by the 128-bit hash of all their bytes instead, counted
    in parts, and so never meet in one task.
    """
    hot = distinct.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > group_bytes).select("anchor")
    columns = ["anchor", "c1", "c2", "cnt", "bytes"]
    few = distinct.join(hot, "anchor", "left_anti").select(columns)
    out = few.repartition("anchor").sortWithinPartitions("anchor", "c1", "c2").mapInArrow(
        _transform(length, block_bytes), "anchor long, c1 long, c2 long, ranges binary"
    )
    if hot.isEmpty():
        return out
    each = distinct.join(hot, "anchor", "left_semi").select(columns).mapInArrow(
        _strings(length), "w1 long, w2 long, anchor long, c1 long, c2 long, off int, cnt long"
    )
    twice = each.groupBy("w1", "w2").agg(F.sum("cnt").alias("n")).where("n > 1").select("w1", "w2")
    hits = each.join(twice, ["w1", "w2"], "left_semi").groupBy("anchor", "c1", "c2").agg(F.collect_set("off").alias("offs"))
    return out.unionByName(hits.mapInArrow(_as_ranges(length), "anchor long, c1 long, c2 long, ranges binary"))


def _as_ranges(length: int):
    def run(batches):
        for b in batches:
            out = []
            for offs in b.column("offs").to_pylist():
                flags = np.zeros(max(offs) + 1, bool)
                flags[offs] = True
                out.append(_ranges(flags, length).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("anchor"), b.column("c1"), b.column("c2"), pa.array(out, pa.binary())], ["anchor", "c1", "c2", "ranges"])

    return run
