"""SimHash near-duplicates through Golay-code fuzzy keys.

A fingerprint is cut into three segments of 22, 21 and 21 bits.  Two
fingerprints that differ in at most two bits have at least one equal segment
(pigeonhole).  The segment after it holds at most two errors; its word is
decoded with the perfect binary Golay code of length 23 to the indices of all
codewords nearby: one if the word lies within two bits of a codeword, else the
six within four bits.  Any two words at distance two or less share an index,
so an equal segment and one shared index make a key that no link can miss.
About 16 keys of some 33 bits come from each distinct fingerprint; equal keys
are joined and verified with the exact bit distance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR = 0b110001110101
WIDTHS = (22, 21, 21)
#: A key of more fingerprints than this is linked through one-bit variants, not in pairs.
PAIR_LIMIT = 1000


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator."""
    left = np.array(words, dtype=np.uint32)
    for bit in range(22, 10, -1):
        left ^= ((left >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return left


def error_table() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the error patterns leading to nearby codewords, and how many there are."""
    table, count = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.uint8)
    near = np.zeros(2048, np.uint8)
    for weight in range(5):
        masks = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(23), weight)], np.uint32)
        for s, mask in zip(syndromes(masks), masks):
            if weight <= 3:
                near[s] = weight
            elif near[s] < 3:
                continue
            table[s, count[s]] = mask
            count[s] += 1
    return table, count


TABLE, COUNT = error_table()


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the word, 12-bit codeword index) of every codeword near each word."""
    s = syndromes(words)
    rows = np.repeat(np.arange(len(words)), COUNT[s])
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(COUNT[s], dtype=np.int64) - COUNT[s], COUNT[s])
    return rows, (words[rows].astype(np.uint32) ^ TABLE[s[rows], nth]) >> np.uint32(11)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, key) with keys as int64."""
    prints = prints.astype(np.uint64)
    parts, at = [], 0
    for width in WIDTHS:
        parts.append((prints >> np.uint64(at)) & np.uint64((1 << width) - 1))
        at += width
    rows, keys = [], []
    for i in range(3):
        r, index = golay_indices(parts[(i + 1) % 3])
        rows.append(r)
        keys.append((np.uint64(i) << np.uint64(34)) | (parts[i][r] << np.uint64(12)) | index.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = iter([b" ".join(words)])
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    total, n = np.zeros(64, np.int64), 0
    while block := list(itertools.islice(runs, 255 * 64)):
        n += len(block)
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in block), np.uint64, len(block))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        for i in range(0, len(bits), 255):  # byte lanes can't overflow below 256 rows
            total += np.add.reduce(bits[i : i + 255], axis=0).view(np.uint8)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _prints(shingle: int):
    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def _keys(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        rows, keys = keys_of(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of ``docs``; a null or empty text has fingerprint zero."""
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _prints(shingle), f"id {kind}, fp long"
    )


def links(prints: DataFrame, folder: str, distance: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, enough to connect all within ``distance`` (at most 2) bits.

    A key shared by up to ``pair_limit`` fingerprints is joined with itself.
    Fingerprints of larger keys are written out with their 64 one-bit
    variants: two fingerprints differ in at most two bits exactly if they
    share a variant, so each is linked to the least fingerprint of each of its
    variants.  That is linear in the group and loses no connection.
    """
    if not 0 < distance <= 2:
        raise ValueError("Golay keys find distances of one or two bits")
    keys = common.saved(prints.mapInArrow(_keys, "key long, fp long"), folder, "keys")
    sizes = common.saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), folder, "sizes")
    few = keys.join(sizes.where(F.col("n") <= pair_limit).select("key"), "key")
    a, b = few.alias("x"), few.alias("y")
    pairs = a.join(b, F.expr(f"x.key = y.key AND x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= {distance}")).select(
        F.col("x.fp").alias("a"), F.col("y.fp").alias("b")
    )
    many = sizes.where(F.col("n") > pair_limit).select("key")
    if many.isEmpty():
        return pairs.distinct()
    hot = keys.join(many, "key").select("fp").distinct()
    flips = "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))"
    spread = hot.select("fp", F.expr(flips).alias("v"))
    least = spread.groupBy("v").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = spread.join(least, "v").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return pairs.unionAll(stars.where(f"bit_count(a ^ b) <= {distance}")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """(id, fp, component): component is the least id reachable over links of near fingerprints.

    Null ids never name a component unless nothing else is in it; repeated ids
    and texts share fingerprints and so components; an empty table gives none.
    """
    folder = common.scratch(docs.sparkSession)
    prints = common.saved(fingerprints(docs, id_col, text_col, shingle), folder, "prints")
    first = common.saved(prints.groupBy("fp").agg(F.min("id").alias("first")), folder, "distinct")
    roots = common.components(links(first.select("fp"), folder, distance, pair_limit), folder)
    named = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    return common.finished(prints.join(named, "fp").select("id", "fp", "component"), folder, "components")


#: Band keys of a text; each is a hash of the least values of ROWS hash functions over its shingles.  Two texts of
#: similarity 0.8 share none with a probability of (1 - 0.8^4)^32, below one in ten million.
BANDS, ROWS = 32, 4
BITS = ["f0", "f1", "f2", "f3"]
#: Texts are compared by their shingles if their fingerprints differ by at most so many standard deviations more than expected.
DEVIATIONS = 6
#: Bytes of shingles and texts in one part of a block of texts to compare.
PART_BYTES, PART_ROWS = 8 << 20, 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FUNCTIONS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BANDS, _ROWS = _mix(_FUNCTIONS[:BANDS]), _mix(_FUNCTIONS[-ROWS:]) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text; of fewer words, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, map(b" ".join, runs)), np.uint64))


def band_keys(held: np.ndarray) -> np.ndarray:
    """The band keys of a shingle set."""
    if not len(held):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(held), 1024):
        np.minimum(least, (held[i : i + 1024, None] * _FUNCTIONS).min(0), out=least)
    return _mix((least.reshape(BANDS, ROWS) * _ROWS).sum(1) + _BANDS).view(np.int64)


def wide(held: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a shingle set, as four words; zero for none."""
    if not len(held):
        return np.zeros(4, np.uint64)
    own = _mix(held[:, None] + _FUNCTIONS[:4])
    total = np.zeros(256, np.int64)
    for i in range(0, len(own), 255):  # byte lanes can't overflow below 256 rows
        bits = np.unpackbits(own[i : i + 255].view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        total += np.add.reduce(bits, axis=0).view(np.uint8)
    return np.packbits(total * 2 > len(own), bitorder="little").view(np.uint64)


def _wide(shingle: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            prints = np.array([wide(x) for x in sets], np.uint64).reshape(-1, 4).view(np.int64)
            held = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets)).view(np.int64)
            sizes = pa.array([len(x) for x in sets], pa.int32())
            keys = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(prints[:, i].copy()) for i in range(4)), pa.array(held), sizes, keys], ["id", "th", *BITS, "held", "size", "keys"]
            )

    return run


def _sets(shingle: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, pair_limit: int = PAIR_LIMIT,
    part_bytes: int = PART_BYTES, part_rows: int = PART_ROWS,
) -> DataFrame:
    """(id, th, first_id, first_th): each row, by id and text hash, and the least row of its group.

    Texts are linked if they share ``similarity`` of their distinct shingles of
    ``shingle`` words (Jaccard, counted exactly); groups are what links
    connect.  Texts of equal shingles are one node.  Nodes meet under the Golay
    keys of their 64-bit fingerprints (two bits), and, since texts of similarity
    0.8 differ in about ten bits, under band keys too.  Then

    * every node is compared with one node of each of its keys, which joins
      most of a large group at a cost linear in it;
    * what the same key holds in different groups and within a bound of
      fingerprint bits is gathered into zones, and all texts of a zone that are
      not joined are compared, in blocks.  ``part_bytes`` and ``part_rows``
      bound a block and change only the cost.

    Null ids come last in a group; null and wordless texts are one node;
    repeated rows are copies; an empty table gives none.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    common.bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    made = rows.mapInArrow(_wide(shingle), f"id {kind}, th long, f0 long, f1 long, f2 long, f3 long, held long, size int, keys array<long>")
    prints = common.saved(made.withColumn("node", F.xxhash64(*BITS, "held")), folder, "wide")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")
    nodes = common.saved(prints.groupBy("node").agg(least, *(F.first(c).alias(c) for c in (*BITS, "size", "keys"))), folder, "nodes")
    held = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    shared = common.saved(held.join(sizes, "key"), folder, "shared")
    short = nodes.select("node", "size", *BITS)
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi  # expected share of differing bits: the angle between the shingle sets
    most = int(256 * share + DEVIATIONS * np.sqrt(256 * share * (1 - share)))

    def shingles_of(wanted: DataFrame, name: str) -> DataFrame:
        """(node, shingles) of wanted nodes; one row speaks for a node."""
        spoken = nodes.join(wanted, "node", "left_semi").select("node", F.col("first.id").alias("wid"), F.col("first.th").alias("wth"))
        spoken = common.small(common.saved(spoken, folder, f"{name}-rows"))
        met = rows.join(spoken, (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid"))).select("node", "text")
        return common.saved(met.mapInArrow(_sets(shingle), "node long, shingles array<long>").dropDuplicates(["node"]), folder, name)

    stars = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = stars.unionAll(_golay_pairs(short, folder, pair_limit)).distinct()
    pairs = pairs.join(_named(short, "a"), "a").join(_named(short, "b"), "b").where(_within(most, similarity))
    pairs = common.saved(pairs.select("a", "b"), folder, "pairs")
    sets = shingles_of(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "sets")
    linked = common.saved(_verified(pairs, sets, similarity), folder, "linked")
    roots = common.saved(common.components(linked, f"{folder}/stars"), folder, "roots")
    rooted = common.saved(
        nodes.join(roots, "node", "left").select("node", "size", *BITS, F.coalesce("root", "node").alias("root")), folder, "rooted"
    )
    zones = _zones(shared, rooted, folder, most, similarity, part_rows)
    if zones is not None:
        sets = shingles_of(zones.select("node"), "zone-sets")
        more = _zone_links(zones.join(sets, "node"), folder, most, similarity, part_bytes, part_rows)
        both = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)
        roots = common.components(both, f"{folder}/all")
    named = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("g"))
    named = named.join(firsts, "root").select("node", "g")
    out = prints.join(named, "node").select("id", "th", F.col("g.id").alias("first_id"), F.col("g.th").alias("first_th"))
    return common.finished(out, folder, "similar")


def _named(short: DataFrame, side: str) -> DataFrame:
    return short.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("size", *BITS)))


def _within(most: int, similarity: float) -> Column:
    """Whether the sizes and 256-bit fingerprints of ``a`` and ``b`` leave room for the similarity."""
    bits = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in BITS), F.lit(0))
    return (bits <= most) & (F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size"))


def _golay_pairs(short: DataFrame, folder: str, pair_limit: int) -> DataFrame:
    """(a, b): nodes of equal fingerprints, and one node each of fingerprints that Golay keys link."""
    by = short.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    by = common.saved(by, folder, "fingerprints")
    equal = short.join(by.where("n > 1"), F.col("f0") == F.col("fp")).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = links(by.select("fp"), f"{folder}/golay", 2, pair_limit)
    for side in ("a", "b"):
        near = near.join(by.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_node")), side)
    return equal.unionAll(near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are similar."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set")), side)
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.where(both / (F.size("a_set") + F.size("b_set") - both) >= similarity).select("a", "b")


def _zones(shared: DataFrame, rooted: DataFrame, folder: str, most: int, similarity: float, part_rows: int) -> DataFrame | None:
    """(zone, root, node, size, bits) of all groups between which pairs of texts may be left to link; None if none is."""
    open_ = shared.where("n > 2").select("key", "node").join(rooted.select("node", "root"), "node")
    kinds = open_.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.expr("bit_xor(node)").alias("x"),
        F.expr("bit_xor(xxhash64(node))").alias("y"),
    ).where("lo <> hi")
    # of keys that the same texts share, one is enough
    kinds = common.saved(kinds.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), folder, "open-keys")
    if kinds.isEmpty():
        return None
    near = common.saved(shared.select("key", "node").join(kinds, "key").join(rooted, "node"), folder, "open")
    few = near.where(F.col("n") <= 2 * part_rows).select(F.xxhash64("key").alias("block"), "root", "node", "size", *BITS)
    many = _blocks(near.where(F.col("n") > 2 * part_rows), part_rows).select(F.xxhash64("key", "block").alias("block"), "root", "node", "size", *BITS)
    dealt = few.unionAll(many).repartition("block").sortWithinPartitions("block", "root", "node")
    met = common.saved(dealt.mapInArrow(_forest(most, similarity), "a long, b long").distinct(), folder, "met")
    zones = common.components(met, f"{folder}/zones").select(F.col("node").alias("root"), F.col("root").alias("zone"))
    return common.saved(rooted.join(zones, "root").select("zone", "root", "node", "size", *BITS), folder, "zoned")


def _blocks(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (key, node, n) with a column ``block``: any two nodes of a key share a block.

    A key's nodes are dealt by hash to parts of about ``limit``; each two parts
    are a block, so a node is repeated once for every other part.
    """
    parts = F.ceil(F.col("n") / limit).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j != mine)
    both = F.transform(others, lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    return df.select(*df.columns, F.explode(both).alias("block"))


def _zone_links(zoned: DataFrame, folder: str, most: int, similarity: float, part_bytes: int, part_rows: int) -> DataFrame:
    """(a, b): links that join the groups of each zone.

    A zone's largest group is cut into parts, and so is the rest.  Blocks hold
    a part of the group and a part of the rest, or two parts of the rest, so a
    large group is sent once for each part of what is not in it.
    """
    weights = zoned.groupBy("zone", "root").agg(F.sum(F.col("size").cast("long") * 8).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    parts_of = lambda b, r: F.greatest(F.ceil(b / part_bytes), F.ceil(r / part_rows), F.lit(1)).cast("int")
    shape = weights.groupBy("zone").agg(F.max(F.struct("rows", "bytes", "root")).alias("top"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    shape = shape.select(
        "zone", F.col("top.root").alias("top"), ((F.col("bytes") <= part_bytes) & (F.col("rows") <= part_rows)).alias("one"),
        parts_of(F.col("top.bytes"), F.col("top.rows")).alias("p"), parts_of(F.col("bytes") - F.col("top.bytes"), F.col("rows") - F.col("top.rows")).alias("q"),
    )
    met = zoned.join(shape, "zone").withColumn("main", F.col("root") == F.col("top"))
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    block = lambda k, i, j: F.struct(F.lit(k).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    p, q = at(F.col("p")), at(F.col("q"))
    rest = F.concat(
        F.transform(upto("p"), lambda i: block(0, i, q)), F.transform(upto("q"), lambda j: block(1, F.least(j, q), F.greatest(j, q)))
    )
    where = F.when(F.col("one"), F.array(block(1, F.lit(0), F.lit(0)))).when(F.col("main"), F.transform(upto("q"), lambda j: block(0, p, j))).otherwise(rest)
    dealt = met.select(F.explode(where).alias("at"), "zone", "main", "root", "node", "size", *BITS, "shingles").select(
        F.xxhash64("zone", "at").alias("block"), (F.col("at.kind") == 0).alias("cross"), "main", "root", "node", "size", *BITS, "shingles"
    )
    found = dealt.repartition("block").sortWithinPartitions("block", "node").mapInArrow(_nearest_first(most, similarity), "a long, b long")
    return common.saved(found, folder, "zone-links")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets without repeats, neither empty."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def _groups(batches):
    """Whole groups of rows with one value in the first column; each a table of a few batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            first = b.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != first[0]:
                yield pa.Table.from_batches(held)
                held = []
            n = int(np.searchsorted(first, first[0], "right"))
            held.append(b.slice(0, n))
            b = b.slice(n)
    if held:
        yield pa.Table.from_batches(held)


def _forest(most: int, similarity: float):
    """Pairs of roots, one forest a group, between which a pair of nodes is within ``most`` bits."""

    def run(batches):
        out: list[tuple[int, int]] = []
        for g in _groups(batches):
            root, size = g.column("root").to_numpy(), g.column("size").to_numpy()
            f = np.stack([g.column(c).to_numpy() for c in BITS], 1).view(np.uint64)
            part, n = np.unique(root, return_inverse=True)[1], len(root)
            for gap in range(1, n):
                at = np.flatnonzero(part[:-gap] != part[gap:])
                small, large = np.minimum(size[at], size[at + gap]), np.maximum(size[at], size[at + gap])
                at = at[small >= similarity * large]
                at = at[np.bitwise_count(f[at] ^ f[at + gap]).sum(1) <= most]
                for i in at.tolist():
                    if part[i] != part[i + gap]:
                        out.append((int(root[i]), int(root[i + gap])))
                        part[part == part[i + gap]] = part[i]
                if gap % 64 == 0 and (part == part[0]).all():
                    break
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _nearest_first(most: int, similarity: float):
    """Links that join the groups of each block: pairs by rising distance, compared by their shingles unless joined already."""

    def candidates(root, main, size, f, cross):
        """(distance, i, j) of all pairs that may be similar, by distance."""
        found = []
        for s in range(0, len(root), 128):
            e = min(s + 128, len(root))
            ok = root[s:e, None] != root[None, s:]
            if cross:
                ok &= main[s:e, None] != main[None, s:]
            ok &= np.arange(s, e)[:, None] < np.arange(s, len(root))[None, :]
            i, j = (x.astype(np.int32) for x in np.nonzero(ok))
            i, j = i + np.int32(s), j + np.int32(s)
            fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            d = np.bitwise_count(f[i] ^ f[j]).sum(1).astype(np.uint16)
            near = d <= most
            found.append((d[near], i[near], j[near]))
        d, i, j = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(d, kind="stable")
        return i[order], j[order]

    def run(batches):
        for g in _groups(batches):
            root, node, size = (g.column(c).to_numpy() for c in ("root", "node", "size"))
            main = g.column("main").to_numpy()
            f = np.stack([g.column(c).to_numpy() for c in BITS], 1).view(np.uint64)
            sets = g.column("shingles").combine_chunks()
            flat, at = sets.values.to_numpy(), sets.offsets.to_numpy()
            part, out = np.unique(root, return_inverse=True)[1], []
            i, j = candidates(root, main, size, f, bool(g.column("cross")[0].as_py()))
            while len(i):
                joined = False
                for x, y in zip(i[:1000].tolist(), j[:1000].tolist()):
                    if part[x] != part[y] and alike(flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]]) >= similarity:
                        out.append((int(node[x]), int(node[y])))
                        part[part == part[y]] = part[x]
                        joined = True
                i, j = i[1000:], j[1000:]
                if joined:
                    apart = part[i] != part[j]
                    i, j = i[apart], j[apart]
            if out:
                yield _links(out)

    return run
