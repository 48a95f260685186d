"""Benchmark decontamination by winnowing.

Words are hashed in runs of ``k``; of every ``w`` runs in a row the least hash
is kept.  Texts that share ``w + k - 1`` words in a row keep the same hash
there, so joining the kept hashes of documents and items misses no shared
window.  Each place that a hit covers is then extended to all windows around
it, whose words are compared exactly.  DataFrame functions only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, Window

from . import common

#: Words of a window; shorter items are one window.
WINDOW = 10
GRAM = 5
#: Bits of the first test of a hash.
BITS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def grams(w: Column, n: Column, length: int) -> Column:
    """Hashes of all runs of min(GRAM, length) words, told apart by ``length``."""
    k = min(GRAM, length)
    hashes = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.lit(length), *(w[i + j] for j in range(k))))
    return F.when(n >= length, hashes).otherwise(_none("bigint"))


def winnowed(h: Column, length: int) -> Column:
    """The distinct least hashes of every window of ``length`` words."""
    width = length - min(GRAM, length) + 1
    if width == 1:
        return F.array_distinct(h)
    least = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.least(*(h[i + j] for j in range(width))))
    return F.when(F.size(h) > 0, F.array_distinct(least)).otherwise(_none("bigint"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), words(text).alias("w")).withColumn("n", F.size("w"))


def _windows(w: Column, starts: Column, length: int) -> Column:
    return F.transform(
        starts, lambda s: F.struct(s.alias("s"), F.lit(length).alias("len"), F.array_join(F.slice(w, s + 1, F.lit(length)), " ").alias("win"))
    )


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, win, len): the distinct windows of each item, its id as a string (null stays null)."""
    it = _keyed(items, id_col, text_col).where("n > 0").withColumn("len", F.least("n", F.lit(window)))
    starts = F.sequence(F.lit(0), F.col("n") - F.col("len"))
    wins = F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.col("len")), " "))
    return it.select(F.col("id").cast("string").alias("item"), F.explode(wins).alias("win"), "len").distinct()


def window_prints(windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(fp): the winnowed hash of each distinct window (win, len)."""
    parts, fp = windows.select("len", F.split("win", " ").alias("x")), _none("bigint")
    for length in range(window, 0, -1):
        fp = F.when(F.col("len") == length, winnowed(grams(F.col("x"), F.size("x"), length), length)).otherwise(fp)
    return parts.select(F.explode(fp).alias("fp")).distinct()


def bitmap(prints: DataFrame) -> Column:
    """A literal of BITS bits, those of the hashes in ``prints`` set: a first test that no member fails, of a fixed size."""
    slot = F.col("fp").bitwiseAND(BITS - 1)
    bit = F.expr("shiftleft(1L, CAST(fp & 63 AS INT))")
    words = np.zeros(BITS // 64, np.int64)
    for r in prints.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect():
        words[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")  # folded to one literal


def _set(bits: Column, fp: Column) -> Column:
    word = F.get(bits, F.shiftright(fp.bitwiseAND(BITS - 1), 6).cast("int"))
    return F.call_function("bit_get", word, fp.bitwiseAND(63).cast("int")) == 1


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(id, th, n_words, n_hit, items) of every row of ``docs``; th is the hash of its text.

    ``n_hit`` counts the words inside any occurrence of an item's window,
    ``items`` lists the ids (as strings, sorted; no nulls) of the items whose
    windows occur.  Null texts have no words; repeated rows give a row each;
    an empty table gives none; without items nothing is hit.  Items with equal
    windows are all listed.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    bench = common.saved(item_windows(items, item_id_col, item_text_col, window), folder, "windows")
    named = bench.select("win", "len").distinct().withColumn("wid", F.xxhash64("win", "len"))
    lengths = sorted((r["len"] for r in bench.select("len").distinct().collect()), reverse=True)  # at most ``window`` values
    # what is made of the windows (ten hashes of each at most) fits if four times their bytes do
    hinted = F.broadcast if 4 * common.measured(bench) <= common.BROADCAST_BYTES else lambda df: df
    prints = common.saved(window_prints(named, window), folder, "prints")
    bits = bitmap(prints)
    texts = _keyed(docs, id_col, text_col)
    fps = F.concat(*(F.col(f"f{n}") for n in lengths)) if lengths else _none("bigint")
    kept = texts.select("id", "th", "n", *(grams(F.col("w"), F.col("n"), n).alias(f"h{n}") for n in lengths))
    kept = kept.select("id", "th", "n", *(winnowed(F.col(f"h{n}"), n).alias(f"f{n}") for n in lengths))
    # one pass over the texts: the number of words of each row, and whether a kept hash is an item's too
    known = hinted(prints.withColumn("hit", F.lit(True)))
    rows = kept.select(F.monotonically_increasing_id().alias("row"), "id", "th", "n", fps.alias("fps"))
    rows = rows.select("row", "id", "th", "n", F.explode_outer("fps").alias("fp")).join(known, "fp", "left")
    base = common.saved(rows.groupBy("row", "id", "th", "n").agg(F.max("hit").alias("hit")).drop("row"), folder, "kept")
    near = common.small(base.where("hit").select(F.col("id").alias("hid"), F.col("th").alias("hth")).distinct())
    # only texts with a hit are split into words again
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    t = plain.join(near, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth"))).select("id", "th", "text")
    t = t.dropDuplicates(["id", "th"]).withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    t = t.select("id", "th", "n", "w", *(grams(F.col("w"), F.col("n"), n).alias(f"h{n}") for n in lengths))
    t = t.select("id", "th", F.concat(_none("struct<s:int,len:int,win:string>"), *(_around(n, bits) for n in lengths)).alias("v"))
    found = t.select("id", "th", F.explode("v").alias("v")).select("id", "th", "v.*")
    match = common.saved(found.join(hinted(named), ["win", "len"]).select("id", "th", "s", "len", "wid"), folder, "match")
    # the first word that no window before covers opens a run, so words are counted without a list of them
    by_text = Window.partitionBy("id", "th").orderBy("s", "len").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("s") + F.col("len")).over(by_text), F.lit(0))
    fresh = F.greatest(F.col("s") + F.col("len") - F.greatest("s", reach), F.lit(0))
    counted = match.withColumn("fresh", fresh).groupBy("id", "th").agg(F.sum("fresh").alias("n_hit"))
    owners = hinted(bench.where("item IS NOT NULL").select("item", F.xxhash64("win", "len").alias("wid")))
    listed = match.select("id", "th", "wid").distinct().join(owners, "wid").groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    c, i = counted.alias("c"), listed.alias("i")
    per = c.join(i, F.col("c.id").eqNullSafe(F.col("i.id")) & (F.col("c.th") == F.col("i.th")), "left").select("c.id", "c.th", "n_hit", "items")
    b, p = base.select("id", "th", "n").alias("b"), per.alias("p")
    out = b.join(p, F.col("b.id").eqNullSafe(F.col("p.id")) & (F.col("b.th") == F.col("p.th")), "left").select(
        "b.id", "b.th", F.col("b.n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", _none("string")).alias("items"),
    )
    return common.finished(out, folder, "contaminated")


def _around(length: int, bits: Column) -> Column:
    """All windows of ``length`` words around the places whose hash may be an item's."""
    k, h, n = min(GRAM, length), F.col(f"h{length}"), F.col("n")
    at = F.filter(F.transform(h, lambda x, i: F.when(_set(bits, x), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(
        F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (length - k), F.lit(0)), F.least(i, n - length))))
    )
    return F.when(n >= length, _windows(F.col("w"), starts, length)).otherwise(_none("struct<s:int,len:int,win:string>"))
