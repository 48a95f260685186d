"""Secret scan by corpus-wide ownership frequency.

Three fixed kinds of secrets are found by pattern in every text.  Beside them,
every long token that mixes letters and digits is a candidate.  The values of
both are hashed and counted over the whole corpus by distinct repositories and
distinct owners: what several owners hold is a widely copied example, what one
owner holds looks like a live credential.  Every span says which; a candidate
outside the fixed kinds is a span only if it looks live.  DataFrame functions
only; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: (kind, pattern, least length, group whose length counts) in the order of the kinds; fixed values.
#: Letters in either case are spelt out, so that every engine folds the same ones.
KINDS = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    ("access", "AKIA[A-Z0-9]+", 18, 0),
    ("hex", "[0-9a-f]+", 16, 0),
)
#: Long tokens that the ownership counts judge.
CANDIDATE = "[A-Za-z0-9_-]{20,}"
#: A value looks live if at most so many owners hold it, in however many repositories; else it is a copied example.
MAX_OWNERS = 1
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,owners:bigint,repositories:bigint,live:boolean>>"
#: Patterns that a text needs for any match of a kind; they only save work.
HINTS = {
    "assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}",
    "access": "AKIA",
    "hex": "[0-9a-f]{16}",
    "owned": CANDIDATE,
}


def _spans(text: Column, kind: str, order: int, pattern: str, least: int, group: int) -> Column:
    """Array of (start, kind order, kind, end, value) of the non-overlapping leftmost matches.

    Matches and the pieces between them come from the same pattern, so their
    running lengths (in code points) give the places.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("len"), value.alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        one = F.struct(
            begin.alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")
        )
        return F.struct(
            end.alias("at"),
            F.when(F.length(x["value"]) >= least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"),
        )

    empty = start["found"]
    return F.when(text.rlike(HINTS[kind]), F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(empty)


def _mixed(value: Column) -> Column:
    """Whether a candidate mixes letters and digits, four of each at least."""
    return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4)


def joined(spans: Column, *more: Callable[[Column], Column]) -> Column:
    """kind:start:end, and what ``more`` says, of sorted spans, comma-joined."""
    parts = lambda s: (s["kind"], s["start"].cast("string"), s["end"].cast("string"), *(f(s).cast("string") for f in more))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", *parts(s))))


def verdict(span: Column) -> Column:
    """``live`` or ``copied``."""
    return F.when(span["live"], "live").otherwise("copied")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_assign, n_access, n_hex, base and spans.

    ``base`` is an array of (start, rank, kind, end) by start, then kind;
    places count code points and ends are exclusive.  ``spans`` adds the numbers
    of owners and repositories that hold the span's value anywhere in the
    corpus, and whether it is ``live``: held by ``max_owners`` owners at most.
    It holds every base span and, as kind ``owned``, every live candidate
    outside of base spans.  Null owners and repositories count as one each.
    Null texts have no span; repeated rows give a row each and are one entry
    of one repository; an empty table gives none.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
    )
    kinds = [_spans(text, k, i, p, n, g).alias(k) for i, (k, p, n, g) in enumerate(KINDS)]
    extra = F.filter(_spans(text, "owned", len(KINDS), CANDIDATE, 20, 0), lambda s: _mixed(s["value"]))
    found = rows.select("id", F.xxhash64(text).alias("text_hash"), "repository", "owner", *kinds, extra.alias("extra"))
    base = F.array_sort(F.concat(*(F.col(k[0]) for k in KINDS)))
    found = found.select("id", "text_hash", "repository", "owner", base.alias("base"), "extra")
    outside = F.filter("extra", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    hashed = lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h1"), F.hash(s["value"]).alias("h2")
    )
    found = common.saved(
        found.select("id", "text_hash", "repository", "owner", F.transform("base", hashed).alias("base"), F.transform(outside, hashed).alias("extra")), folder, "found"
    )
    each = found.select("id", "text_hash", "repository", "owner", F.explode(F.concat("base", "extra")).alias("s")).select("id", "text_hash", "repository", "owner", "s.*")

    def held_by(column: str, name: str) -> DataFrame:
        # distinct holders first, so that a hash in very many documents is counted in parts
        holder = F.coalesce(F.concat(F.lit("="), column), F.lit("")).alias("x")
        return each.select("h1", "h2", holder).distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias(name))

    counts = common.saved(held_by("owner", "owners").join(held_by("repository", "repositories"), ["h1", "h2"]), folder, "counts")
    judged = each.join(common.small(counts), ["h1", "h2"]).withColumn("live", F.col("owners") <= max_owners)
    span = F.struct("start", "rank", "kind", "end", "owners", "repositories", "live")
    listed = judged.where("live OR kind <> 'owned'").groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    f, a = found.alias("f"), listed.alias("a")
    out = f.join(a, F.col("f.id").eqNullSafe(F.col("a.id")) & (F.col("f.text_hash") == F.col("a.text_hash")), "left")
    count = lambda k: F.size(F.filter("f.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    bare = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    out = out.select(
        F.col("f.id").alias("id"), F.col("f.text_hash").alias("text_hash"), *(count(k[0]) for k in KINDS), F.transform("f.base", bare).alias("base"),
        F.coalesce("a.spans", F.array().cast(SPANS)).alias("spans"),
    )
    return common.finished(out, folder, "spans")


def redacted(
    docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", copied: str = "[EXAMPLE]"
) -> DataFrame:
    """``docs`` with every span of (id, text_hash, spans) replaced by ``mark``, or ``copied`` if it isn't live; other columns stay as they are."""
    s = spans.where(F.size("spans") > 0).dropDuplicates(["id", "text_hash"]).select("id", "text_hash", "spans")
    s = common.small(s).alias("_s")
    d = docs.alias("_d")
    text = F.col(f"_d.`{text_col}`")
    met = d.join(s, F.col(f"_d.`{id_col}`").eqNullSafe(F.col("_s.id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_s.text_hash")), "left")
    clean = cut(text, F.col("_s.spans"), mark, copied)
    return met.select(*(clean.alias(c) if c == text_col else F.col(f"_d.`{c}`").alias(c) for c in docs.columns))


def cut(text: Column, spans: Column, mark: str, copied: str) -> Column:
    """``text`` with sorted, possibly overlapping spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        # a span that begins inside the one before only extends it
        said = F.when(s["live"], mark).otherwise(copied)
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), said)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(F.coalesce(spans, F.array().cast(SPANS))) > 0, whole).otherwise(text)
