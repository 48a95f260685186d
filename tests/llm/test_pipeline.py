"""The pipeline's stages on a small corpus, against what brute force keeps."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillon.llm import queries as corpus


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def firsts(rows):
    """Least id of each group of (id, text), by brute force over all pairs."""
    sets, part = [shingles(t or "") for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                part = [part[i] if p == part[j] else p for p in part]
    return {min(k for p, (k, _) in zip(part, rows) if p == q) for q in set(part)}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("id", F.lit("x"))
    clash = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    first = pipeline.quality_rules(spark, docs.unionByName(clash), sf).cache()
    assert first.columns == docs.columns and all(len(r.text.split()) >= 50 for r in first.collect())
    second = pipeline.near_duplicates(spark, first.unionByName(first.limit(5)), sf).cache()
    kept = {r.doc_id: r.text for r in second.collect()}
    assert len(kept) == second.count() and second.columns == docs.columns
    texts = {r.doc_id: r.text for r in first.collect()}
    assert set(texts.values()) >= set(kept.values()) and len(set(kept.values())) == len(kept)
    assert set(kept) == firsts(list(texts.items()))
    third = pipeline.decontamination(spark, second, sf).cache()
    assert 0 < third.count() <= second.count() and third.columns == docs.columns
    fourth = pipeline.secrets(spark, third, sf).cache()
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert fourth.where("length(text) <> n_chars").isEmpty()
    last = pipeline.bpe_words(spark, fourth, sf)
    assert last.count() == fourth.count() and last.where("4 * n_tokens <> length(ids)").isEmpty()


def test_near_duplicates(spark, sf):
    """The near-duplicates stage keeps the least document of each group of all pairs at 0.8, of short, null and wordless texts too."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + i, t) for i, t in enumerate([None, "", " \n", "one", "one", "two words", "Two Words", "a b c d e", "a b c d e f", "x " * 400, "x " * 500])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, sf).collect()}
    assert kept == firsts([(r.doc_id, r.text) for r in docs.collect()])


def test_stage_edges(spark, sf):
    """Stages 2 to 5 on null ids and texts, repeated rows, a very long text, and columns whose names they use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, th int, kept string, text_hash int, n int"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text IS NOT NULL").first().text
    same = ("en", "s", 0, "i", 1, "k", 2, 3)
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [
        (1, None, *same), (None, None, *same), (None, "a text without an id", *same), (2, item, *same), (2, item, *same), (None, item, *same), (3, long, *same),
        (3, long, *same), (4, "", *same), (5, "password=abcDEF123456 " + long, *same), (None, "token: abcDEF123456ZZ", *same),
    ]
    docs = spark.createDataFrame(rows, schema)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    near = pipeline.near_duplicates(spark, docs, sf)
    assert near.columns == docs.columns
    want = [(1, None), (None, "a text without an id"), (2, item), (3, long), (None, "token: abcDEF123456ZZ")]
    assert plain(near) == sorted(want, key=str)  # nulls, the empty text and near copies of the long one go with their least ids
    clean = pipeline.decontamination(spark, docs, sf)
    assert clean.columns == docs.columns and plain(clean) == sorted(((r[0], r[1]) for r in rows if r[1] != item), key=str)
    marked = pipeline.secrets(spark, docs, sf)
    assert marked.columns == docs.columns and marked.count() == len(rows)
    got = {(r.doc_id, r.text) for r in marked.collect()}
    assert (5, "[SECRET] " + long) in got and (None, "[SECRET]") in got and (1, None) in got
    last = pipeline.bpe_words(spark, docs, sf)
    assert last.count() == len(rows) and {r.n_tokens for r in last.where("doc_id in (1, 4)").collect()} == {0}


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = corpus.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({corpus.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, map(tuple, want)))
