"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Document frequencies of hashed byte n-grams cover all learning rows.  From a
bounded number of rows of each language, spherical k-means finds several
centroids; a text gets the language of the centroid with the largest cosine.
A text farther from its centroid than nearly all learning rows is marked as
rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SLOTS = 4096
CENTROIDS = 3
#: Learning rows per language that centroids and bounds are fitted on at most, those least by a hash of the id.
FIT_ROWS = 800
#: Share of the texts nearest to a centroid that lie outside its bound, by rows that the centroids have not seen.
OUTSIDE = 0.005
#: Of so many learning rows of a language one is kept from the centroids, for the bounds.
BOUND_EVERY = 2
UNKNOWN = "und"
LETTER = r"\p{L}"
WORDS = re.compile(r"[^\W\d_]+").findall
CHUNK = 1 << 20


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte n-grams of two to four bytes over the letters of the whole lower-cased text, a space between words."""
    raw = np.frombuffer(f" {' '.join(WORDS(text.lower()))} ".encode("utf-8", "surrogatepass") if text else b"", np.uint8)
    total = np.zeros(SLOTS)
    for at in range(0, len(raw), CHUNK):
        x = raw[at : at + CHUNK + 3].astype(np.uint32)
        h = x
        for n in (2, 3, 4):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
            # grams that begin in the next chunk are counted there
            total += np.bincount((h[:CHUNK] * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=SLOTS)
    return total


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vector(text: str | None, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(gram_counts(text)) * idf)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    bounds: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(nearest language, cosine, rejected); texts without a letter are unknown."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        near = self.centroids @ vector(text, self.idf)
        best = int(near.argmax())  # of equal cosines the first: languages are in order
        return self.langs[best], float(np.clip(near[best], 0, 1)), bool(near[best] < self.bounds[best])


def _kmeans(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [0]
    while len(seeds) < min(k, len(x)):
        far = (x @ x[seeds].T).max(1)
        if far.min() > 1 - 1e-5:  # as near as single precision tells
            break
        seeds.append(int(far.argmin()))
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def _frequencies(batches):
    seen, rows = np.zeros(SLOTS, np.int64), 0
    for b in batches:
        for t in b.column(0).to_pylist():
            seen += gram_counts(t) > 0
            rows += 1
    if rows:
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(SLOTS + 1), pa.int32()), "df": pa.array(np.append(seen, rows))})


def _vectors(idf: np.ndarray):
    def run(batches):
        for b in batches:
            v = [vector(t, idf).astype("<f4").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), b.column(1), b.column(2)], ["v", "lang", "rank"])

    return run


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS,
    fit_rows: int = FIT_ROWS, outside: float = OUTSIDE,
) -> Model:
    """Learn from all rows of ``docs`` with a language and a letter.

    Document frequencies come from all rows, summed in the tasks first;
    centroids and bounds from at most ``fit_rows`` ids of each language, with
    the least text of a repeated id.  Ids are taken by a hash and, where hashes
    are equal, by the id.  Without any row the model knows no language and
    calls every text unknown.
    """
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.xxhash64(F.col(id_col).cast("string")).alias("rank"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    letters = F.col(text_col).rlike(LETTER)
    docs, rows = docs.where(letters), rows.where(F.col("text").rlike(LETTER))
    df = np.zeros(SLOTS + 1)
    for r in rows.select("text").mapInArrow(_frequencies, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect():
        df[r["slot"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.05
    ids = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("part")).dropna().distinct()
    chosen = common.least_rows(ids.withColumn("rank", F.xxhash64(F.col("id").cast("string"))), fit_rows).select("id", F.col("part").alias("lang"))
    chosen = common.saved(chosen, common.scratch(docs.sparkSession), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    # one text an id and language, so that a repeated id adds nothing
    texts = texts.join(common.small(chosen), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    sample = texts.select("text", "lang", F.xxhash64(F.col("id").cast("string")).alias("rank")).mapInArrow(
        _vectors(idf), "v binary, lang string, rank long"
    )
    fitted = sample.groupBy("lang").applyInArrow(_fitted(centroids, outside), "lang string, c binary, bound double")
    # a few centroids a language are all that reaches the driver
    rows = sorted(((r["lang"], bytes(r["c"]), r["bound"]) for r in fitted.collect()))
    found = np.stack([np.frombuffer(c, "<f8") for _, c, _ in rows]) if rows else np.zeros((0, SLOTS))
    return Model(idf, found, [r[0] for r in rows], np.array([r[2] for r in rows]))


def _fitted(centroids: int, outside: float):
    """The centroids and bounds of one language from its chosen rows, of which there are ``fit_rows`` at most."""

    def run(rows: pa.Table) -> pa.Table:
        held = sorted(zip(rows.column("rank").to_pylist(), rows.column("v").to_pylist()))
        x = np.stack([np.frombuffer(v, "<f4") for _, v in held])
        x = x[np.linalg.norm(x, axis=1) > 0]
        out = []
        if len(x):
            apart = np.arange(len(x)) % BOUND_EVERY == BOUND_EVERY - 1
            c = _kmeans(x[~apart], centroids)
            near = (x[apart] if apart.any() else x) @ c.T
            own = near.argmax(1)
            # of few unseen rows the least one is the bound; of none nearest to a centroid, the least of all
            for i in range(len(c)):
                out.append((c[i].astype("<f8").tobytes(), float(np.quantile(near[own == i, i], outside)) if (own == i).any() else float(near.max(1).min())))
        lang = rows.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "c": pa.array([o[0] for o in out], pa.binary()), "bound": pa.array([o[1] for o in out], pa.float64())})

    return run


def _predict(model: Model):
    def run(batches):
        for b in batches:
            rows = [model.predict(t) for t in b.column(0).to_pylist()]
            lang, score, out = zip(*rows) if rows else ((), (), ())
            cols = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + [b.column(i) for i in range(1, b.num_columns)], ["lang_pred", "score", "rejected"] + b.schema.names[1:])

    return run


def identify(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: lang_pred, score (cosine, 0 to 1), rejected and the columns ``carry``.

    Null, empty and letterless texts are ``und`` with score 0.  ``rejected``
    marks texts beyond their centroid's bound; they keep the nearest language.
    Of equally near languages the first by name is taken; repeated rows give a
    row each; an empty table gives none.
    """
    common.bounded_batches(docs.sparkSession)
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).mapInArrow(
        _predict(model), "lang_pred string, score double, rejected boolean" + (", " + kinds if kinds else "")
    )
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})
