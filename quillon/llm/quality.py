"""Quality rules: counted rules first, then a calibrated classifier.

The classifier is a logistic regression on hashed word and character n-grams,
trained on labelled rows and calibrated to probabilities on rows held out from
its training.  It is fitted on a bounded sample; every text is scored whole,
in Arrow batches, against a fixed threshold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Hash slots for words and as many for character trigrams.
SLOTS = 2048
#: Labelled rows that the classifier is fitted on at most; the one sample here.
TRAIN_ROWS = 3000
#: A text is kept if its calibrated probability of good quality reaches this.
KEEP_AT = 0.5
ODD = 0x9E3779B97F4A7C15
CHUNK = 1 << 20

_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        many = {w for w, n in Counter(windows).items() if n > 1}
        reach = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if w in many:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def slots(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, frequencies): hashed words and character trigrams of a whole text, each kind summing to one."""
    text = text or ""
    total = np.zeros(2 * SLOTS)
    for at in range(0, max(len(text) - 2, 0), CHUNK):
        x = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = (x[:-2] * np.uint32(0x01000193) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x9E3779B1)
        total[SLOTS:] += np.bincount(h >> np.uint32(21), minlength=SLOTS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(np.diff(np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]]).astype(np.int8)))
    starts, stops = ends[::2], ends[1::2]
    first = 0
    while first < len(starts):  # in runs of words of about CHUNK bytes, or one longer word
        last = max(int(np.searchsorted(stops, starts[first] + CHUNK, "right")), first + 1)
        begin, end = starts[first], stops[last - 1]
        power, inverse = _powers(int(end - begin))
        x = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw[begin:end] + np.uint64(1)) * power[: end - begin])])
        h = (x[stops[first:last] - begin] - x[starts[first:last] - begin]) * inverse[starts[first:last] - begin]
        h ^= h >> np.uint64(29)
        total[:SLOTS] += np.bincount(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(53)).astype(np.int64), minlength=SLOTS)
        first = last
    total[:SLOTS] /= max(len(starts), 1)
    total[SLOTS:] /= max(total[SLOTS:].sum(), 1)
    at = np.flatnonzero(total)
    return at, total[at]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse modulo 2^64, kept up to CHUNK of them."""
    held = _POWERS.get("held")
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        held = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            for b in (ODD, pow(ODD, -1, 1 << 64))
        )
        if size <= CHUNK:
            _POWERS["held"] = held
    return held


@dataclass(frozen=True)
class Model:
    """Folded weights per slot: a text's logit is bias + frequencies · weights; then the calibration line."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, text: str | None) -> float:
        at, freq = slots(text)
        z = float(freq @ self.weights[at]) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))


def _descend(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's accelerated gradient, both classes weighing the same."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    step = 1.0 / (0.25 * float((np.einsum("ij,ij->i", x, x) + 1) @ weight) + l2)
    w, b = np.zeros(d, np.float32), 0.0
    pw, pb = w.copy(), b
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        g = (1 / (1 + np.exp(-np.clip(x @ vw + vb, -40, 40))) - y) * weight
        pw, pb = w, b
        w, b = vw - step * (x.T @ g + l2 * vw), vb - step * float(g.sum())
    return w, b


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model | None:
    """A model from (slots, frequencies, label) rows; None unless both labels occur."""
    # a quarter of the rows, at the end, is for calibration; all if one label is missing in either part
    rows = [r for i, r in enumerate(rows) if i % 4 != 3] + rows[3::4]
    y = np.array([r[2] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = np.zeros((len(rows), 2 * SLOTS), np.float32)
    for i, (at, freq, _) in enumerate(rows):
        x[i, at] = freq
    mean = x.mean(0)
    std = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean * mean, 0))
    scale = 1 / np.maximum(std, 0.02 / SLOTS + 0.1 * std.mean())
    x -= mean
    x *= scale / np.float32(np.sqrt(2 * SLOTS))
    cut = len(rows) - len(rows) // 4
    if len(set(y[cut:].tolist())) < 2 or len(set(y[:cut].tolist())) < 2:
        w, b = _descend(x, y, 1e-3, 300)
        z, t = x @ w + b, y
    else:
        w, b = _descend(x[:cut], y[:cut], 1e-3, 300)
        z, t = x[cut:] @ w + b, y[cut:]
    # Platt's line with his smoothed targets, by Newton steps
    pos, neg = t.sum(), (1 - t).sum()
    target = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2)).astype(float)
    z, line = z.astype(float), np.array([1.0, 0.0])
    basis = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(basis @ line, -30, 30)))
        h = (basis * (p * (1 - p))[:, None]).T @ basis + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, basis.T @ (p - target))
        line = line - move * min(1.0, 5.0 / max(float(np.abs(move).max()), 1e-12))
    folded = w * scale / np.sqrt(2 * SLOTS)
    return Model(folded.astype(np.float64), float(b - mean @ folded), float(line[0]), float(line[1]))


def _features(batches):
    for b in batches:
        pairs = [slots(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0].astype("<i4").tobytes() for p in pairs], pa.binary()), pa.array([p[1].astype("<f4").tobytes() for p in pairs], pa.binary()), b.column(1), b.column(2)],
            ["at", "freq", "label", "rank"],
        )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = TRAIN_ROWS,
) -> Model | None:
    """Fit on at most ``max_rows`` labelled ids, those least by a hash of the id.

    Rows with a null id or label are left out, as are ids whose labels differ
    or which have no document; a repeated label counts once, of a repeated id
    the least text.  None if fewer than two labels remain, as of an empty table.
    """
    rank = F.xxhash64(F.col("id").cast("string")).alias("rank")
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    )
    ids = common.least_rows(ids.select("id", "label", rank, F.lit(0).alias("part")), max_rows).select("id", "label")
    ids = common.saved(ids, common.scratch(docs.sparkSession), "ids")  # max_rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    texts = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("text", "label", rank).mapInArrow(_features, "at binary, freq binary, label int, rank long")
    held = sorted(rows.collect(), key=lambda r: (r["rank"], r["label"], r["at"], r["freq"]))
    return fit([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["freq"], "<f4"), r["label"]) for r in held])


def _judge(model: Model | None, keep_at: float):
    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            rows = [counts(t) for t in texts]
            failed = [base_failed(r[0], r[4]) for r in rows]
            p = [None if model is None else model.probability(t) for t in texts]
            kept = [not f and (x is None or x >= keep_at) for f, x in zip(failed, p)]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            rest = [pa.array(failed, pa.bool_()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())]
            more = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols + rest + more, FIELDS + b.schema.names[1:])

    return run


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]


def _scored(docs: DataFrame, model: Model | None, carry: list[str], text_col: str, keep_at: float) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    kinds = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return docs.select(F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).mapInArrow(
        _judge(model, keep_at),
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean" + kinds,
    )


def judged(
    docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text", keep_at: float = KEEP_AT
) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, probability, kept and the columns ``carry``.

    A null text counts as empty and so fails the base rules.  A probability of
    exactly ``keep_at`` is kept.  Without a model the probability is null and
    the base rules decide alone.  Repeated rows give a row each; an empty table
    gives none.
    """
    out = _scored(docs, model, carry, text_col, keep_at)
    return out.select(*FIELDS, *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))


def filtered(docs: DataFrame, model: Model | None, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever these are called."""
    out = _scored(docs, model, docs.columns, text_col, keep_at).where("kept")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
