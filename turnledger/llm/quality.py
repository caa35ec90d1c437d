"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTICS = ("chars", "words", "word_length", "upper", "digits", "spaces", "marks", "odd_marks", "bars", "shouts", "line_words",
              "distinct_words", "top_word", "repeats", "distinct_lines", "marked_words", "upper_words", "high_bytes")
FIT_DOCUMENTS = 20_000
_BLOCK = 2_000  # documents whose rules are multiplied at once
TREES = 80
DEPTH = 3
_PREFIX = "_quality_"
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*+<=>@\\^_`{}~")] = True


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a whole text; shares are taken of its bytes, words or lines."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, words = len(text), text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen = Counter(words)
    top = max(seen.values(), default=0)
    repeats = sum(map(bytes.__eq__, words[1:], words))
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,")
    shown = max(n, 1)
    return [float(np.log1p(size)), float(np.log1p(n)), (size - counts[_SPACE].sum()) / shown, counts[_UPPER].sum() / size,
            counts[_DIGIT].sum() / size, counts[_SPACE].sum() / size, counts[_MARK].sum() / size, counts[_ODD].sum() / size,
            counts[124] / size, counts[33] / size, n / max(len(lines), 1), len(seen) / shown, top / shown, repeats / shown,
            len(set(lines)) / max(len(lines), 1), marked / shown, sum(map(bytes.isupper, words)) / shown, counts[128:].sum() / size]


def _with_numbers(docs: DataFrame, text_col: str, names: list[str], numbers: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``docs`` with one more column per name: ``numbers`` of the statistics of some texts, computed where the rows are."""
    taken = {c.lower() for c in docs.columns} & set(names)
    if taken:
        raise ValueError(f"columns in the way: {sorted(taken)}")
    own = docs.columns
    at = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            values = numbers(np.array([statistics(t.as_py() or b"") for t in texts], np.float64).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(values[:, i]) for i in range(len(names)))],
                                             names=[*own, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)]))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column per statistic."""
    return _with_numbers(docs, text_col, [_PREFIX + s for s in STATISTICS], lambda values: values)


@dataclass(frozen=True)
class Rule:
    """All conditions hold: ``(statistic, threshold, above)``, above meaning greater than the threshold."""

    conditions: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for i, cut, above in self.conditions:
            found &= (x[:, i] > cut) if above else (x[:, i] <= cut)
        return found


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def totals(self, x: np.ndarray) -> np.ndarray:
        """The bias and the weights of the rules that hold, added up in pairs."""
        terms = [np.full(len(x), self.bias)] + [np.where(rule.holds(x), weight, 0.0) for rule, weight in zip(self.rules, self.weights)]
        while len(terms) > 1:
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1:]
        return terms[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.totals(x)))


def _paths(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: tuple = ()) -> list[Rule]:
    """Rules of a tree grown on ``x, y``: one for every path from the root to a node."""
    found = [Rule(path)] if path else []
    if depth == 0 or len(y) < 40 or y.min() == y.max():
        return found
    best = None
    for i in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
        for cut in np.unique(np.quantile(x[:, i], rng.uniform(0.02, 0.98, 12))):
            left = x[:, i] <= cut
            n = left.sum()
            if n < 15 or len(y) - n < 15:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, int(i), float(cut), left)
    if best is None:
        return found
    _, i, cut, left = best
    found += _paths(x[left], y[left], depth - 1, rng, (*path, (i, cut, False)))
    found += _paths(x[~left], y[~left], depth - 1, rng, (*path, (i, cut, True)))
    return found


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute-value penalty, by accelerated proximal gradient steps.

    ``r`` holds a byte for every document and rule. Rules are standardised in the arithmetic and multiplied in blocks
    of documents, so nothing larger than the bytes is ever held.
    """
    blocks = [slice(low, low + _BLOCK) for low in range(0, len(y), _BLOCK)]
    n = len(y)
    mean = (sum(r[b].sum(axis=0, dtype=np.int64) for b in blocks) / n).astype(np.float32)
    scale = np.sqrt(mean * (1 - mean)) + np.float32(1e-6)  # of a column of zeros and ones

    def ahead_of(v: np.ndarray) -> np.ndarray:
        v = (v / scale).astype(np.float32)
        return np.concatenate([r[b].astype(np.float32) @ v for b in blocks]) - mean @ v

    def back_of(e: np.ndarray) -> np.ndarray:
        return (sum(e[b] @ r[b].astype(np.float32) for b in blocks) - mean * e.sum()) / scale

    top = np.ones(r.shape[1], np.float32)
    for _ in range(30):  # the largest eigenvalue, for the step length
        top = back_of(ahead_of(top / np.linalg.norm(top)))
    step = 4.0 / (1.05 * np.linalg.norm(top) / n + 1)
    w, b, at, at_b, t = np.zeros_like(top), 0.0, np.zeros_like(top), 0.0, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(ahead_of(at) + at_b))) - y).astype(np.float32)
        new = at - step * back_of(error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = at_b - step * float(error.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_b = (new + (t - 1) / t_new * (new - w)).astype(np.float32), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w / scale, float(b - (w * mean / scale).sum())


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = 0.001, seed: int = 5) -> Ensemble:
    """Grow trees on bootstrap rows and random statistics, take their paths as rules, keep those the lasso weighs."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Ensemble((), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    rules: dict[bytes, Rule] = {}  # by a digest of the documents for which they hold
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        for rule in _paths(x[rows], y[rows], depth, rng):
            rules.setdefault(hashlib.blake2b(np.packbits(rule.holds(x)), digest_size=16).digest(), rule)
    listed = list(rules.values())
    held = np.empty((len(y), len(listed)), np.uint8)
    for i, rule in enumerate(listed):
        held[:, i] = rule.holds(x)
    weights, bias = _lasso(held, y.astype(np.float32), penalty)
    kept = [i for i, w in enumerate(weights) if abs(w) > 1e-6]
    return Ensemble(tuple(listed[i] for i in kept), tuple(float(weights[i]) for i in kept), bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        documents: int = FIT_DOCUMENTS) -> Ensemble:
    """Learn from at most ``documents`` labelled documents, the first in hash order of their keys.

    Only their statistics reach the driver. A key with several labels counts with the largest one.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label is not null")
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(documents)
    wanted = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(known), F.col("_key") == F.col("_id"))
    rows = with_statistics(wanted.select("_key", "_label", "_text"), "_text").drop("_text").orderBy("_key", *[_PREFIX + s for s in STATISTICS])
    rows = rows.limit(2 * documents).toArrow()
    x = np.stack([rows.column(_PREFIX + s).to_numpy() for s in STATISTICS], axis=1) if rows.num_rows else np.empty((0, len(STATISTICS)))
    return fit_rules(x, rows.column("_label").to_numpy() if rows.num_rows else np.empty(0))


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1 for every whole text; all other columns stay.

    The rules are applied next to the statistics: as an expression of the plan they were more code than a method can
    hold. A null text counts as empty; an empty text has statistics of 0 and gets a score like any other. Repeated rows are
    kept. An empty table gives an empty result.
    """
    total = _PREFIX + "total"
    scored = _with_numbers(docs, text_col, [total], lambda values: model.totals(values)[:, None])
    return scored.withColumn(out, 1 / (1 + F.exp(-F.col(total)))).drop(total)
