"""Language identification with a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = 8
WINDOW = 192  # bytes that one pass of the network sees; a longer text is read window by window
FIT_DOCUMENTS = 4000
FIT_WINDOWS = 3  # taken from each of these documents
FIT_BYTES = 80
_LANES = 4096  # windows that a task advances side by side


@dataclass
class Direction:
    """One gated recurrent layer, feature-major: rows are the update gate, the reset gate and the candidate."""

    table: np.ndarray  # (3H, 256): input weights of every byte
    inner: np.ndarray  # (3H, H)
    bias: np.ndarray  # (H, 1), of the candidate's recurrent part
    out: np.ndarray  # (languages, H)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out]


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.forward.parts(), *self.backward.parts(), self.out_bias]


def new_network(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    def direction() -> Direction:
        return Direction((rng.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32),
                         (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
                         np.zeros((hidden, 1), np.float32),
                         (rng.standard_normal((len(languages), hidden)) * 0.3).astype(np.float32))
    return Network(languages, direction(), direction(), np.zeros((len(languages), 1), np.float32))


def states(layer: Direction, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states ``(T, H, N)`` of byte columns ``codes (T, N)``; ``keep`` gathers what the backward pass needs.

    The logistic function is written with tanh, which numpy computes with vector instructions.
    """
    steps, lanes = codes.shape
    h_size = layer.inner.shape[1]
    found = np.empty((steps, h_size, lanes), np.float32)
    h = np.zeros((h_size, lanes), np.float32)
    inner, given = np.empty((3 * h_size, lanes), np.float32), np.empty((3 * h_size, lanes), np.float32)
    for t in range(steps):
        np.take(layer.table, codes[t], axis=1, out=given, mode="clip")
        np.matmul(layer.inner, h, out=inner)
        gates = given[:2 * h_size]
        gates += inner[:2 * h_size]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        update, reset = gates[:h_size], gates[h_size:]
        recurrent = inner[2 * h_size:]
        recurrent += layer.bias
        candidate = given[2 * h_size:]
        if keep is not None:
            keep.append((h, update.copy(), reset.copy(), recurrent.copy()))
        recurrent *= reset
        candidate += recurrent
        np.tanh(candidate, out=candidate)
        if keep is not None:
            keep[-1] += (candidate.copy(),)
        now = found[t]
        np.subtract(h, candidate, out=now)
        now *= update
        now += candidate
        h = now
    return found


def _through_time(layer: Direction, codes: np.ndarray, kept: list, grads: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time; ``grads (T, H, N)`` is the loss gradient of every hidden state."""
    h_size = layer.inner.shape[1]
    d_table, d_inner, d_bias = np.zeros_like(layer.table), np.zeros_like(layer.inner), np.zeros_like(layer.bias)
    d_h = np.zeros(grads.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, update, reset, recurrent, candidate = kept[t]
        d_h = d_h + grads[t]
        d_candidate = d_h * (1 - update) * (1 - candidate * candidate)
        d_update = d_h * (h - candidate) * update * (1 - update)
        d_reset = d_candidate * recurrent * reset * (1 - reset)
        d_recurrent = d_candidate * reset
        d_given = np.concatenate([d_update, d_reset, d_candidate])
        d_within = np.concatenate([d_update, d_reset, d_recurrent])
        d_inner += d_within @ h.T
        d_bias += d_recurrent.sum(axis=1, keepdims=True)
        order = np.argsort(codes[t], kind="stable")
        present, first = np.unique(codes[t][order], return_index=True)
        d_table[:, present] += np.add.reduceat(d_given[:, order], first, axis=1)
        d_h = d_h * update + layer.inner.T @ d_within
    return [d_table, d_inner, d_bias]


def reversed_windows(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that turn every window around inside its own length; padding stays at the end."""
    t = np.arange(codes.shape[0])[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def position_probabilities(net: Network, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``(T, L, N)``: the language probabilities of every byte."""
    back = reversed_windows(codes, lengths)
    ahead = np.matmul(net.forward.out, states(net.forward, codes))
    behind = np.matmul(net.backward.out, states(net.backward, np.take_along_axis(codes, back, axis=0)))
    ahead += np.take_along_axis(behind, back[:, None, :], axis=0)
    ahead += net.out_bias
    np.exp(np.minimum(ahead, 60, out=ahead), out=ahead)
    ahead /= ahead.sum(axis=1, keepdims=True)
    return ahead


def train(snippets: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 450, batch: int = 256, rate: float = 0.01,
          seed: int = 11) -> Network:
    """Fit by backpropagation through time and Adam; the loss is the cross-entropy at every position."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = new_network(languages, hidden, rng)
    width = max(map(len, snippets))
    codes = np.zeros((width, len(snippets)), np.uint8)
    for i, s in enumerate(snippets):
        codes[:len(s), i] = np.frombuffer(s, np.uint8)
    lengths = np.array([len(s) for s in snippets])
    targets = np.searchsorted(languages, labels)
    params = net.parts()
    first, second, count = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    order = np.empty(0, np.int64)
    while count < steps:
        if not len(order):
            order = rng.permutation(len(snippets))
        pick, order = order[:batch], order[batch:]
        grads = _gradients(net, codes[:, pick], lengths[pick], targets[pick])
        count += 1
        step = rate * (1 - 0.9 * count / steps)
        for p, g, m, v in zip(params, grads, first, second):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (step * (m / (1 - 0.9 ** count)) / (np.sqrt(v / (1 - 0.999 ** count)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, codes: np.ndarray, lengths: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
    back = reversed_windows(codes, lengths)
    turned = np.take_along_axis(codes, back, axis=0)
    kept_f, kept_b = [], []
    ahead, behind = states(net.forward, codes, kept_f), states(net.backward, turned, kept_b)
    scores = np.matmul(net.forward.out, ahead)
    scores += np.take_along_axis(np.matmul(net.backward.out, behind), back[:, None, :], axis=0)
    scores += net.out_bias
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    scores[:, targets, np.arange(len(targets))] -= 1
    scores *= (np.arange(len(codes))[:, None] < lengths)[:, None, :]
    scores /= lengths.sum()
    scores = scores.astype(np.float32)
    turned_scores = np.take_along_axis(scores, back[:, None, :], axis=0)
    found = []
    for layer, seen, kept, order, given in ((net.forward, ahead, kept_f, codes, scores), (net.backward, behind, kept_b, turned, turned_scores)):
        d_out = np.einsum("tln,thn->lh", given, seen, optimize=True)
        found += [*_through_time(layer, order, kept, np.matmul(layer.out.T, given)), d_out]
    return [*found, scores.sum(axis=(0, 2))[:, None]]


def document_probabilities(net: Network, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Mean of the position probabilities over the whole of every text; windows of like length run side by side."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per = -(-sizes // window)
    owner = np.repeat(np.arange(len(texts)), per)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    lengths = np.minimum(window, sizes[owner] - at * window)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[owner] + at * window
    sums = np.zeros((len(texts), len(net.languages)))
    order = np.argsort(-lengths, kind="stable")
    for first in range(0, len(order), _LANES):
        pick = order[first:first + _LANES]
        longest = int(lengths[pick[0]])
        t = np.arange(longest)[:, None]
        inside = t < lengths[pick]
        codes = np.where(inside, flat[np.minimum(starts[pick] + t, len(flat) - 1)], 0).astype(np.uint8)
        chances = position_probabilities(net, codes, lengths[pick])
        np.add.at(sums, owner[pick], np.einsum("tln,tn->nl", chances, inside.astype(np.float32)))
    return sums / np.maximum(sizes, 1)[:, None]


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the checksum of the key's text leaves the given remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        documents: int = FIT_DOCUMENTS) -> Network | None:
    """Train on at most ``documents`` documents with a language, the first in hash order of their keys.

    From each, ``FIT_WINDOWS`` windows spread over the whole text are taken, so what reaches the driver is bounded.
    """
    key = F.col(id_col)
    learn = docs.where(key.isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    chosen = learn.select(key.alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(documents).distinct()
    length = F.length(text_col)
    cuts = [F.substring(F.col(text_col), (1 + F.floor(F.greatest(length - FIT_BYTES, F.lit(0)) * i / max(FIT_WINDOWS - 1, 1))).cast("int"),
                        F.lit(FIT_BYTES)) for i in range(FIT_WINDOWS)]
    sample = (learn.join(F.broadcast(chosen), key == F.col("_id"))
              .select(F.col("_id"), F.col(lang_col).alias("_lang"), F.array(*cuts).alias("_cuts")).orderBy("_id", "_lang").collect())
    snippets, labels = [], []
    for row in sample:
        for cut in dict.fromkeys(row["_cuts"]):
            snippets.append(cut.encode()[:FIT_BYTES])
            labels.append(row["_lang"])
    return train(snippets, labels) if snippets else None


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every whole text.

    A text that is null or has no letter gets ``und`` with score 0; so does every text when nothing could be learned.
    Repeated rows are kept. An empty table gives an empty result; other columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            use = [i for i, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if use:
                chances = document_probabilities(net, [texts[i].encode() for i in use])
                best = chances.argmax(axis=1)
                scores[use] = np.clip(chances[np.arange(len(use)), best], 0, 1)
                for i, b in zip(use, best):
                    names[i] = net.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
