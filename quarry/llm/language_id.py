"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes from the left and from the right; at every position their states give a probability of each language.
A document's probabilities are the mean, over the positions that belong to letters, of the log-probabilities, normalised. The network is
trained here, in numpy, by backpropagation through time with Adam, on windows of at most TRAIN_DOCS documents.

Texts are labelled whole: they are cut into windows of WINDOW bytes, each read with CONTEXT bytes on either side that warm up the
states, so that every byte is labelled once and memory does not grow with a text.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the label that sorts first; without a
labelled training row every text is `und`; an empty table gives an empty table; equal texts get equal labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, tidy

FOLDS, HIDDEN, WINDOW, CONTEXT, BATCH = 5, 8, 184, 8, 2048
TRAIN_DOCS, TRAIN_CHARS, STEPS, TRAIN_BATCH, TRAIN_WINDOW = 4000, 400, 240, 192, 40


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo FOLDS, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    labels: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            # Of each byte, its part in update gate, reset gate and candidate; the recurrent parts, by columns in that order.
            p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p[f"g{d}"] = rng.normal(0, 0.3, (hidden, 2 * hidden)).astype(np.float32)
            p[f"c{d}"] = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)
            p[f"o{d}"] = rng.normal(0, 0.3, (hidden, len(labels))).astype(np.float32)
        p["b"] = np.zeros(len(labels), np.float32)
        return cls(labels, p)

    def step(self, d: str, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """A GRU step: state, gates, candidate and reset state."""
        n = h.shape[1]
        gates = sigmoid(inputs[:, : 2 * n] + h @ self.p[f"g{d}"])
        z, r = gates[:, :n], gates[:, n:]
        rh = r * h
        c = np.tanh(inputs[:, 2 * n :] + rh @ self.p[f"c{d}"])
        return h + z * (c - h), z, r, c, rh

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(positions, rows, labels) of byte windows (rows, positions)."""
        rows, steps = data.shape
        hidden = self.p["cf"].shape[0]
        out = np.broadcast_to(self.p["b"], (steps, rows, len(self.labels))).copy()
        turned = np.ascontiguousarray(data.T)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h = np.zeros((rows, hidden), np.float32)
            x, o = self.p[f"x{d}"], self.p[f"o{d}"]
            for t in order:
                h = self.step(d, x[turned[t]], h)[0]
                out[t] += h @ o
        out -= out.max(axis=2, keepdims=True)
        out -= np.log(np.exp(out).sum(axis=2, keepdims=True))
        return out

    def train(self, data: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float, state: dict) -> float:
        """A step of Adam on the mean cross-entropy of all positions; gradients by backpropagation through time."""
        rows, steps = data.shape
        n = self.p["cf"].shape[0]
        turned, kept = np.ascontiguousarray(data.T), {}
        logits = np.broadcast_to(self.p["b"], (steps, rows, len(self.labels))).copy()
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h, kept[d] = np.zeros((rows, n), np.float32), []
            for t in order:
                new, z, r, c, rh = self.step(d, self.p[f"x{d}"][turned[t]], h)
                kept[d].append((t, h, new, z, r, c, rh))
                h = new
                logits[t] += h @ self.p[f"o{d}"]
        logits -= logits.max(axis=2, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=2, keepdims=True)
        loss = -float(np.mean(np.log(q[:, np.arange(rows), target] + 1e-9)))
        q[:, np.arange(rows), target] -= 1
        q *= (weight / (steps * weight.sum())).astype(np.float32)[None, :, None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["b"] = q.sum(axis=(0, 1))
        for d in "fb":
            dh = np.zeros((rows, n), np.float32)
            gate, cand, out = self.p[f"g{d}"], self.p[f"c{d}"], self.p[f"o{d}"]
            for t, before, after, z, r, c, rh in reversed(kept[d]):
                grad[f"o{d}"] += after.T @ q[t]
                dh = dh + q[t] @ out.T
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                drh = dc @ cand.T
                dr = drh * before * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                grad[f"c{d}"] += rh.T @ dc
                grad[f"g{d}"] += before.T @ dg
                np.add.at(grad[f"x{d}"], turned[t], np.concatenate([dg, dc], axis=1))
                dh = dh * (1 - z) + drh * r + dg @ gate.T
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        state["t"] = k = state.get("t", 0) + 1
        for name, g in grad.items():
            g = g * scale
            m = state[f"m{name}"] = 0.9 * state.get(f"m{name}", 0) + 0.1 * g
            v = state[f"v{name}"] = 0.999 * state.get(f"v{name}", 0) + 0.001 * g * g
            self.p[name] -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return loss


def fit(samples: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 1) -> Model | None:
    """Train on (bytes, label) pairs; labels are drawn equally often."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    model, rng, state = Model.new(labels, seed=seed), np.random.default_rng(seed), {}
    by = [[np.frombuffer(b, np.uint8) for b, lang in samples if lang == x and b] for x in labels]
    by = [v or [np.array([32], np.uint8)] for v in by]
    for k in range(steps):
        target = rng.integers(0, len(labels), TRAIN_BATCH)
        data = np.full((TRAIN_BATCH, TRAIN_WINDOW), 32, np.uint8)
        for row, label in enumerate(target):
            text = by[label][rng.integers(len(by[label]))]
            n = min(len(text), int(rng.integers(6, TRAIN_WINDOW + 1)) if rng.random() < 0.3 else TRAIN_WINDOW)
            at = int(rng.integers(0, len(text) - n + 1))
            data[row, :n] = text[at : at + n]
        model.train(data, target, np.ones(TRAIN_BATCH), 0.02 * (1 - k / steps) + 0.001, state)
    return model


def sample(docs: DataFrame, size: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[bytes, str]]:
    """At most size labelled rows outside the held-out fold, spread over the table by the hash of doc_id, each with a piece of at most chars characters at a hashed place."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.count()
    if not n:
        return []
    share = min(1.0, 1.5 * size / n)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = rows.where(h < int(share * (1 << 20)) + 1)
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - chars)) + 1
    found = picked.select("doc_id", F.col("lang").cast("string").alias("lang"), F.substring("text", at.cast("int"), F.lit(chars)).alias("piece")).orderBy(F.xxhash64("doc_id"), "piece").limit(size).collect()
    return [(r["piece"].encode("utf-8", "surrogatepass"), r["lang"]) for r in found]


def letters(data: np.ndarray) -> np.ndarray:
    """Positions that belong to letters: ASCII letters, and all bytes of other characters."""
    return ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)


def label_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean log-probabilities (texts, labels) over the letters of each text."""
    sums, counts = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts))
    edge = b" " * CONTEXT
    windows, owners = [], []
    width = WINDOW + 2 * CONTEXT

    def flush():
        data = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, width)
        own = np.array(owners)
        logs = model.log_probabilities(data)[CONTEXT : CONTEXT + WINDOW]
        mask = letters(data[:, CONTEXT : CONTEXT + WINDOW]).T
        np.add.at(sums, own, np.einsum("tnl,tn->nl", logs, mask.astype(np.float32)))
        np.add.at(counts, own, mask.sum(axis=0))
        windows.clear()
        owners.clear()

    for k, text in enumerate(texts):
        padded = edge + text + edge + b" " * (-len(text) % WINDOW)
        for at in range(0, len(text), WINDOW):
            windows.append(padded[at : at + width])
            owners.append(k)
            if len(windows) == BATCH:
                flush()
    if windows:
        flush()
    return sums / np.maximum(counts, 1)[:, None]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            has = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            which = np.flatnonzero(has) if model else []
            if len(which):
                logs = label_texts(model, [texts[int(i)].as_py().encode("utf-8", "surrogatepass") for i in which])
                p = np.exp(logs - logs.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                pred[which] = np.array(model.labels, object)[best]
                score[which] = p[np.arange(len(p)), best]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return documents(docs).mapInArrow(lambda batches: tidy(work(batches)), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, size: int = TRAIN_DOCS) -> DataFrame:
    """Train on a bounded sample of docs, then doc_id, held_out, lang_pred, score of every row; only text is read for a prediction."""
    out = identify(docs, fit(sample(docs, size)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
