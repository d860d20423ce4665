"""Language identification by a bidirectional gated recurrent network over bytes.

A network of one gated layer in each direction reads the UTF-8 bytes of a text
and gives every byte a distribution over the languages; a document's
probabilities are the mean over its bytes. Texts are read whole, cut into
segments of equal length that run side by side as one batch.

Trained in numpy by backpropagation through time on a bounded sample: some
windows of some documents per language, chosen by a hash of the id.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import map_batches

HIDDEN = 8
SEGMENT = 96
SAMPLE_DOCUMENTS = 300  # expected number per language
SAMPLE_WINDOWS = 3  # of each of them
STEPS = 260
BATCH = 128
LEAST_WINDOW = 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Direction:
    """One direction's weights; gates are stacked as reset, update, candidate."""

    table: np.ndarray  # 3H x 256: input weights and bias of each byte
    gates: np.ndarray  # 2H x H
    candidate: np.ndarray  # H x H
    out: np.ndarray  # K x H

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.candidate, self.out]


class Network:
    def __init__(self, languages: Sequence[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        k, h = len(languages), hidden
        self.languages, self.hidden = list(languages), h

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.directions = [Direction(draw(3 * h, 256, scale=0.5), draw(2 * h, h, scale=h ** -0.5),
                                     draw(h, h, scale=h ** -0.5), draw(k, h, scale=h ** -0.5)) for _ in range(2)]
        self.bias = np.zeros((k, 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [a for d in self.directions for a in d.arrays()] + [self.bias]

    def _read(self, d: Direction, data: np.ndarray, order: Iterable[int], keep: list | None) -> np.ndarray:
        """Contributions to the logits at every step; data: steps x batch."""
        steps, batch = data.shape
        h2 = 2 * self.hidden
        state = np.zeros((self.hidden, batch), np.float32)
        logits = np.empty((steps, len(self.languages), batch), np.float32)
        for t in order:
            x = d.table.take(data[t], axis=1)
            gate = d.gates @ state
            gate += x[:h2]
            gate = _sigmoid(gate)
            reset, update = gate[:self.hidden], gate[self.hidden:]
            fresh = d.candidate @ (reset * state)
            fresh += x[h2:]
            np.tanh(fresh, out=fresh)
            if keep is not None:
                keep.append((t, state, reset, update, fresh))
            state = update * (state - fresh)
            state += fresh
            np.matmul(d.out, state, out=logits[t])
        return logits

    def probabilities(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Distribution at every position: steps x languages x batch."""
        steps = len(data)
        kept: list[list | None] = [None, None] if keep is None else [[], []]
        logits = self._read(self.directions[0], data, range(steps), kept[0])
        logits += self._read(self.directions[1], data, range(steps - 1, -1, -1), kept[1])
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if keep is not None:
            keep.extend(kept)
        return logits

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss over all positions and its gradient, through time in both directions."""
        keep: list = []
        p = self.probabilities(data, keep)
        steps, batch = data.shape
        one = np.arange(batch)
        loss = float(-np.log(np.maximum(p[:, target, one], 1e-9)).mean())
        delta = p
        delta[:, target, one] -= 1
        delta /= steps * batch
        grads: list[np.ndarray] = []
        for d, kept in zip(self.directions, keep, strict=True):
            g = [np.zeros_like(a) for a in d.arrays()]
            rows = np.empty((steps, 3 * self.hidden, batch), np.float32)
            back = np.zeros((self.hidden, batch), np.float32)
            for t, state, reset, update, fresh in reversed(kept):
                after = update * (state - fresh) + fresh
                g[3] += delta[t] @ after.T
                back = back + d.out.T @ delta[t]
                a_fresh = back * (1 - update) * (1 - fresh * fresh)
                a_update = back * (state - fresh) * update * (1 - update)
                shown = d.candidate.T @ a_fresh
                a_reset = shown * state * reset * (1 - reset)
                g[2] += a_fresh @ (reset * state).T
                a_gates = np.vstack([a_reset, a_update])
                g[1] += a_gates @ state.T
                rows[t] = np.vstack([a_gates, a_fresh])
                back = back * update + shown * reset + d.gates.T @ a_gates
            by_byte = np.zeros((256, 3 * self.hidden), np.float32)
            np.add.at(by_byte, data.ravel(), rows.transpose(0, 2, 1).reshape(-1, 3 * self.hidden))
            g[0] = by_byte.T
            grads += g
        grads.append(delta.sum(axis=(0, 2))[:, None])
        return loss, grads

    def train(self, windows: np.ndarray, targets: np.ndarray, steps: int = STEPS, batch: int = BATCH,
              rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random batches; windows: count x length. Languages have equal weight in every batch."""
        rng = np.random.default_rng(seed)
        parameters = self.parameters()
        first, second = ([np.zeros_like(a) for a in parameters] for _ in range(2))
        groups = [np.flatnonzero(targets == k) for k in range(len(self.languages))]
        loss = 0.0
        for step in range(1, steps + 1):
            own = rng.integers(0, len(groups), batch)
            chosen = np.array([groups[k][rng.integers(len(groups[k]))] for k in own])
            loss, grads = self.gradients(windows[chosen].T, own)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * min(1.0, 5 * (1 - step / (steps + 1)))
            for a, g, m, v in zip(parameters, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
        return loss

    def documents(self, texts: list[bytes], segment: int = SEGMENT, batch: int = 2048) -> np.ndarray:
        """Mean distribution over the bytes of each text; texts may not be empty."""
        lengths = np.array([len(t) for t in texts])
        segments = -(-lengths // segment)
        padded = b"".join(t.ljust(int(n) * segment) for t, n in zip(texts, segments, strict=True))
        data = np.frombuffer(padded, np.uint8).reshape(-1, segment)
        inside = np.full(len(data), segment)
        inside[np.cumsum(segments) - 1] = lengths - (segments - 1) * segment
        sums = np.empty((len(data), len(self.languages)))
        for at in range(0, len(data), batch):
            part = inside[at:at + batch]
            p = self.probabilities(np.ascontiguousarray(data[at:at + batch].T))
            whole = p.sum(axis=0)
            for column in np.flatnonzero(part < segment):
                whole[:, column] = p[:part[column], :, column].sum(axis=0)
            sums[at:at + batch] = whole.T
        return np.add.reduceat(sums, np.cumsum(segments) - segments, axis=0) / lengths[:, None]


def sample_windows(docs: DataFrame, per_language: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS,
                   length: int = SEGMENT) -> list[tuple[str, bytes]]:
    """Windows of about ``per_language`` documents of each language, chosen by a hash of the id.

    Every language takes part. Bounded for each: about per_language x windows windows. Windows of fewer than
    LEAST_WINDOW characters count only for languages that have no longer ones.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for row in counts
                           for x in (row["lang"], min(1.0, per_language / row["count"]))))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("language")), F.lit(1_000_003)) / 1_000_003.0
    picked = known.where(F.coalesce(draw < share[F.col("lang")], F.lit(False)))
    cuts = F.array(*(F.substring(F.col("text"), 1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(
        F.length("text") - length, F.lit(1))).cast("int"), F.lit(length)) for i in range(windows)))
    rows = picked.select("lang", F.explode(F.array_distinct(cuts)).alias("cut")).where("cut <> ''").collect()
    served = {r["lang"] for r in rows if len(r["cut"]) >= LEAST_WINDOW}
    return sorted((r["lang"], r["cut"].encode()[:length].ljust(length)) for r in rows
                  if len(r["cut"]) >= LEAST_WINDOW or r["lang"] not in served)


def fit(docs: DataFrame, **sizes: int) -> Network | None:
    """A network for the languages of ``docs``; None if no document has both a text and a language."""
    sample = sample_windows(docs, **sizes)
    if not sample:
        return None
    languages = sorted({language for language, _ in sample})
    network = Network(languages)
    windows = np.frombuffer(b"".join(w for _, w in sample), np.uint8).reshape(len(sample), -1)
    network.train(windows, np.array([languages.index(language) for language, _ in sample]))
    return network


def label(texts: list[str | None], network: Network | None) -> tuple[list[str], list[float]]:
    """Language and probability of each text; ``und`` with 0 for texts that are null or have no letter."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    readable = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if network else []
    if readable:
        p = network.documents([texts[i].encode() for i in readable])
        for i, k, score in zip(readable, p.argmax(axis=1), p.max(axis=1), strict=True):
            names[i], scores[i] = network.languages[k], min(1.0, max(0.0, float(score)))
    return names, scores


def identify(docs: DataFrame, network: Network | None, batch_chars: int = 400_000) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``lang_score`` added, one row per row.

    A null text and one without a letter get ``und`` and 0. Columns of these two
    names in the input are replaced; all others are handed through. Repeated rows
    are labelled as often as they occur; an empty table gives no rows.
    """
    kept = docs.drop("lang_pred", "lang_score")
    at = kept.columns.index("text")

    def run(batches) -> Iterable:
        for batch in batches:
            column, start = batch.column(at), 0
            while start < len(column):
                texts, chars = [], 0
                while start + len(texts) < len(column) and chars < batch_chars:
                    texts.append(column[start + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                part = batch.slice(start, len(texts))
                yield [*part.columns, *label(texts, network)]
                start += len(texts)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(kept, run, f"{types}, lang_pred string, lang_score double")
