"""Language of documents by a bidirectional gated recurrent network over bytes.

The network reads a text as windows of bytes. In each direction a gated recurrent unit (update gate,
reset gate, candidate; hard sigmoids as gates) carries a state over the window; both states give the
language probabilities of every position. A document's probabilities are the mean over its positions.
Training is backpropagation through time in numpy on a bounded sample of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlast.llm.words import column, fold_of, text_column, text_slices

WINDOW = 128
LANES = 1024
UNKNOWN = "und"


@dataclass
class Direction:
    """Weights of one direction; rows of ``inputs`` and ``states`` are update, reset, candidate."""

    inputs: np.ndarray  # (3 H, E)
    states: np.ndarray  # (3 H, H)
    bias: np.ndarray  # (3 H, 1)

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.bias]


@dataclass
class ByteNetwork:
    """languages, byte embedding (E, 256), two directions, output (C, 2 H) and its bias (C, 1)."""

    languages: list[str]
    embedding: np.ndarray
    forward: Direction
    backward: Direction
    output: np.ndarray
    output_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, *self.forward.arrays(), *self.backward.arrays(), self.output, self.output_bias]


def new_network(languages: list[str], hidden: int, embedded: int, seed: int, dtype=np.float32) -> ByteNetwork:
    draw = np.random.default_rng(seed)

    def direction() -> Direction:
        bias = np.zeros((3 * hidden, 1))
        bias[:2 * hidden] = 0.5  # the middle of a hard sigmoid
        return Direction(draw.normal(0, 0.5, (3 * hidden, embedded)), draw.normal(0, 0.3, (3 * hidden, hidden)), bias)

    net = ByteNetwork(languages, draw.normal(0, 0.5, (embedded, 256)), direction(), direction(),
                      draw.normal(0, 0.3, (len(languages), 2 * hidden)), np.zeros((len(languages), 1)))
    for part in (net, net.forward, net.backward):
        for name, value in vars(part).items():
            if isinstance(value, np.ndarray):
                setattr(part, name, value.astype(dtype))
    return net


def _run(d: Direction, x: np.ndarray, real: np.ndarray | None, order: range, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction over embedded bytes x (T, E, B); no state outside ``real`` (T, B)."""
    steps, _, lanes = x.shape
    size = d.states.shape[1]
    states = np.empty((steps, size, lanes), x.dtype)
    h = np.zeros((size, lanes), x.dtype)
    for t in order:
        from_input = d.inputs @ x[t]
        from_input += d.bias
        from_state = d.states @ h
        gates = from_input[:2 * size] + from_state[:2 * size]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        update, reset = gates[:size], gates[size:]
        candidate = np.tanh(from_input[2 * size:] + reset * from_state[2 * size:])
        if keep is not None:
            keep.append((t, h, gates, candidate, from_state[2 * size:]))
        h = candidate + update * (h - candidate)
        if real is not None:
            h = h * real[t]
        states[t] = h
    return states


def _back(d: Direction, x: np.ndarray, real: np.ndarray, kept: list, d_states: np.ndarray):
    """Gradients of the weights and of x, given those of the states."""
    size = d.states.shape[1]
    g_in, g_state, g_bias = (np.zeros_like(a) for a in d.arrays())
    g_x, g_h = np.zeros_like(x), np.zeros_like(d_states[0])
    for t, before, gates, candidate, carried in reversed(kept):
        g = (g_h + d_states[t]) * real[t]
        update, reset = gates[:size], gates[size:]
        g_candidate = g * (1 - update) * (1 - candidate * candidate)
        inside = (gates > 0) & (gates < 1)
        g_gates = np.concatenate((g * (before - candidate), g_candidate * carried)) * inside
        g_from_input = np.concatenate((g_gates, g_candidate))
        g_from_state = np.concatenate((g_gates, g_candidate * reset))
        g_in += g_from_input @ x[t].T
        g_state += g_from_state @ before.T
        g_bias += g_from_input.sum(axis=1, keepdims=True)
        g_x[t] += d.inputs.T @ g_from_input
        g_h = g * update + d.states.T @ g_from_state
    return [g_in, g_state, g_bias], g_x


def probabilities(net: ByteNetwork, taken: np.ndarray, real: np.ndarray | None) -> np.ndarray:
    """Language probabilities (T, C, B) of every position of windows ``taken`` (T, B) of bytes."""
    x = np.ascontiguousarray(net.embedding[:, taken].transpose(1, 0, 2))
    steps, size = len(taken), net.forward.states.shape[1]
    ahead = _run(net.forward, x, real, range(steps))
    behind = _run(net.backward, x, real, range(steps - 1, -1, -1))
    scores = np.matmul(net.output[:, :size], ahead) + np.matmul(net.output[:, size:], behind) + net.output_bias
    np.exp(scores - scores.max(axis=1, keepdims=True), out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def loss_and_gradients(net: ByteNetwork, taken: np.ndarray, real: np.ndarray, labels: np.ndarray):
    """Mean cross-entropy over all real positions, and its gradient for each of ``net.arrays()``."""
    x = np.ascontiguousarray(net.embedding[:, taken].transpose(1, 0, 2))
    steps, size = len(taken), net.forward.states.shape[1]
    kept_ahead, kept_behind = [], []
    ahead = _run(net.forward, x, real, range(steps), kept_ahead)
    behind = _run(net.backward, x, real, range(steps - 1, -1, -1), kept_behind)
    both = np.concatenate((ahead, behind), axis=1)
    scores = np.matmul(net.output, both) + net.output_bias
    scores -= scores.max(axis=1, keepdims=True)
    probs = np.exp(scores)
    probs /= probs.sum(axis=1, keepdims=True)
    lane = np.arange(len(labels))
    total = max(1.0, real.sum())
    loss = -(np.log(probs[:, labels, lane] + 1e-30) * real).sum() / total
    g = probs
    g[:, labels, lane] -= 1
    g *= real[:, None, :] / total
    g_both = np.matmul(net.output.T, g)
    g_output = np.einsum("tcb,thb->ch", g, both)
    g_ahead, x_ahead = _back(net.forward, x, real, kept_ahead, g_both[:, :size])
    g_behind, x_behind = _back(net.backward, x, real, kept_behind, g_both[:, size:])
    g_embedding = np.zeros_like(net.embedding)
    np.add.at(g_embedding.T, taken.ravel(), (x_ahead + x_behind).transpose(0, 2, 1).reshape(-1, len(g_embedding)))
    return loss, [g_embedding, *g_ahead, *g_behind, g_output, g.sum(axis=(0, 2))[:, None]]


def train(texts: list[bytes], labels: np.ndarray, languages: list[str], hidden: int = 6, embedded: int = 6,
          steps: int = 300, lanes: int = 128, rate: float = 0.02, seed: int = 7) -> ByteNetwork:
    """Adam on batches drawn evenly over the languages; ``texts`` are windows of at most WINDOW bytes."""
    net = new_network(languages, hidden, embedded, seed)
    draw = np.random.default_rng(seed + 1)
    of = [np.flatnonzero(labels == c) for c in range(len(languages))]
    taken = np.zeros((len(texts), WINDOW), np.uint8)
    sizes = np.array([len(t) for t in texts])
    for i, t in enumerate(texts):
        taken[i, :len(t)] = np.frombuffer(t, np.uint8)
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        rows = np.concatenate([draw.choice(o, max(1, lanes // len(of))) for o in of])
        real = (np.arange(WINDOW)[:, None] < sizes[rows]).astype(np.float32)
        _, gradients = loss_and_gradients(net, taken[rows].T, real, labels[rows])
        norm = np.sqrt(sum((g * g).sum() for g in gradients))
        scale = min(1.0, 1.0 / (norm + 1e-12))
        slow = rate * (1 - step / (steps + 1))
        for a, g, m, v in zip(net.arrays(), gradients, first, second):
            g = (g * scale).astype(a.dtype)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= slow * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def fit_languages(docs: DataFrame, per_language: int = 1500, **training) -> ByteNetwork | None:
    """Fit on documents with crc32(doc_id as text) mod 3 other than 1 and a non-null lang.

    The sample is bounded: about ``per_language`` windows for each language, at a hashed place of
    hashed documents that hold a letter. None if there is nothing to learn from.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1)
                       & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / count)).otherwise(share)
    rows = known.where(chance < share).select("lang", F.substring("text", place + 1, F.lit(WINDOW)).alias("piece")).collect()
    rows = sorted((r["lang"], r["piece"].encode()[:WINDOW]) for r in rows)
    languages = sorted({lang for lang, piece in rows if piece})
    if not languages:
        return None
    rows = [r for r in rows if r[1]]
    labels = np.array([languages.index(lang) for lang, _ in rows])
    return train([piece for _, piece in rows], labels, languages, **training)


def pooled(net: ByteNetwork, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean probabilities (documents, C) over the positions data[starts:ends] of each document."""
    counts = -(-(ends - starts) // WINDOW)
    owner = np.repeat(np.arange(len(starts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + number * WINDOW
    size = np.minimum(WINDOW, ends[owner] - begin)
    order = np.argsort(-size, kind="stable")  # whole windows first, then shorter and shorter ones
    sums = np.zeros((len(starts), len(net.languages)))
    for at in range(0, len(order), LANES):
        some = order[at:at + LANES]
        longest = int(size[some[0]])
        steps = np.arange(longest)[:, None]
        taken = data[np.minimum(begin[some] + steps, len(data) - 1)]
        partial = size[some[-1]] < longest
        real = (steps < size[some]).astype(np.float32) if partial else None
        probs = probabilities(net, taken, real)
        if partial:
            probs *= real[:, None, :]
        np.add.at(sums, owner[some], probs.sum(axis=0).T)
    return sums / np.maximum(1, ends - starts)[:, None]


def predict_batch(net: ByteNetwork | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text (nulls as empty texts)."""
    letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
    if net is None or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    raw = texts.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    ends = np.where(letters, offsets[1:], offsets[:-1])
    probs = pooled(net, data, offsets[:-1], ends)
    best = probs.argmax(axis=1)
    names = [net.languages[b] if l else UNKNOWN for b, l in zip(best, letters)]
    return names, np.where(letters, np.clip(probs[np.arange(len(best)), best], 0, 1), 0.0)


def predict(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text).

    ``und`` with score 0 where text is null or holds no letter, and everywhere without a network. A
    null doc_id is kept and not held out; repeated rows get equal results; other columns are not read.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            names, scores = predict_batch(net, text_column(batch))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(
        label, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known_language(docs: DataFrame, net: ByteNetwork | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with a score of ``least`` or more.

    All columns pass through. A network that learned nothing rejects only texts without a letter.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = text_column(batch)
            if net is None:
                good = pc.match_substring_regex(texts, r"\pL")
            else:
                names, scores = predict_batch(net, texts)
                good = pa.array([n != UNKNOWN for n in names] & (scores >= least))
            yield batch.filter(good)

    return docs.mapInArrow(keep, docs.schema)
