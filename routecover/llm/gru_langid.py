"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read in windows of bytes. Each direction keeps a state per window; both states label every byte
position, and a document's probability of a language is the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routecover.llm.texts import strings
from routecover.llm.tokens import in_chunks, release

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
Weights = dict[str, np.ndarray]


def new_weights(n_labels: int, hidden: int, seed: int = 7) -> Weights:
    """Per direction: what each byte adds to the update, reset and candidate sums (256 rows), and the state's matrix."""
    r = np.random.default_rng(seed)
    w = {
        "x": r.normal(0, 0.3, (2, 256, 3 * hidden)),
        "u": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
        "out": r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, n_labels)),
        "bias": np.zeros(n_labels),
    }
    w["x"][:, :, :hidden] += 1.0  # states change slowly at first
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_states(w: Weights, octets: np.ndarray, keep: bool = False):
    """States ``(steps, 2, windows, hidden)`` of windows ``(steps, windows)`` of bytes; direction 1 reads from the end.

    ``keep``: also what backpropagation needs.
    """
    steps, n = octets.shape
    hidden = w["u"].shape[1]
    both = np.stack([octets, octets[::-1]], 1)  # (steps, 2, n)
    states = np.zeros((steps + 1, 2, n, hidden), np.float32)
    kept = []
    for t in range(steps):
        h = states[t]
        x = np.stack([np.take(w["x"][d], both[t, d], 0) for d in (0, 1)])
        s = np.matmul(h, w["u"])
        gates = np.tanh(0.5 * (x[..., : 2 * hidden] + s[..., : 2 * hidden])) * 0.5 + 0.5
        z, r = gates[..., :hidden], gates[..., hidden:]
        m = s[..., 2 * hidden :]
        c = np.tanh(x[..., 2 * hidden :] + r * m)
        states[t + 1] = c + z * (h - c)
        if keep:
            kept.append((z, r, m, c))
    return (states, both, kept) if keep else states


def label_scores(w: Weights, states: np.ndarray) -> np.ndarray:
    """Scores ``(steps, windows, labels)`` of every position from both directions' states there."""
    hidden = states.shape[-1]
    return states[1:, 0] @ w["out"][:hidden] + states[:0:-1, 1] @ w["out"][hidden:] + w["bias"]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(w: Weights, octets: np.ndarray, labels: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    steps, n = octets.shape
    hidden = w["u"].shape[1]
    states, both, kept = run_states(w, octets, keep=True)
    p = softmax(label_scores(w, states))
    loss = float(-np.log(np.maximum(np.take_along_axis(p, labels[None, :, None].repeat(steps, 0), 2), 1e-9)).mean())
    p[:, np.arange(n), labels] -= 1
    p /= steps * n
    g = {k: np.zeros_like(v) for k, v in w.items()}
    flat = p.reshape(-1, p.shape[-1])
    g["out"][:hidden] = states[1:, 0].reshape(-1, hidden).T @ flat
    g["out"][hidden:] = states[:0:-1, 1].reshape(-1, hidden).T @ flat
    g["bias"] = flat.sum(0)
    from_out = np.stack([p @ w["out"][:hidden].T, (p @ w["out"][hidden:].T)[::-1]], 1)  # (steps, 2, n, hidden)
    dh = np.zeros((2, n, hidden), np.float32)
    ds = np.empty((steps, 2, n, 3 * hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, m, c = kept[t]
        h = states[t]
        dh = dh + from_out[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * m * r * (1 - r)
        through = np.concatenate([dz, dr, dc * r], -1)  # of what the state's matrix gave
        g["u"] += np.matmul(h.transpose(0, 2, 1), through)
        ds[t] = np.concatenate([dz, dr, dc], -1)
        dh = dh * z + np.matmul(through, w["u"].transpose(0, 2, 1))
    for d in (0, 1):
        np.add.at(g["x"][d], both[:, d].ravel(), ds[:, d].reshape(-1, 3 * hidden))
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, *, hidden: int = 8, steps: int = 500, batch: int = 128, rate: float = 0.02) -> Weights:
    """Adam over batches that draw every label equally often; ``windows`` is (n, bytes)."""
    w = new_weights(n_labels, hidden)
    random = np.random.default_rng(11)
    of_label = [np.flatnonzero(labels == k) for k in range(n_labels)]
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        drawn = np.concatenate([random.choice(rows, -(-batch // n_labels)) for rows in of_label])
        _, g = gradients(w, np.ascontiguousarray(windows[drawn].T), labels[drawn])
        size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        now = rate * (0.1 + 0.9 * (1 - i / steps)) * min(1.0, 1 / max(size, 1e-9))
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            w[k] -= now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
    return w


def pooled(w: Weights, texts: list[bytes], window: int, at_once: int = 1024) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean probabilities (texts, labels) over all bytes of each text, and each text's label at every byte."""
    n_labels = len(w["bias"])
    lengths = np.array([len(t) for t in texts])
    n_windows = -(-lengths // window)
    room = np.zeros((int(n_windows.sum()), window), np.uint8)
    size = np.empty(len(room), np.int64)
    at = 0
    for t, k in zip(texts, n_windows.tolist()):
        room[at : at + k].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        size[at : at + k] = window
        if k:
            size[at + k - 1] = len(t) - (k - 1) * window
        at += k
    sums = np.zeros((len(room), n_labels), np.float64)
    best = np.empty((len(room), window), np.min_scalar_type(max(n_labels - 1, 0)))
    for i in range(0, len(room), at_once):
        part = np.ascontiguousarray(room[i : i + at_once].T)
        p = softmax(label_scores(w, run_states(w, part)))
        best[i : i + at_once] = p.argmax(2).T
        inside = np.arange(window)[:, None] < size[None, i : i + at_once]
        sums[i : i + at_once] = (p * inside[..., None]).sum(0, dtype=np.float64)
    of_text = np.repeat(np.arange(len(texts)), n_windows)
    total = np.zeros((len(texts), n_labels))
    np.add.at(total, of_text, sums)
    ends = np.cumsum(n_windows)
    marks = [best[e - k : e].reshape(-1)[:length] for e, k, length in zip(ends.tolist(), n_windows.tolist(), lengths.tolist())]
    return total / np.maximum(lengths, 1)[:, None], marks


def hash_limit(share: float) -> int:
    """The signed 64-bit number that a share of all 64-bit hashes does not exceed."""
    return min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)


def learn_languages(
    docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, per_text: int = 6,
    window: int = 128, hidden: int = 8, steps: int = 500,
) -> tuple[list[str], Weights]:
    """Train on about ``per_language`` texts of each language, ``per_text`` windows from all over each text.

    The sample is bounded by these parameters and chosen by a hash of the id among the rows where ``usable`` holds and
    neither text nor language is null; languages are read from the column, all of them. An empty table teaches nothing.
    """
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = labelled.groupBy(lang_col).count().collect()
    languages = sorted(r[0] for r in counts)
    share = {r[0]: min(1.0, per_language / r[1]) for r in counts}
    if not languages:
        return [], new_weights(1, hidden)
    limit = F.create_map(*(F.lit(x) for r in counts for x in (r[0], hash_limit(share[r[0]]))))
    drawn = labelled.where(F.xxhash64(id_col) <= limit[F.col(lang_col)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            lang, parts = [], []
            for name, text in zip(strings(batch, "lang"), strings(batch)):
                data = text.encode()
                for start in {int(x) for x in np.linspace(0, max(0, len(data) - window), per_text)}:
                    lang.append(name)
                    parts.append(data[start : start + window])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    sample = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(cut, "lang string, part binary").collect()
    sample.sort()
    room = np.zeros((len(sample), window), np.uint8)
    for i, r in enumerate(sample):  # a short text is repeated to fill its window
        room[i] = np.resize(np.frombuffer(bytes(r["part"]) + b"\n", np.uint8), window)
    known = sorted({r["lang"] for r in sample})
    labels = np.array([known.index(r["lang"]) for r in sample])
    return known, train(room, labels, len(known), hidden=hidden, steps=steps)


def predict_languages(docs: DataFrame, languages: list[str], weights: Weights, *, text_col: str = "text", window: int = 128, with_positions: bool = False, added: tuple[str, str, str] = ("lang_pred", "score", "labels")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (named by ``added``) for every row, from the whole text alone; ``with_positions`` adds ``labels``, one number per byte of
    the text (a byte each for up to 256 languages, else the next larger unsigned little-endian kind).

    A null text, or one without a letter, is ``und`` with score 0 (as is every text if nothing was learned). A text's windows are
    labelled on their own, so a very long text costs no more memory than its windows; repeated rows keep their rows; of equally likely languages the first in
    order of name counts. Columns of ``docs`` that have the new names are replaced, all others stay.
    """
    kinds = [T.StringType(), T.DoubleType(), *[T.BinaryType()] * with_positions]
    kept = docs.drop(*added[: len(kinds)])
    text_at, names = kept.columns.index(text_col), [*kept.columns, *added[: len(kinds)]]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = [x or "" for x in batch.column(text_at).to_pylist()]
            for lo, hi in in_chunks(texts):
                part = [x if languages and LETTER.search(x) else "" for x in texts[lo:hi]]
                p, marks = pooled(weights, [x.encode() for x in part], window)
                columns = [
                    *batch.slice(lo, hi - lo).columns,
                    pa.array([languages[k] if x else UNDETERMINED for k, x in zip(p.argmax(1).tolist(), part)], pa.string()),
                    pa.array([min(1.0, float(q)) if x else 0.0 for q, x in zip(p.max(1).tolist(), part)], pa.float64()),
                    *[pa.array([m.tobytes() for m in marks], pa.binary())] * with_positions,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds))])
    return kept.mapInArrow(label, schema)
