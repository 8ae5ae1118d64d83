"""Document quality by a linear-chain conditional random field over lines.

Each line with a word gets binned features of its characters and of its place among equal
lines; its label (good or bad) depends on its own bins, on those of the lines before and
after it, and on its neighbours' labels. The weights maximise the conditional likelihood of
labelled documents, all of whose lines take the document's label. A document's raw quality
is the mean of its lines' forward-backward marginals of ``good``, weighted by line length; a
logistic curve fitted on the same documents turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.wordhash import ROWS, U, _hash_words, lean, mix, release, text_batches, words_of

#: Labelled documents that the field is fitted on, at most (the first by a hash of their id).
TRAIN_DOCS = 4000
ROUNDS, PENALTY = 120, 1e-3

# Byte classes and bin edges.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"0123456789", b" \t\x0b\x0c\r", b"#*$%&<>@^~_=+\\/{}[]", b"|", b"!", b".", b",;:?"]
UPPER, LOWER, DIGIT, SPACE, SYMBOL, PIPE, BANG, STOP, COMMA = range(9)
_SHARE_EDGES = np.array([1e-9, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95])
_SIZE_EDGES = np.array([2, 5, 10, 20, 40, 80, 160, 320, 640, 1280])
_TIMES_EDGES = np.array([2, 3, 4, 6, 10, 20, 50])
N_FEATURES, N_BINS = 13, 12  # bin 11: no such line

_TABLE = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _TABLE[list(_c)] = _k


def line_bins(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins uint8[lines, N_FEATURES], bytes of each line, first line of each row and the end) of the lines with a word."""
    n_rows = len(rows) - 1
    if not len(buf):
        return np.zeros((0, N_FEATURES), np.uint8), np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
    cut = np.unique(np.concatenate([rows, np.flatnonzero(buf == 10) + 1]))
    start, end = cut[:-1], cut[1:].copy()
    end -= buf[end - 1] == 10
    kind = _TABLE[buf]
    counts = np.empty((len(start), len(_CLASSES)), np.int64)
    for k in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts[:, k] = total[end] - total[start]
    size = end - start
    some = size > counts[:, SPACE]
    # words equal to the word before them in the line
    hashes, at = words_of(buf, cut)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])[: len(hashes)]
    same[at[:-1][at[:-1] < at[1:]]] = False
    total = np.concatenate([[0], np.cumsum(same)])
    again = (total[at[1:]] - total[at[:-1]])[some]
    start, end, size, counts = start[some], end[some], size[some], counts[some].astype(float)
    row = np.searchsorted(rows, start, "right") - 1
    # equal lines of one row
    key = mix(_hash_words(buf, start, end) + mix(row.astype(U)))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    words = counts[:, SPACE] + 1
    letters = np.maximum(counts[:, UPPER] + counts[:, LOWER], 1)
    share = lambda x, of: np.searchsorted(_SHARE_EDGES, x / of, "right")
    last = kind[end - 1]
    features = [
        share(counts[:, UPPER], letters),
        share(counts[:, DIGIT], size),
        share(counts[:, SYMBOL], size),
        share(counts[:, PIPE], size),
        share(counts[:, BANG], size),
        share(counts[:, STOP], words),
        share(counts[:, COMMA], words),
        np.searchsorted(_SIZE_EDGES, size, "right"),
        np.minimum(size / words, 10).astype(int),
        np.searchsorted(_TIMES_EDGES, times[inverse], "right"),
        last,
        kind[start],
        share(again, words),
    ]
    bins = np.stack(features, 1).astype(np.uint8)
    return bins, size, np.searchsorted(row, np.arange(n_rows + 1))


@dataclass
class LineField:
    """weights [3 (own, before, after), N_FEATURES, N_BINS] towards good, log transitions [2, 2], and the curve."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        around = neighbours(bins, first)
        at = np.arange(N_FEATURES)
        return sum(self.weights[k][at, around[k]].sum(1) for k in range(3))

    def document(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def neighbours(bins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.full((1, N_FEATURES), N_BINS - 1, np.uint8)
    before, after = np.concatenate([none, bins[:-1]])[: len(bins)], np.concatenate([bins[1:], none])[: len(bins)]
    some = first[:-1] < first[1:]
    before[first[:-1][some]] = N_BINS - 1
    after[first[1:][some] - 1] = N_BINS - 1
    return bins, before, after


def forward_backward(score: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of good for each line, expected moves [2, 2], log partition summed over rows).

    All rows advance together, one line at a time, longest first.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], first[:-1][order]
    m = np.exp(moves)
    e = np.stack([np.zeros_like(score), np.clip(score, -40, 40)], 1)
    e = np.exp(e - e.max(1, keepdims=True))
    a, b = np.empty_like(e), np.empty_like(e)
    log_z = float(np.maximum(np.clip(score, -40, 40), 0).sum())
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, steps + 1), "right")  # rows with more than t lines
    for t in range(steps):
        i = at[: active[t]] + t
        x = e[i] if t == 0 else (a[i - 1] @ m) * e[i]
        z = x.sum(1, keepdims=True)
        log_z += float(np.log(z).sum())
        a[i] = x / z
    for t in range(steps - 1, -1, -1):
        i = at[: active[t]] + t
        more = active[t + 1] if t + 1 < steps else 0
        b[i[more:]] = 1.0
        if more:
            x = (e[i[:more] + 1] * b[i[:more] + 1]) @ m.T
            b[i[:more]] = x / x.sum(1, keepdims=True)
    p = a * b
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    inner = np.ones(len(score), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    j = np.flatnonzero(inner)
    pair = a[j - 1][:, :, None] * m[None] * (e[j] * b[j])[:, None, :]
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return p[:, 1], pair.sum(0), log_z


def weigh(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each row; 0 for rows without lines."""
    top, bottom = (np.concatenate([[0.0], np.cumsum(x)]) for x in (p * size, size))
    total = bottom[first[1:]] - bottom[first[:-1]]
    return np.where(total > 0, (top[first[1:]] - top[first[:-1]]) / np.maximum(total, 1), 0.0)


def fit(bins: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> LineField:
    """Adam on the penalised conditional likelihood; label: 0 or 1 for each row."""
    n = np.diff(first)
    y = np.repeat(label, n).astype(float)
    around = neighbours(bins, first)
    flat = [(np.arange(N_FEATURES)[None, :] * N_BINS + x).reshape(-1) for x in around]
    inner = np.repeat(label, np.maximum(n - 1, 0))
    seen = np.array([[(inner == 0).sum(), 0.0], [0.0, (inner == 1).sum()]])
    theta = np.zeros(3 * N_FEATURES * N_BINS + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = 1 / max(len(y), 1)
    field = LineField(np.zeros((3, N_FEATURES, N_BINS)), np.zeros((2, 2)))
    for k in range(1, rounds + 1):
        field.weights, field.moves = theta[:-4].reshape(3, N_FEATURES, N_BINS), theta[-4:].reshape(2, 2)
        p, moved, _ = forward_backward(field.scores(bins, first), first, field.moves)
        rest = np.repeat(y - p, N_FEATURES)
        parts = [np.bincount(x, rest, N_FEATURES * N_BINS) for x in flat]
        g = np.concatenate([*parts, (seen - moved).reshape(-1)]) * scale - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    field.weights, field.moves = theta[:-4].reshape(3, N_FEATURES, N_BINS).copy(), theta[-4:].reshape(2, 2).copy()
    raw = weigh(forward_backward(field.scores(bins, first), first, field.moves)[0], size, first)
    w = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)], 1)
    for _ in range(30):  # Newton steps of a logistic curve
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(hess, x.T @ (label - q) - 1e-2 * w)
    field.slope, field.shift = max(float(w[0]), 1e-6), float(w[1])
    return field


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in text_batches(batch.column(1)):
            bins, size, first = line_bins(buf, offsets)
            cut = list(zip(first[:-1].tolist(), first[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([bins[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([size[a:b].tobytes() for a, b in cut], pa.binary())], ["quality", "bins", "size"]
            )


def train(docs: DataFrame, labels: DataFrame, holdout: bool = True, train_docs: int = TRAIN_DOCS) -> LineField:
    """The field fitted on at most ``train_docs`` labelled documents, the first by a hash of their id.

    ``labels``: doc_id, quality (0 or 1; null or other values are ignored; of repeated ids the
    least counts). With ``holdout``, ids whose crc32 (as text) mod 3 is 1 are never used. Only
    line bins of these documents reach the driver.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).filter("label_id is not null and quality in (0, 1)")
    if holdout:
        given = given.filter(~is_held_out("label_id"))
    given = given.groupBy("label_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(train_docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = d.join(F.broadcast(given), F.col("doc_id") == F.col("label_id")).select("quality", "text").mapInArrow(lean(_collect), "quality int, bins binary, size binary").toArrow()
    label = rows.column("quality").to_numpy()
    if not len(label):
        return LineField(np.zeros((3, N_FEATURES, N_BINS)), np.zeros((2, 2)))
    bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, N_FEATURES)
    sizes = rows.column("size").to_pylist()
    first = np.cumsum([0, *(len(x) // 8 for x in sizes)])
    return fit(bins, np.frombuffer(b"".join(sizes), np.int64), first, label)


def is_held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _scores(field: LineField, texts: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for _, _, buf, offsets in text_batches(texts):
        bins, size, first = line_bins(buf, offsets)
        p, _, _ = forward_backward(field.scores(bins, first), first, field.moves)
        out.append(field.document(weigh(p, size, first)))
    return np.concatenate(out)


def _score(field: LineField) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(field, batch.column(1)))], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have no lines: raw quality 0, so they score as low as the curve
    goes. A null id counts as not held out. Repeated rows are each scored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = d.mapInArrow(lean(_score(field)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: LineField, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold. Only the text leaves the JVM."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(np.concatenate([np.zeros(0), *(_scores(field, column.slice(i, ROWS)) for i in range(0, len(column), ROWS))]))
            release()

    return docs.filter(F.arrow_udf(run, "double")(F.col("text").cast("string")) >= threshold)
