"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives (labelled rows of quality 1) and unlabelled web text train a
small network on measures of a text's form: alphabet, casing, marks, word
lengths, repetition, line shape. The risk is pi * R+(g) + max(0, Ru-(g) - pi *
R+-(g)) with the sigmoid loss, minimised by stochastic gradient steps in
numpy; where the negative part falls below zero its gradient is reversed. The
class prior pi is estimated from positives and unlabelled text alone: with a
probe that tells the two apart, the mean of its output over unlabelled text
over that over held-back positives. The network's output orders the texts; slope and
shift that make it a probability, and so where ``cut`` falls, are fitted on
labelled rows of both classes that learning may see.

Samples are bounded by ``positives`` and ``unlabelled``; the measures of a text
cover all of it.

Edge cases: null and empty texts have zero measures and are scored too; rows of
null label or id teach nothing; with no positive to learn from every score is
0.5 and every document passes; repeated rows are scored alike; extra columns
pass through the filter untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.sampling import sample_ids

# classes of bytes: other, lower, upper, digit, blank, newline, stop, symbol, bar, bang, brace, beyond ASCII
_KINDS = ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:'\"-?()", 6), (b"#$%&*+=@\\^_~`", 7), (b"|", 8), (b"!", 9), (b"<>[]{}/", 10), (bytes(range(128, 256)), 11))
CLASS = bytearray(256)
for _chars, _k in _KINDS:
    for _c in _chars:
        CLASS[_c] = _k
CLASS = bytes(CLASS)
N_MEASURES = 26


def measures(text: str | None) -> np.ndarray:
    """The measures of a whole text, each between 0 and about 1."""
    out = np.zeros(N_MEASURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    kinds = raw.translate(CLASS)
    n = len(raw)
    for k in range(12):
        out[k] = kinds.count(k) / n
    m = len(words)
    freq = Counter(words)
    lengths = list(map(len, words))
    out[12] = min(1.0, math.log1p(m) / 10)
    out[13] = min(1.0, sum(lengths) / m / 20)
    out[14] = min(1.0, max(lengths) / 100)
    out[15] = len(freq) / m
    out[16] = max(freq.values()) / m
    out[17] = sum(a == b for a, b in zip(words, words[1:])) / m
    out[18] = len(set(zip(words, words[1:]))) / m
    ends = kinds.translate(bytes(1 if k in (7, 9, 10) else 0 for k in range(256)))
    tails = b"".join([w[-1:] for w in words]).translate(CLASS)
    out[19] = (tails.count(7) + tails.count(9) + tails.count(10)) / m
    out[20] = tails.count(6) / m
    lines = raw.split(b"\n")
    out[21] = min(1.0, math.log1p(len(lines)) / 8)
    out[22] = len(set(lines)) / len(lines)
    out[23] = min(1.0, m / len(lines) / 100)
    out[24] = sum(not w.isalpha() for w in freq if w.isascii()) / len(freq)
    out[25] = ends.count(1) / n
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    sd: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    trained: bool = True

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.sd) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_prior(pos: np.ndarray, unl: np.ndarray, rng: np.random.Generator) -> float:
    """The share of positives in ``unl``, from a logistic probe of positives against unlabelled text."""
    held = rng.random(len(pos)) < 0.3
    if held.sum() < 5 or (~held).sum() < 5:
        return 0.5
    p, h = pos[~held], pos[held]
    x = np.concatenate([p, unl])
    mean, sd = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / sd, -8, 8)
    y = np.concatenate([np.ones(len(p)), np.zeros(len(unl))])
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(400):
        g = _sig(z @ w + b) - y
        w -= 0.3 * (z.T @ g / len(y) + 1e-3 * w)
        b -= 0.3 * g.mean()
    f = lambda a: _sig(np.clip((a - mean) / sd, -8, 8) @ w + b)
    return float(np.clip(f(unl).mean() / max(f(h).mean(), 1e-6), 0.05, 0.95))


def train(pos: np.ndarray, unl: np.ndarray, known: np.ndarray, label: np.ndarray, seed: int = 5, epochs: int = 60, hidden: int = 12, rate: float = 0.05) -> QualityModel:
    """``pos``, ``unl``: measures; ``known``, ``label``: measures and labels to calibrate on."""
    rng = np.random.default_rng(seed)
    d = N_MEASURES
    if not len(pos) or not len(unl):
        return QualityModel(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5, trained=False)
    pi = class_prior(pos, unl, rng)
    mean, sd = unl.mean(0), unl.std(0) + 1e-3
    m = QualityModel(mean, sd, rng.standard_normal((d, hidden)) / math.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / math.sqrt(hidden), 0.0, pi)
    xp, xu = np.clip((pos - mean) / sd, -8, 8), np.clip((unl - mean) / sd, -8, 8)
    m.mean, m.sd = mean, sd
    params = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second, t, size = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0, 256
    for _ in range(epochs):
        pu = rng.permutation(len(xu))
        for at in range(0, len(pu), size):
            u = xu[pu[at : at + size]]
            p = xp[rng.integers(0, len(xp), size)]
            hp, hu = np.tanh(p @ params[0] + params[1]), np.tanh(u @ params[0] + params[1])
            gp, gu = hp @ params[2] + params[3][0], hu @ params[2] + params[3][0]
            # sigmoid loss: l(g, +) = s(-g), l(g, -) = s(g)
            sp, su = _sig(gp), _sig(gu)
            neg = su.mean() - pi * sp.mean()
            dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
            if neg >= 0:
                dgp, dgu = -pi * dp - pi * dp, du
            else:
                dgp, dgu = pi * dp, -du
            grads = [np.zeros_like(q) for q in params]
            for x, h, dg in ((p, hp, dgp), (u, hu, dgu)):
                dh = np.outer(dg, params[2]) * (1 - h * h)
                grads[0] += x.T @ dh
                grads[1] += dh.sum(0)
                grads[2] += h.T @ dg
                grads[3] += dg.sum()
            t += 1
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                g = g + 1e-4 * q
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * 0.2 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(known) and 0 < label.mean() < 1:
        g, a, b = m.raw(known), 1.0, 0.0
        scale = max(g.std(), 1e-6)
        g = g / scale
        for _ in range(2000):
            e = _sig(a * g + b) - label
            a -= 0.5 * ((e * g).mean() + 1e-3 * a)
            b -= 0.5 * e.mean()
        m.slope, m.shift = a / scale, b
    return m


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([measures(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = 6_000, unlabelled: int = 8_000) -> QualityModel:
    """A model from bounded samples; labels are read only where ``learn`` (over doc_id) holds."""
    marked = labels.where(learn & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = sample_ids(marked, "doc_id", positives)
    some = marked.join(F.broadcast(ids), "doc_id")
    web = sample_ids(docs.select("doc_id"), "doc_id", unlabelled)
    wanted = some.select("doc_id").union(web).distinct()  # at most positives + unlabelled ids
    # of a repeated doc_id the smallest text counts
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(_measure, "doc_id long, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    lab = some.toPandas().set_index("doc_id")["quality"]
    web_ids = {r[0] for r in web.collect()}
    x = np.array(rows["x"].tolist()).reshape(-1, N_MEASURES)
    y = rows["doc_id"].map(lab).to_numpy(dtype=float)
    is_web = rows["doc_id"].isin(web_ids).to_numpy()
    known = ~np.isnan(y)
    return train(x[known & (y == 1)], x[is_web], x[known], y[known])


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([measures(t) for t in part.column(part.num_columns - 1).to_pylist()]).reshape(-1, N_MEASURES)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], [*part.schema.names, "quality"])

    return run


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row; only the text is looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, text string, quality double").select("doc_id", F.col("quality").alias("score"))


def keep_good(docs: DataFrame, model: QualityModel, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    scored = rows.mapInArrow(_score(model), f"row {rows.schema['row'].dataType.simpleString()}, text string, quality double")
    return scored.where(F.col("quality") >= cut).select("row.*")
