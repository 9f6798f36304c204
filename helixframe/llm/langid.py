"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Subwords are the 2-, 3- and 4-byte windows of a text's letters (other ASCII
becomes a blank), hashed into a table of embeddings. A text is the mean of its
windows' embeddings; a softmax over that mean gives the languages. Both are
trained by stochastic gradient descent in numpy on a bounded sample
(about ``most`` texts, by language) and on short cuts of those texts. A part of the sample that is
not trained on sets the temperature and the confidence below which a
prediction is rejected.

For prediction the embeddings are multiplied out with the softmax's weights, so
a window costs one look-up and whole texts of any length are scored in pieces.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows of
null lang or null id teach nothing; with no row to learn from every text is
``und``; repeated rows are predicted alike, and of a sampled doc_id's texts in a
language the smallest is learnt from; of equal scores the language first by name wins. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.sampling import unit_hash

BITS, DIM, WINDOWS = 14, 16, (2, 3, 4)
TABLE = len(WINDOWS) << BITS
LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
PIECE = 1 << 20


def letters(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" "


def windows(raw: np.ndarray, n: int) -> np.ndarray:
    """The table rows of the n-byte windows of ``raw``."""
    raw = raw.astype(np.uint32)
    m = len(raw) - n + 1
    h = raw[:m].copy()
    for k in range(1, n):
        h *= np.uint32(257)
        h += raw[k : k + m]
    h *= np.uint32(2654435761)
    h >>= np.uint32(32 - BITS)
    return h + np.uint32(WINDOWS.index(n) << BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # TABLE x languages: embeddings times weights
    bias: np.ndarray
    temperature: float
    accept: float

    def logits(self, text: str) -> np.ndarray:
        raw, total, n = letters(text), np.zeros(len(self.langs)), 0
        for at in range(0, len(raw), PIECE):
            part = np.frombuffer(raw[at : at + PIECE + max(WINDOWS) - 1], np.uint8)
            for w in WINDOWS:
                if len(part) >= w:
                    rows = windows(part, w)[: PIECE if at + PIECE < len(raw) else None]
                    total += np.bincount(rows - (WINDOWS.index(w) << BITS), minlength=1 << BITS) @ self.scores[WINDOWS.index(w) << BITS : (WINDOWS.index(w) + 1) << BITS] if len(rows) > 20_000 else self.scores[rows].sum(0, dtype=np.float64)
                    n += len(rows)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, whether it passes the rejection)."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, False
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.accept)


def train(texts: list[str], labels: list[str], seed: int = 11, epochs: int = 6, rate: float = 0.5, batch: int = 32) -> LanguageModel:
    """SGD on whole texts and cuts of 20 to 200 characters; a fifth of the texts calibrates."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros((TABLE, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y_of = {x: k for k, x in enumerate(langs)}
    held, rows, cal = rng.random(len(texts)) < 0.2, [], []
    for text, label, out in zip(texts, labels, held, strict=True):
        if not has_letter(text):
            continue
        cuts = [text]
        for _ in range(2):
            n = int(rng.integers(20, 200))
            cut = text[(b := int(rng.integers(0, max(1, len(text) - n)))) : b + n]
            cuts += [cut] if has_letter(cut) else []
        for cut in cuts:
            raw = np.frombuffer(letters(cut), np.uint8)
            ids, n = np.unique(np.concatenate([windows(raw, w) for w in WINDOWS if len(raw) >= w]), return_counts=True)
            (cal if out else rows).append((ids.astype(np.int64), (n / n.sum()).astype(np.float32), y_of[label], cut))
    rows, cal = (rows, cal) if rows else (cal, rows)
    e = (rng.standard_normal((TABLE, DIM)) * 0.5).astype(np.float32)
    w, b = (rng.standard_normal((DIM, len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[i] for i in order[at : at + batch]]
            ids, val = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            cut = np.cumsum([0, *(len(r[0]) for r in some[:-1])])
            h = np.add.reduceat(e[ids] * val[:, None], cut, axis=0)
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [r[2] for r in some]] -= 1
            p /= len(some)
            back = (p @ w.T).repeat(np.diff(np.append(cut, len(ids))), axis=0) * val[:, None]
            w -= step * (h.T @ p)
            b -= step * p.sum(0)
            np.add.at(e, ids, -step * 40 * back)
    model = LanguageModel(langs, (e @ w).astype(np.float32), b.astype(np.float64), 1.0, 0.0)
    if cal:
        z, y = np.array([model.logits(r[3]) for r in cal]), np.array([r[2] for r in cal])

        def loss(t: float) -> float:
            q = z / t - (z / t).max(1, keepdims=True)
            return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        q = z / model.temperature
        p = np.exp(q - q.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        conf, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-conf)
        precise = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
        good = np.nonzero(precise >= 0.98)[0]
        model.accept = float(conf[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, learn: Column, most: int = 2_500, least: int = 100) -> LanguageModel:
    """A model of ``lang`` from about ``most`` rows where ``learn`` holds, in proportion, and of each language ``least`` where there are so many."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), "text", "lang").where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = rows.groupBy("lang").agg(F.count("*").alias("n"))
    quota = F.greatest(F.lit(least), F.ceil(F.col("n") * most / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy(F.lit(1))))))
    # a row a language, of which there are no more than learnable rows; texts stay where they are
    per = F.broadcast(per.withColumn("quota", quota))
    some = rows.join(per, "lang").where(unit_hash("doc_id") <= 2 * F.col("quota") / F.col("n"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = some.select("lang", "doc_id", "quota").distinct().withColumn("r", F.row_number().over(first)).where("r <= quota").select("doc_id", "lang")
    got = some.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values(["doc_id", "lang"])
    return train(got["text"].tolist(), got["lang"].tolist())


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lang, score, sure = zip(*map(model.predict, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row; only the text is looked at."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, accepted boolean")
