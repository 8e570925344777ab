"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and of itself, hashed into an embedding table; a
passage of `PASSAGE` words averages the bags; a linear softmax over that average gives the class. Table and softmax
are trained together on the labelled documents: a document's score is that of its most toxic passage, so each epoch
trains on that passage of each document and on random passages of the clean ones. Unseen misspellings share most n-gram vectors with
the words they come from.

The fit uses a bounded sample, the `MOST` labelled rows of the least hash; of a labelled text of more than `FIT_CHARS` characters it
uses passages from evenly spread places, of that length in all. Scoring reads whole texts: as average and
softmax are linear, a word's share of a passage's score is computed once per distinct word.

Defined cases: null or empty text, or text of white space, has the share of toxic labels as its score; labels that are null, or of ids in the held-out fold,
are not used; a doc_id with several labels is toxic if one is; without labels of both kinds the score is the share of toxic labels (0 without any);
rows with the same doc_id are scored by their own texts; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import excerpt, pieces, returning, split_words, table, word_codes

#: Most labelled documents that the driver trains on, and most characters of each.
MOST = 4000
FIT_CHARS = 50_000
FOLDS = 5
BUCKETS, DIM = 1 << 15, 8
PASSAGE = 12
GRAMS = (3, 4, 5)


def subwords(word: str) -> list[int]:
    """Buckets of a word (without ASCII punctuation at its ends) and of its n-grams."""
    w = f"<{word.strip('!$%&*,.#|?;:()[]')}>"
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in {w, *(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))}]


def held_out(key):
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0


class Model:
    def __init__(self, prior: float = 0.0, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)).astype(np.float32) / DIM
        self.w = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.prior, self.fitted = prior, False

    def word_scores(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of each bag's logit differences (toxic - clean), and the bag's size."""
        per = self.table @ (self.w[:, 1] - self.w[:, 0])
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        if not len(bags):
            return np.zeros(0, np.float32), sizes
        flat = np.concatenate(bags)
        return np.add.reduceat(per[flat], np.cumsum(sizes) - sizes), sizes

    def passages(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of all passages of a text; they overlap by half."""
        n, step = len(scores), PASSAGE // 2
        if not n:
            return np.array([float(np.log(max(self.prior, 1e-9) / max(1 - self.prior, 1e-9)))])
        cut = np.arange(0, max(1, n - step), step)
        end = np.minimum(cut + PASSAGE, n)
        a, c = np.concatenate([[0], np.cumsum(scores, dtype=np.float64)]), np.concatenate([[0], np.cumsum(sizes)])
        return (a[end] - a[cut]) / (c[end] - c[cut]) + float(self.b[1] - self.b[0])


def train(texts: pa.Array, toxic: np.ndarray, epochs: int = 14, rate: float = 0.5, seed: int = 9) -> Model:
    model = Model(float(toxic.mean()) if len(toxic) else 0.0, seed)
    if len(np.unique(toxic)) < 2:
        return model
    ends, words = split_words(texts)
    codes, distinct = word_codes(words)
    bags = [np.array(subwords(w), np.int64) for w in distinct]
    rng, n, step = np.random.default_rng(seed), len(texts), PASSAGE // 2
    speed = np.full((BUCKETS, 1), 1e-3, np.float32)
    fast = np.full((DIM, 2), 1e-3, np.float32)
    heavy = float((toxic == 0).sum() / max(1, (toxic == 1).sum()))
    for epoch in range(epochs):
        scores, sizes = model.word_scores(bags)
        todo = []
        for d in range(n):
            own = codes[ends[d] : ends[d + 1]]
            if not len(own):
                continue
            logits = model.passages(scores[own], sizes[own])
            pick = {int(np.argmax(logits))}
            if epoch < 3 and toxic[d]:
                pick = set(range(len(logits)))  # which passage it is shows only after a while
            elif not toxic[d]:
                pick |= set(rng.integers(0, len(logits), 3).tolist())
            share = 1.0 / len(pick) if toxic[d] else 0.5
            todo += [(d, p * step, share * (heavy if toxic[d] else 1.0)) for p in pick]
        for i in rng.permutation(len(todo)).tolist():
            d, at, weight = todo[i]
            own = codes[ends[d] + at : min(ends[d] + at + PASSAGE, ends[d + 1])]
            bag = np.concatenate([bags[c] for c in own])
            rows, back = np.unique(bag, return_counts=True)
            share = (back / len(bag)).astype(np.float32)
            mean = share @ model.table[rows]
            z = mean @ model.w + model.b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(toxic[d])] -= 1.0
            p = (p * min(weight, 5.0)).astype(np.float32)
            back_ = model.w @ p
            grad = share[:, None] * back_[None, :]
            gw = np.outer(mean, p)
            speed[rows] += np.square(grad).sum(axis=1, keepdims=True)
            fast += np.square(gw)
            model.table[rows] -= rate * grad / np.sqrt(speed[rows])
            model.w -= 0.3 * rate * gw / np.sqrt(fast)
            model.b -= 0.02 * rate * p
    model.fitted = True
    return model


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = MOST, fit_chars: int = FIT_CHARS, train_on=None) -> Model:
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.where(train_on(F.col("id")) if train_on else ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    some = known.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(most)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "id")
    rows = rows.withColumn("text", excerpt(F.col("text"), fit_chars)).orderBy(F.xxhash64("id", F.lit(17)), "id", "text").limit(most).toArrow()
    return train(rows.column("text").combine_chunks(), np.array(rows.column("y").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, known = sent.value, {}
        for batch in batches:
            for piece in pieces(batch):
                ends, words = split_words(piece.column("text"))
                codes, distinct = word_codes(words)
                if not m.fitted:
                    out = np.full(piece.num_rows, m.prior)
                else:
                    if len(known) > 400_000:
                        known.clear()
                    new = [w for w in distinct if w not in known]
                    s, c = m.word_scores([np.array(subwords(w), np.int64) for w in new])
                    known.update(zip(new, zip(s.tolist(), c.tolist(), strict=True), strict=True))
                    both = np.array([known[w] for w in distinct], np.float64).reshape(-1, 2)
                    s, c = both[codes, 0], both[codes, 1]
                    top = np.array([m.passages(s[a:b], c[a:b]).max() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
                    out = 1 / (1 + np.exp(-np.clip(top, -50, 50)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(returning(run), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
