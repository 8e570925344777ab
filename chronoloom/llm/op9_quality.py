"""Quality classifier by co-training.

Two views of a document, each with a logistic regression of its own: its text content (how often words of each shape
occur) and its page metadata (source, language, length). In each round every unlabelled document is scored by both views, and each hands
the documents about which it is surest, of all of them, to the other as pseudo-labels. At the end each view is calibrated on labelled rows that
neither was fitted on (on the fitted rows where there are too few of either class to set some aside), and the calibrated log-odds are
added, less the prior counted twice.

Fitted on a bounded sample: the `MOST` labelled rows of the least hash, of texts of more than `FIT_CHARS` characters passages from
evenly spread places of that length in all; and on the `GIVE` pseudo-labels that a view hands over in a round, chosen from all unlabelled
documents, whose features are computed from whole texts and written once. All documents are scored on whole texts.

Defined cases: null or empty text has no words (the metadata decide); null metadata are a value of their own; null labels
and labels of the held-out fold are not used; a doc_id with several labels counts as good if one is; without labels of both
kinds the score is the share of good labels (1 without any); rows with the same doc_id are scored on their own; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, excerpt, pieces, returning, split_words, stored, table, word_codes

#: Most labelled documents that the driver trains on, most characters of each, and pseudo-labels of a view and round.
MOST = 3000
FIT_CHARS = 67_000
GIVE = 300
#: Bytes of text whose words are held at once, and words whose shapes a worker remembers.
PIECE_BYTES, KNOWN = 2 << 20, 100_000
SHAPES, META = 1 << 10, 1 << 9
_RUN = re.compile(r"(.)\1+", re.S)
_LETTERS = {ord("0") + i: "0" for i in range(10)} | {i: "a" for i in range(97, 123)} | {i: "A" for i in range(65, 91)}


def shape(word: str) -> str:
    """A word with letters as a or A, digits as 0, and runs cut to one: 'Thnd***' is 'Aa*'."""
    w = word.translate(_LETTERS)
    if not w.isascii():
        w = "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else "?" for c in w)
    return _RUN.sub(r"\1", w)


_shapes: dict[str, int] = {}


def text_features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of word shapes, hashed to SHAPES columns."""
    ends, words = split_words(texts, lower=False)
    codes, distinct = word_codes(words)
    if len(_shapes) > KNOWN:
        _shapes.clear()
    for w in distinct:
        if w not in _shapes:
            _shapes[w] = xxhash.xxh32_intdigest(shape(w)) % SHAPES
    col = np.fromiter((_shapes[w] for w in distinct), np.int64, len(distinct))[codes] if len(distinct) else np.zeros(0, np.int64)
    out = np.zeros((len(texts), SHAPES), np.float32)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b > a:
            out[i] = np.sqrt(np.bincount(col[a:b], minlength=SHAPES) / (b - a))
    return out


def meta_features(source: list, lang: list, length: list) -> np.ndarray:
    out = np.zeros((len(source), META), np.float32)
    for i, x in enumerate(zip(source, lang, length, strict=True)):
        for name, v in zip(("source", "lang", "length"), (x[0], x[1], len(f"{x[2] or 0:b}")), strict=True):
            out[i, xxhash.xxh32_intdigest(f"{name}={v}") % META] = 1.0
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights and intercept of a logistic regression, by Adam on the whole sample."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)  # products in single precision: no copy of x in each step
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (weight * (p - y)).astype(np.float32) / weight.sum() + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Model:
    def __init__(self, share: float):
        self.share, self.views = share, None

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        if self.views is None:
            return np.full(len(views[0]), self.share)
        z = sum(a * logit(x, w) + b - self.prior for x, (w, a, b) in zip(views, self.views, strict=True)) + self.prior
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Pool:
    """The features of rows, as a written table: doc_id, h (of the text), at, value (text view), meta (places).

    labelled: doc_ids that hand over nothing. They are told apart by joins of scores, so that no text is dealt out by its id.
    """

    def __init__(self, rows: DataFrame, labelled: DataFrame):
        self.labelled = labelled

        def run(batches):
            for batch in batches:
                for piece in pieces(batch, limit=PIECE_BYTES):
                    x, m = _views(piece)
                    row, at = np.nonzero(x)
                    ends = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                    places = np.sort(np.argsort(-m, axis=1, kind="stable")[:, :3], axis=1)
                    places = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 3), pa.array(np.where(np.take_along_axis(m, places, 1) > 0, places, -1).ravel().astype(np.int16)))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int16), x[row, at])]
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("h"), *lists, places], ["doc_id", "h", "at", "value", "meta"])

        self.table = stored(rows.mapInArrow(returning(run), "doc_id long, h long, at array<short>, value array<float>, meta array<short>"), "quality-pool")

    @staticmethod
    def dense(batch) -> list[np.ndarray]:
        """The two views of rows of the table."""
        out = [np.zeros((batch.num_rows, n), np.float32) for n in (SHAPES, META)]

        def flat(name):
            c = batch.column(name)
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            return np.repeat(np.arange(len(c)), pc.list_value_length(c).to_numpy(zero_copy_only=False)), c.flatten().to_numpy(zero_copy_only=False)

        row, at = flat("at")
        out[0][row, at] = flat("value")[1]
        row, at = flat("meta")
        out[1][row[at >= 0], at[at >= 0]] = 1.0
        return out

    def surest(self, weights, scales, give: tuple[int, int], sure: float) -> list[tuple[int, int, tuple, list[np.ndarray]]]:
        """(view, label, document, features) of the unlabelled documents of the whole pool about which each view is surest."""

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    piece = b.slice(lo, 4096)
                    for v, x in enumerate(self_dense(piece)):
                        p = 1 / (1 + np.exp(-np.clip(scales[v][0] * logit(x, weights[v]) + scales[v][1], -30, 30)))
                        for label in (0, 1):
                            c = p if label else 1 - p
                            some = np.flatnonzero(c >= sure)
                            if len(some):
                                kind = [pa.array(np.full(len(some), k, np.int32)) for k in (v, label)]
                                yield pa.RecordBatch.from_arrays([*kind, pa.array(-c[some]), *(piece.column(n).take(pa.array(some)) for n in ("doc_id", "h"))], ["v", "label", "c", "doc_id", "h"])

        self_dense = Pool.dense
        rows = self.table.mapInArrow(returning(run), "v int, label int, c double, doc_id long, h long")
        some = stored(rows.join(self.labelled, "doc_id", "left_anti"), "quality-surest")
        picked = [r for v in (0, 1) for label in (0, 1) for r in some.where((F.col("v") == v) & (F.col("label") == label)).orderBy("c", "doc_id", "h").limit(give[label]).collect()]
        discard(some)
        if not picked:
            return []
        ids = F.broadcast(self.table.sparkSession.createDataFrame(sorted({(r["doc_id"], r["h"]) for r in picked}), "doc_id long, h long"))
        rows = self.table.join(ids, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).toArrow()
        at = {n: i for i, n in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("h").to_pylist(), strict=True))}
        views = Pool.dense(rows)
        return [(r["v"], r["label"], (r["doc_id"], r["h"]), [x[at[r["doc_id"], r["h"]]] for x in views]) for r in picked]


def cotrain(known: list[np.ndarray], y: np.ndarray, pool: Pool | None, rounds: int = 4, give: int = GIVE, sure: float = 0.95) -> Model:
    """known: the two views' features of labelled documents; pool: all documents, of which the unlabelled ones are handed over."""
    model = Model(float(y.mean()) if len(y) else 1.0)
    if len(np.unique(y)) < 2:
        return model
    hold = np.arange(len(y)) % 5 == 0
    if min(y[hold].sum(), (1 - y[hold]).sum(), y[~hold].sum(), (1 - y[~hold]).sum()) < 1:
        hold[:] = True  # too few to set rows aside
    fit = ~hold if not hold.all() else hold
    given: list[dict] = [{}, {}]  # document -> (label, features) that a view got from the other
    weights = [None, None]

    def fitted(v):
        more = [given[v][d] for d in sorted(given[v])]
        x = np.vstack([known[v][fit], *(f[v][None, :] for _, f in more)])
        target = np.concatenate([y[fit], [label for label, _ in more]])
        return logistic(x, target, np.concatenate([np.ones(fit.sum()), np.full(len(more), 0.5)]))

    def calibrated(v):
        z = logit(known[v][hold], weights[v])
        a, b = logistic(z[:, None], y[hold], np.ones(hold.sum()), l2=1e-3)
        return max(a, 0.0), b

    counts = (int(give * (1 - model.share)) + 1, int(give * model.share) + 1)
    for r in range(rounds + 1):
        weights = [fitted(0), fitted(1)]
        scales = [calibrated(0), calibrated(1)]
        new = pool.surest(weights, scales, counts, sure) if pool and r < rounds else []
        if not new:
            break
        for v, label, doc, features in new:
            given[1 - v].setdefault(doc, (label, features))
    model.prior = float(np.log(model.share / (1 - model.share)))
    model.views = [(w, a, b) for w, (a, b) in zip(weights, scales, strict=True)]
    return model


def _columns(docs: DataFrame, text: str, key: str, source: str, lang: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), t.alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.length(t).cast("long").alias("n"))


def _views(t) -> list[np.ndarray]:
    texts = t.column("text")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return [text_features(texts), meta_features(*(t.column(c).to_pylist() for c in ("source", "lang", "n")))]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", most: int = MOST, fit_chars: int = FIT_CHARS, give: int = GIVE, train_on=None) -> Model:
    from .op6_toxicity import held_out

    usable = (lambda c: train_on(c)) if train_on else (lambda c: ~held_out(c))
    y = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("id", F.lit(23)), "id"]
    some = y.where(usable(F.col("id"))).orderBy(*order).limit(most)
    d = _columns(docs, text, key, source, lang)
    known = d.withColumn("text", excerpt(F.col("text"), fit_chars)).join(F.broadcast(some), d["doc_id"] == some["id"]).orderBy(*order, "text").limit(most).toArrow()
    rows = d.where(F.col("doc_id").isNotNull() & usable(F.col("doc_id"))).withColumn("h", F.xxhash64("text"))
    labels_ = np.array(known.column("y").to_pylist(), np.float64)
    pool = Pool(rows, y.select(F.col("id").alias("doc_id"))) if len(np.unique(labels_)) == 2 else None
    model = cotrain(_views(known), labels_, pool, give=give)
    if pool:
        discard(pool.table)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", keep: float | None = None) -> DataFrame:
    """doc_id and score of every row; with keep, the columns of docs where the score reaches it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(piece):
        s = sent.value.score(_views(piece))
        return np.where(np.isnan(s), 0.5, s)

    if keep is None:

        def run(batches):
            for batch in batches:
                for piece in pieces(batch, limit=PIECE_BYTES):
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scored(piece), pa.float64())], ["doc_id", "score"])

        return _columns(docs, text, key, source, lang).mapInArrow(returning(run), "doc_id long, score double")

    # each text goes to the Python workers once: the views are taken from the columns of docs themselves
    def keep_good(batches):
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                view = {"text": piece.column(text), "source": piece.column(source), "lang": piece.column(lang)}
                view = {c: v if pa.types.is_string(v.type) else v.cast(pa.string()) for c, v in view.items()}
                keeps = scored(pa.table(view | {"n": pc.utf8_length(view["text"])})) >= keep
                yield piece.filter(pa.array(keeps))

    return docs.mapInArrow(returning(keep_good), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_toxicity import held_out

    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
