"""Approximate nearest neighbours: multi-index hashing of learned rotated binary codes.

Codes: vectors are centred and projected on several learned rotations (iterative quantisation from different starts) of
their principal axes; the signs are the bits. A code is split into `tables` substrings of `bits` bits, and each substring has an index
from its value to rows. A query looks up, in every index, all values within s flips of its own. By the pigeonhole principle that retrieves
every code within the Hamming radius tables * (s + 1) - 1, and of the codes beyond it those with a substring that agrees as well.
What is retrieved within the rerank radius is reranked by its floats in double precision.

Rows are dealt by hash to shards of bounded size. A shard is one task's work: it builds its indexes once and then takes the queries one
batch after another, so that neither pairs of rows nor all queries are ever held. Its answers, at most k for a query, are merged.

Both s and the rerank radius are calibrated on the learning sample, by exact neighbours within it: s is the least that retrieves
the share `aim` of them, the radius holds 99.5 % of them. The fit uses a bounded sample (`sample`); every row is indexed.
A query for which fewer than k rows are found is answered exactly, in blocks of queries against all rows; so are all, if the sample
shows that even MAX_FLIPS flips retrieve less than the share `aim` (codes then say too little of the distances).

Equal vectors are one entry, which keeps its k + 1 smallest ids: no other id of it can be among any query's k nearest. So a very
common vector is one row.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another length than the most
common one (ties: the shorter) take no part, neither as queries nor as candidates; rows with the same id and vector
are one candidate; fewer candidates than k are all returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ragged, returning, stored, table

K = 10
TABLES, BITS = 96, 16
#: Most flips of a substring that are probed.
MAX_FLIPS = 3
AIM = 0.93
#: Vectors that the rotations and the radii are fitted on, and how many of them serve as queries there.
SAMPLE, TRIALS = 20_000, 256
#: Queries that are answered exactly at once.
EXACT_BLOCK = 1 << 10
SHARD_ROWS = 1 << 14
RESULT = "query_id long, rank int, vec_id long, score double"


def learn(sample: np.ndarray, bits: int, rounds: int = 15, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dims x bits): principal axes, turned by iterative quantisation from several starts."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    rng, out = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in out) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((v.shape[1],) * 2))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.hstack(out)[:, :bits]


def encode(x: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """Codes as bytes, one row each, and their substrings as integers (tables x rows)."""
    mean, proj, bits = model
    sign = (x - mean) @ proj >= 0
    weights = 1 << np.arange(bits, dtype=np.int64)
    parts = sign.reshape(len(x), -1, bits) @ weights
    return np.packbits(np.pad(sign, ((0, 0), (0, -sign.shape[1] % 64))), axis=1, bitorder="little"), parts


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of x to the code y."""
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(axis=1)


def calibrate(sample: np.ndarray, model, k: int, aim: float = AIM, trials: int = TRIALS) -> tuple[int, int]:
    """(s, rerank radius) from the exact k nearest of some rows of the sample."""
    codes, parts = encode(sample, model)
    near_parts, near_codes = [0], [0]
    for i in range(0, len(sample), max(1, len(sample) // trials)):
        d = np.square(sample - sample[i]).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(d) - 1)]
        near_parts += np.bitwise_count(parts[near] ^ parts[i]).min(axis=1).tolist()
        near_codes += distances(codes[near], codes[i]).tolist()
    return int(np.quantile(near_parts, aim, method="higher")), int(np.quantile(near_codes, 0.995, method="higher"))


def flips(bits: int, s: int) -> list[int]:
    return [sum(1 << i for i in at) for n in range(s + 1) for at in itertools.combinations(range(bits), n)]


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(ok)


def _matrix(column) -> np.ndarray:
    """Equally long lists of doubles as an array."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Shard:
    """The rows of a shard, with one index for each substring: rows in the order of its value."""

    def __init__(self, x: np.ndarray, ids: list, model, s: int):
        self.x, self.ids, self.model = x, ids, model
        self.codes, parts = encode(x, model)
        bits = model[2]
        self.order = np.argsort(parts, axis=0, kind="stable").astype(np.int32)
        values = np.take_along_axis(parts, self.order, axis=0)
        self.start = np.stack([np.searchsorted(values[:, j], np.arange((1 << bits) + 1)) for j in range(parts.shape[1])]).astype(np.int32)
        self.near = np.array(flips(bits, s), np.int64)
        self.at = np.arange(parts.shape[1])[:, None]

    def search(self, code: np.ndarray, parts: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows within the radius among those retrieved, their distances to y, and how many were retrieved."""
        values = parts[:, None] ^ self.near[None, :]
        first, last = self.start[self.at, values].ravel(), self.start[self.at, values + 1].ravel()
        some = np.flatnonzero(last > first)
        table_ = (some // len(self.near)).astype(np.int64)
        n = (last[some] - first[some]).astype(np.int64)
        seen = np.zeros(len(self.x), bool)
        seen[self.order[ragged(first[some].astype(np.int64), n), np.repeat(table_, n)]] = True
        rows = np.flatnonzero(seen)
        near = rows[distances(self.codes[rows], code) <= radius]
        return near, np.sqrt(np.square(self.x[near] - y).sum(axis=1)), len(rows)


def best_of(d: np.ndarray, rows: np.ndarray, ids: list, me, k: int) -> list[tuple[float, int]]:
    """The k nearest ids of entries `rows` at the distances d, without `me`; ties to smaller ids."""
    if len(d) > k + 1:
        near = d <= np.partition(d, k)[k]
        rows, d = rows[near], d[near]
    return sorted((s, i) for s, r in zip(d.tolist(), rows.tolist(), strict=True) for i in ids[r] if i != me)[:k]


def _search(entries: DataFrame, asks: DataFrame, sent, k: int, s: int, radius: int, shards: int) -> DataFrame:
    """(shard, ask, query_id, vec_id, score, retrieved, reranked): the answers of every shard to every query."""
    base = entries.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).cast("long").alias("ask"), F.lit(0).cast("long").alias("query_id"), "ids", "vec")
    q = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ask", "query_id", F.array().cast("array<long>").alias("ids"), "vec")

    def run(batches):
        now, parts, index = None, [], None
        for b in batches:
            shard, ask = (b.column(c).to_numpy() for c in ("shard", "ask"))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(ask < 0))) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                piece = b.slice(lo, hi - lo)
                if shard[lo] != now:
                    now, parts, index = shard[lo], [], None
                if ask[lo] < 0:
                    parts.append((_matrix(piece.column("vec")), piece.column("ids").to_pylist()))
                    continue
                if index is None and parts:
                    index = Shard(np.vstack([x for x, _ in parts]), [i for _, ids in parts for i in ids], sent.value, s)
                    parts = []
                if index is not None:
                    out = _answers(index, piece, k, radius)
                    if out is not None:
                        yield out

    rows = base.unionByName(q).repartition(shards, "shard").sortWithinPartitions("shard", "ask")
    return rows.mapInArrow(returning(run), "shard int, ask long, query_id long, vec_id long, score double, retrieved long, reranked long")


def _answers(index: Shard, piece: pa.RecordBatch, k: int, radius: int) -> pa.RecordBatch | None:
    y = _matrix(piece.column("vec"))
    codes, parts = encode(y, index.model)
    out: list[tuple] = []
    for i, (shard, ask, me) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("shard", "ask", "query_id")), strict=True)):
        rows, d, seen = index.search(codes[i], parts[i], y[i], radius)
        out += [(shard, ask, me, v, score, seen, len(rows)) for score, v in best_of(d, rows, index.ids, me, k)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    names = ["shard", "ask", "query_id", "vec_id", "score", "retrieved", "reranked"]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names) if out else None


def _exact(entries: DataFrame, asks: list, k: int) -> DataFrame:
    """(query_id, vec_id, score) for a block of queries against all entries; every task keeps its k nearest of each."""
    sent = entries.sparkSession.sparkContext.broadcast((np.array([r["vec"] for r in asks], np.float64), [r["query_id"] for r in asks]))

    def run(batches):
        q, names = sent.value
        best: list[list] = [[] for _ in names]
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b.column("vec")), b.column("ids").to_pylist()
            for i, me in enumerate(names):
                d = np.sqrt(np.square(x - q[i]).sum(axis=1))
                best[i] = sorted([*best[i], *best_of(d, np.arange(len(d)), ids, me, k)])[:k]
        rows = [(me, j, s) for me, found in zip(names, best, strict=True) for s, j in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return entries.select("vec", "ids").mapInArrow(returning(run), "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query, *, k: int = K, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, bits: int = BITS, aim: float = AIM, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df to each row for which is_query (a Column over vec_id) holds.

    report, a dict, is given s, the radius and the numbers of entries, queries, retrieved and reranked pairs.
    """
    spark = df.sparkSession
    rows = _clean(df, key, vector)
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("vec") == sizes[0]["n"])
    # equal vectors: the smallest ids, reduced by parts first, so that no task gathers a common vector's rows
    keep = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    part = rows.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("salt")).agg(keep(F.collect_list("vec_id")).alias("ids"))
    entries = stored(part.groupBy("vec").agg(keep(F.flatten(F.collect_list("ids"))).alias("ids")), "vectors")
    picked = entries.orderBy(F.xxhash64("vec", F.lit(1)), "ids").limit(sample).select("vec").toArrow()
    some = _matrix(picked.column("vec"))
    model = (*learn(some, tables * bits), bits)
    s, radius = calibrate(some, model, k, aim)
    sent = spark.sparkContext.broadcast(model)
    n = entries.count()
    asks = stored(rows.where(is_query).dropDuplicates(["vec_id", "vec"]).select(F.col("vec_id").alias("query_id"), "vec").withColumn("ask", F.monotonically_increasing_id()), "queries")
    got = _search(entries, asks if s <= MAX_FLIPS else asks.where("false"), sent, k, min(s, MAX_FLIPS), radius, max(1, -(-n // shard_rows)))
    got = stored(got, "neighbours")
    if report is not None:
        sums = got.select("shard", "ask", "retrieved", "reranked").distinct().agg(F.sum("retrieved").alias("retrieved"), F.sum("reranked").alias("reranked")).first()
        report |= {"s": s, "radius": radius, "entries": n, "queries": asks.count()} | sums.asDict()
    short = asks.join(got.groupBy("ask").agg(F.count_distinct("vec_id").alias("count")).where(F.col("count") >= k).select("ask"), "ask", "left_anti").select("ask", "query_id", "vec")
    found = got.select("query_id", "vec_id", "score")
    blocks = -(-short.count() // EXACT_BLOCK)
    for i in range(blocks):
        block = short.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == i).select("query_id", "vec").collect()
        if block:
            found = found.unionByName(stored(_exact(entries, block, k), "neighbours"))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return _first(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest of each query, with their rank; partial limits run before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
