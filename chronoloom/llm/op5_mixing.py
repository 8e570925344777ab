"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Every source gets a target in words. A source takes whole passes over its documents and then the documents whose
permuted hash lies below a threshold, so that its words meet the target to within one document. The hash also
cuts a source into blocks; how many blocks each output shard gets of each source and pass is drawn by a tree that splits the
shards in halves and, at each node, splits the exact block quotas by a multivariate hypergeometric draw. Each shard
then takes its quota from the permuted blocks of the source, disjoint from all other shards, and shuffles locally.

What the driver holds is one row per source and per block: the number of blocks is bounded by `max_blocks`, whatever
the input's size. With more than `max_sources` sources all of these are tables and the driver holds one row per partition;
the targets and thresholds follow the same rules, and the blocks are dealt in the order of a hash, a draw of the same kind.

Defined cases: a null text has size 0; documents of size 0 take part in the draw and count no words; a null source is
a source of its own, the last; rows with the same doc_id are separate documents, and rows equal in doc_id and text
share their fate; no rows give an empty result; further columns are ignored by assign() and kept by mix().
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BITS = 10
HASH_BITS = 60


def fill(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Targets: share * sum(sizes) by weight, none above cap * size, the excess shared again among the others."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    targets, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * sizes.sum()
    while open_.any():
        part = left * weights / weights[open_].sum()
        over = open_ & (part > cap * sizes)
        if not over.any():
            targets[open_] = part[open_]
            break
        targets[over] = cap * sizes[over]
        left -= targets[over].sum()
        open_ &= ~over
    return targets.tolist()


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal the exact block quotas of all sources to shards of nearly equal numbers of blocks: (shards, sources)."""
    quotas = np.asarray(quotas, np.int64)
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(round(quotas.sum() * left / shards))
    some = rng.multivariate_hypergeometric(quotas, take, method="marginals") if quotas.sum() else quotas * 0
    return np.vstack([split_tree(some, left, rng), split_tree(quotas - some, shards - left, rng)])


def _thresholds(sized: DataFrame, rest: dict, levels: int = HASH_BITS // BITS) -> dict:
    """For each source index the hash below which documents are taken once more: their words come nearest to rest.

    A radix search: each level counts the words by the next BITS bits of the hash within one open cell of each
    source, so that a level returns at most 2**BITS rows per source.
    """
    open_ = {s: (0, float(r)) for s, r in rest.items() if r > 0}
    found = dict.fromkeys(rest, 0)
    for level in range(1, levels + 1):
        if not open_:
            break
        shift = HASH_BITS - BITS * level
        cell = sized.sparkSession.createDataFrame([(s, p) for s, (p, _) in open_.items()], "src int, prefix long")
        cells = (
            sized.join(F.broadcast(cell), "src")
            .where(F.shiftright("h", shift + BITS) == F.col("prefix"))
            .groupBy("src", F.shiftright("h", shift).alias("p"))
            .agg(F.sum("size").alias("words"))
            .orderBy("src", "p")
            .collect()
        )
        by: dict[int, list] = {}
        for r in cells:
            by.setdefault(r["src"], []).append((r["p"], r["words"]))
        closed = {}
        for s, (prefix, want) in open_.items():
            at, end = None, (prefix + 1) << (HASH_BITS - BITS * (level - 1))
            for p, words in by.get(s, []):
                if words > want:
                    at = (p, want, words)
                    break
                want -= words
            if at is None:
                found[s] = end
            elif level == levels:
                found[s] = (at[0] + (at[1] * 2 >= at[2])) << shift
            else:
                closed[s] = at[:2]
        open_ = closed
    return found


def assign(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = 64, block_words: int = 1 << 16, max_blocks: int = 1 << 14, max_sources: int = 1 << 16, seed: int = 7) -> DataFrame:
    """One row per row of docs: key, text hash, source, size, source_size, target, shards (one entry for each copy)."""
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = stored(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 64 - HASH_BITS)), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        return _assign_by_tables(sized, weights, share, cap, shards, block_words, max_blocks, seed)
    sums = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [r["size"] or 0 for r in sums]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap) if sums else []
    passes = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    rest = {i: t - p * s for i, (t, p, s) in enumerate(zip(targets, passes, sizes, strict=True))}
    sources = spark.createDataFrame(
        [(i, r["source"], sizes[i], float(targets[i]), passes[i]) for i, r in enumerate(sums)],
        "src int, source_name string, source_size long, target double, passes int",
    )
    numbered = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source_name"])).drop("source_name")
    edge = _thresholds(numbered, rest)
    # blocks: 2**bits equal ranges of the hash for each source and pass, the last pass only below the threshold
    total = max(1, sum(targets))
    unit = max(block_words, 2 * total / max_blocks)
    rng = np.random.default_rng(seed)
    kinds = []  # (source, pass, bits, number of blocks)
    for i, s in enumerate(sizes):
        bits = max(0, min(20, int(np.ceil(np.log2(max(1.0, s / unit))))))
        for k in range(passes[i]):
            kinds.append((i, k, bits, 1 << bits))
        if edge[i]:
            kinds.append((i, passes[i], bits, -(-edge[i] // (1 << (HASH_BITS - bits)))))
    quotas = np.array([k[3] for k in kinds], np.int64)
    dealt = split_tree(quotas, shards, rng) if kinds else np.zeros((shards, 0), np.int64)
    rows = []
    for c, (i, k, bits, n) in enumerate(kinds):
        for block, shard in zip(rng.permutation(n).tolist(), np.repeat(np.arange(shards), dealt[:, c]).tolist(), strict=True):
            rows.append((i, block, k, shard))
    blocks = spark.createDataFrame(rows, "src int, block long, pass int, shard int")
    cuts = spark.createDataFrame([(i, HASH_BITS - next((k[2] for k in kinds if k[0] == i), 0), int(edge[i])) for i in range(len(sizes))], "src int, drop_bits int, edge long")
    return _place(numbered, F.broadcast(cuts), blocks, len(rows) <= 4 * max_blocks)


def _place(numbered: DataFrame, cuts: DataFrame, blocks: DataFrame, small: bool = False) -> DataFrame:
    """The result of assign(): every document with the shards that own its block in each pass."""
    owners = blocks.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("owners"))
    owners = F.broadcast(owners) if small else owners
    placed = numbered.join(cuts, "src").withColumn("block", F.expr("shiftright(h, drop_bits)")).join(owners, ["src", "block"], "left")
    mine = F.filter(F.coalesce("owners", F.array().cast("array<struct<pass:int,shard:int>>")), lambda o: (o["pass"] < F.col("passes")) | (F.col("h") < F.col("edge")))
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", F.transform(mine, lambda o: o["shard"]).alias("shards"))


def _counted(df: DataFrame, name: str, *order) -> DataFrame:
    """df with its place in the order (from 0) as column name. The driver holds one row per partition."""
    d = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "mix-order")
    parts, at, offsets = F.shiftright("_m", 33), 0, []
    for r in d.groupBy(parts.alias("_p")).count().orderBy("_p").collect():
        offsets.append((r["_p"], at))
        at += r["count"]
    o = d.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return d.withColumn("_p", parts).join(F.broadcast(o), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_o")


def _targets(sums: DataFrame, share: float, cap: float) -> DataFrame:
    """fill() as a table: sums (src, source_size, weight) with the column target."""
    w, size = F.col("weight"), F.col("source_size")
    first = sums.agg(F.sum(size).alias("s"), F.sum(w).alias("w")).first()
    left, open_, n = share * first["s"], first["w"], 0
    while open_:
        over = F.lit(left) * w / F.lit(open_) > cap * size
        r = sums.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, size)), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(~over, w)), F.lit(0.0)).alias("w")).first()
        if r["n"] == n:
            return sums.withColumn("target", F.when(over, cap * size).otherwise(F.lit(left) * w / F.lit(open_)))
        n, left, open_ = r["n"], share * first["s"] - cap * r["s"], r["w"]
    return sums.withColumn("target", cap * size)


def _edges(numbered: DataFrame, sources: DataFrame, levels: int = HASH_BITS // BITS) -> DataFrame:
    """_thresholds() as a table: src, edge of the sources with a rest."""
    open_ = sources.where("rest > 0").select("src", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("want"))
    edges = []
    for level in range(1, levels + 1):
        shift = HASH_BITS - BITS * level
        p = F.shiftright("h", shift)
        words = numbered.select("src", "h", "size").join(open_, "src").where(F.shiftright("h", shift + BITS) == F.col("prefix")).groupBy("src", "want", p.alias("p")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("src").orderBy("p"))  # at most 2**BITS rows of a source
        hit = words.withColumn("upto", upto).where("upto > want").groupBy("src").agg(F.min(F.struct("p", (F.col("want") - F.col("upto") + F.col("words")).alias("want"), "words")).alias("m"))
        found = stored(open_.join(hit, "src", "left").select("src", "prefix", "m"), "mix-edges")
        edges.append(found.where("m IS NULL").select("src", F.shiftleft(F.col("prefix") + 1, shift + BITS).alias("edge")))
        open_ = found.where("m IS NOT NULL").select("src", F.col("m.p").alias("prefix"), F.col("m.want").alias("want"), F.col("m.words").alias("words"))
        if level == levels:
            edges.append(open_.select("src", (F.col("prefix") + (F.col("want") * 2 >= F.col("words")).cast("long")).alias("edge")))
        open_ = open_.drop("words")
    return reduce(DataFrame.unionByName, edges)


def _assign_by_tables(sized: DataFrame, weights, share: float, cap: float, shards: int, block_words: int, max_blocks: int, seed: int) -> DataFrame:
    """assign() for any number of sources."""
    sums = _counted(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "src", F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])[(F.col("src") % len(weights)).cast("int")]
    sums = _targets(stored(sums.withColumn("weight", turn), "mix-sums"), share, cap)
    size, passes = F.col("source_size"), F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    sources = stored(sums.select("src", F.col("source").alias("source_name"), "source_size", "target", passes.alias("passes")).withColumn("rest", F.col("target") - F.col("passes") * size), "mix-sources")
    numbered = stored(sized.join(sources.drop("rest"), sized["source"].eqNullSafe(sources["source_name"])).drop("source_name"), "mix-numbered")
    unit = max(block_words, 2 * max(1, sources.agg(F.sum("target")).first()[0]) / max_blocks)
    bits = F.least(F.lit(20), F.ceil(F.log2(F.greatest(F.lit(1.0), size / F.lit(float(unit)))))).cast("int")
    cuts = sources.join(_edges(numbered, sources), "src", "left").withColumns({"edge": F.coalesce("edge", F.lit(0).cast("long")), "bits": bits})
    cuts = stored(cuts.select("src", "passes", "bits", (F.lit(HASH_BITS) - F.col("bits")).alias("drop_bits"), "edge"), "mix-cuts")
    kinds = cuts.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    n = F.expr("CASE WHEN pass < passes THEN shiftleft(1L, bits) WHEN edge > 0 THEN shiftright(edge - 1, drop_bits) + 1 ELSE 0L END")
    blocks = kinds.withColumn("n", n).where("n > 0").select("src", "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    dealt = stored(_counted(blocks, "place", F.xxhash64(F.lit(seed), F.lit("deal"), "src", "pass", "block"), "src", "pass", "block"), "mix-blocks")
    total = max(1, dealt.count())
    owned = dealt.select("src", "block", "pass", F.floor(F.col("place") * shards / total).cast("int").alias("shard"))
    return _place(numbered, cuts.select("src", "drop_bits", "edge"), owned)


def order_in_shard(seed: int, *cols):
    """The place of a row in its shard's local shuffle."""
    return F.xxhash64(F.lit(seed), *cols)


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = 7, **how) -> DataFrame:
    """The mix itself: every column of docs once for each copy taken, with mix_shard, mix_copy and mix_order.

    Within a shard the rows' order is that of mix_order, a local shuffle. Where docs has columns of these names, the new ones get a "_" more.
    """
    k_, h_, d_, t_, s_ = (fresh(docs, c) for c in ("mix_key", "mix_hash", "mix_doc", "mix_text", "mix_shards"))
    own = assign(docs, text=text, key=key, seed=seed, **how).groupBy("doc_id", "text_hash").agg(F.first("shards").alias(s_)).withColumnsRenamed({"doc_id": d_, "text_hash": t_})
    rows = docs.withColumns({h_: F.xxhash64(text), k_: F.col(key)})
    hit = rows.join(own, F.col(k_).eqNullSafe(F.col(d_)) & (F.col(h_) == F.col(t_)))
    copy, shard, order = (fresh(docs, c) for c in ("mix_copy", "mix_shard", "mix_order"))
    out = hit.select(*docs.columns, k_, h_, F.posexplode(s_).alias(copy, shard))
    return out.withColumn(order, order_in_shard(seed, k_, h_, copy, shard)).drop(k_, h_)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the drawn blocks take of each document, with the output shards of its copies and their places there."""
    placed = assign(table(spark, sf_dir, "documents"))
    places = F.transform("shards", lambda shard, copy: F.concat_ws(":", shard, order_in_shard(7, F.col("doc_id"), F.col("text_hash"), copy, shard)))
    return placed.select("doc_id", "size", "source_size", "target", F.aggregate("shards", F.lit(0).cast("long"), lambda n, _: n + F.col("size")).alias("taken"), F.size("shards").alias("copies"), F.array_join(places, ",").alias("mix_places"))
