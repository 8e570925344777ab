"""MinHash near-duplicates: universal hash minima, banding, verification, large-star/small-star components.

1. A document's set of k-word shingles becomes a 128-bit fingerprint and `bands * rows` minima of universal hashes.
   Documents with equal sets form a class; only one representative, its least doc_id, goes on.
2. Each band of minima is a bucket. First every representative is compared with the hub (the least member) of the
   bucket set that it shares most often; verified links join components, which empties the large groups of copies.
3. Buckets that still hold more than one component are compared within, between components only, in blocks of
   bounded size: the members of the largest component of a bucket meet only those of the others, so that a few strangers
   in a very large group cost one pass over it. A pair is looked at in the first band that it shares, its minima must agree often enough (five
   standard errors below the threshold), and it is confirmed on the full sets, which each member brings to its block. So no link that a band shows is lost, and no
   group is expanded into all its pairs.

With 32 bands of 5 rows a pair of similarity 0.85 shares no band with probability 7e-9 (0.8: 3e-6).

Defined cases: null or empty text, and text of white space, has the empty set and is linked with nothing; shorter
texts have one shingle, the whole sequence; rows with the same doc_id are one document and are linked; rows with a
null doc_id take no part (component null, kept); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mix64, pieces, returning, split_words, stored, table, whole_groups, word_codes
from .components import components

BANDS, ROWS = 32, 5
#: Most members of a block, and about the most shingles of all of them.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Most ids that are sent to all executors (8 bytes each).
BROADCAST_IDS = 2_000_000
_POSITION = np.random.default_rng(11).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    ends, words = split_words(texts)
    codes, distinct = word_codes(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes] if len(distinct) else np.zeros(0, np.uint64)
    n = len(h)
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            s += h[j : n - k + 1 + j] * _POSITION[j] if n >= k else s
        s = mix64(s + np.uint64(k))
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            elif b > a:
                out.append(mix64(np.array([(h[a:b] * _POSITION[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        self.room = np.empty((512, size), np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        """The upper halves of the least values of a * x + b (mod 2**64)."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), len(self.room)):
            part = s[i : i + len(self.room)]
            room = self.room[: len(part)]
            np.multiply(part[:, None], self.a[None, :], out=room)
            np.add(room, self.b[None, :], out=room)
            np.minimum(least, room.min(axis=0), out=least)
        return (least >> np.uint64(32)).astype("<u4")


def sketch(docs: DataFrame, k: int, bands: int, rows: int, text: str, key: str) -> DataFrame:
    def run(batches):
        mh = MinHash(bands * rows)
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column("text"), k)
                marks = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                to = lambda shift: pa.array(np.array([m >> shift & (1 << 64) - 1 for m in marks], np.uint64).view(np.int64))
                sig = pa.array([mh.minima(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), to(0), to(64), sig], ["doc_id", "n", "h1", "h2", "sig"])

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(returning(run), "doc_id long, n long, h1 long, h2 long, sig binary")


def _alike(pairs: DataFrame, sigs: DataFrame, low: float) -> DataFrame:
    """Pairs (u, v) of documents whose classes' (hu, hv) minima agree in at least the share low."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(b.num_rows, -1) for c in ("su", "sv"))
                keep = pa.array((x == y).mean(axis=1) >= low)
                yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])

    s = sigs.select("rep", "h1", "sig")
    both = pairs.join(s.withColumnsRenamed({"rep": "u", "h1": "hu", "sig": "su"}), ["u", "hu"]).join(s.withColumnsRenamed({"rep": "v", "h1": "hv", "sig": "sv"}), ["v", "hv"])
    return both.select("u", "v", "su", "sv").mapInArrow(returning(run), "u long, v long")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, above, text: str, key: str) -> DataFrame:
    """Pairs (u, v) whose full shingle sets have a similarity of at least the fraction above."""
    num, den = above

    def run(batches):
        kept: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            for piece in pieces(b, "tu"):
                left = shingle_sets(piece.column("tu"), k)
                vs, tv = piece.column("v").to_pylist(), piece.column("tv")
                marks = [xxhash.xxh3_64_intdigest(t or "") for t in tv.to_pylist()]
                new = {}
                for i, m in enumerate(zip(vs, marks, strict=True)):
                    if m not in kept and m not in new:
                        new[m] = i
                if len(kept) > 256:
                    kept = {m: kept[m] for m in set(zip(vs, marks, strict=True)) if m in kept}
                if new:
                    kept.update(zip(new, shingle_sets(tv.take(pa.array(list(new.values()))), k), strict=True))
                good = []
                for s, m in zip(left, zip(vs, marks, strict=True), strict=True):
                    t = kept[m]
                    same = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(same > 0 and den * same >= num * (len(s) + len(t) - same))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column("u").filter(keep), piece.column("v").filter(keep)], ["u", "v"])

    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    t = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")
    both = pairs.join(t.withColumnsRenamed({"id": "u", "text": "tu"}), "u").join(t.withColumnsRenamed({"id": "v", "text": "tv"}), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(returning(run), "u long, v long")


def _cross(members: DataFrame, bands: int, low: float) -> DataFrame:
    """The pairs of different components within each bucket whose minima agree often enough, each pair once.

    members: band_key, band, rep, label, sig, n. A bucket's largest component is its main one; the others' members are dealt to blocks
    0, 1, .. and its own to blocks -1, -2, ..; a task is a pair of blocks (i, j) that are not both of the main component.
    A row is a member (of a bucket and pair of blocks) that is in such a pair, with its partners of higher place, so
    that there are never more rows than members.
    """
    parts = members.groupBy("band_key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("band_key")
    parts = parts.agg(F.max(F.struct("c", "label", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    parts = parts.select("band_key", F.col("main.label").alias("main"), blocks(F.col("main.c"), F.col("main.s")).alias("big"), blocks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("few"))
    m = members.join(parts, "band_key")
    mine = F.col("label") == F.col("main")
    at = F.pmod(F.xxhash64("rep"), F.when(mine, F.col("big")).otherwise(F.col("few"))).cast("int")
    m = m.withColumn("blk", F.when(mine, -1 - at).otherwise(at))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    few, big = F.sequence(F.lit(0), F.col("few") - 1), F.sequence(F.lit(1), F.col("big"))
    tasks = F.when(mine, F.transform(few, lambda o: pair(o, F.col("blk")))).otherwise(F.concat(F.transform(few, lambda o: pair(F.least("blk", o), F.greatest("blk", o))), F.transform(big, lambda o: pair(F.col("blk"), -o))))
    m = m.withColumn("task", F.explode(tasks)).select("band_key", "task.i", "task.j", "blk", "band", "rep", "label", "sig")

    def run(batches):
        for t, cuts in whole_groups(batches, ["band_key", "i", "j"]):
            rep, label, band, blk = (t.column(c).to_numpy() for c in ("rep", "label", "band", "blk"))
            i_, j_, keys = (t.column(c).to_numpy() for c in ("i", "j", "band_key"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(t.num_rows, -1)
            out: dict[str, list] = {c: [] for c in ("band_key", "i", "j", "rep", "partners")}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                split, pairs = i_[a] != j_[a], {}
                right = np.arange(a, b)[blk[a:b] == j_[a]] if split else np.arange(a, b)
                for x in np.arange(a, b)[blk[a:b] == i_[a]].tolist() if split else range(a, b - 1):
                    y = right if split else right[right > x]
                    y = y[label[y] != label[x]]
                    if not len(y):
                        continue
                    eq = sig[y] == sig[x]
                    near = eq.mean(axis=1) >= low
                    if near.any():
                        y, eq = y[near], eq[near]
                        first = eq.reshape(len(y), bands, -1).all(axis=2).argmax(axis=1)
                        y = rep[y[first == band[x]]].tolist()
                        if y:
                            pairs.setdefault(int(rep[x]), []).extend(y)
                alone = {v for y in pairs.values() for v in y}.difference(pairs)
                for r, y in [*pairs.items(), *((v, []) for v in sorted(alone))]:
                    for c, v in zip(out, (keys[a], i_[a], j_[a], r, y), strict=True):
                        out[c].append(v)
            if out["rep"]:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return m.repartition("band_key", "i", "j").sortWithinPartitions("band_key", "i", "j").mapInArrow(returning(run), "band_key long, i int, j int, rep long, partners array<long>")


def _confirm_groups(tests: DataFrame, docs: DataFrame, k: int, above, text: str, key: str) -> DataFrame:
    """The links (u, v) among the pairs that _cross() found. Each member brings its text to its block once; pairs are never rows."""
    num, den = above

    def run(batches):
        for t, cuts in whole_groups(batches, ["band_key", "i", "j"]):
            us, vs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = t.slice(a, b - a)
                sets: dict[int, list] = {}
                for r, s in zip(part.column("rep").to_pylist(), shingle_sets(part.column("text").combine_chunks(), k), strict=True):
                    sets.setdefault(r, []).append(s)
                for u, partners in zip(part.column("rep").to_pylist(), part.column("partners").to_pylist(), strict=True):
                    for v in partners:
                        if any(_linked(x, y, num, den) for x in sets[u] for y in sets.get(v, ())):
                            us.append(u)
                            vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    ids = tests.select(F.col("rep").alias("id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")
    rows = tests.join(d, tests["rep"] == d["id"]).select("band_key", "i", "j", "rep", "partners", "text")
    return rows.repartition("band_key", "i", "j").sortWithinPartitions("band_key", "i", "j").mapInArrow(returning(run), "u long, v long")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    short, long_ = (x, y) if len(x) <= len(y) else (y, x)
    if not len(short) or den * len(short) < num * len(long_):
        return False
    at = np.searchsorted(long_, short)
    same = int((long_[np.minimum(at, len(long_) - 1)] == short).sum())
    return den * same >= num * (len(x) + len(y) - same)


def near_duplicates(docs: DataFrame, *, k: int = 5, above: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; links have intersection / union >= above."""
    share = above[0] / above[1]
    low = share - 5 * math.sqrt(share * (1 - share) / (bands * rows))
    all_ = stored(sketch(docs, k, bands, rows, text, key), "sketches")
    known = all_.where("n > 0 AND doc_id IS NOT NULL")
    reps = stored(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    sigs = reps.select("rep", "h1", "sig")  # a doc_id that occurs with several texts may be the least of several classes
    width = 4 * rows
    spread = lambda df, *c: df.select("rep", *c, F.posexplode(F.expr(f"transform(sequence(0, {bands - 1}), j -> xxhash64(j, substring(sig, {width} * j + 1, {width})))")).alias("band", "band_key"))
    # rows of one doc_id are one document
    own = known.join(reps.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("doc_id", "rep")
    twice = own.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v <> w").select("doc_id")
    same = own.join(twice, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    # each representative with the hub that it meets most often
    cells = spread(reps, "h1").select("rep", "h1", "band_key")
    hubs = cells.groupBy("band_key").agg(F.min(F.struct("rep", "h1")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    meet = cells.join(hubs, "band_key").where("rep <> hub.rep").groupBy("rep", "h1", "hub").agg(F.count("*").alias("c"))
    best = meet.groupBy("rep", "h1").agg(F.max(F.struct("c", (-F.col("hub.rep")).alias("h"), F.col("hub.h1").alias("g"))).alias("m")).select(F.col("rep").alias("u"), F.col("h1").alias("hu"), (-F.col("m.h")).alias("v"), F.col("m.g").alias("hv"))
    first = stored(_alike(best, sigs, low), "pairs")
    links = stored(_confirm(first, docs, k, above, text, key).union(same), "links")
    labels = components(links)
    # what is left: buckets with several components
    named = reps.join(labels, reps["rep"] == labels["node"], "left").select("rep", "h1", F.coalesce("label", "rep").alias("label"), "n", "sig")
    cells = spread(named, "h1", "label", "n").select("rep", "h1", "label", "n", "band", "band_key")
    mixed = cells.groupBy("band_key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band_key")
    members = stored(cells.join(mixed, "band_key").join(sigs, ["rep", "h1"]), "members")
    rest = stored(_cross(members, bands, low), "pairs")
    more = stored(_confirm_groups(rest, docs, k, above, text, key), "links")
    if more.count():
        labels = components(links.union(more))
    discard(first, members, rest, links, more)
    final = reps.join(labels, reps["rep"] == labels["node"], "left").select("h1", "h2", F.col("n").alias("m"), F.coalesce("label", "rep").alias("c"))
    a = all_.select("doc_id", "n", "h1", "h2")
    out = a.join(final.withColumnsRenamed({"h1": "g1", "h2": "g2"}), (a["h1"] == F.col("g1")) & (a["h2"] == F.col("g2")) & (a["n"] == F.col("m")) & a["doc_id"].isNotNull(), "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, above=(85, 100))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the least doc_id; repeated rows of it once."""
    found = stored(near_duplicates(docs, **how).groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("c")), "near-duplicates")
    gone = found.where(~F.col("kept")).select("doc_id")
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    again = found.where("c > 1 AND kept AND doc_id IS NOT NULL").select("doc_id")
    if again.count():
        many = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = out.join(again, "doc_id", "left_anti").unionByName(many)
    return out.select(*docs.columns)
