"""Benchmark decontamination with DataFrame functions only.

The windows of ten consecutive words of the benchmark items are hashed; every window of every document is looked up in
that set (broadcast while its counted size is within a bound, else joined by shuffle); a hit counts only if the words themselves
are equal. Hit documents, or just the hit words, can be removed.

A text is normalised once: A-Z in lower case, one space between words. Windows are not looked up one by one: if the shortest
window has m words, every window holds a whole block of b = (m + 1) // 2 words that begins at a multiple of b. Each block
is looked up in the set of all runs of b words of the benchmark; around a block that is found, the windows that
hold it are looked up and compared. So every row that leaves the scan is a hit or the one row that stands for its document, the cost is
linear in a document's length, and the scan stays within generated code: it has no lambdas.

Words: A-Z lower-cased, then runs of characters other than ASCII non-alphanumerics. An item with fewer words than a
window, but not none, is one window.

Defined cases: null text has no words; an item or document without words hits nothing; items that are equal each
count; rows equal in doc_id and text get equal results, a row for each of them, rows with the same doc_id and different texts are
separate; empty tables give empty (or all-clean) results; a null doc_id is a value like any other; further columns, whatever their
names, are kept by decontaminate().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, stored, table

#: The characters of words after A-Z are lower-cased, and those between words.
INSIDE, OUTSIDE = r"[0-9a-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WIDTH = 10
#: Most windows that are sent to all executors, and most bytes of their words and items.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 256 << 20


def normal(text):
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), OUTSIDE + "+", " "))


def number_of_words(norm):
    return F.when(norm == "", 0).otherwise(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def contexts_of(norm, block: int, longest: int):
    """For each aligned block of words, in order: the block - 1 words before it, the block, and what the longest window adds.

    Before the first word stand block - 1 dashes, which are no words.
    """
    word = "[^ ]++"
    padded = F.concat(F.lit("- " * (block - 1)), norm)
    some = F.regexp_extract_all(padded, F.lit(rf"(?=({word}(?: {word}){{0,{block + longest - 2}}}))(?:{word} ?+){{1,{block}}}"), F.lit(1))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(some)


def windows_of(norm, width: int):
    """The windows of a normal text in order, as text."""
    return F.regexp_extract_all(norm, F.lit(rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{width - 1}}}))[^ ]++ ?+"), F.lit(1))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id") -> DataFrame:
    """(len, gram, items): each distinct window with the sorted ids of the items that have it."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), normal(F.col(text)).alias("norm")).where("norm <> ''").withColumn("n", number_of_words(F.col("norm")))
    whole = b.where(F.col("n") < width).select("item", F.col("n").cast("int").alias("len"), F.col("norm").alias("gram"))
    cut = b.where(F.col("n") >= width).select("item", F.lit(width).alias("len"), F.explode(windows_of(F.col("norm"), width)).alias("gram"))
    return cut.union(whole).groupBy("len", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(docs: DataFrame, benchmark: DataFrame, width: int, text: str, key: str, item: str, broadcast_rows: int, all_rows: bool) -> DataFrame:
    """(doc_id, text_hash, n_words, first, span, items): a row for each hit and, with all_rows, one for each row of docs (first)."""
    grams = stored(benchmark_windows(benchmark, width, item=item), "benchmark-windows")
    size = F.octet_length("gram") + F.octet_length(F.array_join("items", ",")) + 64
    sizes = {r["len"]: r for r in grams.groupBy("len").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()}  # at most `width` rows
    small = sum(r["n"] for r in sizes.values()) <= broadcast_rows and sum(r["bytes"] for r in sizes.values()) <= BROADCAST_BYTES
    send = F.broadcast if small else lambda df: df
    lens = sorted(sizes) or [width]
    block = (lens[0] + 1) // 2
    hashed = grams.select(F.xxhash64("len", "gram").alias("h"), F.col("gram").alias("words"), "items")
    blocks = grams.select(F.explode(windows_of(F.col("gram"), block)).alias("block")).select(F.xxhash64("block").alias("b")).distinct()
    # explode(array(..)) keeps the optimizer from computing what is inside once for every row that comes of it
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(F.array(normal(F.col(text)))).alias("norm"))
    d = d.select("doc_id", "text_hash", F.explode(F.array(F.struct(number_of_words(F.col("norm")).alias("n"), contexts_of(F.col("norm"), block, lens[-1]).alias("around")))).alias("x"))
    d = d.select("doc_id", "text_hash", F.col("x.n").alias("n_words"), F.posexplode_outer("x.around").alias("j", "around"))
    middle = F.substring_index(F.substring_index("around", " ", 2 * block - 1), " ", -block)
    d = d.join(send(blocks), F.xxhash64(middle) == F.col("b"), "left" if all_rows else "inner")
    start = F.coalesce(F.col("j"), F.lit(0)) == 0
    d = d.where(start | F.col("b").isNotNull())
    each = F.array(*[F.struct(F.lit(n).alias("len"), F.lit(n == lens[0]).alias("one"), windows_of(F.when(F.col("b").isNotNull(), F.col("around")), n).alias("w")) for n in lens])
    d = d.select("doc_id", "text_hash", "n_words", "j", start.alias("start"), F.explode(each).alias("y"))
    d = d.select("doc_id", "text_hash", "n_words", "j", (F.col("start") & F.col("y.one")).alias("start"), F.col("y.len").alias("len"), F.posexplode_outer("y.w").alias("q", "gram"))
    at = F.coalesce(F.col("q"), F.lit(0))
    found = d.where(at < block).join(send(hashed), (F.xxhash64("len", "gram") == F.col("h")) & (F.col("gram") == F.col("words")), "left" if all_rows else "inner")
    span = F.when(F.col("h").isNotNull(), F.struct((F.col("j") * block - block + F.col("q") + 2).alias("pos"), F.col("len").alias("len")))
    found = found.select("doc_id", "text_hash", "n_words", (F.col("start") & (at == 0)).alias("first"), span.alias("span"), "items")
    return found.where("first OR span IS NOT NULL")


def find_hits(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, text: str = "text", key: str = "doc_id", item: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, spans) of the documents with hits; spans: sorted (pos, len) of the hit windows, pos from 1."""
    found = _scan(docs, benchmark, width, text, key, item, broadcast_rows, False)
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def covered(spans):
    """How many positions the sorted spans (pos, len) cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a, s):
        end = s["pos"] + s["len"] - 1
        new = F.greatest(F.lit(0), end - F.greatest(a["end"] + 1, s["pos"]) + 1)
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + new).alias("n"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, text: str = "text", key: str = "doc_id", item: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each row of docs: n_words, n_hit, items (array), contaminated."""
    found = _scan(docs, benchmark, width, text, key, item, broadcast_rows, True)
    g = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count_if("first").alias("rows"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    g = g.select("doc_id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), "items", (F.size("spans") > 0).alias("contaminated"), "rows")
    return g.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """docs without the hit documents, or (remove="spans") without the hit words and what follows them up to the next word."""
    d_, t_, s_, p_, f_ = (fresh(docs, c) for c in ("hit_id", "hit_hash", "hit_spans", "parts", "begins"))
    found = _scan(docs, benchmark, how.pop("width", WIDTH), text, key, how.pop("item", "item_id"), broadcast_rows, False) if remove == "documents" else find_hits(docs, benchmark, text=text, key=key, broadcast_rows=broadcast_rows, **how)
    found = found.select("doc_id", "text_hash").distinct() if remove == "documents" else found
    hits = stored(found.withColumnsRenamed({"doc_id": d_, "text_hash": t_, "spans": s_}), "contaminated")
    rows = hits.agg(F.count("*").alias("n"), (F.sum(F.size(s_)) if remove == "spans" else F.count("*")).alias("spans")).first()
    small = rows["n"] + (rows["spans"] or 0) <= broadcast_rows
    hits = F.broadcast(hits) if small else hits
    same = F.col(key).eqNullSafe(F.col(d_)) & (F.xxhash64(docs[text]) == F.col(t_))
    if remove == "documents":
        return docs.join(hits, same, "left_anti")
    # words and the rest of the text alternate, so that a piece's place gives its word's number
    inside, outside = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    parts = F.regexp_extract_all(F.col(text), F.lit(f"{inside}+|{outside}+"), F.lit(0))
    first = F.when(F.substring(F.col(text), 1, 1).rlike(outside), 0).otherwise(1)  # 1: the text begins with a word
    number = lambda i: F.floor((i + 1 + F.col(f_)) / 2)
    kept = F.filter(p_, lambda p, i: ~F.exists(s_, lambda s: (number(i) >= s["pos"]) & (number(i) < s["pos"] + s["len"])))
    out = docs.join(hits, same, "left").withColumns({p_: parts, f_: first})
    return out.withColumn(text, F.when(F.col(s_).isNull(), F.col(text)).otherwise(F.array_join(kept, ""))).select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, p, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
