"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host, the number of its pages that contain a line is divided by the number of all its pages; a line whose
ratio is above `ratio` (and which is on at least `min_pages` pages) is boilerplate of that host and is dropped from all of its pages.

Only hashes of lines (128 bits) are shuffled, once for each page and distinct line and pre-aggregated; texts stay
where they are. A host has at most (lines per page) / ratio boilerplate lines, so that they fit beside a page; they are written once, and broadcast while their
counted number is within a bound, else joined by the host. In joins by host a host with more than one part in SHARES of all pages
is dealt to as many parts, to each of which its few rows of the other side are copied, so that no host is one task.

Defined cases: a line that is blank is never boilerplate; a null text has no lines, stays null and still counts as a page of
its host; a null host is a host of its own; a line that repeats within a page counts once; rows with the same doc_id
are separate pages; empty tables give empty results; further columns are kept, but for those named lines_before and
lines_after, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from .common import fresh, stored, table

RATIO = 0.1
MIN_PAGES = 3
#: Most boilerplate lines that are sent to all executors (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: A host has one part for each part in so many of all pages, rounded up.
SHARES = 1000


def lines_of(text):
    return F.split(text, "\n", -1)


def line_hash(line):
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line, F.length(line)).alias("b"))


def _parts(docs: DataFrame, host: str) -> DataFrame:
    """(_host, host_pages, parts) of every host: parts is the number of parts that its rows are dealt to in joins by host."""
    pages = stored(docs.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("host_pages")), "hosts")
    total = pages.agg(F.sum("host_pages")).first()[0] or 1
    return pages.withColumn("parts", F.ceil(F.col("host_pages") * SHARES / total).cast("int"))


def _by_host(rows: DataFrame, host: str, spread, few: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """rows joined with few (_host, ..) by host: rows of a large host are dealt to its parts by spread, its rows of few are copied to each."""
    of = parts.where("parts > 1").select(F.col("_host").alias("_large"), "parts")  # fewer than SHARES hosts
    name, large, n, part, same = (fresh(rows, c) for c in ("of_host", "large_host", "host_parts", "host_part", "same_part"))
    dealt = rows.join(F.broadcast(of.withColumnsRenamed({"_large": large, "parts": n})), F.col(host).eqNullSafe(F.col(large)), "left")
    dealt = dealt.withColumn(part, F.coalesce(F.pmod(spread, F.col(n)), F.lit(0)).cast("int")).drop(large, n)
    copied = few.join(F.broadcast(of), F.col("_host").eqNullSafe(F.col("_large")), "left")
    copied = copied.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("_large", "parts")
    copied = copied.withColumnsRenamed({"_host": name, "_part": same})
    return dealt.join(copied, F.col(host).eqNullSafe(F.col(name)) & (F.col(part) == F.col(same)), how).drop(name, part, same)


def boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, parts: DataFrame | None = None) -> DataFrame:
    """(host, h, pages, host_pages): the boilerplate lines of each host."""
    parts = _parts(docs, host) if parts is None else parts
    d = docs.select(F.col(host).alias("host"), F.col(text).cast("string").alias("text"))
    lines = d.select("host", F.explode(F.array_distinct(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""))).alias("line"))
    counts = lines.select("host", line_hash(F.col("line")).alias("h")).groupBy("host", "h.a", "h.b").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    both = _by_host(counts, "host", F.col("a"), parts.select("_host", "host_pages"), parts, "inner")
    return both.where(F.col("pages") > ratio * F.col("host_pages")).select("host", F.struct("a", "b").alias("h"), "pages", "host_pages")


def drop_lines(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with boilerplate lines dropped from `text`, and the columns lines_before and lines_after."""
    parts = _parts(docs, host)
    found = stored(boilerplate(docs, host=host, text=text, ratio=ratio, min_pages=min_pages, parts=parts), "boilerplate")
    bad_, first_, lines_, kept_ = (fresh(docs, c) for c in ("host_bad", "host_first", "all_lines", "kept_lines"))
    each = found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("h").alias(bad_), F.collect_list("h.a").alias(first_))
    if found.count() <= broadcast_rows:
        name = fresh(docs, "of_host")
        out = docs.join(F.broadcast(each.withColumnRenamed("_host", name)), F.col(host).eqNullSafe(F.col(name)), "left")
    else:  # rows are told apart by all their values that can be hashed
        spread = F.xxhash64(*[F.col(f.name) for f in docs.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)])
        out = _by_host(docs, host, spread, each, parts, "left")
    out = out.withColumn(lines_, lines_of(F.col(text).cast("string")))
    bad = lambda x: F.array_contains(first_, F.xxhash64(x)) & F.array_contains(bad_, line_hash(x))
    out = out.withColumn(kept_, F.when(F.col(bad_).isNull(), F.col(lines_)).otherwise(F.filter(lines_, lambda x: (F.trim(x) == "") | ~bad(x))))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    given = [c for c in docs.columns if c.lower() not in ("lines_before", "lines_after")]
    return out.select(*[F.array_join(kept_, "\n").alias(c) if c == text else F.col(c) for c in given], size(lines_).alias("lines_before"), size(kept_).alias("lines_after"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_before", "lines_after", F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT DISTINCT r, source, l FROM (SELECT r, source, unnest(ls) AS l FROM d) WHERE trim(l, ' ') <> ''),
c AS (SELECT source, l, count(*) AS n FROM u GROUP BY source, l),
t AS (SELECT source, count(*) AS m FROM d GROUP BY source),
bad AS (SELECT c.source AS source, l FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > 0.1::DOUBLE * m),
x AS (SELECT r, doc_id, source, text, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS p FROM d),
k AS (SELECT x.r, x.p, x.l FROM x WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.l = x.l AND bad.source IS NOT DISTINCT FROM x.source)),
g AS (SELECT r, count(*) AS n, string_agg(l, chr(10) ORDER BY p) AS kept FROM k GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS lines_before, CAST(coalesce(n, 0) AS BIGINT) AS lines_after,
  CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS text_sha256
FROM d LEFT JOIN g USING (r)
"""
