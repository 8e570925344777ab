"""What the operators of this package share: shared folders, tables written once, words as Arrow arrays."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
BATCH_BYTES = 8 << 20
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_local: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    # texts can be long: what goes to a Python worker at once is bounded by bytes, not by rows alone
    if spark.conf.get(ARROW_BYTES, None) == ARROW_DEFAULT:  # a value that the user chose stays
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    importable(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local:
        _local[key] = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
    return _local[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what stored() wrote; the frames cannot be read afterwards."""
    for df in frames:
        path = getattr(df, "_chronoloom_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-case A-Z only; for texts of ASCII characters alone that is lower(), which is faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def excerpt(text, most: int, parts: int = 16):
    """The text, or of a longer one `parts` passages from evenly spread places, its begin and end among them, `most` characters in all."""
    width, n = most // parts, F.length(text)
    passage = lambda i: F.substr(text, (F.floor((n - width) * i / (parts - 1)) + 1).cast("int"), F.lit(width))
    return F.when(n > most, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), passage), " ")).otherwise(text)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = BATCH_BYTES):
    """Slices of a batch with about `limit` bytes of text each; a row is never cut."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(col if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.cast(pa.string())), 0)
    part = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def returning(run):
    """run, a function of batches, after which a worker gives its free memory back: idle workers stay beside the next stage."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Maximal runs without the six ASCII white-space characters, A-Z in lower case; null counts as empty.

    Returns offsets (len(texts) + 1) and all words in order.
    """
    texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower reads a slice's values from a wrong place
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not some.all():  # white space at an end makes an empty word
        upto = np.concatenate([[0], np.cumsum(some)])
        words, ends = words.filter(pa.array(some)), upto[ends]
    return ends, words


def word_codes(words: pa.Array) -> tuple[np.ndarray, list]:
    """Each word as an index into the list of the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], .., starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_groups(batches, keys: list[str]):
    """From batches sorted by keys, tables that hold whole groups only, with the first row of each group and the end."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        rest = new if rest is None else pa.concat_tables([rest, new])
        change = np.zeros(rest.num_rows - 1, bool)
        for k in keys:
            v = rest.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        at = np.flatnonzero(change) + 1
        if len(at):
            last = int(at[-1])
            yield rest.slice(0, last).combine_chunks(), np.concatenate([[0], at])
            rest = rest.slice(last)
    if rest is not None:
        change = np.zeros(rest.num_rows - 1, bool)
        for k in keys:
            v = rest.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        yield rest.combine_chunks(), np.concatenate([[0], np.flatnonzero(change) + 1, [rest.num_rows]])
