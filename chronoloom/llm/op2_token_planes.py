"""Token ids in binary files: bit-plane shuffling.

Fixed-size blocks of ids are transposed into byte (or bit) planes; each plane is compressed with zstandard;
a footer holds an index of the blocks. A file keeps the rows of one range of doc_id in ascending order.

File layout: magic, the compressed planes of all blocks, a JSON footer (zstandard), its length (8 bytes), magic.
Each block has one entry in the footer's index: offset in the file, number of ids, length of each plane. Document
ids and document lengths are stored the same way, as blocks of unsigned 64-bit values.

Defined cases: null or empty text gives the end id alone; rows with the same doc_id stand in the order of a hash of
their texts; rows with a null doc_id come first; no rows give no file and an empty result; further columns are
ignored. A task writes to a name of its own and only names in the committed manifest are read, so that lost
executors and repeated tasks leave no trace in the result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, new_path, pieces, ragged, returning, split_words, stored, table, word_codes

MAGIC = b"CLPLANE1"
BLOCK = 1 << 16
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# ---------------------------------------------------------------- planes


def to_planes(values: np.ndarray, width: int, kind: str = "byte", level: int = 3) -> list[bytes]:
    """The planes of one block; width: bytes of a value. Plane 0 holds the lowest bytes (or bits)."""
    rows = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(len(values), width)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, bitorder="little").T
    else:
        planes = rows.T
    z = zstandard.ZstdCompressor(level=level)
    return [z.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, width: int, kind: str = "byte") -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(z.decompress(p), dtype=np.uint8) for p in planes]
    if kind == "bit":
        bits = np.unpackbits(np.stack(raw), axis=1, count=n, bitorder="little").T
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.stack(raw, axis=1) if n else np.zeros((0, width), np.uint8)
    return np.ascontiguousarray(rows).view(f"<u{width}").ravel()


class Writer:
    """Writes one file; ids come in any portions and are cut into blocks."""

    def __init__(self, out, block: int = BLOCK, kind: str = "byte", level: int = 3):
        self.out, self.block, self.kind, self.level = out, block, kind, level
        self.at = out.write(MAGIC)
        self.index: dict[str, list] = {"ids": [], "docs": [], "lengths": []}
        self.rest: dict[str, list[np.ndarray]] = {k: [] for k in self.index}
        self.width = {"ids": 4, "docs": 8, "lengths": 8}

    def add(self, what: str, values: np.ndarray, last: bool = False) -> None:
        rest = self.rest[what]
        rest.append(values)
        if not last and sum(map(len, rest)) < self.block:
            return
        values = np.concatenate(rest)
        cut = len(values) if last else len(values) // self.block * self.block
        for a in range(0, cut, self.block):
            part = values[a : min(a + self.block, cut)]
            planes = to_planes(part, self.width[what], self.kind, self.level)
            self.index[what].append([self.at, len(part), [len(p) for p in planes]])
            for p in planes:
                self.at += self.out.write(p)
        self.rest[what] = [values[cut:]]

    def close(self, **more) -> None:
        for what in self.index:
            self.add(what, np.zeros(0, np.uint64), last=True)
        foot = zstandard.compress(json.dumps({"index": self.index, "kind": self.kind, "width": self.width, **more}).encode())
        self.out.write(foot)
        self.out.write(len(foot).to_bytes(8, "little"))
        self.out.write(MAGIC)


class Reader:
    """Reads one file; any block can be read alone by its entry in the index."""

    def __init__(self, src):
        self.src = src
        size = src.size()
        tail = src.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole file of token planes")
        n = int.from_bytes(tail[:8], "little")
        self.foot = json.loads(zstandard.decompress(src.read_at(n, size - 16 - n)))

    def blocks(self, what: str):
        width, kind = self.foot["width"][what], self.foot["kind"]
        for at, n, sizes in self.foot["index"][what]:
            raw = self.src.read_at(sum(sizes), at)
            cuts = np.cumsum([0, *sizes])
            yield from_planes([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], n, width, kind)


# ---------------------------------------------------------------- encoding

_PUNCTUATION = "!$%&*,.#|?;:"


class Encoder:
    """Encodes with the tokenizers library, each distinct core of a word once.

    The vocabulary drops white space, and no rule of it reaches over white space, so a text's ids are those of its
    words. A word of letters that ends in punctuation is the letters and the punctuation, as the pattern has it.
    A text that holds a special token's start is encoded as a whole.
    """

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, parts: list[str]) -> None:
        for a in range(0, len(parts), 2000):
            some = parts[a : a + 2000]
            made = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(made.ids, np.uint32), np.array(made.word_ids, np.int64)
            cuts = np.searchsorted(of, np.arange(len(some) + 1))
            self.known.update((p, ids[x:y].tobytes()) for p, x, y in zip(some, cuts[:-1], cuts[1:], strict=True))

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes."""
        cut = []
        for w in words:
            core = w.rstrip(_PUNCTUATION)
            plain = core.isalpha() and (core.isascii() or (is_normalized("NFC", core) and core.lower().isalpha()))
            cut.append((core, w[len(core) :]) if plain else (w, ""))
        parts = {p for pair in cut for p in pair}
        if len(self.known) + len(new := parts - self.known.keys()) > self.most:
            self.known.clear()
            new = parts
        self.learn(sorted(new))
        known = self.known
        return [known[a] + known[b] if b else known[a] for a, b in cut]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text and all ids."""
        ends, words = split_words(texts)
        codes, distinct = word_codes(words)
        made = self.words(distinct)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat = np.frombuffer(b"".join(made), np.uint32)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ids = flat[ragged(starts[codes], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])[ends]
        counts = np.diff(upto)
        special = [i for i, w in enumerate(distinct) if "<|" in w]
        if special:
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(codes, special)), side="right") - 1)
            lists = np.split(ids, upto[1:-1])
            for i in odd.tolist():
                lists[i] = np.array(self.whole(texts[i].as_py()), np.uint32)
            counts, ids = np.array([len(x) for x in lists], np.int64), np.concatenate(lists)
        return counts, ids


#: Words whose ids a worker remembers.
KNOWN = 400_000
_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = KNOWN) -> Encoder:
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


# ---------------------------------------------------------------- the operator

MANIFEST = "part int, path string, n_docs long, n_ids long"
DIGEST = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"


def write_token_planes(docs: DataFrame, tokenizer: str, folder: str | None = None, *, text: str = "text", key: str = "doc_id", end_id: int = END_ID, block: int = BLOCK, kind: str = "byte", level: int = 3, piece_bytes: int = BATCH_BYTES, known: int = KNOWN) -> DataFrame:
    """Encode docs and write their ids as files in `folder` (default: a new one in the shared folder).

    piece_bytes of text are encoded at once and the ids of `known` words remembered: less of both takes less memory and more time.
    Returns the manifest: part, path, n_docs, n_ids of each file, in ascending order of the key by part.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-planes")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def write(batches):
        from pyspark import TaskContext

        part, writer, out, path, n_docs, n_ids = TaskContext.get().partitionId(), None, None, "", 0, 0
        enc = encoder(tokenizer, known)
        for batch in batches:
            for piece in pieces(batch, limit=piece_bytes):
                if writer is None:
                    files, at = pafs.FileSystem.from_uri(folder)
                    files.create_dir(at)
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.planes"
                    out = files.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}")
                    writer = Writer(out, block, kind, level)
                counts, ids = enc.texts(piece.column("text"))
                ends = np.cumsum(counts + 1)
                with_end = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(with_end), bool)
                keep[ends - 1] = False
                with_end[keep] = ids
                docs_ = piece.column("doc_id")
                writer.add("ids", with_end)
                writer.add("docs", np.asarray(docs_.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
                writer.add("lengths", (counts + 1).astype(np.uint64))
                n_docs, n_ids = n_docs + piece.num_rows, n_ids + len(with_end)
        if writer is not None:
            writer.close(tokenizer=os.path.basename(tokenizer), end_id=end_id)
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return stored(rows.mapInArrow(returning(write), MANIFEST), "token-manifest")


def read_documents(path: str):
    """Yield (doc_ids, lengths, ids) portions of a file; ids are uint32, doc_id null is the least integer."""
    files, at = pafs.FileSystem.from_uri(path)
    with files.open_input_file(at) as src:
        r = Reader(src)
        doc_blocks, length_blocks, ids = r.blocks("docs"), r.blocks("lengths"), r.blocks("ids")
        rest = np.zeros(0, np.uint32)
        for d, n in zip(doc_blocks, length_blocks, strict=True):
            n = n.astype(np.int64)
            done = 0
            while done < len(n):
                stop = done + int(np.searchsorted(np.cumsum(n[done:]), max(BLOCK * 16, int(n[done])), side="right"))
                need = int(n[done:stop].sum())
                have, size = [rest], len(rest)
                while size < need:
                    have.append(next(ids))
                    size += len(have[-1])
                flat = np.concatenate(have)
                yield d[done:stop].view(np.int64), n[done:stop], flat[:need]
                rest, done = flat[need:], stop


def read_digest(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest: doc_id, start, n_tokens, ids_crc32 of every document, from the stored ids."""
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("file_start"))  # a row for each file
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                at = 0
                for ids_of, lengths, ids in read_documents(path):
                    raw = ids.astype("<u4").tobytes()
                    ends = np.cumsum(lengths)
                    begin = ends - lengths
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                    doc = pa.array(ids_of, pa.int64(), mask=ids_of == -(1 << 63))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lengths), part, np.int32)), doc, pa.array(begin + at), pa.array(lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])
                    at += int(ends[-1])

    rows = manifest.select("part", "path").repartition(n, "part").mapInArrow(returning(read), DIGEST)
    return rows.join(starts, "part").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digest(write_token_planes(table(spark, sf_dir, "documents"), default_tokenizer()))
