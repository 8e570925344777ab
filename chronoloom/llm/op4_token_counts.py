"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

build() cuts a text into pre-tokens and counts the tokens of each; update() applies edits to that state. An edit
re-encodes only from the last pre-token that ends CONTEXT characters or more before it up to the first old boundary
behind it that the new pre-tokens meet again; the leaves in between are replaced and the sums of their
ancestors corrected. The pattern looks at most CONTEXT - 1 characters beyond a pre-token and never back, so
the counts are those of encoding the whole new text.

Defined cases: null text is the empty text with 0 tokens; edits beyond the end append, a deletion stops at the end, negative
numbers count as 0; null or no edits leave the counts as they are; edits of a document apply in their order; rows with the
same doc_id are separate; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

VOCABULARY = "byte_bpe_50k.tiktoken"
CONTEXT = 4
LEAF = 64
EDITS = "array<struct<start:bigint,remove:bigint,insert:string>>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Counter:
    """Counts the tokens of pre-tokens, each distinct one once."""

    def __init__(self, path: str, most: int = 400_000):
        import public_tokenizers
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.most, self.known = regex.compile(public_tokenizers.PATTERN), most, {}

    def count(self, parts: list[str]) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for p in set(parts).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in parts]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class Tree:
    """Leaves are runs of about LEAF pre-tokens; inner nodes hold the sums of characters and tokens below them."""

    def __init__(self, sizes: list[int], tokens: list[int]):
        self.sizes = [sizes[i : i + LEAF] for i in range(0, len(sizes), LEAF)] or [[]]
        self.tokens = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.width = 1 << (len(self.sizes) - 1).bit_length()
        self.chars, self.sums = [0] * 2 * self.width, [0] * 2 * self.width
        for i, (s, t) in enumerate(zip(self.sizes, self.tokens, strict=True)):
            self.chars[self.width + i], self.sums[self.width + i] = sum(s), sum(t)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place within it and first character of the last pre-token that ends at or before `at`, plus one."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if start + self.chars[node] < at:
                start += self.chars[node]
                node += 1
        leaf = min(node - self.width, len(self.sizes) - 1)
        if leaf != node - self.width:
            start = sum(self.chars[self.width + i] for i in range(leaf))
        k = 0
        for size in self.sizes[leaf]:
            if start + size > at:
                break
            start, k = start + size, k + 1
        return leaf, k, start

    def replace(self, leaf: int, k: int, old: int, sizes: list[int], tokens: list[int]) -> None:
        """Put new pre-tokens in the place of `old` ones from place k of a leaf on."""
        first = True
        while first or old > 0:
            here = min(old, len(self.sizes[leaf]) - k)
            self.sizes[leaf][k : k + here] = sizes if first else []
            self.tokens[leaf][k : k + here] = tokens if first else []
            node = self.width + leaf
            self.chars[node], self.sums[node] = sum(self.sizes[leaf]), sum(self.tokens[leaf])
            while node > 1:
                node //= 2
                self.chars[node], self.sums[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.sums[2 * node] + self.sums[2 * node + 1]
            old, leaf, k, first = old - here, leaf + 1, 0, False

    def edit(self, text: str, start: int, remove: int, insert: str, c: Counter) -> tuple[str, int]:
        """The new text, and how many pre-tokens were encoded."""
        start = min(max(0, start), len(text))
        stop = min(len(text), start + max(0, remove))
        new = text[:start] + insert + text[stop:]
        shift, safe = len(new) - len(text), start + len(insert)
        leaf, k, begin = self.find(max(0, start - CONTEXT))
        parts, at = [], begin
        old, old_end, (i, j) = 0, begin, (leaf, k)  # old pre-tokens passed, where they end in the old text

        def pass_old(to: int):
            nonlocal old, old_end, i, j
            while old_end < to:
                while j >= len(self.sizes[i]):
                    i, j = i + 1, 0
                old_end += self.sizes[i][j]
                old, j = old + 1, j + 1

        for m in c.pattern.finditer(new, begin):
            parts.append(m.group())
            at = m.end()
            if at >= safe:
                pass_old(at - shift)
                if old_end == at - shift and old_end >= stop:
                    break
        else:
            pass_old(len(text))
        self.replace(leaf, k, old, [len(p) for p in parts], c.count(parts))
        return new, len(parts)

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for s in self.sizes for x in s], [x for t in self.tokens for x in t]

    @property
    def total(self) -> int:
        return self.sums[1]


STATE = "doc_id long, text string, sizes array<int>, tokens array<int>"


def build(docs: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """The state of each row: its text, and characters and tokens of its pre-tokens."""

    def run(batches):
        c = counter(vocabulary)
        for batch in batches:
            for piece in pieces(batch):
                sizes, tokens = [], []
                for t in piece.column("text").to_pylist():
                    parts = c.pattern.findall(t)
                    sizes.append(np.fromiter(map(len, parts), np.int32, len(parts)))
                    tokens.append(np.array(c.count(parts), np.int32))
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sizes])]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x))) for x in (sizes, tokens)]
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in ("doc_id", "text", *more)] + lists, ["doc_id", "text", *more, "sizes", "tokens"])

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)
    kept = "".join(f"{n} {cols.schema[n].dataType.simpleString()}, " for n in more)
    return cols.mapInArrow(run, f"doc_id long, text string, {kept}sizes array<int>, tokens array<int>")


def update(state: DataFrame, vocabulary: str, edits: str = "edits", texts: bool = False) -> DataFrame:
    """Apply each row's edits (array of start, remove, insert). Returns the counts, with texts=True the new state too."""

    def run(batches):
        c = counter(vocabulary)
        for batch in batches:
            for piece in pieces(batch, limit=1 << 20):
                out = {n: [] for n in ("n_before", "n_tokens", "n_pretokens", "n_encoded", "text", "sizes", "tokens")}
                for text, sizes, tokens, some in zip(*(piece.column(n).to_pylist() for n in ("text", "sizes", "tokens", edits)), strict=True):
                    tree, encoded = Tree(sizes, tokens), 0
                    out["n_before"].append(tree.total)
                    for e in some or []:
                        text, n = tree.edit(text, e["start"] or 0, e["remove"] or 0, e["insert"] or "", c)
                        encoded += n
                    out["n_tokens"].append(tree.total)
                    out["n_pretokens"].append(sum(map(len, tree.sizes)))
                    out["n_encoded"].append(encoded)
                    if texts:
                        s, t = tree.leaves()
                        out["text"].append(text)
                        out["sizes"].append(s)
                        out["tokens"].append(t)
                arrays = [piece.column("doc_id"), *(pa.array(out[n], pa.int64()) for n in ("n_before", "n_tokens", "n_pretokens", "n_encoded"))]
                names = ["doc_id", "n_before", "n_tokens", "n_pretokens", "n_encoded"]
                if texts:
                    arrays += [pa.array(out["text"], pa.string()), *(pa.array(out[n], pa.list_(pa.int32())) for n in ("sizes", "tokens"))]
                    names += ["text", "sizes", "tokens"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    more = ", text string, sizes array<int>, tokens array<int>" if texts else ""
    return state.mapInArrow(run, f"doc_id long, n_before long, n_tokens long, n_pretokens long, n_encoded long{more}")


def sample_edits(text):
    """Three edits of a text: an insertion, a deletion and a replacement, placed by its length."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    third = (n / 3).cast("bigint")
    one = lambda start, remove, insert: F.struct(start.alias("start"), F.lit(remove).cast("bigint").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(one(third, 0, " it's an insertion, 2024"), one(third * 2, 7, ""), one(third * 0 + 5, 3, "'re "))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("edits", sample_edits(F.col("text")))
    return update(build(docs, default_vocabulary(), more=("edits",)), default_vocabulary())
