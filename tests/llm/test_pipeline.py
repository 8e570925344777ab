"""The stages of the corpus pipeline: odd rows one by one, and the whole against a plain version."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from chronoloom.llm import op2_token_planes as o2
from chronoloom.llm.common import importable

DATA = "/root/testdata/sf0.01"
ROWS = [(1, "One two three four five six", "en", "a", 27), (1, "One two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n ", "en", None, 3), (None, "no id at all", "de", "b", 12), (5, "y" * 100_000, "fr", "c", 100_000), (6, "Zwei Wörter", "de", "c", 11)]
CLASH = ("h", "size", "label", "sig", "shards", "text_hash", "spans", "items", "target", "mix_copy", "_h", "_d", "rank", "id", "kept", "part")


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
@pytest.mark.parametrize("kind", ["odd", "empty", "clash"])
def test_stage(spark, docs, name, kind):
    d = docs.where("false") if kind == "empty" else docs.withColumns({c: F.lit(7) for c in CLASH}) if kind == "clash" else docs
    out = dict(cp.STAGES)[name](spark, d, DATA)
    rows = out.collect()
    if kind == "empty":
        assert not rows
    if name != "tokens":
        assert out.columns == d.columns
    if kind != "empty":
        found = [r["doc_id"] for r in rows]
        if name == "near_dedup":
            assert sorted(found, key=str) == sorted([1, 2, 3, 4, 5, 6, None], key=str)
        if name == "decontaminate":
            assert len(rows) == len(ROWS)
        if name in ("mix", "tokens"):
            assert all(found.count(k) <= 2 * [r[0] for r in ROWS].count(k) for k in set(found))
        if name == "tokens":
            assert sorted(found, key=str) == sorted((r[0] for r in ROWS), key=str)


def test_pipeline_against_a_plain_version(spark):
    """Decisions of each stage on the real rows, with near copies, windows and sizes taken by brute force."""
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    passed = {}
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        d = cp.stored(stage(spark, d, DATA), f"test-{name}")
        passed[name] = [r["doc_id"] for r in d.select("doc_id").collect()]
    quality, dedup, clean, mixed = (passed[n] for n in ("quality", "near_dedup", "decontaminate", "mix"))
    assert len(set(quality)) == len(quality) and set(quality) <= rows.keys()

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda k: [w for w in __import__("re").split("[\x20\x09-\x0d]+", (rows[k]["text"] or "").translate(lower)) if w]
    sets = {}
    for k in quality:
        w = words(k)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label, by = {k: k for k in quality}, {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)

    def root(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for k, s in sets.items():
        shared: dict = {}
        for x in s:
            for o in by[x]:
                shared[o] = shared.get(o, 0) + 1
        for o, n in shared.items():
            if o != k and 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(k), root(o)))
                label[b] = a
    assert sorted(dedup) == sorted(k for k in quality if root(k) == k)

    import re

    tokens = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    items = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = tokens(r["text"])
        items |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else ({tuple(w)} if w else set())
    sizes = {len(x) for x in items}

    def hit(k):
        w = tokens(rows[k]["text"])
        return any(tuple(w[i : i + n]) in items for n in sizes for i in range(len(w) - n + 1))

    assert sorted(clean) == sorted(k for k in dedup if not hit(k)) and len(clean) < len(dedup) < len(quality)

    size = {k: len(words(k)) for k in clean}
    by_source: dict = {}
    for k in clean:
        by_source.setdefault(rows[k]["source"], []).append(k)
    assert set(mixed) <= set(clean) and max(mixed.count(k) for k in set(mixed)) <= 2
    total, taken = sum(size.values()), sum(size[k] for k in mixed)
    assert abs(taken - min(1.5 * total, 2 * total)) <= len(by_source) * max(size.values())
    out = cp.STAGES[-1][1](spark, d, DATA).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(mixed) and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
    assert o2.default_tokenizer()
