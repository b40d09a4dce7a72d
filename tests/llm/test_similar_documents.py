"""Rows that are numbered alike each time, columns whose names clash, and near-duplicates by a wanted similarity."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import simhash_dedup, simhash_similar
from dossier.llm.shared import numbered
from dossier.llm.simhash_dedup import deduplicated, near_duplicates
from dossier.llm.simhash_similar import WIDE, distance, distinct_documents, similar_groups
from dossier.llm.substring_dedup import remove_repeats

CLASH = ["__row", "__near", "Score", "fp", "root", "part", "c0"]


@pytest.fixture
def clashing(spark, tmp_path, prose):
    texts = [prose(80, 1), prose(80, 1), prose(80, 2), None, "", prose(40, 3) + " " + prose(50, 9), prose(30, 4) + " " + prose(50, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.select("*", *(F.lit(c).alias(c) for c in CLASH)).repartition(3).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def test_numbers_do_not_depend_on_splits(spark, clashing):
    docs, seen = clashing.drop("__row"), []
    for size in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            seen.append({r.doc_id: r["__row"] for r in numbered(docs).select("__row", "doc_id").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 7
    # rows of anything but a scan are stored first
    for other in (docs.union(docs), docs.join(docs.select("doc_id"), "doc_id"), spark.range(4).toDF("doc_id"), docs.limit(0)):
        rows = numbered(other).select("__row").collect()
        assert len(rows) == other.count() == len(set(rows))


def test_clashing_names_stay(clashing):
    for kept in (deduplicated(clashing), distinct_documents(clashing)):
        assert kept.columns == clashing.columns
        rows = kept.collect()
        assert sorted(r.doc_id for r in rows) == [0, 2, 3, 5, 6] and all(r[c] == c for r in rows for c in CLASH)
    cut = {r.doc_id: r for r in remove_repeats(clashing).collect()}
    assert [cut[i].n_removed for i in range(7)] == [80, 80, 0, 0, 0, 50, 50] and all(r[c] == c for r in cut.values() for c in CLASH)
    assert near_duplicates(clashing).filter("component_id = 0").count() == 2


def edited(text, share, seed):
    """The text with some of its words replaced."""
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), max(1, round(share * len(words)))):
        words[i] = f"new{r.random()}"
    return " ".join(words)


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_are_found_and_others_stay(spark, make_docs, prose):
    originals = [prose(100 + 10 * (i % 40), i) for i in range(200)]
    near = [edited(t, (0.004, 0.01, 0.015)[i % 3], i) for i, t in enumerate(originals)]
    far = [edited(t, 0.12, 1000 + i) for i, t in enumerate(originals)]
    likeness = [jaccard(a, b) for a, b in zip(originals, near, strict=True)]
    sure = [i for i, x in enumerate(likeness) if x >= 0.87]
    assert len(sure) > 150 and max(map(jaccard, originals, far)) < 0.6
    kept = {r.doc_id for r in distinct_documents(make_docs(originals + near + far)).select("doc_id").collect()}
    assert kept >= set(range(200)) | set(range(400, 600))
    assert sum(200 + i not in kept for i in sure) >= 0.97 * len(sure)


def test_groups_equal_brute_force(spark, make_docs, prose, odd):
    texts = [edited(prose(150, i % 12), 0.001 * (i % 7), i) for i in range(150)] + odd
    marked = make_docs(texts, ids=[None if i == 3 else i for i in range(len(texts))]).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text").persist()
    words = ["fp", *(f"fp{i}" for i in range(1, WIDE))]
    prints = {r.row: r for r in simhash_dedup.fingerprinted(marked, shingle=5, wide=WIDE).collect()}
    number = {k: sum((r[w] & (2**64 - 1)) << (64 * i) for i, w in enumerate(words)) for k, r in prints.items()}
    root = {k: k for k in number}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    def near(x, y):
        """As the views see it: near in one of them and on the whole, or but for two bits of the first word."""
        apart = x ^ y
        parts = [apart >> s & (2**32 - 1) for s in range(0, 64 * WIDE, 32)]
        return (apart & (2**64 - 1)).bit_count() <= 2 or apart.bit_count() <= distance(0.8) and min(p.bit_count() for p in parts) <= 3

    for a, b in itertools.combinations(number, 2):
        if near(number[a], number[b]):
            root[top(a)] = top(b)
    groups = {}
    for r in similar_groups(marked).collect():
        groups.setdefault(r.root, set()).add(r.row)
    want = {}
    for k in number:
        want.setdefault(top(k), set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert similar_groups(marked.limit(0)).count() == 0


def test_split_cells_find_the_same(spark, make_docs, prose, monkeypatch):
    texts = [edited(prose(120, i % 5), 0.01, i) for i in range(120)]
    whole = sorted(r.doc_id for r in distinct_documents(make_docs(texts)).collect())
    monkeypatch.setattr(simhash_similar, "CELL", 6)
    assert sorted(r.doc_id for r in distinct_documents(make_docs(texts)).collect()) == whole


def test_pieces_hold_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "PIECE", 7)
    a0, a1, b0, b1 = (np.array(x) for x in ([0, 4, 9], [4, 9, 9], [2, 0, 1], [5, 30, 3]))
    got = [p for i, j in simhash_dedup._products(a0, a1, b0, b1) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert got == [(i, j) for s, e, t, f in zip(a0, a1, b0, b1, strict=True) for i in range(s, e) for j in range(t, f)]
