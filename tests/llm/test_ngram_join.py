from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from terracell.llm import components, ngram_join as N


@pytest.mark.parametrize("block", [256, 8])
def test_against_all_pairs(spark, block):
    rows = cases.texts()
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    for k in range(25):  # chains: each differs from the one before
        base = list(base)
        base[rng.randrange(60)] = f"c{k}"
        rows.append((1000 + k, " ".join(base), "en", "a"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.ngram_classes(cases.frame(spark, rows, repeat=False), block_docs=block).collect()}
    assert got == cases.classes([(i, t) for i, t, *_ in rows])


def test_copies_count(spark):
    rows = [(i, "the very same words in every one of these", "en", "a") for i in range(500)]
    got = N.ngram_classes(cases.frame(spark, rows, repeat=False)).collect()
    assert {(r["class_id"], r["n_links"], r["n_copies"]) for r in got} == {(0, 499, 500)}


def test_awkward_rows(spark):
    df = cases.frame(spark)
    got = N.ngram_classes(df).collect()
    assert len(got) == df.count()
    by_text = {i: t for i, t, *_ in cases.texts()}
    for r in got:
        if r["doc_id"] is None:
            assert (r["class_id"], r["n_links"]) == (None, 0)
        elif not cases.words(by_text[r["doc_id"]]):
            assert (r["class_id"], r["n_links"]) == (r["doc_id"], 0)
    assert N.ngram_classes(cases.empty(spark)).collect() == []


def test_one_of_each_class_stays(spark):
    df = cases.frame(spark, repeat=False)
    out = N.drop_near_copies(df)
    assert out.columns == df.columns
    want = cases.classes([(i, t) for i, t, *_ in cases.texts()])
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for c, _ in want.values()})


def test_banding_meets_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.8, 0.9), (0.5, 0.99), (0.95, 0.999)):
        b, r = N.bands_and_rows(threshold, recall)
        assert b * r <= N.MAX_HASHES and 1 - (1 - threshold**r) ** b >= recall


def test_components(spark):
    e = [(i + 1, i) for i in range(20)] + [(100, 101), (102, 101), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_texts_that_share_their_smallest_id(spark, block):
    w = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    near = [*w[0][:59], "other"]
    rows = [(1, w[0]), (1, w[1]), *((i, w[0]) for i in range(5, 10)), *((i, w[1]) for i in range(20, 23)), (30, near), (40, w[2])]
    df = cases.frame(spark, [(i, " ".join(t), "en", "a") for i, t in rows], repeat=False)
    got = sorted(map(tuple, N.ngram_classes(df, block_docs=block).select("doc_id", "class_id", "n_links", "n_copies").collect()))
    want = [(1, 1, 6, 6), (1, 1, 3, 4), *((i, 1, 6, 6) for i in range(5, 10)), *((i, 1, 3, 4) for i in range(20, 23)), (30, 1, 6, 1), (40, 40, 0, 1)]
    assert got == sorted(want)
    assert sorted(r["doc_id"] for r in N.drop_near_copies(df, block_docs=block).collect()) == [1, 1, 40]


def test_recall_near_the_threshold(spark):
    """Two thousand pairs of similarity 0.81: the banding is meant to find 999 of 1000."""
    rng = random.Random(12)
    rows = []
    for k in range(2000):
        w = [f"v{rng.randrange(50_000)}" for _ in range(120)]
        other = w[:108] + [f"u{rng.randrange(50_000)}" for _ in range(12)]  # 104 of 128 5-grams in common
        rows += [(2 * k, " ".join(w), "en", "a"), (2 * k + 1, " ".join(other), "en", "a")]
    got = N.ngram_classes(cases.frame(spark, rows, repeat=False)).collect()
    assert sum(r["n_links"] == 1 for r in got) >= 0.99 * len(rows) and all(r["n_links"] <= 1 for r in got)


@pytest.mark.parametrize("block", [256, 2])
def test_sparse_components_are_compared_by_unit(spark, block):
    """A chain whose ends share no band: the component is larger than its units, and each link is counted once."""
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(60):
        base = base[2:] + [f"n{k}a", f"n{k}b"]
        rows.append((k, " ".join(base), "en", "a"))
    df = cases.frame(spark, rows, repeat=False)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.ngram_classes(df, block_docs=block, recall=0.9999999).collect()}
    assert got == cases.classes([(i, t) for i, t, *_ in rows])


@pytest.mark.parametrize("block", [256, 8])
def test_long_texts_are_compared_in_parts(spark, block):
    """Where the texts of a task hold more n-grams than one task compares, parts of the n-grams give the same links."""
    rng = random.Random(5)
    rows = cases.texts()
    for family in range(3):
        base = [f"f{family}w{rng.randrange(900)}" for _ in range(400)]
        for k in range(12):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(400)] = f"c{rng.randrange(10**6)}"
            rows.append((2000 + 100 * family + k, " ".join(words), "en", "a"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.ngram_classes(cases.frame(spark, rows, repeat=False), block_docs=block, block_grams=300, recall=0.9999999).collect()}
    assert got == cases.classes([(i, t) for i, t, *_ in rows])
