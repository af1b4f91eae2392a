from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from terracell.llm import substring_dedup as S
from terracell.llm.fm_index import FMIndex


def brute(rows, k=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = cases.words(t)
        gone = set()
        for a in range(len(w) - k + 1):
            g = tuple(w[a : a + k])
            if g in seen:
                gone.update(range(a, a + k))
            seen.add(g)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.remove_repeats(S.repeated_windows(df)).collect()}


def case_rows():
    rng = random.Random(4)
    rows = cases.texts()
    long = [f"p{i}" for i in range(300)]
    for k in range(40):
        a = rng.randrange(250)
        own = [f"o{k}_{j}" for j in range(rng.randrange(1, 30))]
        rows.append((2000 + k, " ".join(own + long[a : a + rng.randrange(15, 60)] + own[::-1] + rng.choice([[], ["x", "y"] * 30])), "en", "a"))
    return rows


def test_against_brute_force(spark):
    rows = case_rows()
    assert run(cases.frame(spark, rows, repeat=False)) == brute([(i, t) for i, t, *_ in rows])


@pytest.mark.parametrize("shard, hot, crowd", [(50, 10**9, 10**9), (1 << 19, 2, 10**9), (300, 4096, 2)])
def test_small_shards_and_hot_anchors(spark, monkeypatch, shard, hot, crowd):
    monkeypatch.setattr(S, "SHARD_WORDS", shard)
    monkeypatch.setattr(S, "HOT_RUNS", hot)
    monkeypatch.setattr(S, "CHUNK_RUNS", crowd)
    passage = " ".join(f"q{i}" for i in range(40))
    rows = case_rows() + [(3000 + k, f"a{k} b{k} {passage} c{k} d{k}", "en", "a") for k in range(150)]
    assert run(cases.frame(spark, rows, repeat=False)) == brute([(i, t) for i, t, *_ in rows])


def test_the_index_decides(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1000, 90).astype(np.uint32)
    doc, at, n = np.array([7, 3, 3, 9]), np.array([0, 5, 30, 0]), np.array([20, 10, 4, 20])
    flat = np.concatenate([base[:39], base[10:39], base[40:63], base[:39]])
    got = S._judge(doc, at, n, flat, 20)
    assert got.tolist() == [0] * 10 + [1] * 10 + [0] * 10 + [0] * 4 + [1] * 20

    def gone(*_):
        raise RuntimeError("no index")

    monkeypatch.setattr(S, "FMIndex", gone)
    with pytest.raises(RuntimeError):
        S._judge(doc, at, n, flat, 20)


def test_rows_of_one_id(spark):
    w = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    rows = [(1, w[0]), (1, w[0]), (1, w[1]), (2, w[1]), (3, w[0] + w[2]), (4, w[2])]
    df = cases.frame(spark, [(i, " ".join(t), "en", "a") for i, t in rows], repeat=False)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in S.remove_repeats(S.repeated_windows(df)).collect())
    assert got == [(1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30), (3, 60, 30), (4, 30, 30)]


def test_awkward_rows(spark):
    df = cases.frame(spark)
    rows = S.remove_repeats(S.repeated_windows(df)).collect()
    assert len(rows) == df.count()
    want = brute([(i, t) for i, t, *_ in cases.texts()])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows if r["doc_id"] is not None} == want
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]
    assert run(cases.empty(spark)) == {}


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for depth, sigma in ((20, 3), (20, 60), (7, 4), (4, 5)):
        t = rng.integers(1, sigma, 300)
        t[::57] = 0
        t = np.concatenate([t, t[100:200], [0]])
        f = FMIndex(t, depth)
        held = {m: Counter(tuple(t[i : i + m]) for i in range(len(t) - m + 1)) for m in range(1, depth + 1)}
        for stream in (t, np.concatenate([t[150:250], rng.integers(1, sigma + 2, 100)])):
            end = np.arange(len(stream) + 1)
            length, interval = f.statistics(stream, end)
            seen = {}
            for e, n, lo in zip(end.tolist(), length.tolist(), interval.tolist()):
                want = 0
                while want < min(depth, e) and stream[e - want - 1] > 0 and held[want + 1][tuple(stream[e - want - 1 : e])] > 1:
                    want += 1
                assert n == (want if want >= f.jump else 0)
                if n:
                    assert seen.setdefault((n, lo), tuple(stream[e - n : e])) == tuple(stream[e - n : e])
