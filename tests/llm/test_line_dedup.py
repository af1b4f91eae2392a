from __future__ import annotations

import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent))
import cases

from terracell.llm import line_dedup as L


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and i != max(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def run(df, **options):
    from pyspark.sql import functions as F

    kept = L.apply_bitmaps(df, L.line_keep_bitmaps(df, **options))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("d")).collect()


def test_against_brute_force(spark):
    rows = cases.texts()
    rows += [(900 + k, "\n".join(["É" * 19 + "e", "é" * 20, "Ab " * 9, "ab " * 9, f"own {k}"] * (12 if k == 1 else 1)), "en", "a") for k in range(4)]
    got = {r[0]: tuple(r)[1:] for r in run(cases.frame(spark, rows, repeat=False))}
    assert got == brute([(i, t) for i, t, *_ in rows])


def test_hot_keys_give_the_same(spark):
    rows = cases.texts()
    rows += [(700 + k, "a line that is in each of these rows" + ("\n and this one in every second " if k % 2 else ""), "en", "a") for k in range(200)]
    want = sorted(map(tuple, run(cases.frame(spark, rows, repeat=False), hot_keys=1)))
    assert want == sorted((i, *x) for i, x in brute([(i, t) for i, t, *_ in rows]).items())
    for n in (20, 1000):
        assert sorted(map(tuple, run(cases.frame(spark, rows, repeat=False), hot_keys=n))) == want


def test_bitmaps_leave_out_full_words(spark):
    line = "a line that stands in many documents"
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(70)] + [line]), "en", "a") for i in range(3)]
    got = {r["doc_id"]: r["keep"] for r in L.line_keep_bitmaps(cases.frame(spark, rows, repeat=False)).collect()}
    assert got == {0: {2: ~(1 << 6)}, 1: {2: ~(1 << 6)}}


def test_rows_of_one_id_are_one_document(spark):
    line = "the very same line in all of these"
    rows = [(1, line), (1, line + "\nown one"), (2, line), (5, line.upper() + " too"), (5, line.upper() + " too"), (6, line + " too"), (7, line + " too")]
    df = cases.frame(spark, [(i, t, "en", "a") for i, t in rows], repeat=False)
    got = sorted((r["doc_id"], r["n_dropped"]) for r in run(df))
    assert got == [(1, 0), (1, 0), (2, 0), (5, 1), (5, 1), (6, 1), (7, 0)]
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = dict(con.sql(f"SELECT doc_id, n_dropped FROM ({L.OP3_SQL})").fetchall())
    assert {i: sum(n for j, n in got if j == i) for i, _ in got} == want


def test_awkward_rows(spark):
    got = run(cases.frame(spark))
    assert len(got) == len(cases.texts()) + 3
    assert {(r["n_lines"], r["n_dropped"]) for r in got if r["doc_id"] is None} == {(1, 0)}
    assert run(cases.empty(spark)) == []
