from __future__ import annotations

import sys
from pathlib import Path

import oracle
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

import corpus_pipeline as P
from terracell.llm import decontamination as D
from terracell.llm import registry
from terracell.llm import toxicity as T

from test_decontamination import brute as leaks
from test_toxicity import labelled


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    oracle.check(spark, registry.queries()[name], registry.oracle_sql()[name])


def tables(spark, tmp_path, docs_only_empty=False):
    """Documents for every stage: prose with labels, near copies, benchmark passages, several sources."""
    rows = [(i, t, "en", "ab"[i % 3 == 0]) for i, t, _ in labelled(120)]
    rows += [(200 + i, f"copy {i} " + " ".join(f"word{j}" for j in range(100)), "en", "c") for i in range(6)]
    rows += [(300 + i, " ".join(f"leak{j}" for j in range(i, i + 14)), "en", None) for i in range(4)]
    rows += [(400, None, None, None), (401, "", "de", "a")]
    df = cases.empty(spark) if docs_only_empty else cases.frame(spark, rows, repeat=False)
    df.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(f"leak{j}" for j in range(10)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def test_stages_by_brute_force(spark, tmp_path):
    rows = tables(spark, tmp_path)
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else None
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids = [r["doc_id"] for r in out.collect()]
        if k < 4:
            assert sorted(out.columns) == sorted(columns)
        if name == "toxicity":
            model = T.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
            assert sorted(ids) == sorted(i for i, t in before.items() if model.score(t) < T.THRESHOLD)
            assert len(ids) < len(rows)
        elif name == "ngram_jaccard":
            assert sorted(ids) == sorted({c for c, _ in cases.classes(before.items()).values()})
        elif name == "decontamination":
            dirty = {i for i, v in leaks(list(before.items()), [(0, " ".join(f"leak{j}" for j in range(10)))]).items() if v[-1]}
            assert dirty == {300} and sorted(ids) == sorted(set(before) - dirty)
        elif name == "mixing":
            assert set(ids) <= set(before) and max(map(ids.count, ids)) <= 2
            kept = {i: ids.count(i) for i in ids}
        else:
            assert sorted(ids) == sorted(i for i, n in kept.items() for _ in range(n))
        docs = out


def test_run_returns_the_last_stage(spark, tmp_path):
    tables(spark, tmp_path)
    got = P.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50


def test_run_on_an_empty_table(spark, tmp_path):
    tables(spark, tmp_path, docs_only_empty=True)
    assert P.run(spark, str(tmp_path)).collect() == []


def test_every_contract_query_is_registered():
    q = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in q) for i in range(1, 11)] == [1] * 10
    assert D.WINDOW == 10
