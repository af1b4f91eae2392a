from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import cases

from terracell.llm import token_ids as K
from terracell.llm import vectext as V


@pytest.fixture(scope="module")
def enc():
    return K.Encoder(K.public_vocabulary())


def direct(enc, texts):
    return [[*e.ids, K.END_ID] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=5000))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    blob = K.encode_pfor(x)
    assert (K.decode_pfor(blob) == x).all()
    assert (K.decode_pfor(blob, 1, 3) == x[K.BLOCK : 3 * K.BLOCK]).all()


def test_outliers_are_exceptions():
    x = np.arange(4096, dtype=np.uint32) % 16 + 1000
    x[::500] = 2**31
    blob = K.encode_pfor(x)
    assert len(blob) < 4096 * 0.75 + 200 and (K.decode_pfor(blob) == x).all()
    with pytest.raises(ValueError):
        K.decode_pfor(b"nope" + blob[4:])


def test_pieces_equal_whole_texts(enc):
    rng = random.Random(1)
    alphabet = list(" \n\t\r  ab'sAé12.,!?(#  　   \x1c\x85漢字😀​᠎́") + ["<|endoftext|>", "<|", "'ll", " the", "'s.", "é", "½", "x’s"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(6000)] + ["", " ", "a ", " a", "\n"]
    for i in range(0, len(texts), 300):
        t = texts[i : i + 300]
        ids, n = enc.encode(*V.text_buffers(pa.array(t)))
        want = direct(enc, t)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_written_and_read_back(spark, enc, tmp_path):
    rows = cases.texts()
    out = str(tmp_path / "ids")
    K.write_segments(cases.frame(spark, rows, repeat=False), K.public_vocabulary(), out, segment_ids=500)
    assert spark.read.parquet(out).count() > 3
    at = 0
    want = {}
    for (i, *_), ids in zip(rows, direct(enc, [t or "" for _, t, *_ in rows])):
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in K.read_segments(spark, out).collect()} == want


def test_awkward_rows(spark, tmp_path):
    df = cases.frame(spark)
    K.write_segments(df, K.public_vocabulary(), str(tmp_path / "a"))
    got = sorted(K.read_segments(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert len(got) == df.count() and got[0]["doc_id"] is None
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    K.write_segments(cases.empty(spark), K.public_vocabulary(), str(tmp_path / "b"))
    assert K.read_segments(spark, str(tmp_path / "b")).collect() == []


def test_forgetting_changes_nothing(monkeypatch, enc):
    monkeypatch.setattr(K, "CACHE_PIECES", 3)
    e = K.Encoder(K.public_vocabulary())
    for t in (["a b c d e f"], ["g h i a b"], ["a b c"]):
        assert e.encode(*V.text_buffers(pa.array(t)))[0].tolist() == direct(enc, t)[0]


def test_equal_fingerprints_do_not_mix_pieces(monkeypatch):
    monkeypatch.setattr(K, "run_codes", lambda data, start, end: V.run_codes(data, start, end) % np.uint64(40))
    e = K.Encoder(K.public_vocabulary())
    rng = random.Random(2)
    for _ in range(20):
        t = [" ".join(rng.choice(["alpha", "beta", "gamma delta", "x" * 30, "x" * 29 + "y", "é" * 9, "no", "yes", "12,5"]) for _ in range(rng.randrange(1, 40))) for _ in range(5)]
        ids, n = e.encode(*V.text_buffers(pa.array(t)))
        want = direct(e, t)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_rows_of_one_id_are_spread(spark, tmp_path):
    rows = [(7, f"text number {i} of one id " + "w " * (i % 3), "en", "a") for i in range(400)]
    K.write_segments(cases.frame(spark, rows, repeat=False), K.public_vocabulary(), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).select("part").distinct().count() > 3
    got = sorted(K.read_segments(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert len(got) == 400 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_common_pieces_outlive_forgetting(monkeypatch, enc):
    monkeypatch.setattr(K, "CACHE_PIECES", 60)
    e, rng, learned = K.Encoder(K.public_vocabulary()), random.Random(3), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda pieces, plain: (learned.extend(pieces), learn(pieces, plain)))
    common = [" often", " met", " " + "long" * 20, "\u3000odd space", ","]
    for k in range(60):
        t = ["start" + "".join(x for w in (f" w{k}x{i}" for i in range(8)) for x in (w, rng.choice(common[:3]))) for _ in range(2)] + [common[3], ""]
        ids, n = e.encode(*V.text_buffers(pa.array(t)))
        want = direct(enc, t)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
    assert len(learned) > 5 * K.CACHE_PIECES and e.total < 2 * K.CACHE_PIECES
    assert all(learned.count(x.encode()) == 1 for x in common[:4])


def test_plain_pieces_are_simple(monkeypatch, enc):
    e, rng, seen = K.Encoder(K.public_vocabulary()), random.Random(4), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda pieces, plain: (seen.extend(zip(pieces, plain)), learn(pieces, plain)))
    alphabet = list(" \n\t\r  ab'sAé12.,<\u3000\u00a0\x1c\x1f\x85\u2028\u1680漢") + ["<|endoftext|>", "  "]
    for _ in range(100):
        e.encode(*V.text_buffers(pa.array(["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(40)])))
    simple = [bool(K._SIMPLE.fullmatch(p.decode())) and b"<|endoftext|>" not in p for p, _ in seen]
    assert all(s for s, (_, known) in zip(simple, seen) if known)
    assert sum(known for _, known in seen) > 100 and any(s and not known for s, (_, known) in zip(simple, seen))
