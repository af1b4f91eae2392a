from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from terracell.llm import vectext as V

TEXTS = st.lists(st.none() | st.text(alphabet=" \t\nabAZé漢\x1c!", max_size=30), max_size=12)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words(texts):
    data, offsets = V.text_buffers(pa.array(texts, pa.string()))
    w = V.words(data, offsets, V.space_table())
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end)] == [x for t in want for x in t]
    assert w.counts().tolist() == [len(t) for t in want]
    codes = {}
    for x, c in zip([x for t in want for x in t], w.code.tolist()):
        assert codes.setdefault(x, c) == c
    assert len(set(codes.values())) == len(codes)


@given(TEXTS, st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_windows(texts, k):
    data, offsets = V.text_buffers(pa.array(texts, pa.string()))
    at, code = V.windows(V.words(data, offsets, V.space_table()), k)
    want = [tuple(w[i : i + k]) for t in texts for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i in range(len(w) - k + 1)]
    assert len(at) == len(want)
    seen = {}
    for g, c in zip(want, code.tolist()):
        assert seen.setdefault(g, c) == c
    assert len(set(seen.values())) == len(seen)


def test_pieces_do_not_change_codes(monkeypatch):
    texts = ["alpha beta " * 50, "x" * 500, None, "beta"]
    data, offsets = V.text_buffers(pa.array(texts, pa.string()))
    one = V.words(data, offsets, V.space_table()).code
    monkeypatch.setattr(V, "PIECE_BYTES", 16)
    assert (V.words(data, offsets, V.space_table()).code == one).all()


def test_slices_keep_offsets():
    b = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 10, "", "cc"])], ["text"])
    parts = list(V.chunks(b.slice(1, 4), "text", 4))
    assert [x for p in parts for x in p.column("text").to_pylist()] == [None, "b" * 10, "", "cc"]
    data, offsets = V.text_buffers(b.slice(2, 3).column("text"))
    assert data.tobytes() == b"b" * 10 + b"cc" and offsets.tolist() == [0, 10, 10, 12]
    assert V.text_buffers(pa.array([], pa.string()))[1].tolist() == [0] and isinstance(data, np.ndarray)
