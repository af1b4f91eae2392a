from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from cases import empty, frame, texts
from tokenizers import Tokenizer

from terracell.llm import bpe
from terracell.llm.token_ids import public_vocabulary

PATH = public_vocabulary()
PARTS = ["a", "x", "the", "ing", " ", "  ", "\n", "\t", "'", "s", "re", "'ll", "1", "9", "!", "=", "é", "日", "本", " ", " ", "\x1c", "<|endof", "text|>", "<|endoftext|>", "<", "|", ">", "🙂", "ا"]


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_streams_like_the_library(merges, library):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) * (1 if rng.random() < 0.9 else rng.randrange(1, 900)) for _ in range(rng.randrange(1, 40)))
        stream, got, at = bpe.BpeStream(merges), [], 0
        while at < len(text):
            n = rng.choice([1, 2, 3, 7, 50, 3000])
            got += stream.feed(text[at : at + n]).tolist()
            at += n
        got += stream.finish().tolist()
        assert got == _ids(library, text)


def test_code_points(merges, library):
    stream = bpe.Transducer(merges)
    points = [chr(c) for c in itertools.chain(range(1, 0x3100), range(0xA000, 0xD800, 7), range(0xE000, 0x30000, 13)) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 10_000):
        text = "".join(f"a{c}1{c}! {c}" for c in points[i : i + 10_000])
        assert stream.encode(text).tolist() == _ids(library, text)


@pytest.mark.parametrize("text", ["x" * 120_000, "=" * 40_000, " " * 60_000 + "a", "日本" * 20_000, "<|endoftext|" * 9000])
def test_constant_memory(merges, library, text):
    stream, got, held = bpe.BpeStream(merges), [], 0
    for i in range(0, len(text), 4000):
        got += stream.feed(text[i : i + 4000]).tolist()
        held = max(held, stream.held)
    got += stream.finish().tolist()
    assert got == _ids(library, text)
    assert held < (bpe.HOLD + 2) * merges.lookahead


def _merged(pairs, symbols):
    """Ids by the definition: the merges one after another, each from the left."""
    for a, b, ab in pairs:
        out = []
        for s in symbols:
            if out and out[-1] == a and s == b:
                out[-1] = ab
            else:
                out.append(s)
        symbols = out
    return symbols


def test_lookahead_is_sufficient():
    rng = random.Random(5)
    tight = 0
    for _ in range(150):
        names, pairs = [b"a", b"b", b"c"], []
        while len(pairs) < 7:
            a, b = rng.randrange(len(names)), rng.randrange(len(names))
            if names[a] + names[b] not in names:
                names.append(names[a] + names[b])
                pairs.append((a, b, len(names) - 1))
        reach = bpe.sufficient_lookahead(pairs, names)
        needed = 0
        for _ in range(60):
            text = [rng.randrange(3) for _ in range(rng.randrange(2, 40))]
            whole, cut = _merged(pairs, text), rng.randrange(1, len(text))
            part = _merged(pairs, text[:cut])
            at, i = 0, 0
            while i < len(part) and i < len(whole) and part[i] == whole[i]:
                at += len(names[part[i]])
                i += 1
            if i < len(part):
                first_end = at + len(names[part[i]])
                needed = max(needed, cut - first_end + 1)
                assert cut - first_end < reach
        tight += needed > 1
    assert tight > 20


def test_pieces_and_windows_agree(merges):
    rng = random.Random(8)
    pieces = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(1, 30))).encode() for _ in range(500)] + ["ééé".encode(), b"x" * 300]
    ids, size = bpe.merge_pieces(merges, pieces)
    at = 0
    for p, n in zip(pieces, size.tolist()):
        assert ids[at : at + n].tolist() == bpe.merge_window(merges, p)
        at += n
    assert len(bpe.merge_pieces(merges, [])[0]) == 0


def test_text_state_is_lossy_like_one_decode():
    rng = random.Random(9)
    for _ in range(500):
        data = b"".join(rng.choice([b"a", "é".encode(), "日".encode(), "🙂".encode(), bytes([rng.randrange(256)]), b"\xe2\x82", b"\xf0\x9f\x99", b"\xed\xa0\x80"]) for _ in range(rng.randrange(20)))
        state, out, at = bpe.TextState(), "", 0
        while at < len(data):
            n = rng.choice([1, 2, 3, 9])
            out += state.feed(data[at : at + n])
            assert len(state.held) <= 3
            at += n
        assert out + state.finish() == data.decode("utf-8", "replace")


def test_query_against_the_library(spark, library, tmp_path):
    rows = texts() + [(1000, "before <|endoftext|> after  x", "en", "a"), (1001, "don't  stop\n\n  now ", "en", "a"), (1002, "� \x85 \x1d!", "en", "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in bpe.op12_bpe(spark, str(tmp_path)).collect() if r.doc_id is not None)
    texts_of = {r[0]: r[1] or "" for r in rows}
    want = []
    for i in [r[0] for r in rows] + [r[0] for r in rows[3:5]]:
        ids = _ids(library, texts_of[i])
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_awkward_tables(spark):
    assert bpe.encode_texts(empty(spark), PATH).count() == 0
    rows = bpe.encode_texts(frame(spark), PATH)
    assert rows.columns == ["doc_id", "ids"] and rows.where("doc_id is null").count() == 1
    odd = spark.createDataFrame([(1, [50256, None, 99_999_999, -4, 64]), (2, None), (3, []), (None, [127, 255])], "text_id long, ids array<int>")
    got = {r.text_id: r.text for r in bpe.decode_ids(odd, PATH, ["text_id"]).collect()}
    raw = bpe.MergeList(PATH).bytes
    assert got == {1: "<|endoftext|>a", 2: "", 3: "", None: (raw[127] + raw[255]).decode("utf-8", "replace")}
    with pytest.raises(ValueError, match="text"):
        bpe.decode_ids(odd.withColumnRenamed("text_id", "text"), PATH, ["text"])


def test_long_batches(spark, library):
    e = bpe.encoder(PATH)
    data = [t or "" for _, t, *_ in texts()] * 2
    raw = "".join(data).encode()
    ids, size = e.encode(np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in data]))))
    want = [_ids(library, t) for t in data]
    assert size.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
