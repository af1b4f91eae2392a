from __future__ import annotations

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases

from terracell.llm import telephony as A


def test_companding_tables():
    assert A.MULAW_PCM[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert A.ALAW_PCM[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    for t in (A.MULAW_PCM, A.ALAW_PCM):
        half = np.sort(np.abs(t.astype(int)))
        assert (np.diff(half.reshape(-1, 2)[:, 0]) > 0).all()


def slow_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(A.STEPS[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(A.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_against_scalar():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert A.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("tag", [A.PCM, A.ALAW, A.MULAW, A.IMA_ADPCM])
def test_wav_round_trip(tag):
    payload = bytes(range(128)) * 2
    align = 64 if tag == A.IMA_ADPCM else 2 if tag == A.PCM else 1
    assert A.parse_wav(A.wav(payload, tag, 8000, {A.IMA_ADPCM: 4, A.PCM: 16}.get(tag, 8), align)) == (tag, 8000, align, payload)


def test_resampling():
    x = np.array([0, 100, -100], np.int16)
    assert A.resample(x, 2).tolist() == [0, 50, 100, 0, -100, -100]
    assert A.resample(x, 16_000, 8_000).tolist() == A.resample(x, 2).tolist()
    assert A.resample(x[:0], 2).tolist() == []
    t = np.arange(8000)
    low, high = (np.rint(10_000 * np.sin(2 * np.pi * f / 8000 * t)).astype(np.int16) for f in (300, 3500))
    down = A.resample(low + high, 4_000, 8_000).astype(int)
    assert len(down) == 4000 and np.abs(down[50:-50] - low[::2][50:-50]).max() < 900  # 3500 Hz would fold to 500 Hz
    assert A.resample(np.full(50, 7, np.int16), 3, 7).tolist() == [7] * 22


def test_damaged_files_never_raise(spark):
    rng = np.random.default_rng(6)
    good = [A.wav(bytes(range(128)), A.MULAW), A.wav(bytes(range(128)), A.ALAW), A.wav(bytes(range(128)), A.IMA_ADPCM, bits=4, align=64), A.wav(bytes(range(128)), A.PCM, bits=16, align=2)]
    files = [A.wav(b"x" * 64, A.MULAW, rate=0), A.wav(b"x" * 64, A.IMA_ADPCM, bits=4, align=64)[:32] + b"\0\0" + A.wav(b"x" * 64, A.IMA_ADPCM, bits=4, align=64)[34:], good[0][:30]]
    for _ in range(1500):
        x = bytearray(good[rng.integers(len(good))])
        for at in rng.integers(0, 60, rng.integers(1, 4)):
            x[at] = rng.choice([0, 1, 2, 4, 255, rng.integers(256)])
        files.append(bytes(x[: rng.integers(0, len(x) + 1)] if rng.random() < 0.3 else x))
    df = spark.createDataFrame(list(enumerate(files)), "id int, media binary")
    got = A.decode_telephony(df).collect()
    assert len(got) == len(files) and all((r["pcm"] is None) == (r["error"] is not None) for r in got)
    assert all(r["error"] for r in got if r["id"] < 3) and sum(r["error"] is None for r in got) > 50


def test_decoded_columns(spark):
    good, rows = A.wav(b"\xff\x00" * 32, A.MULAW), []
    rows = [(1, good, "x"), (2, None, "x"), (3, b"junk", "x"), (4, A.wav(b"", A.ALAW), "x"), (5, good[:-5], "x"), (6, A.wav(b"\0" * 64, 0x99), "x")]
    got = {r["id"]: r for r in A.decode_telephony(spark.createDataFrame(rows, "id int, media binary, pcm string")).collect()}
    assert np.frombuffer(got[1]["pcm"], "<i2").tolist() == A.resample(A.MULAW_PCM[np.frombuffer(b"\xff\x00" * 32, np.uint8)], 2).tolist()
    assert got[2]["pcm"] is None and got[2]["error"] is None and got[4]["pcm"] == b"" and got[1]["pcm_rate"] == 16000
    assert got[3]["error"] == "not a WAV file" and got[5]["error"] == "damaged WAV file" and "format" in got[6]["error"]


def slow_feature(payload):
    """The feature by its description, sample by sample."""
    mu, a = [int(A.MULAW_PCM[x]) for x in payload], [int(A.ALAW_PCM[x]) for x in payload]
    n, pcm = len(mu), []
    for i, v in enumerate(mu):
        pcm += [v, v + (mu[min(i + 1, n - 1)] - v) // 2]
    blocks = [slow_adpcm(payload[i : i + 64]) for i in range(0, n, 64)]
    adpcm = sum(abs(v) for b in blocks for v in b) // (121 * len(blocks))
    zc = sum((p < 0) != (q < 0) for p, q in zip(mu, mu[1:]))
    return f"mu={sum(map(abs, mu)) // n};a={sum(map(abs, a)) // n};zc={zc};adpcm={adpcm};pcm16k={zlib.crc32(np.array(pcm, '<i2').tobytes())}"


def read_back(spark, df, path):
    A.store_media(A.encode_payloads(df), str(path), rate=A.RATE)
    return A.describe_media(spark.read.parquet(str(path)))


def test_payloads_read_back(spark, tmp_path):
    df = cases.frame(spark)
    got = read_back(spark, df, tmp_path / "media").collect()
    assert len(got) == df.count()
    by_id = {i: (t or "").encode() for i, t, *_ in cases.texts()}
    same = {}
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = by_id[r["doc_id"]]
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        blob = A.wav(p, A.MULAW)
        assert (r["media_bytes"], r["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())
        assert same.setdefault(raw, r["feature"]) == r["feature"]
    assert all(slow_feature(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")) == f for raw, f in same.items() if len(raw) < 20_000)
    stored = spark.read.parquet(str(tmp_path / "media")).where("doc_id = 0").first()
    assert len(stored["pcm"]) == 2 * (len(stored["media"]) - 58) and stored["pcm_rate"] == 8_000
    A.store_media(A.encode_payloads(df), str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide")).where("doc_id = 0").first()
    assert len(stored["pcm"]) == 4 * (len(stored["media"]) - 58) and stored["pcm_rate"] == 16_000
    assert read_back(spark, cases.empty(spark), tmp_path / "none").collect() == []


@given(st.lists(st.integers(-32768, 32767), max_size=60))
@settings(max_examples=200, deadline=None)
def test_halves_are_lossless(samples):
    x = np.array(samples, "<i2")
    even, odd = A.split_pcm(x.tobytes())
    assert len(even) + len(odd) == 2 * len(x) and A.join_pcm(even, odd) == x.tobytes()
    assert not any(A.split_pcm(A.resample(x, 2).tobytes())[1])


def test_query_resamples_what_it_stores(spark, tmp_path, monkeypatch):
    cases.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(A, "new_path", lambda *_: str(tmp_path / "media"))
    got = {r["doc_id"]: r for r in A.op10_telephony(spark, str(tmp_path)).collect()}
    stored = spark.read.parquet(str(tmp_path / "media"))
    assert {r["pcm_rate"] for r in stored.select("pcm_rate").distinct().collect()} == {16_000}
    row = stored.where("doc_id = 0").first()
    pcm = A.join_pcm(row["pcm_even"], row["pcm_odd"])
    assert len(pcm) == 4 * got[0]["payload_bytes"] and got[0]["feature"].endswith(f"pcm16k={zlib.crc32(pcm)}")
    # What is stored between two samples of the file decides the feature.
    other = stored.where("doc_id = 0").withColumn("pcm_odd", F.expr("concat(X'01', substring(pcm_odd, 2))"))
    assert A.describe_media(other).first()["feature"] != got[0]["feature"]
    rows = [(1, None), (2, b"junk"), (3, A.wav(b"", A.ALAW))]
    halves = {r["id"]: r for r in A.decode_telephony(spark.createDataFrame(rows, "id int, media binary"), halves=True).collect()}
    assert halves[1]["pcm_even"] is None and halves[2]["pcm_odd"] is None and halves[2]["error"] and halves[3]["pcm_even"] == halves[3]["pcm_odd"] == b""
