"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, WAV containers, resampled PCM.

The companding laws are expanded through 256-entry tables built from their definitions.
ADPCM is sequential inside a block only, so the decoder steps through the samples of a
block once and does each step for all blocks of a whole batch with numpy.  Media columns are
stored as Parquet, WAV files and resampled PCM side by side, and read back from there.  PCM can be
stored in two halves by a lifting step, which is lossless for any signal and small for resampled ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from ..store import new_path
from .vectext import chunks, text_buffers, tidy

#: WAV format tags (fixed values).
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
RATE = 8000
#: Rate of resampled PCM.
WIDE_RATE = 16_000
#: Bytes of one ADPCM block: 4 of header and 8 of codes for each 16 samples.
BLOCK = 64
#: Rates that a telephony file may have; others are taken as damage.
MIN_RATE, MAX_RATE = 1_000, 384_000
#: Zero crossings on each side that the low-pass filter has.
LOBES = 4

#: IMA ADPCM step sizes and index moves (fixed values).
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
     230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024,
     3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086,
     29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code: inverted bits; sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    c = ~np.arange(256) & 0xFF
    size = ((((c & 15) << 3) + 132) << ((c >> 4) & 7)) - 132
    return np.where(c & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code: even bits inverted; a set sign bit is positive; the lowest exponent is linear."""
    c = np.arange(256) ^ 0x55
    e, m = (c >> 4) & 7, (c & 15) << 4
    size = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def _adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, code): the change of the predictor, and the next step index."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + MOVES[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


_CHANGE, _NEXT = _adpcm_moves()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of mono IMA blocks, shape (blocks, bytes) to (blocks, 1 + 2 * (bytes - 4)).

    A step index beyond the table is taken as its last entry.
    """
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    state = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for j, code in enumerate((codes[i] & 15, codes[i] >> 4)):
            at = state + code
            value = np.clip(value + _CHANGE[at], -32768, 32767)
            state = _NEXT[at]
            out[1 + 2 * i + j] = value
    return np.ascontiguousarray(out.T)


def low_pass(x: np.ndarray, ratio: float) -> np.ndarray:
    """Windowed-sinc filter that keeps frequencies below half of ``1/ratio`` of the rate; the ends are held."""
    half = int(np.ceil(LOBES * ratio))
    at = np.arange(-half, half + 1)
    taps = np.sinc(at / ratio) * np.hanning(2 * half + 3)[1:-1]
    return np.convolve(np.pad(x.astype(np.float64), half, mode="edge"), taps / taps.sum(), mode="valid")


def resample(x: np.ndarray, up: int, down: int = 1) -> np.ndarray:
    """int16 PCM at ``up/down`` times the rate: linear between neighbours, the last sample held; low-passed first when the rate falls."""
    if len(x) == 0:
        return x.astype(np.int16)
    by = int(np.gcd(up, down))
    up, down = up // by, down // by
    if down > up:
        x = np.clip(np.rint(low_pass(x, down / up)), -32768, 32767).astype(np.int16)
    if down == 1:
        step, out = np.diff(x.astype(np.int64), append=x[-1]), np.empty((len(x), up), np.int16)
        for i in range(up):
            out[:, i] = x + step * i // up
        return out.ravel()
    n = -(-len(x) * up // down)
    at = np.arange(n, dtype=np.int64) * down
    i, part = at // up, at % up
    a = x[i].astype(np.int32)
    b = x[np.minimum(i + 1, len(x) - 1)].astype(np.int32)
    return (a + (b - a).astype(np.int64) * part // up).astype(np.int16)


def wav(payload: bytes, tag: int, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono WAV file around a payload of the given format."""
    extra = struct.pack("<HH", 2, 1 + 2 * (align - 4)) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_block = 1 + 2 * (align - 4) if tag == IMA_ADPCM else 1
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per_block, align, bits) + extra
    samples = len(payload) // align * per_block
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(blob: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, bytes of a block, payload) of a mono WAV file with telephony audio; raises ValueError for anything else."""
    if len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if at + 8 + size > len(blob):
            raise ValueError("damaged WAV file")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("damaged WAV file")
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", blob, at + 8)
            if channels != 1:
                raise ValueError("not mono")
            if tag not in _LAYOUT:
                raise ValueError(f"format {tag} is not telephony audio")
            if not MIN_RATE <= rate <= MAX_RATE or not _LAYOUT[tag](align, bits):
                raise ValueError("damaged WAV file")
            fmt = (tag, rate, align)
        elif name == b"data":
            if fmt is None:
                raise ValueError("damaged WAV file")
            return *fmt, blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


#: Whether bytes of a block and bits of a sample fit a format.
_LAYOUT = {
    PCM: lambda align, bits: (align, bits) == (2, 16), ALAW: lambda align, bits: (align, bits) == (1, 8), MULAW: lambda align, bits: (align, bits) == (1, 8),
    IMA_ADPCM: lambda align, bits: align > 4 and bits == 4,
}


def to_pcm(tag: int, align: int, payload: bytes) -> np.ndarray:
    """int16 samples of a payload; what is left of a cut block or sample is left out."""
    x = np.frombuffer(payload, np.uint8)
    if tag == MULAW:
        return MULAW_PCM[x]
    if tag == ALAW:
        return ALAW_PCM[x]
    if tag == IMA_ADPCM:
        return decode_adpcm(x[: len(x) // align * align].reshape(-1, align)).ravel()
    return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2")


def split_pcm(pcm: bytes) -> tuple[bytes, bytes]:
    """PCM16 as (its even samples, what each odd sample differs modulo 2**16 from the rounded-down mean of its neighbours); the end is held."""
    x = np.frombuffer(pcm, "<i2")
    even, odd = np.ascontiguousarray(x[::2]), x[1::2]
    return even.tobytes(), (odd - _between(even)[: len(odd)]).tobytes()


def join_pcm(even: bytes, odd: bytes) -> bytes:
    """The PCM16 of :func:`split_pcm`."""
    a, b = np.frombuffer(even, "<i2"), np.frombuffer(odd, "<i2")
    out = np.empty(len(a) + len(b), "<i2")
    out[::2] = a
    out[1::2] = b + _between(a)[: len(b)]
    return out.tobytes()


def _between(x: np.ndarray) -> np.ndarray:
    """Rounded-down mean of each sample and the next."""
    wide = x.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:])) >> 1).astype("<i2")


def decode_telephony(media: DataFrame, column: str = "media", rate: int = WIDE_RATE, halves: bool = False) -> DataFrame:
    """Adds ``pcm binary, pcm_rate int, error string`` to rows with WAV files: PCM16 resampled to ``rate``.

    A null file gives null PCM; a damaged or foreign file gives null PCM and the reason in ``error``. A file without
    samples gives empty PCM.  All other columns stay; of those named like a new one, the new one stays.
    With ``halves``, ``pcm_even binary, pcm_odd binary`` of :func:`split_pcm` stand in place of ``pcm``.
    """
    signal = ["pcm_even", "pcm_odd"] if halves else ["pcm"]
    keep = [c for c in media.columns if c not in (*signal, "pcm_rate", "error")]
    schema = StructType([*media.select(*keep).schema.fields, *(StructField(c, BinaryType()) for c in signal), StructField("pcm_rate", IntegerType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, column):
                pcm, errors = [], []
                for x in c.column(column):
                    blob, error = x.as_py(), None
                    try:
                        if blob is not None:
                            tag, own, align, payload = parse_wav(blob)
                            blob = resample(to_pcm(tag, align, payload), rate, own).tobytes()
                    except ValueError as e:
                        blob, error = None, str(e)
                    pcm.append(blob)
                    errors.append(error)
                rates = pa.array([None if x is None else rate for x in pcm], pa.int32())
                stored = zip(*((None, None) if x is None else split_pcm(x) for x in pcm)) if halves else [pcm]
                yield pa.RecordBatch.from_arrays([*c.columns, *(pa.array(x, pa.binary()) for x in stored), rates, pa.array(errors, pa.string())], [*c.schema.names, *signal, "pcm_rate", "error"])

    return media.select(*keep).mapInArrow(tidy(run), schema)


def store_media(media: DataFrame, path: str, column: str = "media", rate: int = WIDE_RATE, halves: bool = False) -> None:
    """Writes the rows with their files and the resampled PCM of :func:`decode_telephony` to a folder of Parquet files.

    Samples repeat as the words of a text do, so large pages are compressed rather than dictionary-encoded; small row groups bound the writer's memory.
    """
    layout = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20), "parquet.page.size": str(4 << 20)}
    decode_telephony(media, column, rate, halves).write.options(**layout).parquet(path)


def encode_payloads(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", codec: int = MULAW) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as the samples of a WAV file.

    Null and empty texts give 64 zero bytes.  Repeated rows repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                data, offsets = text_buffers(c.column("text"))
                raw = data.tobytes()
                blobs = []
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    size = max(BLOCK, -(-(e - s) // BLOCK) * BLOCK)
                    blobs.append(wav(raw[s:e].ljust(size, b"\0"), codec, align=BLOCK if codec == IMA_ADPCM else 1, bits=4 if codec == IMA_ADPCM else 8))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(np.diff(offsets)), pa.array(blobs, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def _features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Per payload: level by either law, zero crossings, level of the payload read as ADPCM blocks, checksum of its PCM at 16 kHz."""
    out = []
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    level = np.abs(decode_adpcm(blocks).astype(np.int32)).sum(axis=1)
    at = 0
    for p, stored in zip(payloads, pcm):
        x = np.frombuffer(p, np.uint8)
        mu = MULAW_PCM[x]
        counts = np.bincount(x, minlength=256)
        size_mu = int(counts @ np.abs(MULAW_PCM.astype(np.int64)))
        size_a = int(counts @ np.abs(ALAW_PCM.astype(np.int64)))
        crossings = int(np.count_nonzero((mu[1:] ^ mu[:-1]) < 0))
        n = len(p) // BLOCK
        adpcm = int(level[at : at + n].sum())
        at += n
        out.append(f"mu={size_mu // len(p)};a={size_a // len(p)};zc={crossings};adpcm={adpcm // (n * (1 + 2 * (BLOCK - 4)))};pcm16k={zlib.crc32(stored)}")
    return out


def describe_media(media: DataFrame) -> DataFrame:
    """Describes stored files of :func:`encode_payloads` and their PCM (``doc_id, n_bytes, media, pcm_rate`` and ``pcm`` or its halves); see :func:`op10_telephony` for the columns.

    The feature is about PCM at 16 kHz: what is stored at that rate is taken as it is, other rates are resampled.  Every file must be a readable one with whole blocks of 64 bytes; rows that :func:`store_media` marked with an error do not belong here.
    """

    signal = ["pcm"] if "pcm" in media.columns else ["pcm_even", "pcm_odd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "media"):
                blobs = c.column("media").to_pylist()
                payloads = [parse_wav(x)[3] for x in blobs]
                stored = [c.column(k).to_pylist() for k in signal]
                pcm = stored[0] if len(stored) == 1 else map(join_pcm, *stored)
                pcm = [x if r == WIDE_RATE else resample(np.frombuffer(x, "<i2"), WIDE_RATE, r).tobytes() for x, r in zip(pcm, c.column("pcm_rate").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), c.column("n_bytes"), pa.array([len(x) for x in payloads], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payloads]),
                     pa.array([zlib.crc32(x[-BLOCK:]) for x in payloads], pa.int64()), pa.array([len(x) for x in blobs], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in blobs]), pa.array(_features(payloads, pcm))],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media", "pcm_rate", *signal).mapInArrow(tidy(run), columns)


def op10_telephony(spark, sf_dir: str) -> DataFrame:
    """Contract query: every text as a mu-law WAV file at 8 kHz, stored with its PCM resampled to 16 kHz, read back and described.

    The PCM is stored in halves, as it takes too much disk beside the files otherwise (see the README).
    """
    path = new_path(spark, "telephony")
    store_media(encode_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet")), path, halves=True)
    return describe_media(spark.read.parquet(path))


def telephony_payloads(spark, sf_dir: str) -> DataFrame:
    """Sizes and digest of the payloads, the part of op10 that SQL can express."""
    return op10_telephony(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


PAYLOAD_SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (
  SELECT doc_id, octet_length(b) AS n_bytes, greatest(64, (octet_length(b) + 63) // 64 * 64) AS payload_bytes, b FROM t
)
SELECT doc_id, n_bytes, payload_bytes, sha256(b || encode(repeat(chr(0), CAST(payload_bytes - n_bytes AS INTEGER)))) AS payload_sha256, payload_bytes + 58 AS media_bytes FROM p
"""
