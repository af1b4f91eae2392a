"""What the span finders (personal data, secrets) share: running a finder over whole texts and its digests."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import chunks, tidy

#: One found span; offsets are code points, end exclusive.
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

Span = tuple[str, int, int, float, bool]


class Taken:
    """Stretches of a text that are taken, as sorted disjoint intervals."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.add(spans)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, spans: list[tuple[int, int]]) -> None:
        """Takes more stretches; many at once, as each call sorts."""
        merged: list[list[int]] = []
        for s, e in sorted([*zip(self.starts, self.ends), *spans]):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            elif e > s:
                merged.append([s, e])
        self.starts, self.ends = [s for s, _ in merged], [e for _, e in merged]


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def find_spans(docs: DataFrame, finder: Callable[[str], list[Span]], order: Callable[[Span], tuple], kinds: tuple[str, ...], doc_id: str, text: str) -> DataFrame:
    """``doc_id, found, counts, base_sha256, spans``, one row per input row; nothing is shuffled.

    counts: number of base spans of each of ``kinds``.  base_sha256, spans: digests of the base spans and of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                found, counts, digests, told = [], [], [], []
                for x in c.column("text"):
                    s = sorted(finder(x.as_py() or ""), key=order)
                    base = [y for y in s if y[4]]
                    found.append([dict(zip(("kind", "start", "end", "score", "base"), y)) for y in s])
                    counts.append([sum(y[0] == k for y in base) for k in kinds])
                    digests.append(hashlib.sha256(digest(base).encode()).hexdigest())
                    told.append(digest(s))
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(found, _ARROW), pa.array(counts, pa.list_(pa.int64())), pa.array(digests, pa.string()), pa.array(told, pa.string())],
                    ["doc_id", "found", "counts", "base_sha256", "spans"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        tidy(run), f"doc_id long, found {SPAN_TYPE}, counts array<long>, base_sha256 string, spans string"
    )
