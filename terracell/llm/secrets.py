"""Secret scan: named patterns plus a battery of randomness tests.

Candidates are long tokens.  The narrowest alphabet that holds a token is its inferred
encoding (decimal, hex, letters, base32, base36, base62, base64, printable).  Three tests ask whether the token looks drawn
uniformly from that alphabet: chi-squared uniformity of its symbols, a runs test of
the upper half against the lower half, and the serial correlation of neighbours.  Their
p-values are combined by Fisher's method.  The likelihood of a uniform draw over that of
ordinary text is an e-value; times the battery's p-value, which is at most 1, it still is
one, and a token that the battery doubts needs that much more evidence.  ``1/e`` bounds the p-value of ordinary
text reaching it, and falls with the length of the token.  The candidates of a document
are then accepted by the Benjamini-Hochberg rule at level ``fdr``, with weights by length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import find_spans, Span, Taken

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 16 or more are the maximal runs with 16 or more characters.
_HEX = re.compile(r"[0-9a-f]{16,}+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from narrow to wide; the order of symbols is used by the runs and serial tests.
ENCODINGS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("hex_upper", _DIGITS + "ABCDEF"), ("upper", _UPPER), ("lower", _LOWER), ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER), ("base36_upper", _DIGITS + _UPPER), ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/="), ("base64url", _UPPER + _LOWER + _DIGITS + "-_="), ("printable", _UPPER + _LOWER + _DIGITS + "+/_=-"),
)
_RANKS = [(name, {c: i for i, c in enumerate(a)}, frozenset(a)) for name, a in ENCODINGS]

#: Ordinary text: letters follow the previous character's class with these probabilities (fixed values).
_STAY = {"l": {"l": 0.95, "u": 0.01, "d": 0.01, "s": 0.03}, "u": {"l": 0.70, "u": 0.26, "d": 0.02, "s": 0.02}, "d": {"l": 0.03, "u": 0.02, "d": 0.90, "s": 0.05}, "s": {"l": 0.55, "u": 0.15, "d": 0.15, "s": 0.15}}
#: A word in capitals goes on in capitals with this probability, as one in small letters does (fixed value).
_CAPITALS = 0.95
#: Letters of ordinary text in per mille (fixed values).
_LETTER = dict(zip(_LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))


def encoding(token: str) -> tuple[str, dict[str, int]]:
    held = set(token.rstrip("=")) or {"="}
    return next((n, r) for n, r, a in _RANKS if held <= a)


def _normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> dict[str, float]:
    """p-values of the three tests under a uniform draw from the inferred alphabet."""
    _, rank = encoding(token)
    x = [rank[c] for c in token.rstrip("=")]
    n, k = len(x), len(rank)
    if n < 2:
        return {"chi2": 1.0, "runs": 1.0, "serial": 1.0}
    # With few symbols per cell, chi-squared is compared with its exact mean and variance under the uniform law.
    chi2 = sum(c * c for c in Counter(x).values()) * k / n - n
    variance = 2 * (k - 1) * (1 - 1 / n)
    p_chi2 = 0.5 * math.erfc((chi2 - (k - 1)) / math.sqrt(2 * variance)) if variance else 1.0
    high = [2 * v >= k for v in x]
    a = sum(high)
    b = n - a
    if a and b and n > 2:
        runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    r = sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / spread if spread else 1.0
    return {"chi2": p_chi2, "runs": p_runs, "serial": _normal_tail((r + 1 / n) * math.sqrt(n))}


def _kind(c: str) -> str:
    return "l" if c in _LETTER else "d" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "s"


def evidence(token: str) -> float:
    """log of (likelihood under a uniform draw) / (likelihood under ordinary text)."""
    name, rank = encoding(token)
    total, last = 0.0, "s"
    kinds = [_kind(c) for c in token]
    capitals = set(kinds) == {"u"}
    for c, k in zip(token, kinds):
        p = (_CAPITALS if capitals and last == "u" else _STAY[last][k]) * (_LETTER[c.lower()] / 1001 if k in "lu" else 0.1 if k == "d" else 0.2)
        total -= math.log(len(rank)) + math.log(p)
        last = k
    return total


def combined(p_values: list[float]) -> float:
    """Fisher's combination of three p-values: minus twice the sum of logarithms is chi-squared with six degrees of freedom."""
    x = -sum(math.log(max(p, 1e-300)) for p in p_values)
    return math.exp(-x) * (1 + x + x * x / 2)


def random_tokens(text: str, fdr: float) -> list[tuple[int, int, float]]:
    """Tokens accepted as random: start, end and q-value."""
    seen = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        e = evidence(t)
        # The battery can only lower the evidence, so tokens without any need no test.
        p = 1.0 if e <= 0 else min(1.0, math.exp(-e) / max(combined(list(battery(t).values())), 1e-300))
        seen.append((p, len(t), m.start(), m.end()))
    if not seen:
        return []
    mean = sum(n for _, n, _, _ in seen) / len(seen)
    ranked = sorted((p * mean / n, s, e) for p, n, s, e in seen)
    q, out = 1.0, []
    for i in range(len(ranked), 0, -1):
        p, s, e = ranked[i - 1]
        q = min(q, p * len(ranked) / i)
        if q <= fdr:
            out.append((s, e, q))
    return out


def find_secrets(text: str, fdr: float = 1e-4) -> list[Span]:
    out: list[Span] = []
    lower = text.lower() if (":" in text or "=" in text) else ""
    if lower and any(x in lower for x in _NAMES):
        out += [("assign", *m.span(), 1.0, True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span(), 1.0, True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span(), 1.0, True) for m in _HEX.finditer(text)]
    taken = Taken([(s, e) for _, s, e, _, _ in out])
    out += [("random", s, e, 1.0 - q, False) for s, e, q in random_tokens(text, fdr) if not taken.meets(s, e)]
    return out


_RANK = {k: i for i, k in enumerate(KINDS)}


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = 1e-4) -> DataFrame:
    """Secrets in every whole text.

    ``fdr``: level at which the random tokens of a document are controlled.  Returns ``doc_id, found, counts, base_sha256,
    spans``, one row per input row (see :func:`spans.find_spans`).

    Null and empty texts have no spans.  Repeated rows give repeated results; ids are not looked at.  Other
    columns are ignored.  The time grows with the length of the text.
    """
    return find_spans(docs, lambda t: find_secrets(t, fdr), lambda y: (y[1], _RANK[y[0]]), BASE_KINDS, doc_id, text)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the secrets of every document."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, "base_sha256", "spans")


def secret_base_counts(spark, sf_dir: str) -> DataFrame:
    """Numbers of base spans by kind, the part of op8 that SQL can express."""
    return op8_secrets(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE_KINDS])


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 12)) AS n_assign,
       len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) AS n_access,
       len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: len(x) >= 16)) AS n_hex
FROM t
"""
