"""Personal data: patterns propose spans, checksums confirm them, context words move their scores.

Proposals are kept when a validator confirms them (length, range, Luhn, mod-97) and their
score reaches ``min_score``.  The four base kinds have fixed rules and always stay.  Added
kinds (IBANs confirmed by mod-97, and numbers of 7 to 15 digits without a country code or
of 13 to 15 digits passing Luhn) need a context word close by unless their
checksum is strong enough alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import find_spans, Span, Taken

#: Kinds in the order of the contract, then the added ones.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "local_phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts, so the look-behind changes no result; with
# possessive runs it keeps long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[\x20.-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])")

#: Characters on each side of a span in which context words count.
CONTEXT_CHARS = 40
#: Context words and what they add to the score of a kind (fixed values).
CONTEXT = {
    "email": ({"email", "mail", "e-mail", "contact", "write"}, 0.1),
    "ip": ({"ip", "address", "host", "server", "login"}, 0.1),
    "card": ({"card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"}, 0.2),
    "phone": ({"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"}, 0.2),
    "iban": ({"iban", "account", "bank", "konto", "compte", "cuenta"}, 0.2),
    "short_card": ({"card", "visa", "amex", "credit", "payment", "karte", "carte", "tarjeta"}, 0.4),
    "local_phone": ({"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"}, 0.4),
}
#: Score of a confirmed proposal without context (fixed values).
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "short_card": 0.3, "local_phone": 0.2}
_CONTEXT_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an IBAN: moved to the end, letters as 10 to 35, the number is 1 modulo 97."""
    rest = 0
    for c in account[4:] + account[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches are anchored at each @: what precedes it in the local alphabet back to the last @ or match is the local part."""
    at, floor = text.find("@"), 0
    while at >= 0:
        head = text[floor:at]
        local = len(head) - len(head.rstrip(_LOCAL))
        floor = at + 1
        if local and (m := _DOMAIN.match(text, at)):
            yield at - local, m.end()
            floor = m.end()
        at = text.find("@", floor)


def _ip_ok(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in s.split("."))


def _scored(kind: str, text: str, start: int, end: int) -> float:
    near = _CONTEXT_WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower())
    words, gain = CONTEXT[kind]
    return min(1.0, PRIOR[kind] + gain * any(w in words for w in near))


def find_pii(text: str, min_score: float = 0.5) -> list[Span]:
    """All spans of one text."""
    out: list[Span] = []

    def base(kind: str, start: int, end: int) -> None:
        out.append((kind, start, end, _scored(kind, text, start, end), True))

    for s, e in _emails(text):
        base("email", s, e)
    for m in _IP.finditer(text):
        if _ip_ok(m[0]):
            base("ip", *m.span())
    short = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            if len(d) >= 16:
                base("card", *m.span())
            else:
                short.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                base("phone", *m.span())

    taken = Taken([(s, e) for _, s, e, _, _ in out])

    def add(kind: str, spans: Iterator[tuple[int, int]]) -> None:
        """Spans of one kind, which do not overlap one another, where nothing is taken."""
        new = [(kind, s, e, score, False) for s, e in spans if not taken.meets(s, e) and (score := _scored(kind, text, s, e)) >= min_score]
        out.extend(new)
        taken.add([y[1:3] for y in new])

    add("iban", (m.span() for m in _IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)))
    add("short_card", short)
    add("local_phone", (m.span() for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15))
    return out


_RANK = {k: i for i, k in enumerate(KINDS)}


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns ``doc_id, found, counts, base_sha256, spans``, one row per input row (see :func:`spans.find_spans`);
    ``found`` has kind, start, end (code points), score and whether the span is one of the base kinds.

    Null and empty texts have no spans.  Repeated rows give repeated results; ids are not looked at.  Other
    columns are ignored.  The time grows with the length of the text.
    """
    return find_spans(docs, lambda t: find_pii(t, min_score), lambda y: (_RANK[y[0]], y[1]), BASE_KINDS, doc_id, text)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the spans of every document."""
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, "base_sha256", "spans")


def pii_base_counts(spark, sf_dir: str) -> DataFrame:
    """Numbers of base spans by kind, the part of op5 that SQL can express."""
    return op5_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE_KINDS])


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
         list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS card,
         list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) AS phone FROM t
)
SELECT doc_id, len(email) AS n_email,
       len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256) > 255)) = 0)) AS n_ip,
       len(list_filter(card, lambda x: len(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(x) + 1),
         lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[i] AS INTEGER) WHEN CAST(x[i] AS INTEGER) > 4 THEN 2 * CAST(x[i] AS INTEGER) - 9 ELSE 2 * CAST(x[i] AS INTEGER) END)) % 10 = 0)) AS n_card,
       len(list_filter(phone, lambda n: n BETWEEN 8 AND 15)) AS n_phone
FROM m
"""
