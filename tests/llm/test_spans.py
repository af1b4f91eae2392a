from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases

from terracell.llm import pii, secrets
from terracell.llm.spans import Taken

SEEDS = list("ab1 .+-@%_:=/()\n'\"") + ["a.b@c.de", "192.168.1.300", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "AKIA", "password", "Secret", "api_key", "0123456789abcdef", "ſ", "é", "1.2.3.4.5", "IBAN DE89370400440532013000"]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def plain_secrets(t):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    found = [(m.start(), i, (k, *m.span())) for i, (k, p, ok) in enumerate(rules) for m in p.finditer(t) if ok(m)]
    return [x for _, _, x in sorted(found)]


def samples(n=3000):
    rng = random.Random(7)
    return ["".join(rng.choice(SEEDS) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_base_spans_of_pii():
    for t in samples():
        found = sorted(pii.find_pii(t), key=lambda y: (pii._RANK[y[0]], y[1]))
        assert [y[:3] for y in found if y[4]] == plain_pii(t), t


def test_base_spans_of_secrets():
    for t in samples():
        found = sorted(secrets.find_secrets(t), key=lambda y: (y[1], secrets._RANK[y[0]]))
        assert [y[:3] for y in found if y[4]] == plain_secrets(t), t


def test_validators_and_context():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    kinds = lambda t: [y[0] for y in pii.find_pii(t)]
    assert kinds("Konto IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("DE89370400440532013001") == []
    assert kinds("call me: (030) 1234567") == ["local_phone"] and kinds("lines 030 1234567") == []
    assert kinds("amex card 378282246310005") == ["short_card"] and kinds("id 378282246310005") == []
    near, far = (pii.find_pii(t)[0][3] for t in ("tel +49 30 1234567", "abc +49 30 1234567"))
    assert near > far


def test_random_tokens_against_words():
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hits = sum(any(y[0] == "random" for y in secrets.find_secrets("key is " + "".join(rng.choice(alphabet) for _ in range(40)) + " ok")) for _ in range(200))
    assert hits >= 190
    vocab = "internationalization transformation configuration documentation repository management application-development_environment".split()
    wrong = sum(any(y[0] == "random" for y in secrets.find_secrets(" ".join("_".join(rng.choices(vocab, k=3)) for _ in range(5)))) for _ in range(200))
    assert wrong == 0


def test_battery_rejects_patterns():
    assert min(secrets.battery("ab12" * 12).values()) < 1e-3
    assert secrets.encoding("deadbeef01")[0] == "hex" and secrets.encoding("ABCDEFGHIJ234567")[0] == "base32" and secrets.encoding("aB3_")[0] == "base64url"


@pytest.mark.parametrize("find, plain", [(pii.pii_spans, plain_pii), (secrets.secret_spans, plain_secrets)])
def test_awkward_rows(spark, find, plain):
    rows = [(i, t, "en", "a") for i, t in enumerate(samples(200))] + [(5000, "@" * 5000 + "a@b.c" * 100, "en", "a"), (5001, "1." * 10_000, "en", "a"), (5002, "9" * 20_000, "en", "a"), (5003, "a" * 20_000, "en", "a"), (5004, None, None, None), (5005, "", None, None)]
    df = cases.frame(spark, rows)
    got = find(df).collect()
    assert len(got) == df.count()
    by_id = {i: t or "" for i, t, *_ in rows}
    for r in got:
        if r["doc_id"] is not None:
            want = ",".join(f"{k}:{s}:{e}" for k, s, e in plain(by_id[r["doc_id"]]))
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert r["spans"] == ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["found"])
            assert sum(r["counts"]) == sum(x["base"] for x in r["found"])
    assert find(cases.empty(spark)).collect() == []


def test_keys_of_one_kind_of_character():
    rng = random.Random(11)
    for alphabet, n in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 40), ("abcdefghijklmnopqrstuvwxyz", 40), ("0123456789", 120)):
        keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(50)]
        assert sum(bool(secrets.random_tokens(f"the key {k} is here", 1e-4)) for k in keys) > 25
    for w in ("COUNTERREVOLUTIONARIES", "donaudampfschifffahrtsgesellschaft", "INTERNATIONALIZATION", "-" * 40, "=" * 40, "7" * 40, "20240101120000202401"):
        assert not secrets.random_tokens(f"a {w} b", 1e-4)


def plain_added(t, base):
    """Added kinds by their rules, comparing every span with every one before it."""
    out, taken = [], [y[1:3] for y in base]
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = [
        ("iban", pii._IBAN, lambda x: 15 <= len(x := x.replace(" ", "")) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1),
        ("short_card", pii._CARD, lambda x: 13 <= len(digits(x)) < 16 and luhn(digits(x))),
        ("local_phone", pii._LOCAL_PHONE, lambda x: 7 <= len(digits(x)) <= 15),
    ]
    for kind, pattern, ok in rules:
        for m in pattern.finditer(t):
            s, e = m.span()
            near = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", t[max(0, s - pii.CONTEXT_CHARS) : s].lower() + " " + t[e : e + pii.CONTEXT_CHARS].lower())
            score = pii.PRIOR[kind] + (pii.CONTEXT[kind][1] if set(near) & pii.CONTEXT[kind][0] else 0)
            if ok(m[0]) and score >= 0.5 and all(e <= a or b <= s for a, b in taken):
                out.append((kind, s, e))
                taken.append((s, e))
    return out


def test_added_kinds_of_pii():
    more = SEEDS + [" call ", " card ", "030 1234567", "378282246310005", "GB82 WEST 1234 5698 7654 32", " tel "]
    rng, found = random.Random(9), 0
    for _ in range(3000):
        t = "".join(rng.choice(more) * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 14)))
        got = pii.find_pii(t)
        want = plain_added(t, [y for y in got if y[4]])
        assert [y[:3] for y in got if not y[4]] == want, t
        found += len(want)
    assert found > 500


def test_taken_against_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        spans = [(s, s + rng.randrange(1, 9)) for s in rng.choices(range(60), k=rng.randrange(0, 12))]
        t = Taken(spans[:5])
        t.add(spans[5:])
        for s in range(60):
            for e in range(s + 1, s + 6):
                assert t.meets(s, e) == any(a < e and s < b for a, b in spans)


def test_long_lists_take_linear_time():
    line = "call me: (030) 1234567, mail a.b@c.de, tel +49 30 1234567, IBAN DE89370400440532013000; "
    took = []
    for n in (2_000, 20_000):
        began = time.process_time()
        assert len(pii.find_pii(line * n)) == 4 * n
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0]


def test_discovery_control_by_definition():
    """Accepted are the tokens up to the largest rank whose weighted p-value is within its share of the level."""
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    vocab = "internationalization transformation configuration documentation repository management development_environment".split()
    for _ in range(150):
        tokens = [rng.choice(["".join(rng.choices(alphabet, k=rng.randrange(20, 45))), "_".join(rng.choices(vocab, k=2)), "x1" * 12]) for _ in range(rng.randrange(1, 8))]
        text = " ".join(tokens)
        rows = []
        for m in secrets._TOKEN.finditer(text):
            e = secrets.evidence(m[0])
            fisher = -2 * sum(math.log(max(p, 1e-300)) for p in secrets.battery(m[0]).values())
            tail = sum((fisher / 2) ** k / math.factorial(k) for k in range(3)) * math.exp(-fisher / 2)
            rows.append((min(1.0, 1 / (math.exp(e) * tail)) if e > 0 and tail > 0 else 1.0, m.span()))
        mean = sum(b - a for _, (a, b) in rows) / len(rows)
        rows = sorted((p * mean / (b - a), a, b) for p, (a, b) in rows)
        last = max((i for i, (p, _, _) in enumerate(rows, 1) if p <= 1e-4 * i / len(rows)), default=0)
        assert sorted(x[:2] for x in secrets.random_tokens(text, 1e-4)) == sorted((a, b) for _, a, b in rows[:last])


def test_battery_is_fair_to_uniform_tokens():
    rng = random.Random(3)
    low = sum(secrets.combined(list(secrets.battery("".join(rng.choices("0123456789abcdef", k=64))).values())) < 0.01 for _ in range(2000))
    assert low < 80
