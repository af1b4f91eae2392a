from __future__ import annotations

import math
import random
import sys
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import cases

from terracell.llm import toxicity as T


def labelled(n=400, seed=1):
    """Invented prose; toxic documents have insults, some of them from a stem with endings."""
    rng = random.Random(seed)
    vocab = [a + b for a in "ba ko li mu ne".split() for b in "ran tes vil dor".split()]
    out = []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randrange(20, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "grumpf" + rng.choice(["en", "eto", "ia", "us"])])
        out.append((i, " ".join(w) + ".", int(toxic)))
    return out


def frames(spark, rows):
    docs = cases.frame(spark, [(i, t, "en", "a") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (0, None, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_grammar_scores_clauses():
    m = T.Model({"idiot$": 2.0}, [0.0] * 5)
    score = lambda t: sum(m.clause_scores(t)[0])
    assert score("you idiot") > score("an idiot you are") > 2 * score("an idiot") > 2 * score("not an idiot")
    assert score("they said an idiot came") < score("they saw an idiot came")
    assert score("they said it. an idiot came") == score("an idiot came")
    assert score("kill the lights") < score("i will kill you") <= score("you i will kill")
    assert score("nice words only") == 0 and score("idiotic") == 0
    assert score("idiot idiot") < 2 * score("an idiot")


def test_composition_equals_running_in_turn():
    table = T.compose(T.PARTS)
    rng = random.Random(3)
    for _ in range(300):
        labels = rng.choices(T.LABELS, k=12)
        state, states = 0, [0] * len(T.PARTS)
        for label in labels:
            out, weight = label, 1.0
            for i, t in enumerate(T.PARTS):
                states[i], out, f = t.step(states[i], out)
                weight *= f
            state, got = table[state, label]
            assert got == (weight if out in ("insult", "threat") else 0.0)


def by_rules(words, label):
    """Score of a clause read off the rules, without states."""
    total, insults, harms, abuses, addressed = 0.0, 0, 0, 0, False
    for i, w in enumerate(words):
        kind, weight = label(w)
        made, factor = None, 0.0
        if kind == "harm":
            made, factor = "threat", 1.0 if addressed else 0.1
            harms += not addressed
        elif kind == "abuse":
            made, factor = "insult", 1.2 if addressed else 0.5
            abuses += not addressed
        elif kind == "target":
            if harms:
                made, factor, harms = "threat", 0.9, 0
            elif abuses:
                made, factor, abuses = "insult", 0.7, 0
            addressed = True
        if made is None:
            continue
        if any(label(x)[0] == "report" for x in words[:i]):
            factor *= 0.6 if made == "insult" else 0.4
        if any(label(x)[0] == "negation" for x in words[max(0, i - 2) : i]):
            factor *= 0.7 if made == "insult" else 0.3
        if made == "insult":
            factor *= 0.8 if insults else 1.0
            insults += 1
        total += factor * (weight or T.THREAT_WEIGHT)
    return total


def test_scores_against_the_rules():
    m = T.Model({"idiot$": 2.5, "grumpf": 1.7}, [-3.0, 2.0, 1.0, 0.5, 0.7])
    rng = random.Random(5)
    pool = ["idiot", "grumpfen", "grumpf", "kill", "hurt", "you", "they", "not", "never", "said", "called", "tree", "house", "green"]
    for _ in range(400):
        clauses = [rng.choices(pool, k=rng.randrange(0, 9)) for _ in range(rng.randrange(1, 5))]
        text = rng.choice([". ", "; ", "\n"]).join(" ".join(c) for c in clauses)
        got, n = m.clause_scores(text)
        want = [x for c in clauses if any(m.label(w)[0] in ("abuse", "harm") for w in c) and (x := by_rules(c, m.label))]
        assert n == sum(map(len, clauses)) and len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want))
        s = sum(want)
        z = sum(a * b for a, b in zip(m.curve, (1, min(s, 30) / 10, max(want, default=0) / 5, math.log1p(len(want)), min(s / math.sqrt(n + 20), 5))))
        assert abs(m.score(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_entries_are_counted_by_half(spark):
    rows = [(h, t, y) for h, (_, t, y) in enumerate(labelled(120))]
    got = {r["entry"]: tuple(r)[1:] for r in T._count_entries(spark.createDataFrame(rows, "h long, text string, toxic int").repartition(3)).collect()}
    want = {}
    for h, t, y in rows:
        for e in T.doc_entries(t):
            want.setdefault(e, [0, 0, 0, 0])[(0 if y else 2) + h % 2] += 1
    assert got == {e: tuple(c) for e, c in want.items() if c[0] + c[1] >= T.LEAST_DOCS}


def test_stems_that_recur_in_a_document():
    m = T.Model({"grumpf+": 2.0, "idiot$": 3.0}, [0.0] * 5)
    score = lambda t: sum(m.clause_scores(t)[0])
    assert score("one grumpfen here") == score("one grumpfen and grumpfen here") == 0
    assert score("a grumpfen. some grumpfia") == 2 * 0.5 * 2.0 and score("grumpfen, idiot") == 0.5 * 3.0
    assert m.clause_scores("you grumpfen and grumpfia")[0] == [1.2 * 2.0 + 0.8 * 1.2 * 2.0]
    assert {"grum+", "grum", "grumpf+"} <= T.doc_entries("grumpfen Grumpfia") and "grumpf+" not in T.doc_entries("grumpfen grumpfen")


def test_ties_and_covered_entries():
    found = {"grum$": (2.0, 4, 0), "grump": (2.0, 4, 0), "blorp$": (2.0, 4, 0), "rare$": (2.0, 2, 0)}
    held = {"grum$": [1, 2, 3, 4], "grump": [5, 6, 7, 8], "blorp$": [9, 10, 11, 12], "rare$": [1, 2]}
    first = T.choose(found, held, 20, 50)
    assert list(first) == ["blorp$", "grum$", "grump"] and first == T.choose(dict(reversed(found.items())), held, 20, 50)
    stems = {"grumpf": (2.5, 6, 0), "grumpfen$": (2.0, 3, 0)}
    assert list(T.choose(stems, {"grumpf": [1, 2, 3, 4, 5, 6], "grumpfen$": [1, 2, 3]}, 20, 50)) == ["grumpf"]


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (3, "a"), (4, "x" * 100), (5, None), (7, "y" * 60), (8, "z" * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in ((1, 0), (1, 1), (3, 1), (4, 1), (5, 1), (7, 0), (8, 0))], "doc_id long, toxic int")
    usable = [i for i in (1, 3, 4, 7, 8) if zlib.crc32(str(i).encode()) % 4 != 2]
    got = T.labelled_sample(docs, labels, 10, 10, 80).collect()
    assert all(len(r["text"]) <= 80 for r in got) and len({r["text"] for r in got if r["toxic"]}) == len([r for r in got if r["toxic"]])
    assert sum(len(r["text"]) for r in got if not r["toxic"]) <= 80
    everything = T.labelled_sample(docs, labels, 10, 10, 10**6).collect()
    assert len({r["h"] for r in everything}) == len(everything) and len(everything) <= len(usable)


def test_a_text_that_does_not_fit_is_passed_over(spark):
    """Whatever its hash, a text beyond the bound takes no other text of its class with it."""
    rows = [(i, f"you are a gronk number {i}" if i % 2 else f"a calm note number {i}") for i in range(400)]
    usable = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and i % 2]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    for big in usable[:6]:
        docs = spark.createDataFrame([(i, "gronk " * 20_000 if i == big else t) for i, t in rows], "doc_id long, text string")
        got = T.labelled_sample(docs, labels, 1000, 1000, 20_000)
        assert got.where("toxic = 1").count() == len(usable) - 1
    model = T.train(docs, labels, max_bytes=20_000)
    assert model.lexicon != T.SEED and model.score("you are a gronk") > 0.5 > model.score("a calm note")


def test_held_out_accuracy(spark):
    rows = labelled()
    docs, labels = frames(spark, rows)
    model = T.train(docs.select("doc_id", "text"), labels)
    assert any(e.startswith("grum") for e in model.lexicon)
    scored = T.score_documents(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    truth = {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((got[i] >= T.THRESHOLD) == bool(y) for i, y in truth.items()) >= 0.98 * len(truth)


def test_held_out_rows_do_not_train(spark):
    rows = labelled()
    docs, labels = frames(spark, rows)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, t, y in rows]
    a = T.train(docs.select("doc_id", "text"), labels)
    b = T.train(docs.select("doc_id", "text"), frames(spark, flipped)[1])
    assert (a.lexicon, a.curve) == (b.lexicon, b.curve)


def test_awkward_rows(spark):
    docs, labels = frames(spark, labelled())
    model = T.train(docs, labels)
    df = cases.frame(spark)
    got = T.score_documents(df, model).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    plain = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(plain) == 1 and plain.pop() < T.THRESHOLD
    assert T.score_documents(cases.empty(spark), model).collect() == []


def test_without_labels(spark):
    docs = cases.frame(spark).select("doc_id", "text")
    model = T.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model.score("you pathetic idiot, you worthless scum") > T.THRESHOLD > model.score("good morning")
