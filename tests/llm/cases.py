"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter

SPACE = r"[^\x20\x09-\x0D]+"
#: Names that the operators use inside; tables may have columns of these names too.
CLASH = ("size", "score", "n_words", "start", "key", "rep", "band", "node", "places", "h", "row", "keeper", "media", "spans", "_id", "_row", "copies", "target", "class_id", "hit", "matches", "docs", "pos", "label", "part")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)

PASSAGE = "Released under the terms of the licence that comes with this very corpus and may be copied without any fee by anyone who keeps this notice"


def texts(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "ka lo mi nu té zo ra ße" .split() for b in "n r st ll q x".split()]
    rows, i = [], 0

    def add(text, source="a"):
        nonlocal i
        rows.append((i, text, "en", source))
        i += 1

    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    base = words(120)
    for k in range(30):
        add(" ".join(words(rng.randrange(1, 80))), rng.choice("abc"))
    for k in range(6):  # near copies
        w = list(base)
        if k:
            w[rng.randrange(len(w))] = f"edit{k}"
        add(" ".join(w), "a")
    for k in range(5):  # exact copies, and a shared passage between own words
        add(" ".join(base), "b")
        add("\n".join([" ".join(words(12)), PASSAGE, " ".join(words(9)), "  " + PASSAGE.upper() + "\t"]), None if k % 2 else "c")
    add("", "a")
    add(None, "b")
    add("   \n\t ", None)
    add("word", "z")
    add("one two three four", "z")
    add("one two three four", "z")
    add(" ".join(["same"] * 200), "y")
    add("a b c d e " * 60, "y")
    add(" ".join(words(30_000)), "long")
    add("x" * 200_000, "long")
    return rows


def frame(spark, rows=None, repeat: bool = True):
    """The cases as documents with extra columns; some rows twice, and a null id."""
    rows = texts() if rows is None else rows
    full = [(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in rows]
    if repeat:
        full += full[3:5] + [(None, "no id here at all", None, None, None, *CLASH)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(SPACE, text or "")


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, threshold=0.8):
    """{id: (class, links)} by comparing every pair."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}
    links = Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in ids}
