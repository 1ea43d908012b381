"""Small tables with the awkward rows that every operator must take, and brute-force versions."""

import hashlib
import random
import re

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score double, copy int"


def docs(spark, rows):
    """rows of (doc_id, text, lang, source); the further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 0.5, 7) for i, t, la, s in rows], DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """Nulls in any column, empty, blank and very long texts, equal rows."""
    long = prose(1, 30_000)
    return [
        (1, "The quick brown fox.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n", "de", "b"),
        (5, long, "en", "b"),
        (6, prose(2, 80), None, None),
        (6, prose(2, 80), None, None),
        (None, prose(3, 70), "fr", "c"),
        (7, "é ü 漢字 x", "de", "a"),
    ]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_classes(rows, share=0.8):
    """doc_id -> smallest id of its class, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            a, b = sets[i], sets[j]
            if t is not None and (t == u or (a and b and len(a & b) >= share * len(a | b))):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def cut_windows(rows, length):
    """doc_id -> (n_words, n_removed, sha256) by looking at every window."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                keep[k : k + length] = [False] * length
        kept = [x for x, ok in zip(w, keep) if ok]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
