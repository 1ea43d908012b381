"""Toxicity by noisy-channel deobfuscation: restore the text, then score it.

Suspect stretches (tokens that mix letters with signs that stand for letters, at their ends too, letters spelt
out with separators, letters repeated three times or more) become character lattices: every written character has the letters that it may stand for, a run
may stand for one letter or two, a separator for itself or for nothing, each with its channel probability.
Viterbi decoding finds the likeliest reading under an interpolated trigram model of characters, which is
counted over the texts of all documents. Everything else reads as written.

Evidence is words and word beginnings of the written and the restored text, and beginnings that many different
words of the text have (MANY, and one in SPARSE of its words). A logistic regression with weights of 0 or more
sums it up; and a word that nearly only toxic rows have is enough by itself: the score is the larger of the
regression's and the highest precision of a piece of evidence, which is shrunk towards the share of toxic rows
by SHRINK rows. Both are fitted on about `sample` labelled rows of each class at most, chosen by a digest of the
id. Toxic and clean rows are counted and compared as tables; of the `keep` best pieces of evidence those make the
model that explain rows of their own or have a precision of SURE.
Only the text enters a score. Texts are read whole.

Defined cases: a null or empty text scores as one without evidence; with no label to learn from every score
is 0; labels that are null or neither 0 nor 1 are ignored, and of several labels of one id the largest
counts; repeated rows score alike; columns other than doc_id, text and toxic are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out
from .textops import portions

LETTERS = re.compile(r"[^\W\d_]+")
_LEET = "0-9@$!|+*€"
_CORE = re.compile(rf"[^\W\d_][{_LEET}]{{1,3}}[^\W\d_]")
# at an end a sign may also be punctuation or a number: one or two of those that seldom are
_LEAD = re.compile(r"(?<![^\s(\[{'\",.:;])[0-9@$!|+€]{1,2}[^\W\d_]{2}")
_TAIL = re.compile(r"[^\W\d_][0-9@$+€]{1,2}(?=[.,;:!?\"')\]}#%&]*\s)")
_RUN = re.compile(r"([^\W\d_])\1\1")
_BETWEEN = " .-_*/~,:;=\\"
_SPELT = re.compile(r"(?<![^\W_])[^\W_](?:(?: {1,3}|[.\-_*/~,:;=\\])[^\W_]){2,}(?![^\W_])")
_EDGE = ".,;:!?\"'()[]{}<>#%&*$|"
_LEFT = ".,;:?\"'()[]{}<>#%&*"
CHANNEL = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
_SYMBOLS = 64
PREFIXES = (4, 5, 6, 7)
MANY, SPARSE = 3, 100
SHRINK = 6
SURE = 0.9

_TABLE = np.zeros(0x250, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
    _TABLE[ord(_c)] = _i
for _i in range(0xDF, 0x250):
    _TABLE[_i] = 27 + (_i - 0xDF) % 36


def symbols(text: str) -> np.ndarray:
    """Letters of lower-case text as numbers from 1 to 62, other scripts' as 63, anything else as 0 (a boundary)."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(x < 0x250, _TABLE[np.minimum(x, 0x24F)], 63 * (x > 0x2AF))


def trigram_counts(texts: list[str]) -> np.ndarray:
    x = symbols(" " + "  ".join(texts).lower() + " ")
    return np.bincount(x[:-2] * _SYMBOLS**2 + x[1:-1] * _SYMBOLS + x[2:], minlength=_SYMBOLS**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b) of the interpolated trigram model, flat."""
    c3 = counts.reshape((_SYMBOLS,) * 3).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + _SYMBOLS)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).ravel()


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """Alternatives (letters, log channel probability) of each run of equal characters; spelt: separators may go."""
    spelt = bool(_SPELT.fullmatch(stretch))
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", stretch, re.S):
        run, c = m.group(0), m.group(1)
        if spelt and c in _BETWEEN:
            out.append([("", math.log(0.7)), (" ", math.log(0.3))])
            continue
        if c == "*":
            reads = [(chr(97 + k), math.log(1 / 26)) for k in range(26)]
        elif c in CHANNEL:
            reads = [(r, math.log(0.9 / len(CHANNEL[c]))) for r in CHANNEL[c]]
        elif c.isalpha():
            reads = [(c, math.log(0.98))]
        else:
            reads = [(" ", 0.0)]
        if len(run) == 1 or not reads[0][0].strip():
            out.append(reads)
        else:
            once, twice = (0.5, 0.5) if len(run) > 2 else (0.2, 0.8)
            out.append([(r * k, p + math.log(w)) for r, p in reads for k, w in ((1, once), (2, twice))])
    return out


def viterbi(units: list[list[tuple[str, float]]], model: list[float]) -> str:
    """The likeliest reading; a state is the last two symbols."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    codes: dict[str, tuple[int, ...]] = {}
    for alternatives in [*units, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for letters, cost in alternatives:
            if letters not in codes:
                codes[letters] = tuple(symbols(letters).tolist())
            for (a, b), (p, read) in states.items():
                p += cost
                for c in codes[letters]:
                    p += model[(a * _SYMBOLS + b) * _SYMBOLS + c]
                    a, b = b, c
                if (a, b) not in after or p > after[a, b][0]:
                    after[a, b] = (p, read + letters)
        states = after
    return max(states.values())[1].rstrip(" ")


def suspects(text: str) -> set[str]:
    """Suspect stretches of lower-case text."""
    out: set[str] = set()
    padded = f" {text} "

    def token(at: int) -> None:
        i, j = at, at
        while not padded[i - 1].isspace():
            i -= 1
        while not padded[j].isspace():
            j += 1
        core = padded[i:j].rstrip(_EDGE.replace("$", "")).lstrip(_LEFT)
        if core:
            out.add(core)

    for pattern in (_CORE, _LEAD, _TAIL, _RUN):
        at = 0
        while m := pattern.search(padded, at):
            token(m.start() if not padded[m.start()].isspace() else m.start() + 1)
            at = m.end()
            while not padded[at - 1].isspace() and at < len(padded) and not padded[at].isspace():
                at += 1
    out.update(m.group(0) for m in _SPELT.finditer(text) if sum(c.isalpha() for c in m.group(0)) > 1)
    return out


class Reader:
    """Words of a text and of its restored stretches; remembers what it decoded."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known: dict[str, str] = {}

    def restore(self, stretch: str) -> str:
        if stretch not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[stretch] = viterbi(lattice(stretch), self.model)
        return self.known[stretch]

    def words(self, text: str) -> set[str]:
        lower = text.lower()
        words = set(LETTERS.findall(lower))
        for s in suspects(lower):
            words.update(LETTERS.findall(self.restore(s)))
        return words


def features(words: set[str]) -> set[str]:
    """Evidence in the words of a text: each word, its beginnings, and beginnings that many of the words have."""
    begin = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
    most = max(MANY, len(words) / SPARSE)
    return {"=" + w for w in words} | begin.keys() | {p + "+" for p, n in begin.items() if n >= most}


@dataclass
class Scorer:
    lm: np.ndarray
    weights: dict[str, float]
    precision: dict[str, float]
    bias: float
    reader: Reader | None = field(default=None, repr=False)
    seen: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict, repr=False)

    def evidence(self, text: str) -> set[str]:
        """Weighted features of a text."""
        self.reader = self.reader or Reader(self.lm)
        found: set[str] = set()
        seen, weights = self.seen, self.weights
        if len(seen) > 100_000:
            seen.clear()
        words = self.reader.words(text)
        begin: dict[str, int] = {}
        for w in words:
            f = seen.get(w)
            if f is None:
                starts = [w[:k] for k in PREFIXES if len(w) > k]
                f = seen[w] = (tuple(x for x in ("=" + w, *starts) if x in weights), tuple(p for p in starts if p + "+" in weights))
            if f[0]:
                found.update(f[0])
            for p in f[1]:
                begin[p] = begin.get(p, 0) + 1
        most = max(MANY, len(words) / SPARSE)
        found.update(p + "+" for p, n in begin.items() if n >= most)
        return found

    def score(self, text: str | None) -> float:
        found = self.evidence(text or "")
        z = self.bias + sum(sorted(self.weights[f] for f in found))
        return max(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), max((self.precision[f] for f in found), default=0.0))


def regress(rows: list[list[int]], y: np.ndarray, many: int, l2: float = 1.5e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature numbers, weights of 0 or more (projected Adam)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([f for r in rows for f in r], np.int64)
    w, b = np.zeros(many + 1), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[col], len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(col, err[at], many), err.sum()) / len(y)
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def cover(rows: list[list[int]], clean: list[float], least: int = 2, part: float = 0.002) -> list[int]:
    """Features, in order, that explain toxic rows which none of those taken before is in: at least `least` such rows, `part` of all its own, and as many as it has clean rows."""
    many = len(clean)
    of: list[list[int]] = [[] for _ in range(many)]
    for k, row in enumerate(rows):
        for f in row:
            of[f].append(k)
    explained = np.zeros(len(rows), bool)
    taken = []
    for f in range(many):
        new = sum(not explained[k] for k in of[f])
        if new >= max(least, part * len(of[f]), clean[f]):
            taken.append(f)
            explained[of[f]] = True
    return taken


def _model_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over the texts of all documents; the table has a fixed number of places."""

    def each(batches):
        total = np.zeros(_SYMBOLS**3, np.int64)
        for b in portions(batches):
            held, size = [], 0
            for t in b.column(0).to_pylist():
                if t:
                    held.append(t)
                    size += len(t)
                if size > 1 << 19:
                    total += trigram_counts(held)
                    held, size = [], 0
            if held:
                total += trigram_counts(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(each, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SYMBOLS**3, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, min_rows: int = 5, keep: int = 3_000, tag: str = "toxicity") -> Scorer | None:
    """Learn from labels (doc_id, toxic), only those whose id isn't held out; the language model reads all docs."""
    spark = docs.sparkSession
    lm = language_model(_model_counts(docs))
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    digest = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    part = F.when(F.col("toxic") == 1, F.lit(sample / max(1, sizes.get(1, 1)))).otherwise(F.lit(sample / max(1, sizes.get(0, 1))))
    chosen = cut(known.where(digest < part), f"{tag}-chosen")  # about 2 * sample ids at most
    rows = cut(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int")), f"{tag}-sample")
    rows = rows.repartition(max(8, spark.sparkContext.defaultParallelism))
    if not sizes.get(1) or not sizes.get(0):
        return Scorer(lm, {}, {}, -10.0 if sizes.get(0) else 0.0) if sizes else None
    shared_lm = spark.sparkContext.broadcast(lm)

    def count(wanted: int) -> DataFrame:
        """Rows of a class by piece of evidence: f, n."""

        def each(batches):
            reader, n = Reader(shared_lm.value), {}
            for b in portions(batches):
                for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if toxic == wanted:
                        for f in features(reader.words(text)):
                            n[f] = n.get(f, 0) + 1
                        if len(n) > 200_000:  # sums are added up later; memory stays bounded
                            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])
                            n = {}
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

        return rows.mapInArrow(each, "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))

    n1 = max(1, min(sizes[1], sample))
    n0 = max(1, min(sizes[0], sample))
    both = count(1).where(F.col("n") >= min_rows).withColumnRenamed("n", "a").join(count(0).withColumnRenamed("n", "b"), "f", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    p, q = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    best = both.where(p > 4 * q).orderBy(F.desc(F.round(F.col("a") * F.log(p / q), 6)), F.desc(F.length("f")), "f").limit(keep)
    found = best.collect()  # the model's pieces of evidence, `keep` at most
    toxic, clean = {r["f"]: r["a"] for r in found}, {r["f"]: r["b"] for r in found}
    names = [r["f"] for r in found]
    place = {f: i for i, f in enumerate(names)}

    def active(batches):
        reader = Reader(shared_lm.value)
        for b in portions(batches):
            found = [sorted(place[f] for f in features(reader.words(t)) & place.keys()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], ["f", "toxic"])

    data = [(r["f"], r["toxic"]) for r in rows.mapInArrow(active, "f array<int>, toxic int").orderBy("toxic", "f").collect()]  # feature numbers of the sample
    scale = (sizes[0] / n0) / (sizes[1] / n1)
    share = sizes[1] / (sizes[0] + sizes[1])
    sure = {f: (toxic[f] + SHRINK * share) / (toxic[f] + clean[f] * scale + SHRINK) for f in names}
    # what explains rows of its own, and what is sure by itself
    telling = sorted({*cover([f for f, t in data if t == 1], [clean[f] * scale for f in names]), *(i for i, f in enumerate(names) if sure[f] >= SURE)})
    names = [names[i] for i in telling]
    again = {i: k for k, i in enumerate(telling)}
    w, bias = regress([[again[i] for i in f if i in again] for f, _ in data], np.array([t for _, t in data], float), len(names))
    # the sample's share of toxic rows isn't the labels'
    bias += math.log(sizes[1] / sizes[0]) - math.log(n1 / n0)
    told = {f: float(x) for f, x in zip(names, w) if x > 1e-3 or sure[f] > 0.5}
    return Scorer(lm, told, {f: sure[f] for f in told}, bias)


def score(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def each(batches):
        s = shared.value
        for b in portions(batches):
            found = [s.score(t) if s else 0.0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that aren't held out and score all documents: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
