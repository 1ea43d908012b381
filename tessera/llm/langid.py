"""Language identification: nearest of several clustered centroids per language, by cosine.

A text's vector counts its byte n-grams in lower case (n = 2 to 4, hashed to `dims` places, anything but
letters read as a space), damped by a logarithm, weighted by inverse document frequency and normalised.
Document frequencies come from all documents that may be learned from. The centroids of a language come
from spherical k-means over a sample of at most about `sample` of its documents, chosen by a digest of the
id. A text takes the language of its nearest centroid. It is rejected where its cosine is below a part
(`reject`) of the 1% quantile of sample texts of that language and about its length, each held against
centroids that were clustered without its part of the sample (four folds). A length class with fewer than
`_NEAR` texts takes in its neighbours; below the shortest sample text the limit falls with the root of the
number of n-grams. A language whose sample can't be split into folds rejects nothing.

Only the text enters a prediction. Texts are read whole; the model that is broadcast has
dims x clusters x languages numbers, whatever the number of documents.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; if nothing can be
learned (no labelled text) all are `und`; ties go to the language that sorts first; repeated rows are
predicted alike; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out
from .textops import portions, slices

_SIGN = re.compile(r"[^\W\d_]")
GRAMS = (2, 3, 4)
_KEEP = np.full(256, 32, np.uint8)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)
_ROWS = 128
_FOLDS = 4
_NEAR = 50
_CLASSES = 40


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category; number signs such as ½, ² or Ⅷ are none."""
    return any(m.group().isalpha() for m in _SIGN.finditer(text or ""))


def gram_counts(texts: list[str], dims: int) -> np.ndarray:
    """Counts of hashed byte n-grams, one row per text. Grams of spaces alone don't count."""
    out = np.zeros((len(texts), dims), np.float32)
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    pad = b" " * max(GRAMS)
    for i, j in slices([len(r) for r in raw], 1 << 18):
        data = _KEEP[np.frombuffer(pad + pad.join(raw[i:j]) + pad, np.uint8)].astype(np.uint32)
        sizes = np.array([len(r) + len(pad) for r in raw[i:j]])
        row = np.repeat(np.arange(j - i, dtype=np.int64), sizes)
        # a gram belongs to the text of its first letter: a text begins where its first gram of the longest kind does
        row = np.concatenate((np.zeros(1, np.int64), row, np.full(len(pad), j - i - 1)))[: len(data)]
        total = np.zeros((j - i) * dims)
        for n in GRAMS:
            code = data[: len(data) - n + 1].copy()
            for k in range(1, n):
                code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
            blank = int.from_bytes(b" " * n, "big")
            at = np.flatnonzero(code != blank)
            place = ((code[at] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(8)) % np.uint32(dims)
            total += np.bincount(row[at] * dims + place, minlength=len(total))
        out[i:j] = total.reshape(j - i, dims)
    return out


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + counts.sum(axis=1)).astype(int)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts with the mean's nearest row and then the farthest rows, so reruns agree."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for g in range(len(c)):
            if (own == g).any():
                m = x[own == g].mean(axis=0)
                c[g] = m / max(np.linalg.norm(m), 1e-12)
    return c


def usual(x: np.ndarray, kinds: np.ndarray, fold: np.ndarray, clusters: int) -> np.ndarray:
    """Low quantile, by length class, of the cosines of rows with centroids of the other folds."""
    top = np.full(len(x), np.nan)
    for f in range(_FOLDS):
        out = fold == f
        if out.any() and not out.all():
            top[out] = np.max(x[out] @ cluster(x[~out], max(1, min(clusters, int((~out).sum()) // 8))).T, axis=1)
    top, kinds = top[~np.isnan(top)], kinds[~np.isnan(top)]
    if not len(top):
        return np.zeros(_CLASSES)
    lows = np.zeros(_CLASSES)
    for k in range(_CLASSES):
        away = np.abs(kinds - max(k, kinds.min()))
        near = away <= np.sort(away)[min(_NEAR, len(away)) - 1]
        lows[k] = np.quantile(top[near], 0.01) * 2.0 ** (-max(0, kinds.min() - k) / 2)
    return lows


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # row per centroid
    owner: np.ndarray  # index into langs
    radius: np.ndarray  # least cosine accepted, by language and length class

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """(language, score, rejected) of texts that have a letter."""
        langs: list[str] = []
        scores: list[float] = []
        rejected: list[bool] = []
        for at in range(0, len(texts), _ROWS):
            counts = gram_counts(texts[at : at + _ROWS], len(self.idf))
            cos = unit(counts, self.idf) @ self.centroids.T
            best = np.argmax(np.round(cos, 6), axis=1)
            # rounded: the last bits of a product depend on how many texts are multiplied at once
            top = np.round(np.clip(cos[np.arange(len(cos)), best], 0, 1).astype(float), 6)
            langs += [self.langs[self.owner[b]] for b in best]
            scores += [float(s) for s in top]
            rejected += [bool(r) for r in top < self.radius[self.owner[best], np.minimum(_length_class(counts), _CLASSES - 1)]]
        return langs, scores, rejected


def fit(docs: DataFrame, dims: int = 4096, clusters: int = 4, sample: int = 600, reject: float = 0.8, tag: str = "langid") -> Model | None:
    """Learn from the rows of docs (text, lang, doc_id), those with a language and a letter; None if there are none."""
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    part = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    spread = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)) < part
    sizes = cut(sizes, f"{tag}-languages")
    small = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes
    rows = known.select("doc_id", "text", "lang").join(small, "lang").select("text", "lang", spread.alias("chosen"))

    def look(batches):
        frequency = np.zeros(dims, np.int64)
        seen = 0
        for b in portions(batches):
            texts = [t or "" for t in b.column(0).to_pylist()]
            langs, chosen = b.column(1).to_pylist(), b.column(2).to_pylist()
            good = [i for i, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(good), _ROWS):
                take = good[at : at + _ROWS]
                counts = gram_counts([texts[i] for i in take], dims)
                frequency += (counts > 0).sum(axis=0)
                seen += len(take)
                pick = [k for k, i in enumerate(take) if chosen[i]]
                if pick:
                    yield pa.RecordBatch.from_arrays([pa.array([langs[take[k]] for k in pick]), pa.array([counts[k].tobytes() for k in pick], pa.binary()), pa.nulls(len(pick), pa.list_(pa.int64()))], ["lang", "counts", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([[seen, *frequency.tolist()]], pa.list_(pa.int64()))], ["lang", "counts", "df"])

    found = cut(rows.mapInArrow(look, "lang string, counts binary, df array<bigint>"), f"{tag}-sample")
    df = {r["at"]: r["n"] for r in found.where("df is not null").select(F.posexplode("df").alias("at", "v")).where("v > 0").groupBy("at").agg(F.sum("v").alias("n")).collect()}  # dims + 1 rows at most
    if not df.get(0):
        return None
    idf = np.array([np.log((1 + df[0]) / (1 + df.get(i + 1, 0))) + 1 for i in range(dims)], np.float32)

    def group(key, table):
        counts = np.stack([np.frombuffer(c, np.float32) for c in table.column("counts").to_pylist()])
        x = unit(counts, idf)
        c = cluster(x, max(1, min(clusters, len(x) // 8)))
        # equal texts are in one fold
        fold = np.array([zlib.crc32(row.tobytes()) % _FOLDS for row in counts])
        lows = usual(x, _length_class(counts), fold, clusters).tolist()
        return pa.table({"lang": [key[0].as_py()], "centroids": [c.astype(np.float32).tobytes()], "lows": [lows]})

    learned = found.where("lang is not null").select("lang", "counts").groupBy("lang").applyInArrow(group, "lang string, centroids binary, lows array<double>")
    models = sorted(learned.collect(), key=lambda r: r["lang"])  # clusters x dims numbers a language
    if not models:
        return None
    each = [np.frombuffer(m["centroids"], np.float32).reshape(-1, dims) for m in models]
    radius = reject * np.array([m["lows"] for m in models])
    return Model([m["lang"] for m in models], idf, np.concatenate(each), np.repeat(np.arange(len(models)), [len(e) for e in each]), radius)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        m = shared.value
        for b in portions(batches):
            texts = b.column(1).to_pylist()
            n = len(texts)
            langs, scores, rejected = ["und"] * n, [0.0] * n, [True] * n
            good = [i for i, t in enumerate(texts) if has_letter(t)] if m else []
            for i, *r in zip(good, *m.predict([texts[i] for i in good])) if good else ():
                langs[i], scores[i], rejected[i] = r
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def predict_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out and predict all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose language the model finds; without a model all stay."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def each(batches):
        m = shared.value
        for b in portions(batches):
            texts = b.column(at).to_pylist()
            good = [i for i, t in enumerate(texts) if has_letter(t)]
            rejected = m.predict([texts[i] for i in good])[2] if good else []
            yield b.take(pa.array([i for i, r in zip(good, rejected) if not r], pa.int64()))

    return docs.mapInArrow(each, docs.schema)
