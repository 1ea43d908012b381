"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest `near` reference points (pivots), in order. Vectors that share at
least `shared` of them are candidates: the inverted lists are kept by combination of `shared` pivots, so a
shared count of that many is the same as meeting in one list, and lists stay short as the number of pivots
grows with the square root of the number of vectors (up to MOST_PIVOTS). Candidates are verified by their
cosine in double precision. A pair that meets in several lists counts in the first of their common ones only.

Pivots come from a sample of at most MOST_SAMPLE vectors, none too near another; every vector is indexed.
Equal vectors of a label are one class and count with their number. A list with more than `block` members
is compared block against block, each pair of blocks a task of its own, so no task grows with a list. Lists
of one member are dropped before any vector is sent. Only link counts and a spanning forest leave a task,
never all pairs of a group.

Defined cases: vectors that are null, zero, empty or hold a null, NaN or infinite component, and those with
a null label, link with nothing; vectors of different lengths aren't compared; repeated rows are vectors of
their own, so that equal ones link; component_id is the smallest vec_id of the component, kept is
vec_id = component_id (true for a null vec_id that is alone); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, partitions
from .textops import give_back

MOST_PIVOTS = 2048
MOST_SAMPLE = 4096


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first: squares of large or tiny components stay within range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, many: int, apart: float = 0.8) -> np.ndarray:
    """Up to many unit vectors of the sample with cosines below `apart`, filled up at random to 16 at least."""
    kept = np.zeros((0, sample.shape[1]))
    for x in _unit(sample):
        if len(kept) == many:
            break
        if not len(kept) or (kept @ x).max() < apart:
            kept = np.vstack([kept, x])
    if len(kept) < 16:
        rng = np.random.RandomState(sample.shape[1])
        kept = np.vstack([kept, _unit(rng.randn(16 - len(kept), sample.shape[1]))])
    return kept


def _orders(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Nearest pivots of each row, nearest first."""
    cos = x @ pivots.T
    near = min(near, cos.shape[1])
    top = np.argpartition(-cos, near - 1, axis=1)[:, :near]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, axis=1), axis=1), axis=1)


def _codes(order: np.ndarray, shared: int) -> np.ndarray:
    """One number per combination of `shared` pivots of a row, whatever their order; rows sorted."""
    s = np.sort(order, axis=1).astype(np.int64)
    cols = [sum(s[:, c] << (12 * k) for k, c in enumerate(reversed(combo))) for combo in combinations(range(s.shape[1]), min(shared, s.shape[1]))]
    return np.sort(np.stack(cols, axis=1), axis=1)


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], near: int, shared: int) -> DataFrame:
    """Add codes (array of long) to rows node, label, dim, embedding, mult, which are sorted in no way."""
    shared_pivots = vectors.sparkSession.sparkContext.broadcast(pivots)

    def each(batches):
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                part = b.take(at)
                known = shared_pivots.value.get(int(dim))
                if known is None:
                    known = choose_pivots(np.ones((1, int(dim))), 16)
                codes = _codes(_orders(_unit(_matrix(part.column(3))), known, near), shared)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "codes"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(each, f"node bigint, label {label}, dim int, embedding array<double>, mult bigint, codes array<bigint>")


def _groups(batches, key_columns: int):
    """Consecutive rows with equal first columns, as tables; the input is sorted by these columns."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in range(key_columns):
            v = t.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        edges = np.concatenate(([0], np.flatnonzero(change) + 1))
        yield from (t.slice(i, j - i) for i, j in zip(edges[:-1], edges[1:]))
        held = t.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held
    give_back()


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (a[i], b[i]) on n nodes."""
    parent = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        r, s = x, y
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        if r != s:
            parent[r] = s
            out.append((x, y))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, near: int = 7, shared: int = 3, block: int = 1024, tag: str = "pivots") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)
    rows = cut(vectors.select("vec_id", "label", x.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound")).withColumn("row", F.monotonically_increasing_id()), f"{tag}-rows")
    good = rows.where("sound")
    # equal vectors of a label are one class; its node is its smallest row
    classes = good.groupBy("label", "embedding").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("mult"))
    classes = cut(classes.select("node", "label", F.size("embedding").alias("dim"), "embedding", "mult"), f"{tag}-classes")
    many = min(MOST_PIVOTS, max(64, int(1.2 * classes.count() ** 0.5)))
    sample = classes.select("dim", "embedding").orderBy(F.xxhash64("node"), "node").limit(min(MOST_SAMPLE, 4 * many)).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    pivots = {d: choose_pivots(np.array(v), many) for d, v in by_dim.items()}
    described = cut(describe(classes, pivots, near, shared), f"{tag}-orders")
    lists = described.select("node", "label", "dim", F.explode("codes").alias("code"))
    sizes = lists.groupBy("label", "dim", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    live = lists.join(sizes, ["label", "dim", "code"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", at)
    # every pair of blocks is a task: rows of block k go to (i, k) for i <= k and to (k, j) for j > k
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select("node", "label", "dim", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    live = live.join(described.select("node", "embedding", "mult", "codes"), "node")
    live = live.select("label", "dim", "code", "i", "j", "own", "node", "mult", "codes", "embedding")
    live = live.repartition(partitions(spark), "label", "dim", "code", "i", "j").sortWithinPartitions("label", "dim", "code", "i", "j", "own", "node")

    def compare(batches):
        sums: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for g in _groups(batches, 5):
            if g.num_rows < 2:
                continue
            g = g.combine_chunks()
            code, i, j = (g.column(k)[0].as_py() for k in (2, 3, 4))
            u = _unit(_matrix(g.column(9).combine_chunks()))
            own = g.column(5).to_numpy()
            split = len(own) if i == j else int(np.searchsorted(own, j))
            hits = np.argwhere(u[:split] @ u[split if i != j else 0 :].T >= threshold)
            a, b = hits[:, 0], hits[:, 1] + (split if i != j else 0)
            a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            codes = _matrix(g.column(8).combine_chunks(), np.int64)
            # codes smaller than this one that both have: the pair counts there
            first = np.ones(len(a), bool)
            for c in range(codes.shape[1]):
                mine = codes[a, c]
                first &= ~((mine < code) & (codes[b] == mine[:, None]).any(axis=1))
            a, b = a[first], b[first]
            node, mult = g.column(6).to_numpy(), g.column(7).to_numpy()
            count = np.bincount(a, weights=mult[b], minlength=len(node)) + np.bincount(b, weights=mult[a], minlength=len(node))
            for k in np.flatnonzero(count):
                sums[int(node[k])] = sums.get(int(node[k]), 0) + int(count[k])
            edges += [(int(node[p]), int(node[q])) for p, q in spanning(len(node), a, b)]
            if len(sums) + len(edges) > 50_000:
                yield flush(sums, edges)
                sums, edges = {}, []
        yield flush(sums, edges)

    def flush(sums, edges):
        a = [*sums, *(e[0] for e in edges)]
        b = [*[None] * len(sums), *(e[1] for e in edges)]
        n = [*sums.values(), *[None] * len(edges)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    found = cut(live.mapInArrow(compare, "a bigint, b bigint, n bigint"), f"{tag}-links")
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = cut(components(found.where("b is not null").select("a", "b"), f"{tag}-components"), f"{tag}-roots")
    member = good.select("row", "vec_id", "label", "embedding").join(classes.select("label", "embedding", "node", "mult"), ["label", "embedding"])
    member = member.join(links, "node", "left").join(roots, "node", "left").select("row", "vec_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    alone = rows.where("not sound").select("row", "vec_id", F.col("row").alias("root"), F.lit(0).cast("long").alias("n_links"))
    every = cut(member.unionByName(alone), f"{tag}-members")
    # only components of several rows need their smallest id looked up
    least = every.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    out = every.join(least, "root", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
