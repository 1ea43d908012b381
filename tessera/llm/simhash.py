"""Near-duplicate texts by SimHash with random bit-sampling tables.

A text is the set of its runs of five words (all its words, if fewer) and has a 128-bit SimHash of it. Each
of several tables samples the bits in a random order of its own and groups texts by the first of them; as
many as make groups of about `bucket` texts. A group above the cap takes four more bits, and so on; what is
still above the cap when 60 bits are used is compared block against block, each pair of blocks a task of its
own. Pairs within the Hamming distance are candidates and are verified on the texts: Jaccard similarity of
the two sets, 0.8 or more.

Verification has two rounds, so that a large group of near copies doesn't need all its pairs. In the first
every text puts forward its `nearest` candidates from each table; the verified ones are joined into classes.
The second is exact, whatever the tables missed: texts of different classes meet in every run of their
prefixes (prefix-filter join). A prefix is the n - ceil(0.8 n) + 1 first of a text's n runs in an order common
to all texts: the runs that are frequent in a sample come last, the others by hash. The sample changes only the
number of pairs, never the classes. Runs that more texts share than the cap are compared block against block as
well. Equal texts are one class from the start, whatever their number.

Most texts that meet in a run have little else in common, and such pairs grow faster than the texts, so no text
is moved for a pair before two bounds that lose nothing have passed it. Similar texts share several runs of
their prefixes, up to LEAST as far as these reach, not one. And each text has marks: as many bits as a power of
two from twice its runs on, where every run flips the bit that its hash names; where two texts' marks differ,
a run differs. This holds for the pairs of either round. Shared runs, counts, marks and verifications are gone through
in rounds, so that what is on disk at a time follows the texts, not the pairs, and is a part of them only: a bit map
of the wanted texts, small enough for every task, leaves nearly all others where they are, and so it is with the
survivors. Tables go as soon as nothing needs them.

Defined cases: a null text is alone; texts without a word are alone but for equal ones; repeated rows are
copies; class_id is the smallest doc_id of the class (null ids aside; null where all are) and kept is
doc_id = class_id; a null doc_id is kept only if its whole class is without ids; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, free_names, partitions, passing, release, sieve, sifted
from .embeddings import _groups
from .textops import give_back, inside, mix, portions, runs, slices, words

BITS = 128
KEY = 60
STEP = 4
RUN = 5
LEAST = 4
ROUND_MET = 64  # meetings in runs that one round counts, for every text
ROUND_NEAR = 4  # pairs whose marks one round moves, for every text
ROUND_PAIRS = 0.25  # pairs whose texts one round moves, for every text
ROUND_ROWS = 30  # rows that one round compares block against block, for every text
ROUNDS_RUNS = 4  # rounds in which texts meet in the runs of their prefixes
SMALL = 10_000  # texts as which fewer count in these


def _orders(tables: int) -> np.ndarray:
    rng = np.random.RandomState(77)
    return np.stack([rng.permutation(BITS)[:KEY] for _ in range(tables)])


def text_digest():
    """The digest of the column text, as describe() gives it."""
    return F.substring(F.sha2("text", 256), 1, 32)


def shingles(texts: list[bytes | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct runs of every text, sorted by both."""
    counts, (h,) = words(texts)
    text = np.repeat(np.arange(len(counts)), counts)
    keep = inside(counts, run)
    n = len(keep)
    at, value = text[:n][keep], runs(h, run)[keep]
    starts = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < run))
    if len(short):  # all words of a shorter text are its only run
        whole = np.array([runs(h[starts[k] : starts[k] + counts[k]], int(counts[k]))[0] for k in short], np.uint64)
        at, value = np.concatenate((at, short)), np.concatenate((value, whole))
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (value[1:] != value[:-1])
    return at[new], value[new]


def signatures(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct runs, packed 128-bit SimHash as two uint64) per text."""
    return _signatures(*shingles(texts), len(texts))


def _signatures(at: np.ndarray, value: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.bincount(at, minlength=many)
    sums = np.zeros((many, BITS), np.int32)
    have = np.flatnonzero(sizes)
    edges = np.concatenate(([0], np.cumsum(sizes[have])))
    for i, j in slices(sizes[have].tolist(), 1 << 14):
        part = value[edges[i] : edges[j]]
        bits = np.unpackbits(np.stack((part, mix(part ^ np.uint64(0x5851F42D4C957F2D))), axis=1).view(np.uint8), axis=1)
        # a running total per bit is faster than a sum per text
        sums[have[i:j]] = np.add.reduceat(bits, edges[i:j] - edges[i], axis=0, dtype=np.int32)
    ones = (2 * sums > sizes[:, None]).astype(np.uint8)
    return sizes, np.packbits(ones, axis=1).view(np.uint64).reshape(-1, 2)


def frequent(docs: DataFrame, sample: int = 16_000, least: int = 3, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, rank from 1) of runs that are frequent in a sample of the texts; the rarer ones rank first."""
    every = max(1, docs.count() // sample)

    def each(batches):
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(b.column(0).cast(pa.binary()).to_pylist())[1].view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(each, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "h").limit(most).collect()  # `most` numbers
    hashes = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(found) - order


def _rest(sizes: np.ndarray, share: float) -> np.ndarray:
    """How many runs of a text are not in its prefix."""
    return np.maximum(0, np.ceil(share * sizes - 1e-9).astype(np.int64) - 1)


def _both(m: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """How many runs similar texts of these sizes share at least."""
    return np.ceil(share / (1 + share) * (m + n) - 1e-6).astype(np.int64)


def prefixes(at: np.ndarray, value: np.ndarray, sizes: np.ndarray, share: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(length, runs) of every text's prefix: two texts that are similar enough share a run of their prefixes."""
    hashes, ranks = common
    if len(hashes):
        place = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
        rank = np.where(hashes[place] == value, ranks[place], 0)
        order = np.lexsort((value, rank, at))
        at, value = at[order], value[order]
    lengths = sizes - _rest(sizes, share)
    return lengths, value[np.arange(len(at)) - (np.cumsum(sizes) - sizes)[at] < lengths[at]]


def marks(at: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The marks of every text: bits that are set where an odd number of its runs fall."""
    widths = np.int64(64) << np.ceil(np.log2(np.maximum(sizes, 32) / 32)).astype(np.int64)
    ends = np.cumsum(widths)
    place = (ends - widths)[at] + (value & (widths[at] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], ends // 8)).astype(np.int32)), pa.py_buffer(bits)])


def apart(x: bytes, y: bytes) -> int:
    """By their marks, the least number of runs that only one of two texts has; the longer marks are folded to the length of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    differ = int.from_bytes(y)
    for k in range(0, len(x), len(y)):
        differ ^= int.from_bytes(x[k : k + len(y)])
    return differ.bit_count()


def describe(docs: DataFrame, tables: int, share: float) -> DataFrame:
    """doc_id, digest (128 bits of SHA-256 in hex; null for a null text), size (distinct runs), sig (two longs), keys (one 60-bit key per table), prefix (runs) and marks."""
    orders = _orders(tables)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))
    weights = np.int64(1) << np.arange(KEY - 1, -1, -1, dtype=np.int64)

    def each(batches):
        for b in portions(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices([len(t or b"") for t in texts], 1 << 21):
                part = texts[i:j]
                at, value = shingles(part)
                sizes, sig = _signatures(at, value, len(part))
                lengths, first = prefixes(at, value, sizes, share, shared.value)
                ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                bits = np.unpackbits(sig.view(np.uint8), axis=1)
                keys = np.stack([bits[:, o].astype(np.int64) @ weights for o in orders], axis=1)
                digest = [None if t is None else hashlib.sha256(t).hexdigest()[:32] for t in part]
                step = lambda k: pa.array(np.arange(len(part) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(digest, pa.string()), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(step(2), pa.array(sig.ravel().view(np.int64))), pa.ListArray.from_arrays(step(tables), pa.array(keys.ravel())), pa.ListArray.from_arrays(ends, pa.array(first.view(np.int64))), marks(at, value, sizes)],
                    ["doc_id", "digest", "size", "sig", "keys", "prefix", "marks"],
                )

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, size bigint, sig array<bigint>, keys array<bigint>, prefix array<bigint>, marks binary")


def buckets(nodes: DataFrame, bucket: int, tag: str) -> DataFrame:
    """node, table, depth, prefix, n (texts of the bucket) for every table; oversized buckets take more bits."""
    many = nodes.count()
    depth = min(KEY, max(0, int(np.ceil(np.log2(max(1, many / bucket))))))
    cap = 4 * bucket
    now = nodes.select("node", F.posexplode("keys").alias("table", "key"))
    done = None
    while True:
        now = now.withColumn("prefix", F.shiftright("key", KEY - depth))
        cells = cut(now.groupBy("table", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{tag}-cells-{depth}")
        whole = now.join(cells if depth == KEY else cells.where(F.col("n") <= cap), ["table", "prefix"])
        whole = whole.select("node", "table", F.lit(depth).alias("depth"), "prefix", "n")
        done = whole if done is None else done.unionByName(whole)
        large = cells.where(F.col("n") > cap).select("table", "prefix")
        if depth == KEY or large.isEmpty():
            return done
        now = cut(now.join(large, ["table", "prefix"]).select("node", "table", "key"), f"{tag}-large-{depth}")
        depth = min(KEY, depth + STEP)


def blocked(rows: DataFrame, node: str, cap: int) -> DataFrame:
    """The rows, of groups of n, once for every pair (i, j) of blocks of their group that they are in; own is the row's block."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / cap).cast("int")).withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def block_rounds(rows: DataFrame, cap: int, most: float) -> list:
    """Conditions, as functions of a hash of a pair of blocks, that split the rows of blocked() in parts of about `most`."""
    parts = max(1, int(np.ceil((rows.agg(F.sum(F.ceil(F.col("n") / cap))).first()[0] or 0) / most)))
    return [lambda h, k=k: F.lit(True) if parts == 1 else F.pmod(h, F.lit(parts)) == k for k in range(parts)]


def candidates(placed: DataFrame, nodes: DataFrame, distance: int, share: float, cap: int, nearest: int | None, part=lambda h: F.lit(True)) -> DataFrame:
    """Pairs a < b of one bucket within the distance, in different classes and with sizes that allow the share.

    nodes has node, size, sig and root. With `nearest`, every text only puts forward so many, the nearest first.
    part, of block_rounds(), is what is compared.
    """
    rows = blocked(placed, "node", cap)
    rows = rows.select("node", (F.col("table") * 64 + F.col("depth")).cast("long").alias("group"), "prefix", "i", "j", "own")
    rows = rows.where(part(F.xxhash64("group", "prefix", "i", "j")))
    rows = rows.join(nodes.select("node", "size", "root", F.get("sig", F.lit(0)).alias("s0"), F.get("sig", F.lit(1)).alias("s1")), "node")
    rows = rows.select("group", "prefix", "i", "j", "own", "node", "root", "size", "s0", "s1")
    rows = rows.repartition(partitions(nodes.sparkSession), "group", "prefix", "i", "j").sortWithinPartitions("group", "prefix", "i", "j", "own", "node")

    def each(batches):
        for g in _groups(batches, 4):
            if g.num_rows < 2:
                continue
            i, j = g.column(2)[0].as_py(), g.column(3)[0].as_py()
            own, node, root, size, s0, s1 = (g.column(k).to_numpy() for k in range(4, 10))
            n = len(node)
            split = n if i == j else int(np.searchsorted(own, j))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
            lo = 0 if i == j else split
            for at in range(0, split, 256):
                d = np.bitwise_count(s0[at : at + 256, None] ^ s0[None, lo:]) + np.bitwise_count(s1[at : at + 256, None] ^ s1[None, lo:])
                x, y = np.nonzero(d <= distance)
                dist = d[x, y]
                x, y = x + at, y + lo
                ok = (x < y) & (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y]))
                found.append((x[ok], y[ok], dist[ok]))
            x, y, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            if not len(x):
                continue
            if nearest is not None:
                me, rank = np.concatenate((x, y)), np.concatenate((d, d)).astype(np.int64)
                pair = np.tile(np.arange(len(x)), 2)
                # nearest first; equal distances by the other's number
                other = node[np.concatenate((y, x))]
                order = np.lexsort((other, rank, me))
                first = np.searchsorted(me[order], me[order])
                keep = np.unique(pair[order[np.arange(len(order)) - first < nearest]])
                x, y = x[keep], y[keep]
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])

    return rows.mapInArrow(each, "a bigint, b bigint").distinct()


def _meeting(h: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, share: float, split: int | None = None):
    """Pairs a < b, in portions, of equal h and different classes that may be similar enough, and how often such a pair meets then at least.

    Rows are sorted by h and size, or with `split` by size in both parts, and pairs are of one row from each.
    """
    many = len(h)
    if split is None:
        change = np.concatenate((np.flatnonzero(h[1:] != h[:-1]) + 1, [many]))
        end = np.repeat(change, np.diff(np.concatenate(([0], change))))
        x, y = np.arange(many), np.arange(1, many + 1)
    else:
        x, end = np.arange(split), np.full(split, many)
        # the first of the other part whose size is large enough
        y = split + np.searchsorted(size[split:], np.ceil(share * size[:split] - 1e-9))
    end = end[x]
    while True:
        on = y < end
        x, y, end = x[on], y[on], end[on]
        # sizes only grow from here
        on = share * size[y] <= size[x] + 1e-9
        x, y, end = x[on], y[on], end[on]
        if not len(x):
            return
        m, n = size[x], size[y]
        both = _both(m, n, share)
        # similar texts share `least` runs of all but the last `both - least` of each, and of the prefixes if these reach as far
        least = np.minimum(LEAST, both - np.maximum(_rest(m, share), _rest(n, share)))
        ok = (root[x] != root[y]) & (np.minimum(m - at[x], n - at[y]) > both - least)
        if ok.any():
            yield np.minimum(node[x[ok]], node[y[ok]]), np.maximum(node[x[ok]], node[y[ok]]), least[ok]
        y = y + 1


def meetings(front: DataFrame, share: float, cap: int, most: float, tag: str) -> list[DataFrame]:
    """Tables of a, b and n, a row for each run that two texts a < b of different classes share so far in front that it counts; similar ones have n rows or more.

    front has node, size, root and prefix. A run of more than `cap` texts goes block against block, `most` rows in a round.
    """
    spark = front.sparkSession
    every = front.select("node", "root", "size", F.posexplode("prefix").alias("at", "h")).select("h", "node", "root", F.col("size").cast("int"), F.col("at").cast("int"))
    names = ["a", "b", "h", "root", "size", "at", "n"]

    def pairs(found):
        held, many = [], 0
        for p in found:
            held.append(p)
            many += len(p[0])
            if many > 50_000:
                yield from sent(held)
                held, many = [], 0
        yield from sent(held)

    def sent(held):
        if held:
            a, b, least = (np.concatenate(c) for c in zip(*held))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[none] * 4, pa.array(least)], names)

    def each(batches):
        rest = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[last:] for c in cols]
            yield from split([c[:last] for c in cols])
        if rest is not None:
            yield from split(rest)
        give_back()

    def split(cols):
        h = cols[0]
        if not len(h):
            return
        edge = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]))
        n = np.repeat(np.diff(edge), np.diff(edge))
        large = n > cap
        if large.any():
            h_, node, root, size, at = (c[large] for c in cols)
            for k in range(0, len(h_), 50_000):
                s = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(node[s]), pa.nulls(len(node[s]), pa.int64()), *(pa.array(c[s]) for c in (h_, root, size, at, n[large]))], names)
        small = (n > 1) & ~large
        if small.any():
            yield from pairs(_meeting(*(c[small] for c in cols), share))

    met = []
    for k in range(ROUNDS_RUNS):
        some = every.where(F.pmod(F.xxhash64("h"), F.lit(ROUNDS_RUNS)) == k).repartition(partitions(spark), "h").sortWithinPartitions("h", "size", "node")
        met.append(cut(some.mapInArrow(each, ", ".join(f"{c} bigint" for c in names)), f"{tag}-met"))
    met = united(met)
    out = [met.where("b is not null").select("a", "b", "n")]
    large = met.where("b is null")
    if large.isEmpty():
        return out
    # a run whose texts are one class already has no pair
    split_runs = large.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("z")).where("x <> z").select("h")
    large = cut(large.join(split_runs, "h"), f"{tag}-hot")

    def blocks(batches):
        for g in _groups(batches, 3):
            i, j = g.column(1)[0].as_py(), g.column(2)[0].as_py()
            h, own, node, root, size, at = (g.column(k).to_numpy() for k in (0, 3, 4, 5, 6, 7))
            yield from (b.select(["a", "b", "n"]) for b in pairs(_meeting(h, node, root, size, at, share, None if i == j else int(np.searchsorted(own, j)))))

    for part in block_rounds(large, cap, most):
        hot = blocked(large, "a", cap).where(part(F.xxhash64("h", "i", "j"))).select("h", "i", "j", "own", F.col("a").alias("node"), "root", "size", "at")
        hot = hot.repartition(partitions(spark), "h", "i", "j").sortWithinPartitions("h", "i", "j", "own", "size", "node")
        out.append(cut(hot.mapInArrow(blocks, "a bigint, b bigint, n bigint"), f"{tag}-met-hot"))
    return out


def rounds(table: DataFrame, many: int, most: float) -> list[DataFrame]:
    """The table, of `many` rows, in parts of about `most` rows; rows of one pair (a, b) are in one part."""
    parts = max(1, int(np.ceil(many / most)))
    return [table] if parts == 1 else [table.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k) for k in range(parts)]


def united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def near(pairs: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose marks allow the share; rows has row, size and marks."""
    side = lambda node, size, bits: rows.select(F.col("row").alias(node), F.col("size").alias(size), F.col("marks").alias(bits))

    def each(batches):
        for batch in batches:
            m, n = (batch.column(k).to_numpy() for k in (2, 3))
            differ = np.array([apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(differ <= m + n - 2 * _both(m, n, share)))

    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(each, "a bigint, b bigint")


def verify(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are similar enough."""
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def each(batches):
        known: dict[int, np.ndarray] = {}
        for b in portions(batches):
            bs, as_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            good = []
            for k, (m, n) in enumerate(zip(as_, bs)):
                sets = []
                for key, col in ((m, 2), (n, 3)):
                    if key not in known:
                        if len(known) > 500:
                            known.clear()
                        known[key] = shingles([b.column(col)[k].as_py().encode()])[1]
                    sets.append(known[key])
                both = len(np.intersect1d(*sets, assume_unique=True))
                good.append(both >= share * (len(sets[0]) + len(sets[1]) - both) - 1e-9)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0)], ["a", "b"]).filter(mask)

    return rows.select("b", "a", "x", "y").mapInArrow(each, "a bigint, b bigint")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, share: float, many: int, tag: str, links: str) -> DataFrame:
    """The pairs whose texts are similar enough, written; in rounds, each of which moves the texts of its own pairs only."""
    spark = docs.sparkSession
    texts = _texts(docs, nodes, pairs, tag)
    out, parts = [], rounds(pairs, pairs.count(), ROUND_PAIRS * many)
    for part in parts:
        some = texts
        if len(parts) > 1:
            bits = sieve(_named(part).select(F.xxhash64("node").alias("key")), f"{tag}-sieve")
            some = sifted(texts, F.xxhash64("node"), bits, "named").where("named").drop("named")
        out.append(cut(verify(part, some, share), links))
    release(spark, texts)
    return united(out)


def members(docs: DataFrame, share: float = 0.8, tables: int = 20, distance: int = 34, bucket: int = 512, nearest: int = 2, tag: str = "simhash") -> DataFrame:
    """row (a number), doc_id, digest and root (the number of a row of the class) of every row; written."""
    with passing(docs.sparkSession) as keep:
        return keep(_members(docs, share, tables, distance, bucket, nearest, tag))


def _members(docs: DataFrame, share: float, tables: int, distance: int, bucket: int, nearest: int, tag: str) -> DataFrame:
    spark = docs.sparkSession
    rows = cut(describe(docs, tables, share).withColumn("row", F.monotonically_increasing_id()), f"{tag}-signatures")
    # equal texts: one node, its first row
    same = rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct("row", "doc_id", "size", "sig", "keys")).alias("r"), (F.count(F.lit(1)) == 1).alias("alone"))
    nodes = cut(same.select("digest", "alone", F.col("r.row").alias("node"), F.col("r.doc_id").alias("id"), F.col("r.size").alias("size"), F.col("r.sig").alias("sig"), F.col("r.keys").alias("keys")), f"{tag}-nodes")
    full = nodes.where("size > 0")
    many = max(SMALL, full.count())
    cap = 4 * bucket
    with passing(spark) as keep:
        placed = keep(cut(buckets(full, bucket, tag), f"{tag}-buckets"))
    parts = block_rounds(placed, cap, ROUND_ROWS * many)
    found = [cut(candidates(placed, full.withColumn("root", F.col("node")), distance, share, cap, nearest, part), f"{tag}-nearest") for part in parts]
    release(spark, placed)
    first = found[0]
    if len(found) > 1:
        first = cut(united(found).distinct(), f"{tag}-nearest")
        release(spark, *found)
    closer = [cut(near(part, rows, share), f"{tag}-nearest-marks") for part in rounds(first, first.count(), ROUND_NEAR * many)]
    release(spark, first)
    first = united(closer)
    links = verified(docs, nodes, first, share, many, f"{tag}-texts-1", f"{tag}-links-1")
    with passing(spark) as keep:
        roots = keep(cut(components(links, f"{tag}-components-1"), f"{tag}-roots-1"))
    now = full.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    front = cut(rows.select(F.col("row").alias("node"), "prefix").join(now.select("node", "size", "root"), "node"), f"{tag}-front")
    # the prefixes stay in one table only
    slim = cut(rows.select("row", "doc_id", "digest", "size", "marks"), f"{tag}-rows")
    release(spark, rows)
    rows = slim
    met = united(meetings(front, share, cap, ROUND_ROWS * many, tag))
    release(spark, front)
    second = []
    for part in rounds(met, met.count(), ROUND_MET * many):
        pairs = part.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("k")).where("k >= n").select("a", "b")
        second.append(cut(near(pairs, rows, share).join(first, ["a", "b"], "left_anti"), f"{tag}-rest"))
    rest = united(second)
    if not rest.isEmpty():
        more = verified(docs, nodes, rest, share, many, f"{tag}-texts-2", f"{tag}-links-2")
        if not more.isEmpty():
            roots = cut(components(links.unionByName(more), f"{tag}-components-2"), f"{tag}-roots-2")
    member = rows.where("digest is not null").select("row", "doc_id", "digest").join(nodes.select("digest", "node"), "digest").join(roots, "node", "left")
    every = member.select("row", "doc_id", "digest", F.coalesce("root", "node").alias("root")).unionByName(rows.where("digest is null").select("row", "doc_id", "digest", F.col("row").alias("root")))
    return cut(every, f"{tag}-members")


def classes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id and kept of every row; settings as for members()."""
    every = members(docs, **settings)
    # only classes of several rows need their smallest id looked up
    least = every.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    out = every.join(least, "root", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def survivors(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each class, the one with the smallest doc_id (null last), and all its columns."""
    every = members(docs, **settings)
    own, id_, digest, again, maybe = free_names(docs.columns, "class_text", "class_doc", "class_digest", "class_again", "class_maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "digest")).alias("w")
    best = every.groupBy("root").agg(first).select(F.col("w.doc_id").alias("_i"), F.col("w.digest").alias("_d"), F.lit(True).alias("_w")).distinct()
    texts = every.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("k"))
    # rows that repeat an id and its text count as one
    texts = texts.withColumn("again", (F.col("k") > 1) & F.col("digest").isNotNull())
    texts = texts.join(best, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("digest").eqNullSafe(F.col("_d")), "left").withColumn("kept", F.col("_w").isNotNull())
    # only what goes or is repeated is looked up exactly, and what the sieve can't tell from it
    looked = cut(texts.where("again or not kept").select("doc_id", "digest", "again", "kept", _key("doc_id", "digest").alias("key")), "simhash-looked-up")
    release(docs.sparkSession, every)
    bits = sieve(looked.select("key"), "simhash-looked-up-sieve")
    rows = sifted(docs.withColumn(own, text_digest()), _key("doc_id", own), bits, maybe)
    clear = rows.where(~F.col(maybe)).drop(own, maybe)
    unclear = rows.where(F.col(maybe)).drop(maybe)
    given = looked.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.col("again").alias(again), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col(own).eqNullSafe(F.col(digest))
    # what is not looked up is there once and stays
    out = clear.unionByName(unclear.join(given.drop("kept", again), same, "left_anti").drop(own))
    repeated = given.where(F.col("kept") & F.col(again)).select(id_, digest)
    if not repeated.isEmpty():
        out = out.unionByName(unclear.join(repeated, same).dropDuplicates([id_, digest]).drop(own, id_, digest))
    return out


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """node, text of the nodes that the pairs name."""
    with passing(docs.sparkSession) as keep:
        wanted = cut(nodes.join(_named(pairs), "node").select("node", "id", "digest", "alone"), f"{tag}-wanted")
        bits = sieve(wanted.select(_key("id", "digest").alias("key")), f"{tag}-sieve")
        found = docs.select("doc_id", "text", text_digest().alias("_d")).where("text is not null")
        found = sifted(found, _key("doc_id", "_d"), bits, "_named").where("_named")
        # an id may stand for several texts: the digest tells; only a text that others equal can be there twice with its id
        found = found.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_d") == F.col("digest")))
        once = found.where("alone").select("node", "text")
        return keep(cut(once.unionByName(found.where("not alone").select("node", "text").dropDuplicates(["node"])), tag))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _key(doc_id: str, digest: str):
    return F.xxhash64(doc_id, digest)
