import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, docs, prose, words
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, sharding

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def water_fill(sizes, weights, repeats=3):
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(repeats * sizes[s] for s in capped)) / max(1e-9, sum(w for s, w in weights.items() if s not in capped))
        more = {s for s in sizes if s not in capped and level * weights[s] > repeats * sizes[s] + 1e-9}
        if not more:
            return {s: repeats * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= more


def test_mix_awkward_rows(spark):
    rows = awkward()
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert Counter(r["size"] for r in out) == Counter(len(words(t)) for _, t, _, _ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = water_fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.5 + 1e-6
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert all((r["position"] is None) == (r["taken"] == 0) for r in out)


def test_mix_follows_the_schedule(spark):
    rows = [(i, prose(i, 20), "en", "ab"[i % 2]) for i in range(200)]
    order = mixing.training_order(mixing.mix(docs(spark, rows))).collect()
    at = [r["position"] for r in order]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    # source a (rank 0) ramps up, b ramps down: a quarter of the way, b has had more of its share
    source = {i: s for i, _, _, s in rows}
    early = Counter(source[r["doc_id"]] for r in order if r["position"] < 0.25)
    total = Counter(source[r["doc_id"]] for r in order)
    assert early["a"] / total["a"] < 0.25 < early["b"] / total["b"]


def test_mix_hot_source_and_reruns(spark):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.randrange(1, 40)), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(300)]
    a = sorted(map(tuple, mixing.mix(docs(spark, rows)).select("doc_id", "taken").collect()))
    b = sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(5)).select("doc_id", "taken").collect()))
    assert a == b


def test_mix_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixed_documents_repeat_and_cut(spark):
    rows = [(1, "a b c d", "en", "x"), (2, prose(1, 200), "en", "y"), (3, None, "en", "x")]
    frame = docs(spark, rows)
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got[1] == 3 and got[3] == 0  # x has 4 words and a third of the weight: it stops at three copies
    taken = sum(len(words(r["text"])) for r in out.collect())
    assert abs(taken - 204) <= 1
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def brute_shards(keyed, limit):
    """key -> (depth, prefix) by splitting bit after bit."""
    todo, out = [(0, 0, keyed)], {}
    while todo:
        depth, prefix, rows = todo.pop()
        if sum(b for _, b in rows) <= limit or len(rows) <= 1 or depth == sharding.BITS:
            out |= {k: (depth, prefix) for k, _ in rows}
            continue
        for bit in (0, 1):
            part = [(k, b) for k, b in rows if (k >> (sharding.BITS - depth - 1)) & 1 == bit]
            if part:
                todo.append((depth + 1, prefix * 2 + bit, part))
    return out


@pytest.mark.parametrize("limit", [1, 300, 2_000, 10**9])
def test_directory_equals_splitting_bit_by_bit(spark, limit):
    rng = random.Random(limit)
    keyed = [(rng.getrandbits(60) >> (0 if i % 3 else 50), rng.randrange(1, 400)) for i in range(400)]
    keyed = list(dict(keyed).items())
    frame = spark.createDataFrame(keyed, "_key long, bytes long")
    got = {r["_key"]: (r["shard_depth"], r["shard_prefix"]) for r in sharding.directory(frame, limit, step=4).collect()}
    assert got == brute_shards(keyed, limit)


def test_shard_awkward_rows(spark):
    rows = awkward() + [(9, "same text here", "en", "a")] * 40
    out = sharding.shard(docs(spark, rows), limit=100).collect()
    assert len(out) == len(rows)
    by = Counter()
    for r in out:
        by[r["shard_depth"], r["shard_prefix"]] += r["bytes"]
        assert r["shard_bytes"] <= 100 or r["shard_docs"] == 1
    assert all(by[r["shard_depth"], r["shard_prefix"]] == r["shard_bytes"] for r in out)
    assert sharding.shard(docs(spark, []), limit=100).count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(i, prose(i, 30), "en", "a") for i in range(50)]
    sharding.write_shards(docs(spark, rows), 500, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() > 5


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (10, 64):
        sizes = [rng.randrange(1, capacity + 1) for _ in range(500)]
        gaps: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [g for g in gaps if g >= s]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - s)
            else:
                gaps.append(capacity - s)
        segments = packing.plan(Counter(sizes), capacity)
        used = Counter()
        by_length = {}
        for length, rank, first, per, _ in segments:
            by_length.setdefault(length, []).append((rank, first, per))
        for length, n in Counter(sizes).items():
            runs = sorted(by_length[length]) + [(n, 0, 0)]
            for (rank, first, per), (after, _, _) in zip(runs, runs[1:]):
                for r in range(rank, after):
                    used[first + (r - rank) // per] += length
        assert max(used.values()) <= capacity and sum(used.values()) == sum(sizes)
        assert len(used) == len(gaps)


def test_pack_awkward_rows(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENS)
    rows = awkward() + [(20, "hello <|endoftext|> world", "en", "a"), (21, "<|endoftext|>" * 100, "en", "a")]
    out = packing.pack_documents(docs(spark, rows), TOKENS, capacity=64, with_ids=True).collect()
    want = Counter()
    for i, t, _, _ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64 if len(ids) > 64 else len(ids)
        at, k = 0, 0
        while at < len(ids):
            n = first if k == 0 else 64
            raw = np.array(ids[at : at + n], "<u4").tobytes()
            want[i, k, at, n, zlib.crc32(raw)] += 1
            at, k = at + n, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in out)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs(spark, []), TOKENS).count() == 0


@pytest.mark.parametrize("as_text", [False, True])
def test_fast_ids_are_the_tokenizers_ids(as_text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENS)
    if as_text:
        own.encode_special_tokens = True
    encode = packing.encoder(TOKENS, as_text)
    rng = random.Random(0)
    for text in ["", "   ", "<|endoftext|> a", "hello <|endoftext|> world", "<|endoftext|", "a" * 5000, "it's we'll I'M", "\n\n \t x  y", "漢字 émoji 🎉🎉", *("".join(chr(rng.choice([32, 10, 97, 233, 0x4E00, 49, 36])) for _ in range(300)) for _ in range(50))]:
        assert list(encode(text)) == own.encode(text, add_special_tokens=False).ids


def test_the_packing_query_equals_sequential_best_fit(spark):
    """Pieces as an unmodified tokenizer and a plain loop give them; sequences are as many and as full as by best-fit decreasing one by one."""
    from helpers import DATA
    from tokenizers import Tokenizer

    from tessera.llm.queries import op10_best_fit_packing

    own = Tokenizer.from_file(TOKENS)
    want, sizes = Counter(), []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % 1024 or 1024) if k == 0 and len(ids) > 1024 else min(1024, len(ids))
            want[r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            sizes.append(n)
            at, k = at + n, k + 1
    out = op10_best_fit_packing(spark, DATA).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if sum(b) + s <= 1024]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    got = {}
    for r in out:
        got.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in got.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    # among equal gaps either may be taken: contents may differ, fill levels can't
    assert Counter(sum(n for _, n in p) for p in got.values()) == Counter(map(sum, bins))


def test_mix_agrees_on_rows_that_share_an_id(spark):
    rng = random.Random(11)
    rows = [(None if i % 3 else 5, prose(i % 150, rng.randrange(1, 30)), "en", None if i % 2 else "a") for i in range(600)]
    frame = docs(spark, rows)
    names = ("doc_id", "source", "size", "target", "taken", "position")
    a = Counter(map(tuple, mixing.mix(frame).select(*names).collect()))
    b = Counter(map(tuple, mixing.mix(frame.repartition(7)).select(*names).collect()))
    assert a == b


def test_clashing_names(spark, tmp_path):
    """Columns of any name pass through: those that operators use inside, in upper case, with a dot."""
    from tessera.llm import simhash, substrings

    shared = prose(90, 30)
    rows = [(i, f"{prose(i, 40)} {shared} {prose(50 + i, 40)}", "en", "ab"[i % 2]) for i in range(12)] + [(30, prose(1, 40), "en", "a")] * 2
    frame = docs(spark, rows)
    for name in ("_id", "_d", "_w", "_h", "_k", "_t", "_row", "_pid", "_source", "_copy", "_words", "_position", "_SIZE", "class_doc", "mix_id", "window_key", "shard", "shard_id", "a.b", "key", "alive", "root", "digest"):
        frame = frame.withColumn(name, F.lit(name))
    for out in (substrings.rewrite(frame), simhash.survivors(frame), mixing.mixed_documents(frame)):
        got = out.collect()
        assert out.columns == frame.columns and got
        assert all(r["_id"] == "_id" and r["a.b"] == "a.b" and r["_SIZE"] == "_SIZE" and r["shard"] == "shard" for r in got)
    sharding.write_shards(frame, 500, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.where("shard = 'shard'").count() == len(rows) and back.select("_shard").distinct().count() > 1
    sharding.write_shards(docs(spark, []), 500, str(tmp_path / "empty"))
