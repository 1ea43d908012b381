import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from helpers import awkward, cut_windows, docs, near_classes, prose, words
from tokenizers import Tokenizer

from tessera.llm import common, simhash
from tessera.tables import shared_folder


def corpus():
    rng = random.Random(12)
    rows = []
    shared = prose(77, 40)
    for i in range(40):
        base = prose(i, rng.randrange(30, 120)).split()
        if i % 5 == 0:
            base[10:10] = shared.split()
        rows.append((2 * i, " ".join(base), "en", "abc"[i % 3]))
        if i % 4 == 0:  # a near copy and an exact one
            near = list(base)
            near[3] = "zz"
            rows.append((2 * i + 1, " ".join(near), "en", "c"))
            rows.append((1000 + i, " ".join(base), "en", "a"))
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus() + [(500, None, "en", "a"), (501, "", "en", "a"), (502, "12 34", "en", "b")]
    frame = docs(spark, rows)
    columns, before = frame.columns, {i: t for i, t, _, _ in rows}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    now = frame
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        got = now.collect()
        if k < 4:
            assert now.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "language_id":  # what has letters stays
            assert {r["doc_id"]: r["text"] for r in got} == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "simhash_near_dedup":
            classes = near_classes(sorted(before.items()))
            assert {r["doc_id"]: r["text"] for r in got} == {i: before[i] for i in classes if classes[i] == i}
        elif name == "substring_dedup":
            want = cut_windows(sorted(before.items()), 13)
            assert {r["doc_id"]: len(words(r["text"])) for r in got} == {i: n - gone for i, (n, gone, _) in want.items()}
            assert sum(gone for _, gone, _ in want.values()) > 100
        elif name == "mixing":
            total = sum(len(words(t)) for t in before.values())
            assert abs(sum(len(words(r["text"])) for r in got) - total) <= 3
            for r in got:  # whole copies, or the first words of one
                assert words(before[r["doc_id"]])[: len(words(r["text"]))] == words(r["text"])
            assert max(Counter(r["doc_id"] for r in got).values()) <= 3
        else:
            own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            tokens = sum(len(own.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
            assert sum(r["length"] for r in got) == tokens
            per = Counter()
            for r in got:
                per[r["sequence_id"]] += r["length"]
            assert max(per.values()) <= 1024
        if k < 4:
            texts = [r["text"] for r in got]
            before = {r["doc_id"]: r["text"] for r in got}


def test_run_takes_awkward_and_empty_tables(spark, tmp_path):
    for name, rows in (("awkward", awkward()), ("empty", [])):
        folder = tmp_path / name
        docs(spark, rows).write.parquet(str(folder / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
        assert (out.count() > 0) == bool(rows)


def test_near_dedup_moves_no_text_for_chance_runs(spark, tmp_path, monkeypatch):
    """Texts of four words in random order share runs by chance: the stage keeps one of each class and compares few texts for it."""
    texts, moved = simhash._texts, []
    monkeypatch.setattr(simhash, "_texts", lambda frame, nodes, pairs, tag: moved.append(pairs.count()) or texts(frame, nodes, pairs, tag))
    rows = [(i, prose(900 + i, 60, 4)) for i in range(150)]
    rows += [(150 + i, t + " end") for i, t in rows[:10]]
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs(spark, [(i, t, "en", "a") for i, t in rows]), str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(near_classes(rows).values())
    assert sum(moved) <= 100  # more than a thousand pairs share a run


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    every = sc.statusStore().executorList(False)
    return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


def test_near_dedup_leaves_texts_and_disk_alone(spark, tmp_path):
    """Texts that stay aren't shuffled to find that they do, and the stage's own tables are gone when its rows are written."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    there = set(folder.iterdir()) if folder.exists() else set()
    texts = [prose(300 + i, 3000, 10**6) for i in range(200)]
    rows = [(i, t, "en", "a") for i, t in enumerate([*texts, texts[3], texts[5] + " end"])]
    docs(spark, rows).write.parquet(str(tmp_path / "in"))
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.read.parquet(str(tmp_path / "in")), str(tmp_path))
    before = shuffled(spark)
    out.write.parquet(str(tmp_path / "out"))
    assert shuffled(spark) - before < 800_000  # of more than 4 million bytes of text
    assert {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == dict(enumerate(texts))
    left = sum(f.stat().st_size for p in set(folder.iterdir()) - there for f in p.rglob("*.parquet"))
    assert left < 100_000  # signatures, prefixes and members were more than a million


def test_near_dedup_with_a_full_sieve(spark, tmp_path, monkeypatch):
    """What the sieve can't tell from the rows that go is looked up exactly; nulls stay and repeated rows count as one."""
    monkeypatch.setattr(common, "MOST_WORDS", 0)
    texts = corpus()
    rows = [*texts, texts[0], texts[0], texts[1], texts[1], (900, None, "en", "a"), (900, None, "en", "a"), (None, None, "en", "a"), (None, texts[3][1], "en", "a"), (None, "alone here", "en", "a"), (None, "alone here", "en", "a")]
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs(spark, rows), str(tmp_path)).collect()
    classes = near_classes(sorted((i, t) for i, t, _, _ in texts))
    want = [(i, t) for i, t, _, _ in texts if classes[i] == i] + [(900, None)] * 2 + [(None, None), (None, "alone here")]
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(want)


def test_run_keeps_one_stage_on_disk(spark, tmp_path):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    there = set(folder.iterdir()) if folder.exists() else set()
    docs(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count()
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - there}
    assert "stage-3-mixing" in left and not any(n.startswith(("stage-0", "stage-1", "stage-2", "simhash", "substrings")) for n in left)
