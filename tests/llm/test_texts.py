import base64
import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import DATA, awkward, cut_windows, docs, near_classes, prose, words

from tessera.llm import langid, quality, simhash, substrings, toxicity
from tessera.llm.common import held_out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


# --- language ID ---


def test_language_id(spark):
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in langid.predict_documents(frame).collect()}
    lang = {r["doc_id"]: r["lang"] for r in frame.select("doc_id", "lang").collect()}
    assert rows.keys() == lang.keys() and all(r["held_out"] == held(i) for i, r in rows.items())
    unseen = [i for i in lang if held(i)]
    assert sum(rows[i]["lang_pred"] == lang[i] for i in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_id_awkward_rows(spark):
    rows = awkward() + [(20 + i, "the cat and the dog and the bird", "en", "a") for i in range(12)] + [(50 + i, "der hund und die katze und das haus", "de", "a") for i in range(12)]
    rows += [(90, "12 34 !!", "en", "a"), (91, "½ ² ① Ⅷ", "en", "a")]
    out = langid.predict_documents(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (2, 3, 4, 90, 91))
    assert got[50]["lang_pred"] == "de" and got[20]["lang_pred"] == "en"
    assert langid.predict_documents(docs(spark, [])).count() == 0
    alone = langid.predict_documents(docs(spark, [(1, "hello", None, None)])).collect()
    assert alone[0]["lang_pred"] == "und"


def test_prediction_needs_the_text_only(spark):
    rows = [(i, f"the cat and the dog number {i}", "en", "a") for i in range(30)] + [(100 + i, f"der hund und die katze nummer {i}", "de", "b") for i in range(30)]
    model = langid.fit(docs(spark, rows))
    a = {r["doc_id"]: tuple(r)[1:] for r in langid.identify(docs(spark, rows), model).collect()}
    b = {r["doc_id"]: tuple(r)[1:] for r in langid.identify(docs(spark, [(i, t, "xx", "z") for i, t, _, _ in rows]).repartition(3), model).collect()}
    assert a == b


def test_language_id_equals_brute_force(spark):
    """Predictions against cosines with all centroids by plain loops over the n-grams of each text."""
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(frame.where(~held_out()))
    dims = len(model.idf)

    def vector(text):
        raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
        raw = b"    " + raw + b"    "
        counts = Counter()
        for n in (2, 3, 4):
            for k in range(len(raw) - n + 1):
                gram = raw[k : k + n]
                if gram.strip(b" "):
                    code = int.from_bytes(gram, "big")
                    counts[((code * 2654435761 + n * 40503) % 2**32 >> 8) % dims] += 1
        x = {k: math.log1p(v) * float(model.idf[k]) for k, v in counts.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / size for k, v in x.items()}

    got = {r["doc_id"]: r for r in langid.predict_documents(frame).collect()}
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for i, text in texts.items():
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        x = vector(text)
        cos = [sum(v * float(c[k]) for k, v in x.items()) for c in model.centroids]
        assert got[i]["score"] == pytest.approx(max(cos), abs=1e-4)
        assert got[i]["lang_pred"] in {model.langs[model.owner[k]] for k, c in enumerate(cos) if c >= max(cos) - 1e-4}


def test_language_ties_go_to_the_first():
    import numpy as np

    c = langid.unit(langid.gram_counts(["der hund"], 64), np.ones(64, np.float32))
    model = langid.Model(["aa", "bb"], np.ones(64, np.float32), np.concatenate([c, c]), np.array([0, 1]), np.zeros((2, 40)))
    assert model.predict(["der hund", "hund"])[0] == ["aa", "aa"]


@pytest.fixture(scope="module")
def learned(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return frame, langid.fit(frame.where(~held_out()))


def test_language_id_rejects_what_it_does_not_know(learned):
    frame, model = learned
    rng = random.Random(4)
    strange = {
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "base64": base64.b64encode(rng.randbytes(600)).decode(),
    }
    rejected = dict(zip(strange, model.predict(list(strange.values()))[2]))
    assert all(rejected.values()), rejected
    clean = [r["text"] for r in frame.where(held_out()).where("lang is not null").select("text").collect() if langid.has_letter(r["text"])]
    assert len(clean) > 500 and sum(model.predict(clean)[2]) <= 0.01 * len(clean)


@pytest.mark.xfail(reason="open: on this table hex digests come as near to a centroid as known texts do", strict=True)
def test_language_id_rejects_hex(learned):
    rng = random.Random(9)
    assert all(learned[1].predict([" ".join(rng.randbytes(32).hex() for _ in range(12)) for _ in range(20)])[2])


# --- quality ---


def base_fields(text):
    w = words(text)
    n = len(w)
    count = Counter(tuple(w[k : k + 3]) for k in range(n - 2))
    covered = set()
    for k in range(n - 2):
        if count[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_fields(spark):
    rng = random.Random(8)
    rows = awkward() + [(100 + i, "".join(rng.choice(["a ", "b ", "a b ", "\n", "#$ ", "é\t", "x y "]) for _ in range(rng.randrange(200))), "en", "a") for i in range(60)]
    out = quality.judge(docs(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((i, *base_fields(t)) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in out) == want
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert quality.judge(docs(spark, [])).count() == 0


def shannon(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0, kl(p) / 2 + kl(q) / 2))


def test_quality_distances_by_hand(spark):
    plain = "the cat sat on the mat and it was good for all of us in this house " * 1
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample(plain.split() * 6, 80)), "en", "a") for i in range(40)]
    rows.append((99, " ".join(f"zq{k}$$$ |" for k in range(60)), "en", "a"))
    out = {r["doc_id"]: r for r in quality.judge(docs(spark, rows), passes=1).collect()}
    sound = [t for i, t, _, _ in rows if not out[i]["base_failed"]]

    def classes(t):
        c = [len(re.findall(x, t)) for x in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", r"[.,;:!?'\"()\-]")]
        chars = sum(map(len, words(t)))
        return [x / len(t) for x in [*c, chars - sum(c), len(t) - chars]]

    def common(t):
        w = [x.lower() for x in words(t)]
        c = Counter(x for x in w if x in quality.COMMON)
        return [c[x] / len(w) for x in quality.COMMON] + [1 - sum(c.values()) / len(w)]

    for i, t, _, _ in rows:
        if out[i]["base_failed"]:
            continue
        for f, name in ((classes, "class_distance"), (common, "word_distance")):
            mean = [sum(x) / len(sound) for x in zip(*map(f, sound))]
            assert out[i][name] == pytest.approx(shannon(f(t), mean), abs=1e-6)
    assert not out[99]["kept"]


def test_quality_keeps_the_clean(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{data}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good, junk = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.1 * len(junk)


# --- substring dedup ---


def repeated(seed):
    rng = random.Random(seed)
    shared = [prose(1000 + k, rng.randrange(5, 60)) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(seed * 100 + i, rng.randrange(0, 40), 50)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng.random(), rng.randrange(0, 12), 50)]
        rows.append((i, (" " if i % 2 else "\n\t ").join(parts)))
    return rows


@pytest.mark.parametrize("first", [1, 4, 7, 13])
def test_substrings_equal_brute_force(spark, first):
    rows = repeated(first)
    out = substrings.dedup(docs(spark, [(i, t, "en", "a") for i, t in rows]), 13, first).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == cut_windows(rows, 13)
    assert sum(r["n_removed"] for r in out) > 0


def test_substrings_awkward_rows(spark):
    rows = awkward() + [(0, prose(2, 80), "en", "a"), (11, prose(3, 70), "en", "a")]
    out = substrings.dedup(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    gone = Counter((r["doc_id"], r["n_removed"]) for r in out)
    assert gone[6, 80] == 2  # both rows of 6 lose what 0 has
    assert gone[None, 0] == 1 and gone[11, 0] == 1  # a null id neither gives nor loses
    assert substrings.dedup(docs(spark, [])).count() == 0


def test_substrings_of_rows_that_share_an_id(spark):
    """Every row of an id loses what a smaller id has, its own text decides; batches end anywhere inside a text."""
    texts = [prose(300 + k, 60) for k in range(6)]
    rows = [(1, " ".join(texts))] + [(5, f"{prose(k, 20)} {texts[k % 6]}") for k in range(40)] + [(5, prose(k, 20)) for k in range(20)]
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup(frame).collect())
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(1, 360, 0): 1, (5, 80, 60): 40, (5, 20, 0): 20}


def test_substrings_rewrite(spark):
    rows = repeated(4)
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows])
    out = substrings.rewrite(frame)
    assert out.columns == frame.columns
    want = cut_windows(rows, 13)
    for r in out.collect():
        import hashlib

        assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == want[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"])


def test_texts_longer_than_a_slice():
    from tessera.llm import textops

    text = prose(1, 900_000).encode() + b" " + b"x" * 3_000_000
    counts, (h,) = textops.words([b"a b", text, None])
    assert counts.tolist() == [2, 900_001, 0]
    assert (h[2:1002] == textops.words([b" ".join(text.split()[:1000])])[1][0]).all()


# --- SimHash ---


def families(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for f in range(12):
        base = prose(seed * 50 + f, rng.choice([6, 40, 200])).split()
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"z{rng.random()}"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[3][1] + "  ")]
    return rows


def test_simhash_classes_equal_brute_force(spark):
    rows = families(3)
    out = simhash.classes(docs(spark, [(i, t, "en", "a") for i, t in rows]), bucket=16)
    assert {r["doc_id"]: r["class_id"] for r in out.collect()} == near_classes(rows)


def test_simhash_hot_group(spark):
    base = prose(9, 120).split()
    rows = [(i, " ".join(base[:60] + [f"z{i}"] + base[60:])) for i in range(300)] + [(1000 + i, prose(5000 + i, 50)) for i in range(100)]
    out = {r["doc_id"]: r["class_id"] for r in simhash.classes(docs(spark, [(i, t, "en", "a") for i, t in rows]), bucket=8).collect()}
    assert {out[i] for i in range(300)} == {0} and all(out[1000 + i] == 1000 + i for i in range(100))


def test_simhash_finds_what_the_tables_miss(spark):
    # a text of 8 words and one word more share 4 of 5 runs; some of their hashes are farther apart than the tables reach
    rows = [r for k in range(400) for r in ((2 * k, prose(7000 + k, 8)), (2 * k + 1, prose(7000 + k, 8) + " end"))]
    out = {r["doc_id"]: r["class_id"] for r in simhash.classes(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert out == {i: i - i % 2 for i in range(800)}


def test_simhash_is_exact_without_tables_that_reach(spark):
    base = prose(21, 20).split()
    rows = families(7) + [(1000 + i, " ".join(base + [f"y{i % 9}", f"z{i}"])) for i in range(60)]
    for bucket in (1, 512):  # 1: shared runs are compared block against block
        out = simhash.classes(docs(spark, [(i, t, "en", "a") for i, t in rows]), tables=1, distance=0, bucket=bucket)
        assert {r["doc_id"]: r["class_id"] for r in out.collect()} == near_classes(rows)


def chance_runs(many):
    """Texts of four words in random order, so that any two share some runs by chance, and pairs that differ in a word."""
    rows = [(i, prose(900 + i, 60, 4)) for i in range(many)]
    return rows + [(many + i, t + " end") for i, t in rows[:10]]


def test_simhash_moves_no_text_for_chance_runs(spark, monkeypatch):
    rows, moved, texts = chance_runs(150), {}, simhash._texts
    monkeypatch.setattr(simhash, "_texts", lambda docs, nodes, pairs, tag: moved.update({tag: pairs.count()}) or texts(docs, nodes, pairs, tag))
    out = simhash.classes(docs(spark, [(i, t, "en", "a") for i, t in rows]), tables=1, distance=0)
    assert {r["doc_id"]: r["class_id"] for r in out.collect()} == near_classes(rows)
    assert moved["simhash-texts-2"] <= 30  # 10 links; more than a thousand pairs share a run


def test_simhash_rounds(spark, monkeypatch):
    for name, value in (("SMALL", 1), ("ROUND_MET", 2), ("ROUND_PAIRS", 0.05)):
        monkeypatch.setattr(simhash, name, value)
    rows = families(7) + chance_runs(20)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    out = simhash.classes(docs(spark, [(i, t, "en", "a") for i, t in rows]), tables=1, distance=0)
    assert {r["doc_id"]: r["class_id"] for r in out.collect()} == near_classes(rows)


def test_simhash_blocks_in_rounds(spark):
    # 24 texts of 25 runs share the 6 of their prefixes, three of them are one class; one more run is in a single class
    front = spark.createDataFrame([(i, 25, 0 if i < 3 else i, [*range(6), *([77] if i < 3 else [])]) for i in range(24)], "node long, size long, root long, prefix array<long>")
    whole, parts = (simhash.united(simhash.meetings(front, 0.8, cap, 300, "test")).collect() for cap in (100, 2))
    assert sorted(map(tuple, parts)) == sorted(map(tuple, whole)) and len({(r["a"], r["b"]) for r in whole}) == 24 * 23 // 2 - 3


def test_simhash_marks():
    rng = random.Random(4)
    texts = [prose(k, rng.choice([0, 3, 30, 36, 70, 300, 3000]), 50).encode() for k in range(60)] + [None]
    at, value = simhash.shingles(texts)
    marks = simhash.marks(at, value, simhash.signatures(texts)[0]).to_pylist()
    sets = [set(value[at == k].tolist()) for k in range(len(texts))]
    for x, s in zip(marks, sets):
        assert simhash.apart(x, x) == 0
        assert all(simhash.apart(x, y) <= len(s ^ t) and simhash.apart(x, y) == simhash.apart(y, x) for y, t in zip(marks, sets))
    assert len({len(x) for x in marks}) > 3


def test_simhash_awkward_rows(spark):
    rows = awkward() + [(12, None, "en", "a"), (13, "", "en", "a")]
    out = simhash.classes(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in out}
    assert got[2] == (2, True) and got[12] == (12, True)  # null texts stay alone
    assert got[13] == (3, False)  # equal texts are one class, empty ones too
    assert got[None] == (None, True)
    assert simhash.classes(docs(spark, [])).count() == 0


def test_simhash_survivors(spark):
    rows = [(i, t, "en", "a") for i, t in families(5)]
    frame = docs(spark, rows + [rows[2]])
    out = simhash.survivors(frame, bucket=16)
    assert out.columns == frame.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(near_classes([(i, t) for i, t, _, _ in rows]).values()))


# --- toxicity ---


def labelled(spark, n=300):
    rng = random.Random(6)
    bad = ["blorgh", "snarfle", "gruntok"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = prose(i, rng.randrange(20, 60)).replace("w", "ba").split()
        if toxic:
            w[rng.randrange(len(w))] = bad[(i // 4) % 3]
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_held_out_rows(spark):
    rows, labels = labelled(spark)
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs(spark, rows), labels).collect()}
    for i, _, _, _ in rows:
        assert out[i]["held_out"] == held(i)
        assert out[i]["predicted"] == (i % 4 == 0) == (out[i]["score"] >= 0.7)


def test_toxicity_reads_through_disguise(spark):
    rows, labels = labelled(spark)
    scorer = toxicity.fit(docs(spark, rows), labels)
    for word in ("blorgh", "bl0rgh", "b l o r g h", "b.l.o.r.g.h", "blooorgh", "5narfle", "snarf1e", "grunt0k", "GRUNTOK!", "snarfl3", "8lorgh", "6runtok", "b/l/o/r/g/h", "b~l~o~r~g~h", "8 l o r g h", "b  l  o  r  g  h", "snarfl€."):
        assert scorer.score(f"ba12 ba7 {word} ba3") >= 0.7, word
    for text in ("", None, "ba1 ba2 ba3", "call 555 100 200 or mail8@x.example", "a b c"):
        assert scorer.score(text) < 0.7


def test_suspects_at_the_ends_of_words():
    want = {"hell0": "hell0", "a$$": "a$$", "assh0le$": "assh0le$", "@ss": "@ss", "8itch": "8itch", "+rash": "+rash", "(1diot)": "1diot", "hat3,": "hat3", "i/d/i/o/t": "i/d/i/o/t", "1 d i o t": "1 d i o t", "i  d  i  o  t": "i  d  i  o  t"}
    for text, stretch in want.items():
        assert stretch in toxicity.suspects(f"well {text} then"), text
    for text in ("well! then", "12 34 56", "1 2 3 4", "it costs 50$ or 20", "2024-01-02", "no. 7, yes"):
        assert not toxicity.suspects(text), text


def test_toxicity_scores_equal_brute_force(spark):
    """Evidence and scores of a learned model by plain loops over all words."""
    rows, labels = labelled(spark)
    rows += [(900, "blorghi blorghu blorgho blorgha ba1 ba2", "en", "a"), (901, "", "en", "a")]
    scorer = toxicity.fit(docs(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), scorer).collect()}
    for i, text, _, _ in rows:
        low = text.lower()
        found = {w for w in re.split(r"[\W\d_]+", low) if w}
        for s in toxicity.suspects(low):
            found |= {w for w in re.split(r"[\W\d_]+", toxicity.viterbi(toxicity.lattice(s), scorer.lm.tolist())) if w}
        evidence = {"=" + w for w in found}
        for k in (4, 5, 6, 7):
            for start in {w[:k] for w in found if len(w) > k}:
                evidence.add(start)
                if sum(len(w) > k and w.startswith(start) for w in found) >= max(3, len(found) / 100):
                    evidence.add(start + "+")
        evidence &= scorer.weights.keys()
        z = scorer.bias + sum(scorer.weights[f] for f in evidence)
        assert got[i] == pytest.approx(max([1 / (1 + math.exp(-z)), *(scorer.precision[f] for f in evidence)]), abs=1e-9)


def test_viterbi_is_the_best_reading():
    counts = toxicity.trigram_counts(["the idiot said the idea is in the id"] * 20)
    model = toxicity.language_model(counts)
    from itertools import product

    def best(units):
        def total(choice):
            a = b = 0
            p = sum(c for _, c in choice)
            for x in toxicity.symbols("".join(s for s, _ in choice) + " ").tolist():
                p += model[(a * 64 + b) * 64 + x]
                a, b = b, x
            return p

        top = max(product(*units), key=total)
        return "".join(s for s, _ in top).rstrip(" ")

    for stretch in ("1d1ot", "i d i o t", "iddiot", "id*ot", "th3"):
        units = toxicity.lattice(stretch)
        assert toxicity.viterbi(units, model.tolist()) == best(units)


def test_toxicity_awkward_rows(spark):
    rows, labels = labelled(spark, 120)
    mixed = labels.union(spark.createDataFrame([(None, 1), (1, None), (2, 5), (4, 1), (4, 0)], "doc_id long, toxic int"))
    every = [(i + 1000 if i is not None else None, t, la, s) for i, t, la, s in awkward()] + rows
    out = toxicity.score_documents(docs(spark, every), mixed).collect()
    assert len(out) == len(every) and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs(spark, awkward()), none).collect()} == {0.0}
    assert toxicity.score_documents(docs(spark, []), none).count() == 0
