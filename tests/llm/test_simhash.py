import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cloudweave.llm import simhash


def slow_fingerprint(text, n=4):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    s = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_of_awkward_texts(docs):
    for text in [r["text"] or "" for r in docs.select("text").collect()]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_key_sets_catch_every_four_bytes():
    for width in (3, 4):
        sets = simhash.key_sets(width)
        assert all(any(set(s) <= set(four) for s in sets) for four in itertools.combinations(range(8), 4))
    assert len(simhash.key_sets(3)) == 20


def test_links_against_all_pairs(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = classes([(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4], signed)
    reps = spark.createDataFrame([(f,) for f in signed], "fp long")
    # Both widths of keys, and keys treated as crowded.
    for width, limit in ((3, 1 << 15), (4, 1 << 15), (3, 3)):
        found = [(r["x"], r["y"]) for r in simhash.links(reps, width, limit).collect()]
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in found)  or limit == 3
        assert classes(found, signed) == want


def test_classes_of_awkward_rows(docs):
    got = simhash.simhash_classes(docs)
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == docs.count()
    of = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert of[0] == of[5] == 0 and of[2] == of[3] == 2 and of[11] == of[12] == 11 and of[None] is None
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


def test_keep_one_of_each(docs):
    found = simhash.simhash_classes(docs)
    kept = simhash.keep_one_of_each(docs, found)
    assert kept.columns == docs.columns
    # One row for each class; text 6 repeats one sentence and so has the fingerprint of text 0.
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in found.collect() if r["component_id"] is not None})


def jaccard(a, b):
    a, b = (set(simhash.shingle_set(t.encode().translate(simhash.LOWER).split()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_duplicates_by_similarity(spark):
    rnd = random.Random(2)
    texts, ids = {}, itertools.count()
    for _ in range(12):
        words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(150)]
        for changes in (0, 0, 1, 2, 8, 20):
            w = list(words)
            for k in rnd.sample(range(150), changes):
                w[k] = "changed%d" % rnd.randint(0, 10**6)
            texts[next(ids)] = " ".join(w)
    want = classes([(a, b) for a, b in itertools.combinations(texts, 2) if jaccard(texts[a], texts[b]) >= 0.8], texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_classes(df).collect()}
    assert sum(got[k] != want[k] for k in texts) <= 1


def test_near_duplicates_of_awkward_rows(docs):
    got = simhash.near_duplicate_classes(docs)
    of = {r["doc_id"]: r["component_id"] for r in got.collect()}
    # Text 9 is 0.9 similar to text 0.
    assert of[0] == of[5] == of[9] == 0 and of[2] == of[3] == 2 and None not in of
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0


def test_sketches_never_rule_out_similar_sets():
    rnd = np.random.default_rng(6)
    for n in (1, 5, 63, 64, 65, 300, 5000, 40_000):
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        for lost in {0, n // 20, n // 9, n // 5}:
            b = np.unique(np.append(a[lost:], rnd.integers(0, 1 << 63, lost // 3).astype(np.uint64)))
            x, y = simhash.parity_sketch(a), simhash.parity_sketch(b)
            width = min(len(x), len(y))
            apart = (int.from_bytes(simhash._folded(x, width)) ^ int.from_bytes(simhash._folded(y, width))).bit_count()
            shared = len(np.intersect1d(a, b))
            assert apart <= len(a) + len(b) - 2 * shared
            if shared >= 0.8 * (len(a) + len(b) - shared):
                assert apart <= simhash._most_apart(len(a), len(b), 0.8)


def test_tally_keeps_exactly_the_near_fingerprints():
    rnd = random.Random(8)
    diff = np.array([sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for _ in range(3000)], dtype=np.uint64)
    assert simhash._near(diff, 4).tolist() == np.flatnonzero(np.bitwise_count(diff) <= 4).tolist()


def test_query(spark, sf, table):
    from cloudweave.llm.queries import queries

    got = queries()["op1_simhash"](spark, sf)
    assert got.count() == table.count() and got.where(F.length("fingerprint") != 16).count() == 0


def star(rnd, copies, words=300, edits=5):
    """An original and copies similar to it, hardly to one another."""
    base = ["w%d" % rnd.randrange(10**9) for _ in range(words)]
    texts = [" ".join(base)]
    for c in range(copies):
        w = list(base)
        for k in rnd.sample(range(words), edits):
            w[k] = "e%d" % rnd.randrange(10**9)
        texts.append(" ".join(w))
    return texts


def test_a_star_of_copies_is_one_class(spark):
    texts = star(random.Random(3), 2000)
    assert all(jaccard(texts[0], t) >= 0.8 for t in texts)
    # The original is not the smallest id.
    df = spark.createDataFrame(list(enumerate(texts[1:] + texts[:1])), "doc_id long, text string")
    got = simhash.near_duplicate_classes(df)
    assert got.count() == 2001 and got.where("component_id <> 0").count() == 0


def test_crowds_without_a_centre(spark, monkeypatch):
    # Chains inside crowds, and crowds whose members are not similar: whole crowds, and small blocks with few tests a turn.
    rnd = random.Random(4)
    texts = []
    for _ in range(3):
        w = ["w%d" % rnd.randrange(10**9) for _ in range(60)]
        for k in range(40):
            texts.append(" ".join(w))
            w[k : k + 1] = ["e%d" % rnd.randrange(10**9)]
    same = " ".join("s%d" % k for k in range(20))
    texts += [same + "".join(" t%d" % rnd.randrange(10**9) for _ in range(rnd.choice((2, 3, 30)))) for _ in range(60)]
    want = classes([(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8], range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for all_pairs, block, tests in ((24, 2048, 8), (3, 7, 1)):
        monkeypatch.setattr(simhash, "ALL_PAIRS", all_pairs)
        monkeypatch.setattr(simhash._link_crowds, "__defaults__", (block, tests))
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_classes(df).collect()} == want


def test_near_duplicates_with_passages_changed(spark):
    rnd = random.Random(5)
    texts = []
    for words in (12, 50, 100, 300):
        for _ in range(10):
            w = ["w%d" % rnd.randrange(10**9) for _ in range(words)]
            new = ["n%d" % rnd.randrange(10**9) for _ in range(words)]
            size, at = max(1, words // 5 - 3), rnd.randrange(words // 2)
            # A passage added at the end, cut from the end, and put in place of another: each with its own copy of the text.
            for pair in ((w, w + new[:size]), (w[: words - size], w), (w, w[:at] + new[: size // 2] + w[at + size // 2 :])):
                texts += [" ".join("%s.%d" % (x, len(texts)) for x in p) for p in pair]
    pairs = [(k, k + 1) for k in range(0, len(texts), 2)]
    alike = [jaccard(texts[a], texts[b]) >= 0.8 for a, b in pairs]
    assert sum(alike) >= 80
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_classes(df).collect()}
    assert [got[a] == got[b] for a, b in pairs] == alike


def test_near_duplicates_keep_rows_without_an_id_and_other_texts_of_an_id(spark):
    one, two, three = (" ".join("%s%d" % (c, k) for k in range(40)) for c in "abc")
    rows = [(None, one), (None, "no id"), (1, one), (1, two), (2, two), (3, three), (3, three), (3, one + " more"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = __import__("corpus_pipeline").near_duplicates(spark, df, "").select("doc_id", "text").collect()
    want = [(None, one), (None, "no id"), (1, one), (1, two), (3, three), (4, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_crowd_gives_fewer_links_than_members():
    import pyarrow as pa

    # Copies similar to one another, copies similar to their original only, and texts that only share a passage.
    rnd = random.Random(9)
    texts = star(rnd, 120, 120, 1) + star(rnd, 120, 100, 2) + [" ".join("p%d" % k for k in range(30)) + " q%d" % rnd.randrange(10**9) * rnd.choice((1, 40)) for _ in range(20)]
    sets = [simhash.shingle_set(t.encode().split()) for t in texts]
    m = len(texts)
    for parts, tests in ((1, 2), (2, 1)):
        rows = pa.table({
            "node": pa.array(range(m), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "pos": pa.array([0] * m, pa.int32()), "c": pa.array(range(m), pa.int64()),
            "slice": pa.array([k % parts for k in range(m)], pa.int32()), "bits": [simhash.parity_sketch(s) for s in sets], "_t": [t.encode() for t in texts],
        })
        got = simhash._crowd_links(tests, 0.8)(rows)
        links = list(zip(got.column("src").to_pylist(), got.column("dst").to_pylist(), strict=True))
        pairs = [(a, b) for a, b in itertools.combinations(range(m), 2) if (parts == 1 or a % 2 != b % 2) and jaccard(texts[a], texts[b]) >= 0.8]
        assert len(links) < m < len(pairs) and set(links) <= set(pairs) | {(b, a) for a, b in pairs}
        assert classes(links, range(m)) == classes(pairs, range(m))
