"""Language ID, scoring, personal data, licenses and segmentation on small fixtures."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.llm import classlm, langid, licenses, nbest, pii


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_langid_held_out_accuracy(spark, table):
    docs = table.select("doc_id", "text", "lang")
    langs, prototypes = langid.learn(docs.where(~langid.held_out()))
    got = langid.predict(docs, langs, prototypes).join(docs, "doc_id").collect()
    held = [r for r in got if fold(r["doc_id"], 3) == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_langid_of_awkward_rows(docs):
    langs, prototypes = langid.learn(docs.select("doc_id", "text", "lang"))
    rows = langid.predict(docs, langs, prototypes).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[1][0] == "de" and got[9][0] == "en"
    assert langid.learn(docs.limit(0).select("doc_id", "text", "lang"))[0] == []
    assert {r["lang_pred"] for r in langid.predict(docs, [], np.zeros((0, 64))).collect()} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_rows_in_no_known_language_go(spark):
    rnd = random.Random(2)
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = ["".join(rnd.choices("日本語文字列漢仮名交", k=300)), "".join(rnd.choices("0123456789qxzjkwQXZJKW+/", k=400)), "Привет мир и всем " * 20]
    short = ["Grüße", "東京"]
    more = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(odd + short)], "doc_id long, text string, lang string")
    blank = sf.where("doc_id < 100").select((F.col("doc_id") + 2 * 10**6).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    kept = {r["doc_id"]: r for r in langid.keep_known(sf.union(more).union(blank)).collect()}
    assert [10**6 + k in kept for k in range(5)] == [False, False, False, True, True]
    was = {r["doc_id"]: r["lang"] for r in sf.collect()}
    assert all(d in kept and kept[d]["lang"] == l for d, l in was.items())
    again = [kept[d]["lang"] == was[d - 2 * 10**6] for d in kept if d >= 2 * 10**6]
    assert len(again) == blank.count() and sum(again) >= 0.95 * len(again)


def test_predictions_against_brute_force(spark, table):
    """n-grams bound and bundled one by one, prototypes and cosines in plain Python."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table.select("doc_id", "text", "lang").limit(60).collect()]
    e = langid.Encoder(64)

    def vector(text):
        t = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        return sum((np.roll(e._letter(ord(a)).astype(float), 2) * np.roll(e._letter(ord(b)), 1) * e._letter(ord(c)) for a, b, c in zip(t, t[1:], t[2:])), np.zeros(64))

    vectors = {d: vector(t) for d, t, _ in docs}
    langs = sorted({l for _, _, l in docs})
    prototypes = np.array([sum(vectors[d] / np.linalg.norm(vectors[d]) for d, _, l in docs if l == x) for x in langs])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found, learned = langid.learn(df, dim=64)
    assert found == langs and np.allclose(learned, prototypes, atol=1e-5)
    for r in langid.predict(df, found, learned).collect():
        cosine = prototypes @ vectors[r["doc_id"]] / np.linalg.norm(vectors[r["doc_id"]])
        assert abs(max(cosine.max(), 0) - r["score"]) < 1e-4 and cosine[langs.index(r["lang_pred"])] > cosine.max() - 1e-4


def test_pieces_and_batches_do_not_change_vectors(monkeypatch):
    texts = ["The cat  sat, on the mat!", "x", "", None, "abc " * 50, "été où", "12 34"]
    whole, _ = langid.Encoder(64).encode(texts)
    monkeypatch.setattr(langid, "PIECE", 7)
    pieces, lettered = langid.Encoder(64).encode(texts)
    assert np.array_equal(whole, pieces) and lettered.tolist() == [True, True, False, False, True, True, False]
    assert np.array_equal(langid.Encoder(64).encode(texts[4:5])[0][0], whole[4])


def test_ngram_vectors_are_bound_rotated_letters():
    e = langid.Encoder(32)
    v, _ = e.encode(["ab"])
    a, b, s = (e._letter(ord(c)).astype(int) for c in "ab ")
    want = np.roll(s, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * s
    assert np.array_equal(v[0], want)


@pytest.mark.parametrize("head", [40, 1 << 17])
def test_classlm_counts_and_probabilities(spark, table, head):
    """With a small head most words go through the join; the figures must be the same as by hand."""
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    words = {d: t.encode().translate(classlm.LOWER).split() for d, t in rows}
    train = [d for d in words if fold(d, 5) != 1]
    c = collections.Counter(w for d in train for w in words[d])
    n, v = sum(c.values()) + len(train), len(c) + 1
    low = math.log10(n + 0.5 * (v + 1))
    got = classlm.score_documents(table, head=head, core=20, classes=5).collect()
    assert len(got) == len(rows)
    better = 0
    for r in got:
        w = words[r["doc_id"]]
        base = sum(math.log10(c[x] + 0.5) - low for x in w) + math.log10(len(train) + 0.5) - low
        assert abs(base - r["base_score"]) < 1e-6
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        better += r["held_out"] and r["score"] > r["base_score"]
    assert better >= 0.8 * sum(r["held_out"] for r in got)


def learned(table, tables, **options):
    """The model, the class and count of every training word, and the training texts' words."""
    rows = table.select("doc_id", (classlm.fold("doc_id", 5) == 1).alias("held_out"), classlm.text_bytes().alias("_t"))
    train = [classlm._words(bytes(r["_t"])) for r in rows.where("not held_out").collect()]
    model, beyond, tokens, encoded, n = classlm.learn(rows.where("not held_out").select("_t"), rows, tables, **options)
    head = sorted(collections.Counter(w for t in train for w in t).items(), key=lambda x: (-x[1], x[0]))[: len(model.of)]
    known = {w: (int(k), c) for (w, c), k in zip(head, model.of, strict=True)} | {bytes(r["w"]): (r["of"], r["c"]) for r in beyond.collect()}
    return model, known, train, classlm.score(encoded, model, tokens, n)


@pytest.mark.parametrize("head", [60, 1 << 17])
def test_classlm_scores_by_hand(spark, table, head):
    with classlm.Tables(spark, "test") as tables:
        model, known, train, scored = learned(table, tables, head=head, core=20, classes=4)
        counts = collections.Counter(w for t in train for w in t)
        assert {w: c for w, (_, c) in known.items()} == counts
        # All words that occur twice have a class of their own kind; the class of unseen words holds the others.
        assert all((k == model.rare) == (c < classlm.LEAST) for k, c in known.values())
        size = collections.Counter()
        for k, c in known.values():
            size[k] += c
        ones = sum(k == model.rare for k, _ in known.values())
        texts = {r["doc_id"]: classlm._words((r["text"] or "").encode()) for r in table.collect()}
        for r in scored.collect():
            before, want = model.end, 0.0
            for w in texts[r["doc_id"]]:
                k, c = known.get(w, (model.rare, 0))
                want += model.move[before, k] + (math.log10((c + 0.5) / (size[k] + 0.5 * (ones + 1))) if k == model.rare else math.log10(c / size[k]))
                before = k
            assert abs(want + model.move[before, model.end] - r["score"]) < 1e-6
        # Transitions come from all bigrams of the training texts.
        pairs = collections.Counter()
        for t in train:
            k = [model.end, *(known[w][0] for w in t), model.end]
            pairs.update(zip(k, k[1:]))
        table_of = np.array([[pairs[a, b] for b in range(model.end + 1)] for a in range(model.end + 1)])
        assert np.allclose(classlm.transitions(table_of), model.move)
        assert np.allclose((10**model.move).sum(axis=1), 1)


def test_classlm_beats_classes_by_last_byte(spark, table):
    """Held-out score of the learned classes against classes given by a word's last byte, all else alike."""
    docs = [(r["doc_id"], classlm._words((r["text"] or "").encode())) for r in table.collect()]
    train = [w for d, w in docs if fold(d, 5) != 1]
    held = {d: w for d, w in docs if fold(d, 5) == 1}
    counts = collections.Counter(w for t in train for w in t)
    of = {w: w[-1] % 64 for w in counts}
    pairs, size = np.zeros((66, 66)), collections.Counter()
    for t in train:
        k = [65, *(of[w] if counts[w] >= classlm.LEAST else 64 for w in t), 65]
        np.add.at(pairs, (k[:-1], k[1:]), 1)
    for w, c in counts.items():
        size[of[w] if c >= classlm.LEAST else 64] += c
    move, ones, plain = classlm.transitions(pairs), sum(c < classlm.LEAST for c in counts.values()), 0.0
    for w in held.values():
        k = [65, *(of[x] if counts[x] >= classlm.LEAST else 64 for x in w), 65]
        plain += move[k[:-1], k[1:]].sum()
        plain += sum(math.log10(counts[x] / size[of[x]]) if counts[x] >= classlm.LEAST else math.log10((counts[x] + 0.5) / (size[64] + 0.5 * (ones + 1))) for x in w)
    got = classlm.score_documents(table).where("held_out").agg({"score": "sum"}).first()[0]
    assert got > plain


def test_exchange_groups_words_of_like_context():
    b = np.zeros((5, 5), dtype=np.int64)
    for a, x, n in ((0, 2, 40), (0, 3, 38), (1, 2, 41), (1, 3, 39), (2, 4, 80), (3, 4, 78), (4, 0, 80), (4, 1, 79)):
        b[a, x] = n
    of = classlm.exchange(b, 4, classes=2)
    assert of[0] == of[1] != of[2] == of[3] and of[4] == 2


def test_classlm_of_awkward_rows(docs):
    got = classlm.score_documents(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[2]["base_score"] == by[3]["base_score"]
    assert classlm.score_documents(docs.limit(0)).count() == 0
    alone = classlm.score_documents(docs.where("doc_id = 1")).first() if fold(1, 5) == 1 else None
    assert alone is None or (alone["train_tokens"] == 0 and alone["n_known"] == 0)


def plain_spans(t):
    def luhn(d):
        x = [int(c) for c in d[::-1]]
        return (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10 == 0

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_patterns():
    rnd = random.Random(0)
    pieces = ["a", "b.c", "@", "@@", "x-y", ".", "1", "255", "256", "4111111111111111", " ", "-", "+4", "+", "(", ")", "99", "é", "\n", "%", "_", "0001"]
    for _ in range(6000):
        t = "".join(rnd.choices(pieces, k=rnd.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_of_awkward_rows(docs):
    got = pii.find(docs, carry=("source", "rank"))
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert (by[10]["n_email"], by[10]["n_ip"], by[10]["n_card"], by[10]["n_phone"]) == (1, 1, 1, 1) and by[10]["rank"] == 9
    assert by[10]["masked"] == "Mail [EMAIL] or call [PHONE], host [IP], card [CARD]."
    assert by[2]["spans"] == by[3]["spans"] == "" and by[7]["masked"] == docs.where("doc_id = 7").first()["text"]
    assert pii.find(docs.limit(0)).count() == 0


def test_skip_chains_carry_labels_to_repeated_tokens():
    """A number that is a phone number once is one elsewhere in the text too; the same number in a text without the first is not."""
    rnd = random.Random(4)
    texts = []
    for _ in range(300):
        number = "%d" % rnd.randint(10**9, 10**10 - 1)
        other = "%d" % rnd.randint(10**9, 10**10 - 1)
        texts += [f"call +{number} or +{number} now", f"item {other} in stock"]
    spans = [pii.base_spans(t) for t in texts]
    g = pii.Graph()
    for i, (t, s) in enumerate(zip(texts, spans, strict=True)):
        g.add(i, t, s)
    ends, is_skip = g.edges()
    assert is_skip.sum() == 300
    w = pii.Weights().fit(np.array(g.features), np.array(g.gold), ends, is_skip)
    phone = pii.KINDS.index("phone") + 1
    assert w.skip[phone, phone] > w.skip[phone, 0]
    assert is_skip.any() and not (np.array(g.gold)[ends[is_skip]] == 0).any()
    probe = pii.Graph()
    for i, t in enumerate(["call +4912345678 and then 4912345678", "then 4912345678"]):
        probe.add(i, t, pii.base_spans(t))
    ends, is_skip = probe.edges()
    share = w.marginals(np.array(probe.features), ends, is_skip, np.array(probe.gold))
    assert share[1, phone] > 0.9 > share[2, phone]


def test_the_field_adds_repeated_and_similar_tokens(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    planted = [
        (f'token = "{key}" is used. Later {key} again', [("secret", key), ("secret", key)]),
        ("Call +49 030 1234567 at noon. The number 0301234567 is home.", [("phone", "0301234567")]),
        ("Mail john.smith@corp.example.com or john.smith@CORP soon", [("email", "john.smith@CORP")]),
        ("Only 12345, 0301234567 and 4111111111111112 here", []),
        ("Version 1.2.3 of 2024-01-02, 3 items", []),
    ]
    rows = [(f"{k}", t) for k, (t, _) in enumerate(planted)]
    plain = table.select(F.concat(F.lit("t"), "doc_id").alias("doc_id"), "text")
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id string, text string").union(plain)).collect()}
    for (doc, text), (_, want) in zip(rows, planted, strict=True):
        base = pii.write(pii.base_spans(text))
        added = [x.split(":") for x in got[doc]["spans"].split(",") if x and x not in base.split(",")]
        assert [(k, text[int(a) : int(b)]) for k, a, b in added] == want, text
        assert got[doc]["n_added"] == len(want) and all(x in got[doc]["spans"].split(",") for x in base.split(",") if x)
        assert key not in got[doc]["masked"]
    assert sum(r["n_added"] for r in got.values()) > 6


def test_belief_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    w = pii.Weights()
    k = pii.LABELS
    w.unary[0], w.chain, s = rng.normal(size=k), rng.normal(size=(k, k)), rng.normal(size=(k, k))
    w.skip = s + s.T
    f = np.zeros((3, pii.N_FEATURES))
    f[:, 0] = 1
    f[1, 0] = 2
    ends, is_skip = np.array([[0, 1], [1, 2]]), np.array([False, True])
    p = np.zeros((k, k, k))
    for i in np.ndindex(k, k, k):
        p[i] = np.exp(sum(f[n, 0] * w.unary[0, i[n]] for n in range(3)) + w.chain[i[0], i[1]] + w.skip[i[1], i[2]])
    p /= p.sum()
    got = w.marginals(f, ends, is_skip)
    assert np.allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=2e-3)


def test_licenses():
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = s.scan("Some words before.\n" + text + "\nAnd some after it.")
        assert name in {f[2] for f in found}, (name, found)
    assert s.scan("Licensed under CC BY-NC 4.0.")[0][2] == "cc-by-nc-4.0"
    edited = licenses.TEMPLATES["mit-notice"].replace("free of charge", "for a small fee")
    (found,) = [f for f in s.scan("/*\n * " + "\n * ".join(edited[k : k + 70] for k in range(0, len(edited), 70)) + "\n */") if f[2] == "mit-notice"] or [None]
    assert found is not None and found[5] + found[6] > 0
    for clean in ("We have a driving licence and a warranty.", "permission was given to copy the key", "version 3 of the story", ""):
        assert s.scan(clean) == []
    assert not any(f[2].startswith("gpl-2") for f in s.scan(licenses.TEMPLATES["gpl-3.0"]))


def test_licenses_of_awkward_rows(spark, docs):
    assert licenses.scan_licenses(docs).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License.\nx\nReleased under the MIT License."), (1, None)], "doc_id long, text string")
    assert [(r["start"], r["end"], r["license"]) for r in licenses.scan_licenses(twice).orderBy("start").collect()] == [(0, 30, "mit"), (34, 64, "mit")]


def test_every_notice_of_a_line_is_found():
    s = licenses.Scanner(licenses.TEMPLATES)
    line = "Released under the MIT License. Licensed under CC BY 4.0."
    assert [(line[a:b], n) for a, b, n, *_ in s.scan(line)] == [("Released under the MIT License", "mit"), ("Licensed under CC BY 4.0", "cc-by-4.0")]
    rnd = random.Random(3)
    # The license itself is part of some templates: these are told apart by what else they hold.
    names = ["all-rights-reserved", "bsd-2-clause", "bsd-license", "cc-by-nc-4.0", "cc0-1.0", "gpl-2.0", "isc", "mit", "mit-notice", "unlicense"]
    for _ in range(40):
        some = rnd.sample(names, rnd.randint(1, 4))
        parts = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=rnd.randint(0, 12))) for _ in range(len(some) + 1)]
        text = parts[0] + "".join(f" {licenses.TEMPLATES[n]} {p}" for n, p in zip(some, parts[1:], strict=True))
        assert [x[2] for x in s.scan(text)] == some, text
        # Far into a line that is compared in pieces.
        long = "word " * 3000 + text + " word" * 3000
        assert [(a - 15000, b - 15000, n) for a, b, n, *_ in s.scan(long)] == [(a, b, n) for a, b, n, *_ in s.scan(text)] or len(text) > licenses.OVERLAP


def test_cues_lose_no_template():
    for name, text in licenses.TEMPLATES.items():
        held = [w for w in licenses.words(text) if any(c in w for c in licenses.CUES)]
        assert held or any(c in text.lower() for c in licenses.CUES), name


def test_license_ties_and_clashing_columns(spark):
    two = {"b": "Released under the Foo License.", "a": "Released under the Foo License."}
    rows = [(1, "Released under the Foo License.", "x", 5), (1, "Released under the Foo License.", "x", 5), (2, "", "y", 6)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string, start int"), templates=two).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "a"), (1, "a")]


@pytest.fixture(scope="module")
def segmenter():
    return nbest.Segmenter(nbest.model_path(), 4)


def test_n_best_against_all_segmentations(segmenter):
    p = segmenter.pieces
    for k in range(400):
        rnd = random.Random(k)
        text = "".join(rnd.choice("the ando\nz é漢▁x") for _ in range(rnd.randint(1, 9)))
        whole = nbest.SPACE + text.replace(nbest.SPACE, nbest.REAL).replace(" ", nbest.SPACE)
        paths = {0: [(0.0, ())]}
        for end, some in enumerate(p.edges(whole)):
            if end:
                paths[end] = [(a + s, i + ids) for start, ids, s in some for a, i in paths[start]]
        every = sorted((s for s, _ in paths[len(whole)]), reverse=True)[:4]
        ((scores, ids),) = segmenter.encode([text])
        assert np.allclose(scores, every) and len(set(ids)) == len(ids)
        assert all(segmenter.decode(i) == text.encode() for i in ids)


def test_a_star_equals_the_numpy_pass(segmenter):
    for chunk in ("▁international", "▁▁▁x", "abcdefghijklmnopqrstuvwx", "\n"):
        (best,), (gap,), (ids,) = segmenter._together([chunk])
        found = nbest.n_best(segmenter.pieces, chunk, 2)
        assert np.isclose(best, found[0][0]) and np.array(found[0][1], dtype="<i4").tobytes() == ids
        assert gap == np.inf if len(found) < 2 else np.isclose(gap, found[0][0] - found[1][0])


def test_n_best_of_awkward_rows(docs):
    got = nbest.encode_n_best(docs)
    assert got.count() == docs.count() and got.where("not round_trip").count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["n_pieces"] == by[3]["n_pieces"] == 0 and by[0]["ids_crc32"] == by[5]["ids_crc32"]
    assert all(a >= b for r in by.values() for a, b in zip(r["scores"], r["scores"][1:]))
    assert nbest.encode_n_best(docs.limit(0)).count() == 0
