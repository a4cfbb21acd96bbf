"""Packing, sharding, media, search and the pipeline."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloudweave.llm import ann, packing, sharding, telephony
from cloudweave.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_those_of_the_tokenizers_library(tokenizer):
    import random

    e = packing.Encoder(packing.vocabulary_path())
    alphabet = [*"ab Z9.'s!\n\r\t\x0b\x1c\x1f\x85\xa0é漢<|>", " ", "　", "​", "﻿", "\U0001f600", "<|endoftext|>", "'re", "  ", "\n\n", " the"]
    for k in range(3000):
        rnd = random.Random(k)
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        assert e(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_ids_of_long_runs(tokenizer):
    e = packing.Encoder(packing.vocabulary_path())
    for text in (" " * 2_000_000 + "x", "a" + " " * 300_000, "\n" * 200_000 + " b", "\u3000" * 50_000, "ab" * 100_000, " \n" * 1000):
        assert e(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_sentences_are_cut_only_where_longer_than_a_sequence():
    at, penalty = packing.candidates(np.array([100, 900, 3000]), np.array([1500, 3200]), 3200, 1024)
    inside = at[penalty == packing.HARD_PENALTY]
    assert len(inside) and inside.min() > 1500 and inside.max() < 3000


def test_added_tokens_are_those_of_the_tokenizers_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x <|endoftext|", "  <|endoftext|>\n\n", "none"]
    e = packing.Encoder(packing.vocabulary_path(), packing.added_tokens())
    for text in texts:
        assert e(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(packing.pack(df).collect(), dict(enumerate(texts)), plain)


def check_packing(rows, texts, tokenizer, size=1024):
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(windows)


def test_packing_is_whole_and_tight(table, tokenizer):
    rows = packing.pack(table.coalesce(1), run_tokens=5000).collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    many = check_packing(rows, texts, tokenizer)
    assert sum(r["length"] for r in rows) > 0.96 * 1024 * (many - 1)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    seen = list(dict.fromkeys(order))
    assert seen == [r["doc_id"] for r in table.coalesce(1).select("doc_id").collect()]


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        total, size = int(rng.integers(5, 40)), 8
        at = np.unique(np.concatenate([[0, total], np.arange(0, total, 8), rng.integers(1, total, 8)]))
        penalty = rng.integers(0, 6, len(at))
        best = np.full(len(at), np.inf)
        best[0] = 0
        for j in range(1, len(at)):
            best[j] = min((best[i] + penalty[j] + size - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= size), default=np.inf)
        cuts = packing.best_cuts(at.tolist(), penalty.tolist(), size, False)
        of = dict(zip(at.tolist(), penalty.tolist(), strict=True))
        assert sum(of[b] + size - (b - a) for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_packing_of_awkward_rows(docs, tokenizer):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(some).collect(), {r["doc_id"]: r["text"] or "" for r in some.collect()}, tokenizer)
    assert packing.pack(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packing.pack(docs.limit(0)).count() == 0


def test_shards_against_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries()["op10_stratified_shards"](spark, sf).toPandas()
    want = c.sql(oracle_sql()["op10_stratified_shards"]).df()[list(got.columns)]
    assert got.sort_values("doc_id").astype(str).values.tolist() == want.sort_values("doc_id").astype(str).values.tolist() or (
        got.drop(columns="grown_shard").sort_values("doc_id").values.tolist() == want.drop(columns="grown_shard").sort_values("doc_id").values.tolist()
    )


def test_shards_match_the_mixture_in_any_blocking(spark):
    df = spark.createDataFrame([(k, "t" * (k % 7), "big" if k % 3 else "s%d" % (k % 15)) for k in range(900)], "doc_id long, text string, source string")
    one, many = (sorted(map(tuple, sharding.stratified_shards(df, 7, block_rows=b).collect())) for b in (10_000, 50))
    assert one == many
    got = sharding.stratified_shards(df, 6, block_rows=100).join(df.select("doc_id", "source"), "doc_id")
    share = {(r["shard"], r["source"]): r["n"] for r in got.groupBy("shard", "source").agg(F.count("*").alias("n")).collect()}
    for source, total in {r["source"]: r["n"] for r in df.groupBy("source").agg(F.count("*").alias("n")).collect()}.items():
        assert all(abs(share.get((s, source), 0) - total / 6) <= 1.01 for s in range(6))


def test_shards_of_awkward_rows(docs):
    rows = sharding.stratified_shards(docs, 4).collect()
    assert len(rows) == docs.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values()) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {8}
    assert sharding.stratified_shards(docs.limit(0)).count() == 0


def test_companding_tables():
    assert telephony.MU[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_adpcm_against_one_block_at_a_time():
    blocks = np.random.default_rng(0).integers(0, 256, (40, 192), dtype=np.uint8)
    for b, got in zip(blocks, telephony.ima_decode(blocks), strict=True):
        p, i = int.from_bytes(b[:2].tobytes(), "little", signed=True), min(int(b[2]), 88)
        want = [p]
        for nibble in (n for byte in b[4:].tolist() for n in (byte & 15, byte >> 4)):
            step = int(telephony.IMA_STEPS[i])
            d = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            p = max(-32768, min(32767, p - d if nibble & 8 else p + d))
            i = max(0, min(88, i + int(telephony.IMA_MOVES[nibble & 7])))
            want.append(p)
        assert got.tolist() == want


def test_adpcm_follows_a_tone():
    tone = (np.sin(np.arange(4000) / 20) * 8000).astype(np.int16)
    back = telephony.decode(telephony.wav(telephony.ima_encode(tone).tobytes(), telephony.IMA))[:4000]
    assert np.abs(back.astype(int) - tone).mean() < 60


def test_media_of_awkward_rows(docs):
    rows = telephony.telephony_column(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    for r in docs.where("doc_id is not null").collect():
        text, m = (r["text"] or "").encode(), by[r["doc_id"]]
        kind, rate, data = telephony.read_wav(bytes(m["media"]))
        assert (kind, rate) == (telephony.MULAW, 8000) and data == text + b" " * (len(data) - len(text)) and len(data) % 192 == 0 and data
        assert m["n_bytes"] == len(text) and m["payload_bytes"] == len(data) and m["tail_crc32"] == zlib.crc32(data[-16:])
        pcm = telephony.decode(bytes(m["pcm"]))
        assert pcm[::2].tolist() == telephony.MU[np.frombuffer(data, np.uint8)].tolist()
        assert telephony.read_wav(bytes(m["pcm"]))[1] == 16000 and m["pcm_bytes"] == len(m["pcm"])
        assert m["feature"].endswith(f"pcm16k={zlib.crc32(pcm.tobytes()):08x}")
    assert by[2]["feature"] == by[3]["feature"] and by[0]["feature"] == by[5]["feature"] != by[9]["feature"]
    assert telephony.telephony_column(docs.limit(0)).count() == 0


def test_resampling(monkeypatch):
    assert telephony.MIDPOINT.tolist() == [-5, 49, -245, 1225, 1225, -245, 49, -5]
    wave = lambda step, n: np.rint(np.sin(np.arange(n) * step) * 9000).astype(np.int16)
    whole = telephony.resample(wave(0.4, 3000))
    assert np.abs(whole.astype(int) - wave(0.2, 6000))[20:-20].max() <= 3
    monkeypatch.setattr(telephony, "STRETCH", 7)
    assert np.array_equal(telephony.resample(wave(0.4, 3000)), whole)
    assert telephony.resample(np.array([5], dtype=np.int16)).tolist() == [5, 5] and not len(telephony.resample(np.zeros(0, dtype=np.int16)))


def test_features_do_not_depend_on_segments(monkeypatch):
    payloads = [telephony.pad(b"hello world" * k) for k in (1, 50, 400, 3)]
    whole = telephony.features(payloads)
    monkeypatch.setattr(telephony, "SEGMENT", 3)
    assert telephony.features(payloads) == whole == [telephony.features([p])[0] for p in payloads]


def brute(x, ids, q, k):
    s = x @ x[q]
    s = np.where(ids == ids[q], -np.inf, s)
    return ids[np.lexsort((ids, -s))[:k]].tolist()


def test_search_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in queries()["op7_ann"](spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(s - x[ids == v][0] @ x[q]) < 1e-12 for _, v, s in mine)
        hits += len(set(brute(x, ids, q, 20)) & {m[1] for m in mine})
    assert hits >= 0.9 * 20 * len(got)


def test_search_of_many_vectors(spark, monkeypatch):
    """Lists wider than what is reranked, copies among the vectors, blocks that are split and copied; what is shuffled follows the rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 24_000)] + rng.normal(size=(24_000, 16)) * 0.5).round(4)
    x[20_000:] = x[7]
    ids = np.arange(len(x))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}))
    monkeypatch.setattr(ann, "MAX_LISTS", 40)
    seen = []
    monkeypatch.setattr(ann, "materialise", lambda f: seen.append(f) or f.checkpoint())
    queries_at = [q for q in range(0, 24_000, 200)]
    for options in ({}, {"block_rows": 900, "block_queries": 50}):
        got = {}
        for r in ann.nearest(df, df.where("vec_id % 200 = 0"), train_rows=4000, **options).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        hits = sum(len(set(brute(x, ids, q, 20)) & {v for _, v in got[q]}) for q in queries_at)
        assert all(sorted(p for p, _ in got[q]) == list(range(1, 21)) for q in queries_at)
        assert hits >= 0.9 * 20 * len(queries_at)
        listed, visits = seen[-2:]
        assert listed.count() == len(x) and visits.count() <= len(queries_at) * 40 * (1 + len(x) // options.get("block_rows", ann.BLOCK_ROWS))


def test_search_of_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(k, rng.normal(size=6).round(3).tolist()) for k in range(40)]
    copies = [(100 + k, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for k in range(60)]
    bad = [(200, None), (201, []), (202, [0.0] * 6), (203, [float("nan")] + [1.0] * 5), (204, [None] + [1.0] * 5), (205, [1.0, 2.0]), (206, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(good + copies + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(3)).withColumn("v", F.lit(1))
    for block in (8192, 7):
        got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, block_rows=block, target=1.0).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by.setdefault(r["query_id"], []).append(r["vec_id"])
        x, ids = np.array([v for _, v in good + copies]), np.array([k for k, _ in good + copies])
        assert set(by) == {0, 20, 100, 120, 140}
        for q, found in by.items():
            assert found == brute(x, ids, int(np.flatnonzero(ids == q)[0]), 5)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few.where("vec_id = 0"), k=20).count() == 2


def test_pipeline(spark, sf, table):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "personal_data", "packing"]
    out = corpus_pipeline.run(spark, sf)
    known = corpus_pipeline.language_id(spark, table, sf)
    assert known.columns == list(corpus_pipeline.COLUMNS) and known.count() == table.where(F.col("text").rlike("\\p{L}")).count()
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, known, sf).collect()}
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == kept and 0 < len(kept) < known.count()
    clean = corpus_pipeline.personal_data(spark, known, sf)
    assert clean.where("n_chars <> length(text)").count() == 0 and clean.where(F.col("text").rlike("[A-Za-z0-9]@[a-z0-9]+\\.[a-z]")).count() == 0


def test_stages_take_awkward_rows(spark, docs, sf):
    plain = docs.select(*corpus_pipeline.COLUMNS)
    for rows in (plain, plain.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, sf).count()


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_return_rows(spark, sf, name):
    if name not in ("pipeline", "op1_simhash", "op7_ann", "op10_stratified_shards"):
        assert queries()[name](spark, sf).count() > 0
