"""Language-model scoring with a Brown class-based bigram model.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Every training word that occurs ``least`` times or more has one of
``classes`` classes, by exchange: a word goes to the class in which the bigrams it takes part in are likeliest.
The ``core`` most frequent words start it, one exchange at a time, until none moves. Then all words of the ``head`` are
moved at once in ``sweeps`` sweeps, by their counts of neighbouring classes, and all words beyond it in one more. Rarer words
share a class with words never seen, where 0.5 is added to every count, with one count for all unseen words. The end of a
text is a class of its own and also precedes its first word. Transitions are smoothed towards class frequencies.

Counts cover all training texts: neighbours, classes and emissions of words beyond the head are tables keyed by the
word, and their bigrams are counted like all others. Texts are written once as word numbers, which all later passes read. The driver gathers tables of fixed size only: the head words with counts and classes, the core's
bigrams, the class bigrams. Words beyond the head are looked up by a shuffled join; being rare, none is a hot key.

Defined cases: null and empty texts are one end token; repeated rows are scored each; without training texts
N = V = 0 and every class is equally likely; ties between classes go to the first; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloudweave.llm.common import Tables, documents, fold, materialise, session_for, text_bytes

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Most words in the dictionary that every worker holds.
HEAD = 1 << 17
CORE, CLASSES, CORE_SWEEPS, SWEEPS = 1024, 64, 6, 2
#: Words that occur less often are not clustered.
LEAST = 2
SMOOTHING = 10.0
#: Log probabilities are summed as integers, so that no order of rows changes a class.
SCALE = 1 << 20
#: Distinct words a counting task holds before it hands them on.
HELD = 400_000
#: Tasks whose bigram rows are merged before all are.
MERGE = 32
#: Words whose neighbours a task sums at a time.
SUMMED = 1 << 19


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c) of all words of the texts (column _t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "c"])
            held.clear()
            return made

        for b in batches:
            for t in b.column(0):
                held.update(_words(t.as_py()))
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return texts.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, count) of the words from a count on, most frequent first: as many as don't exceed ``most``.

    The least count comes from a histogram of a few hundred steps of the logarithm, so no task sorts the vocabulary.
    """
    counts = counts.withColumn("step", F.floor(F.log2("c") * 16))
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for step, n in sizes:
        if held + n > most:
            break
        least, held = step, held + n
    if least is None:
        return []
    found = counts.where(F.col("step") >= least).select("w", "c").toArrow()
    return sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def encode(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """rows (doc_id, held_out, _t) as (doc_id, held_out, rid, ids, rare): places of words in the list, -1 for those listed in rare."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rid = {w: i for i, w in enumerate(sent.value)}, TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rare = [], []
            for t in b.column(2):
                own = _words(t.as_py())
                at = np.fromiter((number.get(w, -1) for w in own), dtype="<i4", count=len(own))
                ids.append(at.tobytes())
                rare.append([own[i] for i in np.flatnonzero(at < 0).tolist()])
            columns = [b.column(0), b.column(1), pa.array(np.arange(rid, rid + len(ids))), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
            rid += len(ids)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "rid", "ids", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, rid long, ids binary, rare array<binary>")


def _streams(batches: Iterator[pa.RecordBatch], of: np.ndarray, rare: int, end: int) -> Iterator[np.ndarray]:
    """The classes of all words of column 0 (word numbers), every text between two ends; those of many texts at a time."""
    held, size = [np.array([end])], 0
    for b in batches:
        for x in b.column(0):
            ids = np.frombuffer(x.as_py(), dtype="<i4")
            held += [np.where(ids < 0, rare, of[ids]) if len(of) else np.full(len(ids), rare), [end]]
            size += len(ids)
            if size > 1 << 20:
                yield np.concatenate(held).astype(np.int64)
                held, size = [np.array([end])], 0
    yield np.concatenate(held).astype(np.int64)


def bigram_counts(encoded: DataFrame, of: np.ndarray, rare: int, end: int) -> np.ndarray:
    """Counts of successive classes over all texts of ``encoded``: ``of`` those of head words, ``rare`` of others."""
    size = max(rare, end) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for x in _streams(batches, of, rare, end):
            total += np.bincount(x[:-1] * size + x[1:], minlength=size * size)
        rows, task = [(i, r) for i, r in enumerate(total.reshape(size, size)) if r.any()], TaskContext.get().partitionId() // MERGE
        if rows:
            columns = [pa.array([i for i, _ in rows], pa.int32()), pa.array([task] * len(rows), pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for _, r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "g", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, dtype=np.int64)
        for v in pdf["v"]:
            total += np.frombuffer(zlib.decompress(v), dtype=np.int64)
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [zlib.compress(total.tobytes(), 1)]})

    # A task gives one row a word or class; its rows are merged in groups, and the groups' rows then.
    merged = encoded.select("ids").mapInArrow(run, "i int, g int, v binary").groupBy("i", "g").applyInPandas(add, "i int, v binary")
    out = np.zeros((size, size), dtype=np.int64)
    for r in merged.groupBy("i").applyInPandas(add, "i int, v binary").collect():
        out[r["i"]] = np.frombuffer(zlib.decompress(r["v"]), dtype=np.int64)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, m: int, classes: int = CLASSES, sweeps: int = CORE_SWEEPS) -> np.ndarray:
    """Classes of all ids of a bigram table: the first m move among ``classes`` classes, the rest are classes of their own."""
    fixed = len(bigrams) - m
    k = classes + fixed
    of = np.concatenate([np.arange(m) % classes, classes + np.arange(fixed)])
    member = np.zeros((len(bigrams), k), dtype=np.float64)
    member[np.arange(len(of)), of] = 1
    b = bigrams.astype(np.float64)
    after, before = b @ member, (member.T @ b).T  # counts of w followed by a class, and of a class followed by w
    n = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(m):
            old, same = of[w], b[w, w]
            right, left = after[w].copy(), before[w].copy()
            if not right.sum() and not left.sum():
                continue
            right[old] -= same
            left[old] -= same
            n[old] -= right
            n[:, old] -= left
            n[old, old] -= same
            c = np.arange(classes)
            rows, cols = n[:classes], n[:, :classes].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + left) - _xlogx(cols)).sum(axis=1)
            own = n[c, c]
            gain -= _xlogx(own + right[c]) + _xlogx(own + left[c]) - 2 * _xlogx(own)
            gain += _xlogx(own + right[c] + left[c] + same) - _xlogx(own)
            out, into = rows.sum(axis=1), cols.sum(axis=1)
            gain -= _xlogx(out + right.sum() + same) - _xlogx(out) + _xlogx(into + left.sum() + same) - _xlogx(into)
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            n[new] += right
            n[:, new] += left
            n[new, new] += same
            if new != old:
                of[w] = new
                after[:, old] -= b[:, w]
                after[:, new] += b[:, w]
                before[:, old] -= b[w]
                before[:, new] += b[w]
                moved += 1
        if not moved:
            break
    return of


def transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), smoothed towards the frequencies of classes."""
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
    return np.log10((pairs + SMOOTHING * share) / (pairs.sum(axis=1, keepdims=True) + SMOOTHING))


def fitness(pairs: np.ndarray, classes: int) -> np.ndarray:
    """What a word gains in each class: a row for each class before it, then one for each class after it, integers of SCALE.

    The row of the class before holds the cost of a larger class as well, as every word has one class before it.
    """
    move = transitions(pairs)
    size = np.log10(pairs.sum(axis=0)[:classes] + 1.0)
    return np.rint(np.concatenate([move[:, :classes] - size, move[:classes].T]) * SCALE).astype(np.int64)


def move_head(encoded: DataFrame, of: np.ndarray, pairs: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """The classes of head words after one sweep in which every word that occurs LEAST times moves to its best class."""
    gains, size, end, rare = fitness(pairs, classes), len(pairs), len(pairs) - 1, len(pairs) - 2
    moves = counts >= LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word * 2 size + neighbour, n)"""
        def neighbours(ids: list[np.ndarray], around: list[np.ndarray]) -> np.ndarray:
            x, c = np.concatenate(ids), np.concatenate(around)
            at = np.flatnonzero(x >= 0)
            at = at[moves[x[at]]]
            return np.concatenate([x[at] * (2 * size) + c[at - 1], x[at] * (2 * size) + size + c[at + 1]])

        sums, ids, around, n = np.zeros((2, 0), dtype=np.int64), [np.array([-1])], [np.array([end])], 0
        for b in itertools.chain(batches, [None]):
            for v in b.column(0) if b is not None else ():
                x = np.frombuffer(v.as_py(), dtype="<i4").astype(np.int64)
                ids += [x, [-1]]
                around += [np.where(x < 0, rare, of[x]), [end]]
                n += len(x)
            if n > SUMMED or b is None:
                sums = _added(sums, neighbours(ids, around))
                ids, around, n = [np.array([-1])], [np.array([end])], 0
        if sums.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1])], names=["k", "n"])

    found = encoded.select("ids").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    word = F.floor(F.col("k") / (2 * size)).cast("int")
    best = found.select(word.alias("w"), (F.col("k") % (2 * size)).cast("int").alias("x"), "n").repartition("w").sortWithinPartitions("w")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, part in _grouped(batches):
            w, x, n = (part.column(i).to_numpy() for i in range(3))
            total = np.add.reduceat(gains[x] * n[:, None], start, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(w[start]), pa.array(total.argmax(axis=1).astype(np.int32))], names=["w", "of"])

    chosen = best.mapInArrow(choose, "w int, of int").toArrow()
    out = of.copy()
    out[chosen.column(0).to_numpy()] = chosen.column(1).to_numpy()
    return out


def _added(sums: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sums (keys, counts) with one more for each of the keys."""
    both, at = np.unique(np.concatenate([sums[0], keys]), return_inverse=True)
    weights = np.concatenate([sums[1], np.ones(len(keys), dtype=np.int64)])
    return np.stack([both, np.bincount(at, weights=weights, minlength=len(both)).astype(np.int64)])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first column in tables that split no value of it, each with the first row of every value."""
    held: list[pa.RecordBatch] = []
    rows, least = 0, 1 << 14
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(b)
            rows += b.num_rows
        if not rows or (b is not None and rows < least):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        # The rows are sorted, so the numbers of the values rise.
        number = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        start = np.flatnonzero(np.diff(number, prepend=-1))
        end = rows if b is None else int(start[-1])
        if end:
            yield start[start < end], table.slice(0, end)
        held, rows = table.slice(end).to_batches(), rows - end
        least = max(1 << 14, 2 * rows)


def beyond_head(encoded: DataFrame, of: np.ndarray, end: int) -> DataFrame:
    """(rid, held_out, pos, w, l, r) of every word that isn't in the head: its place, and the classes before and after, -1 for others beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
            for i, v in enumerate(b.column(2)):
                x = np.frombuffer(v.as_py(), dtype="<i4")
                c = np.full(len(x) + 2, end)
                c[1:-1] = np.where(x < 0, -1, of[x] if len(of) else -1)
                at = np.flatnonzero(x < 0)
                for column, y in zip(rows, (np.full(len(at), i), at, c[at], c[at + 2]), strict=True):
                    column.append(y)
            row, pos, left, right = map(np.concatenate, rows)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array(pos, pa.int32()), b.column(3).flatten(), pa.array(left, pa.int32()), pa.array(right, pa.int32())],
                names=["rid", "held_out", "pos", "w", "l", "r"],
            )

    return encoded.select("rid", "held_out", "ids", "rare").mapInArrow(run, "rid long, held_out boolean, pos int, w binary, l int, r int")


def rare_words(tokens: DataFrame, pairs: np.ndarray, classes: int) -> DataFrame:
    """(w, c, of) of the words of training tokens beyond the head. Those that occur less than LEAST times keep the class of unseen words."""
    gains, size, rare = fitness(pairs, classes), len(pairs), len(pairs) - 2
    known = [F.when(F.col(x) < 0, rare).otherwise(F.col(x)).alias(x) for x in ("l", "r")]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, part in _grouped(batches):
            l, r = part.column(1).to_numpy(), part.column(2).to_numpy()
            n = np.diff(np.append(start, len(l)))
            best = np.add.reduceat(gains[l] + gains[size + r], start, axis=0).argmax(axis=1)
            best = np.where(n >= LEAST, best, rare)
            yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks().take(pa.array(start)), pa.array(n), pa.array(best, pa.int32())], names=["w", "c", "of"])

    return tokens.select("w", *known).repartition("w").sortWithinPartitions("w").mapInArrow(choose, "w binary, c long, of int")


class Model:
    """What scoring needs, all of fixed size: counts, classes and emissions of head words, and transitions."""

    def __init__(self, counts: np.ndarray, of: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, unseen: tuple[int, int], n: int, v: int, texts: int):
        """sizes: training tokens of each class; unseen: tokens and distinct words of the unseen words' class."""
        self.rare, self.end, self.texts, self.of = len(pairs) - 2, len(pairs) - 1, texts, of
        self.log_base = math.log10(n + 0.5 * (v + 1))
        self.base = np.log10(counts + 0.5) - self.log_base
        self.end_base = math.log10(texts + 0.5) - self.log_base
        self.move = transitions(pairs)
        self.sizes = np.log10(np.maximum(sizes, 1))
        self.unseen = math.log10(unseen[0] + 0.5 * (unseen[1] + 1))
        self.emit = np.where(of == self.rare, np.log10(counts + 0.5) - self.unseen, np.log10(np.maximum(counts, 1)) - self.sizes[of]) if len(of) else np.zeros(0)


def learn(
    texts: DataFrame, rows: DataFrame, tables: Tables, head: int = HEAD, core: int = CORE, classes: int = CLASSES, sweeps: int = SWEEPS,
) -> tuple[Model, DataFrame, DataFrame, DataFrame, int]:
    """(model, words beyond the head, their tokens, encoded rows, N) for training texts (column _t), which are the rows that aren't held out."""
    counts = tables.write("counts", word_counts(texts))
    n_texts = texts.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + n_texts, total["v"] + (n_texts > 0)
    top = head_words(counts, head)
    encoded = tables.write("encoded", encode(rows, [w for w, _ in top]))
    train = encoded.where("not held_out")
    found, m = np.array([c for _, c in top], dtype=np.int64), min(core, len(top))
    classes = min(classes, max(m, 1))
    rare, end = classes, classes + 1
    table = bigram_counts(train, np.minimum(np.arange(len(top)), m), m, m + 1)
    by_word = exchange(table, m, classes)
    member = np.zeros((len(table), classes + 2), dtype=np.int64)
    member[np.arange(len(by_word)), by_word] = 1
    pairs = member.T @ table @ member
    of = np.concatenate([by_word[:m], np.full(len(top) - m, rare)]).astype(np.int64)
    of[found < LEAST] = rare
    for _ in range(sweeps if len(top) else 0):
        of = move_head(train, of, pairs, found, classes)
        pairs = bigram_counts(train, of, rare, end)
    tokens = beyond_head(encoded, of, end)
    beyond = tables.write("rare", rare_words(tokens.where("not held_out"), pairs, classes))
    # A class before a word beyond the head may be that of another such word.
    tokens = tokens.join(beyond, "w", "left").select("rid", "held_out", "pos", "l", "r", "c", F.coalesce("of", F.lit(rare)).alias("of"))
    before = F.lag("of").over(Window.partitionBy("rid").orderBy("pos"))
    tokens = tables.write("tokens", tokens.withColumn("l", F.when(F.col("l") < 0, before).otherwise(F.col("l"))).drop("pos"))
    # Bigrams of head words, then those with a word beyond the head, which were counted as one more class.
    pairs = bigram_counts(train, of, classes + 2, end)[: classes + 2, : classes + 2]
    seen = tokens.where("not held_out")
    for side in (seen.select(F.col("l").alias("a"), F.col("of").alias("b")), seen.where("r >= 0").select(F.col("of").alias("a"), F.col("r").alias("b"))):
        for r in side.groupBy("a", "b").agg(F.count("*").alias("n")).collect():
            pairs[r["a"], r["b"]] += r["n"]
    sizes, unseen = np.bincount(of, weights=found, minlength=classes + 2), [int(found[of == rare].sum()), int((of == rare).sum())]
    for r in beyond.groupBy("of").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        sizes[r["of"]] += r["c"]
        if r["of"] == rare:
            unseen = [unseen[0] + r["c"], unseen[1] + r["v"]]
    return Model(found.astype(np.float64), of, pairs, sizes, tuple(unseen), n, v, n_texts), beyond, tokens, encoded, n


def score(encoded: DataFrame, model: Model, tokens: DataFrame, n: int) -> DataFrame:
    """Scores of encoded rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kinds = {"n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for b in batches:
            table: dict[str, list] = {x: [] for x in kinds}
            for v in b.column(3):
                x = np.frombuffer(v.as_py(), dtype="<i4")
                common = x[x >= 0]
                c = np.full(len(x) + 2, m.end)
                c[1:-1] = np.where(x < 0, -1, m.of[x] if len(m.of) else -1)
                both = (c[:-1] >= 0) & (c[1:] >= 0)
                table["n_tokens"].append(len(x) + 1)
                table["known"].append(len(common) + (m.texts > 0))
                table["base"].append(float(m.base[common].sum()) + m.end_base - m.log_base * (len(x) - len(common)))
                table["score"].append(float(m.move[c[:-1][both], c[1:][both]].sum() + m.emit[common].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(table[x], k) for x, k in kinds.items()]], names=["doc_id", "held_out", "rid", *kinds])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    scored = encoded.select("doc_id", "held_out", "rid", "ids").mapInArrow(run, f"doc_id {kind}, held_out boolean, rid long, n_tokens long, known long, base double, score double")
    # One row for each pair of classes.
    size = model.end + 1
    move = spark.createDataFrame([(a, b, float(model.move[a, b])) for a in range(size) for b in range(size)], "a int, b int, x double")
    sizes = spark.createDataFrame([(c, float(model.sizes[c])) for c in range(size)], "of int, size double")
    into = move.select(F.col("a").alias("l"), F.col("b").alias("of"), F.col("x").alias("into"))
    out = move.select(F.col("a").alias("of"), F.col("b").alias("r"), F.col("x").alias("out"))
    tokens = tokens.join(F.broadcast(into), ["l", "of"]).join(F.broadcast(out), ["of", "r"], "left").join(F.broadcast(sizes), "of")
    base = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    emit = F.when(F.col("of") == model.rare, base - model.unseen).otherwise(F.log10("c") - F.col("size"))
    sums = tokens.groupBy("rid").agg(F.sum(base).alias("x"), F.sum(F.col("into") + F.coalesce("out", F.lit(0.0)) + emit).alias("y"), F.count("c").alias("seen"))
    none, seen = F.lit(0.0), F.coalesce("seen", F.lit(0))
    return scored.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("x", none)).alias("base_score"), (F.col("score") + F.coalesce("y", none)).alias("score"),
    )


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, core: int = CORE, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """Learn from the rows whose id's crc32 modulo 5 is not 1 and score all rows."""
    session_for(df)
    rows = df.select(F.col(id_col).alias("doc_id"), (fold(id_col, 5) == 1).alias("held_out"), text_bytes(text_col).alias("_t"))
    with Tables(df.sparkSession, "classlm") as tables:
        model, _, tokens, encoded, n = learn(rows.where("not held_out").select("_t"), rows, tables, head, core, classes, sweeps)
        return materialise(score(encoded, model, tokens, n))


def op5_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
