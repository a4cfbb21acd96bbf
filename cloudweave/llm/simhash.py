"""SimHash near-dedup through a byte-position inverted index.

Fingerprints within ``max_bits`` = 4 differing bits agree in at least 4 of their 8 bytes. The index
therefore posts every fingerprint under sets of positional bytes chosen so that any 4 agreeing
positions contain a posted set (20 triples, Turan's construction, or all 70 quadruples once there are
so many fingerprints that 24-bit keys get crowded). Fingerprints that meet under a key are tallied
byte by byte, pairs below the guaranteed minimum are dropped, and the rest are verified bit by bit.

Equal fingerprints are collapsed before the index, so copies cost nothing there. A key's members are
linked by a search that leaves at most one link for each newly reached member: a crowd of near copies
yields a spanning forest, never all its pairs. Keys with more members than ``task_limit`` are linked
through their neighbours at half the distance instead, spread over all tasks; two members share such
a neighbour exactly if they are within the distance. Both ways find the same classes.

Defined cases: null and empty texts have fingerprint zero and link to each other; fewer words than a
shingle make one shingle of all; repeated rows each give a row; rows with a null id get the class of
their fingerprint (null if it has no other id); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import Tables, documents, materialise, session_for, text_bytes
from cloudweave.operators.components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MAX_BITS = 4
#: Bytes of two fingerprints within MAX_BITS that agree at least.
MIN_BYTES = 8 - MAX_BITS


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    return majority(_shingle_hashes(text.translate(LOWER).split(), shingle))


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    session_for(df)
    rows = df.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def key_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of byte positions, each of ``width``, of which any MIN_BYTES positions contain one."""
    if width >= MIN_BYTES:
        return list(itertools.combinations(range(8), MIN_BYTES))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [c for g in groups for c in itertools.combinations(g, 3)]
    across = [(*two, one) for g, h in zip(groups, groups[1:] + groups[:1], strict=True) for two in itertools.combinations(g, 2) for one in h]
    return [tuple(sorted(s)) for s in inside + across]


def _near(both: np.ndarray, max_bits: int) -> np.ndarray:
    """Which differences of two fingerprints pass: the tally of shared positional bytes first, then the bits of those left."""
    shared = (both[:, None].view(np.uint8) == 0).sum(axis=1)
    kept = np.flatnonzero(shared >= 8 - max_bits)
    return kept[np.bitwise_count(both[kept]) <= max_bits]


def _spread(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join all members of one key within max_bits, at most one for each newly reached member."""
    left = np.arange(len(values))
    src, dst = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.zeros(len(left), dtype=bool)
            near[_near(values[left] ^ values[i], max_bits)] = True
            if near.any():
                hit = left[near]
                src.append(np.full(len(hit), i))
                dst.append(hit)
                queue.extend(hit.tolist())
                left = left[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    start = np.concatenate([[0], cut])
    length = np.diff(np.append(start, len(keys)))
    src, dst = [], []
    two = start[length == 2]
    good = two[_near(fps[two] ^ fps[two + 1], max_bits)]
    src.append(fps[good])
    dst.append(fps[good + 1])
    for s, n in zip(start[length > 2], length[length > 2], strict=True):
        members = fps[s : s + n]
        i, j = _spread(members, max_bits)
        src.append(members[i])
        dst.append(members[j])
    return np.concatenate(src), np.concatenate(dst)


def links(reps: DataFrame, width: int, task_limit: int = 1 << 15, max_bits: int = MAX_BITS) -> DataFrame:
    """(x, y): links between distinct fingerprints (column fp), enough to connect all within max_bits."""
    sets = key_sets(width)
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for n, positions in enumerate(sets):
        key = F.lit(n).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    posted = reps.select(F.explode(F.array(*keys)).alias("k"), "fp")
    sizes = posted.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > task_limit)
    crowded = materialise(sizes.select("k"))
    some_crowded = not crowded.isEmpty()
    usual = posted.join(crowded, "k", "left_anti") if some_crowded else posted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held_k = np.concatenate([held_k, b.column(0).to_numpy()])
                held_f = np.concatenate([held_f, b.column(1).to_numpy().view(np.uint64)])
                # The last key may go on in the next batch.
                end = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0
            else:
                end = len(held_k)
            if end:
                x, y = _links(held_k[:end], held_f[:end], max_bits)
                held_k, held_f = held_k[end:], held_f[end:]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])

    found = usual.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(run, "x long, y long")
    if some_crowded:
        half = max_bits // 2
        near = [0, *(sum(1 << b for b in bits) for r in range(1, half + 1) for bits in itertools.combinations(range(64), r))]
        near = [m - (1 << 64) if m >= 1 << 63 else m for m in near]
        heavy = posted.join(crowded, "k", "left_semi").select("fp").distinct()
        spots = heavy.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in near])).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("spot"))
        low = spots.groupBy("spot").agg(F.min("fp").alias("y"), F.count("*").alias("n")).where("n > 1").select("spot", "y")
        found = found.unionByName(spots.join(low, "spot").where("fp <> y").select(F.col("fp").alias("x"), "y"))
    return found.distinct()


def simhash_classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    task_limit: int = 1 << 15,
    wide_from: int = 1 << 24,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id linked, directly or not.

    ``wide_from``: number of distinct fingerprints from which keys take 4 bytes instead of 3; the result is the same.
    """
    docs = materialise(with_fingerprints(df, id_col, text_col, shingle))
    reps = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("node")))
    width = MIN_BYTES if reps.count() >= wide_from else MIN_BYTES - 1
    pairs = links(reps.select("fp"), width, task_limit)
    ends = (
        pairs.join(reps.select(F.col("fp").alias("x"), F.col("node").alias("src")), "x")
        .join(reps.select(F.col("fp").alias("y"), F.col("node").alias("dst")), "y")
        .select("x", "y", "src", "dst")
    )
    ends = materialise(ends)
    classes = connected_components(ends, "src", "dst")
    named = reps.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return docs.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_of_each(df: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose id is the smallest of its class, one row for each id."""
    kept = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    once = kept.where("n = 1").select(F.col("doc_id").alias(id_col))
    more = kept.where("n > 1").select(F.col("doc_id").alias(id_col))
    repeated = df.join(more, id_col, "left_semi").dropDuplicates([id_col])
    return df.join(once, id_col, "left_semi").select(*df.columns).unionByName(repeated.select(*df.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_classes(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near duplicates by similarity: the byte index and shared rare shingles propose, the shingle sets decide.

SIMILARITY = 0.8
SHINGLE_WORDS = 5
#: Members of one shingle of which every pair is proposed; larger crowds are compared in blocks.
ALL_PAIRS = 24
#: Members of a crowd in one block, their shingles at most about, and partners of a member tested at a time.
CROWD_BLOCK, CROWD_SHINGLES, FIRST_TESTS = 2048, 1 << 20, 8
#: Documents that the order of shingles is drawn from: a share of the table, and this many at least.
ORDER_ROWS, ORDER_SHARE = 20_000, 0.02
#: Shingles found this often there, the most frequent first, come last in the order.
ORDER_LEAST, ORDER_HELD = 3, 1 << 17
#: Postings a proposing task looks at together.
HELD_ROWS = 1 << 15
#: Most bits of a set's parity sketch.
SKETCH_BITS = 1 << 15


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; fewer words than a shingle make one."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    last = ends[size - 1 :].tolist() or [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def shingle_set(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than a shingle make one."""
    return np.unique(_shingle_hashes(words, size))


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes, 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        h = np.ascontiguousarray(hashes[lo : lo + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def parity_sketch(s: np.ndarray) -> bytes:
    """Whether an odd number of the set's hashes falls on each of four to eight times as many bits as it has hashes.

    Two sets differ in at least as many hashes as their sketches, folded to one length, differ in bits.
    """
    width = min(SKETCH_BITS, max(256, 4 << max(0, len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def _folded(sketch: bytes, width: int) -> bytes:
    while len(sketch) > width:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half]) ^ int.from_bytes(sketch[half:])).to_bytes(half)
    return sketch


def _most_apart(n1, n2, similarity: float):
    """Elements that similar sets of n1 and n2 differ in at most."""
    return (n1 + n2) * (1 - similarity) / (1 + similarity) + 1e-6


def _rare_first(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a set in the order of all sets: by rank, 0 for those not in ``common`` (sorted), then by hash."""
    if not len(common) or not len(s):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.argsort(np.where(common[at] == s, rank[at], 0), kind="stable")]


def _prefix(n: int, similarity: float) -> int:
    """Sets that are similar share one of so many first shingles of each: they share ``similarity`` * n of either at least."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _reach(n1, pos1, n2, pos2, similarity: float):
    """Can sets of n1 and n2 shingles be similar if their first shared ones are at these places?"""
    return np.minimum(n1 - pos1, n2 - pos2) >= similarity / (1 + similarity) * (n1 + n2) - 1e-6


def _shingle_order(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted by hash, rank) of frequent shingles, from a sample. Any order finds all pairs; this one keeps crowds small."""
    share = max(ORDER_SHARE, ORDER_ROWS / max(1, texts.count()))
    drawn = texts if share >= 1 else texts.where(F.pmod(F.xxhash64(F.lit("order"), "doc_id", "h"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(t.as_py().translate(LOWER).split()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s).view(np.int64) if s else [], pa.int64())], names=["k"])

    counts = drawn.select("_t").mapInArrow(run, "k long").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= ORDER_LEAST)
    found = counts.orderBy(F.desc("n"), "k").limit(ORDER_HELD).toArrow()
    k, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    by_hash = np.argsort(k)
    return k[by_hash], n[by_hash]


def _ordered(src: str, dst: str) -> list:
    return [F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")]


def _both(pairs: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """The pairs (src, dst) with columns of known (node, ...) as a_... and b_..."""
    for end, name in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(known.select(F.col("node").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in columns]), end)
    return pairs.select("src", "dst", *[f"{name}_{c}" for name in "ab" for c in columns])


def _possible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n1, x, n2, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                width = min(len(x), len(y))
                apart = (int.from_bytes(_folded(x, width)) ^ int.from_bytes(_folded(y, width))).bit_count()
                good.append(apart <= _most_apart(n1, n2, similarity))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return _both(pairs, reps, "n", "bits").mapInArrow(run, "src long, dst long")


def _alike(u: np.ndarray, v: np.ndarray, similarity: float) -> bool:
    """Have two shingle sets that Jaccard similarity or more?"""
    shared = len(np.intersect1d(u, v, assume_unique=True))
    return shared >= similarity * (len(u) + len(v) - shared)


def _similar(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose texts (node, _t) have similar shingle sets. Texts take less room in the joins than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                good.append(_alike(*(shingle_set(t.as_py().translate(LOWER).split()) for t in (x, y)), similarity))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return _both(pairs, known, "_t").mapInArrow(run, "src long, dst long")


def _partners(rows: pa.Table, of: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For members of one block (node, n, pos, c, slice, bits): those of other components, by ``of`` as it then is, that the sketches
    leave possible, nearest first. Every pair is compared once."""
    n, pos, part = (rows.column(x).to_numpy() for x in ("n", "pos", "slice"))
    n = n.astype(np.int64)
    bits = rows.column("bits").to_pylist()
    width = np.array([len(b) for b in bits])
    one_slice = len(np.unique(part)) == 1
    for w in np.unique(width).tolist():
        # Every pair is compared at the shorter of its two widths.
        at = np.flatnonzero(width >= w)
        folded = np.frombuffer(b"".join(_folded(bits[i], w) for i in at), dtype=np.uint64).reshape(len(at), -1)
        for here in np.flatnonzero(width[at] == w).tolist():
            i = int(at[here])
            maybe = (of[at] != of[i]) & _reach(n[i], pos[i], n[at], pos[at], similarity) & ((width[at] > w) | (at > i))
            if not one_slice:
                maybe &= part[at] != part[i]
            left = np.flatnonzero(maybe)
            apart = np.bitwise_count(folded[left] ^ folded[here]).sum(axis=1)
            near = np.argsort(apart, kind="stable")
            yield i, at[left[near[apart[near] <= _most_apart(n[i], n[at[left[near]]], similarity)]]]


def _with_partners(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Makes a function of one block's members: those that have a possible partner. The texts of the others are not needed."""

    def keep(rows: pa.Table) -> pa.Table:
        good = np.zeros(rows.num_rows, dtype=bool)
        for i, j in _partners(rows, rows.column("c").to_numpy(), similarity):
            good[j] = True
            good[i] |= len(j) > 0
        return rows.filter(pa.array(good))

    return keep


def _crowd_links(tests: int, similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Makes a function of one block's members, with their texts _t: links (src, dst) of similar members that join components.

    A member's possible partners in other components are compared with it exactly, nearest sketches first, ``tests`` at a time. A pair found
    similar joins two components at once, so a block of m members gives less than m links, and between them they hold all that are similar.
    """

    def pair(rows: pa.Table) -> pa.Table:
        node, texts = rows.column("node").to_numpy(), rows.column("_t")
        of = np.unique(rows.column("c").to_numpy(), return_inverse=True)[1]
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py().translate(LOWER).split())
            return sets[i]

        src, dst = [], []
        for i, j in _partners(rows, of, similarity):
            while len(j):
                for k in j[:tests].tolist():
                    if of[k] != of[i] and _alike(shingles(i), shingles(k), similarity):
                        src.append(node[i])
                        dst.append(node[k])
                        of[of == of[k]] = of[i]
                j = j[tests:]
                j = j[of[j] != of[i]]
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return pair


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, c) joined by links (src, dst): only the components that links join are looked at, not their members."""
    ends = component.select(F.col("node").alias("src"), F.col("c").alias("a"))
    links = links.join(ends, "src", "left").join(ends.toDF("dst", "b"), "dst", "left").select("src", "dst", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b"))
    links = materialise(links)
    joined = connected_components(links.select("a", "b").distinct(), "a", "b").select(F.col("node").alias("c"), F.col("component").alias("to"))
    alone = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(component, "node", "left_anti")
    every = component.unionByName(alone.select("node", F.col("node").alias("c")))
    return materialise(every.join(joined, "c", "left").select("node", F.coalesce("to", "c").alias("c")))


def _link_crowds(crowds: DataFrame, component: DataFrame, reps: DataFrame, known: DataFrame, similarity: float, block: int = CROWD_BLOCK, tests: int = FIRST_TESTS) -> DataFrame:
    """component (node, c), with all similar members of each crowd (k, node, n, pos) in one.

    Crowds that the links so far hold together are done. In the others members of different components are compared block by block, first
    all by their sketches, then those with a possible partner by their texts, ``tests`` at a time. A block holds so many members, or so
    many shingles, at most about; it gives links that join components only, so a crowd of near copies never gives all its pairs.
    """
    placed = materialise(crowds.join(component, "node", "left").select("k", "node", "n", "pos", F.coalesce("c", "node").alias("c")))
    sizes = placed.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("all")).where("lo <> hi")
    parts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("all") / CROWD_SHINGLES)).cast("int")
    apart = placed.join(sizes.select("k", parts.alias("parts")), "k")
    apart = apart.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    apart = apart.join(reps.select("node", "bits"), "node").withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    apart = apart.withColumns({"a": F.least("slice", "other"), "b": F.greatest("slice", "other")}).select("k", "a", "b", "node", "n", "pos", "c", "slice", "bits")
    possible = materialise(apart.groupBy("k", "a", "b").applyInArrow(_with_partners(similarity), apart.schema))
    found = possible.join(known, "node").groupBy("k", "a", "b").applyInArrow(_crowd_links(tests, similarity), "src long, dst long")
    links = materialise(found.select(*_ordered("src", "dst")).distinct())
    return component if links.isEmpty() else _merged(component, links)


def _byte_index_pairs(reps: DataFrame) -> DataFrame:
    """(src, dst): what the byte-position index proposes: nodes of one fingerprint in a star, fingerprints within MAX_BITS in a forest."""
    by_print = materialise(reps.groupBy("fp").agg(F.min("node").alias("first")))
    alike = reps.join(by_print, "fp").where("node <> first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    near = links(by_print.select("fp"), MIN_BYTES - 1)
    near = near.join(by_print.select(F.col("fp").alias("x"), F.col("first").alias("src")), "x").join(by_print.select(F.col("fp").alias("y"), F.col("first").alias("dst")), "y")
    return alike.union(near.select("src", "dst")).select(*_ordered("src", "dst"))


def _near_duplicate_rows(df: DataFrame, tables: Tables, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(doc_id, h, c) of the rows that have an id: h hashes the text, c is a value of the class."""
    session_for(df)
    texts = df.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_t")).where("doc_id is not null").withColumn("h", F.xxhash64("_t"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    order = df.sparkSession.sparkContext.broadcast(_shingle_order(texts))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, first, n, fp, bits = [], [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py().translate(LOWER).split())
                node.append(xxhash.xxh3_128_digest(s.tobytes()))
                first.append(_rare_first(s, *order.value)[: _prefix(len(s), similarity)].view(np.int64))
                n.append(len(s))
                fp.append(majority(s))
                bits.append(parity_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), pa.array(node, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(n, pa.int32()),
                    pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(bits, pa.binary()),
                ],
                names=["doc_id", "h", "node", "first", "n", "fp", "bits"],
            )

    docs = tables.write("docs", texts.mapInArrow(sketch, f"doc_id {kind}, h long, node binary, first array<long>, n int, fp long, bits binary"))
    # Nodes get numbers, which stay as they are once written.
    reps = docs.groupBy("node").agg(F.min(F.struct("doc_id", "h", "n", "fp", "bits")).alias("r")).select(F.col("node").alias("digest"), "r.*")
    reps = tables.write("reps", reps.withColumn("node", F.monotonically_increasing_id()))
    own = docs.select(F.col("node").alias("digest"), "doc_id", "h", "first", "n").join(reps.select("digest", "doc_id", "h", "node"), ["digest", "doc_id", "h"])
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    posted = own.select("node", "n", F.posexplode("first").alias("pos", "k")).select("k", "node", place.alias("p"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of small keys, smaller node first, with k and p zero; the members of large ones, with dst null."""
        held: list[pa.RecordBatch] = []
        rows, least = 0, HELD_ROWS
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                rows += b.num_rows
            if not rows or (b is not None and rows < least):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            k, p = (table.column(c).to_numpy() for c in (0, 2))
            n, pos = p >> 32, p & 0xFFFFFFFF
            # The last key may go on in the next batch.
            end = rows if b is None else int(np.searchsorted(k, k[-1]))
            start = np.flatnonzero(np.diff(k[:end], prepend=k[:1] - 1)) if end else np.zeros(0, dtype=np.int64)
            length = np.diff(np.append(start, end))
            two, some, many = start[length == 2], (length > 2) & (length <= ALL_PAIRS), length > ALL_PAIRS
            i, j = [two], [two + 1]
            for s, m in zip(start[some].tolist(), length[some].tolist(), strict=True):
                x, y = np.triu_indices(m, 1)
                i.append(s + x)
                j.append(s + y)
            i, j = np.concatenate(i), np.concatenate(j)
            good = _reach(n[i], pos[i], n[j], pos[j], similarity)
            crowd = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(s, s + m) for s, m in zip(start[many].tolist(), length[many].tolist(), strict=True)]])
            if len(crowd) or good.any():
                node, none = table.column(1).to_numpy(), np.zeros(good.sum(), dtype=np.int64)
                x, y = node[i[good]], node[j[good]]
                dst = np.append(np.maximum(x, y), np.zeros(len(crowd), dtype=np.int64))
                columns = [np.append(none, k[crowd]), np.append(np.minimum(x, y), node[crowd]), np.append(none, p[crowd])]
                mask = np.arange(len(dst)) >= len(none)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(dst, mask=mask)], names=["k", "node", "p", "dst"])
            held, rows = table.slice(end).to_batches(), rows - end
            least = max(HELD_ROWS, 2 * rows)

    found = materialise(posted.repartition("k").sortWithinPartitions("k").mapInArrow(propose, "k long, node long, p long, dst long").distinct())
    pairs = found.where("dst <> node").select(F.col("node").alias("src"), "dst").union(_byte_index_pairs(reps)).distinct()
    pairs = materialise(_possible(pairs, reps, similarity))
    n, pos = F.shiftright("p", 32).alias("n"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos")
    crowds = found.where("dst is null").select("k", "node", n, pos)
    wanted = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(crowds.select("node")).distinct()
    asked = reps.join(wanted, "node", "left_semi").select("doc_id", "h", "node")
    known = tables.write("known", texts.join(asked, ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "node"]).select("node", "_t"))
    component = connected_components(_similar(pairs, known, similarity)).select("node", F.col("component").alias("c"))
    classes = _link_crowds(crowds, component, reps, known, similarity)
    named = reps.join(classes, "node", "left").select(F.col("digest").alias("node"), F.coalesce("c", "node").alias("c"))
    return docs.select("doc_id", "h", "node").join(named, "node").select("doc_id", "h", "c")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of their five-word shingles of ``similarity`` or more.

    Documents with equal shingle sets are one node; component_id is the smallest id of the class. Rows with a null id are left out.
    The byte-position index proposes pairs by their fingerprints. It may miss some, so a prefix filter adds to it: similar sets share
    one of their first shingles in an order common to all, and every similar pair meets under a shingle. Parity sketches rule out most
    pairs, and the others are verified exactly. Members of a crowded shingle are joined block by block (``_link_crowds``).
    """
    with Tables(df.sparkSession, "near-duplicates") as tables:
        rows = materialise(_near_duplicate_rows(df, tables, id_col, text_col, similarity))
    return rows.join(rows.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "component_id")


def keep_near_duplicates_once(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of df for every class of near duplicates, of its smallest id, and every row with a null id.

    Classes go by the texts, so rows that repeat an id with another text are judged each by its own.
    """
    with Tables(df.sparkSession, "near-duplicates") as tables:
        rows = _near_duplicate_rows(df, tables, id_col, text_col, similarity).groupBy("c", "doc_id", "h").agg(F.count("*").alias("n"))
        kept = rows.groupBy("c").agg(F.min(F.struct("doc_id", "h", "n")).alias("r")).select(F.col("r.doc_id").alias("_kept_id"), F.col("r.h").alias("_kept_h"), F.col("r.n").alias("_kept_n"))
        kept = materialise(kept)
    same = (F.col(id_col) == F.col("_kept_id")) & (F.xxhash64(text_bytes(text_col)) == F.col("_kept_h"))
    once = df.join(kept.where("_kept_n = 1"), same, "left_semi")
    repeated = df.join(kept.where("_kept_n > 1"), same).dropDuplicates(["_kept_id", "_kept_h"]).select(*df.columns)
    return once.unionByName(repeated).unionByName(df.where(F.col(id_col).isNull()))
