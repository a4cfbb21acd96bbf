"""Order-preserving packing of documents into sequences of at most ``size`` tokens.

The tokens of a partition form one stream in the order of its rows. Cuts may fall at document ends
(free), sentence ends (a truncation penalty) or, inside stretches without either that are longer than a sequence, at fixed
steps (a larger penalty). Dynamic programming picks the cuts that minimise padding plus penalties:

    f(p) = penalty(p) + size - p + min { f(q) + q : p - size <= q < p }

The minimum slides over a window, so a queue with rising values gives every transition in constant
time. The stream is solved in runs of ``run_tokens``; the last windows of a run are opened again and solved
with the next, so memory is bounded. Nothing is shuffled: each task packs what it scans, and pads
one sequence more than the stream needs at most.

A sequence's id holds its partition's number in the upper bits. The input should be a table or another
source whose partitions read the same on every attempt.

Defined cases: a null or empty text is one end token; repeated rows are packed each; an empty table gives no
rows; extra columns are ignored; a text of any length is cut like any other.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import documents, session_for, text_bytes

SIZE = 1024
END_ID = 0
SENTENCE_PENALTY = 8
HARD_PENALTY = 32
#: Stretches longer than a sequence without a sentence end may be cut at multiples of this.
HARD_STEP = 32
#: Runs of blanks from this length on are encoded without the vocabulary's pattern, which can't match runs of a million.
LONG_BLANK = 256
RUN_TOKENS = 1 << 18
#: Words whose ids a worker remembers.
WORDS_HELD = 300_000

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Splits a text where the vocabulary's own pattern always splits too, so parts can be encoded one by one.
PARTS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The added tokens of the vocabulary's tokenizers file."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("added tokens are matched as they are only")
    return {t["content"]: t["id"] for t in found}


class Encoder:
    """Byte-level BPE ids of texts as little-endian uint32 bytes; equal to those of the tokenizers library.

    ``added``: ids of the added tokens, which are matched in the text before anything else.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.added = added or {}
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.ends = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, dtype=bool)
        for token, i in ranks.items():
            self.ends[i] = b"\n" in token or token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")

    def __call__(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            self._plain(text[at : m.start()], out)
            out.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        self._plain(text[at:] if at else text, out)
        out.append(END_ID.to_bytes(4, "little"))
        return np.frombuffer(b"".join(out), dtype="<u4")

    def _plain(self, text: str, out: list[bytes]) -> None:
        known = self.known
        for part in PARTS.findall(text):
            ids = known.get(part)
            if ids is None:
                # A run of blanks is one match of the pattern.
                blank = len(part) >= LONG_BLANK and part.isspace()
                ids = np.array(self.bpe._encode_single_piece(part) if blank else self.bpe.encode_ordinary(part), dtype="<u4").tobytes()
                if len(known) < WORDS_HELD and len(part) < 64:
                    known[part] = ids
            out.append(ids)


def candidates(soft: np.ndarray, ends: np.ndarray, total: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a stream of ``total`` tokens may be cut, with penalties. soft: sentence ends; ends: document ends."""
    penalty = np.full(total + 1, -1, dtype=np.int32)
    penalty[soft] = SENTENCE_PENALTY
    penalty[ends] = 0
    penalty[0] = penalty[total] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.flatnonzero(np.diff(at) > size)
    for g in gaps.tolist():
        penalty[at[g] + HARD_STEP : at[g + 1] : HARD_STEP] = HARD_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: list[int], penalty: list[int], size: int, open_end: bool) -> list[int]:
    """Cuts (from at[0]) of least padding plus penalties. open_end: the stream goes on, so any cut in the last window may be the last."""
    n = len(at)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(at[0], 0, at[0])])
    for j in range(1, n):
        p = at[j]
        while queue[0][2] < p - size:
            queue.popleft()
        value, back[j], _ = queue[0]
        c = cost[j] = value + penalty[j] + size - p
        c += p
        while queue and queue[-1][0] > c:
            queue.pop()
        queue.append((c, j, p))
    j = n - 1
    if open_end:
        j = min((k for k in range(n - 1, -1, -1) if at[k] > at[-1] - size), key=lambda k: cost[k])
    cuts = []
    while j:
        cuts.append(at[j])
        j = back[j]
    return [at[0], *cuts[::-1]]


class Packer:
    """Packs documents in order; pieces() yields (doc, start, length, doc_tokens, sequence, offset, ids) once they are final."""

    def __init__(self, ends: np.ndarray, size: int = SIZE, run_tokens: int = RUN_TOKENS):
        self.is_end, self.size, self.run_tokens = ends, size, run_tokens
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, ids, tokens that are packed
        self.held, self.sequence = 0, 0

    def add(self, doc: object, ids: np.ndarray) -> bool:
        self.docs.append((doc, ids, 0))
        self.held += len(ids)
        return self.held >= self.run_tokens

    def pieces(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        at, penalty = candidates(np.flatnonzero(self.is_end[stream]) + 1, ends, len(stream), self.size)
        cuts = best_cuts(at.tolist(), penalty.tolist(), self.size, not last)
        if not last and len(cuts) > 2:
            cuts = cuts[:-1]
        starts = np.concatenate([[0], ends[:-1]])
        bounds = np.unique(np.concatenate([cuts, ends[ends < cuts[-1]]]))
        doc_of = np.searchsorted(ends, bounds[:-1], side="right")
        window = np.searchsorted(cuts, bounds[:-1], side="right") - 1
        for a, b, d, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc_of.tolist(), window.tolist(), strict=True):
            doc, ids, done = self.docs[d]
            yield doc, done + a - int(starts[d]), b - a, len(ids), self.sequence + w, a - cuts[w], stream[a:b]
        self.sequence += len(cuts) - 1
        first = int(np.searchsorted(ends, cuts[-1], side="right"))
        rest = self.docs[first:]
        if rest:
            doc, ids, done = rest[0]
            rest[0] = (doc, ids, done + cuts[-1] - int(starts[first]))
        self.docs, self.held = rest, len(stream) - cuts[-1]


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None,
    keep_ids: bool = True, run_tokens: int = RUN_TOKENS,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, its ids."""
    session_for(df)
    added = {} if path else added_tokens()
    path = path or vocabulary_path()
    rows = df.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("_t"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, added)
        packer = Packer(encode.ends, size, run_tokens)
        first = TaskContext.get().partitionId() << 33
        id_type = None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            found = list(packer.pieces(last))
            if found:
                doc, start, length, tokens, sequence, offset, ids = zip(*found, strict=True)
                columns = [
                    pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array([first + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            id_type = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if packer.add(doc, encode(text.as_py().decode("utf-8", "replace"))):
                    yield from out(False)
        if packer.held:
            yield from out(True)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), keep_ids=False)
