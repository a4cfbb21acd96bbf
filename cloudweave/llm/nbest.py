"""SentencePiece encoding with N-best segmentations, and decoding.

The pieces of a public SentencePiece model span a lattice over the text (spaces as U+2581, one put in front). A
segmentation's score is the sum of its pieces' log probabilities, which follow from the pieces' ranks by Zipf's law, as a
model of merges carries no probabilities of its own. A forward Viterbi pass gives the best score of every prefix;
taken as exact heuristics, they let a backward A-star search return the N best segmentations in order without
expanding anything else.

No piece crosses the start of a run of spaces or a line break, so the lattice falls apart into chunks there. Chunks met
for the first time get their two best scores by one numpy Viterbi pass over all of them. Of a text's chunks only the N - 1
whose second-best costs least can differ from their best in any of its N best segmentations, so the search runs
on those alone and their candidates are merged best first.

Defined cases: a null or empty text has the one segmentation into no pieces; a character without a piece becomes its UTF-8
bytes' pieces; U+2581 in a text is such a character, so decoding always gives the text back; equal scores come in a
fixed order; texts and chunks of any length are encoded whole; repeated rows each give a row; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import documents, session_for

SPACE, REAL = "▁", "\ud800"
N_BEST = 4
#: Longest chunk of the numpy pass; longer ones, and those with unknown characters, are encoded one by one.
WIDE = 24
CHUNKS_HELD = 300_000
_CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
NEVER = -1e300


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary: pieces with log probabilities, byte pieces, and what every id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.of: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        self.decoded: list[bytes] = [b""] * n
        ranked = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.decoded[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ranked.append((-model.get_score(i), i, piece))
                self.decoded[i] = piece.replace(SPACE, " ").encode()
        harmonic = math.log(sum(1 / (r + 2.0) for r in range(len(ranked))))
        for r, (_, i, piece) in enumerate(sorted(ranked)):
            self.of[piece] = (i, -math.log(r + 2.0) - harmonic)
        self.byte_score = -math.log(len(ranked) + 2.0) - harmonic - 2.0
        self.longest = max(map(len, self.of), default=1)
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.of):
            raise ValueError("a piece crosses a chunk border")

    def edges(self, chunk: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For every end position the (start, ids, score) of the pieces that end there."""
        out: list[list] = [[] for _ in range(len(chunk) + 1)]
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - self.longest), end):
                if (found := self.of.get(chunk[start:end])) is not None:
                    out[end].append((start, (found[0],), found[1]))
            if chunk[end - 1] not in self.of:
                raw = SPACE.encode() if chunk[end - 1] == REAL else chunk[end - 1].encode()
                out[end].append((end - 1, tuple(self.byte[b] for b in raw), self.byte_score * len(raw)))
        return out


def n_best(pieces: Pieces, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a chunk: forward Viterbi, then backward A-star with its scores as heuristics."""
    edges = pieces.edges(chunk)
    forward = [0.0] + [NEVER] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start, _, s in edges[end]:
            forward[end] = max(forward[end], forward[start] + s)
    # A state is a suffix: (minus its best total, tie break, start, its own score, linked ids).
    # Suffixes that start at one place are met best first, so only the n first of a place can be part of the n best: ties stay cheap.
    heap, count, out, met = [(-forward[-1], 0, len(chunk), 0.0, None)], 0, [], [0] * (len(chunk) + 1)
    while heap and len(out) < n:
        _, _, at, own, link = heapq.heappop(heap)
        met[at] += 1
        if met[at] > n:
            continue
        if at == 0:
            ids: list[int] = []
            while link is not None:
                ids.extend(link[0])
                link = link[1]
            out.append((own, tuple(ids)))
            continue
        for start, ids, s in edges[at]:
            count += 1
            heapq.heappush(heap, (-(forward[start] + s + own), count, start, s + own, (ids, link)))
    return out


class Segmenter:
    def __init__(self, path: str, n: int):
        self.pieces, self.n = Pieces(path), n
        codes = sorted((self._hash(p), i, s) for p, (i, s) in self.pieces.of.items())
        self.hashes = np.array([c[0] for c in codes], dtype=np.uint64)
        self.ids = np.array([c[1] for c in codes], dtype=np.int32)
        self.scores = np.array([c[2] for c in codes])
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.single = np.zeros(0x110000, dtype=bool)
        self.single[[ord(p) for p in self.pieces.of if len(p) == 1]] = True
        self.single[:128] = True
        self.clear()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.best = np.zeros(0)
        self.gap = np.zeros(0)
        self.bytes: list[bytes] = []
        self.several: dict[str, list] = {}

    def _alone(self, chunk: str) -> tuple[float, float, bytes]:
        found = n_best(self.pieces, chunk, 2)
        gap = found[0][0] - found[1][0] if len(found) > 1 else math.inf
        return found[0][0], gap, np.array(found[0][1], dtype="<i4").tobytes()

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Best scores, gaps to the second best and best ids of chunks of known characters, none longer than WIDE."""
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        n, width = len(chunks), int(size.max())
        flat = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.zeros((width, n), dtype=np.uint64)
        column = np.repeat(np.arange(n), size)
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), column] = flat.astype(np.uint64) + np.uint64(1)
        best, second = np.full((width + 1, n), NEVER), np.full((width + 1, n), NEVER)
        best[0] = 0
        length = np.zeros((width + 1, n), dtype=np.int8)
        chosen = np.zeros((width + 1, n), dtype=np.int32)
        # Hits of every length: (start, chunk, table place), kept by end position.
        by_end: list[list[tuple]] = [[] for _ in range(width + 1)]
        h = np.zeros((width, n), dtype=np.uint64)
        for l in range(1, min(self.pieces.longest, width) + 1):
            h = h[: width - l + 1] * _BASE + codes[l - 1 :]
            a, b = np.nonzero(self.maybe[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & (codes[l - 1 :] > 0))
            place = np.searchsorted(self.hashes, h[a, b])
            good = self.hashes[np.minimum(place, len(self.hashes) - 1)] == h[a, b]
            a, b, place = a[good], b[good], place[good]
            cuts = np.searchsorted(a, np.arange(width - l + 2))
            for start in range(width - l + 1):
                if cuts[start] < cuts[start + 1]:
                    by_end[start + l].append((start, l, b[cuts[start] : cuts[start + 1]], place[cuts[start] : cuts[start + 1]]))
        known_byte = np.zeros(129, dtype=np.int32)
        for c in range(128):
            known_byte[c + 1] = -1 if chr(c) in self.pieces.of else self.pieces.byte.get(c, -1)
        for end in range(1, width + 1):
            code = codes[end - 1]
            spare = np.flatnonzero((code > 0) & (code <= 128))
            spare = spare[known_byte[code[spare].astype(np.int64)] >= 0]
            moves = [(start, l, who, self.scores[place], self.ids[place]) for start, l, who, place in by_end[end]]
            if len(spare):
                moves.append((end - 1, 1, spare, self.pieces.byte_score, known_byte[code[spare].astype(np.int64)]))
            for start, l, who, s, ids in moves:
                first, next_ = best[start, who] + s, second[start, who] + s
                top, low = best[end, who], second[end, who]
                better = first > top
                second[end, who] = np.maximum(np.maximum(low, np.minimum(top, first)), next_)
                best[end, who] = np.where(better, first, top)
                length[end, who] = np.where(better, l, length[end, who])
                chosen[end, who] = np.where(better, ids, chosen[end, who])
        every = np.arange(n)
        total, other = best[size, every], second[size, every]
        gap = np.where(other > NEVER / 2, total - other, np.inf)
        # Walk back: pieces of a chunk fill its column from the end.
        made, at, fill = np.zeros((n, width), dtype="<i4"), size.copy(), np.full(n, width)
        while (open_ := np.flatnonzero(at > 0)).size:
            fill[open_] -= 1
            made[open_, fill[open_]] = chosen[at[open_], open_]
            at[open_] -= length[at[open_], open_]
        raw = made.tobytes()
        step = 4 * width
        return total, gap, [raw[i * step + 4 * f : (i + 1) * step] for i, f in enumerate(fill.tolist())]

    def learn(self, chunks: set[str]) -> None:
        """Segment chunks that aren't held yet."""
        new = sorted(chunks - self.row.keys())
        if not new:
            return
        size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        flat = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        usual = np.logical_and.reduceat(self.single[flat], np.cumsum(size) - size) & (size <= WIDE)
        order = np.flatnonzero(usual)[np.argsort(size[usual], kind="stable")].tolist()
        best, gap, made = [self.best], [self.gap], []
        for lo in range(0, len(order), 1 << 13):
            part = [new[i] for i in order[lo : lo + (1 << 13)]]
            self.row.update(zip(part, range(len(self.row), len(self.row) + len(part)), strict=True))
            b, g, ids = self._together(part)
            best.append(b)
            gap.append(g)
            made += ids
        for i in np.flatnonzero(~usual).tolist():
            self.row[new[i]] = len(self.row)
            b, g, ids = self._alone(new[i])
            best.append(np.array([b]))
            gap.append(np.array([g]))
            made.append(ids)
        self.best, self.gap = np.concatenate(best), np.concatenate(gap)
        self.bytes += made

    def options(self, chunk: str) -> list[tuple[float, bytes]]:
        if chunk not in self.several:
            self.several[chunk] = [(s, np.array(ids, dtype="<i4").tobytes()) for s, ids in n_best(self.pieces, chunk, self.n)]
        return self.several[chunk]

    def encode(self, texts: list[str]) -> list[tuple[list[float], list[bytes]]]:
        """(scores, ids as little-endian int32) of the n best segmentations of each text."""
        if len(self.row) > CHUNKS_HELD:
            self.clear()
        split = [_CHUNK.findall(SPACE + t.replace(SPACE, REAL).replace(" ", SPACE)) if t else [] for t in texts]
        self.learn({c for s in split for c in s})
        return [self._document(s) for s in split]

    def _document(self, chunks: list[str]) -> tuple[list[float], list[bytes]]:
        at = np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        ids = [self.bytes[i] for i in at.tolist()]
        total = float(self.best[at].sum())
        gaps = self.gap[at]
        few = min(self.n - 1, len(gaps))
        if few and few < len(gaps):
            limit = np.partition(gaps, few - 1)[few - 1]
            below, equal = np.flatnonzero(gaps < limit), np.flatnonzero(gaps == limit)
            places = np.sort(np.concatenate([below, equal[: few - len(below)]])).tolist()
        else:
            places = list(range(few))
        lists = [self.options(chunks[p]) for p in places]
        lists, places = [x for x in lists if len(x) > 1], [p for p, x in zip(places, lists, strict=True) if len(x) > 1]
        scores, out = [], []
        start = (0,) * len(lists)
        heap, seen = [(0.0, start)], {start}
        while heap and len(out) < self.n:
            lost, pick = heapq.heappop(heap)
            mine = list(ids)
            for p, x, k in zip(places, lists, pick, strict=True):
                if k:
                    mine[p] = x[k][1]
            scores.append(total - lost)
            out.append(b"".join(mine))
            for i, x in enumerate(lists):
                after = (*pick[:i], pick[i] + 1, *pick[i + 1 :])
                if after[i] < len(x) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (sum(y[0][0] - y[k][0] for y, k in zip(lists, after, strict=True)), after))
        return scores, out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; the space that encoding puts in front is taken away."""
        return b"".join(map(self.pieces.decoded.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))[1:]


def encode_n_best(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, scores (best first), ids_crc32 (one a segmentation), round_trip and, with keep_ids, ids (one array a segmentation)."""
    session_for(df)
    path = path or model_path()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    kinds = {"n_pieces": pa.int64(), "scores": pa.list_(pa.float64()), "ids_crc32": pa.list_(pa.int64()), "round_trip": pa.bool_()}
    kinds |= {"ids": pa.list_(pa.list_(pa.int32()))} if keep_ids else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(path, n)
        for b in batches:
            texts = b.column(1).to_pylist()
            made = segmenter.encode(texts)
            columns = {
                "n_pieces": [len(ids[0]) // 4 for _, ids in made], "scores": [s for s, _ in made], "ids_crc32": [[zlib.crc32(x) for x in ids] for _, ids in made],
                "round_trip": [segmenter.decode(ids[0]) == t.encode() for t, (_, ids) in zip(texts, made, strict=True)],
            }
            if keep_ids:
                columns["ids"] = [[np.frombuffer(x, dtype="<i4") for x in ids] for _, ids in made]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(columns[k], t) for k, t in kinds.items()]], names=["doc_id", *kinds])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, scores array<double>, ids_crc32 array<long>, round_trip boolean"
    return rows.mapInArrow(run, schema + ", ids array<array<int>>" * keep_ids)


def op8_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_n_best(documents(spark, sf_dir), keep_ids=False)
