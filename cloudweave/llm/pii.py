"""Personal data: exact patterns plus a skip-chain conditional random field.

Four patterns find the base spans, which always stay. The field then labels the tokens that hold a digit
or an ``@``. Tokens without either can only be outside, so they are conditioned on and drop out of the graph.
Neighbouring tokens share chain potentials; tokens of one document that repeat or resemble each other, however far apart, share
skip potentials with the occurrence before and after: the same digits or the last seven of them, the same address whatever its
case or its local part, the same key or its first twelve characters. Tokens in base spans keep their labels; loopy sum-product
messages carry these to the others, over all documents of a batch at once. Runs of tokens with one label and high marginals
become added spans where no base span lies. So an address, number or key that is written again without what gave it away at
first gets the label of its other occurrences. Besides the patterns' four kinds there is ``secret``, for keys and passwords.

The weights are fitted by pseudo-likelihood to a sample of documented size (``train_rows`` rows, picked by a hash of the id),
labelled by the patterns, by assignments to a word such as token or password, and by repeats of what these find. The features of every fourth token are
withheld in training, so that labels must come from neighbours and other occurrences too. Skip weights start from, and decay
towards, equal labels (``AGREE``), as few training texts repeat a token.

Defined cases: null and empty texts have no spans; repeated rows each give a row; ties between labels go to the
outside label; texts of any length are scanned whole in linear time; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import documents, session_for

#: The patterns' kinds, in the order of spans, then the kind that only the field finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
OUTSIDE, LABELS = 0, 1 + len(KINDS)
TRAIN_ROWS = 20_000
MARGINAL = 0.8
#: Prior weight of equal labels on a skip edge.
AGREE = 8.0
#: One token in so many has its features withheld in training.
WITHHELD = 4
#: Weight of the label that a base span gives its tokens.
SURE = 30.0
SWEEPS, DAMPING = 10, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits: it would have started at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NAMED = r"(?i:token|secret|passw(?:or)?d|pwd|(?:api|access|auth|private)[ _-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
_SECRET = re.compile(rf"\b{_NAMED}(?=[A-Za-z+/_.-]*[0-9])(?=[0-9+/_.-]*[A-Za-z])([A-Za-z0-9+/_.-]{{16,}})")
_CUE = re.compile(rf"\b{_NAMED}$")
_KEY = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9+/_-]{16,}")
#: Characters before a token in which a cue is looked for.
BEFORE = 32

_TRIM = ".,;:!?\"'[]{}<>#$%&*|"

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def secret_spans(text: str) -> list[Span]:
    """Keys and passwords that are assigned to a word naming them: labels for training."""
    return [(len(BASE_KINDS), *m.span(1)) for m in _SECRET.finditer(text)]


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _bins(x: int, edges: tuple[int, ...]) -> list[float]:
    k = sum(x >= e for e in edges)
    return [float(i == k) for i in range(len(edges) + 1)]


def token_features(token: str, before: str = "") -> list[float]:
    """Shape of a token: counts of digits, marks and letters, in bins; and whether what stands before it names a secret."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    at = token.find("@")
    number = _NOT_DIGIT.sub("", token)
    check = _luhn(number) if 13 <= len(number) <= 19 else None
    return [
        1.0, *_bins(digits, (1, 2, 4, 7, 8, 9, 11, 13, 15, 17, 20)), *_bins(token.count("."), (1, 2, 3, 4)), *_bins(token.count("-"), (1, 2)),
        *_bins(token.count("@"), (1, 2)), float(at > 0 and "." in token[at:]), float(at == 0), float(token[0] == "+"), float("(" in token),
        *_bins(letters, (1, 4, 9)), float(letters > 0 and digits > 0), float(token[0] in "\"'"), float("/" in token or ":" in token or "=" in token),
        float(check is True), float(check is False), float(_KEY.search(token) is not None), float(_CUE.search(before + token[: len(token) - len(token.lstrip("\"'"))]) is not None), float(_SECRET.search(token) is not None),
    ]


N_FEATURES = len(token_features("1"))


def signatures(token: str) -> list[str]:
    """What repeated or similar tokens have in common."""
    if "@" in token:
        address = token.strip(_TRIM + "()").lower()
        local = address.partition("@")[0]
        return ["a" + address] + ["l" + local] * (len(local) >= 6)
    out = []
    if key := _KEY.search(token):
        out += ["k" + key[0].lower(), "p" + key[0][:12].lower()]
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= 4:
        out.append("d" + digits)
    if len(digits) >= 7 and not key:
        out.append("s" + digits[-7:])
    return out


class Graph:
    """The tokens of many documents with their chain and skip edges."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.features: list[list[float]] = []
        self.gold: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, spans: list[Span]) -> None:
        seen: dict[str, int] = {}
        before = None
        linked: set[tuple[int, int]] = set()
        label_at = sorted((s, e, k + 1) for k, s, e in spans)
        p = 0
        for start, end in tokens(text):
            n, token = len(self.doc), text[start:end]
            self.doc.append(doc)
            self.span.append((start, end))
            self.features.append(token_features(token, text[max(0, start - BEFORE) : start]))
            while p < len(label_at) and label_at[p][1] <= start:
                p += 1
            self.gold.append(label_at[p][2] if p < len(label_at) and label_at[p][0] < end else OUTSIDE)
            chained = before if before is not None and start - self.span[before][1] <= 3 else None
            if chained is not None:
                self.chain.append((chained, n))
            for key in signatures(token):
                if key in seen and seen[key] != chained:
                    linked.add((seen[key], n))
                seen[key] = n
            before = n
        self.skip.extend(sorted(linked))

    def spread_labels(self) -> None:
        """For training: a token outside all spans gets the label of one that it repeats or resembles."""
        for a, b in sorted(self.skip) + sorted(self.skip, reverse=True):
            if OUTSIDE in (self.gold[a], self.gold[b]):
                self.gold[a] = self.gold[b] = max(self.gold[a], self.gold[b])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(ends, is skip) of all edges."""
        both = np.array(self.chain + self.skip, dtype=np.int64).reshape(-1, 2)
        return both, np.arange(len(both)) >= len(self.chain)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


class Weights:
    """unary: features x labels; chain: label then label of the next token; skip: symmetric."""

    def __init__(self) -> None:
        self.unary = np.zeros((N_FEATURES, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.agree = np.eye(LABELS) * AGREE
        self.skip = self.agree.copy()

    def fit(self, features: np.ndarray, gold: np.ndarray, ends: np.ndarray, is_skip: np.ndarray, steps: int = 400, decay: float = 1e-3) -> Weights:
        """Maximum pseudo-likelihood by gradient ascent with momentum."""
        if not len(gold):
            self.unary[0, OUTSIDE] = 5.0
            return self
        n, one = len(gold), np.eye(LABELS)[gold]
        features = features.copy()
        features[np.arange(n) * 2654435761 % (1 << 32) % WITHHELD == 0, 1:] = 0
        c, s = ends[~is_skip], ends[is_skip]
        speed = [np.zeros_like(w) for w in (self.unary, self.chain, self.skip)]
        for _ in range(steps):
            energy = features @ self.unary
            np.add.at(energy, c[:, 1], self.chain[gold[c[:, 0]]])
            np.add.at(energy, c[:, 0], self.chain.T[gold[c[:, 1]]])
            np.add.at(energy, s[:, 1], self.skip[gold[s[:, 0]]])
            np.add.at(energy, s[:, 0], self.skip[gold[s[:, 1]]])
            miss = one - _softmax(energy)
            chain = one[c[:, 0]].T @ miss[c[:, 1]] + (one[c[:, 1]].T @ miss[c[:, 0]]).T
            skip = one[s[:, 0]].T @ miss[s[:, 1]] + one[s[:, 1]].T @ miss[s[:, 0]]
            slopes = (features.T @ miss, chain, (skip + skip.T) / 2)
            for w, v, g, prior, pull in zip((self.unary, self.chain, self.skip), speed, slopes, (0, 0, self.agree), (decay, decay, 50 * decay), strict=True):
                v *= 0.9
                v += g / n - pull * (w - prior)
                w += v
        return self

    def marginals(self, features: np.ndarray, ends: np.ndarray, is_skip: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product beliefs of every token; ``given`` labels other than OUTSIDE are kept."""
        unary = features @ self.unary
        if given is not None:
            unary[np.flatnonzero(given != OUTSIDE), given[given != OUTSIDE]] += SURE
        n, e = len(unary), len(ends)
        if not e:
            return _softmax(unary)
        # Messages 0..e-1 go from an edge's first end to its second, the others back.
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        table = np.concatenate([np.where(is_skip[:, None, None], self.skip, self.chain), np.where(is_skip[:, None, None], self.skip, self.chain.T)])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        message = np.zeros((2 * e, LABELS))
        for _ in range(SWEEPS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            x = (belief[source] - message[back])[:, :, None] + table
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def added_spans(texts: list[str], spans: list[list[Span]], weights: Weights) -> list[list[Span]]:
    """Spans of the field's labels outside the base spans of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    graph = Graph()
    for i, t in enumerate(texts):
        graph.add(i, t, spans[i])
    if not graph.doc:
        return out
    ends, is_skip = graph.edges()
    share = weights.marginals(np.array(graph.features), ends, is_skip, np.array(graph.gold))
    label = np.where(share.max(axis=1) >= MARGINAL, share.argmax(axis=1), OUTSIDE)
    free = (label != OUTSIDE) & (np.array(graph.gold) == OUTSIDE)
    chained = {b: a for a, b in graph.chain}
    run: list[int] = []

    def close() -> None:
        if run:
            doc = graph.doc[run[0]]
            start, end = graph.span[run[0]][0], graph.span[run[-1]][1]
            piece = texts[doc][start:end]
            start, end = start + len(piece) - len(piece.lstrip(_TRIM)), end - len(piece) + len(piece.rstrip(_TRIM))
            if label[run[0]] == LABELS - 1 and (key := _KEY.search(texts[doc], start, end)):
                start, end = key.span()
            if start < end and not any(s < end and start < e for _, s, e in spans[doc]):
                out[doc].append((int(label[run[0]]) - 1, start, end))
        run.clear()

    for n in np.flatnonzero(free).tolist():
        if run and (chained.get(n) != run[-1] or label[n] != label[run[-1]]):
            close()
        run.append(n)
    close()
    return out


def learn(df: DataFrame, train_rows: int = TRAIN_ROWS) -> Weights:
    """Weights fitted to the base spans of about train_rows rows of (doc_id, _t)."""
    n = df.count()
    draw = F.pmod(F.xxhash64(F.lit("pii"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = df if n <= train_rows else df.where(draw < train_rows / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            graph = Graph()
            for i, t in enumerate(b.column(1).to_pylist()):
                graph.add(i, t, base_spans(t) + secret_spans(t))
            graph.spread_labels()
            # Features repeat a lot: equal (features, label) tokens matter once each, but edges need them all.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([np.array(graph.features, dtype=np.uint8).tobytes()]), pa.array([np.array(graph.gold, dtype=np.uint8).tobytes()]),
                    pa.array([np.array(graph.chain, dtype=np.int32).tobytes()]), pa.array([np.array(graph.skip, dtype=np.int32).tobytes()]),
                ],
                names=["f", "g", "c", "s"],
            )

    features, gold, chain, skip, at = [], [], [], [], 0
    rows = sample.mapInArrow(run, "f binary, g binary, c binary, s binary")
    for r in sorted(map(tuple, rows.collect())):
        g = np.frombuffer(r[1], dtype=np.uint8).astype(np.int64)
        features.append(np.frombuffer(r[0], dtype=np.uint8).reshape(-1, N_FEATURES).astype(np.float64))
        gold.append(g)
        chain.append(np.frombuffer(r[2], dtype=np.int32).reshape(-1, 2).astype(np.int64) + at)
        skip.append(np.frombuffer(r[3], dtype=np.int32).reshape(-1, 2).astype(np.int64) + at)
        at += len(g)
    if not at:
        return Weights().fit(np.zeros((0, N_FEATURES)), np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=bool))
    ends = np.concatenate([*chain, *skip])
    return Weights().fit(np.concatenate(features), np.concatenate(gold), ends, np.arange(len(ends)) >= sum(map(len, chain)))


def write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans (base and added) and, with keep_text, the masked text.

    ``carry`` names further columns of df that are handed through.
    """
    session_for(df)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    weights = learn(rows.select("doc_id", "_t"), train_rows)
    names = ["doc_id", *["n_" + k for k in BASE_KINDS], "base_sha256", "spans", "n_added"] + ["masked"] * keep_text + [f"_carry_{c}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, weights)
            columns = [b.column(0)]
            columns += [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(BASE_KINDS))]
            columns += [
                pa.array([hashlib.sha256(write(x).encode()).hexdigest() for x in base], pa.string()),
                pa.array([write(x + y) for x, y in zip(base, more, strict=True)], pa.string()), pa.array([len(y) for y in more], pa.int64()),
            ]
            if keep_text:
                columns.append(pa.array([mask(t, x + y) if x or y else t for t, x, y in zip(texts, base, more, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, *b.columns[2:]], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long" + ", masked string" * keep_text
    schema += "".join(f", `_carry_{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    found = rows.mapInArrow(run, schema)
    return found.withColumnsRenamed({f"_carry_{c}": c for c in carry}) if carry else found


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), keep_text=False)
