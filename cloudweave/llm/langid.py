"""Language identification with hyperdimensional profiles.

Every letter owns a random +1/-1 vector, drawn from its code point and a fixed seed. An n-gram's vector
is the product of its letters' vectors, each permuted (rotated) once more for every place further left;
a text is the sum of its n-gram vectors, and a language the sum over its training texts. A text gets
the language whose prototype has the largest cosine with it.

The prototypes are learned from a sample of labelled rows of documented size: at most about
``rows_per_lang`` rows of each language, picked by a hash of the id. Only one vector per language and
task leaves the executors. The number of languages is taken to be small (each costs ``dim`` numbers).

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything when
nothing could be learned; ties go to the language that sorts first; a text of any length is read in
pieces; an empty table gives no rows; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import documents, fold, session_for

DIM = 1024
ORDER = 3
#: Letters read at a time, over all texts of a batch.
PIECE = 1 << 20
ROWS_PER_LANG = 4000
UNKNOWN = "und"
#: A text of so many letters whose cosine is within so many standard deviations of chance is in no known language.
LEAST_LETTERS, NOISE = 64, 3.0


class Encoder:
    """Bundled n-gram vectors of texts. Letter vectors are drawn once for each code point met."""

    def __init__(self, dim: int = DIM, order: int = ORDER, seed: int = 7):
        self.dim, self.order, self.seed = dim, order, seed
        self.letters: dict[int, np.ndarray] = {}
        self.alpha = np.full(0x110000, -1, dtype=np.int8)
        self.grams: tuple[tuple, np.ndarray] | None = None

    def _space(self, codes: np.ndarray, after_letter: bool) -> np.ndarray:
        """Code points with every run of other than letters turned into one space; a run at the start counts only after a letter."""
        state = self.alpha[codes]
        if (state < 0).any():
            for c in np.unique(codes[state < 0]).tolist():
                self.alpha[c] = chr(c).isalpha()
            state = self.alpha[codes]
        is_letter = state > 0
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[:1] |= after_letter
        return np.where(is_letter, codes, 32)[keep]

    def _letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            rng = np.random.Generator(np.random.PCG64([self.seed, c]))
            self.letters[c] = (rng.integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def _bundle(self, codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Sum of the n-gram vectors in codes for each of n owners; n-grams across owners don't count."""
        out = np.zeros((n, self.dim), dtype=np.float32)
        k = len(codes) - self.order + 1
        if k <= 0:
            return out
        present = np.zeros(int(codes.max()) + 1, dtype=bool)
        present[codes] = True
        alphabet, place = np.flatnonzero(present), (np.cumsum(present, dtype=np.int32) - 1)[codes]
        inside = owner[:k] == owner[self.order - 1 :]
        size = len(alphabet)
        gram = np.zeros(k, dtype=np.int32 if size**self.order < 1 << 31 else np.int64)
        for i in range(self.order):
            gram = gram * size + place[i : i + k]
        gram, who = gram[inside], owner[:k][inside]
        if not len(gram):
            return out
        if size**self.order <= 1 << 24:
            seen = np.bincount(gram, minlength=size**self.order) > 0
            distinct = np.flatnonzero(seen)
            index = (np.cumsum(seen) - 1)[gram]
        else:
            distinct, index = np.unique(gram, return_inverse=True)
        vectors = np.stack([self._letter(int(c)) for c in alphabet])
        rotated = [np.roll(vectors, self.order - 1 - i, axis=1) for i in range(self.order)]
        width = max(1, (1 << 22) // n)
        for lo in range(0, len(distinct), width):
            some, rest = distinct[lo : lo + width], distinct[lo : lo + width]
            bound = np.ones((len(some), self.dim), dtype=np.int8)
            for i in reversed(range(self.order)):
                rest, at = np.divmod(rest, size)
                bound *= rotated[i][at]
            mine = slice(None) if len(distinct) <= width else (index >= lo) & (index < lo + width)
            counts = np.bincount(who[mine] * len(some) + index[mine] - lo, minlength=n * len(some))
            out += counts.reshape(n, len(some)).astype(np.float32) @ bound.astype(np.float32)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, has a letter) of the texts; a text is framed by spaces."""
        total = np.zeros((len(texts), self.dim), dtype=np.float32)
        lettered = np.zeros(len(texts), dtype=bool)
        # Every piece of a text is an owner of its own, so no n-gram is counted across two of them.
        parts, rows, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if parts:
                who = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                np.add.at(total, np.array(rows), self._bundle(np.concatenate(parts), who, len(parts)))
            parts.clear()
            rows.clear()
            held = 0

        for row, text in enumerate(texts):
            if not text:
                continue
            # Pieces overlap by what an n-gram needs, and a space frames the text.
            tail = np.array([32], dtype=np.uint32)
            for at in range(0, len(text), PIECE):
                raw = text[at : at + PIECE].lower().encode("utf-32-le", "replace")
                codes = self._space(np.frombuffer(raw, dtype=np.uint32), bool(tail[-1] != 32))
                lettered[row] |= bool((codes != 32).any())
                codes = np.concatenate([tail, codes])
                if at + PIECE >= len(text) and codes[-1] != 32:
                    codes = np.append(codes, np.uint32(32))
                parts.append(codes)
                rows.append(row)
                held += len(codes)
                tail = codes[-(self.order - 1) :]
                if held >= PIECE:
                    flush()
        flush()
        return total, lettered


def learn(labelled: DataFrame, dim: int = DIM, rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes from (doc_id, text, lang); rows with a null lang or text are passed over."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, dim))
    share = F.lit(1.0)
    for lang, n in sizes.items():
        if n > rows_per_lang:
            share = F.when(F.col("lang") == lang, F.lit(rows_per_lang / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dim), {}
        for b in batches:
            vectors, _ = encoder.encode(b.column(1).to_pylist())
            # Texts count alike, however long.
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"]
            )

    parts = sample.mapInArrow(bundle, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).orderBy("lang").collect()
    langs = [r["lang"] for r in found]
    prototypes = np.array([[x["x"] for x in r["v"]] for r in found])
    return langs, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)


def predict(df: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score): the best language's name and its cosine, not below 0. ``carry`` names columns handed through."""
    session_for(df)
    dim = prototypes.shape[1]
    against = prototypes.T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dim)
        for b in batches:
            vectors, lettered = encoder.encode(b.column(1).to_pylist())
            known = lettered & bool(langs)
            names = np.full(len(vectors), UNKNOWN, dtype=object)
            score = np.zeros(len(vectors))
            if langs and len(vectors):
                cosine = (vectors @ against) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(axis=1)
                names[known] = np.array(langs, dtype=object)[best[known]]
                score[known] = np.clip(cosine[np.arange(len(best)), best][known], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names.tolist(), pa.string()), pa.array(score), *b.columns[2:]], names=["doc_id", "lang_pred", "score", *[f"_carry_{c}" for c in carry]]
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_t"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    schema += "".join(f", `_carry_{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    found = rows.mapInArrow(run, schema)
    return found.withColumnsRenamed({f"_carry_{c}": c for c in carry}) if carry else found


def held_out(id_col: str = "doc_id"):
    return fold(id_col, 3) == 1


def keep_known(df: DataFrame) -> DataFrame:
    """The rows of documents that are in one of the languages learned; where ``lang`` is null it gets the prediction.

    Null texts and texts without a letter go, and so do texts of ``LEAST_LETTERS`` letters or more whose best cosine is no larger than
    that of random vectors may be (``NOISE`` standard deviations): other languages and scripts, and strings in none. Shorter texts have
    too few n-grams for that and stay. Where nothing could be learned letters alone decide.
    """
    session_for(df)
    langs, prototypes = learn(df.where(~held_out()).select("doc_id", "text", "lang"))
    # Columns travel under names that clash with nothing.
    kept = {f"_keep{n}": c for n, c in enumerate(df.columns)}
    plain = df.select("doc_id", "text", *[F.col(c).alias(k) for k, c in kept.items()])
    found = predict(plain, langs, prototypes, carry=tuple(kept))
    text, lang = (next(k for k, c in kept.items() if c == name) for name in ("text", "lang"))
    if not langs:
        return found.where(F.col(text).rlike("\\p{L}")).select(*[F.col(k).alias(c) for k, c in kept.items()])
    few = F.length(F.regexp_replace(text, "\\P{L}+", "")) < LEAST_LETTERS
    known = (F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= NOISE / prototypes.shape[1] ** 0.5) | few)
    return found.where(known).select(*[F.coalesce(k, "lang_pred").alias(c) if k == lang else F.col(k).alias(c) for k, c in kept.items()])


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    session_for(docs)
    langs, prototypes = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, langs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
