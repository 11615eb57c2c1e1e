"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and cut into n-grams of 1 to 3 code points, hashed to 65,536 buckets. Per language and
bucket the training counts give smoothed log-probabilities; that matrix (languages x 256 kB) goes to every task once.
Scoring works on blocks of many texts at once: the hashes of a block are the column indices of a sparse matrix
with a row per text, multiplied with the matrix by a gather and a segmented sum. Blocks have at most
about a million characters, longer texts are cut into pieces whose sums are added, so memory is bounded.

Training uses a sample: about ``per_lang`` documents a language, chosen by a hash of id and text, so that copies under
other ids are thinned like other documents; rows that agree in both come in or stay out together. The priors are
the languages' shares among all rows, sampled or not.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0, as is everything if
nothing was learned; null ids count as the empty string for the held-out rule; repeated rows get equal results; of equally
probable languages the first by code point wins; an empty table trains a model without languages and gets no rows. Input
columns with the names of the two that are added are replaced, whatever their case; other names can be asked for.

Its result is lazy, so ``identify`` leaves the session's limit on Arrow batches at 4 MB or what it was below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import hold_small_batches, small_batches

ORDERS, BITS, BLOCK = 3, 16, 1 << 20
#: Largest size in bytes of the matrix that is sent to the tasks.
MATRIX_LIMIT = 1 << 29


class Model:
    """Languages, their log-priors from the numbers of documents, the log-probability matrix (language, bucket), and how many documents were counted for it."""

    def __init__(self, langs: list[str], docs: np.ndarray, counts: np.ndarray, alpha: float = 0.5, sampled: np.ndarray | None = None):
        self.langs, self.sampled = langs, docs if sampled is None else sampled
        self.prior = np.log((docs + 1.0) / (docs.sum() + len(langs)))
        self.logp = np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * counts.shape[1])).astype(np.float32)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks ``(codes, owner, left, own)``: per character its text, how many characters of its piece follow, and whether n-grams may start there."""
    codes, owner, left, own, n = [], [], [], [], 0
    for i, t in enumerate(texts):
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(c), BLOCK):
            p = c[at : at + BLOCK + ORDERS - 1]
            codes.append(p), owner.append(np.full(len(p), i)), left.append(np.arange(len(p), 0, -1)), own.append(np.arange(len(p)) < BLOCK)
            n += len(p)
            if n >= BLOCK:
                yield tuple(map(np.concatenate, (codes, owner, left, own)))
                codes, owner, left, own, n = [], [], [], [], 0
    if n:
        yield tuple(map(np.concatenate, (codes, owner, left, own)))


def _grams(codes: np.ndarray, left: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the places where its n-grams start, and their buckets."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(ORDERS):
        h[: len(codes) - k] = (h[: len(codes) - k] + codes[k:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        at = np.nonzero(own & (left > k))[0]
        yield at, ((h[at] * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)) >> np.uint64(64 - BITS)).astype(np.int64)


def count_grams(texts: list[str]) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for codes, _, left, own in _pieces(texts):
        for _, bucket in _grams(codes, left, own):
            total += np.bincount(bucket, minlength=1 << BITS)
    return total


def score(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The most probable language of each text and its posterior probability."""
    known = [t if t and model.langs and any(map(str.isalpha, t)) else "" for t in texts]
    sums = np.tile(model.prior, (len(texts), 1)) if model.langs else np.zeros((len(texts), 0))
    for codes, owner, left, own in _pieces(known):
        for at, bucket in _grams(codes, left, own):
            if len(at):
                of = owner[at]
                start = np.nonzero(np.diff(of, prepend=-1))[0]
                for k in range(len(model.langs)):
                    sums[of[start], k] += np.add.reduceat(model.logp[k].take(bucket), start, dtype=np.float64)
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = sums.argmax(axis=1)
    post = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.langs[b] if t else "und" for b, t in zip(best, known, strict=True)], [float(p) if t else 0.0 for p, t in zip(post, known, strict=True)]


def _counted(batches):
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            c = count_grams(texts)
            total[lang] = total[lang] + c if lang in total else c
            docs[lang] = docs.get(lang, 0) + len(texts)
    for lang, c in total.items():
        at = np.nonzero(c)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs[lang], *c[at].tolist()], pa.int64())], ["lang", "bucket", "n"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, per_lang: int = 4000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from rows with text and language: all of them, or about ``per_lang`` of each language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) << BITS + 2 > MATRIX_LIMIT:
        raise ValueError(f"{len(langs)} languages: the matrix would exceed {MATRIX_LIMIT} bytes")
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 1 << BITS)))
    parts = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, per_lang / sizes[lang]) * (1 << 30)))])
    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.element_at(parts, F.col("lang"))).select("lang", "text")
    with small_batches(docs.sparkSession):
        found = some.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sampled, counts = np.zeros(len(langs)), np.zeros((len(langs), 1 << BITS))
    row = np.array([langs.index(x) for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    sampled[row[bucket < 0]] = n[bucket < 0]
    counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    return Model(langs, np.array([sizes[x] for x in langs], float), counts, sampled=sampled)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "__lang", score_name: str = "__lang_score") -> DataFrame:
    """``docs`` with ``__lang`` and ``__lang_score``, or whatever the names given."""
    hold_small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_name, score_name)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            lang, post = score(shared.value, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(post, pa.float64())], [*b.schema.names, lang_name, score_name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())]))
