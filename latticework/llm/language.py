"""Language identification by multilingual mixture inference.

Each language has a model of character n-grams. A document is a mixture of languages: every word comes from one language,
drawn by the document's proportions, and the word's likelihood under a language is that of its n-grams. Expectation-
maximisation estimates the proportions; the language set is the one whose likelihood, less a penalty for each further
language, is highest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Training documents a language, about: those of small hash of doc_id, whole. Every language has a model.
SAMPLE = 400
#: The tables of more languages than this hold only the n-grams that a language has.
DENSE = 64
BUCKETS = 1 << 16
ROUNDS = 12
#: Added to every n-gram's count.
SMOOTHING = 0.5
#: What a further language in the set costs, in units of log(number of words); a word counts with the part EVIDENCE of its n-grams' likelihood.
PENALTY = 2.0
EVIDENCE = 0.5
#: Of at most so many languages with a part in a document, all sets are tried.
FEW = 5
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = ord(" ")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 1- to 3-grams that end at each letter of the text's words, (3, letters), and the words' first letters.

    Words are maximal runs of letters in lower case; a space stands before each word.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty((3, 0), np.int64), np.empty(0, np.int64)
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = codes[1:]
    two = one * np.uint64(0x9E3779B1) + codes[:-1] * np.uint64(0x85EBCA77) + np.uint64(1)
    before = np.concatenate([codes[:1], codes[:-2]]) if len(codes) > 1 else codes[:0]
    three = two * np.uint64(0xC2B2AE3D) + before * np.uint64(0x27D4EB2F) + np.uint64(2)
    spaces = np.flatnonzero(one == _SPACE)
    starts = np.concatenate([[0], spaces[:-1] + 1])
    mix = lambda x: ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)
    return np.stack([mix(one), mix(two), mix(three)]), starts


def training(docs: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """(lang, text) of a sample of labelled rows, about ``sample`` documents a language.

    A document is in the sample if the hash of its id, as a fraction, is below its language's share, so reruns agree.
    """
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in counts.items()], "lang string, __share double")
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    kept = docs.filter(F.col("text").isNotNull()).select("lang", "text", hashed.alias("__hashed")).join(F.broadcast(shares), "lang")
    return kept.filter(F.col("__hashed") < F.col("__share")).select("lang", "text")


def gram_cells(rows: DataFrame, languages: list[str]) -> pa.Table:
    """(cell, lang, n): how often each language has each n-gram in whole texts, from (lang, text); cell is order * BUCKETS + bucket.

    Executors count and keep no table of all languages; what the driver gets is at most a row for each pair of n-gram and language.
    """
    number = {lang: i for i, lang in enumerate(languages)}

    def counted(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        for at in range(0, len(found), 65_536):
            part = found[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array((part % (3 * BUCKETS)).astype(np.int32)), pa.array((part // (3 * BUCKETS)).astype(np.int32)), pa.array(n[at : at + 65_536], pa.int64())], ["cell", "lang", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        keys, size = [], 0
        for batch in common.text_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found, _ = grams(text.as_py())
                keys.append((found + np.arange(3)[:, None] * BUCKETS + number[lang] * 3 * BUCKETS).ravel())
                size += found.size
                if size > 4_000_000:
                    yield from counted(keys)
                    keys, size = [], 0
        if keys:
            yield from counted(keys)

    return rows.mapInArrow(run, "cell int, lang int, n long").groupBy("cell", "lang").agg(F.sum("n").alias("n")).toArrow()


def dense(cells: pa.Table, languages: list[str]) -> np.ndarray:
    """Counts (3, buckets, languages)."""
    out = np.zeros((3, BUCKETS, len(languages)))
    out.reshape(-1)[cells.column("cell").to_numpy().astype(np.int64) * len(languages) + cells.column("lang").to_numpy()] = cells.column("n").to_numpy()
    return out


def gram_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts (3, buckets, languages) of the n-grams of whole texts, from (lang, text)."""
    return dense(gram_cells(rows, languages), languages)


class Model:
    """Log probabilities (buckets, languages) of each order's n-grams, summed over orders when words are scored."""

    def __init__(self, languages: list[str], tables: np.ndarray):
        self.languages, self.tables = languages, tables

    @classmethod
    def of_cells(cls, cells: pa.Table, languages: list[str]) -> Model:
        return cls.of_counts(dense(cells, languages), languages) if len(languages) <= DENSE else SparseModel(languages, cells)

    @classmethod
    def of_counts(cls, counts: np.ndarray, languages: list[str]) -> Model:
        used = np.maximum(1, (counts.sum(axis=2, keepdims=True) > 0).sum(axis=1, keepdims=True))
        logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * used)
        return cls(languages, logs.astype(np.float32))

    def words(self, text: str) -> np.ndarray:
        """Log likelihood (words, languages)."""
        found, starts = grams(text)
        if not len(starts):
            return np.empty((0, len(self.languages)))
        letters = self.tables[0][found[0]] + self.tables[1][found[1]] + self.tables[2][found[2]]
        return np.add.reduceat(letters, starts, axis=0) * (EVIDENCE / 3)

    def infer(self, text: str | None) -> tuple[dict[str, float], float]:
        """(proportions of the languages in the set, log likelihood a word); an empty set if there is no letter."""
        scores = self.words(text or "")
        if not len(scores) or not self.languages:
            return {}, 0.0
        chosen, likelihood = select_set(scores)
        return {self.languages[i]: p for i, p in chosen}, likelihood / len(scores)


class SparseModel(Model):
    """The same for many languages: what an n-gram that a language lacks gets (``base``), and what each one that it has gets beyond it."""

    def __init__(self, languages: list[str], cells: pa.Table):
        self.languages = languages
        cell, lang, n = (cells.column(c).to_numpy() for c in ("cell", "lang", "n"))
        order = np.lexsort((lang, cell))
        cell, lang, n = cell[order], lang[order], n[order]
        self.first = np.searchsorted(cell, np.arange(3 * BUCKETS + 1))
        self.lang, self.gain = lang.astype(np.int32), np.log((n + SMOOTHING) / SMOOTHING).astype(np.float32)
        self.base = np.zeros(len(languages))
        for o in range(3):
            own = slice(self.first[o * BUCKETS], self.first[(o + 1) * BUCKETS])
            used = max(1, len(np.unique(cell[own])))
            totals = np.bincount(lang[own], weights=n[own], minlength=len(languages))
            self.base += np.log(SMOOTHING) - np.log(totals + SMOOTHING * used)

    def words(self, text: str) -> np.ndarray:
        found, starts = grams(text)
        k = len(self.languages)
        out = np.empty((len(starts), k), np.float32)
        ends = np.append(starts[1:], found.shape[1])
        step = max(1, 200_000 // k)
        for a in range(0, len(starts), step):
            low, high = starts[a : a + step], ends[a : a + step]
            cells = (found[:, low[0] : high[-1]] + np.arange(3)[:, None] * BUCKETS).ravel()
            word = np.tile(np.repeat(np.arange(len(low)), high - low), 3)
            n = self.first[cells + 1] - self.first[cells]
            at = np.arange(n.sum()) + np.repeat(self.first[cells] - (np.cumsum(n) - n), n)
            gains = np.bincount(np.repeat(word, n) * k + self.lang[at], weights=self.gain[at], minlength=len(low) * k)
            out[a : a + step] = (gains.reshape(-1, k) + (high - low)[:, None] * self.base) * (EVIDENCE / 3)
        return out


def em(scores: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the mixture and its log likelihood, from word scores (words, languages)."""
    top = scores.max(axis=1, keepdims=True)
    near = np.exp(scores - top)
    share = np.full(scores.shape[1], 1.0 / scores.shape[1])
    step = max(1, 4_000_000 // scores.shape[1])
    for _ in range(rounds):
        new = np.zeros(len(share))
        for a in range(0, len(near), step):
            joint = near[a : a + step] * share
            new += (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0)
        new /= len(near)
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(np.log(np.maximum(near @ share, 1e-300)).sum() + top.sum())


def select_set(scores: np.ndarray) -> tuple[list[tuple[int, float]], float]:
    """[(language, proportion)] of the set of highest penalised likelihood, largest first; ties go to the smaller set and the earlier language.

    No subset is likelier than the best word by word, which settles documents of one language without estimation (their
    proportion is 1). Else sets are made of the languages that have a part in the full mixture: all of them if these are few, and
    nested ones by proportion if they are many.
    """
    price = PENALTY * np.log(len(scores) + 1.0)
    totals = scores.sum(axis=0)
    best = int(totals.argmax())
    if scores.max(axis=1).sum() - totals[best] <= price:
        return [(best, 1.0)], float(totals[best])
    share, full = em(scores)
    if full - totals[best] <= price:
        return [(best, 1.0)], float(totals[best])
    order = [int(i) for i in np.argsort(-share, kind="stable") if share[i] >= 1e-3]
    if len(order) <= FEW:
        sets = [c for k in range(2, len(order) + 1) for c in combinations(sorted(order), k)]
    else:
        sets = [tuple(order[:k]) for k in range(2, len(order) + 1)]
    found, value = ([(best, 1.0)], float(totals[best])), float(totals[best])
    for chosen in sets:
        if full - price * (len(chosen) - 1) <= value:
            continue
        part, likelihood = em(scores[:, list(chosen)])
        if likelihood - price * (len(chosen) - 1) > value:
            value = likelihood - price * (len(chosen) - 1)
            found = (sorted(((i, float(p)) for i, p in zip(chosen, part)), key=lambda x: (-x[1], x[0])), likelihood)
    return found


def fold(column: str = "doc_id"):
    """crc32 of the id as text, mod 5; null ids are in fold 0, which is not learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5, F.lit(0))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of every language that documents (doc_id, text, lang) outside of fold 0 have.

    Rows of a null text, lang or doc_id teach nothing; repeated rows each count; other columns are ignored. Without any labelled
    row the model has no language and everything is ``und``.
    """
    common.bounded_batches(docs.sparkSession)
    known = docs.filter((fold() != 0) & F.col("lang").isNotNull())
    rows = known.filter(F.col("text").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()
    counts = {r["lang"]: r["n"] for r in sorted(rows)}
    if not counts:
        return Model([], np.zeros((3, BUCKETS, 0), np.float32))
    return Model.of_cells(gram_cells(training(known, counts, sample), list(counts)), list(counts))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (its proportion) and mixture (a map of the set's proportions).

    Null texts and texts without a letter are ``und`` with score 0 and an empty mixture, as is everything if no language was learnt.
    Every whole text is read; only the text counts. Repeated rows get equal results. Columns of these names are replaced.
    """
    common.bounded_batches(docs.sparkSession)
    base = docs.drop("lang_pred", "score", "mixture")
    at, names = base.columns.index("text"), base.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        own = shared.value
        for batch in common.text_batches(batches):
            found = [own.infer(t)[0] for t in batch.column(at).to_pylist()]
            best = [next(iter(m.items()), (UNDETERMINED, 0.0)) for m in found]
            mixture = pa.array([list(m.items()) for m in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b[0] for b in best], pa.string()), pa.array([min(1.0, b[1]) for b in best], pa.float64()), mixture], [*names, "lang_pred", "score", "mixture"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{kinds}, lang_pred string, score double, mixture map<string,double>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = predict(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))
