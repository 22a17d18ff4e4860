"""Toxicity by class-conditional Kneser-Ney models.

Two language models, one of toxic and one of ordinary texts, back off from a word after its
predecessor to the word alone and from there to counts that both share. All
counts are Kneser-Ney's: of a pair the number of words seen before it, of a word the
number of words seen before it; so copies of a text count once. Absolute discounts move
mass down. What a level hands down is the same share for both classes, the
larger of the two: a rare expression, which only the level below
knows, has the same probability in both and says nothing about the class.

A text's score compares its two log-likelihoods, normalised by length: the mean of the words'
log-ratios. Its language or subject shifts them all alike, so their median is taken
off, as far as it is below ``DEAD``; ratios within ``DEAD`` of it are chance and count as equal. ``PRIOR``
neutral words are added to every text, which steadies short ones. A mean doesn't grow with length. A
logistic curve in it, rising, fitted on texts that the models did not see (two folds), gives the score.

Training uses labelled rows only, at most ``max_per_class`` of each class in the
order of a hash of the identifier and ``max_chars`` characters in all; that bounds
the one task that fits the models and what is sent to workers. Scoring reads every text
whole.

Edge cases: null counts as empty; a text without words gets the score of a text
without evidence; null identifiers are scored, and never used for training;
repeated labels of an identifier count as toxic if one is; without labels of
both classes the score is the share of toxic labels, 0 without labels; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import lean, released, sliced, table, written

WORD = re.compile(r"[^\W\d_]+")
#: Discounts of words and of pairs: below them a count is rare, and the next level decides.
#: Of these the ones are taken that tell texts not seen apart best.
DISCOUNTS = ((0.25, 0.25), (0.75, 2.0), (3.0, 20.0))
DEAD, PRIOR = 1.0, 20
MAX_PER_CLASS, MAX_CHARS = 2500, 12_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def counted(texts: list[np.ndarray], toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (class, before, word) as numbers ((class * (n + 1) + before) * n + word), and how many words were seen before each; n as before starts a text."""
    # The earlier word is told apart as far as the number has room for it: fully below 1.6 million words.
    room, held, keys, size = (1 << 62) // (2 * (n + 1) * n), [], [], 0
    for k, text in enumerate(texts):
        if len(text):
            word = text.astype(np.int64)
            before = np.concatenate([[n], word[:-1]])
            earlier = np.concatenate([[n], before[:-1]])
            held.append((earlier % room) + room * ((int(toxic[k]) * (n + 1) + before) * n + word))
            size += len(text)
        if size > 1 << 17 or k == len(texts) - 1:
            keys += [np.unique(np.concatenate(held))] if held else []
            held, size = [], 0
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    keys //= room
    return np.unique(keys, return_counts=True)


class Models:
    """Both models as log-likelihood ratios (toxic over ordinary) of the words and pairs that aren't rare; any other has 0."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], names: list[str], discounts: tuple[float, float] = DISCOUNTS[-1]):
        """pairs: what ``counted`` gives for texts as places of their words in ``names``."""
        (pair, count), n = pairs, len(names)
        self.places, self.ratio, self.pairs, self.pair_ratio, self.base = {}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), 1
        if not len(pair):
            return
        mid = int(np.searchsorted(pair, (n + 1) * n))
        sides = [(pair[:mid], count[:mid]), (pair[mid:] - (n + 1) * n, count[mid:])]
        words = np.stack([np.bincount(k % n, minlength=n) for k, _ in sides]).astype(float)
        left = np.maximum(words - discounts[0], 0)
        kept, total = left.sum(1), words.sum(1)
        down = float((1 - kept / np.maximum(total, 1)).max())
        p = down * words.sum(0) / words.sum() + (1 - down) * left / np.maximum(kept, 1)[:, None]
        # Pairs above the discount; the others count in the totals alone.
        clear = [(k[c > discounts[1]], c[c > discounts[1]] - discounts[1]) for k, c in sides]
        total = np.stack([np.bincount(k // n, weights=c, minlength=n + 1) for k, c in sides])
        kept = np.stack([np.bincount(k // n, weights=c, minlength=n + 1) for k, c in clear])
        told = np.unique(np.concatenate([k for k, _ in clear]))
        told = told[kept.min(0)[told // n] > 0]
        v, w, left = told // n, told % n, np.zeros((2, len(told)))
        for side, (k, c) in zip(left, clear, strict=True):
            at = np.minimum(np.searchsorted(told, k), max(0, len(told) - 1))
            hit = told[at] == k if len(told) else np.zeros(len(k), bool)
            side[at[hit]] = c[hit]
        down = (1 - kept[:, v] / np.maximum(total[:, v], 1)).max(0)
        q = down * p[:, w] + (1 - down) * left / np.maximum(kept[:, v], 1)
        log = lambda x: np.log(x[1]) - np.log(x[0])
        keep = np.unique(np.concatenate([np.flatnonzero(words.max(0) > discounts[0]), v[v < n], w]))
        place = np.full(n + 1, -1, np.int64)
        place[keep] = np.arange(len(keep))
        place[n] = len(keep)
        self.places = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.ratio, self.base = log(p[:, keep]), len(keep) + 1
        key = place[v] * self.base + place[w]
        order = np.argsort(key)
        self.pairs, self.pair_ratio = key[order], log(q)[order]

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word after its predecessor."""
        known = self.places.get
        at = np.array([known(w, -1) for w in words], np.int64)
        if not len(self.ratio) or not len(at):
            return np.zeros(len(at))
        out = np.where(at >= 0, self.ratio[at], 0.0)
        if len(self.pairs):
            before = np.concatenate([[self.base - 1], at[:-1]])
            key = before * self.base + at
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (before >= 0) & (at >= 0) & (self.pairs[k] == key)
            out[hit] = self.pair_ratio[k[hit]]
        return out

    def evidence(self, words: list[str]) -> float:
        """Length-normalised difference of the two log-likelihoods."""
        r = self.ratios(words)
        if not len(r):
            return 0.0
        r = np.concatenate([r, np.zeros(PRIOR)])
        r -= np.clip(np.median(r), -DEAD, DEAD)
        return float((np.maximum(r - DEAD, 0) - np.maximum(-r - DEAD, 0)).mean())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta, cost = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    cost[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - cost * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(cost + 1e-9), gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Scorer:
    def __init__(self, texts: list[str], toxic: list[int], odds: float):
        """odds: how many ordinary labels there are for each ordinary text here, against the same for toxic ones."""
        y = np.array(toxic, bool)
        self.models, self.share = None, float(odds)
        if not len(y) or y.all() or not y.any():
            self.share = float(y.mean()) if len(y) else 0.0
            return
        names: dict[str, int] = {}
        words = [np.array([names.setdefault(w, len(names)) for w in words_of(t)], np.int32) for t in texts]
        del texts
        vocabulary = list(names)
        fold = np.zeros(len(y), int)
        for c in (False, True):
            fold[y == c] = np.arange((y == c).sum()) % 2
        weight, best = np.where(y, 1.0, odds), np.inf
        folds = [counted([w for w, g in zip(words, fold, strict=True) if g != f], y[fold != f], len(vocabulary)) for f in (0, 1)]
        for discounts in DISCOUNTS:
            x = np.zeros((len(y), 1))
            for f in (0, 1):
                if y[fold != f].any() and not y[fold != f].all():
                    seen = Models(folds[f], vocabulary, discounts)
                    for k in np.flatnonzero(fold == f):
                        x[k] = seen.evidence([vocabulary[i] for i in words[k].tolist()])
            unit = float(np.sqrt((x**2).mean())) or 1.0
            beta = logistic(x / unit, y.astype(float), weight)
            loss = float(weight @ np.logaddexp(0, np.where(y, -1, 1) * (x[:, 0] / unit * beta[0] + beta[1])))
            if beta[0] > 0 and loss <= best:
                best, self.unit, self.beta, chosen = loss, unit, beta, discounts
        if np.isfinite(best):
            del folds, seen
            self.models = Models(counted(words, y, len(vocabulary)), vocabulary, chosen)
        else:  # the labels don't go with the likelihoods
            self.share = float(y.sum() / (y.sum() + odds * (~y).sum()))

    def __call__(self, text: str | None) -> float:
        if self.models is None:
            return self.share
        z = self.models.evidence(words_of(text)) / self.unit * self.beta[0] + self.beta[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> Packed:
    """A scorer from the labelled rows of ``docs``; leave out beforehand what it must not see."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = written(marked, "labels")
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id")
    ids = None
    for c in (0, 1):
        part = marked.where(F.col("y") == c).orderBy(order, "id").limit(max_per_class)
        ids = part if ids is None else ids.unionByName(part)
    # At most 2 * max_per_class rows.
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc") == F.col("id"))
    rows = written(rows.select("y", "text", order.alias("place"), "id"), "labelled")
    fitted = rows.repartition(1).sortWithinPartitions("place", "id", "text").mapInArrow(fitter(max_chars, n), "model binary").collect()
    return Packed(bytes(fitted[0]["model"]) if fitted else cloudpickle.dumps(Scorer([], [], 1.0)))


def fitter(max_chars: int, labels: dict[int, int]):
    """One task's rows (y, text) to a scorer: each class has half of the characters. labels: number of each class in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, texts, y = {0: max_chars // 2, 1: max_chars // 2}, [], []
        for batch in batches:
            for c, text in zip(batch.column(0), batch.column(1), strict=True):
                c = c.as_py()
                if len(t := text.as_py()) <= left[c]:
                    left[c] -= len(t)
                    texts.append(t), y.append(c)
            del batch
        here = {c: max(1, y.count(c)) for c in (0, 1)}
        odds = (labels.get(0, 0) / here[0]) / max(1e-9, labels.get(1, 0) / here[1]) if labels.get(1) else 1.0
        fitted = cloudpickle.dumps(Scorer(texts, y, odds))
        del texts
        gc.collect()
        released()
        yield pa.RecordBatch.from_pydict({"model": pa.array([fitted], pa.binary())})

    return run


class Packed:
    """A pickled scorer; opened where it is first used, so the driver never holds it open."""

    def __init__(self, raw: bytes):
        self.raw, self.scorer = raw, None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "scorer": None}

    def __call__(self, text: str | None) -> float:
        if self.scorer is None:
            self.scorer = cloudpickle.loads(self.raw)
        return self.scorer(text)

    def close(self) -> None:
        self.scorer = None


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t.as_py()) for t in batch.column(1)], pa.float64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows held out are never learnt from."""
    scorer = train(docs.where(~held_out()), labels.where(~held_out()))
    found = score(docs, scorer)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def ordinary_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose own text isn't scored as toxic."""
    scorer = train(docs.where(~held_out()), labels.where(~held_out()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([scorer(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))
        scorer.close()

    return docs.mapInArrow(lean(keep), docs.schema)
