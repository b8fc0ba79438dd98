"""Toxicity: noisy-channel deobfuscation, then scoring of the restored words.

1. A character trigram model is counted over every document (28 symbols, so 28**3 counts whatever the size).
2. A token that looks disguised (digits or signs among or for its letters, a letter three times running, single letters
   apart) is a lattice: each place has the letters it may stand for, each with a channel cost. Viterbi
   finds its most likely reading under the model. A distinct token is decoded once per worker's cache.
3. From at most MAX_LABELLED labelled training documents, words get log odds of standing in toxic
   documents, shrunk by PRIOR documents at the base rate. Three sums of a document's word weights go into a logistic model fitted on the
   same documents, each without its own share in the weights.

Only texts enter a score. Labels of held-out rows (crc32 of the id as text, mod 3, is 1) are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches, text_of

MAX_LABELLED, MAX_WORDS, MIN_ODDS, PRIOR, CACHE = 20_000, 5_000, 2.0, 2.0, 300_000
#: A telling word stands in so many toxic training documents, and in this share of them.
MIN_DOCS, MIN_SHARE = 3, 0.005
THRESHOLD = 0.7
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
SIGN_COST, SHORTEN_COST, DOUBLE_COST = 1.0, 0.5, 1.5
READINGS, MARGIN = 4, 8.0
#: Letters that are words of their own. As many as ENDS of them, or signs, may stand before or behind a spaced-out word.
SINGLE, ENDS = frozenset("aeiouyrnwzàèéìòóôö"), 3
SYMBOLS = 28  # 0: between words, 1-26: a-z, 27: any other letter

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W\d_]+")
_APART = re.compile(r"(?:\w[\W_]){2,}\w")
#: Single characters between blanks; signs may stand before the first and behind the last.
_SPACED = re.compile(r"(?<!\S)[^\w\s]*(\S(?:[ \t]+\S)+[ \t]+\S)[^\w\s]*(?!\S)")
#: Numbers and amounts are no words, though their digits may stand for letters.
_AMOUNT = re.compile(r"\+?[$€]?[^+$€@!|(*]*[+$€]?")
_RUN = re.compile(r"(.)\1*", re.S)
_TABLE = np.zeros(256, np.uint16)
_TABLE[97:123] = _TABLE[65:91] = np.arange(1, 27)
_TABLE[128:] = 27


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            s = np.concatenate([[0, 0], _TABLE[np.frombuffer(text.encode(), np.uint8)], [0]])
            np.add.at(total, s[:-2].astype(np.int64) * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], 1)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"tri": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others, from all texts: an array of 28 x 28 x 28."""
    rows = docs.select(text_of(docs).alias("text")).mapInArrow(count_trigrams, "tri int, n long").groupBy("tri").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r.tri] = r.n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = counts.sum((0, 1)) + 1
    two = counts.sum(0) + 2 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = counts + 2 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character what it may stand for, with its cost."""
    out = []
    for run in _RUN.finditer(token):
        c, n = run[1], len(run[0])
        letters = [(x, SIGN_COST * n) for x in LEET.get(c, "")] if not c.isalpha() else [(c, 0.0)]
        if not letters:
            continue  # a separator
        out.append([y for x, cost in letters for y in ([(x, cost)] if n == 1 else [(x, cost + (DOUBLE_COST if n == 2 else SHORTEN_COST)), (x * 2, cost + (0 if n == 2 else SHORTEN_COST))])])
    return out


def decode(token: str, lm: np.ndarray) -> list[str]:
    """The likeliest readings of the token, best first: Viterbi over its lattice, with the last two letters as state.

    Ends that differ in their last letters (one s or two) are readings of their own if not much worse."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(token):
        then: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, said) in best.items():
            for letters, cost in options:
                s, x, y = score - cost, a, b
                for c in letters:
                    z = _symbol(c)
                    s, x, y = s + lm[x, y, z], y, z
                if (x, y) not in then or then[x, y][0] < s:
                    then[x, y] = (s, said + letters)
        best = then
    ends = sorted(((s + lm[a, b, 0], said) for (a, b), (s, said) in best.items()), reverse=True)
    return [said for s, said in ends[:READINGS] if s >= ends[0][0] - MARGIN]


def disguised(token: str) -> bool:
    if not any(c.isalpha() for c in token):
        return any(c in LEET for c in token) and not _AMOUNT.fullmatch(token)
    return any(c in LEET for c in token) or any(len(m[0]) > 2 and m[1].isalpha() for m in _RUN.finditer(token)) or bool(_APART.fullmatch(token))


def restored(token: str, lm: np.ndarray, longest: int | None = None) -> list[str]:
    """The words of a token, among them the decoded one if it looks disguised.

    With longest, tokens that can only be read as more letters aren't decoded."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", _HIDDEN.sub("", token))
    words = _WORD.findall(token)
    core = token.strip(".,;:?\"'()[]{}<>#%&*-_~`^=/\\ ")
    core = core.rstrip("!")
    if core and disguised(core) and (longest is None or len(core) <= longest or len(lattice(core)) <= longest):
        words += decode(core, lm)
    return words


def spaced(text: str) -> list[str]:
    """Runs of at least three single characters, joined; runs of one character repeated aren't words.

    Such a run is also joined without words of one letter and signs at its ends, as 'a' in 'a m o r o n'."""
    out = []
    for m in _SPACED.finditer(text):
        run = m[1].split()
        ends = []
        for side in (run, run[::-1]):
            n = 0
            while n < min(ENDS, len(run)) and (side[n] in SINGLE or not side[n].isalpha()):
                n += 1
            ends.append(n)
        for a in range(ends[0] + 1):
            for b in range(ends[1] + 1):
                part = run[a : len(run) - b]
                if len(part) > 2 and len(set(part)) > 1 and (any(c.isalpha() for c in part) or disguised("".join(part))):
                    out.append("".join(part))
    return out


class Reader:
    """Splits texts into restored words, with a bounded cache of decoded tokens."""

    def __init__(self, lm: np.ndarray):
        self.lm, self.known = lm, {}

    def __call__(self, text: str) -> tuple[set[str], list[str]]:
        """Tokens as they stand, and spaced-out words joined."""
        low = text.lower()
        tokens = set(low.split())
        extra = [w for x in spaced(low) if lattice(x) for w in decode(x, self.lm)]
        if len(self.known) > CACHE:
            self.known = {}
        for t in tokens.difference(self.known):
            self.known[t] = restored(t, self.lm)
        return tokens, extra

    def words(self, text: str) -> set[str]:
        tokens, extra = self(text)
        return {w for t in tokens for w in self.known[t]}.union(extra)


def log_odds(pos: float, neg: float, rate: float) -> float:
    """How much likelier than the base rate a document with a word is toxic, in log odds."""
    return float(np.log((max(pos, 0) + PRIOR * rate) / (max(neg, 0) + PRIOR * (1 - rate))) - np.log(rate / (1 - rate)))


@dataclass
class ToxicityModel:
    lm: np.ndarray
    weights: dict[str, float]
    coef: np.ndarray  # of 1, the sum, the largest and the number of word weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))


class Scorer(Reader):
    def __init__(self, lm: np.ndarray, weights: dict[str, float]):
        super().__init__(lm)
        self.weights, self.hot, self.seen, self.longest = weights, {}, set(), max(map(len, weights), default=0)

    def features(self, text: str, weights: dict[str, float] | None = None) -> tuple[float, float, float, float]:
        """1, then the sum, the largest and the number of the text's words' weights; other weights for the same words may be given."""
        low = text.lower()
        tokens = set(low.split())
        if len(self.seen) > CACHE:
            self.hot, self.seen = {}, set()
        new = tokens.difference(self.seen)
        self.seen |= new
        for t in new:
            if hit := [w for w in restored(t, self.lm, self.longest) if w in self.weights]:
                self.hot[t] = hit
        found = {w for t in tokens.intersection(self.hot) for w in self.hot[t]}
        found.update(w for x in spaced(low) if lattice(x) for w in decode(x, self.lm) if w in self.weights)
        ws = sorted((weights or self.weights)[w] for w in found)
        return 1.0, sum(ws), ws[-1] if ws else 0.0, float(len(ws))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    coef = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * coef)
        coef += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return coef


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fits on the labelled documents outside the held-out fold, at most max_labelled, chosen by a hash of the id.

    Of repeated labels of an id the largest counts; null ids and labels are left out. Without both classes, or without telling words, the score is a constant."""
    spark = docs.sparkSession
    small_batches(spark)
    lm = character_model(docs)
    known = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull() & ~held_out(labels["doc_id"])).groupBy(labels["doc_id"].alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    train = docs.select(F.col("doc_id").alias("_id"), text_of(docs).alias("text")).join(F.broadcast(sample), "_id")  # at most max_labelled rows of two numbers
    model = spark.sparkContext.broadcast(lm)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                seen[y > 0].update(reader.words(text))
                seen[y > 0][""] += 1
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "neg": pa.array([seen[0][w] for w in words], pa.int64()), "pos": pa.array([seen[1][w] for w in words], pa.int64())})

    counts = train.mapInArrow(tally, "word string, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where((F.col("pos") >= MIN_DOCS) | (F.col("word") == "")).persist()
    totals = counts.where("word = ''").first()
    n_neg, n_pos = (totals.neg, totals.pos) if totals else (0, 0)
    weights: dict[str, float] = {}
    coef = np.array([np.log((n_pos + 0.5) / (n_neg + 0.5)) if totals else -5.0, 0.0, 0.0, 0.0])
    if n_pos and n_neg:
        rate = n_pos / (n_pos + n_neg)
        odds = F.log((F.col("pos") + PRIOR * rate) / (F.col("neg") + PRIOR * (1 - rate))) - float(np.log(rate / (1 - rate)))
        telling = counts.where((F.col("word") != "") & (F.col("pos") >= MIN_SHARE * n_pos)).select("word", "pos", "neg", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), "word").limit(MAX_WORDS)
        rows = telling.collect()
        weights = {r.word: r.odds for r in rows}
        less = [{r.word: log_odds(r.pos - (y == 1), r.neg - (y == 0), rate) for r in rows} for y in (0, 1)]  # without one clean or toxic document
    counts.unpersist()
    if weights:
        told = spark.sparkContext.broadcast((lm, weights, less))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lm, weights, less = told.value
            scorer = Scorer(lm, weights)
            for batch in batches:
                x = np.array([scorer.features(t, less[y > 0]) for t, y in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True)]).reshape(-1, 4)
                yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "toxic": batch.column("_toxic"), **{f"x{k}": x[:, k] for k in range(1, 4)}})

        rows = train.mapInArrow(features, f"_id {dict(train.dtypes)['_id']}, toxic int, x1 double, x2 double, x3 double").dropDuplicates(["_id"]).drop("_id").toPandas()  # one row for each label
        x = np.column_stack([np.ones(len(rows)), rows[["x1", "x2", "x3"]].to_numpy()])
        coef = fit_logistic(x, (rows["toxic"] > 0).to_numpy(float))
    return ToxicityModel(lm, weights, coef)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted. Null texts score as empty ones; every row is scored by itself.

    Columns of these three names are replaced; others are kept. An empty table gives an empty table."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = told.value
        scorer = Scorer(m.lm, m.weights)
        for texts in batches:
            yield pd.Series(m.score(np.array([scorer.features(t) for t in texts]).reshape(-1, 4)))

    rest = [docs[c] for c in docs.columns if c not in ("held_out", "score", "predicted")]
    df = docs.select(*rest, held_out(docs["doc_id"]).alias("held_out"), score(text_of(docs)).alias("score"))
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels"))).drop("text")
