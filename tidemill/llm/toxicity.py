"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts. An expression is a word; its count c in a class
is the number of the class's distinct texts that hold it, so that one long text or its copies do
not shout. With N the sum of a class's counts and T its number of expressions::

    P(w | class) = max(c(w) - D, 0) / N + D * T / N * S(w)

D is the class's discount by counts of counts, n1 / (n1 + 2 n2). S is shared by both classes: the
continuation counts of both together (of how many distinct words w is the successor), plus a half
for every expression and one for all unknown ones. Each P sums to 1.

A text is compared by the log-likelihood difference of its whole length, divided by its number of
words (plus ``prior_words``, so that one word does not decide a text of three). Chance makes
expressions differ that do not, and a class with more texts of one language favours all its words.
So a difference counts by what goes beyond ``errors`` standard errors of it, or beyond
``least_difference`` where that is more; with more labelled texts the errors shrink and rarer
expressions speak. These three were chosen by two folds inside the training part (crc32 mod 3 in
{0, 2}); held-out texts were not looked at.

The score is the share of toxic texts at a difference: a non-decreasing function (isotonic
regression, interpolated), fit on differences of training texts under models that leave out their
own fold of four.

The models are fit on a bounded sample of distinct labelled texts: about ``toxic_sample`` and
``ordinary_sample``, chosen by a hash of the ids. Only expressions that speak leave the executors;
they are bounded by the sample, not by the corpus. Scores read text alone.

Defined results: null and wordless texts have difference 0 and the score of that; a text of any
length is read whole; rows without a label are scored but not learnt from; equal texts of one class
count once and a text labelled both ways counts in both; when a class has no sample every score is
0; null doc_ids hash as the empty text and find no label; a document labelled twice counts as toxic
if one label says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_WORD = re.compile(r"[^\W_]+")

#: Folds that calibrate the score; model number FOLDS is of all of them.
FOLDS = 4
ALL = FOLDS


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """What is left to look up: by model number, the expressions that speak and what they say."""

    says: list[dict[str, float]]
    prior_words: float = 30.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def difference(self, text: str | None, model: int = ALL) -> float:
        ws, says = words(text), self.says[model]
        return sum(says.get(w, 0.0) for w in ws) / (len(ws) + self.prior_words)

    def score(self, text: str | None) -> float:
        if not len(self.steps):
            return 0.0
        return float(np.interp(self.difference(text), self.steps, self.values))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y, as the middles of its steps and their values."""
    blocks: list[list[float]] = []
    at, inverse = np.unique(x, return_inverse=True)
    value, n = np.bincount(inverse, y * weight), np.bincount(inverse, weight)
    for k in range(len(at)):
        blocks.append([at[k] * n[k], value[k], n[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def with_text(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The marks of documents to learn from."""
    return common.checkpoint(marks.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi"))


_HELD = pa.schema([("h", pa.int64()), ("word", pa.string()), ("toxic", pa.int64()), ("fold", pa.int64()), ("n", pa.int64())])
_AFTER = pa.schema([("h", pa.int64()), ("before", pa.int64()), ("folds", pa.int64())])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch hold each word, by class and fold."""
    for batch in batches:
        held = Counter()
        for text, toxic, fold in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["fold"].to_pylist()):
            held.update((w, toxic, fold) for w in set(words(text)))
        if held:
            w, toxic, fold = zip(*held)
            yield from common.batches(_HELD, [[*map(common.word_hash, w)], w, toxic, fold, list(held.values())])


def _after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of words of a batch, with a bit for each fold that has them."""
    for batch in batches:
        folds: dict[tuple, int] = {}
        for text, fold in zip(batch["text"].to_pylist(), batch["fold"].to_pylist()):
            ws = words(text)
            for pair in set(zip(ws[1:], ws)):
                folds[pair] = folds.get(pair, 0) | 1 << fold
        if folds:
            w, before = zip(*folds)
            yield from common.batches(_AFTER, [[*map(common.word_hash, w)], [*map(common.word_hash, before)], list(folds.values())])


def counts(sample: DataFrame) -> DataFrame:
    """text, toxic, fold in; model, word, toxic and ordinary (texts that hold it) and continuation
    (distinct words before it) out, for the models that leave out one fold each and that of all."""
    of = lambda c, k: F.coalesce(F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == k), F.col("n"))), F.lit(0)).alias(f"c{c}{k}")
    held = sample.select("text", "toxic", "fold").mapInArrow(_held, "h long, word string, toxic long, fold long, n long")
    held = held.groupBy("h").agg(F.min("word").alias("word"), *[of(c, k) for c in (0, 1) for k in range(FOLDS)])
    pairs = sample.select("text", "fold").mapInArrow(_after, "h long, before long, folds long").groupBy("h", "before").agg(F.bit_or("folds").alias("folds"))
    every = (1 << FOLDS) - 1
    in_model = [F.count_if(F.col("folds").bitwiseAND(F.lit(every - (1 << m) if m < FOLDS else every)) != 0).alias(f"a{m}") for m in range(FOLDS + 1)]
    both = common.checkpoint(held.join(pairs.groupBy("h").agg(*in_model), "h", "left"))
    total = lambda c, m: reduce(Column.__add__, [F.col(f"c{c}{k}") for k in range(FOLDS) if k != m])
    each = [F.struct(F.lit(m).alias("model"), "word", total(1, m).alias("toxic"), total(0, m).alias("ordinary"), F.coalesce(f"a{m}", F.lit(0)).alias("continuation")) for m in range(FOLDS + 1)]
    return both.select(F.inline(F.array(*each))).where("toxic + ordinary > 0")


def probabilities(grams: DataFrame) -> DataFrame:
    """counts() with p_toxic and p_ordinary of each word, and n_toxic and n_ordinary, the sums of
    counts. A word of no row has the probabilities of a row with counts 0."""
    sums = []
    for c in ("toxic", "ordinary"):
        once, twice = F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2)
        sums += [F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"t_{c}"), F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5).alias(f"d_{c}")]
    total = grams.groupBy("model").agg(*sums, (F.sum("continuation") + (F.count("*") + 1) / 2).alias("all"))
    share = (F.col("continuation") + 0.5) / F.col("all")
    each = lambda c: F.greatest(F.col(c) - F.col(f"d_{c}"), F.lit(0.0)) / F.col(f"n_{c}") + F.col(f"d_{c}") * F.col(f"t_{c}") / F.col(f"n_{c}") * share
    # one row for each of the five models
    return grams.join(F.broadcast(total), "model").select(*grams.columns, "n_toxic", "n_ordinary", each("toxic").alias("p_toxic"), each("ordinary").alias("p_ordinary"))


def speaking(grams: DataFrame, errors: float, least_difference: float) -> DataFrame:
    """model, word, says: the words whose difference goes beyond its error and by how much."""
    difference = F.log(F.col("p_toxic") / F.col("p_ordinary"))
    error = F.sqrt(1 / (F.col("n_toxic") * F.col("p_toxic")) + 1 / (F.col("n_ordinary") * F.col("p_ordinary")))
    beyond = F.abs(difference) - F.greatest(F.lit(least_difference), errors * error)
    return probabilities(grams).where("n_toxic > 0 and n_ordinary > 0").where(beyond > 0).select("model", "word", (F.signum(difference) * beyond).alias("says"))


def train(docs: DataFrame, marks: DataFrame, toxic_sample: int = 3000, ordinary_sample: int = 6000, errors: float = 2.0, least_difference: float = 1.0, prior_words: float = 30.0) -> Model:
    """docs: doc_id, text to learn from; marks: doc_id, toxic (0 or 1). The sample is drawn from the
    ids alone and then joined to the texts, which are not shuffled but for the sample."""
    marks = with_text(docs, marks)
    counted = {int(r[0]): r[1] for r in marks.groupBy("toxic").count().collect()}
    none = Model([{}] * (FOLDS + 1), prior_words)
    if not counted.get(0) or not counted.get(1):
        return none
    bound = {0: ordinary_sample, 1: toxic_sample}
    share = F.when(F.col("toxic") == 1, min(1.0, bound[1] / counted[1])).otherwise(min(1.0, bound[0] / counted[0]))
    drawn = common.checkpoint(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30)))
    # the draw is near its bound unless a hash fails us: then the join shuffles
    few = drawn.count() <= 2 * (toxic_sample + ordinary_sample)
    texts = docs.where("text is not null").join(F.broadcast(drawn) if few else drawn, "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))
    sample = common.checkpoint(texts.dropDuplicates(["text", "toxic"]).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS))))
    held = {int(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}
    if not held.get(0) or not held.get(1):
        return none
    model = Model([{} for _ in range(FOLDS + 1)], prior_words)
    for k, word, says in speaking(counts(sample), errors, least_difference).collect():
        model.says[k][word] = says
    fit = _each(sample, model, ("toxic", "fold"), "difference", lambda m, row: m.difference(row["tm_text"], row["fold"])).select("difference", "toxic").toPandas()
    y = fit["toxic"].to_numpy(float)
    # each class counts as often as the labels have it
    model.steps, model.values = isotonic(fit["difference"].to_numpy(), y, np.where(y == 1, counted[1] / held[1], counted[0] / held[0]))
    return model


def _each(docs: DataFrame, model: Model, keep: tuple[str, ...], name: str, f) -> DataFrame:
    rows = docs.select(*keep, F.col("text").cast("string").alias("tm_text"))

    # the model travels in the closure: it grows with the sample, not with the corpus
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [f(model, row) for row in batch.to_pylist()]
            rest = batch.drop_columns(["tm_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.float64())], [*rest.schema.names, name])

    return rows.mapInArrow(run, rows.drop("tm_text").schema.add(name, "double"))


def scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    return _each(docs, model, keep, "score", lambda m, row: m.score(row["tm_text"]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    model = train(rows.where(~F.col("held_out")).select("doc_id", "text"), marks)
    return scores(rows, model, "doc_id", "held_out").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
