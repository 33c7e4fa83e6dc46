"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each of its slots is a bit mask over the languages, so the
conjunction of an n-gram's few slots gives at once every language that (apart from false
positives) contains the n-gram. A document's n-grams are looked up together; per language the set
bits are counted, and the count is corrected by the language's false-positive rate, which follows
from how full its slice of the filter is. The language with the largest corrected share decides;
that share is the score.

A language "contains" an n-gram that makes up at least ``min_share`` of the n-grams of its training
texts, which bounds a language to 1 / min_share n-grams whatever the size of the corpus. The filter
is fit on a bounded sample: about ``sample_per_language`` documents of each language, chosen by a
hash. Predictions read text alone.

The share keeps out n-grams that a language's texts have by chance (names, foreign words): a filter
of them would contain the other languages too.

Defined results: texts of any length are read whole; rows that repeat are told each, and without
documents there are no rows; a null text or one without a letter is ``und`` with score 0; so is everything when
there is no labelled text. A text in a script that no language contains gets the first language and
score 0. Ties go to the language that sorts first. A null doc_id hashes as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UND = "und"
ORDERS = (2, 3, 4)
HASHES = 3


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Letters:
    """Code points of a text as words of lower-case letters with single spaces around them."""

    def __init__(self) -> None:
        self.is_letter = _letters()

    def __call__(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        c = np.where(self.is_letter[c], c, 32)
        c = np.concatenate([[32], c, [32]]).astype(np.uint64)
        return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def ngram_hashes(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams with letters inside; a space may stand at either end."""
    out = []
    letter = c != 32
    for n in ORDERS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        keep = np.ones(m, bool) if n > 2 else letter[:m] | letter[1:]
        for k in range(1, n - 1):
            keep &= letter[k : k + m]
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = h[keep] * np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(ch.isalpha() for ch in text)


class BitmaskFilter:
    """Bit-sliced Bloom filter over languages. masks: slots x words of 64 languages each."""

    def __init__(self, languages: list[str], slot_bits: int = 18) -> None:
        self.languages, self.slot_bits = languages, slot_bits
        self.masks = np.zeros((max(1, -(-len(languages) // 8)), 1 << slot_bits), np.uint8)
        self.false_rate = np.zeros(len(languages))

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield (h >> np.uint64(k * 21)) & np.uint64((1 << self.slot_bits) - 1)

    def add(self, language: int, h: np.ndarray) -> None:
        for at in self.slots(h):
            self.masks[language // 8, at] |= np.uint8(1 << language % 8)

    def seal(self) -> BitmaskFilter:
        for k in range(len(self.languages)):
            self.false_rate[k] = float((self.masks[k // 8] >> (k % 8) & 1).mean()) ** HASHES
        return self

    def shares(self, h: np.ndarray) -> np.ndarray:
        """Per language the share of n-grams it contains, corrected for false positives."""
        hits = np.zeros(len(self.languages))
        if not len(h):
            return hits
        at = list(self.slots(h))
        for w, masks in enumerate(self.masks):
            both = masks[at[0]]
            for x in at[1:]:
                both &= masks[x]
            by_mask = np.bincount(both, minlength=256)
            for k in range(w * 8, min(w * 8 + 8, len(self.languages))):
                hits[k] = by_mask[(np.arange(256) >> (k % 8) & 1) == 1].sum()
        return np.clip((hits / len(h) - self.false_rate) / (1 - self.false_rate), 0, 1)


def train(docs: DataFrame, sample_per_language: int = 2000, min_share: float = 2e-5) -> BitmaskFilter:
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    made = BitmaskFilter(sorted(counts))
    if not counts:
        return made.seal()
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_language / n))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rate[F.col("lang")] * float(1 << 30))
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                by_lang.setdefault(lang, []).append(ngram_hashes(letters(text)))
            for lang, parts in by_lang.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield from common.batches(schema, [pa.array([lang] * len(h), pa.string()), h.view(np.int64), n])

    grams = common.checkpoint(sample.mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in grams.groupBy("lang").agg(F.sum("n")).collect()}
    if totals:
        least = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n) * min_share)])
        found = grams.where(F.col("n") >= least[F.col("lang")]).select("lang", "h").toPandas()
        for lang, part in found.groupby("lang"):
            made.add(made.languages.index(lang), part["h"].to_numpy().view(np.uint64))
    return made.seal()


def predict(docs: DataFrame, filters: BitmaskFilter, *keep: str) -> DataFrame:
    """keep..., lang_pred, score for every row of docs. The names kept must not be among these."""
    held = docs.select(*keep, F.col("text").cast("string").alias("tm_text"))
    kind = held.select(*keep).schema

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = Letters(), filters  # fixed slots, one bit per language; Spark broadcasts large closures
        for batch in batches:
            lang, score = [], []
            for text in batch["tm_text"].to_pylist():
                if not known.languages or not has_letter(text):
                    lang.append(UND), score.append(0.0)
                    continue
                share = known.shares(ngram_hashes(letters(text)))
                best = int(share.argmax())
                lang.append(known.languages[best]), score.append(float(share[best]))
            kept = batch.drop_columns(["tm_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept.schema.names, "lang_pred", "score"])

    for name, of in (("lang_pred", "string"), ("score", "double")):
        kind = kind.add(name, of)
    return held.mapInArrow(run, kind)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the folds that are not held out."""
    rows = docs.withColumn("tm_out", common.fold("doc_id", 3) == 1)
    filters = train(rows.where(~F.col("tm_out")))
    named = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tm_out").alias("held_out"), "text")
    return predict(named, filters, "doc_id", "held_out")


def known_language(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Rows of docs whose language is told; those without a letter, or of whose n-grams no learnt
    language contains min_score, go. The columns stay as they are."""
    filters = train(docs.where(common.fold("doc_id", 3) != 1))
    rows = docs.select(common.row_of(docs).alias("tm_row"), "text")
    told = predict(rows, filters, "tm_row").where((F.col("lang_pred") != UND) & (F.col("score") >= min_score))
    return told.select(*[F.col("tm_row").getField(c).alias(c) for c in docs.columns])
