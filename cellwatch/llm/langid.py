"""Language identification by n-gram filters with one bit per language.

Training counts each language's character n-grams (3 characters, letters in lower
case, everything else a boundary) over all labelled texts.  A language's filter holds
its n-grams that make up at least ``LEAST_SHARE`` of its n-grams and are not ``RIVAL``
times rarer than in the language where they are most frequent.  The filters of ``GROUP`` languages
share one bit-sliced Bloom filter: a row of it is a bitmask of languages, and the AND of an
n-gram's rows gives every language that contains it at once.  Each group's filter is as
long as its own languages ask for, so any number of languages takes no more than their n-grams do.

A text's n-grams are looked up, bits are counted per language, and the count is
corrected for the filter's false positives: of ``n`` n-grams ``t`` in a language's
filter, ``t + (n - t) * f`` bits are expected at a false positive rate ``f``.  The
language with the largest corrected count decides; the score is its part of all
languages' corrected counts.

What reaches the driver: a language has at most ``1 / LEAST_SHARE`` n-grams in its filter, so the
model grows with the number of languages and not with the texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text
none of whose n-grams is known gets the language with most training n-grams and score 0, as
does, by the order of names, a tie of counts; without training rows every text is ``und``;
a null lang or doc_id is never learned from, and a null doc_id is not held out.  Rows that
repeat are learned from and judged each by itself; texts are read whole, whatever their length;
columns other than doc_id, text and lang are not looked at and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from cellwatch.llm.shared import giving_back, mixed, random_words, slices, stored

LEAST_SHARE = 1e-5
RIVAL = 10.0
GROUP = 64
#: Part of a text's n-grams that must be found in its language for the language to count as known.
LEAST_FOUND = 0.25
#: Rows of the filter for each n-gram in it, and rows set by an n-gram.
ROWS_EACH = 16
HASHES = 3
#: Distinct (language, n-gram) pairs that a worker adds up before it emits them.
HELD = 1 << 20
UNKNOWN = "und"

_FACTORS = random_words("gram", 3)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the bounds of each text's, and whether a text has a letter."""
    lowered = [(t or "").lower() for t in texts]
    joined = np.frombuffer(("\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in lowered]) if lowered else np.zeros(0, np.int64)
    is_letter = letters()[joined]
    codes = np.where(is_letter, joined, 0).astype(np.uint64)
    hashes = mixed(codes[:-2] * _FACTORS[0] + codes[1:-1] * _FACTORS[1] + codes[2:] * _FACTORS[2])
    middle = np.flatnonzero(is_letter[1:-1])  # position of the middle character, less one
    # Text i has the characters from ends[i-1] + 1 on; the middle one decides to which text an n-gram belongs.
    bounds = np.searchsorted(middle, np.concatenate([np.zeros(1, np.int64), ends]))
    return hashes[middle], bounds, np.diff(bounds) > 0


def bucket(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _gram_counts(training: DataFrame, names: list[str]) -> DataFrame:
    """``(lang int, gram long, n long)`` over all training texts."""
    number = {name: i for i, name in enumerate(names)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            hashes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            return hashes[first], np.add.reduceat(counts, first)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                hashes, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hashes), lang, np.int32)), pa.array(hashes.view(np.int64)), pa.array(counts)],
                    ["lang", "gram", "n"])
            held.clear()

        for batch in (part for whole in batches for part in slices(whole, "text")):
            hashes, bounds, _ = grams(batch.column("text").to_pylist())
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for lang in np.unique(langs):
                own = np.sort(np.concatenate([hashes[bounds[i]:bounds[i + 1]] for i in np.flatnonzero(langs == lang)]))
                if not len(own):
                    continue
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                parts = held.setdefault(int(lang), [])
                parts.append((own[first], np.diff(np.append(first, len(own)))))
                size += len(first)
                if len(parts) >= 16:
                    size -= sum(len(p[0]) for p in parts)
                    parts[:] = [merged(parts)]
                    size += len(parts[0][0])
            if size > HELD:
                yield from flush()
                size = 0
        yield from flush()

    counted = training.select("lang", "text").mapInArrow(giving_back(work), "lang int, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages, each group's filter (a row a word of bits), false positive rates and training sizes."""

    languages: list[str]
    filters: list[np.ndarray]
    rates: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def places(rows: int, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = mixed(hashes) | np.uint64(1)
        for i in range(HASHES):
            yield ((hashes + np.uint64(i) * step) % np.uint64(rows)).astype(np.int64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the words of its language bits, one for each group."""
        out = np.empty((len(hashes), len(self.filters)), np.uint64)
        for group, rows in enumerate(self.filters):
            found = None
            for place in self.places(len(rows), hashes):
                found = rows[place] if found is None else found & rows[place]
            out[:, group] = found
        return out

    def corrected(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text and language how many of the text's n-grams are in its filter, less the false positives expected."""
        totals = np.diff(bounds).astype(np.float64)
        out = np.zeros((len(totals), len(self.languages)))
        if not self.languages or not len(hashes):
            return out
        found = self.masks(hashes)
        for i in range(len(self.languages)):
            bits = (found[:, i // GROUP] >> np.uint64(i % GROUP)) & np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(bits, dtype=np.int64)])
            hits = (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float64)
            out[:, i] = np.maximum(0.0, (hits - totals * self.rates[i]) / (1.0 - self.rates[i]))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the part of the text's n-grams that are found in the language."""
        hashes, bounds, has_letter = grams(texts)
        corrected = self.corrected(hashes, bounds)
        whole, most = corrected.sum(axis=1), corrected.max(axis=1, initial=0.0)
        best = np.argmax(corrected, axis=1) if self.languages else np.zeros(len(texts), np.int64)
        if self.languages:
            best = np.where(whole > 0, best, int(np.argmax(self.sizes)))
        score = np.where(whole > 0, most / np.where(whole > 0, whole, 1.0), 0.0)
        known = has_letter & bool(self.languages)
        part = np.where(known, most / np.maximum(np.diff(bounds), 1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0), part


def train(training: DataFrame) -> Model:
    """A model of ``text`` and non-null ``lang``."""
    training = training.where("lang is not null and text is not null")
    names = sorted(r[0] for r in training.select("lang").distinct().collect())
    if not names:
        return Model([], [], np.zeros(0), np.zeros(0))
    counts = stored(_gram_counts(training, names), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("size"))
    sizes = {r["lang"]: r["size"] for r in totals.collect()}
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("size")).where(F.col("share") >= LEAST_SHARE)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").where(F.col("share") * RIVAL >= F.col("most")).select("lang", "gram").toPandas()
    lang, gram = kept["lang"].to_numpy(np.int64), kept["gram"].to_numpy(np.int64).view(np.uint64)
    model = Model(names, [], np.zeros(len(names)), np.array([float(sizes.get(i, 0)) for i in range(len(names))]))
    for first in range(0, len(names), GROUP):
        here = lang // GROUP == first // GROUP
        rows = np.zeros(max(64, ROWS_EACH * len(np.unique(gram[here]))), np.uint64)
        for place in model.places(len(rows), gram[here]):
            np.bitwise_or.at(rows, place, np.uint64(1) << (lang[here] % GROUP).astype(np.uint64))
        model.filters.append(rows)
        for i in range(first, min(first + GROUP, len(names))):
            filled = ((rows >> np.uint64(i % GROUP)) & np.uint64(1)).mean()
            model.rates[i] = filled ** HASHES
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            names, score, _ = shared.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score)], schema.names)

    return docs.mapInArrow(giving_back(work), schema)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text is in a known language, with their columns as they are.

    A language is known if at least ``LEAST_FOUND`` of the text's n-grams, beyond what false positives
    explain, are in its filter.  Texts without such a language go, whether they have letters or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            _, _, part = shared.value.predict(batch.column(text).to_pylist())
            yield batch.filter(pa.array(part >= LEAST_FOUND))

    return docs.mapInArrow(giving_back(work), docs.schema)


FOLDS, HELD_OUT = 4, 2


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(bucket(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(F.col("doc_id").isNotNull() & ~is_held_out()))


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` with a model of the rows that aren't held out."""
    model = train_on_documents(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
