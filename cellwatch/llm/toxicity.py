"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Training.  Labels say which documents are toxic, not which words.  Features of a token
are its word (a run of letters and digits) and the word's first 4, 5 and 6 bytes.
Features that occur in far more toxic than clean training documents label tokens:
a token with one in a toxic document is toxic, every other token is not.  A chain
with two states is fitted to these tokens: a weight per known feature, a bias and a
transition table, by gradient steps on the log-likelihood.  A logistic model of the
chain's marginals (largest one, expected number of toxic tokens, that number per
token) gives the document's score; it is weighted so that it holds for the labels' true
proportion.  Both are fitted to a bounded sample: ``FIT_ROWS`` labelled documents a
class at most, those with the smallest hash of their id, with ``FIT_BYTES`` of text, and one
text of an id that several rows have; the chain to windows around ``FIT_TOKENS`` toxic tokens
and as many others.

Scoring runs the forward and backward passes over whole texts, all texts of a slice
side by side.  Tokens whose marginal reaches 1/2 are the offending ones; runs of them
are spans, with offsets in code points.

Defined results: null and empty texts score what a text without tokens scores; a
repeated row scores alike; without labelled rows of both classes every score is the
known share of toxic labels (0 without any); several labels of a document count as toxic if one is;
a null doc_id is never learned from and is not held out.  Other columns are not looked at; the
stage that drops documents keeps them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from cellwatch.llm.shared import Words, giving_back, mixed, random_words, slices

FIT_ROWS = 1500
#: Bytes of a class's texts in the sample; a text that would go beyond is passed over.
FIT_BYTES = 32 << 20
#: The chain is fitted to windows around this many toxic tokens, and as many others, at most.
FIT_TOKENS = 4000
#: A feature that so many tokens of the sample have is known for contrast, even if it labels none.
FREQUENT = 50
PREFIXES = (4, 5, 6)
#: A feature labels tokens if this many toxic documents have it, and if it is so many times as frequent in them.
LEAST_DOCUMENTS = 5
LEAST_PART = 0.004  # or this part of them, if that is more
LEAST_RATIO = 20.0
#: Training windows have this many tokens.
WINDOW = 24
STEPS = 150
FOLDS, HELD_OUT = 5, 0


def tokens(column: pa.Array) -> Words:
    """Runs of letters, digits and bytes of other characters, lower-cased in ASCII and Latin-1."""
    return Words(column, kind="alphanumeric")


def token_features(found: Words) -> np.ndarray:
    """A row of hashes for each kind of feature; 0 where a token has none of the kind."""
    return np.stack([found.hashes, *[found.prefixes(n) for n in PREFIXES]])


@dataclass
class Model:
    """Known features (sorted hashes) with their weights, the chain's other weights and the document model."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))
    intercept: float = -np.inf

    def __post_init__(self):
        self.known = np.zeros(1 << 22, bool)  # a first sieve, by the low bits of hashes
        self.known[(self.words & np.uint64(0x3FFFFF)).astype(np.int64)] = True

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Weight of state 1 over state 0 per token."""
        out = np.full(features.shape[1], self.bias)
        for hashes in features if len(self.words) else ():
            maybe = np.flatnonzero(self.known[(hashes & np.uint64(0x3FFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            out[maybe] += np.where(self.words[at] == hashes[maybe], self.weights[at], 0.0)
        return out

    def document_score(self, features: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(features @ self.document + self.intercept)))


def marginals(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each token; chain ``i`` has the tokens from ``bounds[i]`` to ``bounds[i + 1]``.

    Forward and backward messages are ratios of the two states' values, so they need no
    scaling; chains are ordered by length and advance together.
    """
    t = np.exp(transitions - transitions[0, 0])
    ratio = np.exp(np.clip(emissions, -500, 500))
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = bounds[:-1][order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    # active[s]: chains with more than s tokens
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    forward, backward = np.empty(len(ratio)), np.empty(len(ratio))
    state = np.empty(0)
    for s in range(longest):
        at = starts[:active[s]] + s
        if s == 0:
            state = ratio[at]
        else:
            state = state[:active[s]]
            state = ratio[at] * (t[0, 1] + t[1, 1] * state) / (t[0, 0] + t[1, 0] * state)
        np.clip(state, 1e-200, 1e200, out=state)
        forward[at] = state
    state = np.ones(len(sizes))
    for s in range(longest):  # from each chain's end
        at = starts[:active[s]] + sizes[:active[s]] - 1 - s
        state = state[:active[s]]
        if s:
            ahead = ratio[at + 1] * state
            state = (t[1, 0] + t[1, 1] * ahead) / (t[0, 0] + t[0, 1] * ahead)
        backward[at] = state
    odds = forward * backward
    return odds / (1.0 + odds)


def document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: largest marginal, logarithm of one plus the expected number, its square root per token."""
    sums = np.concatenate([np.zeros(1), np.cumsum(p)])
    expected = np.maximum(0.0, sums[bounds[1:]] - sums[bounds[:-1]])
    lengths = np.diff(bounds)
    most = np.zeros(len(lengths))
    filled = np.flatnonzero(lengths > 0)
    if len(filled):
        most[filled] = np.maximum.reduceat(p, bounds[:-1][filled])
    return np.stack([most, np.log1p(expected), np.sqrt(expected / np.maximum(1, lengths))], axis=1)


def _marks(words: np.ndarray, seeds: np.ndarray, runs: int = 3) -> list[tuple[int, int]]:
    """The smallest hashes of a text's word runs, one for each seed."""
    if not len(words):
        return [(-1, 0)] * len(seeds)
    size = max(1, len(words) - runs + 1)
    joined = words[:size].copy()
    for k in range(1, min(runs, len(words))):
        joined += words[k:k + size] * seeds[k]
    return [(k, int(mixed(joined ^ seed).min())) for k, seed in enumerate(seeds)]


def _sample_features(rows: pa.Table, minima: int = 8, alike: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token features, bounds and labels of the sample's texts, without copies.

    Of copies and near copies (``alike`` of ``minima`` marks agree) the first counts, or all
    their words would look telling.
    """
    seen: dict[tuple[int, int], list[int]] = {}
    seeds = random_words("alike", minima)
    features, lengths, toxic = [], [], []
    for batch in (part for whole in rows.combine_chunks().to_batches() for part in slices(whole, "text")):
        found = tokens(batch.column("text"))
        own = token_features(found)
        for i, label in enumerate(batch.column("toxic").to_pylist()):
            low, high = int(found.bounds[i]), int(found.bounds[i + 1])
            marks = _marks(found.hashes[low:high], seeds)
            votes: dict[int, int] = {}
            for mark in marks:
                for earlier in seen.get(mark, ()):
                    votes[earlier] = votes.get(earlier, 0) + 1
            if max(votes.values(), default=0) >= alike:
                continue
            for mark in set(marks):
                seen.setdefault(mark, []).append(len(lengths))
            features.append(own[:, low:high].copy())  # a view would hold the slice's features
            lengths.append(high - low)
            toxic.append(label)
    joined = np.concatenate(features, axis=1) if features else np.zeros((1 + len(PREFIXES), 0), np.uint64)
    return joined, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), np.array(toxic, bool)


def _token_labels(features: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that label toxic tokens, and the tokens' labels."""
    docs = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    chosen = []
    for hashes in features:
        order = np.lexsort((docs, hashes))
        value, doc = hashes[order], docs[order]
        fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) & (value != 0)
        words, at = np.unique(value[fresh], return_inverse=True)
        is_toxic = toxic[doc[fresh]]
        bad = np.bincount(at, weights=is_toxic, minlength=len(words))
        good = np.bincount(at, weights=~is_toxic, minlength=len(words))
        ratio = (bad / toxic.sum()) / ((good + 0.5) / (~toxic).sum())
        # The square roots bound what chance does to small counts.
        sure = (bad >= max(LEAST_DOCUMENTS, LEAST_PART * toxic.sum())) & (ratio >= LEAST_RATIO) & (bad - 3 * np.sqrt(bad) > 3 * np.sqrt(good + 1))
        chosen.append(words[sure])
    telling = np.unique(np.concatenate(chosen))
    # Kind by kind: what numpy's isin needs for all of them at once is many times their size.
    found = np.zeros(features.shape[1], bool)
    for hashes in features if len(telling) else ():
        found |= telling[np.minimum(np.searchsorted(telling, hashes), len(telling) - 1)] == hashes
    return telling, found & toxic[docs]


def _fit_chain(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by gradient steps on windows around toxic tokens and as many from elsewhere."""
    where = np.flatnonzero(labels)
    generator = np.random.default_rng(7)
    picked = np.concatenate([
        where if len(where) <= FIT_TOKENS else generator.choice(where, FIT_TOKENS, replace=False),
        generator.integers(0, features.shape[1], FIT_TOKENS)])
    docs = np.searchsorted(bounds, picked, side="right") - 1
    begin = np.maximum(bounds[docs], picked - WINDOW // 2)
    size = np.minimum(bounds[docs + 1], begin + WINDOW) - begin
    keep = size > 0
    begin, size = begin[keep], size[keep]
    index = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    chains = np.concatenate([[0], np.cumsum(size)])
    y = labels[index].astype(np.float64)
    own = features[:, index]
    place = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    known = vocabulary[place] == own
    token = np.broadcast_to(np.arange(len(index)), own.shape)[known]  # of each known feature, its token and its number
    place = place[known]
    inner = np.ones(len(index), bool)
    inner[chains[:-1]] = False  # tokens with one before them
    second = np.flatnonzero(inner)
    weights, bias, transitions = np.zeros(len(vocabulary)), 0.0, np.zeros((2, 2))
    seen = np.bincount(place, minlength=len(vocabulary)) + 1.0
    speed: dict[str, np.ndarray] = {"w": np.zeros(len(vocabulary)), "b": np.zeros(1), "t": np.zeros((2, 2))}

    def step(name: str, gradient: np.ndarray) -> np.ndarray:
        speed[name] = speed[name] + gradient ** 2
        return 0.5 * gradient / np.sqrt(speed[name] + 1e-8)

    empirical = np.zeros((2, 2))
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        empirical[a, b] = np.mean((y[second - 1] == a) & (y[second] == b)) if len(second) else 0.25
    for _ in range(STEPS):
        e = bias + np.bincount(token, weights=weights[place], minlength=len(index))
        p = marginals(e, chains, transitions)
        # Expected pairs: the product of what holds left and right of the border, by messages.
        pair = _pair_marginals(e, chains, transitions, second)
        weights += step("w", np.bincount(place, weights=(y - p)[token], minlength=len(vocabulary)) / seen - 0.01 * weights)
        bias += float(step("b", np.array([np.mean(y - p) - 0.001 * bias]))[0])
        transitions = transitions + step("t", empirical - pair - 0.001 * transitions)
    return weights, bias, transitions


def _pair_marginals(e: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Mean probability of each pair of states over the tokens ``second`` and those before them.

    With one token's state fixed the two sides part, so fixing it by a large emission
    would do; this gets the same from the marginals of the chain and the local odds.
    """
    if not len(second):
        return np.full((2, 2), 0.25)
    t = np.exp(transitions - transitions[0, 0])
    p = marginals(e, bounds, transitions)
    left, right = np.clip(p[second - 1], 1e-12, 1 - 1e-12), np.clip(p[second], 1e-12, 1 - 1e-12)
    # The pair's table has these margins and the odds ratio of the transition table, which fixes it.
    odds = t[0, 0] * t[1, 1] / (t[0, 1] * t[1, 0])
    if abs(odds - 1.0) < 1e-9:
        both = left * right
    else:
        s = 1.0 + (left + right) * (odds - 1.0)
        both = (s - np.sqrt(np.maximum(0.0, s * s - 4.0 * odds * (odds - 1.0) * left * right))) / (2.0 * (odds - 1.0))
    return np.array([[np.mean(1 - left - right + both), np.mean(right - both)], [np.mean(left - both), np.mean(both)]])


def _fit_documents(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (toxic - p)) - 0.1 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        change = np.linalg.solve(hessian, gradient)
        w = w + change
        if np.abs(change).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labelled documents that aren't held out (``doc_id``, ``text``; ``doc_id``, ``toxic``)."""
    labelled = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
        .where(~is_held_out())
    )
    share = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(share) < 2:
        return Model(intercept=np.inf if True in share else -np.inf)
    order = F.md5(F.concat(F.lit("fit/"), F.col("doc_id").cast("string")))
    sample = [labelled.where(F.col("toxic") == F.lit(c)).orderBy(order).limit(FIT_ROWS) for c in (False, True)]
    ids = sample[0].unionByName(sample[1])  # at most twice FIT_ROWS rows, so their size is bounded
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    # Of an id that several rows have, one text; its size first, so that only texts within the bound come.
    one = F.struct(F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("hash"))
    sizes = found.groupBy("doc_id", "toxic").agg(F.min(one).alias("one")).select("doc_id", "toxic", "one.size", "one.hash").collect()
    kept, held = [], {False: 0, True: 0}
    for row in sorted(sizes, key=lambda r: hashlib.md5(f"fit/{r['doc_id']}".encode()).digest()):
        if held[row["toxic"]] + row["size"] <= FIT_BYTES:
            held[row["toxic"]] += row["size"]
            kept.append((row["doc_id"], row["hash"]))
    wanted = docs.sparkSession.createDataFrame(kept, "doc_id long, hash long")
    rows = (
        found.withColumn("hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "hash"])
        .dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toArrow())
    seen, bounds, toxic = _sample_features(rows)
    if toxic.all() or not toxic.any() or not seen.shape[1]:
        whole = share[True] / (share[True] + share[False])
        return Model(intercept=float(np.log(whole / (1 - whole))))
    chosen, token_labels = _token_labels(seen, bounds, toxic)
    # Known features: those that label tokens, and, as contrast, frequent ones.
    frequent = []
    for kind in seen:
        words, counts = np.unique(kind, return_counts=True)
        frequent.append(words[(counts >= FREQUENT) & (words != 0)])
    vocabulary = np.union1d(chosen, np.concatenate(frequent))
    model = Model()
    if len(vocabulary):
        weights, bias, transitions = _fit_chain(seen, bounds, token_labels, vocabulary)
        model = Model(vocabulary, weights, bias, transitions)
    features = document_features(marginals(model.emissions(seen), bounds, model.transitions), bounds)
    weight = np.where(toxic, share[True] / toxic.sum(), share[False] / (~toxic).sum())
    model.document, model.intercept = _fit_documents(features, toxic.astype(np.float64), weight / weight.mean())
    return model


_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("probability", DoubleType())])
_ADDED = StructType([
    StructField("score", DoubleType()), StructField("predicted", IntegerType()),
    StructField("n_tokens", LongType()), StructField("n_toxic", LongType()), StructField("spans", ArrayType(_SPAN))])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score, predicted, n_tokens, n_toxic, spans``; columns of these names are replaced."""
    docs = docs.drop(*_ADDED.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, *_ADDED.fields])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for whole in batches for part in slices(whole, text)):
            found = tokens(batch.column(text))
            p = marginals(model.emissions(token_features(found)), found.bounds, model.transitions)
            value = model.document_score(document_features(p, found.bounds))
            spans: list[list[dict]] = [[] for _ in range(len(found))]
            bad = np.flatnonzero(p >= 0.5)
            docs_of = np.searchsorted(found.bounds, bad, side="right") - 1
            characters = np.concatenate([np.zeros(1, np.int64), np.cumsum((found.data & 0xC0) != 0x80)])
            last, last_doc = -2, -1
            for token, doc in zip(bad.tolist(), docs_of.tolist()):
                base = characters[found.offsets[doc]]
                start, end = int(characters[found.starts[token]] - base), int(characters[found.ends[token]] - base)
                if doc == last_doc and token == last + 1:
                    spans[doc][-1]["end"] = end
                    spans[doc][-1]["probability"] = max(spans[doc][-1]["probability"], float(p[token]))
                else:
                    spans[doc].append({"start": start, "end": end, "probability": float(p[token])})
                last, last_doc = token, doc
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(np.diff(found.bounds)),
                pa.array(np.bincount(docs_of, minlength=len(found)).astype(np.int64)), pa.array(spans, span_type)], schema.names)

    return docs.mapInArrow(giving_back(work), schema)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for whole in batches for part in slices(whole, text)):
            found = tokens(batch.column(text))
            p = marginals(model.emissions(token_features(found)), found.bounds, model.transitions)
            yield batch.filter(pa.array(model.document_score(document_features(p, found.bounds)) < 0.5))

    return docs.mapInArrow(giving_back(work), docs.schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the spans, with a model of labels that aren't held out."""
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", is_held_out().alias("held_out"), "score", "predicted", "n_tokens", "n_toxic", "spans")
