"""Context mixing against a bit-by-bit version, and the base against a word count."""

import math
import random
import re
import zlib
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellwatch.llm import contextmix as cm

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def line_of(text):
    return b"".join(w.encode() + b" " for w in words_of(text)) + b"\n"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute_counts(texts):
    counts = Counter()
    for text in texts:
        line = b"\n" * cm.LONGEST + line_of(text)
        for i in range(cm.LONGEST, len(line)):
            for order in cm.ORDERS:
                counts[line[i - order:i], line[i]] += 1
    return counts


def brute_code(line, counts, mixer, byte_at=None):
    """Natural logarithm of a line's probability, a bit at a time; with ``byte_at`` the probabilities of all bytes there."""
    padded = b"\n" * cm.LONGEST + line
    weights, right, tried = mixer.weights.astype(float).copy(), mixer.table.astype(float) * cm.PRIOR, np.full((8, cm.STEPS), cm.PRIOR)
    total = 0.0

    def bits(context, byte):
        for j in range(8):
            votes = []
            for order in cm.ORDERS:
                way = [sum(counts[context[-order:], y] for y in range(256) if y >> (8 - b) == byte >> (8 - b)) for b in (j, j + 1)]
                votes.append(math.log((way[1] + cm.SMALL) / (way[0] - way[1] + cm.SMALL)))
            seen = sum(counts[context, y] for y in range(256))
            s = sum(seen >= least for least in cm.LEVELS)
            z = max(-cm.STRONGEST, min(cm.STRONGEST, float(np.dot(weights[s, j], votes))))
            p = 1 / (1 + math.exp(-z))
            step = min(int(abs(z) / cm.STEP), cm.STEPS - 1) if z >= 0 else cm.STEPS - 1 - int(z / cm.STEP + cm.STEPS)
            share = min(max(right[j, step] / tried[j, step], cm.LEAST), 1 - cm.LEAST)
            yield j, s, np.array(votes), z, p, step, (p + (0.5 if z == 0 else share if z > 0 else 1 - share)) / 2

    for at in range(0, len(line), cm.CHUNK):
        change, came = np.zeros_like(weights), []
        for i in range(at, min(at + cm.CHUNK, len(line))):
            context = padded[i:i + cm.LONGEST]
            if i == byte_at:
                return [math.prod(b[-1] for b in bits(context, y)) for y in range(256)]
            for j, s, votes, z, p, step, mean in bits(context, line[i]):
                total += math.log(mean)
                change[s, j] += (1 - p) * votes
                came.append((j, step, z >= 0))
        weights += cm.RATE / math.sqrt(cm.CHUNK) * change
        for j, step, correct in came:
            tried[j, step] += 1
            right[j, step] += correct
    return total


def coded(texts, learned):
    """What the vectorized version says of ``texts``."""
    known, grams = cm.Coded(cm.lines(pa.array(learned, pa.string()))), cm.Coded(cm.lines(pa.array(texts, pa.string())))
    entries, counts = cm._summed(np.concatenate([cm.entries_of(known.grams, o) for o in cm.ORDERS]), np.ones(3 * len(known.grams), np.int64))
    distinct, _ = cm._distinct(grams.grams)
    seen, level = cm.votes(distinct, entries, counts)
    return cm.Places(distinct).find(grams.grams), grams.bounds, seen, level


def random_texts(seed, n, longest):
    r = random.Random(seed)
    return [" ".join(r.choice(["the", "THEn", "aß", "b", "日本", "zebra"]) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_lines():
    texts = ["A  bÉ\t\n", "", None, "x", " \x0b", "Q" * 3000, "no\x00pe \x85  "]
    got = cm.lines(pa.array(texts, pa.string())).to_pylist()
    assert got == [b"\n" * cm.LONGEST + line_of(t) for t in texts]
    grams = cm.Coded(cm.lines(pa.array(texts, pa.string())).slice(1, 4))
    assert np.diff(grams.bounds).tolist() == [len(line_of(t)) for t in texts[1:5]]
    assert grams.grams[0] == int.from_bytes(b"\n" * (cm.LONGEST + 1))


def test_equals_bit_by_bit():
    learned, texts = random_texts(1, 12, 60), [*random_texts(2, 5, 120), "", "quite unseen \x01", "the " * 200]
    rng = np.random.default_rng(3)
    start = cm.Mixer.initial()
    start.weights += rng.normal(0, 0.05, start.weights.shape).astype(np.float32)
    total, *_ = cm.code(*coded(texts, learned), start)
    counts = brute_counts(learned)
    for text, got in zip(texts, total):
        assert got == pytest.approx(brute_code(line_of(text), counts, start), rel=1e-3)


def test_probabilities_of_all_bytes_sum_to_one():
    learned, start = random_texts(4, 8, 40), cm.Mixer.initial()
    line, counts = line_of("the zebra then unseen\x01 b " * 12), brute_counts(learned)
    for at in (0, 3, 24, 260, len(line) - 1):
        assert sum(brute_code(line, counts, start, at)) == pytest.approx(1.0)


def test_a_text_scores_alike_beside_any_others():
    learned, texts = random_texts(5, 20, 60), random_texts(6, 90, 200)
    start = cm.fit(*coded(learned[:5], learned))
    alone = [cm.code(*coded([t], learned), start)[0][0] for t in texts[:6]]
    assert cm.code(*coded(texts, learned), start)[0][:6] == pytest.approx(alone, rel=1e-4)


def brute_base(rows):
    tokens = Counter()
    for doc_id, text in rows:
        if doc_id is not None and not held_out(doc_id):
            tokens.update([*words_of(text), "\n"])
    n, v = sum(tokens.values()), len(tokens)
    found = []
    for doc_id, text in rows:
        own = [*words_of(text), "\n"]
        found.append((doc_id, held_out(doc_id), len(own), sum(t in tokens for t in own), n,
                      sum(math.log10((tokens[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return found


def key(row):
    return tuple((x is not None, x) for x in row)


def check_rows(got, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(got, sorted(brute_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-12)


def test_scores_of_a_table(spark):
    r = random.Random(7)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    lexicon = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(300)]
    after = {w: r.sample(lexicon, 2) for w in lexicon}

    def prose(n):
        words = [r.choice(lexicon)]
        while len(words) < n:
            words.append(r.choice(after[words[-1]]))
        return " ".join(words).title()

    rows = [(i, prose(r.randint(1, 200))) for i in range(400)]
    passage = " ".join("".join(r.choice("qxzwvy") for _ in range(6)) for _ in range(60))
    known = [i for i in range(1000, 1100) if not held_out(i)][:5]
    fresh = [i for i in range(1100, 1300) if held_out(i)][:2]
    rows += [(i, passage) for i in known] + [(fresh[0], passage), (fresh[1], passage[::-1])]
    got = cm.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    check_rows(got, rows)
    by_id = {x["doc_id"]: x for x in got}
    unseen = [x for x in got if x["held_out"] and x["doc_id"] < 400]
    # Better than words alone, and a passage that the corpus repeats is known.
    assert sum(x["score"] for x in unseen) > sum(x["base_score"] for x in unseen)
    assert by_id[fresh[0]]["score"] > 0.7 * by_id[fresh[1]]["score"]
    assert all(x["score"] < 0 and x["bits_per_byte"] == pytest.approx(-x["score"] * math.log2(10) / x["n_bytes"]) for x in got)
    again = cm.score_documents(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    for x in again:
        assert x["score"] == pytest.approx(by_id[x["doc_id"]]["score"], rel=1e-4)


def brute_sums(texts, mixer):
    """Loss, slope and curvature by set and bit, and the table, of all bytes of ``texts``, each left out of the counts."""
    after, grams = {}, Counter()
    for (context, byte), n in brute_counts(texts).items():
        after.setdefault(context, Counter())[byte] = n
        if len(context) == cm.LONGEST:
            grams[context, byte] = n
    k = len(cm.ORDERS)
    loss, slope, curve = (np.zeros((cm.SETS, 8, *rest)) for rest in ((), (k,), (k, k)))
    right, tried = np.zeros((8, cm.STEPS)), np.zeros((8, cm.STEPS))
    for (context, byte), n in grams.items():
        of_order = [after[context[-order:]] for order in cm.ORDERS]
        s = sum(sum(of_order[-1].values()) - 1 >= least for least in cm.LEVELS)
        for j in range(8):
            votes = []
            for counts in of_order:
                way = [sum(c for y, c in counts.items() if y >> (8 - b) == byte >> (8 - b)) - 1 for b in (j, j + 1)]
                votes.append(math.log((way[1] + cm.SMALL) / (way[0] - way[1] + cm.SMALL)))
            votes = np.array(votes)
            z = float(votes @ mixer.weights[s, j])
            miss, step = 1 / (1 + math.exp(z)), min(int(abs(z) / cm.STEP), cm.STEPS - 1)
            loss[s, j] += n * math.log1p(math.exp(-z))
            slope[s, j] += n * miss * votes
            curve[s, j] += n * miss * (1 - miss) * np.outer(votes, votes)
            tried[j, step] += n
            right[j, step] += n * (z >= 0)
    first = cm.Mixer.initial()
    away = mixer.weights - first.weights
    return (loss.sum(), slope - cm.FIT_PULL * away, curve + cm.FIT_PULL * np.eye(k),
            (right + 8 * first.table) / (tried + 8))


def test_weights_and_table_are_fitted_to_every_training_text(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(random_texts(8, 700, 12))] + [(None, "zebra zebra"), (701, None)]
    used, scores = [], cm._scores
    monkeypatch.setattr(cm, "_scores", lambda blocks, answers, mixer, whole: used.append(mixer) or scores(blocks, answers, mixer, whole))
    monkeypatch.setattr(cm, "BUCKET", 1 << 12)  # several buckets
    cm.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(5))
    loss, slope, curve, table = brute_sums([t for i, t in rows if i is not None and not held_out(i)], used[0])
    step = np.linalg.solve(curve, slope[..., None])[..., 0]
    assert (slope * step).sum() < 1e-5 * loss  # nothing is left to gain over all texts
    assert used[0].table == pytest.approx(table, abs=0.02)
    assert np.abs(used[0].weights - cm.Mixer.initial().weights).max() > 0.1


def test_a_step_of_the_fit_that_goes_too_far_is_halved():
    seen = np.zeros((2, 8, len(cm.ORDERS)), np.float32)
    seen[0], seen[1] = 11, -0.1
    counts, level = np.array([1000, 1]), np.full(2, cm.SETS - 1, np.int8)
    losses = []

    def sums_at(weights):
        sums = cm.Sums.none()
        sums.add(seen, level, counts, weights)
        losses.append(sums.loss.sum())
        return sums

    mixer, last = cm.searched(sums_at), cm.Sums.none()
    last.add(seen, level, counts, mixer.weights)
    assert last.loss.sum() <= losses[0] and np.isfinite(mixer.weights).all()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "lost words"), (3, "x" * 60_000), (3, "again"), (3, "again"), (4, " \n"), (5, "\x00 \x85 日"),
            (20, "the <|endoftext|> end"), (21, "a " * 20_000)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("slice", F.lit("own")).withColumn("Train", F.lit(1)).withColumn("line", F.lit(2))
    check_rows(cm.score_documents(table).collect(), rows)
    assert cm.score_documents(table.limit(0)).count() == 0
    only_held = [(i, "the b") for i in range(60) if held_out(i)]
    check_rows(cm.score_documents(spark.createDataFrame(only_held, SCHEMA)).collect(), only_held)
