"""Mixing, BPE, toxicity, language and n-gram join on small tables, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from cellwatch.llm import bpe, langid, mixing, ngramjoin, toxicity
from cellwatch.llm.shared import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(seed, n, alphabet="abcdef"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 6))) for _ in range(n))


ODD = [None, "", " \n\t", "a", "!!!", "é", "A b\x0bC", "x" * 50_000, "the <|endoftext|> end", "\x1cno\x85space　"]


# ---- word hashes

def test_words_are_those_of_the_pattern():
    texts = ["A b\x0bc", "", "  x ", None, "É é z", "one\ntwo"]
    found = Words(pa.array(texts))
    table = str.maketrans(ascii_uppercase, ascii_lowercase)
    names = {}
    for i, text in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        got = found.hashes[found.bounds[i]:found.bounds[i + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


# ---- mixing

def test_poisson_counts_follow_the_distribution(spark):
    table = docs(spark, [(i, "abcd", None, "a" if i % 4 else "b", 4) for i in range(4000)])
    mixed = mixing.mix(table, weights={"a": 1.0, "b": 1.0})
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for source, size, rate in (("a", 3000, 2 / 3), ("b", 1000, 2.0)):
        own = [counts.get(i, 0) for i in range(4000) if (i % 4 != 0) == (source == "a")]
        assert abs(np.mean(own) - rate) < 5 * math.sqrt(rate / size)
        assert abs(np.mean(np.array(own) == 0) - math.exp(-rate)) < 0.05
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert sorted(mixed.collect()) == sorted(mixing.mix(table.repartition(7), weights={"a": 1.0, "b": 1.0}).collect())


def test_mixing_takes_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x", "en", "a", 1), (3, "", "en", "z", 0)]
    table = docs(spark, rows).withColumn("copy", F.lit("own")).withColumn("cumulative", F.lit(1))
    got = mixing.mix(table)
    assert got.columns == [*table.columns, "copy_", "shuffle_key"]
    assert {r["copy"] for r in got.collect()} <= {"own"}
    assert mixing.mix(docs(spark, [])).count() == 0


def test_large_rates_do_not_underflow(spark):
    tables = mixing.poisson_tables(spark.createDataFrame([("s", 2000.0)], "source string, rate double")).collect()
    cumulative = np.array(tables[0]["cumulative"])
    assert abs(cumulative[-1] - 1.0) < 1e-9 and abs(np.searchsorted(cumulative, 0.5) - 2000) < 3


# ---- BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


def test_encodings_are_the_librarys(library):
    codec = bpe.Codec(bpe.vocabulary_path())
    r = random.Random(3)
    parts = ["a", "aa", "th", "ing", "'s", "'LL", "ß", "É", "é", "Σ", "İ", "1", "½", " ", "\n", " ", "\x1c", "!", "...", "🤗", "日本",
             "<|endoftext|>", "</w>", "​", "\x00", "क्"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [x for x in ODD if x is not None]
    texts += [r.choice("abmz!=-") * r.randint(1, 300) for _ in range(60)]
    for text, (n, ids, decoded) in zip(texts, codec.encode_all(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert decoded == library.decode(want, skip_special_tokens=False)
        assert decoded == bpe.decode(want, codec.vocabulary)


def test_encodings_with_few_kept_words_are_the_same(library, monkeypatch):
    codec = bpe.Codec(bpe.vocabulary_path())
    monkeypatch.setattr(bpe, "MOST_WORDS", 20)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 30)
    r = random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(r.choices("aeinst", k=r.randint(1, 7))) for _ in range(r.randint(0, 30))) for _ in range(5)]
        for text, (_, ids, _) in zip(texts, codec.encode_all(texts)):
            assert ids == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert len(codec.ids) == len(codec.decoded) <= 20 + 5 * 30


def test_bpe_query_takes_odd_rows(spark, library):
    table = docs(spark, [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(0, None, None, None, None)]).withColumn("ids", F.lit(5))
    got = bpe.encode(table).collect()
    assert len(got) == len(ODD) + 1
    for row in got:
        want = library.encode(ODD[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == want
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode(docs(spark, [])).count() == 0


# ---- toxicity

def test_marginals_are_those_of_all_paths():
    r = np.random.default_rng(1)
    e, bounds, t = r.normal(size=9), np.array([0, 4, 4, 5, 9]), r.normal(size=(2, 2))
    got = toxicity.marginals(e, bounds, t)
    for low, high in zip(bounds[:-1], bounds[1:]):
        n = high - low
        weight = np.zeros(n)
        total = 0.0
        for path in range(1 << n):
            y = [(path >> i) & 1 for i in range(n)]
            w = math.exp(sum(e[low + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += w
            weight += w * np.array(y)
        assert np.allclose(got[low:high], weight / total if n else [])


def test_pair_marginals_are_those_of_all_paths():
    e, bounds, t = np.array([0.3, -1.0, 0.7]), np.array([0, 3]), np.array([[0.2, -0.4], [0.1, 0.9]])
    table = np.zeros((2, 2))
    for path in range(8):
        y = [(path >> i) & 1 for i in range(3)]
        w = math.exp(sum(e[i] * y[i] for i in range(3)) + t[y[0], y[1]] + t[y[1], y[2]])
        table[y[0], y[1]] += w
        table[y[1], y[2]] += w
    assert np.allclose(toxicity._pair_marginals(e, bounds, t, np.array([1, 2])), table / table.sum())


def toxic_tables(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        body = words(i, 40, "abcdefghij").split()
        bad = i % 3 == 0
        if bad:
            body[7] = "GrÄuel" if i % 2 else "vilekk" + words(i, 1)
            body[20] = "vilekkso"
        rows.append((i, " ".join(body), None, None, None))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_and_spans_are_found(spark):
    table, labels = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.scores(table, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 50
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in held)
    for i in held:
        for span in got[i]["spans"]:
            assert texts[i][span["start"]:span["end"]].startswith(("vilekk", "Gr"))
        assert bool(got[i]["spans"]) == (i % 3 == 0)
    model = toxicity.train(table, labels)
    kept = toxicity.clean(table, model)
    assert kept.columns == table.columns and {r["doc_id"] % 3 for r in kept.collect()} == {1, 2}


def test_toxicity_takes_odd_rows(spark):
    table, labels = toxic_tables(spark)
    model = toxicity.train(table, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (9, 1, 0)], labels.schema)))
    odd = docs(spark, [(i, t, None, None, None) for i, t in enumerate(ODD)]).withColumn("score", F.lit("own"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0.0 <= r["score"] <= 1.0 and r["predicted"] == 0 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert toxicity.clean(odd, model).count() == len(ODD)
    nothing = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.scores(table, nothing).collect()} == {0.0}
    assert toxicity.scores(docs(spark, []), labels).count() == 0


# ---- language

def language_rows():
    rows = []
    for i in range(400):
        lang, alphabet = [("xx", "abcde"), ("yy", "fghij"), ("zz", "àéklm")][i % 3]
        rows.append((i, words(i, 30, alphabet).upper() if i % 5 == 0 else words(i, 30, alphabet), lang, None, None))
    return rows


def test_languages_are_told_apart(spark):
    rows = language_rows()
    got = {r["doc_id"]: r for r in langid.predictions(docs(spark, rows)).collect()}
    assert all(got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1.0 for i, _, lang, _, _ in rows if got[i]["held_out"])
    assert 50 < sum(r["held_out"] for r in got.values()) < 150


def test_filters_hold_every_learned_gram(spark):
    table = docs(spark, language_rows())
    model = langid.train(table)
    for name, bit in zip(model.languages, range(3)):
        text = table.where(F.col("lang") == name).limit(20).collect()
        hashes, _, _ = langid.grams([r["text"] for r in text])
        found = (model.masks(hashes)[:, 0] >> np.uint64(bit)) & np.uint64(1)
        assert found.mean() > 0.99
    assert (model.rates < 0.05).all()


def test_language_takes_odd_rows(spark):
    model = langid.train(docs(spark, language_rows()).unionByName(docs(spark, [(None, None, "xx", None, None), (1, "q", None, None, None)])))
    got = langid.identify(docs(spark, [(i, t, None, None, None) for i, t in enumerate(ODD)]).withColumn("score", F.lit(1)), model).collect()
    letters = {i: any(c.isalpha() for c in t or "") for i, t in enumerate(ODD)}
    for r in got:
        assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]]) and 0.0 <= r["score"] <= 1.0
    _, _, part = model.predict(ODD)
    kept = langid.identified(docs(spark, [(i, t, None, None, None) for i, t in enumerate(ODD)]), model).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, p in enumerate(part) if p >= langid.LEAST_FOUND]
    # Nothing of these is in a learned language.
    assert not {ODD.index(t) for t in ODD if t and t.startswith("xxxx")} & {r["doc_id"] for r in kept}
    assert langid.predictions(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.predictions(docs(spark, [(1, "abc", None, None, None)])).collect()} == {"und"}


def test_any_number_of_languages(spark):
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03}": "".join(r.sample(letters, 5)) for k in range(600)}
    rows = [(i, " ".join("".join(r.choice(own[lang]) for _ in range(6)) for _ in range(40)), lang, None, None)
            for i, lang in enumerate([*own] * 4)]
    got = langid.predictions(docs(spark, rows)).collect()
    right = sum(x["lang_pred"] == rows[x["doc_id"]][2] for x in got if x["held_out"])
    assert right > 0.9 * sum(x["held_out"] for x in got)
    assert len(langid.train(docs(spark, rows)).filters) == 10


def test_corrected_counts_are_those_of_sets(spark):
    rows = language_rows()
    table = docs(spark, rows)
    model = langid.train(table)
    counts = {}
    for _, text, lang, _, _ in rows:
        hashes, _, _ = langid.grams([text])
        counts.setdefault(lang, Counter()).update(hashes.tolist())
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    kept = {lang: {g for g, x in own.items() if x >= langid.LEAST_SHARE and x * langid.RIVAL >= max(o.get(g, 0) for o in share.values())}
            for lang, own in share.items()}
    texts = [t for _, t, _, _, _ in rows[:60]]
    hashes, bounds, _ = langid.grams(texts)
    got = model.corrected(hashes, bounds)
    for i in range(len(texts)):
        mine = hashes[bounds[i]:bounds[i + 1]].tolist()
        for k, lang in enumerate(model.languages):
            assert got[i, k] == pytest.approx(sum(g in kept[lang] for g in mine), abs=1 + 0.02 * len(mine))


def test_identification_of_repeated_and_long_rows(spark):
    rows = language_rows()[:30]
    model = langid.train(docs(spark, rows))
    text = rows[0][1]
    table = docs(spark, [(1, text, None, None, None)] * 3 + [(2, (text + " ") * 3000, None, None, None)]).withColumn("lang_pred", F.lit("own"))
    got = langid.identify(table, model).collect()
    assert {r["lang_pred"] for r in got} == {rows[0][2]} and len(got) == 4
    assert langid.identified(table, model).columns == table.columns


# ---- n-gram join

def brute_components(rows):
    table = str.maketrans(ascii_uppercase, ascii_lowercase)
    sets = {}
    for i, (doc_id, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def near_rows(seed, n):
    """Chains of near copies, copies, texts with a common passage, and short ones."""
    r = random.Random(seed)
    passage = words("passage", 60)
    rows, bases = [], [words(f"{seed}/{k}", r.randint(30, 120)) for k in range(12)]
    for i in range(n):
        w = r.choice(bases).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = words(r.random(), 1)
        text = " ".join(w)
        if r.random() < 0.3:
            text = passage + " " + text
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    w = words("chain", 200).split()
    for k in range(25):  # each like the one before, the ends unlike
        w[8 * k] = f"new{k}"
        rows.append((n + k, " ".join(w)))
    rows += [(n + 100 + k, t) for k, t in enumerate(ODD + ["a b c", "A  b\tc", "a b", "!!!"])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_are_those_of_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LEAST_FRAGMENTS", 4)
    rows = near_rows(seed, 150)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", F.lit(0)).withColumn("n", F.lit(0))
    got = sorted(map(tuple, ngramjoin.near_duplicates(table).collect()))
    assert got == brute_components(rows)


def test_crossing_pairs_alone_find_every_link(spark):
    """With each text a component of its own, the pairs of the last step are all that link."""
    rows = near_rows(5, 60)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    base = ngramjoin.text_keys(table)
    sets = ngramjoin.candidates(table, base.agg(F.sum("n")).collect()[0][0])
    postings = ngramjoin._postings(sets)
    nothing = spark.createDataFrame([], "id long, component long")
    alone = ngramjoin.linked(sets, ngramjoin._crossing_pairs(postings, nothing))
    texts = {}
    for _, text in rows:
        w = (text or "").lower().split(" ")
        if len(w) >= 5:
            texts[tuple(w)] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    links = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(texts.values()) for b in list(texts.values())[:i])
    assert alone.count() == links > 20


def test_one_of_each_keeps_whole_rows(spark):
    rows = near_rows(3, 60)
    table = docs(spark, [(i, t, "en", "s", 1) for i, t in rows] + [(0, dict(rows)[0], "en", "s", 1)])
    kept = ngramjoin.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})


def test_repeated_and_null_ids(spark):
    a, b = words("a", 40), words("b", 40)
    got = ngramjoin.near_duplicates(spark.createDataFrame([(5, a), (5, b), (7, a), (None, b), (None, words("c", 9))], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(5, 36, 5), (5, 36, 5), (7, 36, 5), (None, 36, 5), (None, 5, None)], key=str)
    assert ngramjoin.near_duplicates(docs(spark, [])).count() == 0


def test_texts_in_no_known_language_go(spark):
    table = docs(spark, [(i, words(i, 30), "a", None, None) for i in range(20)] + [(100 + i, words(i, 30, "uvwxyz"), "b", None, None) for i in range(20)])
    model = langid.train(table)
    odd = [(200, "ξεν γλω σσα", None, None, None), (201, "日本語", None, None, None), (202, "12 !", None, None, None), (203, None, None, None, None)]
    got = langid.identified(table.unionByName(docs(spark, odd)), model).collect()
    assert sorted(got) == sorted(table.collect())
    assert langid.identify(docs(spark, odd), model).where("lang_pred <> 'und'").count() == 2
