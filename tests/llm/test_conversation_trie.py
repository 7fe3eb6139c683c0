"""The conversation trie against a trie of dictionaries."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cellwatch.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}/{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = (*own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h], *turns[h:])
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, inside in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(inside) - 1) * words
    return sorted(
        (min(m), len(n), -1 if not n else min(members[n[:-1]]), len(m), children.get(n, 0), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items())


def got(nodes):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in nodes.collect())


def random_rows(seed, convs, turns, words):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 4 * convs), convs):
        rows += [(c, t, r.choice("ua"), " ".join(r.choice("xy") for _ in range(r.randint(0, words)))) for t in range(r.randint(1, turns))]
    return rows


@pytest.mark.parametrize("segment", [1, 2, 3, convtrie.SEGMENT_TURNS])
def test_nodes_equal_a_trie_of_dictionaries(spark, segment):
    rows = random_rows(segment, 60, 7, 1)
    turns = convtrie.with_shared_heads(convtrie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got(convtrie.prefix_trie(turns, segment)) == brute(rows)


def test_long_conversations_and_copies(spark):
    rows = [(c, t, "u", f"w {min(t, 150 + c // 40)}") for c in range(0, 200, 20) for t in range(150 + c)]
    rows += [(c, t, "u", "same") for c in range(1000, 1400) for t in range(3)]
    assert got(convtrie.trie_of_conversations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_long_conversations_are_numbered_in_segments(spark):
    rows = [(7, t, "u", f"{t % 5}") for t in range(900)] + [(8, t, "u", f"{t % 5}") for t in range(700)]
    spark.conf.set("cellwatch.split.rows", "200")
    try:
        nodes = got(convtrie.trie_of_conversations(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    finally:
        spark.conf.unset("cellwatch.split.rows")
    assert nodes == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "u", "lost"), (40, None, None, None), (40, None, "", ""), (40, 1, "u", "a\x0bb  c"), (40, 1, "u", "a\x0bb  c"),
            (41, 3, "u", "x" * 100_000), (41, -1, "a", " "), (41, 3, "a", "tie"), (41, 3, "u", "tie")]
    # A conversation whose turns all belong to the head, taken from one that isn't there.
    alone = next(c for c in range(2001, 2020) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows += [(alone, 0, "u", "gone")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("words", F.lit("own")).withColumn("PART", F.lit(2))
    nodes = got(convtrie.trie_of_conversations(table))
    assert nodes == brute(rows)
    root = next(n for n in nodes if n[1] == 0)
    assert root[3] == 3 and root[7] == hashlib.sha256(str(alone).encode()).hexdigest()
    assert convtrie.trie_of_conversations(table.limit(0)).count() == 0
    assert got(convtrie.trie_of_conversations(table.where(F.col("conv_id") == alone))) == brute(rows[-1:])


def test_intervals_are_those_of_a_scan():
    r = random.Random(4)
    values = [r.randint(0, 5) for _ in range(70)]
    table = convtrie.Minima(convtrie.np.array(values))
    at = convtrie.np.repeat(convtrie.np.arange(70), 6)
    least = convtrie.np.tile(convtrie.np.arange(6), 70)
    left, right = table.left_end(at, least).tolist(), table.right_end(at, least).tolist()
    for i, d, l, e in zip(at.tolist(), least.tolist(), left, right):
        want = i
        while want > 0 and values[want] >= d:
            want -= 1
        assert l == want
        want = i
        while want < 69 and values[want + 1] >= d:
            want += 1
        assert e == want
