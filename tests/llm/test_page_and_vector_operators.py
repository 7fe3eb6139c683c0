"""WARC, main text, url verdicts, components and vector searches on small tables, against brute force."""

import hashlib
import random
import struct
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwatch.llm import embedjoin, htmltext, lshforest, urls, warc
from cellwatch.llm.components import components

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


# ---- components

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_those_of_a_walk(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(40)] + [(300, 300 + k) for k in range(1, 30)]
    edges += edges[:5] + [(None, 3), (7, None), (9, 9)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


# ---- WARC

def warc_rows():
    long = "<p>" + "é" * 80 + "</p>"
    rows = [(i, f"http://h/{i}", f"<html>{i % 40} " + "x" * (i * 37 % 900)) for i in range(200)]
    rows += [(500 + k, f"http://h/{k}?a=100%&b=%41\r\nX: y", long) for k in range(30)]
    rows += [(600, None, None), (601, "u", ""), (602, "u", "short"), (603, "u", "short"), (None, "n", long), (500, "again", long),
             (700, "big", "y" * 700_000), (701, "\u2028é", "z\x00\r\n\r\nWARC/1.1\r\n" * 20)]
    return rows


def test_archives_give_back_every_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    rows = warc_rows()
    table = pages(spark, rows).repartition(3).withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    folder, index = warc.write_archives(table)
    got = warc.read_archives(folder, index).collect()
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None and len(raw) >= 100:
            first[raw] = min(page, first.get(raw, page))
    want = []
    for page, url, html in rows:
        raw = (html or "").encode()
        copy = sum((h or "").encode() == raw for _, _, h in rows) > 1 and len(raw) >= 100 and page != first.get(raw)
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if copy else "response",
                     first[raw] if copy else None, url, None if copy else html or ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert index.select("bundle").distinct().count() > 1


def test_a_bundle_ends_with_a_seek_table(spark):
    folder, index = warc.write_archives(pages(spark, [(i, "u", str(i) * 60_000) for i in range(20)]).coalesce(1))
    name = index.first()["bundle"]
    raw = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
    count, _, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == warc.SEEKABLE_MAGIC and count == index.select("frame").distinct().count() > 1
    reader = warc.BundleReader(folder, name)
    place = index.where("page_id = 13").first()
    record = reader.frame(place["frame"])[place["start"]:place["start"] + place["length"]]
    assert warc.decode_record(record)[-1] == "13" * 60_000
    # Any decoder reads the whole: the frames one after the other, the table skipped.
    import io
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as stream:
        assert len(stream.read()) == sum(plain for _, _, plain in reader.places)


def test_no_pages_no_bundles(spark):
    folder, index = warc.write_archives(pages(spark, []))
    assert index.count() == 0 and warc.read_archives(folder, index).count() == 0


# ---- main text

ARTICLE = "A paragraph, with commas, that is long enough to count as one."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<", "<"), ("just text", "just text"), ("<p", ""), ("<script>x", ""),
    (f"<nav><a href=/>menu</a></nav><div class=body><h1>T &amp; U</h1><p>{ARTICLE}<p>{ARTICLE}<br>more</div><footer>f</footer>",
     f"T & U\n{ARTICLE}\n{ARTICLE} more"),
    (f"<article><header><h1>T</h1></header><p>{ARTICLE}</p><aside>see also</aside><ul><li>one<li>two</ul></article>", f"T\n{ARTICLE}\none\ntwo"),
    (f"<div id='content'><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div id='comments'><p>{ARTICLE} {ARTICLE}</p><p>{ARTICLE}</p></div>", f"{ARTICLE}\n{ARTICLE}"),
    (f"<body><div class='cookie-notice'><p>{ARTICLE}</p></div><main class='has-sidebar'><p>{ARTICLE}</p></main></body>", ARTICLE),
    (f"<div><p>{ARTICLE}</p><div style='display:none'>{ARTICLE}</div><!-- {ARTICLE} --><form><p>{ARTICLE}</p></form></div>", ARTICLE),
    (f"<title>t</title><body><p>{ARTICLE}&nbsp;\n &eacute;&#233;&#xe9;</p>", f"{ARTICLE} ééé"),
    ("<div>" * 3000 + ARTICLE, ARTICLE),
])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_main_text_over_two_articles():
    """Articles and paragraphs beside the one with the best element are its siblings."""
    strong = [f"Part {i}" + ", and so on" * 6 + ", to the end." for i in range(8)]
    several = ["".join(f"<p>{x}</p>" for x in part) for part in (strong[:5], strong[5:7], strong[7:])]
    page = f"<body><div><article>{several[0]}</article><article>{several[1]}</article>{several[2]}<article><p>{ARTICLE}</p></article></div></body>"
    assert htmltext.main_text(page).split("\n") == strong
    inner = f"<article><div><section>{several[0]}</section></div></article><article><div>{several[1]}{several[2]}</div></article>"
    assert htmltext.main_text(f"<main>{inner}</main>").split("\n") == strong


def test_long_and_odd_pages_end_soon():
    for page in ("<p>" * 50_000, '<a "' * 50_000, "<div><p>" * 20_000, "&amp" * 100_000, "</div>" * 50_000, "<li>" * 30_000):
        htmltext.main_text(page)


def test_extract_keeps_rows_and_columns(spark):
    table = pages(spark, [(1, "u", None), (1, "u", None), (2, None, f"<p>{ARTICLE}🤗")]).withColumn("text", F.lit("own")).withColumn("x", F.lit(1))
    got = htmltext.extract(table)
    assert got.columns == ["page_id", "url", "x", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "u", 1, "", 0), (1, "u", 1, "", 0), (2, None, 1, ARTICLE + "🤗", len(ARTICLE) + 1)], key=str)
    assert htmltext.extract(pages(spark, [])).count() == 0


# ---- urls

@pytest.mark.parametrize("url, want", [
    ("https://www.Example.ORG/es/1?q#f", ("www.example.org", "/es/1", "example.org/es/", "block")),
    ("http://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
    ("http://example.org/en/2", ("example.org", "/en/2", "org/", "allow")),
    ("http://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
    ("http://a.com/de/x", ("a.com", "/de/x", "com/de/", "block")),
    ("http://a.com/fr/x", ("a.com", "/fr/x", "com/fr/", "allow")),
    ("http://a.com", ("a.com", "", None, "allow")), ("http://a.org?x/", ("a.org", "", None, "allow")),
    ("ftp://É.COM/de/", ("É.com", "/de/", "com/de/", "block")), ("x://a://b/c", ("a:", "//b/c", None, "allow")),
    ("no scheme", ("", "", None, "allow")), (None, ("", "", None, "allow")),
])
def test_rules(spark, url, want):
    got = urls.judge(pages(spark, [(1, url, None)])).select("host", "path", "rule", "verdict").first()
    assert tuple(got) == want


def test_blocks_reach_aliases(spark):
    link = '<html><head><title><link rel=canonical href="http://no/"></title><LINK href="{}" REL="canonical"></head><body>'
    rows = [
        (1, "http://a.net/x#top", link.format("http://b.com/de/bad")),  # alias of a blocked url that is no page
        (2, "HTTP://A.net/x", None),  # the same url
        (3, "http://c.net/1", '<meta http-equiv="Refresh" content="0; URL=\'/2\'">'), (4, "http://c.net/2", link.format("//a.net/x")),
        (5, "http://d.com/fr/ok", link.format("http://b.com/de/bad")),  # allowed by a rule
        (6, "http://e.net/", link.format("http://d.net/y?a=1&amp;b=2")), (7, "http://d.net/y?a=1&b=2", None),
        (8, "http://f.net/", '<body><link rel="canonical" href="http://b.com/de/bad">'), (9, "http://g.net/", None)]
    redirects = spark.createDataFrame([("http://g.net", "http://h.net/"), ("http://h.net/", "http://i.com/de/")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages(spark, rows), redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block"}


def test_links_behind_scripts_and_comments(spark):
    canonical, refresh = '<link rel="canonical" href="http://b.com/{}">', '<meta http-equiv=refresh content="0; url=http://b.com/{}">'
    bodies = [
        "<head><script>x = '<body>'</script>" + canonical, "<head><!-- </head> <body> -->" + canonical,
        "<head><meta content='a <script> or </head>'>" + canonical, "<head></head><body><p>it's</p>" + refresh,
        "<body><script>'" + refresh + "'</script>", "<body><!-- " + refresh, "<body><textarea>" + refresh + "</textarea>",
        "<head></head><body>" + canonical, "<head><script>x</SCRIPT ></head>" + canonical, "<head>" + "<a \"<!-- --><title>" * 3 + canonical]
    rows = [(i, f"http://a.net/{i}", html.format(i)) for i, html in enumerate(bodies)]
    got = {tuple(r) for r in urls.page_links(pages(spark, rows)).collect()}
    assert got == {(f"http://a.net/{i}", f"http://b.com/{i}") for i in range(4)}
    assert urls.page_links(pages(spark, [(1, "http://a.net/", x * 20_000) for x in ('<a "', '<a b="', "<!--", "<title>", "<meta ", "<")])).count() == 0


# ---- vectors

def vector_rows(n=260, d=24, seed=4):
    r = np.random.default_rng(seed)
    base = r.standard_normal((12, d))
    rows = [base[i % 12] + r.standard_normal(d) * (0.05 + 0.4 * (i % 5)) for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(1100, [2 * x for x in rows[3][1]]), (7, rows[9][1])]
    rows += [(2000, None), (2001, [0.0] * d), (2002, [float("nan")] + [1.0] * (d - 1)), (2003, [float("inf")] * d),
             (2004, [None] + [1.0] * (d - 1)), (2005, []), (2006, [1.0, 2.0])]
    return rows


VECTORS = "vec_id long, embedding array<float>"


def usable_rows(rows, d=24):
    out = []
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out.append((i, np.array(v + [0.0] * (d - len(v)), dtype=np.float32).astype(float)))
    return out


@pytest.mark.parametrize("home, others", [(8_000, 32_000), (30, 50)])
def test_vector_links_are_those_of_all_pairs(spark, monkeypatch, home, others):
    monkeypatch.setattr(embedjoin, "HOME_ROWS", home)
    monkeypatch.setattr(embedjoin, "OTHER_ROWS", others)
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit(0)).withColumn("first", F.lit(0)).withColumn("label", F.lit(1))
    good = usable_rows(rows)
    x = np.array([v for _, v in good])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(len(good))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(good))])
        if (new == label).all():
            break
        label = new
    least = {k: min(good[i][0] for i in np.flatnonzero(label == k)) for k in set(label)}
    want = [(good[i][0], int(near[i].sum()) - 1, least[label[i]]) for i in range(len(good))]
    want += [(i, 0, i) for i, _ in rows if i in (2000, 2001, 2002, 2003, 2004, 2005)]
    got = embedjoin.near_duplicates(table).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_are_stored_once_however_many_meet(spark, monkeypatch):
    """Each vector lies in one tile, pairs of tiles take no exchange, and tiles out of reach do not meet."""
    monkeypatch.setattr(embedjoin, "HOME_ROWS", 30)
    seen, store = {}, embedjoin.stored

    def stored(df, label):
        seen[label] = df._jdf.queryExecution().executedPlan().toString(), store(df, label)
        return seen[label][1]

    monkeypatch.setattr(embedjoin, "stored", stored)
    r = np.random.default_rng(4)
    groups = np.repeat(np.eye(16, 8, dtype=np.float64) - np.eye(16, 8, -8), 40, axis=0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((groups + 0.05 * r.standard_normal(groups.shape)).astype(np.float32))]
    got = embedjoin.near_duplicates(spark.createDataFrame(rows + rows[:5], VECTORS)).collect()
    assert len(got) == 645 and len({x["component_id"] for x in got}) == 16
    plan, tiles = seen["vector-tiles"]
    held = [np.frombuffer(x["ids"], np.int64) for x in tiles.select("ids").collect()]
    assert "Exchange" in plan and sorted(map(len, held))[-1] <= 30 and len(np.unique(np.concatenate(held))) == sum(map(len, held)) == 640
    assert "Exchange" not in seen["vector-links"][0] and "CartesianProduct" in seen["vector-links"][0]
    blocks = embedjoin.fit_blocks(np.array([v for _, v in rows]), 8, 0.9)
    other = tiles.select(*[F.col(c).alias(f"other_{c}") for c in tiles.columns])
    assert len(held) <= tiles.crossJoin(other).where(embedjoin._within_reach(blocks)).count() < len(held) ** 2 / 2


def test_budgets_miss_no_pair():
    r = np.random.default_rng(0)
    sample = r.standard_normal((500, 24)) * np.linspace(2, 0.1, 24)
    blocks = embedjoin.fit_blocks(sample, 24, 0.9)
    assert abs(blocks.budgets.sum() - 0.2) < 1e-12 and sorted(np.concatenate(blocks.axes)) == list(range(24))
    a = r.standard_normal((4000, 24))
    b = a + r.standard_normal((4000, 24)) * 0.45
    cosine = (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    squares = (blocks.rotated(a).astype(float) - blocks.rotated(b)) ** 2
    within = np.stack([squares[:, x].sum(axis=1) <= y + embedjoin.SLACK for x, y in zip(blocks.axes, blocks.budgets)])
    assert (cosine >= 0.9).sum() > 500 and within.any(axis=0)[cosine >= 0.9].all()


def test_links_of_a_large_group_need_no_list_of_pairs(monkeypatch):
    """Memory of a cell's task doesn't grow with the pairs that it finds."""
    monkeypatch.setattr(embedjoin, "PAIRS", 1 << 14)
    n, d = 3000, 8
    r = np.random.default_rng(3)
    vectors = np.concatenate([1.0 + 1e-3 * r.standard_normal((n, d)), r.standard_normal((1, d)) - 3.0])
    blocks = embedjoin.fit_blocks(vectors[:n], d, 0.9)
    rows = pd.DataFrame({
        "block": 0, "home": True, "id": np.arange(n + 1) * 7, "copies": 1, "rotated": [v.tobytes() for v in blocks.rotated(vectors)],
        "vector": [v.tobytes() for v in vectors]})
    work = embedjoin._cell_links(blocks, d, 0.9, np.float64)
    tracemalloc.start()
    got = work(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got["id"]) == [7 * i for i in range(n)] and set(got["links"]) == {n - 1} and set(got["root"]) == {0}
    assert peak < n * n * 16 / 2


def test_forests_grow_by_blocks_of_links():
    r = np.random.default_rng(6)
    left, right = r.integers(0, 500, 350), r.integers(0, 500, 350)
    root = np.arange(500)
    for at in range(0, 350, 40):
        root = embedjoin._joined(root, left[at:at + 40], right[at:at + 40])
    assert (root == embedjoin._forest(left, right, 500)).all()


def test_empty_vectors(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert embedjoin.near_duplicates(nothing).count() == 0
    assert lshforest.search(nothing, nothing).count() == 0
    useless = spark.createDataFrame([(1, None), (2, [0.0])], VECTORS)
    assert [tuple(r) for r in embedjoin.near_duplicates(useless).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert lshforest.search(useless, useless).count() == 0


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        scores = sorted({(-float((w * v).sum()), i) for i, w in rows if i != q})
        best = out.setdefault(q, set())
        best.update(scores[:k])
    return {q: sorted(best)[:k] for q, best in out.items()}


def test_whole_share_is_exact(spark):
    """Looking at everything, the forest is brute force: ties, copies and few candidates included."""
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in lshforest.search(table, lshforest.queries_of(table), share=1e9, trees=3, bits=12).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = usable_rows(rows)
    want = brute_nearest(good, [(i, v) for i, v in good if i % 20 == 0], 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))
        assert [v for _, v, _ in sorted(found)] == [i for _, i in want[q]]
        assert np.allclose([s for _, _, s in sorted(found)], [-s for s, _ in want[q]], rtol=1e-12)
    few = spark.createDataFrame(rows[:5], VECTORS)
    assert lshforest.search(few, few).count() == 20


def test_recall_and_parts(spark):
    """Trees cut into parts and crowded parts into pieces find as much."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(r.standard_normal((1500, 32)))]
    rows += [(5000 + i, rows[40][1]) for i in range(300)]
    table = spark.createDataFrame(rows, VECTORS)
    good = usable_rows(rows, 32)
    want = brute_nearest(good, [(i, v) for i, v in good if i % 20 == 0], 20)
    exact = spark.createDataFrame([(q, i) for q, best in want.items() for _, i in best], "query_id long, vec_id long")
    for part_rows in (100_000, 100):
        found = lshforest.search(table, lshforest.queries_of(table), part_rows=part_rows)
        assert lshforest.measure_recall(found, exact) >= 0.9


@pytest.mark.parametrize("copies, part_rows", [(4, 100_000), (25, 100)])
def test_repeated_rows_take_no_places(spark, copies, part_rows):
    """With each row there several times the answers are those of the rows once."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(r.standard_normal((400, 16)))]
    rows += [(7, rows[9][1]), (20, rows[33][1])]  # ids with two vectors, one of them a query
    once = spark.createDataFrame(rows, VECTORS)
    often = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    often = often.unionByName(once.withColumn("embedding", F.concat("embedding", F.array(F.lit(0.0).cast("float")))))
    want, got = (sorted(map(tuple, lshforest.search(t, lshforest.queries_of(t), part_rows=part_rows).collect())) for t in (once, often))
    assert got == want and len(got) == 20 * 20
