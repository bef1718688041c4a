from __future__ import annotations

import html
import os
import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from tracemill.llm import html_text, mtree

EMB = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    v = [(i, np.floor(np.array(x, dtype=np.float32).astype(np.float64) * 1024).astype(np.int64)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for i, q in sorted({(i, tuple(q)) for i, q in v if i % every == 0}):
        best = {}
        for j, y in v:
            if j != i and len(y) == len(q):
                s = int(np.dot(np.array(q), y))
                best[j] = max(s, best.get(j, s))
        out += [(i, r + 1, j, s) for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def vectors(seed, n=900, dim=8):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    rows = [(int(i), (centres[i % 6] * (i % 3) + r.standard_normal(dim) * 0.2).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n + i, rows[5][1]) for i in range(60)]  # many equal vectors: ties


@pytest.mark.parametrize("seed", [0, 1])
def test_agrees_with_brute_force(spark, monkeypatch, seed):
    for name, value in (("TREE", 200), ("LEAF", 8), ("FANOUT", 4), ("BLOCK", 7), ("SAMPLE", 30)):
        monkeypatch.setattr(mtree, name, value)
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], EMB)
    assert sorted(tuple(r) for r in mtree.top_k(df, 10, 10).collect()) == brute(rows, 10, 10)


@pytest.mark.parametrize("seed", [0, 1])
def test_repeated_rows_and_ids_take_no_neighbours_place(spark, monkeypatch, seed):
    for name, value in (("TREE", 200), ("LEAF", 8), ("FANOUT", 4), ("BLOCK", 7), ("SAMPLE", 300)):
        monkeypatch.setattr(mtree, name, value)
    rows = vectors(seed)
    rows = rows + rows + [(7, v) for _, v in rows[:100]]  # every row twice, and one id with many vectors
    rows += [(2000 + i % 12, [9.0] * 8) for i in range(400)]  # one vector, each id many times
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], EMB)
    assert sorted(tuple(r) for r in mtree.top_k(df, 10, 10).collect()) == brute(rows, 10, 10)


def test_large_components_are_compared(spark):
    rows = [(i, [float(i % 7), 2.0**17 * (i % 5), 1.0 + i]) for i in range(300)] + [(300, [2.0**27, 1.0, 2.0]), (301, [-(2.0**14), 0.5, 3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], EMB)
    assert sorted(tuple(r) for r in mtree.top_k(df, 10, 100).collect()) == brute(rows, 10, 100)
    # a component that fits no long takes its vector out
    assert mtree.top_k(spark.createDataFrame([(0, [1.0e30], 0), (1, [1.0], 0)], EMB), 10, 100).count() == 0


def test_a_tree_finds_the_best_of_clustered_points():
    r = np.random.default_rng(2)
    points = np.unique(np.round(np.repeat(r.standard_normal((40, 6)) * 3000, 100, axis=0) + r.standard_normal((4000, 6)) * 30).astype(np.int32), axis=0)
    pages, centre, _, m2 = mtree.grow(points, [np.array([i]) for i in range(len(points))])
    tree = mtree.Tree([p.dump() for p in pages], centre, m2)
    q = points[:5]
    ids, best = tree.search(q, np.arange(5), 10, np.full(5, mtree._NEVER))
    scores = q.astype(np.int64) @ points.T.astype(np.int64)
    scores[np.arange(5), np.arange(5)] = mtree._NEVER
    want = np.array([sorted(range(len(points)), key=lambda j: (-int(s[j]), j))[:10] for s in scores])
    assert (ids == want).all() and (best == np.take_along_axis(scores, want, 1)).all()
    assert sum(p.leaf for p in pages) > 60 and len(tree.open) < len(pages)  # pages that no bound leads to are never read
    assert tree.computed < 0.5 * len(q) * len(points)


def test_radii_cover_and_stored_distances_are_those_to_the_centre():
    r = np.random.default_rng(9)
    points = np.unique(r.integers(-900, 900, (3000, 5)), axis=0)
    pages, centre, radius, m2 = mtree.grow(points, [np.array([i]) for i in range(len(points))])
    lift = lambda x: np.concatenate([x, np.sqrt(np.maximum(0, m2 - (x.astype(float) ** 2).sum(axis=1)))[:, None]], axis=1)

    def below(k):
        p = pages[k]
        return p.points if p.leaf else np.concatenate([below(c) for c in p.numbers])

    seen = []

    def check(k, centre, radius):
        p = pages[k]
        assert np.linalg.norm(lift(below(k)) - lift(centre[None]), axis=1).max() <= radius * (1 + 1e-9) + 1e-9
        assert np.allclose(p.stored, np.linalg.norm(lift(p.points) - lift(centre[None]), axis=1))
        if p.leaf:
            seen.append(len(p.points))
        for i in range(0 if p.leaf else len(p.points)):
            check(p.numbers[i], p.points[i], p.radii[i])

    check(len(pages) - 1, centre, radius)
    assert sum(seen) == len(points) and max(seen) <= mtree.LEAF


def test_distances_are_avoided_where_vectors_cluster(spark, monkeypatch):
    """Through the whole operator: fewer than a third of all pairs of query and vector are worked out, and the result is that of all."""
    monkeypatch.setattr(mtree, "TREE", 512)
    r = np.random.default_rng(6)
    x = np.repeat(r.standard_normal((60, 16)), 100, axis=0) + r.standard_normal((6000, 16)) * 0.03
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, EMB)
    spent = mtree.walked(df, 10, 100, 1024.0).where("query_id is null").agg({"score": "sum"}).first()[0]
    assert spent < 60 * 6000 / 3
    got = sorted(tuple(t) for t in mtree.top_k(df, 10, 100).collect())
    assert got == brute([t[:2] for t in rows], 10, 100)


def test_many_dimensions_and_rows_of_one_vector(spark):
    r = np.random.default_rng(7)
    rows = [(i, (r.standard_normal(1024) * 3e4).tolist(), 0) for i in range(150)] + [(1000 + i, [1.0] * 1024, 0) for i in range(300)]
    got = sorted(tuple(t) for t in mtree.top_k(spark.createDataFrame(rows, EMB), 10, 100).collect())
    assert got == brute([t[:2] for t in rows], 10, 100)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [3.0]), (7, [-1.0, 0.001]), (7, [-1.0, 0.001]), (200, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], EMB + ", score string")
    got = sorted(tuple(r) for r in mtree.top_k(df, 10, 100).collect())
    assert got == brute(rows, 10, 100)
    assert mtree.top_k(df.where("false"), 10, 100).count() == 0
    assert mtree.top_k(df.where("vec_id = 0"), 10, 100).count() == 0


def test_blocks_go_to_cells_not_to_all_trees(spark, monkeypatch):
    """Clustered vectors: fewer pairs of blocks and trees are looked at than there are, and results are exact."""
    monkeypatch.setattr(mtree, "TREE", 100)
    r = np.random.default_rng(12)
    centres = r.normal(size=(40, 8)) * 40
    rows = [(i, (centres[i % 40] + r.normal(size=8) * 0.2).tolist()) for i in range(4000)]
    seen, own = [], mtree.routes

    def routes(roots, blocks, pivots):
        out = own(roots, blocks, pivots)
        seen.append((out.count(), roots.count() * blocks.count()))
        return out

    monkeypatch.setattr(mtree, "routes", routes)
    got = sorted(tuple(x) for x in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 100).collect())
    assert got == brute(rows, 10, 100)
    assert seen[0][0] < 0.5 * seen[0][1]


def test_components_and_scores_that_fit_no_long(spark):
    """A huge component takes its vector out, a huge score its pair; all other queries' results stay."""
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(301)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda df: sorted(tuple(x) for x in mtree.top_k(df, 10, 100).collect())
    want = key(plain)
    assert key(spark.createDataFrame([*rows, (1000, [1e17, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")) == want
    big = [*rows, (1001, [4e6, 0.0, 0.0, 0.0]), (1002, [4e6, 0.0, 0.0, 1.0]), (1100, [0.0, 4e6, 0.0, 0.0])]
    exact = {i: [int(np.floor(1024 * x)) for x in v] for i, v in big}
    ranked = []
    for q in (i for i in exact if i % 100 == 0):
        found = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)
        ranked += [(q, k, i, -s) for k, (s, i) in enumerate([x for x in found if abs(x[0]) < 1 << 63][:10], 1)]
    assert key(spark.createDataFrame(big, "vec_id long, embedding array<double>")) == sorted(ranked)
    huge = [*rows, (1100, [4e12, 0.0, 0.0, 0.0]), (1101, [4e12, 0.0, 0.0, 0.0])]
    assert not any(x[0] == 1100 and x[2] == 1101 for x in key(spark.createDataFrame(huge, "vec_id long, embedding array<double>")))


def test_pages_agree_with_their_articles(spark, sf_dir):
    """Also on the larger table beside, where neighbours share lines of their articles by chance."""
    larger = re.sub(r"sf0\.001/?$", "sf0.01", sf_dir)
    pages = spark.read.parquet(f"{larger if os.path.isdir(larger) else sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for p in pages.collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "\0", article)).replace("\0", " ").split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


CASES = [
    ("<p title='a hidden gem'>kept</p><p hidden>gone</p><div aria-hidden='true'>gone</div>", "kept"),
    ("<form action=x><div>tools</div><article>in a form</article></form>", "in a form"),
    ("<div class='social-science'>one</div><div class='comment-free-zone'>two</div><div class='site-nav'>no</div><div id='cookie-notice'>no</div>", "one two"),
    ("<p>one</p><p>two &amp; three</p>", "one two & three"),
    ("<header>x</header><main><h1>T</h1><p>a<b>b</b>c<br>d</p><aside>n</aside></main><footer>f</footer>", "T abc d"),
    ("<article>text<form><input value=x>no</form><script>if (a < b) '</p>'</script></article>", "text"),
    ('<article>keep<div class="comments"><p>reader</p></div><div id="cookie-notice">c</div><p role="navigation">m</p></article>', "keep"),
    ("<body><!-- <p>no</p> -->yes<style>p{}</style>", "yes"),
    ("<article><p>&lt;b&gt; &#233;&eacute;&nbsp;x  y\n z</article>", "<b> éé x y z"),
    ("a < b and c > d", "a < b and c > d"),
    ("<article>cut <a href='x", "cut"),
    ("<p>address, header-like words and loads</p>", "address, header-like words and loads"),
    ("<div class='loads'><p>kept</p></div>", "kept"),
    ("<article><p class='related-work'>a</p><h2 class='header'>b</h2><section id='notice'>c</section><p>body</p></article>", "a b c body"),
    ("<article><header><h1>Title</h1></header><p>body</p><footer>f</footer><aside>n</aside></article>", "Title body"),
    ("<header><h1>Site</h1></header><main><div class='social-bar'>tell</div><div class='related'>more</div><div class='related-work'>kept</div></main>", "kept"),
    ("<p title=\"it's\">one</p><p title='x>two</p><p>three</p>", "one two three"),
    ("<p title='a > b'>kept</p>", "kept"),
    ("<div>x</span></b></div><p>y<p>z", "x y z"),
    ("", ""),
    (None, ""),
]


def test_blocks(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/x", h, "y") for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(CASES)}


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a '" * 250_000, "<a \"'" * 200_000, "<!--" * 250_000, "<b>" * 300_000 + "</i>" * 200_000, "<b>" * 100_000 + "<p></p>" * 100_000, "<script" * 100_000, "<script>" + "</script " * 100_000, "&" * 1_000_000, "<p " + "class=" * 150_000 + ">"])
def test_a_hostile_page_costs_no_more_than_its_length(page):
    began = time.perf_counter()
    html_text.blocks(page)
    assert time.perf_counter() - began < 3


def test_long_sequences_are_aligned_in_bounded_memory():
    r = random.Random(1)
    a = [r.randrange(3000) for _ in range(12_000)]
    b = [x for x in a if r.random() < 0.9]
    tracemalloc.start()
    assert len(html_text.common(a, b)) == len(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all rows would be 12,000 numbers of 10,800 bits and their masks


def brute_lines(pages):
    """page_id -> text: all pages of a host in order, plain tables of longest common subsequences."""

    def lcs(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            old, new = rows[-1], [0]
            for j, y in enumerate(b):
                new.append(old[j] + 1 if x == y else max(old[j + 1], new[j]))
            rows.append(new)
        out, i, j = set(), len(a), len(b)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.add(i)
        return out

    rows = sorted((*html_text._host_path(p.url), p.page_id, html_text.blocks(p.html or "")) for p in pages)
    out = {}
    for k, (host, path, page_id, found) in enumerate(rows):
        on_host = lambda n: rows[n] if 0 <= n < len(rows) and rows[n][0] == host else None  # noqa: B023, E731
        near = sorted((x for x in map(on_host, (k - 1, k + 1)) if x), key=lambda x: -len(os.path.commonprefix([path, x[1]])))
        near += [x for x in map(on_host, (k - 2, k + 2)) if x] if len(near) == 1 else []
        within = [i for i, x in enumerate(found) if x[1] & 1]
        judged, gone, copies, hits = within or range(len(found)), None, [], []
        for other in near:
            if not other[3]:
                continue
            hit = lcs([x for x, _ in found], [x for x, _ in other[3]])
            if sum(len(found[i][0]) for i in judged if i in hit) < (0.5 if within else 0.9) * sum(len(found[i][0]) for i in judged):
                hits.append(hit)
            else:
                copies.append(hit)
        if hits:
            two = hits[0] & hits[1] if len(hits) > 1 else set()
            gone = {i for i in hits[0] if i not in within and (within or not found[i][1] & 2)} | {i for i in two if not within or not found[i][1] & 2}
        if gone is None:
            gone = set.intersection(*copies) - set(within) if copies else set()
            gone = gone if len(gone) < len(found) else set()
        out[page_id] = " ".join(x for i, (x, _) in enumerate(found) if i not in gone)
    return out


def test_pages_agree_with_brute_force(spark, sf_dir):
    """The supplied pages on two hosts, each in a frame of its section without article elements, some of them copies."""
    given = [p.html for p in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]
    rows = []
    for i, h in enumerate(given):
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1] if i % 7 else ""
        frame = "".join(f"<div>Section {i % 3} entry {k}</div>" for k in range(i % 3 + 3))
        copy = i % 5 == 4
        rows.append((i, f"http://h{i % 2}.org/{i % 3}/{i // (2 if copy else 1)}", f"{frame}<div>{inner if not copy else given[i - 1]}</div><div>Written for section {i % 3}</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == brute_lines(df.collect())


def test_frames_shared_with_the_nearest_page_go(spark):
    page = lambda *own: "<div>Site name</div><div>Home | News</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div>"
    rows = [
        (1, "http://a.org/news/1", page("First story", "It was so.")),
        (2, "http://a.org/news/2", page("Second story", "It was not.")),
        (3, "http://b.org/x", page("Alone here")),
        (4, "http://c.org/same/1", page("Copy")),
        (5, "http://c.org/same/2", page("Copy")),
        (6, None, page("No address")),
        (None, "http://a.org/news/3", page("No number")),
        (7, "http://a.org/blog/1", "<article>Site name</article>"),
        (7, "http://a.org/blog/1", "<article>Site name</article>"),
    ]
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    frame = lambda x: f"Site name Home | News {x} All rights"
    assert got == [(0, frame("No number")), (1, "First story It was so."), (2, "Second story It was not."), (3, frame("Alone here")), (4, frame("Copy")), (5, frame("Copy")), (6, frame("No address")), (7, "Site name"), (7, "Site name")]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_article_lines_need_more_than_one_page_s_word(spark):
    """Subheads and paragraphs that neighbours happen to hold too stay, with article elements and without."""
    story = lambda i, *shared: "".join(f"<p>{x}</p>" for x in (*shared, *(f"Words of story {i} number {k}" for k in range(6))))
    rows = [(i, f"http://a.org/news/{i}", f"<div>Site</div><article><h2>Intro</h2>{story(i, 'As we said')}<h2>Summary</h2></article><div>Rights</div>") for i in range(4)]
    shared = ("first", "first", "last", "last")  # each with one neighbour
    rows += [(10 + i, f"http://b.org/news/{i}", f"<div>Site</div>{story(10 + i, 'Said ' + shared[i])}<div>Rights</div>") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    plain = lambda h: " ".join(re.sub("<[^>]*>", " ", h).split())
    assert got == {i: plain(h).removeprefix("Site ").removesuffix(" Rights") for i, _, h in rows}


def test_a_short_article_in_a_long_shared_frame_loses_the_frame(spark):
    frame = "".join(f"<div><li>Entry {i}</li></div>" for i in range(10))
    rows = [(i, f"http://a.org/news/{i}", f"{frame}<article><p>Story number {i}</p></article>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story number {i}" for i in range(3)}


def test_lines_that_pages_repeat_within_their_articles_go(spark):
    story = lambda i: f"<p>{' '.join(f'word{i}x{k}' for k in range(40))}</p>"
    page = lambda i: f"<main><div class='x1'>The Site</div>{story(i)}<div class='x2'>Tell a friend</div>{story(i + 100)}<div>Written by the desk</div></main>"
    rows = [(i, f"http://a.org/news/{i}", page(i)) for i in range(4)]
    rows += [(10 + i, f"http://b.org/copy/{i}", page(7)) for i in range(2)]  # true copies
    rows += [(20 + i, f"http://c.org/edit/{i}", page(8).replace("word8x3", f"other{i}")) for i in range(2)]  # half of it edited
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    plain = lambda h: " ".join(re.sub("<[^>]*>", " ", h).split())
    assert {i: got[i] for i in range(4)} == {i: plain(story(i) + story(i + 100)) for i in range(4)}
    assert all(got[i] == plain(h) for i, _, h in rows if i >= 10)


def test_longest_common_subsequences():
    r = random.Random(4)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    for _ in range(400):
        a, b = ([r.randrange(6) for _ in range(r.randrange(0, 14))] for _ in range(2))
        found = sorted(html_text.common(a, b))
        assert len(found) == length(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)
