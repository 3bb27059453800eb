"""Corpus helpers: chunking, substring joins, viewports, HTML."""

from pyspark.sql import functions as F

from tessera.functions.chunking import chunk_with_starts
from tessera.functions.html import html_to_markdown
from tessera.operators import corpus as C
from tessera.operators.textjoin import substring_matches


def test_chunks_are_substrings_within_size():
    text = ("Para one is here.\n\n" + "word " * 300 + "\nLast line. Another sentence.") * 3
    chunks = chunk_with_starts(text, 200, 20)
    assert chunks
    for start, chunk in chunks:
        assert len(chunk) <= 200
        assert text[start:start + len(chunk)] == chunk


def test_substrings(spark):
    hay = spark.createDataFrame([(1, "the quick brown fox"), (2, "lazy dog"), (3, "quick quick é日"), (4, None), (5, "")], "h long, t string")
    nee = spark.createDataFrame([(10, "quick"), (11, "dog"), (12, "cat"), (13, "the quick brown fox jumps"), (14, "é"), (15, "日"),
                                 (16, ""), (17, None), (18, "the quick brown fox")], "n long, s string")
    got = sorted(tuple(r) for r in substring_matches(hay, "h", "t", nee, "n", "s").collect())
    assert got == [(1, 10, 5), (1, 18, 1), (2, 11, 6), (3, 10, 1), (3, 14, 13), (3, 15, 14)]


def test_substrings_of_a_text_of_a_megabyte(spark):
    import random
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(2_500_000))
    nee = [(i, text[p: p + n]) for i, (p, n) in enumerate([(0, 40), (1_048_570, 30), (2_499_990, 10), (1_500_000, 1_000_000)])]
    nee += [(9, "x" * 30), (10, text[:20] + "x")]
    hay = spark.createDataFrame([(1, text), (2, text[:1000])], "h long, t string")
    got = sorted(tuple(r) for r in substring_matches(hay, "h", "t", spark.createDataFrame(nee, "n long, s string"), "n", "s").collect())
    assert got == sorted((h, n, t.find(s) + 1) for h, t in ((1, text), (2, text[:1000])) for n, s in nee if s in t)


def test_viewports_end_on_whitespace(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb cccc"), (2, "")], "id long, t string")
    vp = {(r["id"], r["page_index"]): (r["start"], r["end"]) for r in C.viewports(df, "id", "t", 3).collect()}
    assert vp[(1, 0)] == (0, 5) and vp[(1, 1)] == (5, 10) and vp[(1, 2)] == (10, 14)
    assert vp[(2, 0)] == (0, 0)


def test_find_query_normalization():
    assert C.normalize_find_query("the*of") == " the.*of "
    assert C.normalize_find_query("hello * world") == " hello.* world "
    assert C.normalize_find_query("  ") is None


def test_find_query_stars():
    assert C.normalize_find_query("the *of") == " the .*of "
    assert C.normalize_find_query("a * * b") == " a.* .* b "
    assert C.normalize_find_query("*") == ".* "
    assert C.normalize_find_query("One, two!") == " one two "


def test_search_results_are_not_split(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb cccc", True), (2, "aaaa bbbb", False), (3, None, True)], "id long, t string, w boolean")
    vp = sorted((r["id"], r["n_pages"], r["content"]) for r in C.viewports(df, "id", "t", 3, whole=F.col("w")).collect())
    assert vp == [(1, 1, "aaaa bbbb cccc"), (2, 2, "aaaa "), (2, 2, "bbbb")]


def test_find_from_each_pages_own_viewport(spark):
    df = spark.createDataFrame([(1, "cat dog cat dog ", 2), (2, "cat dog cat dog ", 0)], "id long, t string, at int")
    vp = C.viewports(df, "id", "t", 3).join(df.select("id", "at"), "id")
    got = {r["id"]: (r["first_match"], r["next_match"]) for r in C.find_on_pages(vp, "id", {"q": "cat"}, "at").collect()}
    assert got == {1: (2, 0), 2: (0, 2)}


def test_links_in_all_quote_forms(spark):
    html = "<a href='/s'>one</a> <a href=/b class=x>two</a> <A HREF=\"https://d/\"><b>three</b></A> <a data-href='/no'>x</a> <a href='mailto:q'>m</a>"
    rows = C.page_links(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("link_index").collect()
    assert [(r["href"], r["text"], r["kept"]) for r in rows] == [
        ("/s", "one", True), ("/b", "two", True), ("https://d/", "three", True), ("mailto:q", "m", False)]


def test_visits_resolve_against_the_prior_address(spark):
    rows = [(1, 1, "http://a/x/y", "/z"), (1, 2, "http://b/p/q", "r/s"), (1, 3, "http://c/", "../up"), (1, 4, "http://d/", "https://e/"),
            (2, 1, "http://f/", "g")]
    df = spark.createDataFrame(rows, "s long, o long, url string, href string")
    got = [r["resolved"] for r in C.resolve_visits(df, "s", ["o"], "url", "href").orderBy("s", "o").collect()]
    assert got == ["/z", "http://a/x/r/s", "http://b/up", "https://e/", "g"]


def test_vectors_and_bm25_in_blocks(spark, monkeypatch):
    import random
    rnd = random.Random(1)
    vec = [(i, [rnd.random() for _ in range(4)]) for i in range(60)]
    docs = [(i, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12)))) for i in range(50)]
    v, d = spark.createDataFrame(vec, "id long, v array<float>"), spark.createDataFrame(docs, "id long, t string")
    q = v.where("id < 7").selectExpr("id AS qid", "v AS qv")
    dq = d.where("id < 9").selectExpr("id AS qid", "t AS qt")
    run = lambda: (sorted(map(tuple, C.vector_top_k(v, "id", "v", q, "qid", "qv", 3).collect())),
                   sorted(map(tuple, C.bm25_top_k(d, ["id"], "t", dq, "qid", "qt", 4).collect())))
    whole = run()
    monkeypatch.setattr(C.query_blocks, "__defaults__", None)
    monkeypatch.setattr(C.query_blocks, "__kwdefaults__", {"size": 2})
    assert run() == whole and len(whole[0]) == 21
    near = {r[0]: r[1] for r in whole[0] if r[3] == 1}
    assert near == {i: i for i in range(7)}


def test_html_to_markdown():
    html = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><h1>Head</h1>'
            '<p>Text <a href="javascript:x()">js</a> <a href="/a b">rel</a><!-- c --></p>'
            '<img src="data:image/png;base64,AAAA" alt="i"></body></html>')
    title, md = html_to_markdown(html)
    assert title == "T"
    assert "# Head" in md and "[rel](/a%20b)" in md and "js" in md and "javascript" not in md
    assert "![i](data:image/png;base64...)" in md and "var t" not in md


def test_long_pages_are_whole():
    body = "word " * 30_000
    title, md = html_to_markdown(f"<html><head><title>T</title></head><body><p>{body}</p></body></html>")
    assert md == body.strip()
    video, md = html_to_markdown("<title>T</title>", url="http://youtube.com/watch?v=1")
    assert not md.startswith("# YouTube")


def test_top_k_ties_by_key(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 4, 2.0), (2, 1, 0.5)], "q long, d long, s double")
    got = sorted((r["q"], r["rank"], r["d"]) for r in C.top_k(df, ["q"], "s", ["d"], 2).collect())
    assert got == [(1, 1, 4), (1, 2, 3), (2, 1, 1)]


def test_site_routes():
    wiki = ('<html><head><title>X - Wikipedia</title></head><body><div id="nav">menu</div>'
            '<span class="mw-page-title-main">Spark</span><div id="mw-content-text"><div><p>Body <b>bold</b></p></div>'
            '</div><div>footer</div></body></html>')
    title, md = html_to_markdown(wiki, url="https://en.wikipedia.org/wiki/Spark")
    assert title == "Spark" and md.startswith("# Spark") and "Body **bold**" in md
    assert "menu" not in md and "footer" not in md
    yt = ('<html><head><title>Vid</title><meta name="keywords" content="a,b">'
          '<meta itemprop="interactionCount" content="42"><meta name="description" content="About"></head></html>')
    title, md = html_to_markdown(yt, url="https://www.youtube.com/watch?v=1")
    assert md.startswith("# YouTube\n\n## Vid") and "- **Views:** 42" in md and "### Description\nAbout" in md


def test_cluster_conf_scales_with_input():
    from tessera.session import cluster_conf
    small, big = cluster_conf(10 * 1024 ** 3), cluster_conf(100 * 1024 ** 4)
    assert int(big["spark.sql.shuffle.partitions"]) > int(small["spark.sql.shuffle.partitions"]) >= 200


def test_bm25_index_against_plain_scores(spark):
    """Odd white space, null and empty units, ties, few and many shards, queries beyond one pass."""
    import math
    import random
    from collections import Counter

    from tessera.operators import bm25
    rnd = random.Random(4)
    units = [(i % 7, i, rnd.choice([None, "", " \t　 ", "a a", "b\x1ca c", " ".join(rnd.choices("abcdefg", k=rnd.randint(1, 9)))]))
             for i in range(300)]
    queries = [(i, rnd.choice(["a b", "", None, "zz", "c c c a", "g　f"])) for i in range(12)]
    words = [(u or "").split() for _, _, u in units]
    n, mean = len(units), sum(map(len, words)) / len(units)
    df = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    want = []
    for q, text in queries:
        asked, scored = Counter((text or "").split()), []
        for (a, b, _), ws in zip(units, words):
            tf = Counter(ws)
            if tf.keys() & asked.keys():
                scored.append((-sum(math.floor(m * idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) * 1e9 + 0.5)
                                    for t, m in asked.items() if t in tf), a, b))
        want += [(q, a, b, r + 1) for r, (_, a, b) in enumerate(sorted(scored)[:4])]
    d = spark.createDataFrame(units, "a long, b long, t string").repartition(3)
    dq = spark.createDataFrame(queries, "qid long, qt string")
    for shard_units, scores in ((4096, 1 << 22), (7, 10)):
        index = bm25.Bm25Index(d, ["a", "b"], "t", shard_units=shard_units, scores=scores)
        got = C.bm25_search(index, dq, "qid", "qt", 4)
        assert sorted((r["qid"], r["a"], r["b"], r["rank"]) for r in got.collect()) == sorted(want)
    assert C.bm25_top_k(d.where("a > 9"), ["a", "b"], "t", dq, "qid", "qt", 4).collect() == []
    assert C.bm25_top_k(d, ["a", "b"], "t", dq.where("qid > 99"), "qid", "qt", 4).collect() == []


def test_bm25_adds_up_no_more_postings_at_once_than_it_may():
    import numpy as np

    from tessera.operators.bm25 import _steps
    postings = np.array([0, 900, 50, 60, 5000, 0, 0, 10] + [400] * 50)
    steps = list(_steps(postings, 100, 1000))
    assert [x for low, high in steps for x in range(low, high)] == list(range(len(postings)))
    assert all((postings[low:high].sum() <= 1000 or high == low + 1) and (high - low) * 100 <= 1000 for low, high in steps)
    assert list(_steps(np.array([], np.int64), 100, 1000)) == []


def test_bm25_shards_lie_in_small_row_groups(spark, monkeypatch):
    """A shard is a row of some MB, so the writer may not wait for a hundred of them."""
    import pyarrow.parquet as pq

    from tessera.operators import bm25
    monkeypatch.setattr(bm25, "SHARD_FILES", {**bm25.SHARD_FILES, "parquet.block.size": "4096"})
    words = F.expr("concat_ws(' ', transform(sequence(1, 60), x -> cast(xxhash64(id, x) as string))) AS t")
    d = spark.range(0, 200, 1, 1).select("id", words)
    index = bm25.Bm25Index(d, ["id"], "t", shard_units=1)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.shards.inputFiles()]
    assert sum(m.num_rows for m in groups) == 200
    assert all(m.row_group(i).num_rows <= 20 for m in groups for i in range(m.num_row_groups))


def test_chunks_of_ids_beyond_doubles_and_without_id(spark):
    """Rows go through Arrow a slice at a time: an id stays what it is beside a null one."""
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big, "a b", "s"), (None, "c", None), (3, None, "s"), (4, "", "s")], "id long, t string, s string").coalesce(1)
    got = C.chunk_documents(df, "id", "t", 500, 50, keep=["s"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(big, "s", 0, 0, "a b"), (None, None, 0, 0, "c")], key=str)
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_viewports_leave_python_a_slice_at_a_time(spark):
    df = spark.createDataFrame([(1, "aa bb cc "), (None, ""), (2, None)], "id long, t string").coalesce(1)
    vp = C.viewports(df, "id", "t", 3)
    assert sorted((tuple(r)[:6] for r in vp.collect()), key=str) == sorted(
        [(1, 0, 3, 0, 3, "aa "), (1, 1, 3, 3, 6, "bb "), (1, 2, 3, 6, 9, "cc "), (None, 0, 1, 0, 0, "")], key=str)
    assert "MapInArrow" in vp._jdf.queryExecution().toString()


def test_text_slices_are_bounded_in_bytes():
    import pyarrow as pa

    from tessera.operators.bm25 import SHARD_BYTES, text_slices
    batch = pa.RecordBatch.from_pydict({"t": ["x" * (SHARD_BYTES // 4)] * 30 + [None, "", "y" * (2 * SHARD_BYTES), "z"]})
    slices = list(text_slices([batch], "t"))
    assert pa.Table.from_batches(slices).column("t").to_pylist() == batch.column("t").to_pylist()
    assert all(s.num_rows == 1 or sum(len(x or "") for x in s.column("t").to_pylist()) <= SHARD_BYTES for s in slices)
