"""Main text of pages: the pages table against a plain reading, and pages made by hand."""

import html
import re

import pytest
from pyspark.sql import types as T

from tessera.llm import main_text
from tessera.llm.main_text import extract, main_texts, op12_html_extraction

SF = "/root/testdata/sf0.001"
PROSE = "This is what the people of the town said when they were told that it was to be so and that they had no more of it."


def one(page):
    return main_texts([page])[0][0]


def plainly(page):
    """Blocks of the article element, split at its block tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_every_page_of_the_table(spark):
    want = {r["page_id"]: (r["url"], plainly(r["html"])) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op12_html_extraction(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["url"], r["text"]) == want[r["page_id"]]
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("junk", [
    "<nav><a href=1>Home</a> the one and only</nav>", "<header><h1>Site of the day</h1></header>", "<footer>&copy; us</footer>",
    f"<aside><p>{PROSE}</p></aside>", f"<div class='sidebar left'><p>{PROSE}</p></div>", f"<div id=cookie-notice>{PROSE}</div>",
    f"<div class='ad'>{PROSE}</div>", f"<form><p>{PROSE}</p><input><button>Go</button></form>", "<script>if (a < b) '</p>'</script>",
    "<style>p > a {}</style>", f"<section class=\"comments\"><p>{PROSE}</p></section>", "<!-- <p>old</p> -->",
    f"<div role='complementary'>{PROSE}</div>", f"<noscript><p>{PROSE}</p></noscript>",
    "<ul><li><a href=/a>One thing</a></li><li><a href=/b>Another thing</a></li></ul>", f"<template><p>{PROSE}</p></template>",
])
def test_furniture_goes_with_and_without_an_article(junk):
    body = f"<h1>A title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE} Again.</p>"
    want = f"A title\n\n{PROSE}\n\nShort.\n\n{PROSE} Again."
    assert one(f"<html><body>{junk}<article>{body}</article>{junk}</body></html>") == want
    assert one(f"<html><body><article>{body}{junk}</article></body></html>") == want
    assert one(f"<html><body><main>{body}</main>{junk}</body></html>") == want
    assert one(f"<html><body>{junk}<div>{body}</div></body></html>") == want


def test_blocks_and_characters():
    assert one("<p>a&amp;b &lt;c&gt; caf&#233; &#x4e2d;&nbsp;x  \n y<br>z <b>bo</b>ld</p>") == "a&b <c> café 中 x y z bold"
    assert one("<article>loose text<p>one<p>two</article>") == "loose text\n\none\n\ntwo"
    assert one("<article><ul><li>one<li>two</ul><table><tr><td>3<td>4</table></article>") == "one\n\ntwo\n\n3\n\n4"
    assert one("<article><h2><a href=#x>Linked title</a></h2><p>x</p></article>") == "Linked title\n\nx"
    assert one("a < b and <3 you &amp") == "a < b and <3 you &"


def test_forgotten_and_stray_tags():
    assert one(f"<body><nav><ul><li><a href=1>x</a><article><p>{PROSE}</article>") == PROSE
    assert one(f"<div class=ad>Buy<article><p>{PROSE}</p></article>") == PROSE
    assert one(f"<div class='with sidebar'><article><p>{PROSE}</p></article></div>") == PROSE
    assert one(f"</div></p><article><p><b>{PROSE}</article></b>") == PROSE
    assert one("<article><p>kept<script>never ends <p>no") == "kept"
    assert one(f"<article><header class=entry-header><h1>T</h1></header><p>{PROSE}</p><footer>tags</footer></article>") == f"T\n\n{PROSE}"
    assert one("<article></article><p>Only this.</p>") == "Only this."
    assert one("<a title='x") == "<a title='x"


def test_second_pass_takes_the_nearest_label():
    links = "<p><a href=1>one link of many</a></p>" * 3
    long = f"<p>{PROSE}</p>"
    assert one(f"<div>{links}<p>near links</p>{links}{long}<p>near prose</p>{long}</div>") == f"{PROSE}\n\nnear prose\n\n{PROSE}"
    junk = "<p>" + "xq zzk " * 60 + "</p>"
    assert one(long + junk + long) == f"{PROSE}\n\n{PROSE}"
    assert one(f"<article>{long}{junk}</article>").startswith(PROSE + "\n\nxq")  # an article keeps it


def test_odd_rows(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("page_id", "url", "html", "text", "n_chars", "__x")])
    huge = "<article>" + f"<p>{PROSE}</p>" * 5_000 + "</article>"
    deep = "<div>" * 20_000 + PROSE
    rows = [("1", "u", None, "t", "9", "x"), (None, None, "", None, None, None), ("2", "u", "<p>x</p>", "t", None, "x"),
            ("2", "u", "<p>x</p>", "t", None, "x"), ("3", None, huge, None, "n", None), ("4", "u", deep, None, "n", None),
            ("5", "u", " \n\t ", "", "", ""), ("6", "u", "<nav>a</nav>", "", "", "")]
    got = extract(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]
    got = {r["page_id"]: r for r in got.collect()}
    assert [got[k]["text"] for k in ("1", None, "2", "4", "5", "6")] == ["", "", "x", PROSE, "", ""]
    assert got["3"]["text"] == "\n\n".join([PROSE] * 5_000) and got["3"]["n_kept"] == 5_000
    assert extract(spark.createDataFrame([], schema)).count() == 0


def test_reads_forms_of_attributes():
    assert main_text._role("div", " CLASS=Cookie-Banner ") == ("aside", False)
    assert main_text._role("div", " class='post-content header' ") == ("main", True)
    assert main_text._role("section", " role=\"navigation\"") == ("aside", True)
    assert main_text._role("body", " class='has ad'") == (None, False)
