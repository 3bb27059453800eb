"""Corpus and retrieval queries (family D) over documents, benchmark,
embeddings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.ordered import as_of
from ..sources.tables import read_table
from .oracle_views import WS_SQL
from .registry import register

CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
VIEWPORT = 1024
FIND_QUERIES = {"wild": "the*of", "two_words": "und der", "single": "que"}


def _docs(spark, sf_dir, cols=("doc_id", "text")):
    return read_table(spark, sf_dir, "documents", list(cols))


def _chunks(spark, sf_dir):
    return C.chunk_documents(_docs(spark, sf_dir, ("doc_id", "source", "text")), "doc_id", "text",
                             CHUNK_SIZE, CHUNK_OVERLAP, keep=["source"])


@register("D4_chunk_documents")
def chunks(spark, sf_dir):
    return _chunks(spark, sf_dir)


@register("U3_dedupe_chunks")
def dedupe_chunks(spark, sf_dir):
    return C.dedupe_exact(_chunks(spark, sf_dir), "chunk", ["doc_id", "start_index"])


PARA_SQL = """SELECT doc_id, CAST(i - 1 AS INTEGER) AS para_idx, parts[i] AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
     LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)"""


@register("U3_dedupe_paragraphs",
          f"""SELECT doc_id, para_idx, text FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, para_idx) AS rn FROM ({PARA_SQL}) p) WHERE rn = 1""")
def dedupe_paragraphs(spark, sf_dir):
    return C.dedupe_exact(C.paragraphs(_docs(spark, sf_dir), "doc_id", "text"), "text", ["doc_id", "para_idx"])


def _bm25_sql(units_sql: str, keys: list[str], k: int = 10, final: str | None = None) -> str:
    """BM25 top-k in SQL; ``final`` replaces the last SELECT (CTE ``top`` holds the ranked rows)."""
    kk = ", ".join(keys)
    ku = ", ".join(f"u.{c}" for c in keys)
    body = final or "SELECT * FROM top"
    return f"""
WITH units AS ({units_sql}),
toks AS (SELECT {kk}, list_filter(regexp_split_to_array(text, '{WS_SQL}+'), lambda x: x <> '') AS t FROM units),
dl AS (SELECT {kk}, len(t) AS dl FROM toks),
tf AS (SELECT {kk}, term, count(*) AS tf FROM (SELECT {kk}, unnest(t) AS term FROM toks) GROUP BY ALL),
nd AS (SELECT term, count(*) AS nd FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, ln((SELECT n FROM stats) - nd + 0.5) - ln(nd + 0.5) AS idf FROM nd),
mean AS (SELECT CAST(sum(CAST(idf AS DECIMAL(38,18))) AS DOUBLE) / count(*) AS m FROM raw),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT m FROM mean) ELSE idf END AS idf FROM raw),
qt AS (SELECT item_id, term, count(*) AS qc FROM (
         SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '{WS_SQL}+'), lambda x: x <> '')) AS term
         FROM benchmark) GROUP BY item_id, term),
scores AS (
  SELECT q.item_id, {ku},
    sum(CAST(round(q.qc * i.idf * (u.tf * 2.5) / (u.tf + 1.5 * (0.25 + 0.75 * d.dl / (SELECT avgdl FROM stats))) * 1e9)
             AS BIGINT)) / 1e9 AS score
  FROM qt q JOIN idf i ON q.term = i.term JOIN tf u ON u.term = q.term JOIN dl d USING ({kk})
  GROUP BY q.item_id, {ku}),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {kk}) AS INTEGER) AS rank
                       FROM scores) WHERE rank <= {k})
{body}"""


@register("D5_T4_bm25_top10_paragraphs", _bm25_sql(PARA_SQL, ["doc_id", "para_idx"]))
def bm25_paragraphs(spark, sf_dir):
    units = C.paragraphs(_docs(spark, sf_dir), "doc_id", "text")
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return C.bm25_top_k(units, ["doc_id", "para_idx"], "text", bench, "item_id", "text", k=10)


@register("D5_T4_bm25_top10_chunks", headline=True)
def bm25_chunks(spark, sf_dir):
    units = _chunks(spark, sf_dir)
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return C.bm25_top_k(units, ["doc_id", "chunk_index"], "chunk", bench, "item_id", "text", k=10)


@register("D7_retrieved_text_paragraphs",
          _bm25_sql(PARA_SQL, ["doc_id", "para_idx"], final="""
SELECT item_id, chr(10) || 'Retrieved documents:' || chr(10) || string_agg(chr(10) || chr(10) || '===== Document '
       || CAST(rank - 1 AS VARCHAR) || ' =====' || chr(10) || u.text, '' ORDER BY rank) AS retrieved
FROM top JOIN units u USING (doc_id, para_idx) GROUP BY item_id"""))
def retrieved(spark, sf_dir):
    units = C.paragraphs(_docs(spark, sf_dir), "doc_id", "text")
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    top = C.bm25_top_k(units, ["doc_id", "para_idx"], "text", bench, "item_id", "text", k=10)
    return C.retrieved_text(top.join(units, ["doc_id", "para_idx"]), "item_id", "text")


QUERY_VECTORS_SQL = """SELECT label AS query_label, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label"""


@register("D6_T5_vector_top3",
          f"""SELECT * FROM (
  SELECT query_label, vec_id, distance,
         CAST(row_number() OVER (PARTITION BY query_label ORDER BY distance, vec_id) AS INTEGER) AS rank FROM (
    SELECT q.query_label, e.vec_id,
      list_reduce(list_transform(range(1, len(e.embedding) + 1),
        lambda i: (CAST(q.qv[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) * (CAST(q.qv[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE))),
        lambda a, b: a + b) AS distance
    FROM embeddings e, ({QUERY_VECTORS_SQL}) q)) WHERE rank <= 3""")
def vector_search(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    queries = emb.groupBy(F.col("label").alias("query_label")).agg(
        F.min_by("embedding", "vec_id").alias("qv"))
    return C.vector_top_k(emb, "vec_id", "embedding", queries, "query_label", "qv", k=3)


VP_SQL = f"""
WITH RECURSIVE vp(doc_id, page_index, s, e, n, text) AS (
  SELECT doc_id, 0, 0, CASE WHEN source = 'src0' THEN length(text) ELSE {{end0}} END, length(text), text FROM documents
  UNION ALL
  SELECT doc_id, page_index + 1, e, {{endn}}, n, text FROM vp WHERE e < n
)"""


def _end_sql(pos: str, n: str) -> str:
    e0 = f"least({pos} + {VIEWPORT}, {n})"
    run = f"length(regexp_extract(substring(text, {e0}), '^[^ \\t\\r\\n]*'))"
    return f"CASE WHEN {e0} >= {n} THEN {e0} ELSE least({e0} + {run}, {n}) END"


VIEWPORTS_SQL = VP_SQL.format(end0=_end_sql("0", "length(text)"), endn=_end_sql("e", "n")) + """
SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_pages,
  CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", substring(text, s + 1, e - s) AS content,
  'Viewport position: Showing page ' || CAST(page_index + 1 AS VARCHAR) || ' of '
    || CAST(count(*) OVER (PARTITION BY doc_id) AS VARCHAR) || '.' AS header
FROM vp"""


def _viewports(spark, sf_dir):
    # documents of one source stand for search results, which are not split
    docs = _docs(spark, sf_dir, ("doc_id", "source", "text"))
    return C.viewports(docs, "doc_id", "text", VIEWPORT, whole=F.col("source") == "src0")


@register("D8_D10_viewports", VIEWPORTS_SQL)
def viewports(spark, sf_dir):
    return _viewports(spark, sf_dir)


def _find_sql():
    qs = " UNION ALL ".join(f"SELECT '{name}' AS query, '{C.normalize_find_query(q)}' AS rx"
                            for name, q in FIND_QUERIES.items() if C.normalize_find_query(q))
    return VP_SQL.format(end0=_end_sql("0", "length(text)"), endn=_end_sql("e", "n")) + f""",
vps AS (SELECT doc_id, page_index, count(*) OVER (PARTITION BY doc_id) AS n_pages,
               substring(text, s + 1, e - s) AS content FROM vp),
qs AS ({qs}),
hits AS (SELECT v.doc_id, v.page_index, v.n_pages, q.query FROM vps v, qs q
         WHERE regexp_matches(' ' || lower(trim(array_to_string(regexp_split_to_array(v.content, '[^\\p{{L}}\\p{{N}}_]+'), ' '))) || ' ', q.rx)),
firsts AS (SELECT doc_id, query, min(page_index) AS first_match, any_value(n_pages) AS np FROM hits GROUP BY doc_id, query)
SELECT f.doc_id, f.query, CAST(f.first_match AS INTEGER) AS first_match,
  CAST(arg_min(h.page_index, (CASE WHEN h.page_index < CASE WHEN f.first_match + 1 >= f.np THEN 0 ELSE f.first_match + 1 END
                              THEN 1 ELSE 0 END) * 1000000 + h.page_index) AS INTEGER) AS next_match
FROM firsts f JOIN hits h ON f.doc_id = h.doc_id AND f.query = h.query
GROUP BY f.doc_id, f.query, f.first_match"""


@register("D9_find_on_page", _find_sql())
def find_on_page(spark, sf_dir):
    return C.find_on_pages(_viewports(spark, sf_dir), "doc_id", FIND_QUERIES)


@register("D1_D3_pages_to_markdown")
def pages_markdown(spark, sf_dir):
    return C.pages_to_markdown(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


# tag by tag, with plain string functions for the address
LINKS_SQL = r"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS link_index, href, trim(regexp_replace(body, '<[^>]*>', '', 'g')) AS text,
  (strpos(href, ':') = 0 OR NOT regexp_matches(split_part(href, ':', 1), '^[A-Za-z][A-Za-z0-9+.-]*$')
   OR lower(split_part(href, ':', 1)) IN ('http', 'https', 'file')) AS kept
FROM (SELECT page_id, i, CASE substring(attr, 1, 1) WHEN chr(34) THEN split_part(substring(attr, 2), chr(34), 1)
               WHEN chr(39) THEN split_part(substring(attr, 2), chr(39), 1) ELSE regexp_extract(attr, '^[^ \t\r\n>]+') END AS href,
             regexp_extract(tag, '(?is)^<a[^>]*>(.*)</a>$', 1) AS body
      FROM (SELECT page_id, i, tags[i] AS tag, regexp_extract(tags[i], '(?is)^<a\s(?:[^>]*\s)?href\s*=\s*(.*)$', 1) AS attr
            FROM (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>'),
                                              lambda t: regexp_matches(t, '(?is)^<a\s(?:[^>]*\s)?href\s*=')) AS tags FROM pages) p,
                 LATERAL (SELECT unnest(range(1, len(tags) + 1)) AS i)))"""


@register("D2_page_links", LINKS_SQL)
def page_links(spark, sf_dir):
    return C.page_links(read_table(spark, sf_dir, "pages", ["page_id", "html"]))


VISITED_SQL = """
WITH visits AS (SELECT e.user_id AS session_id, e.event_id, e.ts, p.page_id, p.url FROM events e
                JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)),
clicks AS (SELECT page_id, arg_min(href, link_index) AS href FROM ({links}) l WHERE kept GROUP BY page_id),
asked AS (SELECT v.*, CASE WHEN v.event_id % 2 = 0 THEN v.url ELSE c.href END AS href
          FROM visits v LEFT JOIN clicks c ON v.page_id = c.page_id),
prior AS (SELECT *, lag(url) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM asked)
SELECT session_id, event_id, href, CASE
  WHEN starts_with(href, 'http:') OR starts_with(href, 'https:') OR starts_with(href, 'file:') OR before IS NULL THEN href
  ELSE regexp_extract(before, '^[a-z]+://[^/?#]+') || href END AS resolved FROM prior"""


@register("D10_resolve_relative_links", VISITED_SQL.format(links=LINKS_SQL))
def resolve_links(spark, sf_dir):
    # a session asks for a page's own address or for the first link of the page
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"])
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    n_pages = pages.count()
    clicks = C.page_links(pages).where("kept").groupBy("page_id").agg(F.min_by("href", "link_index").alias("click"))
    visits = (ev.join(pages.select("page_id", "url"), F.pmod(ev.event_id, F.lit(n_pages)) == pages.page_id)
              .join(clicks, "page_id", "left")
              .select(F.col("user_id").alias("session_id"), "event_id", "ts", "url",
                      F.when(F.col("event_id") % 2 == 0, F.col("url")).otherwise(F.col("click")).alias("href")))
    return C.resolve_visits(visits, "session_id", ["ts", "event_id"], "url", "href").select(
        "session_id", "event_id", "href", "resolved")


SNAP_SQL = """
WITH snaps AS (SELECT p.url, e.ts FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)),
wanted AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN NULL
                            ELSE TIMESTAMP '2024-01-10 00:00:00' + to_hours(page_id) END AS wanted_ts FROM pages)
SELECT s.url, coalesce(arg_min(s.ts, CASE WHEN w.wanted_ts IS NOT NULL
                                        THEN abs(epoch_us(s.ts) - epoch_us(w.wanted_ts)) * 1.0 END),
                       max(s.ts)) AS snapshot_ts
FROM snaps s LEFT JOIN wanted w ON s.url = w.url GROUP BY s.url"""


@register("J8_nearest_snapshot", SNAP_SQL)
def nearest(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    n_pages = pages.count()
    snaps = ev.join(pages, F.pmod(ev.event_id, F.lit(n_pages)) == pages.page_id).select("url", "ts")
    wanted = pages.select("url", F.when(F.col("page_id") % 3 == 0, F.lit(None).cast("timestamp_ntz"))
                          .otherwise(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
                                     + F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("wanted_ts"))
    return C.nearest_snapshot(snaps, "url", "ts", wanted, "wanted_ts")


@register("J8_views_around_each_purchase", """
WITH bought AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
seen AS (SELECT user_id, ts FROM events WHERE event_type = 'view')
SELECT b.event_id, b.user_id, b.ts, p.ts AS previous_view, n.ts AS next_view
FROM bought b ASOF LEFT JOIN seen p ON b.user_id = p.user_id AND b.ts >= p.ts
              ASOF LEFT JOIN seen n ON b.user_id = n.user_id AND b.ts < n.ts""")
def views_around(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    bought = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = ev.where("event_type = 'view'").select("user_id", "ts")
    return as_of(bought, "ts", seen, "ts", ["user_id"]).select(
        "event_id", "user_id", "ts", F.col("before.ts").alias("previous_view"), F.col("after.ts").alias("next_view"))


PAYLOAD_SQL = """
WITH items AS (
  SELECT CAST(trunc(page_id / 10) AS BIGINT) AS payload_id, page_id,
         regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url,
         'Page ' || CAST(page_id AS VARCHAR) || ' in ' || regexp_extract(url, '/([a-z]{2})/', 1) AS description
  FROM pages),
res AS (SELECT payload_id, list({'title': title, 'url': url, 'description': description} ORDER BY page_id) AS r
        FROM items GROUP BY payload_id)"""


@register("F25_T6_search_results_ranked",
          PAYLOAD_SQL + """
SELECT payload_id, CAST(i AS INTEGER) AS rank, r[i].title AS title, r[i].url AS url, r[i].description AS description
FROM res, LATERAL (SELECT unnest(range(1, least(len(r), 5) + 1)) AS i)""")
def search_ranked(spark, sf_dir):
    from ..sources.fixtures import search_payloads
    return C.flatten_search_payload(search_payloads(spark, sf_dir), "payload_id", "payload", max_results=5)


@register("F25_search_results_markdown",
          PAYLOAD_SQL + """
SELECT payload_id, '## Search Results' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(r) + 1),
  lambda i: CAST(i AS VARCHAR) || '. [' || r[i].title || '](' || r[i].url || ')' || chr(10) || r[i].description),
  chr(10) || chr(10)) AS markdown FROM res""")
def search_md(spark, sf_dir):
    from ..sources.fixtures import search_payloads
    return C.search_markdown(search_payloads(spark, sf_dir), "payload_id", "payload")


@register("P6_source_prefix_filter_with_path_part",
          """SELECT doc_id, path AS source, string_split(path, '/')[2] AS source_part, n_chars
FROM (SELECT *, 'src/' || substring(source, 4) AS path FROM documents) d WHERE starts_with(path, 'src/1')""")
def source_prefix(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"])
    path = F.concat(F.lit("src/"), F.substring("source", 4, 100))  # sources as paths
    return C.with_source_part(d.withColumn("source", path), "src/1").select("doc_id", "source", "source_part", "n_chars")


RSS_SQL = """
WITH items AS (
  SELECT CAST(trunc(page_id / 10) AS BIGINT) AS payload_id, page_id,
         regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS link, 'Page ' || CAST(page_id AS VARCHAR) AS description,
         CAST(row_number() OVER (PARTITION BY CAST(trunc(page_id / 10) AS BIGINT) ORDER BY page_id) AS INTEGER) AS rank
  FROM pages)"""


@register("F25_T6_rss_results_ranked",
          RSS_SQL + "\nSELECT payload_id, rank, title, link, description FROM items WHERE rank <= 5")
def rss_ranked(spark, sf_dir):
    from ..sources.fixtures import rss_payloads
    return C.flatten_rss_payload(rss_payloads(spark, sf_dir), "payload_id", "rss", max_results=5)


@register("F25_rss_results_markdown",
          RSS_SQL + """
SELECT payload_id, '## Search Results' || chr(10) || chr(10) || string_agg('[' || title || '](' || link || ')' || chr(10)
  || description, chr(10) || chr(10) ORDER BY rank) AS markdown FROM items GROUP BY payload_id""")
def rss_markdown(spark, sf_dir):
    from ..sources.fixtures import rss_payloads
    return C.rss_markdown(rss_payloads(spark, sf_dir), "payload_id", "rss")


@register("F25_organic_results_markdown",
          RSS_SQL + """
SELECT payload_id, '## Search Results' || chr(10) || string_agg(CAST(rank - 1 AS VARCHAR) || '. [' || title || '](' || link
  || ')' || chr(10) || chr(10) || description, chr(10) || chr(10) ORDER BY rank) AS markdown
FROM items GROUP BY payload_id""")
def organic_markdown(spark, sf_dir):
    from ..sources.fixtures import rss_payloads
    return C.organic_markdown(C.flatten_rss_payload(rss_payloads(spark, sf_dir), "payload_id", "rss"), "payload_id")
