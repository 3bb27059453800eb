"""Document corpus preparation and retrieval.

* Chunking, viewports and HTML conversion are per-document Python helpers run with
  ``mapInArrow`` or ``mapInPandas``: Spark partitions the corpus, nothing is collected.
* BM25 has an inverted index (``bm25``), vector search compares units where they
  are; both take blocks of queries whose size is set, and only the best of a shard
  or batch are shuffled.
* Per-query top-k is a window with a row limit, which Spark applies in each
  partition before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunking import DEFAULT_SEPARATORS, chunk_with_starts
from ..functions.html import html_to_markdown, route_for_url
from ..session import cut_lineage
from .bm25 import BM25_B, BM25_EPSILON, BM25_K1, Bm25Index, text_slices
from .ordered import as_of, lag_values

# Characters a viewport may end on (fixed values of the reference).
VIEWPORT_END = re.compile("[ \t\r\n]")
#: Queries that are sent to all tasks at once; more are worked off in blocks.
QUERY_BLOCK = 4096
# Retrieved-documents text block (fixed values of the reference).
RETRIEVED_HEADER = "\nRetrieved documents:\n"
RETRIEVED_ITEM = "\n\n===== Document {i} =====\n"


# ------------------------------------------------------------------ chunking

def chunk_documents(docs: DataFrame, id_col: str, text_col: str, chunk_size: int = 500,
                    chunk_overlap: int = 50, separators=DEFAULT_SEPARATORS, keep=()) -> DataFrame:
    """One row per chunk (id, chunk_index, start_index, chunk, *keep)."""
    keep = list(keep)
    fields = [docs.schema[id_col]] + [docs.schema[c] for c in keep] + [
        T.StructField("chunk_index", T.IntegerType()), T.StructField("start_index", T.IntegerType()),
        T.StructField("chunk", T.StringType())]
    schema = T.StructType(fields)
    seps = tuple(separators)

    def run(batches):
        for rows in text_slices(batches, text_col):  # a task holds the chunks of a slice
            row, index, starts, chunks = [], [], [], []
            for at, text in enumerate(rows.column(text_col).to_pylist()):
                for i, (start, chunk) in enumerate(chunk_with_starts(text, chunk_size, chunk_overlap, seps) if text else ()):
                    row.append(at)
                    index.append(i)
                    starts.append(start)
                    chunks.append(chunk)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(row) for c in (id_col, *keep)), pa.array(index, pa.int32()),
                                              pa.array(starts, pa.int32()), pa.array(chunks, pa.string())], names=schema.names)

    return docs.select(id_col, *keep, text_col).mapInArrow(run, schema)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraph units (split on newlines), for retrieval over whole texts."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("para_idx", "text"))


def with_source_part(docs: DataFrame, prefix: str, source_col: str = "source") -> DataFrame:
    """Documents whose source starts with ``prefix``, with the second part of
    the source's path as ``source_part``."""
    return docs.where(F.col(source_col).startswith(prefix)).withColumn("source_part", F.split(source_col, "/")[1])


def dedupe_exact(units: DataFrame, text_col: str, order_cols) -> DataFrame:
    """Keep the first unit (by ``order_cols``) of every exact text. An
    aggregate with partial combination, so a text repeated very often does
    not pile up in one task."""
    cols = units.columns
    best = units.groupBy(F.col(text_col).alias("__t")).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order_cols])).alias("__r"))
    return best.select("__r.*")


# ------------------------------------------------------------------ top-k

def top_k(df: DataFrame, group_cols, score_col: str, tie_cols, k: int, descending: bool = True) -> DataFrame:
    """Best ``k`` rows per group by score (ties by ``tie_cols``
    ascending) with ``rank`` 1..k. Spark keeps ``k`` rows of a group in each
    partition before it brings them together (WindowGroupLimit)."""
    s = F.col(score_col).desc() if descending else F.col(score_col).asc()
    w = Window.partitionBy(*group_cols).orderBy(s, *[F.col(c).asc() for c in tie_cols])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame, *columns: str, size: int = QUERY_BLOCK) -> Iterator[list]:
    """The queries in blocks of ``size`` rows; the driver holds one at a time."""
    block = []
    for r in queries.select(*columns).toLocalIterator():
        block.append(tuple(r))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


# ------------------------------------------------------------------ BM25

def bm25_top_k(units: DataFrame, unit_keys, text_col: str, queries: DataFrame, query_key: str,
               query_text: str, k: int = 10, k1: float = BM25_K1, b: float = BM25_B,
               epsilon: float = BM25_EPSILON) -> DataFrame:
    """D5 + T4: the ``k`` best units per query by BM25Okapi (ties by unit key) of
    those that share a term with it; each query token counts once per occurrence.
    Scores are sums of whole 1e-9, so they do not depend on the order of the terms."""
    return bm25_search(Bm25Index(units, unit_keys, text_col, k1, b, epsilon), queries, query_key, query_text, k)


def bm25_search(index: Bm25Index, queries: DataFrame, query_key: str, query_text: str, k: int = 10) -> DataFrame:
    """``bm25_top_k`` over an index that is there already."""
    best = None
    for block in query_blocks(index.asked(queries, query_key, query_text), query_key, "terms"):
        part = index.best(queries.schema[query_key], block, k)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = index.best(queries.schema[query_key], [], k)
    return top_k(best, [query_key], "score", index.unit_keys, k)


def retrieved_text(ranked: DataFrame, query_key: str, text_col: str, rank_col: str = "rank") -> DataFrame:
    """The retrieved-documents text block per query (items numbered from 0
    in rank order)."""
    before, after = RETRIEVED_ITEM.split("{i}")
    item = F.concat(F.lit(before), (F.col(rank_col) - 1).cast("string"), F.lit(after), F.col(text_col))
    return ranked.select(query_key, rank_col, item.alias("__item")).groupBy(query_key).agg(
        F.concat(F.lit(RETRIEVED_HEADER),
                 F.expr(f"listagg(__item, '') WITHIN GROUP (ORDER BY {rank_col})")).alias("retrieved"))


# ------------------------------------------------------------------ vectors

def vector_top_k(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str,
                 query_vec: str, k: int = 3) -> DataFrame:
    """K nearest corpus vectors (squared L2) for each query vector.

    Blocks of query vectors go to all tasks; a task compares a batch of corpus
    rows with a block at once and keeps the ``k`` nearest of the batch for each
    query, which the final ranking brings together.
    """
    schema = T.StructType([queries.schema[query_id], corpus.schema[id_col], T.StructField("distance", T.DoubleType())])
    best = None
    for block in query_blocks(queries, query_id, query_vec):
        part = _nearest_block(corpus.select(id_col, vec_col), id_col, vec_col, block, k, schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = corpus.sparkSession.createDataFrame([], schema)
    return top_k(best, [query_id], "distance", [id_col], k, descending=False)


def _nearest_block(corpus, id_col, vec_col, block, k, schema) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(
        ([q for q, _ in block], np.array([v for _, v in block], np.float64)))  # QUERY_BLOCK vectors at most

    def run(batches):
        names, q = shared.value
        for pdf in batches:
            ids = pdf[id_col].to_numpy()
            for at in range(0, len(pdf), 1024):
                x = np.stack(pdf[vec_col].iloc[at: at + 1024].to_numpy()).astype(np.float64)
                own, distance = ids[at: at + 1024], np.zeros((len(x), len(q)))
                for d in range(x.shape[1]):  # in the order of the dimensions, as the sum is defined
                    step = x[:, d: d + 1] - q[:, d]
                    distance += step * step
                best = [np.lexsort((own, distance[:, j]))[:k] for j in range(len(q))]
                yield pd.DataFrame([(names[j], own[i], distance[i, j]) for j, rows in enumerate(best) for i in rows],
                                   columns=schema.names)

    return corpus.where(F.col(vec_col).isNotNull()).mapInPandas(run, schema)


# ------------------------------------------------------------------ viewports

def _viewport_bounds(text: str, size: int) -> list[tuple[int, int]]:
    """Start and end of the viewports of a text that is not empty."""
    bounds, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):  # on to the first break at or after the last character
            found = VIEWPORT_END.search(text, end - 1)
            end = found.end() if found else len(text)
        bounds.append((at, end))
        at = end
    return bounds


def viewports(docs: DataFrame, id_col: str, text_col: str, size: int, whole: Column | None = None) -> DataFrame:
    """D8 rows: (id, page_index, n_pages, start, end, content, header): texts in
    viewports of ``size`` characters, each extended to end on white space; an
    empty text is one empty viewport. Rows where ``whole`` holds (search results)
    are not split. The split is sequential within a text, so an Arrow function cuts
    the contents too, a slice of the texts at a time, and no text is copied for a viewport."""
    whole = F.coalesce(whole, F.lit(False)) if whole is not None else F.lit(False)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.IntegerType()) for c in ("page_index", "n_pages", "start", "end")),
                           T.StructField("content", T.StringType())])

    def run(batches):
        for rows in text_slices(batches, "__text"):  # a task holds the viewports of a slice
            row, spans, contents = [], [], []
            for at, (text, one) in enumerate(zip(rows.column("__text").to_pylist(), rows.column("__whole").to_pylist())):
                if text is None:
                    continue
                bounds = _viewport_bounds(text, size) if text and not one else [(0, len(text))]
                row += [at] * len(bounds)
                spans += [(i, len(bounds), a, b) for i, (a, b) in enumerate(bounds)]
                contents += [text[a:b] for a, b in bounds]
            columns = np.array(spans, np.int32).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row, pa.int64())), *map(pa.array, columns),
                                              pa.array(contents, pa.string())], names=schema.names)

    out = docs.select(id_col, F.col(text_col).alias("__text"), whole.alias("__whole")).mapInArrow(run, schema)
    return out.withColumn("header", F.concat(F.lit("Viewport position: Showing page "), (F.col("page_index") + 1).cast("string"),
                                             F.lit(" of "), F.col("n_pages").cast("string"), F.lit(".")))


WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def normalize_find_query(query: str) -> str | None:
    """The page-search pattern of a query, lower case: its words between
    single spaces; ``*`` within a word stands for any text, and one that stands
    alone belongs to the word before it. None for a query without words."""
    pattern, joined = "", False
    for word in re.findall(r"[\w*]+", query.lower()):
        joined = word == "*" and not joined
        pattern += word if joined else " " + word
    return pattern.replace("*", ".*") + " " if pattern else None


def normalized_content(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(" "), F.lower(F.trim(F.array_join(F.split(c, WORD_SPLIT, -1), " "))), F.lit(" "))


def find_on_pages(vp: DataFrame, id_col: str, queries: dict[str, str], start_page: int | str = 0) -> DataFrame:
    """Per (page, query) the first matching viewport from ``start_page`` (a
    number, or the column that has each page's current viewport) with
    wrap-around, and the next match after it (find-next)."""
    from_page = F.col(start_page) if isinstance(start_page, str) else F.lit(start_page)
    nc = vp.select(id_col, "page_index", "n_pages", from_page.alias("__from"), normalized_content("content").alias("__nc"))
    structs = []
    for name, q in queries.items():
        rx = normalize_find_query(q)
        if rx is None:
            continue
        structs.append(F.struct(F.lit(name).alias("query"), F.col("__nc").rlike(rx).alias("hit")))
    hits = nc.select(id_col, "page_index", "n_pages", "__from", F.inline(F.array(*structs))).where("hit")
    # hits (one row per matching viewport) feed two aggregates: write them once
    # to the shared checkpoint folder instead of recomputing the text pipeline
    hits = cut_lineage(hits.select(id_col, "page_index", "n_pages", "__from", "query"))
    first = hits.groupBy(id_col, "query").agg(
        F.min_by("page_index", F.struct((F.col("page_index") < F.col("__from")).alias("w"),
                                         F.col("page_index").alias("p"))).alias("first_match"),
        F.first("n_pages").alias("n_pages"))
    nxt = hits.join(first.select(id_col, "query", "first_match"), [id_col, "query"])
    nxt = nxt.join(first.select(id_col, "query", "n_pages").withColumnRenamed("n_pages", "__np"), [id_col, "query"])
    start = F.when(F.col("first_match") + 1 >= F.col("__np"), 0).otherwise(F.col("first_match") + 1)
    second = nxt.groupBy(id_col, "query").agg(F.min_by("page_index", F.struct(
        (F.col("page_index") < start).alias("w"), F.col("page_index").alias("p"))).alias("next_match"))
    return first.drop("n_pages").join(second, [id_col, "query"])


def _url_join_batch(base: pd.Series, ref: pd.Series) -> pd.Series:
    from urllib.parse import urljoin
    return pd.Series([None if r is None else (r if b is None else urljoin(b, r)) for b, r in zip(base, ref)])


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a (possibly relative) address against the previous one
    (pandas UDF created on first use)."""
    return F.pandas_udf(_url_join_batch, "string")(base, ref)


# ------------------------------------------------------------------ HTML

def pages_to_markdown(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(id, url, route, title, markdown) for every page."""
    schema = T.StructType([pages.schema[id_col], T.StructField(url_col, T.StringType()),
                           T.StructField("route", T.StringType()), T.StructField("title", T.StringType()),
                           T.StructField("markdown", T.StringType())])

    def run(batches):
        for pdf in batches:
            out = []
            for pid, url, html in zip(pdf[id_col], pdf[url_col], pdf[html_col]):
                title, md = html_to_markdown(html, url=url)
                out.append((pid, url, route_for_url(url), title, md))
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return pages.select(id_col, url_col, html_col).mapInPandas(run, schema)


#: An anchor: its address in double quotes, single quotes or none, and its content.
LINK_PATTERN = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>"


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, link_index, href, text, kept) for every anchor with an address;
    kept when the scheme is http/https/file or there is none (relative link)."""
    part = lambda i: F.regexp_extract_all(F.col(html_col), F.lit(LINK_PATTERN), i)
    found = F.arrays_zip(part(1).alias("double"), part(2).alias("single"), part(3).alias("bare"), part(4).alias("text"))
    z = pages.select(id_col, F.posexplode(found).alias("link_index", "l")).select(
        id_col, "link_index", F.concat("l.double", "l.single", "l.bare").alias("href"), F.col("l.text").alias("text"))
    scheme = F.lower(F.regexp_extract("href", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return z.select(id_col, "link_index", "href", F.trim(F.regexp_replace("text", r"<[^>]*>", "")).alias("text"),
                    ((scheme == "") | scheme.isin("http", "https", "file")).alias("kept"))


def resolve_visits(visits: DataFrame, session_col: str, order_cols, url_col: str, href_col: str) -> DataFrame:
    """Adds ``resolved``, the address that a visit asks for: an absolute one
    (http, https, file) as it is, a relative one against the address that the
    session visited before, and as it is when there was none."""
    prior = lag_values(visits, [session_col], list(order_cols), [url_col])
    href, before = F.col(href_col), F.col(f"prev_{url_col}")
    absolute = href.rlike("^(http:|https:|file:)")
    return prior.withColumn("resolved", F.when(absolute | before.isNull(), href).otherwise(url_join(before, href)))


# ------------------------------------------------------------------ J8

def nearest_snapshot(snapshots: DataFrame, key_col: str, ts_col: str, wanted: DataFrame,
                     wanted_col: str) -> DataFrame:
    """Per key the snapshot closest in time to a wanted timestamp
    (ties -> earlier); keys without a wanted time take their newest snapshot.
    Only the snapshots on either side of a wanted time are compared with it."""
    near = as_of(wanted.where(F.col(wanted_col).isNotNull()).select(key_col, wanted_col), wanted_col,
                 snapshots.select(key_col, ts_col), ts_col, [key_col])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sides = near.select(key_col, wanted_col, F.explode(F.array(f"before.{ts_col}", f"after.{ts_col}")).alias("__ts"))
    picked = sides.where("__ts is not null").groupBy(key_col).agg(
        F.min_by("__ts", F.struct(F.abs(micros("__ts") - micros(wanted_col)), "__ts")).alias("__ts"))
    newest = snapshots.groupBy(key_col).agg(F.max(ts_col).alias("__newest"))
    return newest.join(picked, key_col, "left").select(key_col, F.coalesce("__ts", "__newest").alias("snapshot_ts"))


# ------------------------------------------------------------------ search payloads

SEARCH_RESULT = "struct<title:string,url:string,description:string>"


def flatten_search_payload(payloads: DataFrame, id_col: str, payload_col: str, max_results: int = 10) -> DataFrame:
    """F25 + T6: ``web.results[]`` of a JSON search payload as ranked rows
    (rank from 1), cut to ``max_results``."""
    parsed = payloads.select(id_col, F.from_json(payload_col, f"struct<web:struct<results:array<{SEARCH_RESULT}>>>")
                             .alias("__p"))
    res = F.slice(F.coalesce(F.col("__p.web.results"), F.array().cast(f"array<{SEARCH_RESULT}>")), 1, max_results)
    return parsed.select(id_col, F.posexplode(res).alias("__i", "__r")).select(
        id_col, (F.col("__i") + 1).alias("rank"), "__r.title", "__r.url",
        F.coalesce(F.col("__r.description"), F.lit("")).alias("description"))


def search_markdown(payloads: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """the markdown block of a payload: "## Search Results" then
    "i. [title](url)\\ndescription" items (numbered from 1) separated by a
    blank line; "No results found." when empty. Built per payload from the
    payload's own array, no regrouping."""
    parsed = payloads.select(id_col, F.from_json(payload_col, f"struct<web:struct<results:array<{SEARCH_RESULT}>>>")
                             .alias("__p"))
    res = F.coalesce(F.col("__p.web.results"), F.array().cast(f"array<{SEARCH_RESULT}>"))
    items = F.transform(res, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". ["), r["title"], F.lit("]("),
                                                   r["url"], F.lit(")\n"), F.coalesce(r["description"], F.lit(""))))
    md = F.when(F.size(res) == 0, F.lit("No results found.")).otherwise(
        F.concat(F.lit("## Search Results\n\n"), F.array_join(items, "\n\n")))
    return parsed.select(id_col, md.alias("markdown"))


RSS_ITEM = "struct<title:string,link:string,description:string>"


def _rss_items(xml_col: str) -> Column:
    parsed = F.from_xml(xml_col, f"channel struct<item: array<{RSS_ITEM}>>", {"rowTag": "rss", "ignoreSurroundingSpaces": "false"})
    return F.coalesce(parsed["channel"]["item"], F.array().cast(f"array<{RSS_ITEM}>"))


def flatten_rss_payload(payloads: DataFrame, id_col: str, xml_col: str, max_results: int = 10) -> DataFrame:
    """F25 (RSS form) + T6: ``channel.item[]`` of an RSS document (parsed with
    ``from_xml``) as ranked rows, cut to ``max_results``."""
    items = F.slice(_rss_items(xml_col), 1, max_results)
    return payloads.select(id_col, F.posexplode(items).alias("__i", "__r")).select(
        id_col, (F.col("__i") + 1).alias("rank"), "__r.title", "__r.link", "__r.description")


def rss_markdown(payloads: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """F25, style without numbers: "## Search Results" then
    "[title](link)\\ndescription" items separated by blank lines."""
    p = payloads.select(id_col, _rss_items(xml_col).alias("__items"))
    items = F.transform("__items", lambda r: F.concat(F.lit("["), r["title"], F.lit("]("), r["link"], F.lit(")\n"), r["description"]))
    return p.select(id_col, F.concat(F.lit("## Search Results\n\n"), F.array_join(items, "\n\n")).alias("markdown"))


def organic_markdown(ranked: DataFrame, id_col: str, title: str = "title", link: str = "link",
                     snippet: str | None = "description", date: str | None = None,
                     source: str | None = None) -> DataFrame:
    """F25 (second style): "## Search Results\\n" then items numbered from 0,
    "i. [title](link)" + optional "\\nDate published: ..." / "\\nSource: ..." +
    "\\n" + optional "\\n<snippet>", joined by blank lines, per payload."""
    extra = F.lit("")
    if date:
        extra = F.concat(extra, F.when(F.col(date).isNotNull(), F.concat(F.lit("\nDate published: "), F.col(date)))
                         .otherwise(F.lit("")))
    if source:
        extra = F.concat(extra, F.when(F.col(source).isNotNull(), F.concat(F.lit("\nSource: "), F.col(source)))
                         .otherwise(F.lit("")))
    snip = (F.when(F.col(snippet).isNotNull(), F.concat(F.lit("\n"), F.col(snippet))).otherwise(F.lit(""))
            if snippet else F.lit(""))
    item = F.concat((F.col("rank") - 1).cast("string"), F.lit(". ["), F.col(title), F.lit("]("), F.col(link),
                    F.lit(")"), extra, F.lit("\n"), snip)
    return ranked.select(id_col, "rank", item.alias("__it")).groupBy(id_col).agg(
        F.concat(F.lit("## Search Results\n"),
                 F.expr("listagg(__it, '\\n\\n') WITHIN GROUP (ORDER BY rank)")).alias("markdown"))
