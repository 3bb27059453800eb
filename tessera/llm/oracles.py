"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

import string

from .licenses import BASE_PHRASES, TELLING, TEMPLATES, THRESHOLD, step_for
from .quality import (
    COMMON_WORDS,
    LEAST_WORDS,
    MAX_CHAR_DISTANCE,
    MAX_WORD_DISTANCE,
    MIN_CHARS,
    MIN_WORDS,
    MOST_REPEATED,
)

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_sql() -> str:
    """All blocks against all templates, without any filter."""
    def words(text: str) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in text.lower()).split()

    places = " || ".join(
        f"list_transform(list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: w[i:i + {len(p.split()) - 1}] = {_quoted(p.split())}), "
        f"lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in BASE_PHRASES.items())
    templates = ", ".join(f"('{label}', {_quoted(sorted(set(words(text))))}, "
                          f"{_quoted(sorted(TELLING.get(label, set()) & set(words(text))))}::VARCHAR[])" for label, text in TEMPLATES)
    step = step_for(TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
base AS (SELECT *, {places} AS found FROM d),
blocks AS (SELECT r, list_distinct(w[s + 1:s + {2 * step}]) AS b FROM d, LATERAL (SELECT unnest(range(0, greatest(1, len(w) - {step}), {step})) AS s)),
templates AS (SELECT * FROM (VALUES {templates}) t(label, t, telling)),
hits AS (SELECT r, list(DISTINCT label) AS more, max(n / len(t)) AS score
         FROM (SELECT r, label, t, len(list_intersect(b, t)) AS n FROM blocks, templates WHERE list_has_all(b, telling))
         WHERE n >= ceil(len(t) * {THRESHOLD} - 1e-9) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(found) AS BIGINT) AS n_base,
  list_min(list_transform(found, lambda f: f.at)) AS first_word, list_max(list_transform(found, lambda f: f.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(found, lambda f: f.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(found, lambda f: f.label) || coalesce(more, []))), ',') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM base LEFT JOIN hits USING (r)"""


#: All pairs of shingle sets that share a shingle, and the classes they connect.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
item AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (SELECT a.node AS a, b.node AS b FROM item a JOIN item b ON a.x = b.x AND a.node <> b.node
          GROUP BY a.node, b.node, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
class AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n_links FROM links GROUP BY a)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, coalesce(n.node, s.doc_id) AS copy_id, coalesce(g.n_links, 0) AS n_links
FROM s LEFT JOIN nodes n ON s.s = n.s LEFT JOIN class c ON n.node = c.node LEFT JOIN degree g ON n.node = g.node"""

_SPACE = "[\\x09-\\x0D ]+"
#: Patterns of the character classes, by Unicode category.
_CLASSES = ["\\p{Lu}", "\\p{Ll}", "\\p{Lt}\\p{Lm}\\p{Lo}", "\\p{N}", "\\p{P}", "\\p{S}", "\\p{Z}\\x09-\\x0D", "\\p{M}"]


def _divergence(p: str, q: str) -> str:
    """Jensen-Shannon distance of two columns of shares, summed over the rows of a group."""
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, sum({half(p)} + {half(q)}) / 2))"


def _quality_sql() -> str:
    classes = ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in _CLASSES)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS w,
             list_filter(string_split_regex({_LOWER.replace("coalesce(text, '')", "t")}, '{_SPACE}'), lambda x: x <> '') AS lw,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D ]')) AS lines FROM d),
windows AS (SELECT r, i, w[i:i + 2] AS x FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS c FROM windows), range(0, 3) o(j)
          WHERE c > 1 GROUP BY r),
base AS (SELECT w.r, doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\\x09-\\x0D ]', '', 'g')) AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN again USING (r)),
chars AS (SELECT r, lang, length(t) AS total, unnest(c || [length(t) - list_sum(c)]) AS n, unnest(range(0, {len(_CLASSES) + 1})) AS class
          FROM (SELECT *, [{classes}] AS c FROM d)),
char_ref AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM chars WHERE lang IS NOT NULL GROUP BY lang, class),
by_char AS (SELECT c.r, f.lang, {_divergence("(c.n / c.total)", "f.q")} AS x FROM chars c JOIN char_ref f USING (class)
            WHERE c.total >= {MIN_CHARS} GROUP BY c.r, f.lang),
word_n AS (SELECT r, any_value(lang) AS lang, x, count(*) AS n FROM (SELECT r, lang, unnest(lw) AS x FROM w) GROUP BY r, x),
word_all AS (SELECT lang, x, sum(n) AS n FROM word_n WHERE lang IS NOT NULL GROUP BY lang, x),
common AS (SELECT lang, x, n / total AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS rank,
             sum(n) OVER (PARTITION BY lang) AS total FROM word_all) WHERE rank <= {COMMON_WORDS}),
pairs AS (SELECT b.r, l.lang, b.n_words FROM base b, (SELECT DISTINCT lang FROM common) l WHERE b.n_words >= {MIN_WORDS}),
named AS (SELECT p.r, p.lang, c.q, coalesce(n.n, 0) / p.n_words AS p FROM pairs p JOIN common c ON p.lang = c.lang
          LEFT JOIN word_n n ON n.r = p.r AND n.x = c.x),
bins AS (SELECT r, lang, p, q FROM named UNION ALL
         SELECT r, lang, 1 - sum(p), 1 - sum(q) FROM named GROUP BY r, lang),
by_word AS (SELECT r, lang, {_divergence("p", "q")} AS x FROM bins GROUP BY r, lang),
nearest_char AS (SELECT r, min(x) AS x, arg_min(lang, (x, lang)) AS lang FROM by_char GROUP BY r),
nearest_word AS (SELECT r, min(x) AS x, arg_min(lang, (x, lang)) AS lang FROM by_word GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND coalesce(c.x <= {MAX_CHAR_DISTANCE}, true) AND coalesce(v.x <= {MAX_WORD_DISTANCE}, true) AS kept,
  coalesce(v.lang, c.lang) AS nearest_lang, round(c.x, 9) AS char_distance, round(v.x, 9) AS word_distance
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS failed FROM base) b
LEFT JOIN nearest_char c USING (r) LEFT JOIN nearest_word v USING (r)"""


ORACLES = {"op5_quality_rules": _quality_sql(), "op1_license_scans": _license_sql(), "op8_ngram_jaccard_join": NEAR_DUPLICATES}
