"""Text functions over model outputs and code, as Column
expressions. The only Python is ``is_python_source`` (the fallback of code
extraction), an Arrow-batched pandas UDF fed only the rows with no code block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
# White space as Python's ``str.strip`` and ``str.split`` have it, written out: a
# bare ``\s`` is ASCII only in Java and in RE2.
WHITESPACE = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
              r"\x{3000}]")
CODE_TAGS = ("<code>", "</code>")
FENCE_TAGS = ("```(?:python|py)", "\n```")
TRUNCATION_MARKER = "\n..._This content has been truncated to stay below {n} characters_...\n"
IMPORT_PATTERN = r"(?m)^\s*import\s+(\S+?)(?:\s+as\s+\S+)?\s*$"
FROM_IMPORT_PATTERN = r"(?m)^\s*from\s+(\S+)\s+import"
TRY_BLOCK_PATTERN = r"(?s)\s*try\s*:.*?except.*?:"
GUARDED_BLOCK_PATTERN = r"if is_flash_attn[a-zA-Z0-9_]+available\(\):\s*(from flash_attn\s*.*\s*)+"
IMPORT_TO_PACKAGE = {"wikipediaapi": "wikipedia-api"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(x), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that it uses several times, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- F15 / F16 ------------------------------------------------------------------

#: Stands for the backslash of an escape while a JSON text is taken apart (a private character).
_MARK = "\ue000"


def _json_parts(blob: Column) -> Column:
    """A JSON text split at the quotes that begin or end its strings: every second
    part is a string. Escapes are read from left to right, a backslash with the
    character after it, so runs of backslashes of any length come out right."""
    marked = F.regexp_replace(F.replace(blob, F.lit(_MARK), F.lit("\\ue000")), r"(?s)\\(.)", _MARK + "$1")
    return F.split(marked, f'(?<!{_MARK})"', -1)


def _outside_strings(parts: Column) -> Column:
    """The text with its strings emptied."""
    return F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), '""')


def strict_json(blob: Column) -> Column:
    """A JSON text as a lenient parser reads it, for strict ones: control characters
    inside strings become escapes; NaN and the infinities, which JSON has no
    numbers for, become the strings from which Spark reads them as doubles."""
    def string(x: Column) -> Column:
        out = x
        for code in range(32):
            out = F.regexp_replace(out, f"(?<!{_MARK})\\x{code:02x}", f"{_MARK}u{code:04x}")
        return F.when(x.rlike(r"[\x00-\x1f]"), out).otherwise(x)

    def outside(x: Column) -> Column:
        return F.regexp_replace(x, r"(?<![\w.+-])(NaN|-?Infinity)(?![\w.+-]|\s*:)", '"$1"')

    joined = F.array_join(F.transform(_json_parts(blob), lambda x, i: F.when(i % 2 == 1, string(x)).otherwise(outside(x))), '"')
    return F.when(blob.rlike(r"[\x00-\x1f]|NaN|Infinity"), F.replace(joined, F.lit(_MARK), F.lit("\\"))).otherwise(blob)


def _is_one_object(blob: Column) -> Column:
    """Whether a text in braces is one JSON object and nothing else. Spark's parsers
    stop at the end of the first value, so it is parsed within brackets of two
    kinds, which no text can close both; they also take strings in single quotes."""
    whole = F.lit(True)
    for before, after in (("[", "]"), ('[{"_":', "}]")):
        whole &= F.coalesce(F.json_array_length(F.concat(F.lit(before), blob, F.lit(after))) == 1, F.lit(False))
    return whole & F.when(blob.contains("'"), ~_outside_strings(_json_parts(blob)).contains("'")).otherwise(F.lit(True))


def _more_than_one_object(blob: Column) -> Column:
    """Whether a whole object is followed by a comma and a line break."""
    pieces = F.split(_outside_strings(_json_parts(blob)), r"(?<=\})", -1)
    opened = lambda x: F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))

    def step(state: Column, x: Column) -> Column:
        depth = state["depth"] + opened(x) - F.when(x.endswith("}"), 1).otherwise(0)
        ends_here = (state["end"] == 0) & (depth == 0) & x.endswith("}")
        return F.struct(depth.alias("depth"), (state["seen"] + 1).alias("seen"),
                        F.when(ends_here, state["seen"] + 1).otherwise(state["end"]).alias("end"))

    end = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end")), step)["end"]
    first = F.array_join(F.slice(pieces, F.lit(1), end), "")
    return (end > 0) & F.coalesce(F.get(pieces, end).startswith(",\n"), F.lit(False)) & _is_one_object(first)


def parse_json_blob(text) -> Column:
    """struct(json, prefix, status): text from the first ``{`` to the last
    ``}`` as strict JSON, the text before it, and status ok / no_blob /
    multiple_tool_calls / invalid_json. A repeated key stays in ``json``; its last
    value counts, as ``tool_call_from_text`` reads it."""
    s = _c(text)
    first = F.instr(s, "{")
    last = F.when(F.instr(F.reverse(s), "}") > 0, F.length(s) - F.instr(F.reverse(s), "}") + 1).otherwise(0)
    raw = F.when(last >= first, s.substr(first, last - first + 1)).otherwise(F.lit(""))
    prefix = F.when(first > 0, s.substr(F.lit(1), first - 1))
    read = lambda raw, blob: (F.when(s.isNull(), F.lit(None).cast("string"))
                              .when((first == 0) | (last == 0), F.lit("no_blob"))
                              .when(_is_one_object(blob), F.lit("ok"))
                              .when(_more_than_one_object(raw), F.lit("multiple_tool_calls")).otherwise(F.lit("invalid_json")))
    return _let(raw, lambda raw: _let(strict_json(raw), lambda blob: _let(read(raw, blob), lambda status: F.struct(
        F.when(status == "ok", blob).alias("json"), prefix.alias("prefix"), status.alias("status")))))


def tool_call_from_text(text, name_key: str = "name", arguments_key: str = "arguments") -> Column:
    """F16: struct(name, arguments, status) of a JSON tool call inside text; of a
    repeated key the last value counts. ``arguments`` is JSON text; a string
    argument that itself parses is unwrapped."""
    def value(members: Column, key: str) -> Column:
        keys = F.map_keys(members)
        return F.get(F.map_values(members), F.size(keys) - F.array_position(F.reverse(keys), key).cast("int"))

    def call(p: Column, members: Column) -> Column:
        name = value(members, name_key)
        status = (F.when(p["status"] != "ok", p["status"])
                  .when(name.isNull(), F.lit("missing_name")).otherwise(F.lit("ok")))
        return F.struct(name.alias("name"), value(members, arguments_key).alias("arguments"), status.alias("status"))

    # a map read from JSON keeps repeated keys, in order
    return _let(parse_json_blob(text), lambda p: _let(F.from_json(p["json"], "map<string,string>"), lambda m: call(p, m)))


# ---- F17 -------------------------------------------------------------------------

def _blocks(text: Column, open_tag: str, close_tag: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s){open_tag}(.*?){close_tag}"), 1)
    joined = F.array_join(F.transform(found, strip_ws), "\n\n")
    return F.when(F.size(found) > 0, joined)


def _parses_as_python(s: pd.Series) -> pd.Series:
    """True where the text parses as Python (null stays null)."""
    import ast

    def ok(t):
        if t is None:
            return None
        try:
            ast.parse(t)
            return True
        except (SyntaxError, ValueError):
            return False
    return s.map(ok)


_UDFS: dict = {}


def is_python_source(col: Column) -> Column:
    """Arrow-batched check (pandas UDF, created on first use so that importing
    this module on an executor needs no session)."""
    if "py" not in _UDFS:
        _UDFS["py"] = F.pandas_udf(_parses_as_python, "boolean")
    return _UDFS["py"](col)


def extract_code(text, tags=CODE_TAGS) -> Column:
    """struct(code, status): tagged blocks, else fenced python blocks,
    joined by a blank line; else the whole text if it parses as Python; else
    status no_code (or final_answer_hint when the text mentions both words)."""
    t = _c(text)
    blocks = F.coalesce(_blocks(t, *tags), _blocks(t, *FENCE_TAGS))
    needs_parse = F.when(blocks.isNull() | (blocks == ""), t)
    parses = F.coalesce(is_python_source(needs_parse), F.lit(False))
    has_blocks = blocks.isNotNull() & (blocks != "")
    code = F.when(has_blocks, blocks).when(parses, t)
    status = (F.when(t.isNull(), F.lit(None).cast("string")).when(code.isNotNull(), F.lit("ok"))
              .when(t.contains("final") & t.contains("answer"), F.lit("final_answer_hint"))
              .otherwise(F.lit("no_code")))
    return F.struct(code.alias("code"), status.alias("status"))


# ---- F18 - F20 ---------------------------------------------------------------------

def truncate_middle(text, max_length: int) -> Column:
    """keep the first n//2 and last ceil(n/2) characters with a marker."""
    t = _c(text)
    head, tail = max_length // 2, -(-max_length // 2)
    marker = TRUNCATION_MARKER.format(n=max_length)
    return F.when(F.length(t) <= max_length, t).otherwise(
        F.concat(F.substring(t, 1, head), F.lit(marker), F.substring(t, -tail, tail)))


def truncate_tail(text, max_length: int) -> Column:
    """keep the first n characters and a marker."""
    t = _c(text)
    return F.when(F.length(t) <= max_length, t).otherwise(
        F.concat(F.substring(t, 1, max_length), F.lit(TRUNCATION_MARKER.format(n=max_length))))


def cut_at_stop_sequences(text, stops) -> Column:
    """for each stop sequence in turn keep the text before its first
    occurrence; null stays null."""
    out = _c(text)
    for s in stops:
        if s:
            out = F.substring_index(out, s, 1)
    return out


# ---- F21 / F22 ---------------------------------------------------------------------

def code_imports(code) -> Column:
    """distinct top-level packages imported by a code text (try/except
    blocks and imports behind an availability guard removed first; relative
    imports skipped; known renames applied)."""
    c = F.regexp_replace(F.regexp_replace(_c(code), TRY_BLOCK_PATTERN, ""), GUARDED_BLOCK_PATTERN, "")
    names = F.concat(F.regexp_extract_all(c, F.lit(IMPORT_PATTERN), 1),
                     F.regexp_extract_all(c, F.lit(FROM_IMPORT_PATTERN), 1))
    names = F.filter(names, lambda n: ~n.startswith("."))
    top = F.transform(names, lambda n: F.split(n, r"\.")[0])
    mapping = F.create_map(*[x for kv in IMPORT_TO_PACKAGE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.array_distinct(F.transform(top, lambda n: F.coalesce(mapping[n], n)))


def code_import_paths(code) -> Column:
    """Full dotted module paths imported by a code text (for F22)."""
    c = F.regexp_replace(_c(code), TRY_BLOCK_PATTERN, "")
    return F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(IMPORT_PATTERN), 1),
                                     F.regexp_extract_all(c, F.lit(FROM_IMPORT_PATTERN), 1)))


def import_authorized(module, authorized: list[str]) -> Column:
    """walking the dotted path through the tree of authorized imports,
    a ``*`` node allows everything below it; the path must not leave the tree."""
    m = _c(module)
    allowed = F.array(*[F.lit(a) for a in authorized]) if authorized else F.array().cast("array<string>")
    parts = F.split(m, r"\.")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                           lambda i: F.when(i == 0, F.lit("*")).otherwise(
                               F.concat(F.array_join(F.slice(parts, 1, i), "."), F.lit(".*"))))
    star = F.exists(prefixes, lambda p: F.array_contains(allowed, p))
    inside = F.exists(allowed, lambda a: (a == m) | a.startswith(F.concat(m, F.lit("."))))
    return star | inside
