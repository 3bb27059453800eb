"""Text functions (F15-F22) on the reference's literal examples."""

import json

from pyspark.sql import functions as F

from tessera.functions import text as TX


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("x")).first()["x"]


def test_parse_json_blob(spark):
    r = _one(spark, 'With text before{"simple": "json"}And text after', TX.parse_json_blob)
    assert r["status"] == "ok" and r["prefix"] == "With text before" and r["json"] == '{"simple": "json"}'
    assert _one(spark, "}}", TX.parse_json_blob)["status"] in ("no_blob", "invalid_json")
    assert _one(spark, "} and {", TX.parse_json_blob)["status"] == "invalid_json"
    assert _one(spark, 'simple": "json"}', TX.parse_json_blob)["status"] == "no_blob"
    assert _one(spark, "no braces", TX.parse_json_blob)["status"] == "no_blob"


def test_tool_call_from_text(spark):
    r = _one(spark, 'Action: {"name": "search", "arguments": {"q": 3}}', TX.tool_call_from_text)
    assert r["name"] == "search" and r["arguments"] == '{"q":3}' and r["status"] == "ok"


def test_extract_code(spark):
    text = "<code>\nFoo\n</code>\ntext\n<code>\ncode_a\n</code>\n<code>code_b</code>"
    assert _one(spark, text, TX.extract_code)["code"] == "Foo\n\ncode_a\n\ncode_b"
    fenced = "Thought\n```python\nprint(1)\n```"
    assert _one(spark, fenced, TX.extract_code)["code"] == "print(1)"
    assert _one(spark, "Wrong blob!", TX.extract_code)["status"] == "no_code"
    assert _one(spark, "x = 1", TX.extract_code)["code"] == "x = 1"


def test_stop_sequences(spark):
    assert _one(spark, "Hello<code>world!", lambda c: TX.cut_at_stop_sequences(c, ["<code>"])) == "Hello"
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(TX.cut_at_stop_sequences(F.col("s"), ["<code>"])).first()[0] is None


def test_truncation(spark):
    s = "abcdefghij"
    mid = _one(spark, s, lambda c: TX.truncate_middle(c, 5))
    assert mid.startswith("ab") and mid.endswith("hij") and "below 5 characters" in mid
    assert _one(spark, s, lambda c: TX.truncate_middle(c, 20)) == s
    assert _one(spark, s, lambda c: TX.truncate_tail(c, 4)).startswith("abcd\n")


def test_imports_and_policy(spark):
    code = "import numpy as np\nfrom os.path import join\ntry:\n    import secret\nexcept ImportError:\n    pass\nimport .rel"
    got = sorted(_one(spark, code, TX.code_imports))
    assert got == ["numpy", "os"]
    df = spark.createDataFrame([("os",), ("os.path",), ("collections.abc",), ("sys",)], "m string")
    allowed = [r[0] for r in df.select(TX.import_authorized(F.col("m"), ["os.path", "collections.*"])).collect()]
    assert allowed == [True, True, True, False]
    star = [r[0] for r in df.select(TX.import_authorized(F.col("m"), ["*"])).collect()]
    assert all(star)


def test_python_white_space(spark):
    from tessera.functions.scoring import is_float, normalize_str, to_float
    odd = "  a b 　"
    assert _one(spark, odd, TX.strip_ws) == odd.strip()
    assert _one(spark, odd, normalize_str) == "ab"
    assert _one(spark, " 1_000 ", is_float) is True and _one(spark, " 1_000 ", to_float) == 1000.0


def test_lenient_json(spark):
    blob = 'x {"a": "two\nlines\tand \\"quotes\\" \\\\", \n "b": [1, 2]} y'
    r = _one(spark, blob, TX.parse_json_blob)
    assert r["status"] == "ok"
    assert json.loads(r["json"]) == json.loads(blob[2:-2], strict=False)
    t = _one(spark, '{"name": "f", "arguments": "{\\"q\\": 3}"}', TX.tool_call_from_text)
    assert t["arguments"] == '{"q": 3}'
    assert _one(spark, '{"name": "f", "arguments": "abc"}', TX.tool_call_from_text)["arguments"] == "abc"


def _lenient(blob):
    try:
        return json.loads(blob, strict=False)
    except json.JSONDecodeError:
        return None


ODD_JSON = [
    '{"a": "x\x1by"}', '{"a": "x\x0by"}', '{"b": "' + "\\\\" * 9 + '", "a": "q\nr"}', '{"a":1,"a":2}', '{"a": NaN}',
    '{"a": "' + "\\\\" * 500 + '"}', '{"a": "' + "\\\\" * 500 + '\\"}', '{"a": -Infinity, "b": [Infinity, NaN]}', '{NaN: 1}', '{"a": xNaN}',
    '{"a": "NaN \t"}', '{"a": "\\\n"}', '{"a": "\\q"}', "{'a': 1}", '{"a": "it\'s"}', '{"a": 1} x}', '{"a":1}] , [{}', '{"a":1}}],[{"b":{"c":1}',
    '{"a":1},{"b":2}', '{"a": "\ue000\x01"}', '{"a": \ue0001}', '{"a":1,}', '{"a":\x0b1}', '{\n "a":\t[1,\r\n 2]}', '{"a":01}', '{"\x1fk": {"k": "\x00"}}',
    '{"a": "b" "c"}', '{}', '{"a": {"x": 1, "x": {"y": "\x02"}}, "a": 3}', '{"a": "\u2028é\U0001f600\x7f"}', '{"a":"\\u00e9\\/\\b"}',
]


def test_json_like_a_lenient_parser(spark):
    df = spark.createDataFrame(list(enumerate(ODD_JSON)), "n int, s string").select("n", TX.parse_json_blob("s").alias("p"))
    same = lambda x: str(x).replace("'nan'", "nan").replace("'NaN'", "nan").replace("'Infinity'", "inf").replace("'-Infinity'", "-inf")
    for r in df.collect():
        want = _lenient(ODD_JSON[r["n"]])
        assert (r["p"]["status"] == "ok") == (want is not None), ODD_JSON[r["n"]]
        if want is not None:
            assert same(json.loads(r["p"]["json"])) == same(want)


def test_several_calls_in_one_blob(spark):
    status = lambda x: _one(spark, x, TX.parse_json_blob)["status"]
    assert status('{"name": "a", "arguments": {"q": "},\n"}},\n{"name": "b"}') == "multiple_tool_calls"
    assert status('Action: {"name": "a}"},\n{"name": broken}') == "multiple_tool_calls"
    assert status('{"name": "a"}, {"name": "b"}') == "invalid_json"
    assert status('{"name": a},\n{"name": "b"}') == "invalid_json"
    assert status('{"x": {"name": "a"},\n "y"}') == "invalid_json"


def test_last_of_repeated_keys_counts(spark):
    r = _one(spark, '{"name": "a", "arguments": {"q": 1}, "name": "b\x1b", "arguments": {"q": [2, "\t"]}}', TX.tool_call_from_text)
    assert (r["name"], r["arguments"], r["status"]) == ("b\x1b", '{"q":[2,"\\t"]}', "ok")
    r = _one(spark, '{"name": "a", "name": null}', TX.tool_call_from_text)
    assert (r["name"], r["arguments"], r["status"]) == (None, None, "missing_name")
    assert _one(spark, '{"name": "a", "arguments": NaN}', TX.tool_call_from_text)["arguments"] == "NaN"


def test_guarded_imports(spark):
    code = "import torch\nif is_flash_attn_2_available():\n    from flash_attn import x\n    from flash_attn.y import z\nimport numpy"
    assert "flash_attn" not in _one(spark, code, TX.code_imports)
    assert "torch" in _one(spark, code, TX.code_imports)
