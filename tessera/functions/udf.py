"""User-defined function surface.

* ``register_typed`` turns a type-hinted Python function into a Spark UDF
  (Arrow-batched pandas UDF when ``vectorized``) registered under a name.
* ``validate_calls`` checks a log of tool calls (JSON arguments) against a
  table of declared arguments, as a join, on the JVM.
* ``batch_apply`` runs an opaque per-item function over a table with
  ``mapInPandas``, capturing errors per row instead of failing the job.
"""

from __future__ import annotations

import typing
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(),
           bytes: T.BinaryType()}


def spark_type(hint) -> T.DataType:
    """Spark type of a Python type hint (int, float, str, bool, bytes,
    list[...], dict[str, ...], Optional[...])."""
    origin = typing.get_origin(hint)
    args = typing.get_args(hint)
    if hint in _SIMPLE:
        return _SIMPLE[hint]
    if origin in (list, tuple) and args:
        return T.ArrayType(spark_type(args[0]))
    if origin is dict and len(args) == 2:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if origin is typing.Union or str(origin) == "<class 'types.UnionType'>":
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return spark_type(rest[0])
    raise TypeError(f"unsupported type hint {hint!r}")


def register_typed(spark: SparkSession, fn: Callable, name: str | None = None, vectorized: bool = False):
    """Register ``fn`` under ``name`` with the return type from its hints.

    With ``vectorized`` the function takes and returns whole pandas Series (its
    hints name the types of their values); a null argument gives null.
    """
    hints = typing.get_type_hints(fn)
    if "return" not in hints:
        raise TypeError(f"{fn.__name__} needs a return type hint")
    rtype = spark_type(hints["return"])

    if vectorized:
        @F.pandas_udf(rtype)
        def u(*cols: pd.Series) -> pd.Series:
            full = pd.concat(cols, axis=1).notna().all(axis=1)
            return fn(*[c[full] for c in cols]).reindex(cols[0].index)
    else:
        u = F.udf(fn, rtype)
    spark.udf.register(name or fn.__name__, u)
    return u


# ---------------------------------------------------------------- X2

JSON_KIND = {"BIGINT": "integer", "INT": "integer", "SMALLINT": "integer", "TINYINT": "integer",
             "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean",
             "VOID": "null"}


def json_kind(v: Column) -> Column:
    """Kind of a VARIANT value: integer, number, string, boolean, null, object, array."""
    s = F.schema_of_variant(v)
    out = F.lit("number")
    for k, kind in JSON_KIND.items():
        out = F.when(s == k, F.lit(kind)).otherwise(out)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(s.startswith("OBJECT"), F.lit("object")).when(s.startswith("ARRAY"), F.lit("array"))
            .when(s.startswith("DECIMAL"), F.lit("number")).otherwise(out))


def accepts(declared: Column, passed: Column) -> Column:
    return ((declared == passed) | (declared == "any")
            | ((declared == "number") & (passed == "integer")))


def validate_calls(calls: DataFrame, spec: DataFrame, call_id: str = "call_id", tool_col: str = "tool_name",
                   args_col: str = "arguments") -> DataFrame:
    """(call, argument, status) with status ok / missing / null_not_allowed /
    wrong_type / unknown. ``spec`` = (tool_name, arg_name, arg_type, nullable)."""
    parsed = calls.select(call_id, tool_col, F.from_json(F.col(args_col), "map<string,variant>").alias("__m"))
    declared = parsed.join(spec, tool_col)  # Spark broadcasts the declared arguments if they are small
    v = F.col("__m")[F.col("arg_name")]
    present = F.array_contains(F.map_keys("__m"), F.col("arg_name"))
    kind = json_kind(v)
    status = (F.when(~present, F.when(F.col("nullable"), F.lit("ok")).otherwise(F.lit("missing")))
              .when(kind == "null", F.when(F.col("nullable"), F.lit("ok")).otherwise(F.lit("null_not_allowed")))
              .when(accepts(F.col("arg_type"), kind), F.lit("ok")).otherwise(F.lit("wrong_type")))
    d = declared.select(call_id, tool_col, "arg_name", status.alias("status"))
    passed = parsed.select(call_id, tool_col, F.explode(F.map_keys("__m")).alias("arg_name"))
    unknown = (passed.join(spec.select(tool_col, "arg_name"), [tool_col, "arg_name"], "left_anti")
               .withColumn("status", F.lit("unknown")))
    return d.unionByName(unknown)


# ---------------------------------------------------------------- X3

def batch_apply(df: DataFrame, fn: Callable[[str], str], input_col: str, keep=(),
                output_col: str = "answer", error_col: str = "error") -> DataFrame:
    """Apply ``fn`` to every value of ``input_col`` inside the tasks;
    an exception becomes the row's error text (the answer is then null)."""
    keep = list(keep)
    fields = [df.schema[c] for c in keep] + [df.schema[input_col],
                                             T.StructField(output_col, T.StringType()),
                                             T.StructField(error_col, T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        for pdf in batches:
            answers, errors = [], []
            for x in pdf[input_col]:
                try:
                    answers.append(None if x is None else str(fn(x)))
                    errors.append(None)
                except Exception as e:  # captured per row, like the reference's run loop
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            out = pdf[keep + [input_col]].copy()
            out[output_col] = answers
            out[error_col] = errors
            yield out

    return df.select(*keep, input_col).mapInPandas(run, schema)
