import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Names that operators use inside, as columns of the input.
CLASHES = ["n_tokens", "score", "id", "th", "row", "slice", "bucket", "part", "kept", "length"]


def _odd_rows():
    """Nulls in every column, empty, short and very long texts, ties and repeated rows."""
    rnd = random.Random(7)
    words = ["the", "of", "alpha", "beta.", "gamma,", "Delta", "é", "straße", "naïve", "mit", "license", "#", "42"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = prose(160)
    near = base.replace("alpha", "omega", 2)
    passage = prose(60)
    texts = [
        (1, base), (2, near), (3, base), (3, base), (None, base), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
        (8, "mit license " * 3 + "\n" + prose(80)), (9, prose(40) + "\n" + passage + "\n" + prose(40)),
        (10, prose(50) + " " + passage), (11, "x" * 30_000), (12, ("lorem ipsum " * 20_000).strip()), (13, prose(30_000)),
        (14, "line\nline\nline\n\n  \nline"), (15, "日本語 テキスト 中文"), (16, "12 34 !!"), (None, None), (17, "a b \x00 c d"),
        (18, "Released under the MIT License."), (19, "<|endoftext|> <|startoftext|> x"), (20, "▁ space ▁▁ mark"),
        (21, "aaaa " * 200), (22, "aaaa " * 200 + "b"), (-5, prose(70)), (23, "ß" * 120 + " " + "ß" * 120),
    ]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t),
             *(str(k) for _ in CLASHES)) for k, (i, t) in enumerate(texts)]


ODD_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])


@pytest.fixture(scope="session")
def odd_rows():
    return _odd_rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"], r["lang"]) for r in small.collect()]
