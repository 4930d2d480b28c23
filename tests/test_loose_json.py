import pytest
from pyspark.sql import functions as F

from quillmetry.functions.loose_json import loose_object


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": "x", "b": "y", "c": "z"}', {"a": "x", "b": "y"}),
        ('Here:\n```json\n{"a": "x"}\n```\nbye', {"a": "x"}),
        ("{'a': 'x', b: 'y'}", {"a": "x", "b": "y"}),
        ('{“a”: “x”}', {"a": "x"}),
        ('{"a": "bad \\u12 escape"}', {"a": "bad 12 escape"}),
        ('{"a": "one", "b": "no end', {"a": "one"}),
        ("nothing here", None),
        ("", None),
        (None, None),
    ],
)
def test_loose_object(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(loose_object(F.col("t"), ["a", "b"]).alias("m")).first()
    assert row.m == want
