import json

import pytest
from pyspark.sql import functions as F

from nodeloom.functions import metadata, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, expected", [(None, False), ("", False), (" \t\n", False), (" ", False), ("　", False), ("\x1c", False), ("​", True), ("x", True), ("None", True)])
def test_has_text(spark, value, expected):
    assert one(spark, text.has_text, value) is expected


@pytest.mark.parametrize("value, expected", [("Please   PROVIDE the\ntranscript", True), ("please provide details", False), ("send me raw materials", True), ("Once you share it", True), (None, False), ("", False)])
def test_asks_for_source(spark, value, expected):
    assert one(spark, text.asks_for_source, value) is expected


@pytest.mark.parametrize("value, expected", [("  Ann  O'Neil ", "ann-o-neil"), ("--", "podcast"), ("ΟΔΟΣ x", "οδοσ-x"), ("A_b", "a-b"), (None, "podcast")])
def test_slug(spark, value, expected):
    assert one(spark, text.slug, value) == expected


@pytest.mark.parametrize("value, expected", [("a/b:c", "a b c"), ("???", "Podcast Export"), (" x   y ", "x y"), ("a\x01b\\c", "a b c")])
def test_folder_name(spark, value, expected):
    assert one(spark, text.folder_name, value) == expected


@pytest.mark.parametrize(
    "meta, expected",
    [
        ({"speaker": " Ann ", "speakers": ["Bob", "Ann"]}, ["Ann", "Bob"]),
        ({"speaker": "Mixed"}, []),
        ({"speaker": " unknown "}, ["unknown"]),
        ({"speakers": "A, unknown ,B"}, ["A", "B"]),
        ({"speakers": '["A",1,null]'}, ["A"]),
        ({"speakers": ["A", 1, None, " "]}, ["A"]),
        ({"speakers": "123"}, []),
        ({"speakers": '"Bob"'}, []),
        ({"speakers": '{"a":1}'}, []),
        ({"speakers": "['A','B']"}, ["['A'", "'B']"]),
        ({"speakers": None, "speaker": 3}, []),
        ({}, []),
    ],
)
def test_speakers(spark, meta, expected):
    assert one(spark, lambda x: metadata.speakers(F.parse_json(x)), json.dumps(meta)) == expected


@pytest.mark.parametrize("value, expected", [(0, False), ("0", True), (None, False), ("", False), (False, False), ([], False), ([1], True), (0.0, False), (True, True)])
def test_truthy(spark, value, expected):
    assert one(spark, lambda x: metadata.truthy(metadata.field(F.parse_json(x), "k")), json.dumps({"k": value})) is expected


def test_flat_metadata(spark):
    rows = {"a": None, "b": True, "c": 3, "d": 1.5, "e": [1, "é"], "f": "t"}
    found = json.loads(one(spark, metadata.flat_json, json.dumps(rows)))
    assert found == {"a": "", "b": True, "c": 3, "d": 1.5, "e": '[1, "\\u00e9"]', "f": "t"}
    assert one(spark, metadata.flat_json, None) == "{}"
