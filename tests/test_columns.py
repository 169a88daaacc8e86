import datetime

import pytest
from pyspark.sql import functions as F

from credence.functions.columns import (
    date_prefix,
    json_text,
    lenient,
    number_flag,
    parse_metadata,
    parse_roles,
    stripped,
    with_external_id,
)


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_stripped_removes_every_kind_of_white_space(spark):
    assert one(spark, " \t 7700 \n", "string", stripped) == "7700"
    assert one(spark, 5000, "int", stripped) == "5000"
    assert one(spark, None, "string", stripped) is None


def test_lenient_cast_gives_null_for_malformed_numbers(spark):
    assert one(spark, "n/a", "string", lambda c: lenient(c, "double")) is None
    assert one(spark, "12.5", "string", lambda c: lenient(c, "double")) == 12.5


def test_date_prefix(spark):
    assert one(spark, "2001-02-03T10:00:00", "string", date_prefix) == datetime.date(2001, 2, 3)
    assert one(spark, "", "string", date_prefix) is None
    assert one(spark, None, "string", date_prefix) is None
    with pytest.raises(Exception):
        one(spark, "yesterday!", "string", date_prefix)


def test_number_flag(spark):
    assert one(spark, 0.0, "double", number_flag) is False
    assert one(spark, 2.0, "double", number_flag) is True
    assert one(spark, float("nan"), "double", number_flag) is True
    assert one(spark, None, "double", number_flag) is None


def test_external_id_replaces_the_stored_one(spark):
    row = spark.createDataFrame([({"a": "1", "external_id": "old"}, "new")], "m map<string,string>, e string")
    assert row.select(with_external_id(F.col("m"), F.col("e")).alias("r")).first()["r"] == {"a": "1", "external_id": "new"}


def test_json_text_and_back(spark):
    df = spark.createDataFrame([(["risk_manager"], {"linked_inn": "77"}, 1)], "roles array<string>, m map<string,string>, n int")
    text = json_text(df)
    assert dict(text.dtypes) == {"roles": "string", "m": "string", "n": "int"}
    back = text.select(parse_roles(F.col("roles")).alias("r"), parse_metadata(F.col("m")).alias("m")).first()
    assert back["r"] == ["risk_manager"] and back["m"] == {"linked_inn": "77"}


def test_json_defaults_and_type_errors(spark):
    assert one(spark, "  ", "string", parse_metadata) == {}
    assert one(spark, None, "string", parse_roles) == []
    for text, parse in (("[1]", parse_metadata), ('{"a":1}', parse_roles), ("broken", parse_metadata)):
        with pytest.raises(Exception):
            one(spark, text, "string", parse)
