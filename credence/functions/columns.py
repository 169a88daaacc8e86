"""Column expressions for cleaning, casting and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stripped(col: Column) -> Column:
    """Text without leading or trailing white space of any kind (trim() removes U+0020 only)."""
    return F.regexp_replace(col.cast("string"), r"(?U)^\s+|\s+$", "")


def lenient(col: Column, to: str) -> Column:
    """Cast where malformed input becomes NULL instead of an error."""
    return col.try_cast(to)


def date_prefix(col: Column) -> Column:
    """DATE from the first ten characters; NULL and '' give NULL, malformed text raises."""
    text = col.cast("string")
    return F.to_date(F.substring(F.nullif(text, F.lit("")), 1, 10))


def number_flag(col: Column) -> Column:
    """Numeric flag to BOOLEAN: NULL stays NULL, zero is false, the rest (NaN too) is true."""
    return col.cast("double") != F.lit(0.0)


def chunk_node_id(external_id: Column) -> Column:
    return F.concat(F.lit("chunk:"), external_id)


def with_external_id(metadata: Column, external_id: Column) -> Column:
    """Metadata map plus external_id; the new value wins over one already there."""
    kept = F.map_filter(
        F.coalesce(metadata, F.create_map().cast("map<string,string>")),
        lambda key, _: key != F.lit("external_id"),
    )
    return F.map_concat(kept, F.create_map(F.lit("external_id"), external_id))


def json_text(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text; every other column untouched."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name)
            if isinstance(f.dataType, nested)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def parse_metadata(text: Column) -> Column:
    """JSON object text to a map; NULL or blank gives an empty map, anything else raises."""
    blank = text.isNull() | (stripped(text) == "")
    parsed = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    return (
        F.when(blank, F.create_map().cast("map<string,string>"))
        .when(is_json_object(text), parsed)
        .otherwise(F.raise_error(F.concat(F.lit("metadata must be an object: "), text)))
    )


def parse_roles(text: Column) -> Column:
    """JSON list text to an array; NULL or blank gives an empty array, anything else raises."""
    blank = text.isNull() | (stripped(text) == "")
    parsed = F.from_json(text, T.ArrayType(T.StringType()))
    return (
        F.when(blank, F.array().cast("array<string>"))
        .when(is_json_list(text), parsed)
        .otherwise(F.raise_error(F.concat(F.lit("allowed_roles must be a list: "), text)))
    )


def is_json_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def is_json_list(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.lit(False))
