"""Property values: each is kept as JSON text, whose kind decides its column's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kinds of a property column.
KINDS = ("double", "long", "string", "boolean")


def encoded(value: Column, kind: str) -> Column:
    """JSON text of a plain column of a known kind; null stays null."""
    if kind == "string":
        return F.when(value.isNotNull(), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
    return value.cast("string")


def kind_of(text: Column) -> Column:
    """``double, long, string, boolean``; null for JSON null, ``other`` for what can't be a property."""
    return (
        F.when(text.isNull() | (text == "null"), None)
        .when(text.startswith('"'), "string")
        .when(text.isin("true", "false"), "boolean")
        .when(text.rlike(r"^-?[0-9]+$"), F.when(text.try_cast("bigint").isNotNull(), "long").otherwise("other"))
        .when(text.try_cast("double").isNotNull() & (F.abs(text.try_cast("double")) < float("inf")), "double")
        .otherwise("other")
    )


def decoded(text: Column, kind: str) -> Column:
    """The value of JSON text as a column of ``kind``."""
    if kind == "string":
        return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return text.cast({"double": "double", "long": "bigint", "boolean": "boolean"}[kind])


def cell_text(cell: Column) -> Column:
    """JSON text of the narrowest kind a CSV cell's text supports; null where it is empty."""
    text = F.trim(cell)
    low = F.lower(text)
    whole = text.rlike(r"^[+-]?[0-9]+$") & text.try_cast("bigint").isNotNull()
    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(text.try_cast("double")) < float("inf"))
    return F.when(text == "", None).when(whole, text.try_cast("bigint").cast("string")).when(number, text.try_cast("double").cast("string")).when(low.isin("true", "false"), low).otherwise(encoded(text, "string"))


def long_properties(rows: DataFrame, key: str = "idx", column: str = "properties") -> DataFrame:
    """``key, name, value, kind`` of the property map of ``rows``; absent and null values have no row."""
    each = rows.select(key, F.explode(column).alias("name", "value"))
    return each.withColumn("kind", kind_of(F.col("value"))).filter("kind is not null")


def column_kinds(properties: DataFrame) -> dict[str, str]:
    """The kind of every key; whole and fractional numbers make a fractional column, any other mix is an error."""
    found = properties.groupBy("name").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).collect()  # one row a key
    out = {}
    for row in sorted(found):
        kinds = row["kinds"]
        if "other" in kinds:
            raise ValueError(f"property '{row['name']}' holds more than finite numbers, strings and booleans")
        if kinds == ["double", "long"]:
            kinds = ["double"]
        if len(kinds) != 1:
            raise ValueError(f"property '{row['name']}' mixes conflicting types across features")
        out[row["name"]] = kinds[0]
    return out


def wide(rows: DataFrame, column: str = "properties", keys: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with every property as a typed column instead of the map."""
    kinds = column_kinds(long_properties(rows.withColumn("idx", F.lit(0)), "idx", column)) if keys is None else keys
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, *(decoded(F.when(F.try_element_at(column, F.lit(k)) != "null", F.try_element_at(column, F.lit(k))), kind).alias(k) for k, kind in kinds.items()))
