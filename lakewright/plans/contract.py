"""Schemas of results, as contracts that clients can check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: JSON Schema types of Spark's plain ones.
PLAIN = {"string": "string", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "number", "float": "number", "boolean": "boolean", "date": "string", "timestamp": "string", "binary": "string"}


def json_schema(kind: T.DataType) -> dict:
    """A Spark type as JSON Schema; a column that may be null may be left out."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": PLAIN.get(kind.simpleString(), "string")}


def contract(results: dict[str, DataFrame]) -> dict:
    """One schema for each named result."""
    return {"components": {"schemas": {name: json_schema(df.schema) for name, df in sorted(results.items())}}}
