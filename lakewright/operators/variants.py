"""Documents parsed once into VARIANT: fields by path and type, and the schema that they really have, held against a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How the schema of variants names types that a contract names otherwise.
SAME = {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}


def parsed(text: Column) -> Column:
    """The document of a JSON text; null where it cannot be parsed."""
    return F.try_parse_json(text)


def fields(document: Column, wanted: dict[str, str]) -> list[Column]:
    """A column for each (name of a path, type), null where a document has no such value of that type."""
    return [F.try_variant_get(document, path, kind).alias(name) for name, (path, kind) in wanted.items()]


def found_schema(documents: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, schema, documents, broken): the schema of all documents of a VARIANT column together, as DDL, with the number of documents and of those that are null.

    The aggregate merges the schemas of rows in each task before anything is shuffled; a row of the result is as large as the schema.
    """
    return documents.groupBy(*(keys or [])).agg(F.schema_of_variant_agg(column).alias("schema"), F.count("*").alias("documents"), F.count_if(F.col(column).isNull()).alias("broken"))


def _plain(kind: T.DataType) -> str:
    name = kind.simpleString()
    if isinstance(kind, T.DecimalType):
        return "number"
    return SAME.get(name, name)


def deviations(found: str, contract: T.DataType, at: str = "$") -> list[tuple[str, str, str, str]]:
    """(path, what, expected, found) of a schema that was found in variants: `unknown` fields, `missing` ones and `changed` types.

    Numbers of any width are one type; a field that is only ever null fits any.
    """
    ddl = found.replace("OBJECT<", "STRUCT<")
    return list(_compare(T._parse_datatype_string(ddl), contract, at))


def _compare(found: T.DataType, wanted: T.DataType, at: str):
    if isinstance(found, T.NullType):
        return
    if isinstance(found, T.StructType) and isinstance(wanted, T.MapType):
        for f in found:
            yield from _compare(f.dataType, wanted.valueType, f"{at}.{f.name}")
    elif isinstance(found, T.StructType) and isinstance(wanted, T.StructType):
        known = {f.name: f.dataType for f in wanted}
        for f in found:
            if f.name not in known:
                yield f"{at}.{f.name}", "unknown", "", _plain(f.dataType)
            else:
                yield from _compare(f.dataType, known[f.name], f"{at}.{f.name}")
        for name in known.keys() - {f.name for f in found}:
            yield f"{at}.{name}", "missing", _plain(known[name]), ""
    elif isinstance(found, T.ArrayType) and isinstance(wanted, T.ArrayType):
        yield from _compare(found.elementType, wanted.elementType, f"{at}[*]")
    elif _plain(found) != _plain(wanted) and not (_plain(found) in ("bigint", "number") and _plain(wanted) in ("double", "number")):
        yield at, "changed", _plain(wanted), _plain(found)
