"""Declared field types and Spark types, both ways."""

from __future__ import annotations

from pyspark.sql import types as T

#: Declared type names and what they are in Spark. Names are read in any case.
DECLARED = {
    "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "NUMBER": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIME": T.TimeType(), "BINARY": T.StringType(), "OBJECT": T.StringType(), "NULL": T.NullType(),
}


def spark_type(field: dict) -> T.DataType:
    """The type of a declared field: name, type, mode (NULLABLE, REQUIRED, REPEATED) and, of records,
    fields."""
    name = str(field.get("type", "STRING")).upper()
    kind = struct(field.get("fields", ())) if name == "RECORD" else DECLARED.get(name)
    if kind is None:
        kind = T._parse_datatype_string(name.lower())
    return T.ArrayType(kind) if field.get("mode", "NULLABLE").upper() == "REPEATED" else kind


def struct(schema) -> T.StructType:
    """A StructType from one, from a list of declared fields, or from a dict that has them."""
    if isinstance(schema, T.StructType):
        return schema
    fields = schema["fields"] if isinstance(schema, dict) else schema
    return T.StructType([T.StructField(f["name"], spark_type(f), f.get("mode", "NULLABLE").upper() != "REQUIRED") for f in fields])


def declared(schema: T.StructType) -> list[dict]:
    """The declared fields of a StructType."""
    return [_declared(f.name, f.dataType, f.nullable) for f in schema.fields]


def _declared(name: str, kind: T.DataType, nullable: bool = True) -> dict:
    if isinstance(kind, T.ArrayType):
        return _declared(name, kind.elementType) | {"mode": "REPEATED"}
    out = {"name": name, "type": type_name(kind), "mode": "NULLABLE" if nullable else "REQUIRED"}
    return out | {"fields": declared(kind)} if isinstance(kind, T.StructType) else out


def type_name(kind: T.DataType) -> str:
    """The declared name of a type."""
    if isinstance(kind, T.StructType):
        return "RECORD"
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "FLOAT"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    return next((n for n, k in DECLARED.items() if k == kind), kind.simpleString().upper())


def cast_type(name: str) -> T.DataType:
    """The target of a CAST: a declared name or a Spark name."""
    return DECLARED[name.upper()] if name.upper() in DECLARED else T._parse_datatype_string(name.lower())
