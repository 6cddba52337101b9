"""The type system: five types, implicit and explicit casts between them, and their Spark types."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class EngineError(Exception):
    """A statement that can't be parsed, checked or run."""


class Type(Enum):
    INTEGER = "INTEGER"
    FLOAT = "FLOAT"
    VARCHAR = "VARCHAR"
    DATETIME = "DATETIME"
    BOOLEAN = "BOOLEAN"

    def spark(self) -> T.DataType:
        return _SPARK[self]

    def implicit(self, to: Type) -> bool:
        """Whether a value of this type stands for one of the other without a CAST."""
        return self is to or to in _IMPLICIT.get(self, ())

    def explicit(self, to: Type) -> bool:
        """Whether CAST accepts it: what is implicit, anything to VARCHAR, and FLOAT to INTEGER."""
        return self.implicit(to) or to is Type.VARCHAR or (self, to) == (Type.FLOAT, Type.INTEGER)

    @property
    def numeric(self) -> bool:
        return self in (Type.INTEGER, Type.FLOAT)


_SPARK = {Type.INTEGER: T.LongType(), Type.FLOAT: T.DoubleType(), Type.VARCHAR: T.StringType(), Type.DATETIME: T.TimestampNTZType(), Type.BOOLEAN: T.BooleanType()}
_IMPLICIT = {
    Type.BOOLEAN: (Type.INTEGER, Type.FLOAT),
    Type.INTEGER: (Type.FLOAT,),
    Type.VARCHAR: (Type.DATETIME,),
    Type.DATETIME: (Type.VARCHAR,),
}
#: SQL names of the types; any other name is an error.
NAMES = {"int": Type.INTEGER, "integer": Type.INTEGER, "int4": Type.INTEGER, "float": Type.FLOAT, "real": Type.FLOAT, "varchar": Type.VARCHAR, "datetime": Type.DATETIME, "boolean": Type.BOOLEAN, "bool": Type.BOOLEAN}


def of_spark(kind: T.DataType) -> Type | None:
    """The engine's type for a Spark column, None where it has none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Type.INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Type.FLOAT
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return Type.VARCHAR
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Type.DATETIME
    return Type.BOOLEAN if isinstance(kind, T.BooleanType) else None
