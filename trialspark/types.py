"""Type names shown to users, and record schemas shared by several operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The names that the catalog shows for Spark types.
_SIMPLE_NAMES: dict[type[T.DataType], str] = {
    T.BooleanType: "BOOLEAN",
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.VarcharType: "VARCHAR",
    T.CharType: "VARCHAR",
    T.BinaryType: "BLOB",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.NullType: "NULL",
}

DATASET_SCHEMA = T.StructType(
    [
        T.StructField("protocol", T.StringType(), False),
        T.StructField("dataset_url", T.StringType()),
        T.StructField("document_url", T.StringType()),
    ]
)


def display_name(data_type: T.DataType) -> str:
    """Catalog name of a Spark type, e.g. ``BIGINT`` or ``STRUCT(a VARCHAR)``."""
    if isinstance(data_type, T.DecimalType):
        if (data_type.precision, data_type.scale) == (38, 0):
            return "HUGEINT"
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    if isinstance(data_type, T.ArrayType):
        return f"{display_name(data_type.elementType)}[]"
    if isinstance(data_type, T.MapType):
        return f"MAP({display_name(data_type.keyType)}, {display_name(data_type.valueType)})"
    if isinstance(data_type, T.StructType):
        fields = ", ".join(f"{f.name} {display_name(f.dataType)}" for f in data_type.fields)
        return f"STRUCT({fields})"
    return _SIMPLE_NAMES.get(type(data_type), data_type.simpleString().upper())
