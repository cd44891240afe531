"""Column names and values as they are, whatever they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def quoted(column: str) -> str:
    """A column name as it is, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def has_map(dtype: DataType) -> bool:
    if isinstance(dtype, ArrayType):
        return has_map(dtype.elementType)
    return isinstance(dtype, MapType) or isinstance(dtype, StructType) and any(has_map(f.dataType) for f in dtype.fields)


def orderable(value: Column, dtype: DataType) -> Column:
    """The value in a form that can be compared and hashed: maps become their entries by key, at every depth."""
    if not has_map(dtype):
        return value
    if isinstance(dtype, MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(
            orderable(e["key"], dtype.keyType).alias("key"), orderable(e["value"], dtype.valueType).alias("value"))))
    if isinstance(dtype, ArrayType):
        return F.transform(value, lambda x: orderable(x, dtype.elementType))
    fields = [orderable(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(value.isNotNull(), F.struct(*fields))
