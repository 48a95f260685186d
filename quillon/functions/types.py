"""Column types: from Python annotations and field flags to Spark types, and value codecs."""

from __future__ import annotations

import datetime
import decimal
import enum
import typing
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

#: Longest string kept as varchar; fixed value of the servers this data comes from.
VARCHAR_BELOW = 21845
DEFAULT_SIZE = 255


class Int8(int): ...


class UInt8(int): ...


class Int16(int): ...


class UInt16(int): ...


class Int32(int): ...


class UInt32(int): ...


class Int64(int): ...


class UInt64(int): ...


class Float32(float): ...


class Timestamp(int):
    """Unix seconds in a long column; never negative."""


class Datetime(datetime.datetime):
    """A moment without zone, cut to seconds."""


class Tristate(int):
    """0 unknown, 1 true, 2 false in an integer column."""


class Json:
    """A JSON document in a string column; empty text is no value."""


class Geometry:
    """Well-known text in a string column."""


SCALARS: dict[type, T.DataType] = {
    bool: T.BooleanType(),
    Int8: T.ByteType(),
    UInt8: T.ShortType(),
    Int16: T.ShortType(),
    UInt16: T.IntegerType(),
    int: T.LongType(),
    Int32: T.IntegerType(),
    UInt32: T.LongType(),
    Int64: T.LongType(),
    UInt64: T.DecimalType(20, 0),
    Float32: T.FloatType(),
    float: T.DoubleType(),
    bytes: T.BinaryType(),
    bytearray: T.BinaryType(),
    datetime.datetime: T.TimestampType(),
    datetime.date: T.DateType(),
    Timestamp: T.LongType(),
    Datetime: T.TimestampNTZType(),
    Tristate: T.IntegerType(),
    Json: T.StringType(),
    Geometry: T.StringType(),
}


@dataclass(frozen=True)
class Flags:
    """What a field's tag says beside the column's name."""

    null: bool = False
    autoincrement: bool = False
    deprecated: bool = False
    rename: str | None = None
    size: int | None = None
    decimal: int | None = None
    default: str | None = None
    onupdate: str | None = None


def parse_tag(tag: str) -> tuple[str, Flags]:
    """(column name, flags) of ``name,flag,flag=value``; quotes keep commas and equals signs together."""
    parts, quote, word = [], "", ""
    for ch in tag:
        if quote:
            quote = "" if ch == quote else quote
            word += ch
        elif ch in "'\"":
            quote = ch
            word += ch
        elif ch == ",":
            parts.append(word)
            word = ""
        else:
            word += ch
    parts.append(word)
    values: dict[str, typing.Any] = {}
    for part in parts[1:]:
        key, given, value = part.strip().partition("=")
        key = key.lower()
        if key in ("null", "autoincrement"):
            values[key] = True
        elif key == "deprecated":
            values |= {"deprecated": True, "rename": value.strip() or None}
        elif key in ("size", "decimal"):
            if not value.strip().isdigit():
                raise ValueError(f"{key} needs a number in tag {tag!r}")
            values[key] = int(value)
        elif key in ("default", "onupdate"):
            if not given or not value:
                raise ValueError(f"{key} needs a value in tag {tag!r}")
            values[key] = value
        elif key:
            raise ValueError(f"unknown flag {key!r} in tag {tag!r}")
    return parts[0].strip().lower(), Flags(**values)


def optional(kind: typing.Any) -> tuple[typing.Any, bool]:
    """(inner type, whether None is allowed)."""
    args = typing.get_args(kind)
    if type(None) in args:
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return rest[0], True
    return kind, False


def spark_type(kind: typing.Any, flags: Flags = Flags()) -> T.DataType:
    """The Spark type of an annotation; types with a ``spark_type`` hook name their own."""
    kind, _ = optional(kind)
    if hook := getattr(kind, "spark_type", None):
        return hook() if callable(hook) else hook
    if kind is str:
        size = flags.size or DEFAULT_SIZE
        return T.VarcharType(size) if size < VARCHAR_BELOW else T.StringType()
    if kind is decimal.Decimal:
        return T.DecimalType(flags.size or 10, flags.decimal or 0)
    if kind in SCALARS:
        return SCALARS[kind]
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is list and len(args) == 1:
        inner = spark_type(args[0])
        return T.ArrayType(T.StringType() if isinstance(inner, T.VarcharType) else inner)
    if origin is dict and args == (str, str):
        return T.MapType(T.StringType(), T.StringType())
    if isinstance(kind, type) and issubclass(kind, enum.IntEnum):
        return T.IntegerType()
    raise TypeError(f"no column type for {kind!r}")


def zero_of(kind: typing.Any) -> typing.Any:
    """The value that counts as not set."""
    kind, nullable = optional(kind)
    if nullable:
        return None
    if kind is bool:
        return False
    if kind is str:
        return ""
    if isinstance(kind, type) and issubclass(kind, (int, float)):
        return 0
    return None


def timestamp_write(c: Column) -> Column:
    """Unix seconds of a moment; before 1970 and null are 0."""
    return F.greatest(F.coalesce(F.unix_seconds(c.cast("timestamp")), F.lit(0)), F.lit(0))


def timestamp_read(c: Column) -> Column:
    """The moment of unix seconds; negative ones are the epoch."""
    return F.timestamp_seconds(F.greatest(c, F.lit(0)))


def timestamp_text(c: Column) -> Column:
    """RFC 3339 text of unix seconds in the fixed zone +08:00, whatever the session's zone is."""
    local = (F.lit(datetime.datetime(1970, 1, 1, 8)).cast("timestamp_ntz") + F.make_dt_interval(secs=c.cast("decimal(18,6)")))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def datetime_seconds(c: Column) -> Column:
    """A moment without zone, cut to seconds."""
    return F.date_trunc("second", c).cast("timestamp_ntz")


def tristate_read(c: Column) -> Column:
    """True, false or null of 1, 2 and anything else."""
    return F.when(c == 1, F.lit(True)).when(c == 2, F.lit(False))


def tristate_write(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).when(c, F.lit(1)).otherwise(F.lit(2))


def json_read(c: Column, schema: str) -> Column:
    """Parsed JSON; null and empty text are null."""
    return F.from_json(F.nullif(c, F.lit("")), schema)


def json_write(c: Column) -> Column:
    """JSON text; null is the empty text."""
    return F.coalesce(F.to_json(c), F.lit(""))
