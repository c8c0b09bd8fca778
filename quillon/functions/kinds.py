"""What a column of a collection may hold, and how a delta is merged into it."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (value, delta) -> the merged value. The value is null where nothing was stored.
MergeRule = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Codec:
    """Records as bytes of a format of one's own. `type` is what is written and read, encode and decode are expressions.

    Null stays null: neither function sees one.
    """

    type: T.DataType
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def json_codec(type: T.DataType) -> Codec:
    return Codec(type, lambda value: F.to_json(value).cast("binary"), lambda stored: F.from_json(stored.cast("string"), type))


def python_codec(type: T.DataType, to_bytes: Callable[[object], bytes], from_bytes: Callable[[bytes], object]) -> Codec:
    """A codec of Python functions, run over Arrow batches: for formats that no built-in function knows."""
    encode = F.udf(lambda v: None if v is None else to_bytes(v), T.BinaryType(), useArrow=True)
    decode = F.udf(lambda b: None if b is None else from_bytes(bytes(b)), type, useArrow=True)
    return Codec(type, encode, decode)


@dataclass(frozen=True)
class Kind:
    name: str
    type: T.DataType
    merge: MergeRule | None = None
    low: int | None = None
    high: int | None = None
    codec: Codec | None = None
    #: Applied to what is stored, after the cast: a check or another form of the value.
    store: Callable[[Column], Column] | None = None

    @property
    def given(self) -> T.DataType:
        """The type of values as they are written and read."""
        return self.type if self.codec is None else self.codec.type

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def textual(self) -> bool:
        return isinstance(self.type, T.StringType)

    def stored(self, value: Column) -> Column:
        """value as this kind stores it; out of range is an error."""
        if self.codec is not None:
            value = value.cast(self.codec.type)
            return F.when(value.isNotNull(), self.codec.encode(value)).cast(self.type)
        cast = value.cast(self.type)
        if self.store is not None:
            return self.store(cast).cast(self.type)
        if self.name == "bool":
            return F.coalesce(cast, F.lit(False))
        if self.low is None:
            return cast
        outside = (cast < F.lit(decimal.Decimal(self.low)).cast(self.type)) | (cast > F.lit(decimal.Decimal(self.high)).cast(self.type))
        return F.when(outside, F.raise_error(F.concat(F.lit(f"out of range for {self.name}: "), value.cast("string"))).cast(self.type)).otherwise(cast)

    def loaded(self, value: Column) -> Column:
        """A stored value as it was given."""
        return value if self.codec is None else F.when(value.isNotNull(), self.codec.decode(value))

    def merged(self, value: Column, delta: Column) -> Column:
        return value if self.merge is None else self.stored(self.merge(self.loaded(value), delta))


def add(value: Column, delta: Column) -> Column:
    return F.coalesce(value, F.lit(0)) + delta


def overwrite(value: Column, delta: Column) -> Column:
    return delta


_UNSIGNED = T.DecimalType(20, 0)
_NUMBERS = {
    "int": (T.LongType(), None, None),
    "int16": (T.ShortType(), None, None),
    "int32": (T.IntegerType(), None, None),
    "int64": (T.LongType(), None, None),
    "uint": (_UNSIGNED, 0, 2**64 - 1),
    "uint16": (T.IntegerType(), 0, 2**16 - 1),
    "uint32": (T.LongType(), 0, 2**32 - 1),
    "uint64": (_UNSIGNED, 0, 2**64 - 1),
    "float32": (T.FloatType(), None, None),
    "float64": (T.DoubleType(), None, None),
}
KINDS: dict[str, Kind] = {name: Kind(name, kind, add, low, high) for name, (kind, low, high) in _NUMBERS.items()} | {
    "bool": Kind("bool", T.BooleanType()),
    "string": Kind("string", T.StringType(), overwrite),
    "enum": Kind("enum", T.StringType()),  # Parquet's dictionaries store it; merging does nothing
    "key": Kind("key", T.StringType()),
    "expire": Kind("expire", T.LongType(), add),
}


def register(own: Kind) -> Kind:
    """A kind of one's own, known by its name from now on. A process that opens a collection with it registers it, too."""
    if own.name == "record" or KINDS.get(own.name, own) != own:
        raise ValueError(f"{own.name} is taken")
    KINDS[own.name] = own
    return own


def kind(name: str, merge: MergeRule | None = None, type: T.DataType | None = None, codec: Codec | None = None) -> Kind:
    """A kind by name; `record` takes a type (a struct, or binary) or a codec. merge replaces the kind's own rule."""
    if name == "record":
        found = Kind("record", T.BinaryType() if codec else type or T.BinaryType(), overwrite, codec=codec)
    elif codec is not None:
        raise ValueError("only a record has a codec")
    elif name in KINDS:
        found = KINDS[name] if type is None else replace(KINDS[name], type=type)
    else:
        raise ValueError(f"no such kind of column: {name}")
    return found if merge is None else replace(found, merge=merge)


def infer(value: object) -> Kind:
    """The kind of a sample value."""
    if isinstance(value, bool):
        return KINDS["bool"]
    for python, name in ((int, "int"), (float, "float64"), (str, "string"), (decimal.Decimal, "uint64")):
        if isinstance(value, python):
            return KINDS[name]
    if isinstance(value, bytes):
        return kind("record")
    if isinstance(value, dt.datetime):
        return kind("record", type=T.TimestampType())
    if isinstance(value, dict) and value:
        return kind("record", type=T.StructType([T.StructField(k, infer(v).type) for k, v in value.items()]))
    raise TypeError(f"no kind of column for {type(value).__name__}")


def of_type(type: T.DataType) -> Kind:
    """The kind of a DataFrame's column."""
    for name in ("bool", "int16", "int32", "int64", "float32", "float64", "string", "uint64"):
        if KINDS[name].type == type:
            return KINDS[name]
    return kind("record", type=type)
