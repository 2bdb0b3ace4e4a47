"""Well-known types as native columns: timestamps and durations as struct<seconds bigint, nanos int>, their texts, Any and type URLs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Field, MessageSchema, Registry
from .wire import let

MAX64, MIN64 = (1 << 63) - 1, -(1 << 63)
BILLION = 1_000_000_000
PACKAGE = "google.protobuf"

TIMESTAMP = MessageSchema("Timestamp", [Field("seconds", 1, "int64"), Field("nanos", 2, "int32")], PACKAGE, "type.googleapis.com")
DURATION = MessageSchema("Duration", [Field("seconds", 1, "int64"), Field("nanos", 2, "int32")], PACKAGE, "type.googleapis.com")
ANY = MessageSchema("Any", [Field("type_url", 1, "string"), Field("value", 2, "bytes")], PACKAGE, "type.googleapis.com")
EMPTY = MessageSchema("Empty", [], PACKAGE, "type.googleapis.com")
FIELD_MASK = MessageSchema("FieldMask", [Field("paths", 1, "string", "repeated")], PACKAGE, "type.googleapis.com")
SOURCE_CONTEXT = MessageSchema("SourceContext", [Field("file_name", 1, "string")], PACKAGE, "type.googleapis.com")
#: Wrapper messages and the kind of their field 1.
WRAPPERS = {"BoolValue": "bool", "UInt32Value": "uint32", "UInt64Value": "uint64", "Int32Value": "int32", "Int64Value": "int64", "FloatValue": "float", "DoubleValue": "double", "StringValue": "string", "BytesValue": "bytes"}


def wrapper(name: str) -> MessageSchema:
    return MessageSchema(name, [Field("value", 1, WRAPPERS[name])], PACKAGE, "type.googleapis.com")


FIELD_KINDS = ["TYPE_UNKNOWN", "TYPE_DOUBLE", "TYPE_FLOAT", "TYPE_INT64", "TYPE_UINT64", "TYPE_INT32", "TYPE_FIXED64", "TYPE_FIXED32", "TYPE_BOOL", "TYPE_STRING", "TYPE_GROUP", "TYPE_MESSAGE", "TYPE_BYTES", "TYPE_UINT32", "TYPE_ENUM", "TYPE_SFIXED32", "TYPE_SFIXED64", "TYPE_SINT32", "TYPE_SINT64"]
CARDINALITIES = ["CARDINALITY_UNKNOWN", "CARDINALITY_OPTIONAL", "CARDINALITY_REQUIRED", "CARDINALITY_REPEATED"]


def _add_types(r: Registry) -> None:
    """The messages of type.proto and api.proto."""
    from ..schema import EnumSchema

    def enum(name: str, values: list[str]) -> EnumSchema:
        e = r.enums[f"{PACKAGE}.{name}"] = EnumSchema(name.split(".")[-1], [(v, k) for k, v in enumerate(values)])
        return e

    def message(name: str, tag: int, of: str, label: str = "plain") -> Field:
        return Field(name, tag, "message", label, of=f"{PACKAGE}.{of}")

    def text(name: str, tag: int, label: str = "plain") -> Field:
        return Field(name, tag, "string", label)

    syntax, kind, cardinality = enum("Syntax", ["SYNTAX_PROTO2", "SYNTAX_PROTO3"]), enum("Field.Kind", FIELD_KINDS), enum("Field.Cardinality", CARDINALITIES)
    messages = {
        "Type": [text("name", 1), message("fields", 2, "Field", "repeated"), text("oneofs", 3, "repeated"), message("options", 4, "Option", "repeated"), message("source_context", 5, "SourceContext"), Field("syntax", 6, "enum", of=syntax)],
        "Field": [
            Field("kind", 1, "enum", of=kind), Field("cardinality", 2, "enum", of=cardinality), Field("number", 3, "int32"), text("name", 4), text("type_url", 6), Field("oneof_index", 7, "int32"),
            Field("packed", 8, "bool"), message("options", 9, "Option", "repeated"), text("json_name", 10), text("default_value", 11),
        ],
        "Enum": [text("name", 1), message("enumvalue", 2, "EnumValue", "repeated"), message("options", 3, "Option", "repeated"), message("source_context", 4, "SourceContext"), Field("syntax", 5, "enum", of=syntax)],
        "EnumValue": [text("name", 1), Field("number", 2, "int32"), message("options", 3, "Option", "repeated")],
        "Option": [text("name", 1), message("value", 2, "Any")],
        "Api": [
            text("name", 1), message("methods", 2, "Method", "repeated"), message("options", 3, "Option", "repeated"), text("version", 4), message("source_context", 5, "SourceContext"),
            message("mixins", 6, "Mixin", "repeated"), Field("syntax", 7, "enum", of=syntax),
        ],
        "Method": [text("name", 1), text("request_type_url", 2), Field("request_streaming", 3, "bool"), text("response_type_url", 4), Field("response_streaming", 5, "bool"), message("options", 6, "Option", "repeated"), Field("syntax", 7, "enum", of=syntax)],
        "Mixin": [text("name", 1), text("root", 2)],
    }
    for name, fields in messages.items():
        r.add(MessageSchema(name, fields, PACKAGE, "type.googleapis.com", r))


def registry() -> Registry:
    """The well-known messages, with Struct, Value and ListValue (recursive) and those of type.proto and api.proto."""
    from ..schema import EnumSchema

    r = Registry()
    for m in (TIMESTAMP, DURATION, ANY, EMPTY, FIELD_MASK, SOURCE_CONTEXT, *map(wrapper, WRAPPERS)):
        r.add(m)
    null = r.enums[f"{PACKAGE}.NullValue"] = EnumSchema("NullValue", [("NULL_VALUE", 0)])
    value = f"{PACKAGE}.Value"
    r.add(MessageSchema("Struct", [Field("fields", 1, "map", key=Field("key", 1, "string"), value=Field("value", 2, "message", of=value))], PACKAGE, "type.googleapis.com", r))
    kinds = [Field("null_value", 1, "enum", of=null), Field("number_value", 2, "double"), Field("string_value", 3, "string"), Field("bool_value", 4, "bool"), Field("struct_value", 5, "message", of=f"{PACKAGE}.Struct"), Field("list_value", 6, "message", of=f"{PACKAGE}.ListValue")]
    for f in kinds:
        f.oneof = "kind"
    r.add(MessageSchema("Value", kinds, PACKAGE, "type.googleapis.com", r))
    r.add(MessageSchema("ListValue", [Field("values", 1, "message", "repeated", of=value)], PACKAGE, "type.googleapis.com", r))
    _add_types(r)
    return r


# ------------------------------------------------------------------ integers


def tdiv(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n))


def fdiv(a: Column, n: int) -> Column:
    """Floor division that cannot overflow."""
    return tdiv(a, n) - F.when((a < 0) & (a % n != 0), 1).otherwise(0)


def _pair(seconds: Column, nanos: Column) -> Column:
    return F.struct(seconds.cast("bigint").alias("seconds"), nanos.cast("int").alias("nanos"))


def timestamp_normalize(ts: Column) -> Column:
    """0 <= nanos < 10^9; beyond the range of seconds it stays at the last or the first moment."""
    s, n = ts["seconds"], ts["nanos"].cast("bigint")
    total = F.try_add(s, fdiv(n, BILLION))
    high = _pair(F.lit(MAX64), F.lit(BILLION - 1))
    low = _pair(F.lit(MIN64).cast("bigint"), F.lit(0))
    return F.when(ts.isNull(), None).when(total.isNotNull(), _pair(total, F.pmod(n, F.lit(BILLION)))).when(n > 0, high).otherwise(low)


def timestamp_try_normalize(ts: Column) -> Column:
    """Null where normalising leaves the range."""
    return F.when(F.try_add(ts["seconds"], fdiv(ts["nanos"].cast("bigint"), BILLION)).isNotNull(), timestamp_normalize(ts))


def duration_normalize(d: Column) -> Column:
    """|nanos| < 10^9 and both parts of one sign; saturates."""
    s, n = d["seconds"], d["nanos"].cast("bigint")
    total, rest = F.try_add(s, tdiv(n, BILLION)), n % BILLION
    mixed = F.when((total < 0) & (rest > 0), _pair(total + 1, rest - BILLION)).when((total > 0) & (rest < 0), _pair(total - 1, rest + BILLION)).otherwise(_pair(total, rest))
    high = _pair(F.lit(MAX64), F.lit(BILLION - 1))
    low = _pair(F.lit(MIN64).cast("bigint"), F.lit(1 - BILLION))
    return F.when(d.isNull(), None).when(total.isNotNull(), mixed).when(n > 0, high).otherwise(low)


# ------------------------------------------------------------------ calendar


def civil_struct(days: Column) -> Column:
    """struct<y, m, d> of days since 1970-01-01, proleptic Gregorian, any bigint year; each step is bound once."""

    def in_era(e: Column) -> Column:
        doe = e["doe"]
        yoe = tdiv(doe - tdiv(doe, 1460) + tdiv(doe, 36524) - tdiv(doe, 146096), 365)
        return let(F.struct(e["era"].alias("era"), doe.alias("doe"), yoe.alias("yoe")), in_year)

    def in_year(e: Column) -> Column:
        yoe = e["yoe"]
        doy = e["doe"] - (365 * yoe + tdiv(yoe, 4) - tdiv(yoe, 100))
        return let(F.struct((yoe + e["era"] * 400).alias("y"), doy.alias("doy"), tdiv(5 * doy + 2, 153).alias("mp")), dated)

    def dated(e: Column) -> Column:
        mp = e["mp"]
        late = mp >= 10
        return F.struct((e["y"] + F.when(late, 1).otherwise(0)).alias("y"), F.when(late, mp - 9).otherwise(mp + 3).alias("m"), (e["doy"] - tdiv(153 * mp + 2, 5) + 1).alias("d"))

    z = days + 719468
    return let(z, lambda z: let(F.struct(fdiv(z, 146097).alias("era"), F.pmod(z, F.lit(146097)).alias("doe")), in_era))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    y = y.cast("bigint") - F.when(m <= 2, 1).otherwise(0)
    era = fdiv(y, 400)
    yoe = y - era * 400
    mp = F.pmod(m + 9, F.lit(12))
    doy = tdiv(153 * mp + 2, 5) + d - 1
    return era * 146097 + yoe * 365 + tdiv(yoe, 4) - tdiv(yoe, 100) + doy - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).when(m.between(1, 12), 31)


def timestamp_of(y: Column, mo: Column, d: Column, h: Column | None = None, mi: Column | None = None, s: Column | None = None, nanos: Column | None = None) -> Column:
    """Null if the date and time are not valid."""
    h, mi, s, nanos = (F.lit(0) if x is None else x for x in (h, mi, s, nanos))
    ok = mo.between(1, 12) & (d >= 1) & (d <= days_in_month(y, mo)) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59) & nanos.between(0, BILLION - 1)
    return F.when(ok, _pair(days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s, nanos))


def _fraction(n: Column) -> Column:
    def digits(x: Column, k: int) -> Column:
        return F.concat(F.lit("."), F.lpad(x.cast("string"), k, "0"))

    return F.when(n == 0, "").when(n % 1_000_000 == 0, digits(tdiv(n, 1_000_000), 3)).when(n % 1000 == 0, digits(tdiv(n, 1000), 6)).otherwise(digits(n, 9))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def timestamp_format(ts: Column) -> Column:
    """RFC 3339 in UTC with 0, 3, 6 or 9 digits; years beyond 9999 have a plus, negative ones a minus."""
    def dated(t: Column) -> Column:
        return let(civil_struct(fdiv(t["seconds"], 86400)), lambda c: text(t, c))

    def text(t: Column, c: Column) -> Column:
        y, r, n = c["y"], F.pmod(t["seconds"], F.lit(86400)), t["nanos"].cast("bigint")
        signed = F.concat(F.when(y < 0, "-").otherwise("+"), F.abs(y).cast("string"))
        year = F.when((y > 9999) | (y < -9999), signed).when(y < 0, F.concat(F.lit("-"), F.lpad((-y).cast("string"), 4, "0"))).otherwise(F.lpad(y.cast("string"), 4, "0"))
        return F.concat(year, F.lit("-"), _two(c["m"]), F.lit("-"), _two(c["d"]), F.lit("T"), _two(tdiv(r, 3600)), F.lit(":"), _two(tdiv(r % 3600, 60)), F.lit(":"), _two(r % 60), _fraction(n), F.lit("Z"))

    return let(timestamp_normalize(ts), dated)


def duration_format(d: Column) -> Column:
    """Seconds with 0, 3, 6 or 9 digits and an s; the sign is that of the normalised value."""
    def text(t: Column) -> Column:
        n = t["nanos"].cast("bigint")
        sign = F.when((t["seconds"] < 0) | (n < 0), "-").otherwise("")
        return F.concat(sign, F.abs(t["seconds"].cast("decimal(20,0)")).cast("string"), _fraction(F.abs(n)), F.lit("s"))

    return let(duration_normalize(d), text)


def duration_parse(text: Column) -> Column:
    """-?digits(.digits)?s; more than nine digits of fraction are cut. Null if it does not parse."""
    pattern = r"^(-?)([0-9]+)(?:\.([0-9]+))?s$"
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1).otherwise(1)
    whole = F.regexp_extract(text, pattern, 2)
    s = F.when(F.length(whole) > 0, F.concat(F.regexp_extract(text, pattern, 1), whole)).try_cast("bigint")
    n = F.rpad(F.substring(F.regexp_extract(text, pattern, 3), 1, 9), 9, "0").try_cast("int")
    return F.when(text.rlike(r"\A-?[0-9]+(\.[0-9]+)?s\z") & s.isNotNull(), _pair(s, n * sign))


#: Texts of what is wrong.
BAD_TIMESTAMP, BAD_DATE, BAD_DURATION = "failed to parse RFC-3339 formatted timestamp", "invalid date or time", "failed to parse duration"
NEGATIVE_DURATION, DURATION_RANGE = "failed to convert negative duration", "failed to convert duration out of range"

#: Year, month, day, hour, minute, second, fraction, zone, its hours and minutes.
_STAMP = (
    r"^([+][0-9]{5,}|-[0-9]{4,}|[0-9]{4})-([0-9]{2})-([0-9]{2})"
    r"(?:[Tt ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.]([0-9]+))?(?: ?([Zz]|[+-]([0-9]{2})(?::?([0-9]{2}))?))?)?$"
)


def _stamp_parts(text: Column) -> Column:
    """The ten parts of a timestamp's text; null where it has another form. A line break at the end is no part of it."""
    fits = text.rlike(_STAMP) & ~F.contains(text, F.lit("\n"))
    return F.when(fits, F.split(F.regexp_replace(text, _STAMP, "|".join(f"${i}" for i in range(1, 11))), r"\|"))


def _stamp(p: Column) -> Column:
    """(seconds, nanos) of the parts; null if there is no such time, or none within a bigint's seconds."""

    def number(i: int) -> Column:
        return F.coalesce(F.when(p[i] != "", p[i]).try_cast("bigint"), F.lit(0).cast("bigint"))

    year = p[0].try_cast("decimal(38,0)")
    near = F.abs(year) < 300_000_000_000
    y, mo, d, s = F.when(near, year).cast("bigint"), number(1), number(2), number(5)
    late = F.when(s == 60, F.lit(59).cast("bigint")).otherwise(s)
    ok = mo.between(1, 12) & (d >= 1) & (d <= days_in_month(y, mo)) & number(3).between(0, 23) & number(4).between(0, 59) & (late <= 59) & (number(8) <= 23) & (number(9) <= 59)
    shift = (number(8) * 3600 + number(9) * 60) * F.when(F.startswith(p[7], F.lit("-")), -1).otherwise(1)
    total = days_from_civil(y, mo, d).cast("decimal(38,0)") * 86400 + (number(3) * 3600 + number(4) * 60 + late - shift)
    return F.when(ok, let(total, lambda t: F.when(t.between(MIN64, MAX64), _pair(t.cast("bigint"), F.rpad(F.substring(p[6], 1, 9), 9, "0").cast("int")))))


def timestamp_parse(text: Column) -> Column:
    """struct<seconds, nanos> of RFC 3339 texts and wider forms: a date alone, signed long years, a blank as separator, no offset,
    ±HH, ±HHMM. A second of 60 reads as 59. Null if a text does not parse or the time does not exist."""
    return let(_stamp_parts(text), lambda p: F.when(p.isNotNull(), _stamp(p)))


def timestamp_error(text: Column) -> Column:
    """What is wrong with a timestamp's text; null if it parses or is null. A date or time that does not exist does not parse."""
    return F.when(text.isNotNull() & timestamp_parse(text).isNull(), BAD_TIMESTAMP)


def date_time_error(ts: Column) -> Column:
    """What is wrong with the parts of a date: of a timestamp_of() that gave none."""
    return F.when(ts.isNull(), BAD_DATE)


def duration_error(text: Column) -> Column:
    """What is wrong with a duration's text; null if it parses or is null."""
    return F.when(text.isNotNull() & duration_parse(text).isNull(), BAD_DURATION)


def to_spark_timestamp(ts: Column) -> Column:
    """TIMESTAMP, cut to microseconds towards the past."""
    t = timestamp_normalize(ts)
    return F.timestamp_micros(t["seconds"] * 1_000_000 + tdiv(t["nanos"].cast("bigint"), 1000))


def from_spark_timestamp(x: Column) -> Column:
    us = F.unix_micros(x)
    return _pair(fdiv(us, 1_000_000), F.pmod(us, F.lit(1_000_000)) * 1000)


def interval_of(us: Column) -> Column:
    """The day-time interval of a bigint of microseconds, over its whole range (make_dt_interval's seconds end at 10^12)."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(Decimal("0.000001"))) * us.cast("bigint")


def to_interval(d: Column) -> Column:
    """The day-time interval of a Duration, cut to microseconds towards zero; an error beyond an interval's range."""
    t = duration_normalize(d)
    return interval_of(t["seconds"]) * F.lit(1_000_000) + interval_of(tdiv(t["nanos"].cast("bigint"), 1000))


def from_interval(x: Column) -> Column:
    """A Duration of a day-time interval, in any session time zone."""
    return F.when(x.isNotNull(), _pair(x.cast("interval second").cast("bigint"), F.extract(F.lit("SECOND"), x) * 1_000_000 % 1_000_000 * 1000))


def interval_error(d: Column) -> Column:
    """Why a Duration has no counterpart that cannot be negative; null if it has one."""
    t = duration_normalize(d)
    return F.when((t["seconds"] < 0) | (t["nanos"] < 0), F.concat(F.lit(NEGATIVE_DURATION + ": "), F.ltrim(duration_format(d), F.lit("-"))))


# ------------------------------------------------------------------ Any


def type_name(url: Column) -> Column:
    """The full name behind the last slash; null without a slash, or for a name that is empty or begins with a dot."""
    name = F.substring_index(url, "/", -1)
    return F.when(F.contains(url, F.lit("/")) & ~F.startswith(name, F.lit(".")) & (name != ""), name)


def any_pack(value: Column, m: MessageSchema) -> Column:
    from ..operators.encode import pb_encode

    return F.struct(F.lit(m.type_url).alias("type_url"), pb_encode(value, m).alias("value"))


def any_is(x: Column, m: MessageSchema) -> Column:
    return F.coalesce(type_name(x["type_url"]) == F.lit(m.full_name), F.lit(False))


def any_payload(x: Column, m: MessageSchema, check: bool = False) -> Column:
    """The bytes of an Any that holds an m; others are null, or with check an error."""
    other: Column = F.lit(None).cast("binary")
    if check:
        text = F.concat(F.lit(f'failed to decode Protobuf message: unexpected type URL.type_url: expected type URL: "{m.type_url}" (got: "'), x["type_url"], F.lit('")'))
        other = F.raise_error(text).cast("binary")
    return F.when(any_is(x, m), x["value"]).otherwise(other)
