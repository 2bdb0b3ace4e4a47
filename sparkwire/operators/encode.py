"""STRUCT column -> BINARY messages, compiled from the schema into one native column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.wire import key_hex, key_len, let, scalar_hex, scalar_len, varint_hex, varint_len, varint_value
from ..schema import EnumSchema, Field, MessageSchema, wire_type

FIXED_SIZES = {"bool": 1, "fixed32": 4, "sfixed32": 4, "float": 4, "fixed64": 8, "sfixed64": 8, "double": 8}


def _framed(body: Column) -> Column:
    """A body's length and the body itself, from one expression: nesting stays linear."""
    return let(body, lambda b: F.concat(varint_hex(F.shiftright(F.octet_length(b), 1)), b))


def _value_hex(m: MessageSchema, f: Field, x: Column, above: tuple[str, ...], depth: int) -> Column:
    """One occurrence of a field, key included."""
    key = F.lit(key_hex(f.number, wire_type(f.kind)))
    if f.kind in ("message", "group"):
        inner = m.message(f)
        x = F.struct(x.alias("value")) if f.wrapped else x
        body = F.hex(x) if above.count(inner.full_name) > depth else body_hex(inner, x, above, depth)
        return F.concat(key, body, F.lit(key_hex(f.number, 4))) if f.kind == "group" else F.concat(key, _framed(body))
    return F.concat(key, scalar_hex(f.kind, x))


def _set(f: Field, x: Column) -> Column:
    """Whether a plain value differs from its default (IEEE: -0.0 does not, NaN does)."""
    zero = f.zero()
    if f.kind == "bool":
        return x if not zero else ~x
    return x != (F.lit(zero) if f.kind != "bytes" else F.lit(bytearray(zero)))


def _field_hex(m: MessageSchema, f: Field, x: Column, above: tuple[str, ...], depth: int) -> Column:
    if f.kind == "map":
        k, v = f.key, f.value

        def entry(e: Column) -> Column:
            parts = []
            for side, col in ((k, e["key"]), (v, e["value"])):
                text = _value_hex(m, side, col, above, depth)
                parts.append(text if side.kind == "message" else F.when(_set(side, col), text).otherwise(""))
            return F.concat(F.lit(key_hex(f.number, 2)), _framed(F.concat(*parts)))

        return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), entry), ""), F.lit(""))
    if f.label == "repeated":
        if f.is_packed():
            body = F.array_join(F.transform(x, lambda e: scalar_hex(f.kind, e)), "")
            return F.when(F.size(x) > 0, F.concat(F.lit(key_hex(f.number, 2)), _framed(body))).otherwise("")
        return F.coalesce(F.array_join(F.transform(x, lambda e: _value_hex(m, f, e, above, depth)), ""), F.lit(""))
    text = _value_hex(m, f, x, above, depth)
    if f.kind in ("message", "group"):
        return F.when(x.isNotNull(), text).otherwise(F.lit(key_hex(f.number, wire_type(f.kind)) + ("00" if f.kind == "message" else key_hex(f.number, 4))) if f.label == "required" else "")
    if f.label == "required":
        zero = F.lit(bytearray(f.zero())) if f.kind == "bytes" else F.lit(f.zero())
        return _value_hex(m, f, F.coalesce(x, zero), above, depth)
    if f.label == "optional" or f.oneof:
        return F.when(x.isNotNull(), text).otherwise("")
    return F.when(_set(f, x), text).otherwise("")


def _one_set(oneof: str, x: Column, members: list[Field], text: Column) -> Column:
    """The text of a oneof, or an error where more than one member is set."""
    several = sum((x[f.name].isNotNull().cast("int") for f in members[1:]), x[members[0].name].isNotNull().cast("int")) > 1
    return F.when(several, F.raise_error(F.lit(f"oneof {oneof} has more than one member set"))).otherwise(text)


def body_hex(m: MessageSchema, x: Column, above: tuple[str, ...] = (), depth: int = 3) -> Column:
    """Fields in order of tag, a oneof at its lowest. A null plain value counts as its default; two set members of a oneof are an error."""
    above = (*above, m.full_name)
    parts = []
    for name, members in m.units():
        texts = [_field_hex(m, f, x[name][f.name] if f.oneof else x[name], above, depth) for f in members]
        parts += [_one_set(name, x[name], members, F.concat(*texts))] if len(members) > 1 else texts
    return F.concat(*parts) if parts else F.lit("")


def _framed_len(body: Column) -> Column:
    return let(body, lambda n: varint_len(n) + n)


def _sum(xs: Column, one) -> Column:
    return F.coalesce(F.aggregate(xs, F.lit(0).cast("bigint"), lambda total, x: total + one(x)), F.lit(0).cast("bigint"))


def _value_len(m: MessageSchema, f: Field, x: Column, above: tuple[str, ...], depth: int) -> Column:
    """Bytes of one occurrence of a field, key included."""
    key = key_len(f.number)
    if f.kind in ("message", "group"):
        inner = m.message(f)
        x = F.struct(x.alias("value")) if f.wrapped else x
        body = F.octet_length(x).cast("bigint") if above.count(inner.full_name) > depth else body_len(inner, x, above, depth)
        return F.lit(2 * key) + body if f.kind == "group" else F.lit(key) + _framed_len(body)
    return F.lit(key) + scalar_len(f.kind, x)


def _field_len(m: MessageSchema, f: Field, x: Column, above: tuple[str, ...], depth: int) -> Column:
    key, none = key_len(f.number), F.lit(0).cast("bigint")
    if f.kind == "map":

        def entry(e: Column) -> Column:
            sides = [(f.key, e["key"]), (f.value, e["value"])]
            both = [_value_len(m, side, col, above, depth) if side.kind == "message" else F.when(_set(side, col), _value_len(m, side, col, above, depth)).otherwise(none) for side, col in sides]
            return F.lit(key) + _framed_len(both[0] + both[1])

        return _sum(F.map_entries(x), entry)
    if f.label == "repeated":
        if f.is_packed():
            body = _sum(x, lambda e: scalar_len(f.kind, e)) if f.kind not in FIXED_SIZES else (F.size(x) * FIXED_SIZES[f.kind]).cast("bigint")
            return F.when(F.size(x) > 0, F.lit(key) + _framed_len(body)).otherwise(none)
        return _sum(x, lambda e: _value_len(m, f, e, above, depth))
    own = _value_len(m, f, x, above, depth)
    if f.kind in ("message", "group"):
        return F.when(x.isNotNull(), own).otherwise(F.lit(key + (1 if f.kind == "message" else key) if f.label == "required" else 0).cast("bigint"))
    if f.label == "required":
        return _value_len(m, f, F.coalesce(x, F.lit(bytearray(f.zero())) if f.kind == "bytes" else F.lit(f.zero())), above, depth)
    return F.when(x.isNotNull() if f.label == "optional" or f.oneof else _set(f, x), own).otherwise(none)


def body_len(m: MessageSchema, x: Column, above: tuple[str, ...] = (), depth: int = 3) -> Column:
    """Bytes of a message, counted: nothing is encoded."""
    above, out = (*above, m.full_name), F.lit(0).cast("bigint")
    for name, members in m.units():
        for f in members:
            out = out + _field_len(m, f, x[name][f.name] if f.oneof else x[name], above, depth)
    return out


def pb_encode(x: Column, m: MessageSchema, depth: int = 3) -> Column:
    """BINARY message; null for a null struct."""
    return F.when(x.isNotNull(), F.unhex(body_hex(m, x, (), depth)))


def pb_encode_delimited(x: Column, m: MessageSchema, depth: int = 3) -> Column:
    return F.when(x.isNotNull(), F.unhex(_framed(body_hex(m, x, (), depth))))


def pb_encoded_len(x: Column, m: MessageSchema, depth: int = 3) -> Column:
    """Bytes that pb_encode makes, without making them."""
    return F.when(x.isNotNull(), body_len(m, x, (), depth).cast("bigint"))


def pb_unframe(raw: Column) -> Column:
    """The message of a length-delimited BINARY; null where its length is no varint or goes beyond the bytes."""

    def body(n: Column) -> Column:
        head = varint_len(n)
        return F.when((n >= 0) & (n <= F.octet_length(raw) - head), F.substr(raw, (head + 1).cast("int"), n.cast("int")))

    return let(varint_value(raw), body)


def pb_merge_delimited(a: Column, framed: Column) -> Column:
    """Bytes whose message is a merged with the length-delimited second; null where that one has no frame."""
    return F.concat(F.coalesce(a, F.lit(b"")), pb_unframe(framed))


def pb_default(m: MessageSchema) -> Column:
    """The message of defaults, as a struct literal."""

    def lit(value, kind):
        if value is None:
            return F.lit(None).cast(kind)
        if isinstance(value, dict) and hasattr(kind, "fields"):
            return F.struct(*[lit(value[f.name], f.dataType).alias(f.name) for f in kind.fields]) if kind.fields else F.struct()
        if isinstance(value, dict):
            return F.create_map().cast(kind)
        if isinstance(value, list):
            return F.array().cast(kind)
        return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(kind)

    return lit(m.defaults(), m.struct())


def enum_name(x: Column, e: EnumSchema) -> Column:
    """Name of a number; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in e.names().items() for v in kv]), x)


def enum_number(x: Column, e: EnumSchema) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in e.numbers().items() for v in kv]), x)


def enum_is_valid(x: Column, e: EnumSchema) -> Column:
    return x.isin(sorted(e.names()))


def enum_checked(x: Column, e: EnumSchema) -> Column:
    """The number itself, or an error that names it."""
    return F.when(enum_is_valid(x, e), x).otherwise(F.raise_error(F.concat(F.lit("unknown enumeration value "), x.cast("string"))).cast("int"))


def enum_get(x: Column, e: EnumSchema) -> Column:
    """A field's getter: an unknown or null number reads as the default."""
    return F.when(enum_is_valid(x, e), x).otherwise(F.lit(e.default))


def enum_valid_only(xs: Column, e: EnumSchema) -> Column:
    return F.filter(xs, lambda x: enum_is_valid(x, e))


def enum_map_get(m: Column, key: Column, e: EnumSchema) -> Column:
    """The number at a key of a map of enums; null where the key is absent or the number unknown."""
    x = F.try_element_at(m, key)
    return F.when(enum_is_valid(x, e), x)


def enum_map_put(m: Column, key: Column, number: Column) -> Column:
    """The map with that key set, whatever the session's policy on repeated keys."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, number))


def field_get(x: Column, f: Field) -> Column:
    """Getter of an optional field: its default where it is absent, and for an enum where the number is unknown."""
    if f.kind == "enum" and isinstance(f.of, EnumSchema):
        return F.when(enum_is_valid(x, f.of), x).otherwise(F.lit(f.zero()))
    return F.coalesce(x, F.lit(bytearray(f.zero()) if f.kind == "bytes" else f.zero()))
