"""The debug text of a message, as a native column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EnumSchema, Field, MessageSchema, to_upper_camel

#: Characters that a quoted text shows as escapes, the backslash first.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")]


def _quoted(x: Column) -> Column:
    for c, shown in ESCAPES:
        x = F.replace(x, F.lit(c), F.lit(shown))
    return F.concat(F.lit('"'), x, F.lit('"'))


def _number(x: Column, kind: str) -> Column:
    """Decimal digits between 1e-3 and 1e16 (with .0 for a whole number); beyond that Java's text."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,15)").cast("string"), r"0+$", ""), r"\.$", ".0")
    size = F.abs(x)
    return F.when(F.isnan(x), "NaN").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when((size >= 1e7) & (size < 1e16), plain).otherwise(x.cast("string"))


def _scalar(f: Field, x: Column) -> Column:
    if f.kind == "string":
        return _quoted(x)
    if f.kind == "bytes":
        pairs = F.regexp_extract_all(F.hex(x), F.lit("(..)"))
        return F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda h: F.conv(h, 16, 10)), ", "), F.lit("]"))
    if f.kind == "enum" and isinstance(f.of, EnumSchema):
        names = F.create_map(*[F.lit(v) for kv in f.of.names().items() for v in kv])
        return F.coalesce(F.try_element_at(names, x), x.cast("string"))
    return _number(x, f.kind) if f.kind in ("float", "double") else x.cast("string")


def _value(m: MessageSchema, f: Field, x: Column, above: tuple[str, ...], depth: int) -> Column:
    if f.kind not in ("message", "group"):
        return _scalar(f, x)
    inner = m.message(f)
    if f.wrapped:
        return _scalar(inner.fields[0], x)
    if above.count(inner.full_name) > depth:  # kept bytes
        return _scalar(Field(f.name, 1, "bytes"), x)
    return _message(inner, x, above, depth)


def _some(x: Column, text: Column) -> Column:
    return F.when(x.isNull(), "None").otherwise(F.concat(F.lit("Some("), text, F.lit(")")))


def _message(m: MessageSchema, x: Column, above: tuple[str, ...], depth: int) -> Column:
    above, parts = (*above, m.full_name), []
    for name, members in m.units():
        f, own = members[0], x[name]
        if f.oneof:
            shown: Column = F.lit("None")
            for s in reversed(members):
                text = F.concat(F.lit(f"Some({to_upper_camel(s.name)}("), _value(m, s, own[s.name], above, depth), F.lit("))"))
                shown = F.when(own[s.name].isNotNull(), text).otherwise(shown)
        elif f.kind == "map":
            pairs = F.transform(F.map_entries(own), lambda e: F.concat(_value(m, f.key, e["key"], above, depth), F.lit(": "), _value(m, f.value, e["value"], above, depth)))
            shown = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
        elif f.label == "repeated":
            shown = F.concat(F.lit("["), F.array_join(F.transform(own, lambda v: _value(m, f, v, above, depth)), ", "), F.lit("]"))
        elif f.label == "optional" or (f.kind in ("message", "group") and f.label == "plain"):
            shown = _some(own, _value(m, f, own, above, depth))
        else:
            shown = _value(m, f, own, above, depth)
        parts.append(F.concat(F.lit(f"{name}: "), shown))
    if not parts:
        return F.lit(m.name)
    return F.concat(F.lit(f"{m.name} {{ "), F.concat_ws(", ", *parts), F.lit(" }"))


def pb_debug(x: Column, m: MessageSchema, depth: int = 3) -> Column:
    """One line that names a message's fields in order of tag; enums by name where the number is known. Null for a null message."""
    return F.when(x.isNotNull(), _message(m, x, (), depth))
