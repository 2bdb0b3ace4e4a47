"""Message, enum and service schemas; their Spark types; validation and tag inference."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

MIN_TAG, MAX_TAG = 1, (1 << 29) - 1
VARINT = ("bool", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "enum")
FIXED32 = ("float", "fixed32", "sfixed32")
FIXED64 = ("double", "fixed64", "sfixed64")
LENGTH = ("string", "bytes", "message", "map")
#: Fixed values of the wire format.
WIRE_NAMES = ["Varint", "SixtyFourBit", "LengthDelimited", "StartGroup", "EndGroup", "ThirtyTwoBit"]
SPARK_TYPES = {
    "bool": T.BooleanType(), "int32": T.IntegerType(), "sint32": T.IntegerType(), "sfixed32": T.IntegerType(), "enum": T.IntegerType(),
    "int64": T.LongType(), "sint64": T.LongType(), "sfixed64": T.LongType(), "uint32": T.LongType(), "fixed32": T.LongType(),
    "uint64": T.DecimalType(20, 0), "fixed64": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "bytes": T.BinaryType(),
}
ZERO: dict[str, Any] = {"bool": False, "float": 0.0, "double": 0.0, "string": "", "bytes": b""}
KEY_KINDS = {"bool", "string", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64"}


class SchemaError(ValueError):
    """A schema that breaks a rule of the format."""


def wire_type(kind: str) -> int:
    if kind in VARINT:
        return 0
    if kind in FIXED64:
        return 1
    if kind in FIXED32:
        return 5
    return 3 if kind == "group" else 2


def can_pack(kind: str) -> bool:
    return wire_type(kind) in (0, 1, 5)


@dataclass
class EnumSchema:
    """Open enum: unknown numbers survive. The first value is the default; of names that share a number the first counts."""

    name: str
    values: list[tuple[str, int]]

    def __post_init__(self):
        if not self.values:
            raise SchemaError(f"enum {self.name} has no values")

    @property
    def default(self) -> int:
        return self.values[0][1]

    def names(self) -> dict[int, str]:
        out: dict[int, str] = {}
        for n, v in self.values:
            out.setdefault(v, n)
        return out

    def numbers(self) -> dict[str, int]:
        return dict(self.values)

    def short_names(self) -> dict[int, str]:
        """Value names without the enum's own name in front, for display."""
        head = to_upper_camel(self.name.rpartition(".")[2])
        out = {}
        for v, n in self.names().items():
            camel = to_upper_camel(n)
            rest = camel[len(head) :] if camel.startswith(head) else camel
            out[v] = rest if rest and rest[0].isupper() else camel
        return out


@dataclass
class Field:
    """label: plain (default is not sent), optional, required or repeated. `of`: the message or enum, or its full name
    in the registry. A map has kind "map" with key and value fields numbered 1 and 2. wrapped: a message of one field, value,
    that is a nullable column of that field's type; on the wire it stays a message."""

    name: str
    number: int | None
    kind: str
    label: str = "plain"
    of: Any = None
    packed: bool | None = None
    default: Any = None
    oneof: str | None = None
    key: Field | None = None
    value: Field | None = None
    doc: str = ""
    wrapped: bool = False

    def is_packed(self) -> bool:
        return self.label == "repeated" and can_pack(self.kind) and self.packed is not False

    def zero(self) -> Any:
        if self.default is not None:
            return self.default
        if self.kind == "enum":
            return self.of.default if isinstance(self.of, EnumSchema) else 0
        return ZERO.get(self.kind, 0)


@dataclass
class MessageSchema:
    name: str
    fields: list[Field]
    package: str = ""
    url_domain: str = ""
    registry: Registry | None = field(default=None, repr=False)
    doc: str = ""

    def __post_init__(self):
        last = 0
        for f in self.fields:
            if f.number is None:
                if f.oneof:
                    raise SchemaError(f"oneof field {self.name}.{f.name} needs a tag")
                f.number = last + 1
            last = max(last, f.number)
        self.validate()

    @property
    def full_name(self) -> str:
        return f"{self.package}.{self.name}" if self.package else self.name

    @property
    def type_url(self) -> str:
        return f"{self.url_domain}/{self.full_name}"

    def validate(self) -> None:
        seen: set[int] = set()
        for f in self.fields:
            if not MIN_TAG <= f.number <= MAX_TAG:
                raise SchemaError(f"invalid tag {f.number} of {self.name}.{f.name}")
            if f.number in seen:
                raise SchemaError(f"message {self.name} has multiple fields with tag {f.number}")
            seen.add(f.number)
            if f.packed and not (f.label == "repeated" and can_pack(f.kind)):
                raise SchemaError("packed attribute may only be applied to numeric repeated fields")
            if f.default is not None and f.label == "repeated":
                raise SchemaError("default may not be applied to repeated fields")
            if f.oneof and f.label not in ("plain", "optional"):
                raise SchemaError("a oneof field may not be repeated or required")
            if f.kind == "map" and (f.key is None or f.value is None or f.key.kind not in KEY_KINDS):
                raise SchemaError(f"invalid map key of {self.name}.{f.name}")
            if f.kind not in SPARK_TYPES and f.kind not in ("message", "group", "map"):
                raise SchemaError(f"unknown kind {f.kind}")

    def message(self, f: Field) -> MessageSchema:
        return self.registry.messages[f.of] if isinstance(f.of, str) else f.of

    def units(self) -> list[tuple[str, list[Field]]]:
        """Columns in order of tag: a field by itself, or a oneof (name, members) at its lowest tag."""
        out: dict[str, list[Field]] = {}
        for f in sorted(self.fields, key=lambda f: f.number):
            out.setdefault(f.oneof or f.name, []).append(f)
        return list(out.items())

    def is_recursive(self, f: Field) -> bool:
        """Whether non-repeated fields lead from f's message back to this one."""
        if f.kind not in ("message", "group"):
            return False
        todo, seen = [self.message(f)], set()
        while todo:
            m = todo.pop()
            if m.full_name == self.full_name:
                return True
            if m.full_name not in seen:
                seen.add(m.full_name)
                todo += [m.message(x) for x in m.fields if x.kind in ("message", "group") and x.label != "repeated"]
        return False

    def struct(self, depth: int = 3, above: tuple[str, ...] = ()) -> T.StructType:
        """Spark type. A message inside itself is unrolled `depth` times; below that its bytes are kept."""
        above = (*above, self.full_name)
        cols = []
        for name, members in self.units():
            if members[0].oneof:
                kind = T.StructType([T.StructField(f.name, self.field_type(f, depth, above), True) for f in members])
                cols.append(T.StructField(name, kind, True))
            else:
                f = members[0]
                kind = self.field_type(f, depth, above)
                if f.label == "repeated" and f.kind != "map":
                    kind = T.ArrayType(kind, False)
                cols.append(T.StructField(f.name, kind, f.label == "optional" or (f.kind in ("message", "group") and f.label == "plain")))
        return T.StructType(cols)

    def field_type(self, f: Field, depth: int, above: tuple[str, ...]) -> T.DataType:
        if f.kind == "map":
            return T.MapType(self.field_type(f.key, depth, above), self.field_type(f.value, depth, above), False)
        if f.kind in ("message", "group"):
            m = self.message(f)
            if f.wrapped:
                return SPARK_TYPES[m.fields[0].kind]
            return T.BinaryType() if above.count(m.full_name) > depth else m.struct(depth, above)
        return SPARK_TYPES[f.kind]

    def pruned(self, names: list[str]) -> MessageSchema:
        """The schema of some fields only: decoding skips the others."""
        keep = [f for f in self.fields if f.name in names or f.oneof in names]
        return MessageSchema(self.name, keep, self.package, self.url_domain, self.registry)

    def defaults(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name, members in self.units():
            f = members[0]
            if f.oneof or f.label == "optional" or (f.kind in ("message", "group") and f.label == "plain"):
                out[name] = None
            elif f.kind == "map":
                out[name] = {}
            elif f.label == "repeated":
                out[name] = []
            elif f.kind in ("message", "group"):
                out[name] = self.message(f).defaults()
            else:
                out[name] = f.zero()
        return out


@dataclass
class Method:
    name: str
    input: str
    output: str
    client_streaming: bool = False
    server_streaming: bool = False


@dataclass
class Service:
    name: str
    package: str
    methods: list[Method]
    doc: str = ""


@dataclass
class Registry:
    """Messages, enums and services by full name."""

    messages: dict[str, MessageSchema] = field(default_factory=dict)
    enums: dict[str, EnumSchema] = field(default_factory=dict)
    services: dict[str, Service] = field(default_factory=dict)

    def add(self, m: MessageSchema) -> MessageSchema:
        m.registry = self
        self.messages[m.full_name] = m
        return m

    def to_df(self, spark):
        """(message, field, number, kind, label, type, oneof, packed, doc): the schema as rows."""
        rows = []
        for name, m in sorted(self.messages.items()):
            for f in m.fields:
                of = f.of if isinstance(f.of, str) else getattr(f.of, "full_name", getattr(f.of, "name", None))
                rows.append((name, f.name, f.number, f.kind, f.label, of, f.oneof, f.is_packed(), f.doc))
        return spark.createDataFrame(rows, "message string, field string, number int, kind string, label string, type string, oneof string, packed boolean, doc string")

    def services_df(self, spark):
        rows = [(s, m.name, m.input, m.output, m.client_streaming, m.server_streaming) for s, v in sorted(self.services.items()) for m in v.methods]
        return spark.createDataFrame(rows, "service string, method string, input string, output string, client_streaming boolean, server_streaming boolean")


def words(name: str) -> list[str]:
    """An identifier's words: cut at non-alphanumerics, before a capital after a small letter, and before the last capital of a run."""
    out, word = [], ""
    for i, c in enumerate(name):
        if not c.isalnum():
            out, word = ([*out, word] if word else out), ""
            continue
        nxt = name[i + 1] if i + 1 < len(name) else ""
        if word and c.isupper() and (word[-1].islower() or word[-1].isupper() and nxt.islower()):
            out, word = [*out, word], ""
        word += c
    return [*out, word] if word else out


def to_snake(name: str) -> str:
    return "_".join(w.lower() for w in words(name))


def to_upper_camel(name: str) -> str:
    return "".join(w[:1].upper() + w[1:].lower() for w in words(name))


def unescape(text: str) -> bytes:
    """C escapes of a bytes default."""
    simple = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, "'": 39, '"': 34, "?": 63}
    out, i, raw = bytearray(), 0, text
    while i < len(raw):
        c = raw[i]
        i += 1
        if c != "\\":
            out += c.encode()
            continue
        if i >= len(raw):
            raise SchemaError("missing escape character")
        c = raw[i]
        i += 1
        if c in simple:
            out.append(simple[c])
        elif c in "01234567":
            digits = c
            while len(digits) < 3 and i < len(raw) and raw[i] in "01234567":
                digits, i = digits + raw[i], i + 1
            value = int(digits, 8)
            if value > 255:
                raise SchemaError(f"octal escape out of range: {digits}")
            out.append(value)
        elif c in "xX":
            digits = ""
            while len(digits) < 2 and i < len(raw) and raw[i] in "0123456789abcdefABCDEF":
                digits, i = digits + raw[i], i + 1
            if not digits:
                raise SchemaError("hexadecimal escape needs digits")
            out.append(int(digits, 16))
        else:
            raise SchemaError(f"unknown escape: \\{c}")
    return bytes(out)


def parse_default(kind: str, text: str) -> Any:
    """A proto2 default literal."""
    if kind == "bool":
        if text not in ("true", "false"):
            raise SchemaError(f"invalid default {text}")
        return text == "true"
    if kind == "string":
        return text
    if kind == "bytes":
        return unescape(text)
    if kind in ("float", "double"):
        return float(text)
    try:
        value = int(text, 0)
    except ValueError as e:
        raise SchemaError(f"invalid default {text}") from e
    bits, low = (32 if "32" in kind or kind == "enum" else 64), kind.startswith(("uint", "fixed"))
    if not (0 if low else -(1 << bits - 1)) <= value < (1 << bits if low else 1 << bits - 1):
        raise SchemaError(f"default {text} is out of range for {kind}")
    return value


class PathOptions:
    """Options by path, most particular first: exact, then suffixes, then prefixes, then "." for all."""

    def __init__(self, items: dict[str, Any]):
        self.items = {k.strip("."): v for k, v in items.items() if k != "."}
        self.exact = {k.strip(".") for k in items if k.startswith(".") and k != "."}
        self.common = items.get(".")

    def get(self, path: str) -> Any:
        parts = path.strip(".").split(".")
        full = ".".join(parts)
        if full in self.items:
            return self.items[full]
        for i in range(1, len(parts)):
            tail = ".".join(parts[i:])
            if tail in self.items and tail not in self.exact:
                return self.items[tail]
        for i in range(len(parts) - 1, 0, -1):
            head = ".".join(parts[:i])
            if head in self.exact:
                return self.items[head]
        return self.common
