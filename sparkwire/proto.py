"""Schemas from .proto text and from descriptor sets."""

from __future__ import annotations

import re

from .operators.decode import Parser
from .schema import EnumSchema, Field, MessageSchema, Method, PathOptions, Registry, SchemaError, Service, can_pack, parse_default, unescape

SCALARS = {"double", "float", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "bool", "string", "bytes"}
#: Type numbers of field descriptors.
TYPE_NUMBERS = {1: "double", 2: "float", 3: "int64", 4: "uint64", 5: "int32", 6: "fixed64", 7: "fixed32", 8: "bool", 9: "string", 10: "group", 11: "message", 12: "bytes", 13: "uint32", 14: "enum", 15: "sfixed32", 16: "sfixed64", 17: "sint32", 18: "sint64"}

_TOKEN = re.compile(r"""\s+|//(?P<line>[^\n]*)|/\*(?P<block>.*?)\*/|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<num>[+-]?(?:0[xX][0-9a-fA-F]+|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+))|(?P<id>\.?[A-Za-z_][\w.]*)|(?P<op>[{}\[\]()<>=;,:+-])""", re.S)


def detect_syntax(syntax: str | None) -> str:
    if syntax in (None, "", "proto2"):
        return "proto2"
    if syntax == "proto3":
        return "proto3"
    raise SchemaError(f"unknown syntax: {syntax}")


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.docs, at, doc = [], {}, 0, []
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"unexpected character {text[at]!r}")
            at = m.end()
            note = m["line"] if m["line"] is not None else m["block"]
            if note is not None:
                doc.append(note.strip(" *"))
            elif m.lastgroup:
                self.docs[len(self.tokens)] = "\n".join(doc)
                doc = []
                self.tokens.append(m[0])
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        t = self.peek()
        if not t:
            raise SchemaError("unexpected end of file")
        self.at += 1
        return t

    def want(self, *tokens: str) -> str:
        t = self.next()
        if t not in tokens:
            raise SchemaError(f"expected {' or '.join(tokens)}, got {t}")
        return t

    def skip_block(self) -> None:
        depth = 0
        while True:
            t = self.next()
            depth += (t == "{") - (t == "}")
            if depth <= 0 and t in (";", "}"):
                return


def _text(token: str) -> str:
    return unescape(token[1:-1]).decode()


def _options(r: _Reader) -> dict[str, str]:
    out: dict[str, str] = {}
    if r.peek() != "[":
        return out
    r.next()
    while r.peek() != "]":
        name = ""
        while r.peek() != "=":
            name += r.next()
        r.next()
        value = r.next()
        if value in "+-":
            value += r.next()
        if value == "{":
            depth = 1
            while depth:
                t = r.next()
                depth += (t == "{") - (t == "}")
        while value[:1] in "\"'" and r.peek()[:1] in "\"'" and r.peek():
            value = value[:-1] + r.next()[1:]
        out[name] = value
        if r.peek() == ",":
            r.next()
    r.next()
    return out


class _File:
    """Reads one file's text into flat lists; type names are resolved once all files are read."""

    def __init__(self, text: str, reg: Registry):
        self.r, self.reg, self.package, self.syntax = _Reader(text), reg, "", "proto2"
        self.imports: list[str] = []
        self.open: list[tuple[Field, str]] = []

    def read(self) -> None:
        r = self.r
        while r.peek():
            doc, t = r.docs.get(r.at, ""), r.next()
            if t == "syntax":
                r.want("=")
                self.syntax = detect_syntax(_text(r.next()))
                r.want(";")
            elif t == "edition":
                raise SchemaError("editions are not supported")
            elif t == "package":
                self.package = r.next()
                r.want(";")
            elif t == "import":
                name = r.next()
                if name in ("public", "weak"):
                    name = r.next()
                self.imports.append(_text(name))
                r.want(";")
            elif t == "message":
                self.message(r.next(), "", doc)
            elif t == "enum":
                self.enum(r.next(), "")
            elif t == "service":
                self.service(r.next(), doc)
            elif t != ";":
                r.skip_block()  # options and extensions

    def enum(self, name: str, scope: str) -> None:
        r, values = self.r, []
        r.want("{")
        while (t := r.next()) != "}":
            if t in ("option", "reserved"):
                r.skip_block()
            elif t != ";":
                r.want("=")
                values.append((t, int(r.next(), 0)))
                _options(r)
                r.want(";")
        full = ".".join(x for x in (self.package, scope, name) if x)
        self.reg.enums[full] = EnumSchema(f"{scope}.{name}" if scope else name, values)

    def message(self, name: str, scope: str, doc: str = "") -> None:
        r, path = self.r, f"{scope}.{name}" if scope else name
        fields: list[Field] = []
        r.want("{")
        while r.peek() != "}":
            note = r.docs.get(r.at, "")
            t = r.next()
            if t == "message" and r.peek() not in ("=",):
                self.message(r.next(), path, note)
            elif t == "enum":
                self.enum(r.next(), path)
            elif t == "oneof":
                own = r.next()
                r.want("{")
                while r.peek() != "}":
                    if r.peek() == "option":
                        r.skip_block()
                        continue
                    f = self.field(r.next(), "plain", path, r.docs.get(r.at, ""))
                    f.oneof = own
                    fields.append(f)
                r.next()
            elif t in ("option", "reserved", "extensions", "extend"):
                r.skip_block()
            elif t in ("optional", "required", "repeated"):
                fields.append(self.field(r.next(), t, path, note))
            elif t != ";":
                fields.append(self.field(t, "plain", path, note))
        r.next()
        full = path if not self.package else f"{self.package}.{path}"
        self.reg.messages[full] = MessageSchema.__new__(MessageSchema)
        m = self.reg.messages[full]
        m.name, m.package, m.fields, m.registry, m.url_domain, m.doc = path, self.package, fields, self.reg, "", doc
        self.reg.messages[full] = m

    def field(self, kind: str, label: str, path: str, doc: str) -> Field:
        r = self.r
        if kind == "map":
            r.want("<")
            key = Field("key", 1, r.next())
            r.want(",")
            of = r.next()
            r.want(">")
            f = Field(r.next(), None, "map", "plain", key=key, value=self.typed("value", 2, of, path))
            r.want("=")
            f.number = int(r.next(), 0)
            _options(r)
            r.want(";")
            return f
        if kind == "group":
            name = r.next()
            r.want("=")
            number = int(r.next(), 0)
            _options(r)
            self.message(name, path)
            f = self.typed(name.lower(), number, name, path)
            f.kind, f.label = "group", "plain" if label == "optional" else label
            self.open[-1] = (f, path)
            return f
        name = r.next()
        r.want("=")
        f = self.typed(name, int(r.next(), 0), kind, path)
        options = _options(r)
        r.want(";")
        f.label, f.doc = label, doc
        if "default" in options:
            raw = options["default"]
            f.default = raw if f.kind == "enum" or f.kind == "message" else parse_default(f.kind, raw[1:-1] if f.kind == "bytes" else _text(raw) if f.kind == "string" else raw)
        if label == "repeated":
            said = None if f.kind == "message" else self.syntax == "proto3" and can_pack(f.kind)  # an enum is not yet known as one
            f.packed = options["packed"] == "true" if "packed" in options else said
            f.doc = doc
        return f

    def typed(self, name: str, number: int, kind: str, path: str) -> Field:
        f = Field(name, number, kind)
        if kind not in SCALARS:
            f.kind, f.of = "message", kind
            self.open.append((f, path))
        return f


def _resolve(reg: Registry, name: str, package: str, path: str) -> str:
    if name.startswith("."):
        return name[1:]
    scope = [x for x in f"{package}.{path}".split(".") if x]
    for n in range(len(scope), -1, -1):
        full = ".".join([*scope[:n], name])
        if full in reg.messages or full in reg.enums:
            return full
    raise SchemaError(f"unknown type {name}")


def is_wrapper(name: str) -> bool:
    from .functions.wkt import PACKAGE, WRAPPERS

    return name.startswith(f"{PACKAGE}.") and name[len(PACKAGE) + 1 :] in WRAPPERS


def compile_protos(sources: dict[str, str], url_domain: str = "", well_known: Registry | None = None, wrappers: bool = True) -> Registry:
    """Registry of the messages, enums and services of .proto texts by file name. Imports must be among them, but for the well-known types.

    wrappers: fields of the wrapper messages (Int32Value, ...) are nullable columns of their values; without it structs."""
    if well_known is None:
        from .functions.wkt import registry

        well_known = registry()
    reg = Registry(dict(well_known.messages), dict(well_known.enums))
    files = []
    for name, text in sources.items():
        f = _File(text, reg)
        f.read()
        files.append(f)
        for i in f.imports:
            if i not in sources and not i.startswith("google/protobuf/"):
                raise SchemaError(f"{name}: import {i} is missing")
    for file in files:
        for f, path in file.open:
            full = _resolve(reg, f.of, file.package, path)
            if full in reg.enums:
                f.kind, f.of = "enum", reg.enums[full]
                if isinstance(f.default, str):
                    f.default = f.of.numbers()[f.default]
                if f.label == "repeated" and f.packed is None:
                    f.packed = file.syntax == "proto3"
            else:
                f.of, f.wrapped = full, wrappers and is_wrapper(full)
                if f.kind == "message" and f.label == "optional":
                    f.label = "plain"
                f.packed = None
    for m in reg.messages.values():
        if m.registry is reg or m.registry is None:
            m.registry, m.url_domain = reg, m.url_domain or url_domain
            for f in m.fields:
                if f.label == "repeated" and not (can_pack(f.kind)):
                    f.packed = None
            m.validate()
    return reg


def _service(self: _File, name: str, doc: str) -> None:
    r, methods = self.r, []
    r.want("{")
    while (t := r.next()) != "}":
        if t != "rpc":
            if t != ";":
                r.skip_block()
            continue
        own, sides = r.next(), []
        for _ in range(2):
            r.want("(")
            stream = r.peek() == "stream" and self.r.tokens[r.at + 1] != ")"
            if stream:
                r.next()
            sides.append((r.next(), stream))
            r.want(")")
            if r.peek() == "returns":
                r.next()
        if r.peek() == "{":
            r.skip_block()
        else:
            r.want(";")
        methods.append(Method(own, sides[0][0], sides[1][0], sides[0][1], sides[1][1]))
    full = f"{self.package}.{name}" if self.package else name
    self.reg.services[full] = Service(name, self.package, methods, doc)


_File.service = _service


def descriptor_schema() -> Registry:
    """The part of the descriptor messages that schemas are made from: a descriptor set is read with the decoder it describes."""
    reg = Registry()

    def msg(name: str, *fields: Field) -> None:
        reg.add(MessageSchema(name, list(fields), "google.protobuf", registry=reg))

    def sub(name: str, n: int, of: str, label: str = "repeated") -> Field:
        return Field(name, n, "message", label, of=f"google.protobuf.{of}")

    def opt(name: str, n: int, kind: str) -> Field:
        return Field(name, n, kind, "optional")

    msg("FileDescriptorSet", sub("file", 1, "FileDescriptorProto"))
    msg("FileDescriptorProto", opt("name", 1, "string"), opt("package", 2, "string"), Field("dependency", 3, "string", "repeated"), sub("message_type", 4, "DescriptorProto"), sub("enum_type", 5, "EnumDescriptorProto"), sub("service", 6, "ServiceDescriptorProto"), opt("syntax", 12, "string"))
    msg("DescriptorProto", opt("name", 1, "string"), sub("field", 2, "FieldDescriptorProto"), sub("nested_type", 3, "DescriptorProto"), sub("enum_type", 4, "EnumDescriptorProto"), sub("options", 7, "MessageOptions", "plain"), sub("oneof_decl", 8, "OneofDescriptorProto"))
    msg("MessageOptions", opt("map_entry", 7, "bool"))
    msg("OneofDescriptorProto", opt("name", 1, "string"))
    msg("FieldDescriptorProto", opt("name", 1, "string"), opt("extendee", 2, "string"), opt("number", 3, "int32"), opt("label", 4, "int32"), opt("type", 5, "int32"), opt("type_name", 6, "string"), opt("default_value", 7, "string"), sub("options", 8, "FieldOptions", "plain"), opt("oneof_index", 9, "int32"), opt("json_name", 10, "string"), opt("proto3_optional", 17, "bool"))
    msg("FieldOptions", opt("packed", 2, "bool"), opt("deprecated", 3, "bool"))
    msg("EnumDescriptorProto", opt("name", 1, "string"), sub("value", 2, "EnumValueDescriptorProto"))
    msg("EnumValueDescriptorProto", opt("name", 1, "string"), opt("number", 2, "int32"))
    msg("ServiceDescriptorProto", opt("name", 1, "string"), sub("method", 2, "MethodDescriptorProto"))
    msg("MethodDescriptorProto", opt("name", 1, "string"), opt("input_type", 2, "string"), opt("output_type", 3, "string"), opt("client_streaming", 5, "bool"), opt("server_streaming", 6, "bool"))
    return reg


def load_descriptor_set(raw: bytes, extern: dict[str, str] | None = None, wrappers: bool = True) -> Registry:
    """Registry of a FileDescriptorSet. extern: full names (or prefixes) of messages of one field 1 to the scalar kinds that stand for
    them, as nullable columns; on the wire they stay messages. wrappers: so the wrapper messages (Int32Value, ...) too."""
    from .functions.wkt import PACKAGE, WRAPPERS

    files = Parser(descriptor_schema().messages["google.protobuf.FileDescriptorSet"], depth=32).parse(raw)["file"]
    reg, entries, swap = Registry(), {}, PathOptions(extern or {})
    proto3 = {}

    def enum(e: dict, scope: str) -> None:
        full = f"{scope}.{e['name']}" if scope else e["name"]
        reg.enums[full] = EnumSchema(e["name"], [(v["name"], v["number"] or 0) for v in e["value"]])

    def walk(d: dict, package: str, path: str) -> None:
        own = f"{path}.{d['name']}" if path else d["name"]
        full = f"{package}.{own}" if package else own
        for e in d["enum_type"]:
            enum(e, full)
        for n in d["nested_type"]:
            walk(n, package, own)
        entries[full] = (d, package, own)

    for f in files:
        syntax, package = detect_syntax(f["syntax"]), f["package"] or ""
        for e in f["enum_type"]:
            enum(e, package)
        before = set(entries)
        for d in f["message_type"]:
            walk(d, package, "")
        proto3 |= dict.fromkeys(set(entries) - before, syntax == "proto3")
        for s in f["service"]:
            full = f"{package}.{s['name']}" if package else s["name"]
            reg.services[full] = Service(s["name"], package, [Method(m["name"], m["input_type"].lstrip("."), m["output_type"].lstrip("."), bool(m["client_streaming"]), bool(m["server_streaming"])) for m in s["method"]])

    def is_map(name: str) -> bool:
        return bool((entries.get(name, ({},))[0].get("options") or {}).get("map_entry"))

    def make(d: dict, new: bool, x: dict) -> Field:
        kind, name = TYPE_NUMBERS[x["type"]], (x["type_name"] or "").lstrip(".")
        label = {2: "required", 3: "repeated"}.get(x["label"], "plain")
        f = Field(x["name"], x["number"], kind, label)
        if kind == "message" and is_map(name):
            k, v = sorted(entries[name][0]["field"], key=lambda y: y["number"])
            f.kind, f.label, f.key, f.value = "map", "plain", make(d, new, k), make(d, new, v)
            return f
        scalar = swap.get(name) or (WRAPPERS[name[len(PACKAGE) + 1 :]] if wrappers and is_wrapper(name) else None)
        if kind == "message" and scalar:
            own, _, last = name.rpartition(".")
            f.wrapped, f.of = True, MessageSchema(last, [Field("value", 1, scalar)], own, "type.googleapis.com")
        elif kind in ("message", "group"):
            f.of = name
        elif kind == "enum":
            f.of = reg.enums[name]
        if label == "plain" and kind not in ("message", "group") and (x["proto3_optional"] or not new):
            f.label = "optional"
        if label == "repeated" and can_pack(kind):
            said = (x["options"] or {}).get("packed")
            f.packed = new if said is None else said
        if x["default_value"] is not None and label != "repeated":
            f.default = f.of.numbers()[x["default_value"]] if kind == "enum" else parse_default(kind, x["default_value"])
        if x["oneof_index"] is not None and not x["proto3_optional"]:
            f.oneof, f.label = d["oneof_decl"][x["oneof_index"]]["name"], "plain"
        return f

    for full, (d, package, own) in entries.items():
        if not is_map(full):
            reg.add(MessageSchema(own, [make(d, proto3[full], x) for x in d["field"]], package, registry=reg))
    return reg
