"""Golden bytes, error texts, round trips and well-known types."""

import datetime
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwire.functions import structs, wire, wkt
from sparkwire.functions.sql import register_functions
from sparkwire.operators import encode as E
from sparkwire.operators.debug import pb_debug
from sparkwire.operators.decode import LIMIT, DecodeError, Parser, pb_decode, pb_merge, read_key, read_varint, skip, wire_fields
from sparkwire.proto import compile_protos, load_descriptor_set
from sparkwire.schema import EnumSchema, Field, MessageSchema, PathOptions, Registry, SchemaError, to_snake, to_upper_camel, unescape

GOLDEN = {0: "00", 1: "01", 127: "7F", 128: "8001", 300: "AC02", 1 << 14: "808001", 1 << 35: "808080808001", (1 << 64) - 1: "FFFFFFFFFFFFFFFFFF01"}


def test_varint_golden(spark):
    for value, text in GOLDEN.items():
        assert wire.host_varint(value).hex().upper() == text
        assert read_varint(bytes.fromhex(text), 0, len(text) // 2) == (value, len(text) // 2)
    rows = [(v - (1 << 64) if v >> 63 else v, t) for v, t in GOLDEN.items()]
    df = spark.createDataFrame(rows, "v long, t string")
    got = df.select(wire.varint_hex(F.col("v")) == F.col("t"), wire.varint_len(F.col("v")) == F.length("t") / 2, wire.varint_value(F.unhex("t")) == F.col("v")).collect()
    assert all(all(r) for r in got)
    bad = spark.createDataFrame([("FFFFFFFFFFFFFFFFFF02",), ("80",), ("",)], "t string")
    assert [r[0] for r in bad.select(wire.varint_value(F.unhex("t"))).collect()] == [None] * 3


@given(st.integers(0, (1 << 64) - 1))
def test_varint_round_trip(x):
    b = wire.host_varint(x)
    assert read_varint(b, 0, len(b)) == (x, len(b))


def test_scalar_payloads(spark):
    df = spark.range(1).select(
        wire.scalar_hex("sint64", F.lit(-1).cast("bigint")), wire.scalar_hex("sfixed32", F.lit(-2)), wire.scalar_hex("double", F.lit(1.5)),
        wire.scalar_hex("int32", F.lit(-1)), wire.scalar_hex("uint64", F.lit("18446744073709551615").cast("decimal(20,0)")), wire.truncate32(F.lit(4294967295).cast("bigint")),
    )
    assert list(df.first()) == ["01", "FEFFFFFF", "000000000000F83F", "FFFFFFFFFFFFFFFFFF01", "FFFFFFFFFFFFFFFFFF01", -1]


ALL = MessageSchema(
    "All",
    [Field(f"plain_{k}", i, k) for i, k in enumerate(["bool", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "float", "double", "string", "bytes"], 1)]
    + [Field("opt", 20, "int32", "optional"), Field("req", 21, "int32", "required"), Field("many", 22, "sint32", "repeated"), Field("loose", 23, "int32", "repeated", packed=False), Field("m", 24, "map", key=Field("key", 1, "string"), value=Field("value", 2, "int64")), Field("a", 25, "int32", oneof="pick"), Field("b", 26, "string", oneof="pick")],
)


def test_message_round_trip_against_protobuf_runtime(spark):
    struct = ALL.struct()
    row = (True, -5, 1 << 40, 4000000000, "18446744073709551615", -7, -(1 << 50), 7, "9", -8, -9, 1.5, -2.25, "häß", bytearray(b"\0\xff"), 0, 0, [1, -1, 300], [1, 2], {"z": 1, "a": 0}, (None, "x"))
    from decimal import Decimal

    row = tuple(Decimal(v) if i in (4, 8) else v for i, v in enumerate(row))
    df = spark.createDataFrame([row, ALL_EMPTY], struct).select(F.struct("*").alias("m"))
    enc = df.select("m", E.pb_encode(F.col("m"), ALL).alias("raw"), E.pb_encoded_len(F.col("m"), ALL).alias("n"))
    got = pb_decode(enc, "raw", ALL, out="back").collect()
    assert all(r["back_error"] is None and len(r["raw"]) == r["n"] for r in got)
    full = next(r for r in got if r["m"]["plain_bool"])
    assert full["back"].asDict(True) == full["m"].asDict(True)
    empty = next(r for r in got if not r["m"]["plain_bool"])
    assert bytes(empty["raw"]).hex() == "a80100"  # only the required field is sent
    assert empty["back"]["opt"] is None and empty["back"]["req"] == 0 and empty["back"]["m"] == {} and empty["back"]["pick"] is None


from decimal import Decimal  # noqa: E402

ALL_EMPTY = (False, 0, 0, 0, Decimal(0), 0, 0, 0, Decimal(0), 0, 0, 0.0, 0.0, "", bytearray(b""), None, 0, [], [], {}, None)

ITEM = MessageSchema("Group", [Field("i2", 2, "int32", "optional")])
TEST1 = MessageSchema("Test1", [Field("groupa", 1, "group", of=ITEM)])


def test_groups_golden():
    for text in ("0B10200C", "0B30012B30FF012C10200C"):  # the second holds unknown fields and an unknown group
        assert Parser(TEST1).parse(bytes.fromhex(text)) == {"groupa": {"i2": 32}}
    other = MessageSchema("Test2", [Field("i14", 4, "int32", "optional"), Field("groupb", 5, "group", "repeated", of=MessageSchema("G", [Field("i16", 6, "int32", "optional")])), Field("i17", 7, "int32", "optional")])
    assert Parser(other).parse(bytes.fromhex("20402B30FF012C2B30012C3864")) == {"i14": 64, "groupb": [{"i16": 255}, {"i16": 1}], "i17": 100}


ERRORS = {
    "36": "invalid wire type value: 6", "FFFFFFFFFFFFFF01": "invalid key value: 1125899906842623", "00": "invalid tag value: 0", "12": "buffer underflow",
    "08FFFFFFFFFFFFFFFFFF": "One.v: invalid varint", "1A028080": "One.s: invalid string value: data is not UTF-8 encoded", "0A00": "One.v: invalid wire type: LengthDelimited (expected Varint)",
    "4C": "unexpected end group tag", "4B54": "unexpected end group tag", "220508FFFF": "One.sub: buffer underflow",
}
ONE = MessageSchema("One", [Field("v", 1, "int32"), Field("s", 3, "string"), Field("sub", 4, "message", of=MessageSchema("Sub", [Field("x", 1, "int32"), Field("y", 2, "string")]))])


@pytest.mark.parametrize("text", ERRORS)
def test_error_texts(text):
    want = ERRORS[text]
    raw = bytes.fromhex(text)
    with pytest.raises(DecodeError) as e:
        if text == "12":
            skip(b"\x05", 0, 1, 2, 2, LIMIT)
        else:
            Parser(ONE).parse(raw)
    assert str(e.value) == "failed to decode Protobuf message: " + want


#: A nested field is read against the end of all bytes; where it ends tells whether it ran past its own message.
OVERRUN = {
    "22031205411A0461626364": "One.sub: delimited length exceeded", "220208FF0801": "One.sub: delimited length exceeded", "2203120541": "Sub.y: One.sub: buffer underflow",
    "220208FF": "Sub.x: One.sub: invalid varint", "2205": "One.sub: buffer underflow", "22": "One.sub: invalid varint",
}


@pytest.mark.parametrize("text", OVERRUN)
def test_inner_length_and_paths(text):
    with pytest.raises(DecodeError) as e:
        Parser(ONE).parse(bytes.fromhex(text))
    assert str(e.value) == "failed to decode Protobuf message: " + OVERRUN[text]


@pytest.mark.parametrize("text", ["0B1020", "0B"])
def test_truncated_groups(text):
    with pytest.raises(DecodeError) as e:
        Parser(TEST1).parse(bytes.fromhex(text))
    assert str(e.value) == "failed to decode Protobuf message: Test1.groupa: invalid varint"


def test_packed_overrun():
    m = MessageSchema("P", [Field("v", 1, "int32", "repeated"), Field("f", 2, "fixed32", "repeated")])
    for text, want in (("0A01FF01", "P.v: delimited length exceeded"), ("12050000000000000000", "P.f: delimited length exceeded"), ("1203000000", "P.f: buffer underflow"), ("0A0501", "P.v: buffer underflow")):
        with pytest.raises(DecodeError) as e:
            Parser(m).parse(bytes.fromhex(text))
        assert str(e.value) == "failed to decode Protobuf message: " + want


def nested(depth):
    raw = b""
    for _ in range(depth):
        raw = b"\x0a" + wire.host_varint(len(raw)) + raw
    return raw


def test_recursion_limit_and_unrolling(spark):
    reg = Registry()
    a = reg.add(MessageSchema("A", [Field("a", 1, "message", of="A"), Field("n", 2, "int32")], registry=reg))
    deep = Parser(a, depth=200)
    deep.parse(nested(100))
    with pytest.raises(DecodeError, match="recursion limit reached"):
        deep.parse(nested(101))
    assert a.is_recursive(a.fields[0])
    df = spark.createDataFrame([(bytearray(nested(6)),)], "raw binary")
    got = pb_decode(df, "raw", a, depth=2)
    r = got.first()["message"]
    assert isinstance(r["a"]["a"]["a"], (bytes, bytearray))  # below the unrolled levels the bytes stay
    assert bytes(got.select(E.pb_encode(F.col("message"), a, 2).alias("x")).first()["x"]) == nested(6)
    # what is kept as bytes is checked all the same: depth, and bytes that are no message
    bad = {bytes(nested(101)): "recursion limit reached", b"\x0a\x08\x0a\x06\x0a\x04\x0a\x02\x10\xff": "invalid varint", bytes(nested(100)): None}
    df = spark.createDataFrame([(bytearray(k),) for k in bad], "raw binary")
    for depth in (1, 3):
        for r in pb_decode(df, "raw", a, depth=depth).collect():
            want = bad[bytes(r["raw"])]
            assert (r["message_error"] or "").endswith(want or "") and (want is None) == (r["message_error"] is None) == (r["message"] is not None)


def test_recursive_oneof_and_group_limits():
    reg = Registry()
    m = reg.add(MessageSchema("M", [Field("sub", 1, "message", of="M", oneof="kind"), Field("n", 2, "int32", oneof="kind"), Field("g", 3, "group", of="M")], registry=reg))
    Parser(m).parse(nested(100))
    Parser(m).parse(b"\x1b" * 100 + b"\x1c" * 100)
    for raw in (nested(101), b"\x1b" * 101 + b"\x1c" * 101):
        with pytest.raises(DecodeError, match="recursion limit reached"):
            Parser(m).parse(raw)


def test_start_group_bomb():
    with pytest.raises(DecodeError, match="recursion limit reached"):
        Parser(ONE).parse(b"\x43" * (1 << 20))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_decode_or_fail_cleanly(raw):
    try:
        Parser(ALL).parse(raw)
    except DecodeError as e:
        assert str(e).startswith("failed to decode Protobuf message: ")


def test_packed_both_ways_last_wins_and_merge(spark):
    m = MessageSchema("P", [Field("xs", 1, "int32", "repeated"), Field("v", 2, "int32")])
    assert Parser(m).parse(bytes.fromhex("0A02010208031005 1006".replace(" ", ""))) == {"xs": [1, 2, 3], "v": 6}
    df = spark.createDataFrame([(bytearray(b"\x10\x05"), bytearray(b"\x10\x06"))], "a binary, b binary").select(pb_merge(F.col("a"), F.col("b")).alias("raw"))
    assert pb_decode(df, "raw", m).first()["message"]["v"] == 6


def test_modes_pruning_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x08\x05")), (2, bytearray(b"\x08")), (3, None)], "message int, raw binary")
    got = {r["message"]: r for r in pb_decode(df, "raw", ONE, out="got").collect()}
    assert got[1]["got"]["v"] == 5 and got[2]["got"] is None and "invalid varint" in got[2]["got_error"] and got[3]["got_error"] is None
    assert pb_decode(df, "raw", ONE, out="got", mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="invalid varint"):
        pb_decode(df, "raw", ONE, out="got", mode="FAILFAST").collect()
    assert pb_decode(df, "raw", ONE, out="got", fields=["s"]).schema["got"].dataType.names == ["s"]
    assert wire_fields(df, "raw").where("message = 1").select("tag", "wire", "offset", "length").first()[:] == (1, 0, 1, 1)


def test_schema_rules():
    assert [f.number for f in MessageSchema("T", [Field("a", None, "int32"), Field("b", 5, "int32"), Field("c", None, "int32")]).fields] == [1, 5, 6]
    for fields in ([Field("a", 1, "int32"), Field("b", 1, "int32")], [Field("a", 0, "int32")], [Field("a", 1, "string", "repeated", packed=True)], [Field("a", 1, "map", key=Field("key", 1, "double"), value=Field("value", 2, "int32"))], [Field("a", None, "int32", oneof="x")]):
        with pytest.raises(SchemaError):
            MessageSchema("T", fields)
    assert to_snake("FooBar_bazHTTPServer") == "foo_bar_baz_http_server" and to_upper_camel("foo_barBaz") == "FooBarBaz"
    assert unescape(r"a\n\x41\101\\") == b"a\nAA\\"
    with pytest.raises(SchemaError):
        unescape(r"\777")
    o = PathOptions({".": 0, ".a.b": 1, "c": 2})
    assert (o.get(".a.b"), o.get(".a.b.x"), o.get(".z.c"), o.get(".q")) == (1, 1, 2, 0)
    e = EnumSchema("Kind", [("KIND_B", 1), ("KIND_A", 0), ("KIND_C", 1)])
    assert e.default == 1 and e.names()[1] == "KIND_B" and e.short_names()[0] == "A"


PROTO = """
syntax = "proto3";
package shop;  // a shop
import "google/protobuf/timestamp.proto";
// An order.
message Order {
  int64 id = 1;
  optional string note = 2;
  repeated int32 codes = 3;
  map<string, Line> lines = 4;
  oneof pay { double cash = 5; string card = 6; }
  google.protobuf.Timestamp at = 7;
  State state = 8;
  message Line { string sku = 1; repeated double prices = 2 [packed = false]; }
}
enum State { NEW = 0; DONE = 1; }
service Desk { rpc Put (Order) returns (stream Order); }
"""


def test_proto_text():
    r = compile_protos({"shop.proto": PROTO}, url_domain="shop.test")
    m = r.messages["shop.Order"]
    by = {f.name: f for f in m.fields}
    assert m.full_name == "shop.Order" and m.type_url == "shop.test/shop.Order" and m.doc == "An order."
    assert by["codes"].is_packed() and by["note"].label == "optional" and by["lines"].value.of == "shop.Order.Line" and by["cash"].oneof == "pay"
    assert not next(f for f in r.messages["shop.Order.Line"].fields if f.name == "prices").is_packed()
    assert by["state"].kind == "enum" and by["at"].of == "google.protobuf.Timestamp"
    assert r.services["shop.Desk"].methods[0].server_streaming
    with pytest.raises(SchemaError):
        compile_protos({"x.proto": 'edition = "2023";'})
    two = compile_protos({"x.proto": 'message M { optional int32 a = 1 [default = -0x10]; repeated int32 b = 2; required string c = 3 [default = "x\\n"]; }'}).messages["M"]
    assert two.fields[0].default == -16 and not two.fields[1].is_packed() and two.fields[2].default == "x\n"


def test_descriptor_set_against_runtime():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    f = pb.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    d = f.message_type.add(name="M")
    d.field.add(name="id", number=1, type=3, label=1)
    d.field.add(name="xs", number=2, type=5, label=3)
    d.field.add(name="w", number=3, type=11, label=1, type_name=".google.protobuf.Int32Value")
    d.field.add(name="k", number=4, type=14, label=1, type_name=".t.K")
    e = d.nested_type.add(name="MmEntry")
    e.options.map_entry = True
    e.field.add(name="key", number=1, type=9, label=1)
    e.field.add(name="value", number=2, type=5, label=1)
    d.field.add(name="mm", number=5, type=11, label=3, type_name=".t.M.MmEntry")
    k = f.enum_type.add(name="K")
    k.value.add(name="K0", number=0)
    r = load_descriptor_set(pb.FileDescriptorSet(file=[f]).SerializeToString(), extern={".google.protobuf.Int32Value": "int32"})
    by = {x.name: x for x in r.messages["t.M"].fields}
    assert by["xs"].is_packed() and by["w"].wrapped and r.messages["t.M"].message(by["w"]).fields[0].kind == "int32" and by["mm"].kind == "map" and by["k"].of.name == "K"


STAMPS = {(0, 123450000): "1970-01-01T00:00:00.123450Z", (-1, 500000000): "1969-12-31T23:59:59.500Z", ((1 << 63) - 1, 0): "+292277026596-12-04T15:30:07Z", (-62167219201, 0): "-0001-12-31T23:59:59Z", (0, 0): "1970-01-01T00:00:00Z"}
TEXTS = {"1996-12-19T16:39:57-08:00": (851042397, 0), "1990-12-31T23:59:60Z": (662687999, 0), "2020-06-15 00:01:02.123 +0800": (1592150462, 123000000), "2020-06-15": (1592179200, 0), "19+1-+2-+3T+4:+5:+6Z": None, "2021-02-29": None, "": None}


def test_timestamps(spark):
    df = spark.createDataFrame([((s, n), t) for (s, n), t in STAMPS.items()], "t struct<seconds:bigint,nanos:int>, x string")
    for r in df.select("x", wkt.timestamp_format(F.col("t")).alias("got")).collect():
        assert r["got"] == r["x"]
    got = spark.createDataFrame([(t,) for t in TEXTS], "x string").select("x", wkt.timestamp_parse(F.col("x")).alias("t")).collect()
    assert {r["x"]: tuple(r["t"]) if r["t"] else None for r in got} == TEXTS


def test_parse_agrees_with_datetime(spark):
    rng, want = random.Random(11), {}
    for _ in range(400):
        x = datetime.datetime(1, 1, 1) + datetime.timedelta(days=rng.randrange(3_652_059), microseconds=rng.randrange(86_400_000_000))
        s = int((x.replace(microsecond=0) - datetime.datetime(1970, 1, 1)).total_seconds())
        want[f"{x.year:04}-{x.month:02}-{x.day:02}T{x.hour:02}:{x.minute:02}:{x.second:02}.{x.microsecond:06}Z"] = (s, x.microsecond * 1000)
    odd = {
        "2020-01-01T00:00:00+23:59": (1577836800 - 86340, 0), "2020-01-01T00:00:00-0130": (1577836800 + 5400, 0), "2020-01-01 00:00:00 z": (1577836800, 0), "2020-01-01T24:00:00Z": None, "2020-01-01T00:00:61Z": None,
        "2020-01-01T00:00:00.1234567899Z": (1577836800, 123456789), "+292277026596-12-04T15:30:07Z": ((1 << 63) - 1, 0), "+292277026596-12-04T15:30:08Z": None, "-292277022657-01-27T08:29:52Z": (-(1 << 63), 0),
        "-292277022657-01-27T08:29:51Z": None, "+99999999999999999999999999999999999999999-01-01": None, "2020-01-01T00:00:00+24": None, "2020-1-01": None, "2020-01-01\n": None, "2000-02-29": (951782400, 0), "1900-02-29": None,
        "0000-01-01": (-62167219200, 0), "-0001-12-31": (-62167305600, 0), "2020-01-01T": None, "2020-00-01": None,
    }
    want |= odd
    df = spark.createDataFrame([(k,) for k in want], "x string")
    rows = df.select("x", wkt.timestamp_parse(F.col("x")).alias("t"), wkt.timestamp_error(F.col("x")).alias("e")).collect()
    assert {r["x"]: tuple(r["t"]) if r["t"] else None for r in rows} == want
    assert all((r["t"] is None) == (r["e"] == wkt.BAD_TIMESTAMP) for r in rows)


def test_debug_text(spark):
    e = EnumSchema("Kind", [("ZERO", 0), ("TWO", 2)])
    inner = MessageSchema("Inner", [Field("x", 1, "int32")])
    m = MessageSchema("Basic", [
        Field("int32", 1, "int32"), Field("bools", 2, "bool", "repeated", packed=False), Field("string", 3, "string"), Field("optional_string", 4, "string", "optional"), Field("enumeration", 5, "enum", of=e),
        Field("enumeration_map", 6, "map", key=Field("key", 1, "int32"), value=Field("value", 2, "enum", of=e)), Field("bytes_map", 7, "map", key=Field("key", 1, "string"), value=Field("value", 2, "bytes")),
        Field("int", 8, "int32", oneof="of"), Field("enumeration_of", 10, "enum", oneof="of", of=e), Field("sub", 11, "message", of=inner), Field("d", 12, "double"), Field("none", 13, "message", of=MessageSchema("None_", [])),
    ])
    rows = [
        (0, [], "", None, 0, {}, {}, None, None, 0.0, None),
        (-1, [True, False], 'a"\n', "x", 42, {0: 2}, {"hello": bytearray(b"world")}, (None, 2), (7,), 12345678.5, ()),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, m.struct()).select(pb_debug(F.struct("*"), m)).collect()]
    assert got == [
        'Basic { int32: 0, bools: [], string: "", optional_string: None, enumeration: ZERO, enumeration_map: {}, bytes_map: {}, of: None, sub: None, d: 0.0, none: None }',
        'Basic { int32: -1, bools: [true, false], string: "a\\"\\n", optional_string: Some("x"), enumeration: 42, enumeration_map: {0: TWO}, bytes_map: {"hello": [119, 111, 114, 108, 100]}, '
        "of: Some(EnumerationOf(TWO)), sub: Some(Inner { x: 7 }), d: 12345678.5, none: Some(None_) }",
    ]


def test_structs_and_json(spark):
    texts = ['{"a":1,"b":[true,null,"é",1.5,{"":{}}],"c":{"d":[]}}', "{}", "[1]", "nonsense", None, '{"n":1e300}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = df.select("t", structs.json_to_struct(F.col("t")).alias("raw")).select("t", "raw", structs.struct_to_json(F.col("raw")).alias("back"), structs.variant_to_struct(structs.struct_to_variant(F.col("raw"))).alias("again"))
    for r in df.collect():
        good = r["t"] is not None and r["t"].startswith("{")
        assert (r["raw"] is not None) == good and (not good or json.loads(r["back"]) == json.loads(r["t"])) and r["again"] == r["raw"]
    deep = json.dumps({"k": [[[[[[[[{"x": [1]}]]]]]]]]})
    v = spark.range(1).select(structs.json_to_struct(F.lit(json.dumps([deep, {"z": None}])), "ListValue").alias("l"), structs.json_to_struct(F.lit("2.5"), "Value").alias("v"))
    r = v.select(structs.struct_to_json(F.col("l"), "ListValue").alias("l"), structs.struct_to_json(F.col("v"), "Value").alias("v")).first()
    assert json.loads(r["l"]) == [deep, {"z": None}] and r["v"] == "2.5"
    # the bytes are those of the schema's own encoder
    reg = wkt.registry()
    one = spark.createDataFrame([({"a": ((None, 1.0, None, None, None, None),)},)], reg.messages["google.protobuf.Struct"].struct(1))
    want = one.select(E.pb_encode(F.struct("*"), reg.messages["google.protobuf.Struct"], 1)).first()[0]
    assert spark.range(1).select(structs.json_to_struct(F.lit('{"a":1}'))).first()[0] == want


def test_functions_in_sql_text(spark):
    names = register_functions(spark, TEST1)
    assert names[-1] == "pb_decode_test1"
    for value, text in GOLDEN.items():
        v = value - (1 << 64) if value >> 63 else value
        assert tuple(spark.sql(f"SELECT hex(pb_varint({v}L)), pb_varint_len({v}L), pb_unzigzag(pb_zigzag({v}L))").first()) == (text, len(text) // 2, v)
    got = spark.sql("SELECT pb_decode_test1(unhex(h)) AS m FROM VALUES ('0B10200C'), ('0B1020'), (NULL) t(h)").collect()
    assert [r["m"] and r["m"]["groupa"]["i2"] for r in got] == [32, None, None]


def test_unframe_and_merge(spark):
    df = spark.createDataFrame([(bytearray.fromhex(h),) for h in ("020801", "00", "0308", "80", "", "0208010801")], "raw binary")
    got = [None if r[0] is None else bytes(r[0]).hex() for r in df.select(E.pb_unframe(F.col("raw"))).collect()]
    assert got == ["0801", "", None, None, None, "0801"]


def test_oneof_with_two_members_and_ranges(spark):
    m = MessageSchema("M", [Field("a", 1, "int32", oneof="pick"), Field("b", 2, "string", oneof="pick"), Field("u", 3, "uint32")])
    df = spark.createDataFrame([((1, "x"), 0)], m.struct())
    with pytest.raises(Exception, match="more than one member set"):
        df.select(E.pb_encode(F.struct("*"), m)).collect()
    for n in (-1, 1 << 32):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(None, n)], m.struct()).select(E.pb_encode(F.struct("*"), m)).collect()


def test_wrapped_fields(spark):
    """Nullable columns that are messages on the wire: alone, repeated, in maps and oneofs, merged, and by compiled schemas."""
    r = compile_protos({"w.proto": """syntax = "proto3"; package w;
        message M { google.protobuf.Int32Value i = 1; repeated google.protobuf.StringValue s = 2; map<string, google.protobuf.DoubleValue> d = 3;
          oneof pick { google.protobuf.BoolValue b = 4; int32 n = 5; } repeated K k = 6 [packed = false]; repeated K k2 = 7; }
        enum K { A = 0; B = 1; }"""})
    m = r.messages["w.M"]
    by = {f.name: f for f in m.fields}
    assert not by["k"].is_packed() and by["k2"].is_packed()
    assert m.struct().simpleString().startswith("struct<i:int,s:array<string>,d:map<string,double>,pick:struct<b:boolean,n:int>")
    rows = [(5, ["", "x"], {"a": 1.5, "z": 0.0}, (False, None), [1], [0, 1]), (None, [], {}, (None, 7), [], []), (0, ["q"], {}, None, [], [])]
    df = spark.createDataFrame(rows, m.struct()).select(F.struct("*").alias("m"))
    got = pb_decode(df.select("m", E.pb_encode(F.col("m"), m).alias("raw"), E.pb_encoded_len(F.col("m"), m).alias("n")), "raw", m, out="back", mode="FAILFAST").collect()
    assert all(x["back"] == x["m"] and len(x["raw"]) == x["n"] for x in got)
    assert bytes(got[2]["raw"]).hex() == "0a0012030a0171" and bytes(got[0]["raw"]).hex().startswith("0a0208051200" + "12030a0178")
    twice = spark.createDataFrame([(bytearray.fromhex("0a020805" + "0a00" + "2200" + "22020801"),)], "raw binary")
    x = pb_decode(twice, "raw", m, mode="FAILFAST").first()["message"]
    assert x["i"] == 5 and x["pick"]["b"] is True  # merged, as messages are
    assert not compile_protos({"w.proto": 'syntax = "proto3"; message M { google.protobuf.Int32Value i = 1; }'}, wrappers=False).messages["M"].fields[0].wrapped


def test_normalise_and_durations(spark):
    big = (1 << 63) - 1
    t = {(0, -1000000001): (-2, 999999999), (big, 1000000000): (big, 999999999), (-big - 1, -1): (-big - 1, 0), (1, 5): (1, 5)}
    d = {(-1, 1): (0, -999999999), (1, -1): (0, 999999999), (big, 1000000000): (big, 999999999), (2, 1500000000): (3, 500000000)}
    for table, f in ((t, wkt.timestamp_normalize), (d, wkt.duration_normalize)):
        df = spark.createDataFrame([(a, b) for a, b in table.items()], "a struct<seconds:bigint,nanos:int>, b struct<seconds:bigint,nanos:int>")
        assert all(r[0] for r in df.select(f(F.col("a")) == F.col("b")).collect())
    df = spark.createDataFrame([("-100.000000009s",), ("1.5s",), ("x",), ("1.s",), ("0.1234567899s",)], "x string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(wkt.duration_parse(F.col("x"))).collect()]
    assert got == [(-100, -9), (1, 500000000), None, None, (0, 123456789)]
    assert df.limit(1).select(wkt.duration_format(wkt.duration_parse(F.col("x")))).first()[0] == "-100.000000009s"


def test_type_urls_and_enums(spark):
    df = spark.createDataFrame([("a.b/x.Y",), ("/.x.Y",), ("noslash",), ("a/",)], "u string")
    assert [r[0] for r in df.select(wkt.type_name(F.col("u"))).collect()] == ["x.Y", None, None, None]
    e = EnumSchema("E", [("B", 3), ("A", 0)])
    df = spark.createDataFrame([(0,), (3,), (9,)], "x int")
    assert [tuple(r) for r in df.select(E.enum_name(F.col("x"), e), E.enum_get(F.col("x"), e)).collect()] == [("A", 0), ("B", 3), (None, 3)]
    with pytest.raises(Exception, match="unknown enumeration value 9"):
        df.select(E.enum_checked(F.col("x"), e)).collect()


def test_keys():
    assert read_key(bytes.fromhex("AA01"), 0, 2) == (21, 2, 2) and wire.key_len(15) == 1 and wire.key_len(16) == 2


def test_framed_files(spark, tmp_path):
    from sparkwire.sources.delimited import read_delimited, write_delimited
    from sparkwire.streaming.decode import read_stream_delimited

    df = spark.range(50).select(F.struct(F.col("id").cast("int").alias("v"), F.col("id").cast("string").alias("s"), F.lit(None).cast(ONE.struct()["sub"].dataType).alias("sub")).alias("m"))
    raw = df.select(E.pb_encode(F.col("m"), ONE).alias("raw"))
    for frame in ("varint", "u32le"):
        path = str(tmp_path / frame)
        write_delimited(raw.repartition(3), "raw", path, frame)
        got = read_delimited(spark, f"{path}/*.pb", ONE, frame)
        assert sorted(r["message"]["v"] for r in got.collect()) == list(range(50))
    stream = read_stream_delimited(spark, f"{tmp_path}/varint/*.pb", ONE)
    q = stream.select("message.v").writeStream.format("memory").queryName("framed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select count(*) from framed").first()[0] == 50


def test_getters(spark):
    e = EnumSchema("Colour", [("RED", 2), ("BLUE", 0)])
    m = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(9))
    more = E.enum_map_put(E.enum_map_put(m, F.lit("a"), F.lit(2)), F.lit("c"), F.lit(0))
    none = F.lit(None)
    row = spark.range(1).select(
        E.enum_map_get(m, F.lit("a"), e).alias("known"), E.enum_map_get(m, F.lit("b"), e).alias("unknown"), E.enum_map_get(m, F.lit("z"), e).alias("absent"), more.alias("more"),
        E.field_get(none.cast("int"), Field("n", 1, "int32", "optional", default=7)).alias("n"), E.field_get(F.lit(3), Field("n", 1, "int32", "optional", default=7)).alias("set"),
        E.field_get(F.lit(9), Field("c", 2, "enum", "optional", of=e)).alias("colour"), E.field_get(none.cast("binary"), Field("b", 3, "bytes", "optional", default=b"x")).alias("raw"),
    ).first()
    assert (row["known"], row["unknown"], row["absent"], row["more"]) == (0, None, None, {"a": 2, "b": 9, "c": 0})
    assert (row["n"], row["set"], row["colour"], bytes(row["raw"])) == (7, 3, 2, b"x")


def test_messages_of_type_and_api(spark):
    text = 'syntax = "proto3"; import "google/protobuf/api.proto"; import "google/protobuf/type.proto"; message Bar { google.protobuf.Api api = 1; google.protobuf.Type type = 2; google.protobuf.Enum e = 3; }'
    bar = compile_protos({"bar.proto": text}).messages["Bar"]
    method, mixin = b"\x0a\x01m\x18\x01\x38\x01", b"\x0a\x01x\x12\x01r"
    api = b"\x0a\x01A\x12" + bytes([len(method)]) + method + b"\x22\x021v\x32" + bytes([len(mixin)]) + mixin + b"\x38\x01"
    field = b"\x08\x09\x10\x03\x18\x05\x22\x01f\x52\x01j"
    kind = b"\x0a\x01T\x12" + bytes([len(field)]) + field + b"\x1a\x01o\x30\x01"
    value = b"\x0a\x01E\x12\x05\x0a\x01v\x10\x07"
    raw = b"".join(bytes([t]) + bytes([len(x)]) + x for t, x in ((0x0A, api), (0x12, kind), (0x1A, value)))
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    got = pb_decode(df, "b", bar, out="x")
    assert bytes(got.select(E.pb_encode(F.col("x"), bar)).first()[0]) == raw
