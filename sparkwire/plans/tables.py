"""Message schemas of the test tables."""

from __future__ import annotations

from ..functions.wkt import TIMESTAMP
from ..schema import EnumSchema, Field, MessageSchema, Registry

TABLES = Registry()
STATUS = EnumSchema("OrderStatus", [("UNKNOWN", 0), ("F", 1), ("O", 2), ("P", 3)])
TABLES.enums["tables.OrderStatus"] = STATUS
TABLES.add(TIMESTAMP.__class__("Timestamp", list(TIMESTAMP.fields), TIMESTAMP.package, TIMESTAMP.url_domain))


def _m(name: str, *fields: Field) -> MessageSchema:
    return TABLES.add(MessageSchema(name, list(fields), "tables", "example.test"))


def _fields(text: str) -> list[Field]:
    out = []
    for n, part in enumerate(text.split(","), 1):
        name, kind = part.split()
        out.append(Field(name, n, kind))
    return out


REGION = _m("Region", *_fields("r_regionkey int32, r_name string"))
NATION = _m("Nation", *_fields("n_nationkey int32, n_name string, n_regionkey int32"))
CUSTOMER = _m("Customer", *_fields("c_custkey int64, c_name string, c_nationkey int32, c_acctbal double, c_mktsegment string"))
LINEITEM = _m("LineItem", *_fields("l_partkey int64, l_suppkey int64, l_linenumber int32, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"))
ORDER = _m(
    "Order", Field("o_orderkey", 1, "int64"), Field("o_custkey", 2, "int64"), Field("o_orderstatus", 3, "enum", of=STATUS), Field("o_totalprice", 4, "double"),
    Field("o_orderpriority", 6, "string"), Field("items", 7, "message", "repeated", of=LINEITEM),
)
EVENT = _m(
    "Event", Field("event_id", 1, "int64"), Field("ts", 2, "message", of="google.protobuf.Timestamp"), Field("user_id", 3, "int64"),
    Field("value", 4, "double", oneof="what"), Field("event_type", 5, "string", oneof="what"),
    Field("props", 6, "map", key=Field("key", 1, "string"), value=Field("value", 2, "int64")),
)
DOCUMENT = _m("Document", *_fields("doc_id int64, text string, lang string, source string, n_chars int64"))
EMBEDDING = _m("Embedding", Field("vec_id", 1, "int64"), Field("embedding", 2, "float", "repeated"), Field("label", 3, "int32"))
EMBEDDING_UNPACKED = _m("EmbeddingUnpacked", Field("vec_id", 1, "int64"), Field("embedding", 2, "float", "repeated", packed=False), Field("label", 3, "int32"))
TURN = _m("Turn", *_fields("turn int64, role string, text string"))
CONVERSATION = _m("Conversation", Field("conv_id", 1, "int64"), Field("turns", 2, "message", "repeated", of=TURN))
GROUPED = _m("Grouped", Field("key", 1, "int64"), Field("item", 2, "group", of=LINEITEM))
OPTIONAL = _m("Optional", Field("doc_id", 1, "int64"), Field("quality", 2, "int32", "optional"), Field("toxic", 3, "int32", "optional"))
WIDE = _m("Wide", *_fields("p_partkey int64, p_name string, p_brand string, p_type string, p_size int32, p_retailprice double"))
NARROW = _m("Narrow", Field("p_partkey", 1, "int64"), Field("p_size", 5, "int32"))
