"""Functions by name in SQL text, for one session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import MessageSchema, to_snake

_GROUPS = " | ".join(f"shiftleft(shiftrightunsigned(x, {7 * i}) & 127L, {56 - 8 * i})" for i in range(8))
#: Name, arguments, result and body of the native ones.
NATIVE = [
    ("pb_zigzag", "x BIGINT", "BIGINT", "shiftleft(x, 1) ^ shiftright(x, 63)"),
    ("pb_unzigzag", "x BIGINT", "BIGINT", "shiftrightunsigned(x, 1) ^ (-(x & 1L))"),
    ("pb_varint_len", "x BIGINT", "INT", "CAST((length(bin(x)) + 6) DIV 7 AS INT)"),
    (
        "pb_varint", "x BIGINT", "BINARY",
        f"unhex(concat(substr(hex(({_GROUPS}) | -9187201950435737472L), 1, 2 * ((length(bin(x)) + 6) DIV 7) - 2), "
        "CASE WHEN x < 0 THEN lpad(hex(shiftrightunsigned(x, 56) | 128L), 2, '0') ELSE '' END, "
        "lpad(hex(shiftrightunsigned(x, CAST(7 * ((length(bin(x)) + 6) DIV 7) - 7 AS INT))), 2, '0')))",
    ),
]


def register_functions(spark: SparkSession, *messages: MessageSchema) -> list[str]:
    """Makes temporary functions pb_zigzag, pb_unzigzag, pb_varint_len and pb_varint, and pb_decode_<message> (BINARY to STRUCT, null for
    bytes that are no such message) for each schema; gives their names."""
    names = []
    for name, args, gives, body in NATIVE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {gives} RETURN {body}")
        names.append(name)
    for m in messages:
        names.append(f"pb_decode_{to_snake(m.name)}")
        spark.udf.register(names[-1], _decoder(m))
    return names


def _decoder(m: MessageSchema, depth: int = 3):
    from ..operators.decode import Decoder, _nullable

    kind = _nullable(m.struct(depth))

    @F.arrow_udf(kind)
    def decode(raws: pa.Array) -> pa.Array:
        return Decoder(m, depth).decode(raws, to_arrow_type(kind))[0]

    return decode
