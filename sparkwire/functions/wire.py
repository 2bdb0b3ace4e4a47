"""Wire primitives as native columns. Bytes are built as hexadecimal text, two digits a byte, and turned into BINARY once at the end."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_hex(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def _bits(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("bigint"))


def _nibbles(x: Column) -> Column:
    """The two halves of each byte swapped: the text of a number's digits, reversed, then holds its bytes lowest first."""
    return F.shiftleft(_bits(x, 0x0F0F0F0F0F0F0F0F), 4).bitwiseOR(_bits(F.shiftrightunsigned(x, 4), 0x0F0F0F0F0F0F0F0F))


def varint_hex(x: Column) -> Column:
    """LEB128 of a bigint read as unsigned: 1 to 10 bytes. Up to 28 bits the groups are put in place, lowest first, and their number's digits
    are the text, as inside lambdas each node is interpreted. Beyond, eight seven-bit groups are spread over one number, whose
    digits are the text of all bytes but the last. Few nodes: messages have many fields, and plans are compiled."""
    x = x.cast("bigint")

    def placed(groups: int, last: int) -> Column:
        """So many groups, lowest in the highest byte; the one at `last` holds all bits above."""
        out = None
        for i in range(groups):
            by = 8 * (groups - 1 - i) - 7 * i
            moved = F.shiftleft(x, by) if by > 0 else F.shiftrightunsigned(x, -by)
            group = moved if i == last else _bits(moved, 127 << 8 * (groups - 1 - i))
            out = group if out is None else out.bitwiseOR(group)
        return out

    digits = F.hex(placed(8, 8).bitwiseOR(F.lit(-0x7F7F7F7F7F7F7F80)))

    def text(n: Column) -> Column:
        last = F.call_function("shiftrightunsigned", x, n * 7 - 7)
        ninth = F.when(n == 10, byte_hex(F.shiftrightunsigned(x, 56).bitwiseOR(F.lit(128).cast("bigint")))).otherwise("")
        return F.concat(F.substr(digits, F.lit(1), n * 2 - 2), ninth, byte_hex(last))

    out = F.when((x >= 0) & (x < 128), byte_hex(x))
    for n in (2, 3, 4):
        out = out.when((x >= 0) & (x < 1 << 7 * n), F.hex(placed(n, n - 1).bitwiseOR(F.lit(sum(128 << 8 * k for k in range(1, n))).cast("bigint"))))
    return out.otherwise(let(F.floor((F.octet_length(F.bin(x)) + 6) / 7).cast("int"), text))


def varint_len(x: Column) -> Column:
    x = x.cast("bigint")
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when(F.shiftrightunsigned(x, 7 * n) == 0, n).otherwise(out)
    return out


def varint_value(raw: Column) -> Column:
    """The bigint (two's complement of the unsigned value) of a varint at the front of a BINARY; null where it is not a valid varint."""

    def number(first: int, digits: int) -> Column:
        """Bytes from a place on as a little-endian bigint; null where there are none."""
        text = F.substring(F.hex(raw), 2 * first + 1, 2 * digits)
        return _nibbles(F.when(text != "", F.conv(F.reverse(F.rpad(text, 2 * digits, "0")), 16, -10).cast("bigint")))

    def value(w: Column) -> Column:
        stop = _bits(F.shiftrightunsigned(F.bitwise_not(w), 7), 0x0101010101010101)  # a bit for each byte below 128
        return let(_bits(F.bitwise_not(stop), -1).bitwiseAND(stop - 1), lambda below: ended(w, below))

    def ended(w: Column, below: Column) -> Column:
        x = _bits(w.bitwiseAND(F.shiftleft(below, 8).bitwiseOR(F.lit(255).cast("bigint"))), 0x7F7F7F7F7F7F7F7F)
        for keep, by, put in ((0x007F007F007F007F, 1, 0x3F803F803F803F80), (0x00003FFF00003FFF, 2, 0x0FFFC0000FFFC000), (0x0FFFFFFF, 4, 0x00FFFFFFF0000000)):
            x = _bits(x, keep).bitwiseOR(_bits(F.shiftrightunsigned(x, by), put))
        size, ninth, tenth = F.octet_length(raw), number(8, 1), number(9, 1)
        whole = F.when(ninth < 128, x.bitwiseOR(F.shiftleft(ninth, 56))).when(tenth < 2, x.bitwiseOR(F.shiftleft(ninth.bitwiseAND(F.lit(127)), 56)).bitwiseOR(F.shiftleft(tenth, 63)))
        return F.when(below == -1, whole).when(F.bit_count(below) / 8 < size, x)

    return let(number(0, 8), value)


def let(x: Column, use) -> Column:
    """use(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def key_hex(tag: int, wire: int) -> str:
    """A field's key: constant bytes, made on the driver."""
    return host_varint(tag << 3 | wire).hex().upper()


def host_varint(x: int) -> bytes:
    out = bytearray()
    x &= (1 << 64) - 1
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def key_len(tag: int) -> int:
    return len(host_varint(tag << 3))


def key_parts(key: Column) -> tuple[Column, Column]:
    """(tag, wire type) of a key's value."""
    return F.shiftrightunsigned(key, 3), key.bitwiseAND(F.lit(7))


def zigzag(x: Column) -> Column:
    x = x.cast("bigint")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1).cast("bigint"))))


def unsigned(x: Column) -> Column:
    """DECIMAL(20,0) of a bigint read as unsigned."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, (d + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(d)


def wrapped(x: Column) -> Column:
    """The bigint of the same 64 bits as an unsigned DECIMAL(20,0)."""
    d = x.cast("decimal(20,0)")
    high = d >= F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(high, (d - F.lit("18446744073709551616").cast("decimal(20,0)")).cast("bigint")).otherwise(F.when(~high, d).cast("bigint"))


def truncate32(x: Column) -> Column:
    """The low 32 bits of a bigint as INT."""
    return F.shiftright(F.shiftleft(x.cast("bigint"), 32), 32).cast("int")


def _static(name: str, method: str, x: Column, of: str, gives: str) -> Column | None:
    """A static method of java.lang as a column, in generated code; None where expressions can't be made from here (Spark Connect)."""
    try:
        jvm = SparkContext._active_spark_context._jvm
        made = jvm.org.apache.spark.sql.classic.ExpressionUtils
        types = [getattr(getattr(jvm.org.apache.spark.sql.types, f"{t}Type$"), "MODULE$") for t in (of, gives)]
        call = jvm.org.apache.spark.sql.catalyst.expressions.objects.StaticInvoke
        args, kinds = jvm.PythonUtils.toSeq([made.expression(x._jc)]), jvm.PythonUtils.toSeq(types[:1])
        return Column(made.column(call(jvm.java.lang.Class.forName(f"java.lang.{name}"), types[1], method, args, kinds, True, True, True, jvm.scala.Option.empty())))
    except (AttributeError, TypeError, Py4JError):
        return None


def _little(x: Column, n: int) -> Column:
    """The low n bytes (4 or 8) of a bigint, lowest first."""
    turned = _static("Long", "reverseBytes", x, "Long", "Long")
    if turned is not None:
        text = F.lpad(F.hex(turned), 16, "0")
        return text if n == 8 else F.substring(text, 1, 8)
    text = F.lpad(F.hex(x if n == 8 else x.bitwiseAND(F.lit(0xFFFFFFFF))), 2 * n, "0")
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])


def fixed32_hex(x: Column) -> Column:
    return _little(x.cast("bigint"), 4)


def fixed64_hex(x: Column) -> Column:
    return _little(x.cast("bigint"), 8)


def float_bits(x: Column) -> Column:
    bits = _static("Float", "floatToRawIntBits", x, "Float", "Integer")
    return (F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x) if bits is None else bits).cast("bigint")


def double_bits(x: Column) -> Column:
    bits = _static("Double", "doubleToRawLongBits", x, "Double", "Long")
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("bigint") if bits is None else bits


def scalar_hex(kind: str, x: Column) -> Column:
    """Payload of a scalar, without key; strings and bytes with their length."""
    if kind == "bool":
        return F.when(x, "01").otherwise("00")
    if kind in ("uint32", "fixed32"):
        x = F.when((x >= 0) & (x <= 0xFFFFFFFF), x).when(x.isNotNull(), F.raise_error(F.concat(F.lit(f"{kind} out of range: "), x.cast("string"))).cast("bigint"))
    if kind in ("int32", "int64", "enum", "uint32"):
        return varint_hex(x)
    if kind == "uint64":
        return let(wrapped(x), varint_hex)
    if kind in ("sint32", "sint64"):
        return let(zigzag(x), varint_hex)
    if kind in ("fixed32", "sfixed32"):
        return fixed32_hex(x)
    if kind == "float":
        return fixed32_hex(float_bits(x))
    if kind == "sfixed64":
        return fixed64_hex(x)
    if kind == "fixed64":
        return fixed64_hex(wrapped(x))
    if kind == "double":
        return fixed64_hex(double_bits(x))
    return F.concat(varint_hex(F.octet_length(x)), F.hex(x))


def scalar_len(kind: str, x: Column) -> Column:
    """Bytes of a scalar's payload, without key."""
    if kind == "bool":
        return F.lit(1)
    if kind in ("fixed32", "sfixed32", "float"):
        return F.lit(4)
    if kind in ("fixed64", "sfixed64", "double"):
        return F.lit(8)
    if kind in ("string", "bytes"):
        return varint_len(F.octet_length(x)) + F.octet_length(x)
    if kind == "uint64" or kind in ("sint32", "sint64"):
        return let(wrapped(x) if kind == "uint64" else zigzag(x), varint_len)
    return varint_len(x)
