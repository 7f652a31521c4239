"""Addresses, log lines and the routing hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, and the constants of FNV-1a with 64 bits.
IP = r"^(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) ([^"]*) HTTP/(\d\.\d)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)"(?: \S+)?)?$'
COMBINED_FIELDS = ("ip", "time", "method", "path", "http", "status", "size", "ref", "agent")
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: IP after bytes that weren't UTF-8; a column keeps them as they are, so only a pattern sees them.
_LINE_IP = "^�*" + IP.removeprefix("^")

_MASK = 0xFFFFFFFF


def parse_ip(line: Column) -> Column:
    """The dotted address at the start of a line, '' if there is none.

    Octets aren't range-checked and nothing has to follow them, so 999.1.2.3 is
    an address and 1.2.3.4567 gives 1.2.3.456.  Digits are ASCII.  Bytes that
    weren't UTF-8, which a regular expression reads as U+FFFD, are skipped at the start.
    """
    return F.coalesce(F.regexp_extract(line, _LINE_IP, 1), F.lit(""))


def is_address(ip: Column) -> Column:
    """Whether a text is a whole address: four numbers from 0 to 255 without leading zeros."""
    return F.coalesce(ip.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"), F.lit(False))


def sample_ip(line: Column) -> Column:
    """The sampler's stricter reading: '' unless the line holds a quote or " - - ["."""
    return F.when(line.contains(" - - [") | line.contains('"'), parse_ip(line)).otherwise(F.lit(""))


def is_combined(line: Column) -> Column:
    """Whether a trimmed line has the Combined Log Format."""
    return F.coalesce(F.trim(line).rlike(COMBINED), F.lit(False))


def combined_fields(line: Column) -> Column:
    """The nine fields of a Combined Log Format line; null if it has another format."""
    trimmed = F.trim(line)
    parts = [F.regexp_extract(trimmed, COMBINED, i + 1).alias(n) for i, n in enumerate(COMBINED_FIELDS)]
    return F.when(is_combined(line), F.struct(*parts))


def ip_to_int(ip: Column) -> Column:
    """a<<24 | b<<16 | c<<8 | d; 0 if one of the first four parts is missing or no number.

    The parts are combined by OR, so an octet over 255 runs into the next one;
    parts after the fourth don't count.
    """
    parts = F.split(ip, r"\.")
    n = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    return F.coalesce(F.shiftleft(n[0], 24).bitwiseOR(F.shiftleft(n[1], 16)).bitwiseOR(F.shiftleft(n[2], 8)).bitwiseOR(n[3]), F.lit(0).cast("bigint"))


def int_to_ip(n: Column) -> Column:
    """Dotted form of the low 32 bits."""
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _bytes(text: Column) -> Column:
    """UTF-8 byte values; the shorter way when the text is ASCII."""
    n = F.octet_length(text)
    plain = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"))
    raw = text.cast("binary")
    other = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n == F.length(text), plain).otherwise(other)


def fnv1a_64(text: Column, finish: Callable[[Column], Column] | None = None) -> Column:
    """FNV-1a 64 of the UTF-8 bytes as struct(hi, lo) of unsigned 32-bit halves in longs, or what finish makes of that.

    The prime is 2**40 + 435, so a step needs no product beyond 63 bits.
    """
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(FNV_OFFSET & _MASK).cast("bigint").alias("lo"))
    mask = F.lit(_MASK).cast("bigint")
    small = F.lit(FNV_PRIME & _MASK).cast("bigint")

    def step(s: Column, byte: Column) -> Column:
        x = s["lo"].bitwiseXOR(byte)
        low = x * small
        high = s["hi"] * small + F.shiftleft(x, 8) + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    return F.aggregate(_bytes(text), start, step, finish)


def fnv_mod(text: Column, n: int) -> Column:
    """FNV-1a 64 of a text, as an unsigned number, modulo n."""
    return fnv1a_64(text, lambda h: F.pmod(F.pmod(h["hi"], F.lit(n)) * F.lit((1 << 32) % n) + F.pmod(h["lo"], F.lit(n)), F.lit(n)).cast("int"))
