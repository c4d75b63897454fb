"""Byte-string columns: ranges, bit fields, glob patterns, time to live."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 512 * 1024 * 1024


def _bytes(value: Column) -> Column:
    return value.cast("binary")


def byte_length(value: Column) -> Column:
    return F.octet_length(value).cast("long")


def byte_range(value: Column, start: int, end: int) -> Column:
    """Bytes ``start..end``, both included; negatives count from the end; clamped."""
    size = F.octet_length(value)
    low = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    high = F.least(F.lit(end) if end >= 0 else F.greatest(size + end, F.lit(0)), size - 1)
    backwards = F.lit(start < 0 and end < 0 and start > end)
    none = backwards | (size == 0) | (low > high)
    return F.when(none, _bytes(F.lit(""))).otherwise(F.substring(_bytes(value), low + 1, high - low + 1))


def overwrite(value: Column, offset: int, part: Column) -> Column:
    """``part`` written at byte ``offset``; a gap is filled with zero bytes."""
    base, new = _bytes(F.coalesce(value, F.lit(""))), _bytes(part)
    size = F.octet_length(base)
    zeros = F.repeat(F.lit("00"), F.greatest(F.lit(offset) - size, F.lit(0)))
    head = F.concat(F.substring(base, 1, offset), F.unhex(zeros))
    tail_at = F.octet_length(new) + offset
    tail = F.substring(base, tail_at + 1, F.greatest(size - tail_at, F.lit(0)))
    return F.when(F.octet_length(new) == 0, base).otherwise(F.concat(head, new, tail))


def append(value: Column, part: Column) -> Column:
    return F.concat(F.coalesce(value, F.lit("")), part)


def bit_at(value: Column, offset: int) -> Column:
    """Bit at ``offset``, most significant bit of the first byte first; 0 beyond the end."""
    byte = F.conv(F.hex(F.substring(_bytes(value), offset // 8 + 1, 1)), 16, 10).try_cast("long")
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(1), F.lit(0)).cast("long")


def _wrapped(raw: Column, width: int, signed: bool) -> Column:
    """A raw unsigned value of ``width`` bits as decimal(38), read as signed if asked."""
    span = _number(2**width)
    inside = F.pmod(raw, span)
    if not signed:
        return inside
    return F.when(inside >= _number(2 ** (width - 1)), inside - span).otherwise(inside)


def _number(value: int) -> Column:
    """An exact number beyond 64 bits."""
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def field_get(value: Column, width: int, offset: int, signed: bool = False) -> Column:
    """Integer of ``width`` bits at bit ``offset``; bits beyond the end are zero.

    Widths go up to 64 signed and 63 unsigned.
    """
    if not 1 <= width <= (64 if signed else 63):
        raise ValueError("width out of range")
    first, last = offset // 8, (offset + width - 1) // 8
    raw = F.lit(0).cast("decimal(38,0)")
    for byte in range(first, last + 1):
        piece = F.conv(F.hex(F.substring(_bytes(value), byte + 1, 1)), 16, 10).try_cast("int")
        raw = (raw * 256 + F.coalesce(piece, F.lit(0))).cast("decimal(38,0)")
    spare = 8 * (last + 1) - offset - width
    shifted = F.floor(raw / F.lit(2**spare)).cast("decimal(38,0)") if spare else raw
    return _wrapped(shifted, width, signed).cast("long")


def field_add(field: Column, width: int, delta: Column | int, overflow: str = "wrap", signed: bool = True) -> Column:
    """A field value plus ``delta``; beyond the range it wraps, saturates, or fails to null."""
    low, high = (-(2 ** (width - 1)), 2 ** (width - 1) - 1) if signed else (0, 2**width - 1)
    delta = F.lit(delta) if isinstance(delta, int) else delta
    total = (field.cast("decimal(38,0)") + delta.cast("decimal(38,0)")).cast("decimal(38,0)")
    if overflow == "wrap":
        return _wrapped(total, width, signed).cast("long")
    if overflow == "sat":
        bounded = F.least(F.greatest(total, _number(low)), _number(high))
        return bounded.cast("long")
    if overflow == "fail":
        return F.when(total.between(_number(low), _number(high)), total).cast("long")
    raise ValueError(f"overflow must be wrap, sat or fail, not {overflow!r}")


def field_offset(index: int, width: int) -> int:
    """Bit offset of the ``index``-th field of a row of fields of equal width."""
    return index * width


def field_set(
    value: Column, width: int, offset: int, number: Column, overflow: str = "wrap", signed: bool = False
) -> Column:
    """The bytes with the ``width`` bits at ``offset`` replaced by ``number``.

    A number beyond the range wraps, saturates, or with ``fail`` leaves the bytes
    as they are.
    """
    if overflow != "wrap":
        fitting = field_add(F.lit(0).cast("long"), width, number, overflow, signed)
        made = field_set(value, width, offset, fitting)
        return F.when(fitting.isNull(), _bytes(F.coalesce(value, F.lit("")))).otherwise(made)
    first, last = offset // 8, (offset + width - 1) // 8
    count = last - first + 1
    spare = 8 * count - (offset - 8 * first) - width
    base = _bytes(F.coalesce(value, F.lit("")))
    padded = F.concat(base, F.unhex(F.repeat(F.lit("00"), F.greatest(last + 1 - F.octet_length(base), F.lit(0)))))
    window = F.hex(F.substring(padded, first + 1, count))
    bits = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.lit(2 * count)),
            lambda i: F.lpad(F.conv(F.substring(window, i, F.lit(1)), 16, 2), 4, "0"),
        ),
        "",
    )
    new = F.lpad(F.right(F.bin(number.cast("long")), F.lit(width)), width, "0")
    start = offset - 8 * first
    changed = F.concat(F.substring(bits, 1, start), new, F.right(bits, F.lit(spare)) if spare else F.lit(""))
    as_hex = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(2 * count - 1)),
            lambda i: F.conv(F.substring(changed, i * 4 + 1, F.lit(4)), 2, 16),
        ),
        "",
    )
    tail = F.substring(padded, last + 2, F.greatest(F.octet_length(padded) - last - 1, F.lit(0)))
    return F.concat(F.substring(padded, 1, first), F.unhex(as_hex), tail)


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob with ``* ? [set] [^set] \\``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            i += 1
            negated = pattern[i : i + 1] == "^"
            i += negated
            members = []
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i] == "\\" and i + 1 < len(pattern):
                    i += 1
                    low = pattern[i]
                elif pattern[i + 1 : i + 2] == "-" and i + 2 < len(pattern):
                    low, high = sorted((pattern[i], pattern[i + 2]))
                    members.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
                    i += 3
                    continue
                else:
                    low = pattern[i]
                members.append(f"\\x{{{ord(low):x}}}")
                i += 1
            if members:
                out.append(f"[{'^' if negated else ''}{''.join(members)}]")
            else:
                out.append("." if negated else "[^\\x{0}-\\x{10ffff}]")
        else:
            if char == "\\" and i + 1 < len(pattern):
                i += 1
                char = pattern[i]
            out.append(char if char.isalnum() else f"\\x{{{ord(char):x}}}")
        i += 1
    return f"(?s)^{''.join(out)}\\z"


def glob_match(value: Column, pattern: str) -> Column:
    return value.rlike(glob_to_regex(pattern))


def glob_prefix(pattern: Column) -> Column:
    """The literal start of a pattern, up to the first special character."""
    return F.regexp_extract(pattern, r"^([^*?\[\\]*)", 1)


def glob_column_regex(pattern: Column) -> Column:
    """``glob_to_regex`` for a column of patterns.

    The pattern is cut into its parts (escapes, sets, single characters) and
    each part is rewritten.
    """
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)\\.|\[\^?(?:\\.|[^\]\\])*+\]?|."), F.lit(0))

    def escaped(char: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(char, r"(?s)^\\(.)", "$1"), r"([^0-9A-Za-z])", r"\\$1")

    def member(piece: Column) -> Column:
        low, high = F.substring(piece, 1, 1), F.substring(piece, 3, 1)
        span = F.concat(escaped(F.least(low, high)), F.lit("-"), escaped(F.greatest(low, high)))
        return F.when(F.length(piece) == 3, span).otherwise(escaped(piece))

    def rewrite(piece: Column) -> Column:
        body = F.regexp_replace(piece, r"^\[\^?|\]$", "")
        inner = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)[^\\]-.|\\.|."), F.lit(0)), member), "")
        negated = piece.startswith("[^")
        some = F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), inner, F.lit("]"))
        none = F.when(negated, F.lit(".")).otherwise(F.lit(r"[^\x{0}-\x{10ffff}]"))
        return (
            F.when(piece == "*", F.lit(".*"))
            .when(piece == "?", F.lit("."))
            .when(piece.startswith("["), F.when(inner == "", none).otherwise(some))
            .otherwise(escaped(piece))
        )

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(parts, rewrite), ""), F.lit(r"\z"))


def expired(expire_at: Column, now: Column) -> Column:
    return F.coalesce(now > expire_at, F.lit(False))


def ttl(exists: Column, expire_at: Column, now: Column, unit: str = "s") -> Column:
    """-2 if the key is absent, -1 if it never expires, else the time left.

    Seconds are rounded half up from milliseconds; the time left is never below zero.
    """
    left = F.greatest(F.unix_millis(expire_at) - F.unix_millis(now), F.lit(0))
    value = left if unit == "ms" else F.floor((left + 500) / 1000)
    gone = ~F.coalesce(exists, F.lit(False)) | expired(expire_at, now)
    return F.when(gone, F.lit(-2)).when(expire_at.isNull(), F.lit(-1)).otherwise(value).cast("long")
