"""Column expressions on text: emptiness, UTF-8 sizes and cuts, size literals, axis labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decimal size units.
SIZE_UNITS = {"B": 1, "KB": 1_000, "MB": 1_000_000, "GB": 1_000_000_000}
SIZE_PATTERN = r"([1-9][0-9]*)\s*(B|KB|MB|GB)"
# White space of Python beyond the Unicode property.
_SEPARATORS = r"[\s\x1c-\x1f]"

# A byte cut can drop at most this many bytes of an incomplete last character.
MAX_BOUNDARY_LOSS = 3


def is_nonempty(text: Column) -> Column:
    """True for texts that count as documents: neither null nor the empty string."""
    return text.isNotNull() & (text != "")


def utf8_bytes(text: Column) -> Column:
    """Size in UTF-8 bytes as BIGINT."""
    return F.octet_length(text).cast("bigint")


def utf8_prefix(text: Column, n_bytes: Column | int) -> Column:
    """Longest prefix of whole characters that fits in ``n_bytes`` bytes."""
    n = F.lit(n_bytes) if isinstance(n_bytes, int) else n_bytes
    n = F.least(n, F.octet_length(text)).cast("int")
    raw = F.encode(text, "UTF-8")
    cuts = [
        F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(n - back, F.lit(0))).cast("string"))
        for back in range(MAX_BOUNDARY_LOSS + 1)
    ]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*cuts))


def parse_size(value: str) -> int:
    """``"10GB"`` -> 10_000_000_000; raises ``ValueError`` for anything but digits and a unit."""
    spelled = value.upper()
    # Every unit ends in that of bytes, so the longest that fits is the one meant.
    unit = max((u for u in SIZE_UNITS if spelled.endswith(u)), key=len, default="")
    digits = spelled.removesuffix(unit).rstrip() if unit else ""
    if not (digits.isascii() and digits.isdigit() and digits[0] != "0"):
        raise ValueError(f"not a byte size: {value!r} (examples: 1MB, 10MB, 10GB)")
    return int(digits) * SIZE_UNITS[unit]


def size_bytes(value: Column) -> Column:
    """Column form of :func:`parse_size`; null where the literal is not a size."""
    upper = F.upper(value)
    whole = rf"(?U)\A{SIZE_PATTERN}\z".replace(r"\s", _SEPARATORS)
    number = F.regexp_extract(upper, whole, 1).try_cast("bigint")
    unit = F.regexp_extract(upper, whole, 2)
    factor = F.lit(None).cast("bigint")
    for name, size in SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(size).cast("bigint")).otherwise(factor)
    return F.try_multiply(number, factor)


def vocab_axis_label(size: Column) -> Column:
    """Tick label of a vocabulary size: ``0``, ``1M`` for one million, else thousands as ``16k``."""
    return (
        F.when(size == 0, F.lit("0"))
        .when(size == 1_000_000, F.lit("1M"))
        .otherwise(F.concat(F.floor(size / 1_000).cast("string"), F.lit("k")))
    )
