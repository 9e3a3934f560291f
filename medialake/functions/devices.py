"""Device tag: a short base-36 code mixed from the eight digits of a device number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake import catalogs as C


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _mul_mod(a: Column, factor: int, low_bits: int, keep: int) -> Column:
    """``a * factor`` modulo ``2**keep`` without leaving the long range: one operand is cut in two
    at ``low_bits`` so that each partial product fits, and the high part is trimmed before it is
    shifted back."""
    if low_bits == 16:  # cut the factor; a has at most 32 bits
        lo, hi = factor & 0xFFFF, factor >> 16
        low = a * F.lit(lo)
        high = (a * F.lit(hi)).bitwiseAND(F.lit((1 << (keep - 16)) - 1))
        shift = 16
    else:  # cut a; the factor has at most 32 bits
        low = a.bitwiseAND(F.lit((1 << low_bits) - 1)) * F.lit(factor)
        high = (F.shiftright(a, low_bits) * F.lit(factor)).bitwiseAND(
            F.lit((1 << (keep - low_bits)) - 1)
        )
        shift = low_bits
    return (low + F.shiftleft(high, shift)).bitwiseAND(F.lit((1 << keep) - 1))


def device_hash(number: Column, mask: int = C.TAG_MASK) -> Column:
    """Masked 31-bit hash of an eight-digit device number, null for any other text.

    The mixing works on 64-bit integers that wrap. Only the low 32 bits of the last step are kept,
    which depend on the low 48 bits of the second product and on the low 61 bits of the first, so
    both products are computed exactly modulo a smaller power of two instead of in wider numbers.
    """
    if not 0 <= mask <= 0xFFFFFFFF:
        raise ValueError("the mask must fit in 32 bits")

    def mix(h: Column, ch: Column) -> Column:
        h = h * F.lit(31) + F.ascii(ch).cast("long")
        h = _xor(h, F.shiftleft(h, 13))
        h = _xor(h, F.shiftright(h, 17))
        h = h + F.shiftleft(h, 5)
        h = _xor(h, F.shiftright(h, 3))
        return h.bitwiseAND(F.lit(0xFFFFFFFF))

    h = F.aggregate(F.split(number, ""), F.lit(0).cast("long"), mix)
    return F.when(number.rlike("^[0-9]{8}$"), _finish(h, mask))


def _finish(h: Column, mask: int) -> Column:
    first, second = C.TAG_MULTIPLIERS
    # Each stage is bound to a lambda variable, so it is evaluated once although used twice.
    def bind(c: Column, f) -> Column:
        return F.get(F.transform(F.array(c), f), F.lit(0))

    h = bind(h, lambda x: _xor(x, F.shiftright(x, 15)))
    h = bind(h, lambda x: _mul_mod(x, first, 16, 62))
    h = bind(h, lambda x: _xor(x, F.shiftright(x, 13)).bitwiseAND(F.lit((1 << 48) - 1)))
    h = bind(h, lambda x: _mul_mod(x, second, 24, 48))
    h = bind(h, lambda x: _xor(x, F.shiftright(x, 16)))
    return h.bitwiseAND(F.lit(mask)).bitwiseAND(F.lit(0x7FFFFFFF))


def device_tag(number: Column, mask: int = C.TAG_MASK) -> Column:
    """Base-36 text of the hash, digits written with the fixed alphabet."""
    digits = F.conv(device_hash(number, mask).cast("string"), 10, 36)
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", C.TAG_ALPHABET)
