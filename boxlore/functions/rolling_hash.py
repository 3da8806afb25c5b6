"""A hash of a sequence of lines that can be summed up in pieces, in any order.

Line i adds h(line) * BASE^i modulo a prime.  So a block of lines gives a partial sum with
places counted from its start, and the blocks' sums, each times BASE^(lines before the
block), add up to the hash of the file: it doesn't matter how the file was split, and
nothing but one row per block leaves a task.  Three primes give about 93 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: primes below 2^31, so that a product of two remainders fits 64 bits, and a base for each
MODULI = (2147483647, 2147483629, 2147483587)
BASES = (1_103_515_245, 1_664_525_017, 1_220_703_125)
DIGIT_BITS, DIGITS = 8, 5


def power(exponent: Column, k: int, back: bool = False) -> Column:
    """BASES[k] ** exponent (``back``: its inverse) modulo MODULI[k], from tables of the powers of its digits; exponents up to 2^40."""
    prime, out = MODULI[k], None
    base = pow(BASES[k], -1, prime) if back else BASES[k]
    for digit in range(DIGITS):
        step = pow(base, 1 << (DIGIT_BITS * digit), prime)
        powers = [1]
        for _ in range((1 << DIGIT_BITS) - 1):
            powers.append(powers[-1] * step % prime)
        place = F.shiftright(exponent, DIGIT_BITS * digit).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        factor = F.get(F.expr(f"array({', '.join(f'{x}L' for x in powers)})"), place.cast("int"))
        out = factor if out is None else out * factor % F.lit(prime)
    return out


def terms(line: Column, place: Column) -> list[Column]:
    """What a line at ``place`` adds to each of the sums."""
    value = F.xxhash64(line)
    return [F.pmod(value, F.lit(prime)) * power(place, k) % F.lit(prime) for k, prime in enumerate(MODULI)]


def moved(total: Column, back: Column, on: Column, k: int) -> Column:
    """A sum whose lines stand ``back`` places too far, as it counts ``on`` places further on than the first."""
    prime = F.lit(MODULI[k])
    return F.pmod(total, prime) * power(back, k, back=True) % prime * power(on, k) % prime


def digest(lines: Column, sums: list[Column]) -> Column:
    """Hash of a whole file from its number of lines and its sums."""
    parts = [F.pmod(total, F.lit(prime)).cast("string") for total, prime in zip(sums, MODULI)]
    return F.md5(F.concat_ws("-", lines.cast("string"), *parts))
