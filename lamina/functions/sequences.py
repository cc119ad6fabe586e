"""Structure of base sequences, given as strings over A, C, G, T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions import scalars

BASES = "ACGT"
LAGS = (1, 2, 3, 4, 6, 8, 12)  # fixed value


def occurrences(sequence: Column, piece: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, piece, ""))


def frequencies(sequence: Column) -> list[Column]:
    """Share of each base in BASES order."""
    return [scalars.rate_or_zero(occurrences(sequence, b), F.length(sequence)) for b in BASES]


def gc_fraction(sequence: Column) -> Column:
    return scalars.rate_or_zero(F.length(sequence) - F.length(F.translate(sequence, "GC", "")), F.length(sequence))


def is_legal(sequence: Column) -> Column:
    return sequence.rlike(f"^[{BASES}]+$")


def _runs(sequence: Column) -> Column:
    return F.regexp_extract_all(sequence, F.lit("(A+|C+|G+|T+)"), F.lit(1))


def longest_run(sequence: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_runs(sequence), lambda r: F.length(r))), F.lit(0))


def long_run_fraction(sequence: Column, least: int = 3) -> Column:
    """Share of bases in runs of ``least`` or more."""
    in_long = F.aggregate(_runs(sequence), F.lit(0), lambda acc, r: acc + F.when(F.length(r) >= least, F.length(r)).otherwise(0))
    return scalars.rate_or_zero(in_long, F.length(sequence))


def pair_frequencies(sequence: Column) -> list[Column]:
    """Share of each ordered pair of neighbours, AA, AC ... TT. Matches overlap, so they are looked for behind a look-ahead."""
    pairs = F.greatest(F.length(sequence) - 1, F.lit(1))
    return [F.regexp_count(sequence, F.lit(f"{a}(?={b})")) / pairs for a in BASES for b in BASES]


def lag_match(sequence: Column, lag: int) -> Column:
    """Share of positions that equal the one ``lag`` before."""
    letters = F.split(sequence, "")
    n = F.length(sequence) - lag
    same = F.size(F.filter(F.zip_with(F.slice(letters, F.lit(1), F.greatest(n, F.lit(0))), F.slice(letters, F.lit(lag + 1), F.greatest(n, F.lit(0))), lambda a, b: a == b), lambda x: x))
    return F.when(n > 0, same / n).otherwise(0.0)


def read_features(sequence: Column, padded_length: int) -> dict[str, Column]:
    """The 33 features of one read."""
    base, pair = frequencies(sequence), pair_frequencies(sequence)
    found = {"length": F.length(sequence) / padded_length}
    found |= {f"base_{b}": c for b, c in zip(BASES, base)}
    found |= {"gc": gc_fraction(sequence), "base_entropy": scalars.frequency_entropy(base)}
    found |= {f"pair_{a}{b}": c for (a, b), c in zip([(a, b) for a in BASES for b in BASES], pair)}
    found |= {"pair_entropy": scalars.frequency_entropy(pair), "longest_run": scalars.rate_or_zero(longest_run(sequence), F.length(sequence)), "long_run_fraction": long_run_fraction(sequence)}
    found |= {f"lag_{k}": lag_match(sequence, k) for k in LAGS}
    return found


def digits(sequence: Column, alphabet: str = BASES) -> Column:
    """Raw bytes 0-3, the form that sequence digests are taken over."""
    return F.unhex(F.array_join(F.transform(F.split(F.translate(sequence, alphabet, "0123"), ""), lambda c: F.concat(F.lit("0"), c)), ""))


def digest(sequence: Column, alphabet: str = BASES) -> Column:
    return F.sha2(digits(sequence, alphabet), 256)


def from_digits(numbers: Column, alphabet: str = BASES) -> Column:
    """Letters of an array of 0-3."""
    return F.translate(F.array_join(numbers.cast("array<string>"), ""), "0123", alphabet)


def stable_seed(*parts: Column, bits: int = 64) -> Column:
    """First ``bits`` bits, little-endian and unsigned, of the SHA-256 of the parts' texts joined by the unit separator."""
    hexadecimal = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary"), 256)
    swapped = F.concat(*[F.substring(hexadecimal, 2 * i + 1, 2) for i in reversed(range(bits // 8))])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def hamming_parities(bits: list[Column]) -> list[Column]:
    """Parities of four data bits of the extended (8,4) code: three over triples, then one over everything."""
    a, b, c, d = bits
    p = [a.bitwiseXOR(b).bitwiseXOR(d), a.bitwiseXOR(c).bitwiseXOR(d), b.bitwiseXOR(c).bitwiseXOR(d)]
    whole = a
    for x in (b, c, d, *p):
        whole = whole.bitwiseXOR(x)
    return [*p, whole]


def one_hot(sequence: Column, length: int) -> Column:
    """``length`` arrays of four, one place set for each base; places behind the sequence, or other letters, have none."""
    letters = F.slice(F.split(sequence, ""), 1, length)
    padded = F.concat(letters, F.array_repeat(F.lit(""), F.lit(length) - F.size(letters)))
    return F.transform(padded, lambda c: F.array(*[(c == b).cast("int") for b in BASES]))


def masked(sequence: Column, length: int) -> Column:
    """Base numbers 1 to 4, 0 behind the sequence; and the mask of what is inside. A longer sequence is cut."""
    letters = F.filter(F.slice(F.split(sequence, ""), 1, length), lambda c: c != "")
    rest = F.array_repeat(F.lit(0), F.lit(length) - F.size(letters))
    numbers = F.transform(letters, lambda c: F.array_position(F.array(*map(F.lit, BASES)), c).cast("int"))
    return F.struct(F.concat(numbers, rest).alias("bases"), F.concat(F.transform(letters, lambda c: F.lit(1)), rest).alias("mask"))
