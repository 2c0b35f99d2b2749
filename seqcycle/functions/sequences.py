"""Scalar functions of symbol sequences, as column expressions."""

from __future__ import annotations

import random
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the composition tables and of k-mer tokens.
BASES = ("A", "T", "G", "C")
#: Order of the latent-state model.
STATE_BASES = ("A", "C", "G", "T")


def cleaned(seq: Column) -> Column:
    return F.upper(F.trim(seq))


def is_unambiguous(seq: Column) -> Column:
    """Whether a sequence is not empty and has no symbol but A, C, G and T."""
    return F.coalesce(seq.rlike("^[ACGT]+$"), F.lit(False))


def reverse_complement(seq: Column) -> Column:
    """Complements A, C, G and T of either case; N and other symbols stay."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def reverse_complement_upper(seq: Column) -> Column:
    """Complements upper-case A, C, G and T only."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def trimmed(seq: Column, five: Column | int, three: Column | int) -> Column:
    """The sequence without ``five`` and ``three`` symbols at its ends; empty if nothing is left."""
    five, three = (x if isinstance(x, Column) else F.lit(x) for x in (five, three))
    left = F.length(seq) - five - three
    return F.when(left > 0, F.substr(seq, five + 1, left)).otherwise(F.lit(""))


def phase_trimmed(text: Column, five: Column | int) -> Column:
    """The two-symbol trim: ``five`` (0 to 2) symbols from the start and ``2 - five`` from the end."""
    five = five if isinstance(five, Column) else F.lit(five)
    checked = F.when(F.length(text) > 2, F.length(text) - 2).otherwise(F.raise_error(F.lit("a two-symbol trim needs more than two symbols")).cast("int"))
    return F.substr(text, five + 1, checked)


def uniform(*parts: Column) -> Column:
    """48 bits of an MD5 over the joined parts, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def hashed_offset(key: Column, seed: int, n: int = 3) -> Column:
    """An offset in 0 to n-1 that depends on seed and key alone."""
    return F.floor(uniform(F.lit(str(seed)), key) * n).cast("int")


def replayed_offsets(n: int, seed: int) -> list[int]:
    """The offsets 0 to 2 that one sequential generator deals to the first ``n`` eligible reads."""
    draw = random.Random(seed)
    return [draw.randrange(3) for _ in range(n)]


def dedup_key(seq: Column, mode: str) -> Column:
    """What rows must share to count as copies: the sequence, or the smaller of it and its reverse complement, as text or as 64-bit hash."""
    if mode == "sequence":
        return seq
    if mode == "seq_rc":
        return F.least(seq, reverse_complement(seq))
    if mode == "hash64":
        return F.xxhash64(seq)
    if mode == "hash64_rc":
        return F.xxhash64(F.least(seq, reverse_complement(seq)))
    raise ValueError(f"unknown deduplication mode: {mode}")


def kmer_tokens(k: int) -> list[str]:
    """All k-mers in the order of the tables."""
    if k not in (1, 2, 3):
        raise ValueError("k must be 1, 2 or 3")
    return ["".join(t) for t in product(BASES, repeat=k)]


def mod3_counts(seq: Column) -> Column:
    """Array of 12: how often A, C, G, T stand at 0-based positions of remainder 0, 1 and 2; other symbols do not count."""
    letters = F.split(seq, "")
    strands = [F.array_join(F.filter(letters, _at(r)), "") for r in range(3)]
    return F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))).cast("long") for s in strands for b in STATE_BASES])


def _at(remainder: int):
    return lambda x, i: i % 3 == remainder


def is_simple_cigar(cigar: Column) -> Column:
    """Whether an alignment has matches and mismatches only."""
    return F.coalesce(cigar.rlike("^([0-9]+[M=X])+$"), F.lit(False))


def codon_corrected(seq: Column, phase: Column) -> tuple[Column, Column, Column]:
    """(sequence of whole codons, 5' trim, 3' trim) of a sequence whose first symbol has the given codon phase."""
    five = F.pmod(-phase, F.lit(3))
    rest = F.greatest(F.length(seq) - five, F.lit(0))
    three = F.when(rest > 0, rest % 3).otherwise(F.lit(0))
    return F.when(rest > 0, F.substr(seq, five + 1, rest - three)).otherwise(F.lit("")), five, three


def pyrimidine_acceptance(bias: Column | float) -> Column:
    """The probability (1-b)/b with which a break after C or T is kept; b lies in [0.5, 1]."""
    bias = bias if isinstance(bias, Column) else F.lit(float(bias))
    return F.when(bias.between(0.5, 1.0), (1 - bias) / bias).otherwise(F.raise_error(F.lit("a bias lies between 0.5 and 1")).cast("double"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\w-]", "_")
