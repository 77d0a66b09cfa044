"""Nucleotide sequences as string columns: codes, strands, windows, masks.

Only upper-case A, C, G and T are valid bases; anything else makes the windows
that hold it invalid. Codes are A=0, C=1, G=2, T=3, two bits each, the first
base highest, so k-mers of one length sort alike as text and as numbers.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
MAX_K = 31  # 62 bits: codes stay non-negative

#: How any text stands for a sequence: letters cycle through the bases, digits are unknown bases.
LETTERS = string.ascii_lowercase + string.ascii_uppercase + string.digits
AS_BASES = "".join(BASES[i % 4] for i in range(26)) * 2 + "N" * 10


def from_text(text: Column) -> Column:
    """The sequence a text stands for; what is no ASCII letter or digit is left out."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z0-9]", ""), LETTERS, AS_BASES)


def encode(kmer: Column) -> Column:
    """The number of a k-mer, whose bases may be of either case; null if any base is invalid or it is longer than MAX_K."""
    valid = kmer.rlike(f"^[ACGTacgt]{{1,{MAX_K}}}$")
    return F.when(valid, F.conv(F.translate(kmer, BASES + BASES.lower(), "01230123"), 4, 10).cast("long"))


def decode(code: Column, k: int) -> Column:
    """The k-mer of a number: pairs of bits are spread to hexadecimal digits, at most 16 bases at a time."""
    parts = []
    for bases in ([k] if k <= 16 else [k - 16, 16]):
        x = F.shiftrightunsigned(code, 32) if k > 16 and not parts else code.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        parts.append(F.translate(F.lpad(F.hex(x), bases, "0"), "0123", BASES))
    return F.concat(*parts)


def revcomp(seq: Column) -> Column:
    """Reverse complement; bases keep their case, other letters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def revcomp_code(code: Column, k: int) -> Column:
    """Reverse complement of a number: complemented bits, two-bit groups reversed by swapping ever larger halves."""
    x = F.bitwise_not(code)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def windows(seq: Column, k: int, left: int = 0, right: int = 0) -> Column:
    """``array<struct<pos, kmer>>`` of all windows that start in ``[left, length - right - k]``; none if it is too short.

    For short sequences in a plain column: each window walks from the start. Long ones go through :func:`chunks`.
    """
    last = F.length(seq) - right - k
    starts = F.when(last >= left, F.sequence(F.lit(left), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.substring(seq, i + 1, F.lit(k)).alias("kmer")))


def chunks(seq: Column, k: int, size: int = 256) -> Column:
    """``array<struct<at, part>>`` that together hold every window of ``k`` bases once: ``size`` starts each."""
    count = F.ceil(F.length(seq) / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct((i * size).alias("at"), F.substring(seq, i * size + 1, F.lit(size + k - 1)).alias("part")))


def is_valid(kmer: Column) -> Column:
    return ~kmer.rlike("[^ACGT]")


def mate_name(title: Column) -> Column:
    """A read's title without the mark of its mate."""
    return F.regexp_replace(title, "/[12]$", "")


def quality_mask(quality: Column, k: int, least: int) -> Column:
    """For each window whether all its bases reach ``least`` (Phred, offset 33); ``quality`` is a plain column."""
    low = f"[!-{chr(33 + least - 1)}]"
    return F.transform(windows(quality, k), lambda w: ~w["kmer"].rlike(low))


def run_lengths(states: Column) -> Column:
    """Run-length text of an array of one-letter states, such as ``12*3=``."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("state"), F.lit(0).alias("n"))

    def add(acc, x):
        same = acc["state"] == x
        flushed = F.when(same | (acc["n"] == 0), acc["done"]).otherwise(F.concat(acc["done"], acc["n"].cast("string"), acc["state"]))
        return F.struct(flushed.alias("done"), x.alias("state"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"))

    return F.aggregate(states, start, add, lambda a: F.when(a["n"] > 0, F.concat(a["done"], a["n"].cast("string"), a["state"])).otherwise(F.lit("")))
