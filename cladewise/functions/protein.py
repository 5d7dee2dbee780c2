"""Codons, reading frames and residue properties as Column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let, literal_map

# Residues of the 64 codons in T, C, A, G order, as the public
# genetic-code tables 1 (standard) and 2 (vertebrate mitochondrial) list them.
CODE_TABLES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
}
# Formal charge near pH 7, charge groups and side-chain volumes.
CHARGE = {"R": 1, "K": 1, "H": 0, "D": -1, "E": -1}
GROUPS = {"positive": "RKH", "negative": "DE", "polar": "STNQYC", "nonpolar": "AVLIMFWPG"}
VOLUME = {
    "G": 60, "A": 88, "V": 140, "L": 166, "I": 166, "P": 112, "F": 190, "W": 227, "M": 162, "S": 89,
    "T": 116, "C": 108, "Y": 193, "H": 153, "D": 111, "E": 138, "N": 114, "Q": 143, "K": 168, "R": 173,
}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def codon_map(table: int) -> dict[str, str]:
    return dict(zip(("".join(c) for c in product("TCAG", repeat=3)), CODE_TABLES[table]))


def _residue(codon: Column, table: int) -> Column:
    """Residue of a codon in upper case, read off the table at its number in base four."""
    number = F.conv(F.translate(codon, "TCAG", "0123"), 4, 10).cast("int")
    known = F.substring(F.lit(CODE_TABLES[table]), number + 1, F.lit(1))
    return F.when(codon == "---", "-").when(codon.rlike("^[TCAG]{3}$"), known).otherwise("X")


def translate_codon(codon, table: int = 1) -> Column:
    """--- is a gap; an N, X, - or any unknown base inside gives X."""
    return _residue(F.upper(_col(codon)), table)


def translate_sequence(nt, table: int = 1) -> Column:
    """Whole-sequence translation; null where the length is no multiple of three."""
    nt = F.upper(_col(nt))
    codons = F.regexp_extract_all(nt, F.lit(r"(?s)(...)"), F.lit(1))
    return F.when(F.length(nt) % 3 == 0, F.array_join(F.transform(codons, lambda c: _residue(c, table)), ""))


def codon_start(pos) -> Column:
    return _col(pos) - (_col(pos) - 1) % 3


def mutate_codon(seq, pos, alt) -> Column:
    """The codon around a 1-based position with the new base put in.

    Null where the position or any of the three bases lies outside the sequence, and where ``alt`` is not one base.
    """
    seq, pos = _col(seq), _col(pos).cast("int")
    start = codon_start(pos)
    codon = F.substring(seq, start, F.lit(3))
    mutated = F.overlay(codon, F.upper(_col(alt)), ((pos - 1) % 3 + 1).cast("int"), F.lit(1))
    return F.when((pos >= 1) & (start + 2 <= F.length(seq)) & (F.length(_col(alt)) == 1), mutated)


def genomic_to_cds(pos, start, end, strand) -> Column:
    pos, start, end = _col(pos), _col(start), _col(end)
    return F.when(_col(strand) == "+", pos - start + 1).otherwise(end - pos + 1)


def complement_in_range(base, pos, lo: int, hi: int) -> Column:
    base = _col(base)
    return F.when(_col(pos).between(lo, hi), F.translate(base, "ACGT", "TGCA")).otherwise(base)


def frame_consequence(seq, pos, start, end, strand, alt, table: int = 2) -> Column:
    """Effect of one base change inside a gene, with a status for every way it can fail.

    struct(status, codon_index, ref_aa, alt_aa, aa_change, hgvs_p, is_synonymous, is_missense)
    """
    seq, pos, alt = _col(seq), _col(pos), _col(alt)
    inside = pos.between(_col(start), _col(end))
    cds = genomic_to_cds(pos, start, end, strand)
    first = codon_start(cds)
    ref_codon = F.substring(seq, first.cast("int"), F.lit(3))
    bad = (
        F.when(~F.coalesce(F.length(alt) == 1, F.lit(False)), "not_single_base")
        .when(~inside, "position_outside_gene")
        .when(cds > F.length(seq), "position_outside_sequence")
        .when(first + 2 > F.length(seq), "partial_terminal_codon")
    )

    def letter(codon):
        return F.when(codon == "---", "X").otherwise(_residue(codon, table))

    def finish(x):
        done = x["bad"].isNull()
        change = F.concat(x["ref"], x["index"].cast("string"), x["alt"])
        failed = (x["ref"] == "X") | (x["alt"] == "X")
        return F.struct(
            F.coalesce(x["bad"], F.when(failed, "translation_failed").otherwise("resolved")).alias("status"),
            F.when(done | (x["bad"] == "partial_terminal_codon"), x["index"]).alias("codon_index"),
            F.when(done, x["ref"]).otherwise("").alias("ref_aa"),
            F.when(done, x["alt"]).otherwise("").alias("alt_aa"),
            F.when(done, change).otherwise("").alias("aa_change"),
            F.when(done, F.concat(F.lit("p."), change)).otherwise("").alias("hgvs_p"),
            F.when(done, x["ref"] == x["alt"]).alias("is_synonymous"),
            F.when(done, (x["ref"] != x["alt"]) & (x["alt"] != "*")).alias("is_missense"),
        )

    # The codons are cut out of the long sequence once, before they are looked at several times.
    codons = F.struct(
        bad.alias("bad"), (F.floor((cds - 1) / 3) + 1).alias("index"), F.upper(ref_codon).alias("ref"),
        F.upper(mutate_codon(seq, cds, alt)).alias("alt"),
    )

    def read(x):
        return F.struct(x["bad"].alias("bad"), x["index"].alias("index"), letter(x["ref"]).alias("ref"), letter(x["alt"]).alias("alt"))

    parts = let(codons, read)
    return let(parts, finish)


def charge_of(aa) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CHARGE), _col(aa)), F.lit(0))


def volume_of(aa) -> Column:
    return F.coalesce(F.try_element_at(literal_map(VOLUME), _col(aa)), F.lit(0))


def charge_group(aa) -> Column:
    aa = _col(aa)
    out = None
    for name, letters in GROUPS.items():
        test = aa.isin(list(letters))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def complementarity(dar_ref, dar_alt, con_ref, con_alt) -> Column:
    """How a contact substitution relates to the one it may compensate.

    charge_reversal > charge_rescue > volume_swap > polarity_swap > same_direction.
    """
    cols = [_col(c) for c in (dar_ref, dar_alt, con_ref, con_alt)]
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.coalesce(c == "", F.lit(True))
    dr, da, cr, ca = cols
    g = [charge_group(c) for c in cols]
    sign_flip = [
        g[i].isin("positive", "negative") & g[i + 1].isin("positive", "negative") & (g[i] != g[i + 1]) for i in (0, 2)
    ]
    grow = [volume_of(da) - volume_of(dr), volume_of(ca) - volume_of(cr)]
    polar = [x.isin("positive", "negative", "polar") for x in g]
    both_turn = (polar[0] != polar[1]) & (polar[2] != polar[3])
    return (
        F.when(missing | (dr == da) | (cr == ca), "unclassified")
        .when(sign_flip[0] & sign_flip[1] & (g[1] != g[3]), "charge_reversal")
        .when((g[0] != g[1]) & (g[2] != g[3]), "charge_rescue")
        .when((F.abs(grow[0]) > 20) & (F.abs(grow[1]) > 20) & (grow[0] * grow[1] < 0), "volume_swap")
        .when(both_turn & (polar[1] != polar[3]), "polarity_swap")
        .when(both_turn, "same_direction")
        .otherwise("unclassified")
    )
