"""Column expressions for reading free text, identifiers and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for "no value" in the source files.
NULL_WORDS = ["", "nan", "na", "none"]
# Spellings of "not observed" in the plasmy columns.
ABSENT_WORDS = ["", "no", "nr", "nan"]

# Three-letter and one-letter residue codes.
RESIDUE_CODES = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C",
    "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P",
    "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}

AA_CHANGE = r"^([A-Za-z*]+)(\d+)([A-Za-z*]+)$"
AA_CHANGE_STRICT = r"^([A-Za-z]+)(\d+)([A-Za-z]+)$"
PROTEIN_HGVS = r"p\.([A-Z][a-z]{2}|\*)(\d+)([A-Z][a-z]{2}|\*)"
CDS_HGVS = r"c\.\d+([ACGT])>([ACGT])"
TRANSCRIPT = r"(NM_[\d.]+|NR_[\d.]+|NP_[\d.]+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once, where an expression needs it many times."""
    return F.get(F.transform(F.array(value), lambda x: fn(x)), F.lit(0))


def group_or_null(c, pattern: str, group: int = 1) -> Column:
    """regexp_extract that gives null, not the empty string, on a miss."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


def null_if_word(c, words=NULL_WORDS) -> Column:
    c = _col(c)
    return F.when(F.lower(F.trim(c)).isin(words), None).otherwise(c)


def blank_to_null(c) -> Column:
    return F.nullif(_col(c).cast("string"), F.lit(""))


def first_non_null(*cols) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def first_scalar(json_text, path: str = "$") -> Column:
    """Leaf at a path of a JSON text as a string; a list gives its first element."""
    doc = F.try_parse_json(_col(json_text))
    head = F.try_variant_get(doc, path + "[0]", "string")
    whole = F.try_variant_get(doc, path, "string")
    is_list = F.try_variant_get(doc, path, "array<variant>").isNotNull()
    return F.when(is_list, head).otherwise(whole)


def to_float(c) -> Column:
    return _col(c).try_cast("double")


def to_int(c) -> Column:
    """Whole-number text only: "3.5" is a failed cast, not 3."""
    c = F.trim(_col(c).cast("string"))
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))


def plasmy(homo, hetero) -> Column:
    has = [~F.coalesce(F.lower(F.trim(_col(c))), F.lit("")).isin(ABSENT_WORDS) for c in (homo, hetero)]
    return F.array_join(
        F.array_compact(F.array(F.when(has[0], F.lit("homo")), F.when(has[1], F.lit("hetero")))), "/"
    )


def count_list(c) -> Column:
    """Number of non-blank comma tokens; a null word counts as none."""
    c = F.trim(F.coalesce(_col(c), F.lit("")))
    tokens = F.filter(F.split(c, ","), lambda t: F.trim(t) != "")
    return F.when(F.lower(c) == "nan", F.lit(0)).otherwise(F.size(tokens)).cast("bigint")


def dedupe_terms(c) -> Column:
    """Trimmed non-blank tokens between | or ;, first occurrence kept in order."""
    tokens = F.transform(F.split(_col(c), "[|;]"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def parse_aa_change(c, stops: bool = True) -> Column:
    """struct(ref, pos, alt) in upper case, null where the text has another form."""
    pattern = AA_CHANGE if stops else AA_CHANGE_STRICT
    c = F.trim(_col(c))
    return F.when(
        c.rlike(pattern),
        F.struct(
            F.upper(F.regexp_extract(c, pattern, 1)).alias("ref"),
            F.regexp_extract(c, pattern, 2).cast("bigint").alias("pos"),
            F.upper(F.regexp_extract(c, pattern, 3)).alias("alt"),
        ),
    )


def residue_letter(c) -> Column:
    """Three-letter code to one letter; any other code reads as X."""
    return F.coalesce(F.try_element_at(literal_map(RESIDUE_CODES), _col(c)), F.lit("X"))


def parse_protein_hgvs(c, allow_stop: bool = True) -> Column:
    """struct(ref, pos, alt) from p.Xxx123Yyy.

    With allow_stop a stop sign is accepted and, being no residue code, reads as X;
    without it the whole change is rejected.
    """
    c = _col(c)
    first, last = F.regexp_extract(c, PROTEIN_HGVS, 1), F.regexp_extract(c, PROTEIN_HGVS, 3)
    accepted = c.rlike(PROTEIN_HGVS)
    if not allow_stop:
        accepted = accepted & (first != "*") & (last != "*")
    return F.when(
        accepted,
        F.struct(
            residue_letter(first).alias("ref"),
            F.regexp_extract(c, PROTEIN_HGVS, 2).alias("pos"),
            residue_letter(last).alias("alt"),
        ),
    )


def extract_hgvs_c(c) -> Column:
    """struct(hgvs, transcript, ref, alt); the transcript prefix is optional."""
    c = _col(c)
    tx, change = F.regexp_extract(c, TRANSCRIPT, 1), F.regexp_extract(c, CDS_HGVS, 0)
    hgvs = F.when(change == "", "").when(tx == "", change).otherwise(F.concat_ws(":", tx, change))
    return F.struct(
        hgvs.alias("hgvs"),
        tx.alias("transcript"),
        F.regexp_extract(c, CDS_HGVS, 1).alias("ref"),
        F.regexp_extract(c, CDS_HGVS, 2).alias("alt"),
    )


def extract_hgvs_p(c, allow_stop: bool = True) -> Column:
    return F.regexp_extract(_col(c), r"(p\.[A-Za-z0-9*]+)" if allow_stop else r"(p\.[A-Za-z0-9]+)", 1)


def review_stars(c) -> Column:
    r = F.lower(_col(c))
    return (
        F.when(r.contains("guideline"), 4)
        .when(r.contains("expert"), 3)
        .when(r.contains("multiple") & r.contains("no conflicts"), 2)
        .when(r.contains("single submitter") | r.contains("conflicting"), 1)
        .otherwise(0)
    )


def aa_position_from_text(c, stops: bool = True) -> Column:
    """Residue number, first from a p. form and else from any letters-digits-letters run."""
    letters = "[A-Za-z*]+" if stops else "[A-Za-z]+"
    generic = rf"{letters}(\d+){letters}"
    return F.coalesce(group_or_null(c, r"p\." + generic), group_or_null(c, generic)).cast("bigint")


def file_date(c) -> Column:
    """YYYY-MM-DD inside a file name, or the empty string."""
    return F.regexp_extract(_col(c), r"(\d{4}-\d{2}-\d{2})", 1)


def strip_version(c) -> Column:
    return F.split_part(_col(c), F.lit("."), F.lit(1))


def transcript_from_name(c) -> Column:
    """First NM_ token of a name without its version suffix."""
    return strip_version(group_or_null(c, r"(NM_[\d.]+)"))


def strip_tip_suffix(c) -> Column:
    """Drop trailing all-capital tokens while more than two tokens remain."""
    tokens = F.split(_col(c), "_")
    head, tail = F.slice(tokens, 1, 2), F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(0)))
    kept = F.regexp_replace(F.array_join(tail, "_"), r"(^|_)[A-Z]+(_[A-Z]+)*$", "")
    return F.concat_ws("_", F.array_join(head, "_"), F.nullif(kept, F.lit("")))


def coord_key(c) -> Column:
    """Text form of a whole-number coordinate: "45.0" and "45" are the same key."""
    return _col(c).try_cast("double").cast("bigint").cast("string")


def categorize_change(c) -> Column:
    """Class of an amino-acid change text, most specific rule first."""
    raw = F.trim(_col(c))
    t = F.lower(raw)
    parsed = parse_aa_change(raw, stops=False)
    return (
        F.when(F.coalesce(t, F.lit("")).isin("", "nan"), "Missing")
        .when(t.contains("noncoding"), "Noncoding")
        .when(t.contains("syn"), "Synonymous")
        .when(t.contains("frameshift") | t.contains("fs"), "Frameshift")
        .when(t.contains("*") | t.contains("ter") | t.contains("stop"), "Nonsense")
        .when(parsed["ref"] == parsed["alt"], "Synonymous")
        .when(parsed.isNotNull(), "Missense")
        .otherwise("Other")
    )


def parse_set(c) -> Column:
    """Distinct elements of a list stored as a JSON text."""
    return F.array_distinct(F.from_json(_col(c), "array<string>"))


def sanitize_sequence(c, mask: str = "X!*", gap: str = "-") -> Column:
    return F.translate(_col(c), mask, gap * len(mask))


def prediction_class(c) -> Column:
    low = F.lower(_col(c))
    return (
        F.when(low.isin("lp", "p", "pathogenic", "likely pathogenic"), "likely_pathogenic")
        .when(low.isin("lb", "b", "benign", "likely benign"), "likely_benign")
        .when(low.isNotNull(), "ambiguous")
    )


# Population order in which the first maximum wins.
POPULATIONS = ("afr", "amr", "asj", "eas", "fin", "nfe", "oth")


def population_frequency(doc, roots=("gnomad_genome", "gnomad_exome"), order=POPULATIONS) -> Column:
    """struct of global counts and the highest sub-population frequency; first root present wins."""
    parsed = F.try_parse_json(_col(doc))
    # Field of the first root that is there at all.
    has_first = F.try_variant_get(parsed, f"$.{roots[0]}", "variant").isNotNull()

    def leaf(path, kind):
        a = F.try_variant_get(parsed, f"$.{roots[0]}.{path}", kind)
        b = F.try_variant_get(parsed, f"$.{roots[1]}.{path}", kind)
        return F.when(has_first, a).otherwise(b)

    freqs = [(p, leaf(f"af.af_{p}", "double")) for p in order]
    best = F.greatest(*[f for _, f in freqs]) if len(freqs) > 1 else freqs[0][1]
    name = F.when(best.isNull(), None)
    for p, f in freqs:
        name = name.when(f == best, p)
    return F.struct(
        leaf("af.af", "double").alias("af_global"), best.alias("popmax_af"), name.alias("popmax_pop"),
        leaf("ac.ac", "bigint").alias("ac"), leaf("an.an", "bigint").alias("an"), leaf("hom.hom", "bigint").alias("nhomalt"),
    )


FEATURE_SCHEMA = (
    "struct<features:array<struct<type:string,location:struct<end:struct<value:bigint>>,"
    "evidences:array<struct<evidenceCode:string,source:string>>>>>"
)


def leader_feature(doc, wanted=("Transit peptide", "Signal peptide")) -> Column:
    """First feature of the first wanted kind with an end; struct of its end, offset and evidence."""
    features = F.from_json(_col(doc), FEATURE_SCHEMA)["features"]
    picks = []
    for kind in wanted:
        known = F.filter(features, lambda f: f["location"]["end"]["value"].isNotNull())
        picks.append(F.try_element_at(F.filter(known, lambda f: f["type"] == F.lit(kind)), F.lit(1)))
    best = F.coalesce(*picks)
    end = best["location"]["end"]["value"]
    first = F.try_element_at(best["evidences"], F.lit(1))
    src = first["source"]
    # The source is an object with name and id, or a plain string.
    as_object = F.from_json(src, "struct<name:string,id:string>")
    is_object = src.startswith("{")
    parts = F.array_compact(F.array(
        blank_to_null(first["evidenceCode"]),
        blank_to_null(F.when(is_object, as_object["name"]).otherwise(src)),
        blank_to_null(F.when(is_object, as_object["id"])),
    ))
    evidence = F.when(first.isNull(), "manual_no_code").when(F.size(parts) == 0, "manual").otherwise(F.array_join(parts, "|"))
    return F.struct(
        best["type"].alias("feature_type"), end.alias("feature_end"),
        F.when(end != 0, end + 1).otherwise(1).alias("mature_start"), F.coalesce(end, F.lit(0)).alias("mature_offset"),
        F.when(best.isNotNull(), evidence).alias("evidence"),
    )
