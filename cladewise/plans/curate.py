"""Curation of two sources into one master table with an inventory of what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import protein, rules, text
from ..operators.lookup import alias_lookup
from ..operators.ranges import overlap_expand
from ..operators.summaries import duplicate_status, link_duplicates
from ..session import cut_lineage

C = F.col
MASTER = ["variant_id", "source_group_id", "record_id", "source_db", "genome", "gene", "genomic_pos", "ref_nt", "alt_nt", "genomic_ref", "genomic_alt",
          "aa_change", "ref_aa", "alt_aa", "is_overlap", "reason", "eligible"]


def curate_mito(rows: DataFrame, intervals: DataFrame, sequences: DataFrame, minus_range: tuple[int, int], source: str = "mito") -> tuple[DataFrame, DataFrame]:
    """(records, inventory) of (id, pos, ref, alt, aachange); one record per overlapping gene.

    ``sequences`` holds (gene, start, end, strand, seq); overlap rows are translated in the frame of
    each gene that has one.
    """
    src = rows.withColumns({"_pos": text.to_int("pos"), "genomic_ref": F.upper(F.trim("ref")), "genomic_alt": F.upper(F.trim("alt")),
                            "aa_text": F.coalesce(F.trim("aachange"), F.lit(""))})
    bad = src.where("_pos is null").select(F.lit(source).alias("source_db"), C("id").alias("record_id"), F.lit("invalid_position").alias("exclusion_reason"))
    good = src.where("_pos is not null")
    gid = F.concat(F.lit(source + ":"), C("id").cast("string"))
    hit = overlap_expand(good, "_pos", intervals, "gene", "start_pos", "end_pos", gid)
    outside = good.join(hit.select("id").distinct(), ["id"], "left_anti").select(
        F.lit(source).alias("source_db"), C("id").alias("record_id"), F.lit("outside_panel").alias("exclusion_reason"))
    x = hit.join(sequences.select("gene", C("start").alias("_s"), C("end").alias("_e"), "strand", "seq"), ["gene"], "left")
    x = x.withColumns({"ref_nt": protein.complement_in_range("genomic_ref", "_pos", *minus_range), "alt_nt": protein.complement_in_range("genomic_alt", "_pos", *minus_range)})
    framed = C("is_overlap") & C("seq").isNotNull()
    f = F.when(framed, protein.frame_consequence("seq", "_pos", "_s", "_e", "strand", "alt_nt"))
    flags = rules.variant_flags("genomic_ref", "genomic_alt", "aa_text")
    # Written once: its fields are read many times, by the master and by the groups of duplicates.
    x = cut_lineage(x.withColumns({"_f": f, "_v": flags, "_p": text.parse_aa_change("aa_text")}).drop("seq"))
    missense = F.when(C("_f").isNotNull(), F.coalesce(C("_f.is_missense"), F.lit(False))).otherwise(C("_v.is_missense"))
    failure = F.when(C("is_overlap") & ~F.coalesce(C("_f.status") == "resolved", F.lit(False)), "unresolved_overlap_translation").otherwise("")
    x = x.withColumn("_v", C("_v").withField("is_missense", missense)).withColumn("reason", rules.exclusion_reason("_v", failure))

    def framed_or(field, other):
        return F.when(C("_f").isNotNull(), C("_f")[field]).otherwise(other)

    out = x.select(
        C("row_id").alias("variant_id"), C("group_id").alias("source_group_id"), C("id").cast("string").alias("record_id"), F.lit(source).alias("source_db"),
        F.lit("mtDNA").alias("genome"), "gene", C("_pos").alias("genomic_pos"), "ref_nt", "alt_nt", "genomic_ref", "genomic_alt",
        framed_or("aa_change", C("aa_text")).alias("aa_change"), framed_or("ref_aa", F.coalesce(C("_p.ref"), F.lit(""))).alias("ref_aa"),
        framed_or("alt_aa", F.coalesce(C("_p.alt"), F.lit(""))).alias("alt_aa"), "is_overlap", "reason", (C("reason") == "").alias("eligible"))
    return out, bad.unionByName(outside)


def curate_nuclear(rows: DataFrame, aliases: DataFrame, source: str = "clin", build: str = "GRCh38") -> tuple[DataFrame, DataFrame]:
    """(records, inventory) of (id, gene_raw, assembly, kind, chromosome, name, ref, alt, start)."""
    x = alias_lookup(rows, "gene_raw", aliases, "gene")
    lost = x.where("gene is null").select(F.lit(source).alias("source_db"), C("id").cast("string").alias("record_id"), F.lit("outside_panel").alias("exclusion_reason"))
    x = x.where("gene is not null").withColumns({"_h": text.extract_hgvs_c("name"), "_p": text.parse_protein_hgvs("name")})
    snv = F.lower(F.trim("kind")) == "single nucleotide variant"
    p = C("_p")
    missense = p.isNotNull() & (p["ref"] != p["alt"]) & ~p["alt"].isin("*", "X") & (p["ref"] != "X")
    parse = F.when((C("assembly") == build) & (C("chromosome") != "MT") & p.isNull(), "unparsable_aa").otherwise("")
    flags = F.struct(p.isNotNull().alias("is_coding"), snv.alias("is_snv"), F.lit(False).alias("is_frameshift"),
                     F.coalesce(p["alt"] == "*", F.lit(False)).alias("is_nonsense"), F.coalesce(missense, F.lit(False)).alias("is_missense"))
    reason = rules.override_reason(rules.exclusion_reason(flags, parse), "assembly", "chromosome", snv, build)
    x = x.withColumn("reason", reason)
    gref, galt = F.upper(F.trim("ref")), F.upper(F.trim("alt"))
    out = x.select(
        F.concat_ws(":", F.lit(source), C("id").cast("string"), "gene").alias("variant_id"), F.concat_ws(":", F.lit(source), C("id").cast("string")).alias("source_group_id"),
        C("id").cast("string").alias("record_id"), F.lit(source).alias("source_db"), F.lit("nucDNA").alias("genome"), "gene", C("start").cast("bigint").alias("genomic_pos"),
        F.coalesce(text.blank_to_null("_h.ref"), gref).alias("ref_nt"), F.coalesce(text.blank_to_null("_h.alt"), galt).alias("alt_nt"),
        gref.alias("genomic_ref"), galt.alias("genomic_alt"), F.coalesce(F.concat(p["ref"], p["pos"], p["alt"]), F.lit("")).alias("aa_change"),
        F.coalesce(p["ref"], F.lit("")).alias("ref_aa"), F.coalesce(p["alt"], F.lit("")).alias("alt_aa"), F.lit(False).alias("is_overlap"),
        "reason", (C("reason") == "").alias("eligible"))
    return out, lost


def curate(mito: DataFrame, nuclear: DataFrame, intervals: DataFrame, sequences: DataFrame, aliases: DataFrame,
           minus_range: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(master, inventory, duplicate groups)."""
    m, out_m = curate_mito(mito, intervals, sequences, minus_range)
    n, out_n = curate_nuclear(nuclear, aliases)
    both = m.unionByName(n).withColumn("match_key", rules.match_key(rules.encoded_by("gene"), "gene", "genomic_pos", "genomic_ref", "genomic_alt"))
    groups = link_duplicates(both, "match_key", "source_db", "variant_id", ["clin", "mito"])
    return duplicate_status(both, groups, "match_key", "source_db"), out_m.select("source_db", C("record_id").cast("string").alias("record_id"), "exclusion_reason").unionByName(out_n), groups
