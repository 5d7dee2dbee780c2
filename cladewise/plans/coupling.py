"""Coupling scores of residue pairs, with a note for every reason a score is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators.ranking import percentile_strict
from ..session import cut_lineage

C = F.col


def score_pairs(pairs: DataFrame, aln: DataFrame, di: DataFrame, m_eff: DataFrame, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``pairs``: (pair_id, gene, pos, gene_b, pos_b, genome, genome_b); ``di``: (gene, i, j, score), i < j;
    ``m_eff``: (gene, m_eff). ``stats`` are (row means, grand mean) for the product correction.
    """
    pmap = al.position_map(al.reference_row(aln), "-X!*").select("gene", "pos", C("col").cast("bigint").alias("col"))
    size = aln.groupBy("gene").agg(F.count(F.lit(1)).alias("n_species"))
    ref = pmap.select("gene").distinct()
    x = (
        pairs.join(pmap.withColumnRenamed("col", "ci"), ["gene", "pos"], "left")
        .join(pmap.select(C("gene").alias("gene_b"), C("pos").alias("pos_b"), C("col").alias("cj")), ["gene_b", "pos_b"], "left")
        .join(size, ["gene"], "left").join(size.select(C("gene").alias("gene_b"), C("n_species").alias("_nb")), ["gene_b"], "left")
        .join(ref.withColumn("_r", F.lit(True)), ["gene"], "left").join(ref.select(C("gene").alias("gene_b"), F.lit(True).alias("_rb")), ["gene_b"], "left")
    )
    x = cut_lineage(x.withColumns({"inter": C("gene") != C("gene_b"), "i": F.least("ci", "cj"), "j": F.greatest("ci", "cj")}))
    cols = x.select("gene", C("ci").alias("col")).unionByName(x.select(C("gene_b").alias("gene"), C("cj").alias("col"))).where("col is not null").distinct()
    entropy = al.column_entropy(al.asked_cells(aln, cols).where("ch is not null")).drop("n_residues")
    usable = x.where("ci is not null and cj is not null")
    mi = cut_lineage(al.mutual_information(aln, usable.where("not inter and ci <> cj").select("gene", "i", "j")))
    mi = al.apc_correct(mi, *stats) if stats else mi.withColumn("mi_apc", C("mi"))
    between = al.mutual_information_between(aln, usable.where("inter").select("gene", C("ci").alias("i"), "gene_b", C("cj").alias("j")))
    between = al.apc_correct(between, *stats) if stats else between.withColumn("mi_apc", C("mi"))
    scored = percentile_strict(di, "score", di, "score", ["gene"], "di_percentile")
    out = (
        x.join(entropy.select("gene", C("col").alias("ci"), C("entropy").alias("dar_entropy")), ["gene", "ci"], "left")
        .join(entropy.select(C("gene").alias("gene_b"), C("col").alias("cj"), C("entropy").alias("contact_entropy")), ["gene_b", "cj"], "left")
        .join(mi.withColumn("inter", F.lit(False)), ["gene", "i", "j", "inter"], "left")
        .join(between.select("gene", C("i").alias("ci"), "gene_b", C("j").alias("cj"), C("mi").alias("_mb"), C("mi_apc").alias("_ab")), ["gene", "ci", "gene_b", "cj"], "left")
        .join(scored.withColumn("inter", F.lit(False)), ["gene", "i", "j", "inter"], "left")
        .join(m_eff, ["gene"], "left").join(di.select("gene").distinct().withColumn("_di", F.lit(True)), ["gene"], "left")
    )
    alone = (
        F.when(C("n_species").isNull() | C("_nb").isNull(), "no_alignment").when(C("_r").isNull() | C("_rb").isNull(), "no_human_ref")
        .when(C("ci").isNull() | C("cj").isNull(), "pos_not_in_aln")
    )
    asym = F.when(C("genome") != C("genome_b"), "mt_nuc_asymmetry")
    no_result, intra = C("_di").isNull(), ~C("inter")
    parts = F.array_compact(F.array(
        asym, F.when(C("inter"), "hpc_intra_only"), F.when(intra & no_result, "no_result"),
        F.when(intra & ~no_result & C("score").isNull(), "pair_not_scored"), F.when(intra & ~no_result & (C("m_eff") < C("n_species")), "insufficient_meff")))
    note = F.coalesce(alone, F.array_join(parts, ","))
    return out.select("pair_id", "gene", "pos", "gene_b", "pos_b", "inter", "dar_entropy", "contact_entropy", F.coalesce("mi", "_mb").alias("mi_raw"),
                      F.coalesce("mi_apc", "_ab").alias("mi_apc"), C("score").alias("di"), "di_percentile", "m_eff", note.alias("note"))
