"""Readers for the text formats the sources come in.

Every reader returns a lazy DataFrame. "First wins" and "last wins" rules use
``line_order``: the file, the byte where the split starts, and the row number inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NULL_WORDS, blank_to_null, file_date, strip_version
from .arrays import RANGE, read_array_records


def line_order() -> Column:
    """Order of the lines of a glob of files, fixed when the line is read."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of a glob; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")


def newest_file(files: DataFrame, by_date: bool = False) -> DataFrame:
    """One row: the newest file of a listing and the date in its name."""
    table = F.regexp_replace("path", "/part-[^/]*$", "")  # the parts of a folder that Spark wrote are one file
    order = F.struct(file_date(table), "modificationTime", table.alias("t")) if by_date else F.struct("modificationTime", table.alias("t"))
    return files.agg(F.max_by(table, order).alias("path")).withColumn("version", file_date("path"))


def read_tsv_dated(spark: SparkSession, glob: str, by_date: bool = False, **options) -> DataFrame:
    """The newest file that matches, with its version; one path comes to the driver, no data."""
    newest = newest_file(list_files(spark, glob), by_date).first()
    if newest is None or newest["path"] is None:
        raise FileNotFoundError(glob)
    df = spark.read.csv(newest["path"], sep="\t", header=True, **options)
    return df.withColumn("source_version", F.lit(newest["version"]))


def read_lenient_tsv(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """Lines with more fields than the header are left out, shorter ones filled; names trimmed and lowered."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    names = spark.read.csv(path, sep="\t", header=True, encoding=encoding).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_raw"]])
    df = spark.read.csv(path, sep="\t", header=True, encoding=encoding, schema=schema, mode="PERMISSIVE",
                        columnNameOfCorruptRecord="_raw", enforceSchema=True)
    fits = F.coalesce(F.size(F.split("_raw", "\t")) <= len(names), F.lit(True))
    return df.where(fits).drop("_raw").toDF(*[n.strip().lower() for n in names])


def read_gz_tsv(spark: SparkSession, path: str, partitions: int | None = None, **options) -> DataFrame:
    """Gzip cannot be split: one task inflates a file, then its rows are spread out."""
    df = spark.read.csv(path, sep="\t", header=True, **options)
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def normalise_nulls(df: DataFrame, words: Sequence[str] = NULL_WORDS) -> DataFrame:
    """Every spelling of "no value" in string columns becomes null, once, at the edge."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        F.when(F.lower(F.trim(c)).isin(list(words)), None).otherwise(F.col(c)).alias(c) if c in text else F.col(c)
        for c in df.columns
    ])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, seq_id, species, seq): multi-line records, upper case; a ">" inside a header stays in it."""
    rec = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    rec = rec.where(F.trim(F.col("value")) != "").withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", ""))
    head = F.substring_index("value", "\n", 1)
    body = F.substr("value", F.length(head) + 1)
    seq_id = F.regexp_extract(head, r"^(\S*)", 1)
    return rec.select(
        "file", head.alias("header"), seq_id.alias("seq_id"), F.split_part(seq_id, F.lit("|"), F.lit(1)).alias("species"),
        F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"),
    )


def parse_seq_header(df: DataFrame, header: str = "header") -> DataFrame:
    """Fields of species|taxid|accession[|transcript] [| gene] and the schema they follow."""
    left = F.split_part(F.trim(header), F.lit(" | "), F.lit(1))
    fields = F.split(left, r"\|")

    def field(i):
        return F.coalesce(F.get(fields, F.lit(i)), F.lit(""))

    schema = (
        F.when(F.size(fields) >= 4, "species_taxid_assembly_transcript")
        .when(field(2).startswith("NC_"), "species_taxid_accession")
        .otherwise("unclassified")
    )
    gene = F.split_part(F.trim(header), F.lit(" | "), F.lit(2))
    return df.withColumns({"header_schema": schema, "h_species": field(0), "taxid": field(1), "accession": field(2), "h_gene": gene})


def read_state_table(spark: SparkSession, path: str, hc: float = 0.80, lc: float = 0.50) -> DataFrame:
    """(node, site, state, prob, tier) of a node/site/state table with probability columns."""
    # The header names the columns; the first comment-free line is it.
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    probs = [F.col(f"`{c}`").try_cast("double") for c in df.columns if c.startswith("p_")]
    best = probs[0] if len(probs) == 1 else F.greatest(*probs) if probs else F.lit(1.0)
    site = F.col("Site").try_cast("int")
    rows = df.where(site.isNotNull() & (F.length("State") == 1) & (F.col("State") != "-"))
    rows = rows.select(F.col("Node").alias("node"), site.alias("site"), F.col("State").alias("state"), F.coalesce(best, F.lit(1.0)).alias("prob"))
    return rows.withColumn("tier", F.when(F.col("prob") >= hc, "high").when(F.col("prob") >= lc, "low")).where("tier is not null")


@F.udtf(returnType="parent string, child string, level int, branch_length double", useArrow=True)
class NewickEdges:
    """Edges of one tree text: a node is called by its label, the root ROOT without one."""

    def eval(self, text: str):
        if text is None:
            return
        stack, last, buf, quoted, n_anon = [[]], None, "", False, 0
        nodes: list[list] = []  # label, length, children

        def close(buf, kids):
            label, _, length = buf.strip().partition(":")
            label = label.strip().strip("'")
            nodes.append([label, float(length) if length.strip() else None, kids])
            return len(nodes) - 1

        kids_of_open: list[int] = []
        for ch in text.strip():
            if ch == "'":
                quoted = not quoted
            if quoted or ch not in "(),;":
                buf += ch
            elif ch == "(":
                stack.append([])
                buf = ""
            else:
                stack[-1].append(close(buf, kids_of_open))
                kids_of_open, buf = [], ""
                if ch == ")":
                    kids_of_open = stack.pop()
                elif ch == ";":
                    break
        root = stack[0][-1] if stack[0] else None
        if root is None:
            return
        nodes[root][0] = nodes[root][0] or "ROOT"
        level, front = 1, [root]
        while front:
            below = []
            for p in front:
                for c in nodes[p][2]:
                    if not nodes[c][0]:
                        n_anon += 1
                        nodes[c][0] = f"anon_{n_anon}"
                    yield nodes[p][0], nodes[c][0], level, nodes[c][1]
                    below.append(c)
            front, level = below, level + 1


def read_newick(trees: DataFrame, key: str, text: str) -> DataFrame:
    """(key, parent, child, level, branch_length): one job over a table of trees."""
    edges = NewickEdges(F.col(text).outer())
    return trees.lateralJoin(edges).select(key, "parent", "child", "level", "branch_length")


# Three-letter names of the standard residues in structure files.
STANDARD_RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def read_atom_table(spark: SparkSession, path: str, model: str = "1") -> DataFrame:
    """Atoms of the _atom_site loop of each data block: standard residues of one model.

    A block states its own column order, so a block is one row until its loop is split;
    files are cut at block starts and need not fit in one row.
    """
    blocks = spark.read.option("lineSep", "\ndata_").text(path)
    files = blocks.select(F.regexp_extract("value", r"^(?:data_)?(\S+)", 1).alias("pdb"), "value")
    names = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^_atom_site\.(\S+)"), F.lit(1)), lambda t: F.trim(t))
    rows = files.select("pdb", names.alias("names"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^((?:ATOM|HETATM)\b.*)$"), F.lit(1))).alias("line"))
    rows = rows.select("pdb", F.map_from_arrays("names", F.slice(F.split(F.trim("line"), r"\s+"), F.lit(1), F.size("names"))).alias("a"))

    def f(*keys):
        return F.coalesce(*[F.nullif(F.try_element_at("a", F.lit(k)), F.lit("?")) for k in keys])

    atoms = rows.select(
        "pdb", f("auth_asym_id", "label_asym_id").alias("chain"), f("auth_seq_id", "label_seq_id").try_cast("int").alias("resnum"),
        f("auth_comp_id", "label_comp_id").alias("resname"), F.regexp_replace(f("auth_atom_id", "label_atom_id"), '"', "").alias("atom"),
        f("type_symbol").alias("element"), *[f(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"],
        F.coalesce(f("pdbx_PDB_model_num"), F.lit(model)).alias("model"),
    )
    return atoms.where(F.col("resname").isin(list(STANDARD_RESIDUES)) & (F.col("model") == model)).drop("model")


def beta_atoms(atoms: DataFrame, residue: str = "resname", glycine: str = "GLY") -> DataFrame:
    """The side-chain atom that stands for a residue: beta carbon, alpha for glycine."""
    return atoms.where(F.col("atom") == F.when(F.col(residue) == glycine, "CA").otherwise("CB"))


def read_annotation_json(spark: SparkSession, path: str, key: str = "_id", arrays: bool = True, size: int = RANGE) -> DataFrame:
    """(key, doc): records as variants, without those marked as not found.

    A file is a JSON array of records, read in ranges of ``size`` bytes, or with ``arrays`` off one record per line.
    """
    texts = read_array_records(spark, path, size) if arrays else spark.read.text(path).select(F.col("value").alias("record"))
    df = texts.where(F.trim("record") != "").select(F.parse_json("record").alias("doc"))
    lost = F.coalesce(F.try_variant_get("doc", "$.notfound", "boolean"), F.lit(False))
    return df.where(~lost).select(F.variant_get("doc", f"$.{key}", "string").alias(key), "doc")


def marker_tokens(df: DataFrame, key: str, html: str) -> DataFrame:
    """Distinct (key, pos, alt) markers in the visible text of a page.

    Decimals and deletions are skipped, as are back mutations; a token without a letter
    means the transition and has a null alt.
    """
    visible = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "[() ]", " ")
    tok = F.col("tok")
    tokens = df.select(key, F.explode(F.split(F.trim(visible), r"\s+")).alias("tok"))
    kept = tokens.where(tok.rlike(r"^\d+[A-Za-z]?!?$") & ~tok.rlike(r"^\d+d$"))
    return kept.select(
        key, F.regexp_extract("tok", r"^(\d+)", 1).try_cast("bigint").alias("pos"),
        blank_to_null(F.upper(F.regexp_extract("tok", r"^\d+([A-Za-z]?)", 1))).alias("alt"),
    ).distinct()


def merge_score_rows(df: DataFrame, keys: Sequence[str], score: str, label: str, order: str) -> DataFrame:
    """Last score wins, even a null one; a label is appended with " | " unless already contained.

    Repeats of a label change nothing, so only distinct labels of a key meet in a list.
    """
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(score), order).alias("_s"))
    firsts = df.groupBy(*keys, F.coalesce(F.col(label), F.lit("")).alias("_l")).agg(F.min(order).alias("_o"))
    listed = firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]).alias("_ls"))
    folded = F.aggregate(
        F.slice("_ls", F.lit(2), F.size("_ls")), F.get("_ls", F.lit(0)),
        lambda acc, x: F.when((x == "") | acc.contains(x), acc).otherwise(F.concat(acc, F.lit(" | "), x)),
    )
    return last.join(listed, keys).select(*keys, F.col(f"_s.{score}").alias(score), folded.alias(label))


def read_summaries(spark: SparkSession, path: str, named: str | None = None, fallback: int = 5) -> DataFrame:
    """Numeric cells of tab-separated run summaries, header lines skipped.

    (file, line, name, c1, c2[, named]): ``named`` is a column found by its header text,
    or at a fallback place where no header has it.
    """
    raw = spark.read.text(path).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), line_order().alias("line"),
        F.split(F.trim("value"), "\t").alias("c"))
    is_head = F.get("c", F.lit(0)).startswith("Pdb")
    rows = raw.where((F.size("c") >= 2) & ~is_head & (F.trim(F.get("c", F.lit(0))) != ""))
    out = rows.select("file", "line", F.get("c", F.lit(0)).alias("name"), *[F.get("c", F.lit(i)).try_cast("double").alias(f"c{i}") for i in (1, 2)], "c")
    if named is None:
        return out.drop("c")
    heads = raw.where(is_head).groupBy("file").agg(F.min_by(F.array_position("c", named), "line").alias("_at"))
    at = F.coalesce(F.nullif(F.col("_at") - 1, F.lit(-1)), F.lit(fallback)).cast("int")
    return out.join(heads, ["file"], "left").withColumn("named", F.get("c", at).try_cast("double")).drop("c", "_at")


def summary_mean_sd(rows: DataFrame) -> DataFrame:
    """First line of each file with two numbers: mean in the third field, deviation in the second."""
    good = rows.where(F.col("c1").isNotNull() & F.col("c2").isNotNull())
    return good.groupBy("file").agg(F.min_by("c2", "line").alias("mean"), F.min_by("c1", "line").alias("sd"))


def read_result_lines(spark: SparkSession, path: str, tag: str = "pagel_p") -> DataFrame:
    """(key, value) of three-field result lines; NA and non-numbers are null, the last line wins."""
    raw = spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("c"), line_order().alias("o"))
    rows = raw.where((F.size("c") == 3) & (F.get("c", F.lit(1)) == tag))
    return rows.groupBy(F.get("c", F.lit(0)).alias("key")).agg(
        F.max_by(F.struct(F.get("c", F.lit(2)).try_cast("double").alias("v")), "o").alias("_v")
    ).select("key", F.col("_v.v").alias("value"))


def read_pair_scores(spark: SparkSession, path: str, genes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pair scores stored per gene; a gene without any takes those of its other name."""
    scores = spark.read.parquet(path)
    have = scores.select("gene").distinct().withColumn("_own", F.lit(True))
    asked = genes.select("gene").distinct().join(have, ["gene"], "left").join(aliases, ["gene"], "left")
    source = F.when(F.col("_own").isNotNull(), F.col("gene")).otherwise(F.col("alias"))
    return asked.select(F.col("gene").alias("asked_gene"), source.alias("gene")).join(scores, "gene").select(
        "asked_gene", "gene", *[c for c in scores.columns if c != "gene"])


def read_transcript_select(spark: SparkSession, path: str, order_field: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(gene → transcript) and (transcript → transcript) of a selection file; last row wins.

    Rows are ordered by their place in the file, or by a numeric field where the rows stand in several files.
    """
    cells = F.transform(F.split(F.regexp_replace("value", "^#+", ""), "\t"), lambda t: F.trim(t))
    order = line_order() if order_field is None else F.get(cells, F.lit(order_field)).try_cast("bigint")
    raw = spark.read.text(path).select(cells.alias("c"), order.alias("o"))

    def f(i):
        return F.get("c", F.lit(i))

    by_gene = raw.where((F.size("c") >= 6) & (f(3) != "") & f(5).startswith("NM_"))
    by_tx = raw.where((F.size("c") >= 8) & f(5).startswith("NM_") & f(7).startswith("ENST"))
    return (
        by_gene.groupBy(f(3).alias("gene")).agg(F.max_by(strip_version(f(5)), "o").alias("transcript")),
        by_tx.groupBy(strip_version(f(5)).alias("nm")).agg(F.max_by(strip_version(f(7)), "o").alias("enst")),
    )


def strand_from_bounds(df: DataFrame, start: str, end: str, zero_based: bool = False) -> DataFrame:
    """Bounds in order, 1-based, and the strand that their given order tells."""
    s, e = F.col(start), F.col(end)
    lo = F.least(s, e) + (1 if zero_based else 0)
    return df.withColumns({"strand": F.when(s > e, "-").otherwise("+"), "lo": lo, "hi": F.greatest(s, e)})


def gene_coords(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(gene, chr, start, end, strand) with start <= end; old names also appear under the current one."""
    c = df.select("gene", "chr", F.least(F.col("start").cast("bigint"), F.col("end").cast("bigint")).alias("start"),
                  F.greatest(F.col("start").cast("bigint"), F.col("end").cast("bigint")).alias("end"), "strand")
    if aliases is None:
        return c
    renamed = c.join(aliases.select(F.col("alias").alias("gene"), "symbol"), "gene").where("symbol <> gene")
    return c.unionByName(renamed.drop("gene").withColumnRenamed("symbol", "gene").select(*c.columns))


def conform(df: DataFrame, schema: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in schema if c in df.columns])


def route_records(df: DataFrame, header: str, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of wanted genes: the [gene=X] tag of the header under its canonical name."""
    tagged = df.withColumn("alias", F.upper(F.regexp_extract(header, r"\[gene=([^\]]+)\]", 1))).where("alias <> ''")
    named = tagged.join(aliases, "alias").withColumnRenamed("symbol", "gene")
    accession = F.regexp_replace(F.substring_index(header, "_cds_", 1), r"^>?lcl\|", "")
    return named.join(wanted.select("gene"), ["gene"], "left_semi").withColumn("accession", accession)


def property_matrix(df: DataFrame, json: str) -> DataFrame:
    """(ref, alt, score) of a nested JSON map."""
    parsed = F.from_json(json, "map<string,map<string,double>>")
    outer = df.select(F.explode(parsed).alias("ref", "_m"))
    return outer.select("ref", F.explode("_m").alias("alt", "score"))


def property_scale(df: DataFrame, json: str) -> DataFrame:
    return df.select(F.explode(F.from_json(json, "map<string,double>")).alias("aa", "value"))
