"""S: readers, writers and file governance, each on files Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files, readers, sinks
from .registry import query

C = F.col


def _tsv(df, path, **options):
    df.write.mode("overwrite").csv(path, sep="\t", header=True, **options)
    return path


def _text(df, path, **options):
    df.write.mode("overwrite").options(**options).text(path)
    return path


@query("s01_read_tsv_dated", "SELECT o_orderkey, o_orderpriority, '2024-03-01' AS source_version FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    root = scratch_path(t.spark, "dated")
    for status, day in (("F", "2024-01-01"), ("O", "2024-02-01"), ("P", "2024-03-01")):
        _tsv(t.orders.where(C("o_orderstatus") == status).select("o_orderkey", "o_orderpriority"), f"{root}/orders_{day}.tsv")
    return readers.read_tsv_dated(t.spark, f"{root}/orders_*.tsv/part-*", by_date=True, schema="o_orderkey long, o_orderpriority string")


@query("s02_read_lenient_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ' ' || chr(233) AS name, CASE WHEN c_custkey % 5 <> 1 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0")
def _(t):
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    k = C("c_custkey")
    name = F.concat("c_name", F.lit(" "), F.lit("é"))
    line = F.concat_ws("\t", k.cast("string"), name, F.when(k % 5 != 1, C("c_mktsegment")), F.when(k % 7 == 0, F.concat_ws("\t", F.lit("x"), F.lit("too many"))))
    root = scratch_path(t.spark, "lenient")
    body = t.customer.select(line.alias(" Key\tNAME \tSegment"))
    # An unusual separator writes the lines as they are.
    body.write.csv(root, sep="¦", header=True, encoding="windows-1252", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_lenient_tsv(t.spark, root).select("key", "name", "segment")


@query("s03_read_gz_tsv", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def _(t):
    path = _tsv(t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity"), scratch_path(t.spark, "gz"), compression="gzip")
    df = readers.read_gz_tsv(t.spark, path, schema="l_orderkey long, l_returnflag string, l_quantity double")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _fasta(t):
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    rec = t.aln.where(F.length("seq") > 0).select(F.concat(F.lit(">"), "header", F.lit(" "), "gene", F.lit("\n"), F.lower(wrapped)).alias("value"))
    return readers.read_fasta(t.spark, _text(rec, scratch_path(t.spark, "fasta")))


@query("s04_read_fasta", "SELECT header AS seq_id, split_part(header, '|', 1) AS species, md5(seq) AS seq_md5 FROM prx_aln WHERE length(seq) > 0")
def _(t):
    return _fasta(t).select("seq_id", "species", F.md5("seq").alias("seq_md5"))


@query("s05_parse_seq_header", """
SELECT header, CASE WHEN is_ref THEN 'species_taxid_assembly_transcript' ELSE 'unclassified' END AS header_schema, split_part(header, '|', 1) AS h_species, split_part(header, '|', 2) AS taxid, split_part(header, '|', 3) AS accession FROM prx_aln""")
def _(t):
    return readers.parse_seq_header(t.aln).select("header", "header_schema", "h_species", "taxid", "accession")


@query("s06_read_state_table", """
WITH s AS (SELECT o_orderkey AS k, 'N' || o_orderkey AS node, o_custkey AS site, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN '-' ELSE 'R' END AS state, (o_orderkey % 100) / 100.0::DOUBLE AS p FROM orders)
SELECT node, site, state, round(greatest(p, 1 - p), 4) AS prob, CASE WHEN greatest(p, 1 - p) >= 0.8 THEN 'high' ELSE 'low' END AS tier FROM s WHERE state <> '-'""")
def _(t):
    p = (C("o_orderkey") % 100) / 100.0
    st = F.when(C("o_orderstatus") == "F", "A").when(C("o_orderstatus") == "O", "-").otherwise("R")
    src = t.orders.select(F.concat(F.lit("N"), C("o_orderkey").cast("string")).alias("Node"), C("o_custkey").alias("Site"), st.alias("State"), p.alias("p_A"), (1 - p).alias("p_R"))
    return readers.read_state_table(t.spark, _tsv(src, scratch_path(t.spark, "state"))).withColumn("prob", F.round("prob", 4))


@query("s07_read_newick", """
WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k, 'ROOT' AS parent, 'I' || k AS child, 1 AS level, 2.5 AS branch_length FROM o UNION ALL SELECT k, 'ROOT', 'C' || k, 1, NULL FROM o UNION ALL SELECT k, 'I' || k, 'A' || k, 2, 1.0 FROM o UNION ALL SELECT k, 'I' || k, 'B b', 2, 0.5 FROM o""")
def _(t):
    k = C("o_orderkey").cast("string")
    tree = F.concat(F.lit("((A"), k, F.lit(":1.0,'B b':0.5)I"), k, F.lit(":2.5,C"), k, F.lit(");"))
    return readers.read_newick(t.orders.select(C("o_orderkey").alias("k"), tree.alias("newick")), "k", "newick")


@query("s08_read_atom_table", """
SELECT 'L' || chain AS chain, resnum, atom, element, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM prx_atom WHERE atom = CASE WHEN aa = 'G' THEN 'CA' ELSE 'CB' END""")
def _(t):
    three = F.element_at(F.create_map(*[F.lit(v) for kv in ((b, a) for a, b in readers.STANDARD_RESIDUES.items()) for v in kv]), C("aa"))
    num = [F.format_string("%.3f", C(c)) for c in "xyz"]
    atoms = t.atom.select(
        C("resnum").alias("k"), F.concat_ws(" ", F.lit("ATOM"), "element", "atom", three, F.concat(F.lit("L"), C("chain").cast("string")), C("resnum").cast("string"), *num, F.lit("1")).alias("l"))
    water = t.supplier.select((-C("s_suppkey") - 1).alias("k"), F.concat_ws(" ", F.lit("HETATM"), F.lit("O"), F.lit("O"), F.lit("HOH"), F.lit("L0"), C("s_suppkey").cast("string"), F.lit("0 0 0 1")).alias("l"))
    names = ["group_PDB", "type_symbol", "auth_atom_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    head = F.concat(F.lit("data_b"), C("k").cast("string"), F.lit("\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names)))
    # One data block per residue: four atom lines.
    block = atoms.unionByName(water).groupBy("k").agg(F.array_join(F.collect_list("l"), "\n").alias("b"))
    path = _text(block.select(F.concat(head, "b").alias("value")), scratch_path(t.spark, "cif"))
    out = readers.beta_atoms(readers.read_atom_table(t.spark, path))
    return out.select("chain", "resnum", "atom", "element", *[(C(c) + 0.0).alias(c) for c in "xyz"])


@query("s09_read_annotation_json", """
SELECT unnest(['lines', 'array']) AS mode, CAST(event_id AS VARCHAR) AS _id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'""")
def _(t):
    """Records as lines, and as one array a file (a file for each kind of event), which several tasks read."""
    rec = t.events.select(C("event_id").cast("string").alias("_id"), F.when(C("event_type") == "error", True).alias("notfound"), F.from_json("props", "k bigint").alias("dbnsfp"),
                          F.lit('a "[{\\').alias("note"), C("event_type").alias("p"))
    lines, arrays = scratch_path(t.spark, "json"), scratch_path(t.spark, "json")
    rec.drop("p").write.json(lines)
    body = rec.select("p", F.lit(1).alias("o"), F.concat(F.to_json(F.struct("_id", "notfound", "dbnsfp", "note")), F.lit(",")).alias("value"))
    ends = rec.select("p").distinct().select("p", F.inline(F.array(F.struct(F.lit(0).alias("o"), F.lit("[").alias("value")), F.struct(F.lit(2).alias("o"), F.lit("null]").alias("value")))))
    body.unionByName(ends).repartition("p").sortWithinPartitions("p", "o").drop("o").write.partitionBy("p").text(arrays)
    read = {"lines": readers.read_annotation_json(t.spark, lines, arrays=False), "array": readers.read_annotation_json(t.spark, f"{arrays}/p=*/part-*", size=1 << 16)}
    out = [d.select(F.lit(m).alias("mode"), "_id", F.variant_get("doc", "$.dbnsfp.k", "bigint").alias("k")) for m, d in read.items()]
    return out[0].unionByName(out[1])


@query("s10_marker_tokens", r"""
WITH v AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[()]', ' ', 'g') AS txt FROM pages), k AS (SELECT DISTINCT page_id, unnest(regexp_split_to_array(trim(txt), '\s+')) AS tok FROM v)
SELECT DISTINCT page_id, CAST(regexp_extract(tok, '^(\d+)', 1) AS BIGINT) AS pos, nullif(upper(regexp_extract(tok, '^\d+([A-Za-z]?)', 1)), '') AS alt FROM k WHERE regexp_full_match(tok, '\d+[A-Za-z]?!?') AND NOT regexp_full_match(tok, '\d+d')""")
def _(t):
    return readers.marker_tokens(t.pages, "page_id", "html")


@query("s11_merge_score_rows", """
WITH o AS (SELECT o_custkey AS k, o_orderkey AS ord, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS s, lower(substr(o_orderpriority, 3)) AS l FROM orders), f AS (SELECT k, l, min(ord) AS f FROM o GROUP BY 1, 2)
SELECT k, (SELECT arg_max(s, ord) FROM (SELECT COALESCE(s, -1) AS s, ord FROM o x WHERE x.k = f.k)) AS score, string_agg(l, ' | ' ORDER BY f) AS label FROM f GROUP BY 1""")
def _(t):
    src = t.orders.select(C("o_custkey").alias("k"), C("o_orderkey").alias("ord"), F.when(C("o_orderstatus") != "O", C("o_totalprice")).alias("score"), F.lower(F.substring("o_orderpriority", 3, 99)).alias("label"))
    return readers.merge_score_rows(src, ["k"], "score", "label", "ord").withColumn("score", F.coalesce("score", F.lit(-1.0)))


@query("s12_read_summaries", """
SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total_c1, round(sum(s_suppkey / 2.0), 2) AS total_c2, round(sum(s_suppkey / 2.0), 2) AS total_named FROM supplier WHERE s_suppkey % 10 <> 3""")
def _(t):
    k = C("s_suppkey")
    line = F.when(k % 10 == 3, "Pdb\tSD\ttotal energy").otherwise(F.concat_ws("\t", "s_name", C("s_acctbal").cast("string"), (k / 2.0).cast("string")))
    path = _text(t.supplier.select(line.alias("value")), scratch_path(t.spark, "fxout"))
    out = readers.read_summaries(t.spark, path, named="total energy")
    return out.agg(F.count("*").alias("n"), F.round(F.sum("c1"), 2).alias("total_c1"), F.round(F.sum("c2"), 2).alias("total_c2"), F.round(F.sum("named"), 2).alias("total_named"))


@query("s13_read_result_lines", "SELECT 'k' || o_orderkey AS key, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value FROM orders WHERE o_orderkey % 3 <> 0")
def _(t):
    k = C("o_orderkey")
    line = F.concat_ws("\t", F.concat(F.lit("k"), k.cast("string")), F.when(k % 3 == 0, "other").otherwise("pagel_p"),
                       F.when(C("o_orderstatus") == "F", "NA").otherwise(C("o_totalprice").cast("string")))
    return readers.read_result_lines(t.spark, _text(t.orders.select(line.alias("value")), scratch_path(t.spark, "results")))


@query("s14_read_pair_scores", """
WITH sc AS (SELECT l_returnflag AS gene, l_partkey AS i, l_suppkey AS j, max(l_discount) AS score FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3)
SELECT 'R' AS asked_gene, gene, i, j, score FROM sc WHERE gene = 'R' UNION ALL SELECT 'A', gene, i, j, score FROM sc WHERE gene = 'A' UNION ALL SELECT 'N', gene, i, j, score FROM sc WHERE gene = 'A'""")
def _(t):
    sc = t.lineitem.where("l_returnflag <> 'N'").groupBy(C("l_returnflag").alias("gene"), C("l_partkey").alias("i"), C("l_suppkey").alias("j")).agg(F.max("l_discount").alias("score"))
    path = scratch_path(t.spark, "scores")
    sc.write.partitionBy("gene").parquet(path)
    genes = t.lineitem.select(C("l_returnflag").alias("gene")).distinct()
    alias = genes.where("gene = 'N'").select("gene", F.lit("A").alias("alias"))
    return readers.read_pair_scores(t.spark, path, genes, alias)


@query("s15_write_master", "SELECT genome, count(*) AS n, count(DISTINCT vid) AS n_ids FROM prx_variant GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "master")
    sinks.write_master(t.variant.withColumn("x", F.lit(float("nan"))), path)
    back = t.spark.read.schema("vid string, genome string").json(f"{path}/by_genome")
    both = t.spark.read.parquet(f"{path}/parquet").select("vid", "genome").join(back.select("vid", C("genome").alias("g")), "vid").where("g = genome")
    # Rows of an id meet by the join already: they are counted there.
    return both.groupBy("vid", "genome").agg(F.count("*").alias("k")).groupBy("genome").agg(F.sum("k").alias("n"), F.count("vid").alias("n_ids"))


@query("s16_write_text", "SELECT pair_id, printf('%.3e', fisher_p) AS p, COALESCE(printf('%.3f', pagel_fdr), '') AS rate FROM prx_tested")
def _(t):
    path = scratch_path(t.spark, "tsv")
    src = t.tested.select("pair_id", C("fisher_p").alias("p"), C("pagel_fdr").alias("rate"))
    sinks.write_text(src, path, ["pair_id", "p", "rate"], scientific=["p"], fixed=["rate"])
    return t.spark.read.csv(path, sep="\t", header=True, schema="pair_id long, p string, rate string").fillna("", ["rate"])


@query("s17_run_metadata", """
WITH c AS (SELECT contact_type, COALESCE(timing, 'null') AS s, count(*) AS n FROM prx_tested GROUP BY 1, 2) SELECT contact_type, CAST(sum(n) AS BIGINT) AS rows_total, '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS by_status FROM c GROUP BY 1""")
def _(t):
    return sinks.run_metadata(t.tested, "contact_type", "timing")


@query("s18_upsert_manifest", """
WITH a AS (SELECT o_custkey AS resource, 'f' || o_orderkey % 40 AS path, max(o_orderdate) AS date FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), b AS (SELECT o_custkey AS resource, 'f' || o_orderkey % 40 AS path, max(o_orderdate) AS date FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
u AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.resource = a.resource AND b.path = a.path) UNION ALL SELECT * FROM b)
SELECT resource, path, strftime(date, '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY resource ORDER BY date DESC, path DESC) = 1 AS active FROM u""")
def _(t):
    def man(cond):
        return t.orders.where(cond).groupBy(C("o_custkey").alias("resource"), F.concat(F.lit("f"), (C("o_orderkey") % 40).cast("string")).alias("path")).agg(
            F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("date"))

    return files.upsert_manifest(man("o_orderstatus <> 'P'"), man("o_orderstatus = 'P'"))


def _by_priority(t, name):
    """The orders' keys and states as sorted lines, one text file a priority."""
    root = scratch_path(t.spark, name)
    line = F.concat_ws("\t", "o_orderkey", "o_orderstatus")
    rows = t.orders.select(line.alias("value"), C("o_orderpriority").alias("p"), "o_orderkey").repartition("p").sortWithinPartitions("p", "o_orderkey").drop("o_orderkey")
    rows.write.partitionBy("p").text(root)
    return root


def _part():
    return F.url_decode(F.regexp_extract("path", "p=([^/]+)/", 1)).alias("part")


@query("s19_register_files", """
SELECT o_orderpriority AS part, sum(length(l))::BIGINT AS size, sha256(string_agg(l, '' ORDER BY o_orderkey)) AS sha256, 'txt' AS kind, '' AS date FROM (SELECT o_orderpriority, o_orderkey, o_orderkey || chr(9) || o_orderstatus || chr(10) AS l FROM orders) GROUP BY 1""")
def _(t):
    return files.register_files(t.spark, f"{_by_priority(t, 'register')}/p=*/part-*").select(_part(), "size", "sha256", "kind", "date")


@query("s20_validate_files", """
WITH p AS (SELECT DISTINCT o_orderpriority AS part FROM orders), n AS (SELECT DISTINCT 'n' || n_nationkey AS part, n_nationkey % 3 AS r FROM nation)
SELECT part, 'txt' AS kind, 'ok' AS status FROM p UNION ALL SELECT part, 'gz', 'invalid:not a gzip file' FROM p UNION ALL SELECT part, 'parquet', 'invalid:not a parquet file' FROM p UNION ALL SELECT part, 'zip', 'invalid:not a zip file' FROM p
UNION ALL SELECT part, 'json', CASE WHEN r = 2 THEN 'invalid:not JSON' ELSE 'ok' END FROM n UNION ALL SELECT 'compressed', 'gz', 'ok' FROM region UNION ALL SELECT 'columns', 'parquet', 'ok' FROM region""")
def _(t):
    """Files of every kind, whole ones and ones of another kind than they say."""
    root = _by_priority(t, "validate")
    text = [files.validate_files(t.spark, f"{root}/p=*/part-*", kind) for kind in (None, "gz", "parquet", "zip")]
    k, other = C("n_nationkey"), scratch_path(t.spark, "validate")
    doc = F.to_json(F.array(F.struct("n_nationkey", "n_name", F.array(F.lit(1.5), F.lit(None)).alias("x"), (k > 3).alias("y"))))
    shape = F.when(k % 3 == 1, F.concat(F.lit(' {"a" : '), doc, F.lit(' , "b\\n": {} }'))).when(k % 3 == 2, F.concat(doc, F.lit(","))).otherwise(doc)
    t.nation.select(shape.alias("value"), F.concat(F.lit("n"), k).alias("p")).repartition("p").write.partitionBy("p").text(f"{other}/json")
    t.region.repartition("r_regionkey").write.option("maxRecordsPerFile", 1).csv(f"{other}/gz", compression="gzip")
    t.region.repartition("r_regionkey").write.option("maxRecordsPerFile", 1).parquet(f"{other}/pq")
    out = files.validate_files(t.spark, f"{other}/json/p=*/part-*", "json")
    for found in text:
        out = out.unionByName(found)
    rest = files.validate_files(t.spark, f"{other}/gz/part-*.gz").select(F.lit("compressed").alias("part"), "kind", "status").unionByName(
        files.validate_files(t.spark, f"{other}/pq/part-*.parquet").select(F.lit("columns").alias("part"), "kind", "status"))
    return out.select(_part(), "kind", "status").unionByName(rest)


@query("s21_check_freeze", """
WITH k(kind, status, failures, warnings) AS (VALUES ('as it was', 'pass', '', ''), ('gone', 'fail', 'missing artifact', ''), ('longer', 'fail', 'byte_size', ''), ('other', 'fail', 'sha256 differs', ''), ('rows', 'fail', 'row_count', ''), ('uncounted', 'pass', '', 'row_count not checked'))
SELECT o_orderpriority AS part, kind, status, failures, warnings, n_rows FROM k, (SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1)""")
def _(t):
    """Files of the orders, one folder a priority, registered as they are and altered in every way the check knows."""
    root = scratch_path(t.spark, "freeze")
    t.orders.repartition("o_orderpriority").select("o_orderkey", "o_orderpriority", C("o_orderpriority").alias("p")).write.partitionBy("p").csv(root, sep="\t", header=True)
    glob = f"{root}/p=*/part-*.csv"
    seen = files.register_files(t.spark, glob).join(files.count_lines(t.spark, glob), "path")
    kinds = {"as it was": {}, "gone": {"path": F.concat("path", F.lit(".gone"))}, "longer": {"byte_size": C("byte_size") + 1}, "other": {"sha256": F.sha2(C("sha256").cast("binary"), 256)},
             "rows": {"row_count": (C("n_rows") + 1).cast("string")}, "uncounted": {}}
    own = seen.select(F.lit("true").alias("frozen"), "path", C("size").alias("byte_size"), "sha256", C("n_rows").cast("string").alias("row_count"), "n_rows", _part())
    out = None
    for kind, change in kinds.items():
        found = seen.withColumn("n_rows", F.lit(None).cast("bigint")) if kind == "uncounted" else seen
        reg = own.withColumns(change).withColumn("stage_id", F.concat_ws("|", "part", F.lit(kind), C("n_rows").cast("string"))).drop("n_rows", "part")
        part = files.check_freeze(reg, found).select(F.split("stage_id", r"\|").alias("s"), "status", "failures", "warnings")
        out = part if out is None else out.unionByName(part)
    named = F.regexp_replace("failures", r"(byte_size|row_count) .*", "$1")
    return out.select(C("s")[0].alias("part"), C("s")[1].alias("kind"), "status", named.alias("failures"), "warnings", C("s")[2].cast("bigint").alias("n_rows"))


@query("s22_read_transcript_select", "SELECT 'G' || o_custkey AS gene, 'NM_' || max(o_orderkey) AS transcript FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1")
def _(t):
    k = C("o_orderkey").cast("string")
    line = F.concat_ws("\t", F.lit("#a"), F.lit("b"), F.lit("c"), F.concat(F.lit("G"), C("o_custkey").cast("string")), F.lit("e"),
                       F.when(C("o_orderstatus") == "O", F.concat(F.lit("NR_"), k)).otherwise(F.concat(F.lit("NM_"), k, F.lit(".3"))), F.lit("g"), F.lit("ENST1.2"), k)
    path = _text(t.orders.select(line.alias("value")), scratch_path(t.spark, "select"), compression="gzip")
    return readers.read_transcript_select(t.spark, path, order_field=8)[0]


@query("s23_read_gene_coords", """
WITH c AS (SELECT n_name AS gene, least(n_nationkey * 100, 1500) AS s, greatest(n_nationkey * 100, 1500) AS e FROM nation UNION ALL SELECT 'OLD_' || n_nationkey, least(n_nationkey * 100, 1500), greatest(n_nationkey * 100, 1500) FROM nation WHERE n_nationkey < 5)
SELECT gene, s AS start, e AS "end" FROM c UNION ALL SELECT 'NATION_' || substr(gene, 5), s, e FROM c WHERE gene LIKE 'OLD%'""")
def _(t):
    k = C("n_nationkey")
    src = t.nation.select(C("n_name").alias("gene"), F.lit("MT").alias("chr"), (k * 100).alias("start"), F.lit(1500).alias("end"), F.lit("+").alias("strand"))
    old = t.nation.where(k < 5).select(F.concat(F.lit("OLD_"), k.cast("string")).alias("gene"), F.lit("MT").alias("chr"), (k * 100).alias("start"), F.lit(1500).alias("end"), F.lit("+").alias("strand"))
    path = _tsv(src.unionByName(old), scratch_path(t.spark, "coords"))
    alias = t.nation.select(F.concat(F.lit("OLD_"), k.cast("string")).alias("alias"), C("n_name").alias("symbol"))
    return readers.gene_coords(t.spark.read.csv(path, sep="\t", header=True), alias).select("gene", "start", "end")


@query("s24_reference_sequences", "SELECT gene, md5(translate(seq, '-X', '')) AS seq_md5, 'ENST' || species AS transcript FROM prx_aln WHERE is_ref")
def _(t):
    from ..operators.alignment import reference_sequences

    return reference_sequences(t.aln, "-X").select("gene", F.md5("seq").alias("seq_md5"), "transcript")


@query("s25_conform", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return readers.conform(t.orders, ["o_orderkey", "not_there", "o_orderstatus"])


@query("s26_route_records", """
SELECT n_name AS gene, count(*) AS n FROM orders JOIN nation ON n_nationkey = o_custkey % 60 WHERE n_nationkey % 2 = 0 GROUP BY 1""")
def _(t):
    head = F.concat(F.lit(">lcl|AC"), C("o_orderkey").cast("string"), F.lit("_cds_1 [gene=old_"), (C("o_custkey") % 60).cast("string"), F.lit("]"))
    alias = t.nation.select(F.concat(F.lit("OLD_"), C("n_nationkey").cast("string")).alias("alias"), C("n_name").alias("symbol"))
    wanted = t.nation.where("n_nationkey % 2 = 0").select(C("n_name").alias("gene"))
    return readers.route_records(t.orders.select(head.alias("header")), "header", alias, wanted).groupBy("gene").agg(F.count("*").alias("n"))


@query("s27_read_property_matrix", "SELECT p_brand AS ref, p_type AS alt, CAST(max(p_size) AS DOUBLE) AS score FROM part GROUP BY 1, 2")
def _(t):
    m = t.part.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("s"))
    doc = m.select(F.to_json(F.map_from_arrays(F.array("p_brand"), F.array(F.map_from_arrays(F.array("p_type"), F.array("s"))))).alias("j"))
    return readers.property_matrix(doc, "j")
