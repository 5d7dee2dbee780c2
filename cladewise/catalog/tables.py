"""The driver's tables and the views that bind the operators to them.

Every view reads whole tables and whole texts. VIEW_SQL holds the same views for the
comparison engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]
AA = "ACDEFGHIKLMNPQRSTVWY"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_BASE = "ACGTACGTACGTACGTACGTACGTAC"

VIEW_SQL = {
    "prx_variant": """
SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS vid,
       CASE WHEN p_size % 3 = 0 THEN 'MT-' || p_brand ELSE p_brand END AS gene,
       p_brand AS brand, l_partkey + 1 AS pos,
       substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) || CASE WHEN l_linenumber = 6 THEN 'A' ELSE '' END AS ref,
       substr('ACGT', CAST(1 + l_suppkey % 4 AS INT), 1) || CASE WHEN l_linenumber >= 6 THEN 'G' ELSE '' END AS alt,
       substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + l_partkey % 20 AS INT), 1) AS ref_aa,
       substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + l_suppkey % 20 AS INT), 1) AS alt_aa,
       CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'noncoding' WHEN 4 THEN 'frameshift'
            ELSE substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + l_partkey % 20 AS INT), 1) || (l_partkey + 1) ||
                 CASE WHEN l_linenumber = 3 THEN '*' ELSE substr('ACDEFGHIKLMNPQRSTVWY', CAST(1 + l_suppkey % 20 AS INT), 1) END
       END AS aa_change,
       CASE WHEN o_orderstatus = 'F' THEN 'GRCh37' ELSE 'GRCh38' END AS assembly,
       CASE WHEN p_size % 3 = 0 THEN 'MT' ELSE CAST(p_size AS VARCHAR) END AS chromosome,
       CASE WHEN p_size % 3 = 0 THEN 'mtDNA' ELSE 'nucDNA' END AS genome,
       CASE WHEN l_returnflag = 'A' THEN 'mito' ELSE 'clin' END AS source_db,
       o_orderpriority AS priority, o_orderstatus AS status, l_linestatus AS linestatus, l_linenumber AS line,
       l_orderkey AS okey, l_partkey AS pkey, l_suppkey AS skey, l_quantity AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "prx_aln": """
SELECT lang AS gene, doc_id AS species, source,
       CASE WHEN doc_id = first_id THEN 'Homo_sapiens|9606|hs|ENST' || doc_id ELSE source || '|' || doc_id || '|asm' END AS header,
       doc_id = first_id AS is_ref, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS seq
FROM documents JOIN (SELECT lang AS l2, min(doc_id) AS first_id FROM documents GROUP BY 1) ON lang = l2""",
    "prx_codon": f"""
SELECT gene, species, source, header, is_ref, translate(seq, '{UPPER}', '{TO_BASE}') AS seq FROM prx_aln""",
    "prx_cell": """
SELECT gene, species, is_ref, unnest(range(length(seq))) AS col, unnest(string_split(seq, '')) AS ch FROM prx_aln
WHERE length(seq) > 0""",
    "prx_word": """
SELECT 'name' AS gene, p_partkey AS species, upper(p_name) AS seq FROM part UNION ALL SELECT 'brand', p_partkey, upper(p_brand) FROM part UNION ALL SELECT 'type', p_partkey, upper(p_type) FROM part
UNION ALL SELECT 'url', page_id, upper(url) FROM pages""",
    "prx_interval": """
SELECT p_brand AS gene, p_size * 100 AS start_pos, p_size * 100 + 150 AS end_pos, min(p_partkey) AS ord
FROM part GROUP BY 1, 2, 3""",
    "prx_edge": """
SELECT 'geo' AS tree, 'ROOT' AS parent, 'R' || r_regionkey AS child FROM region
UNION ALL SELECT 'geo', 'R' || n_regionkey, 'N' || n_nationkey FROM nation
UNION ALL SELECT 'geo', 'N' || c_nationkey, 'C' || c_custkey FROM customer
UNION ALL SELECT 'geo', 'C' || o_custkey, 'O' || o_orderkey FROM orders""",
    "prx_edge2": """
SELECT DISTINCT 'prio' AS tree, 'TOP' AS parent, 'P' || o_orderpriority AS child FROM orders
UNION ALL SELECT DISTINCT 'prio', 'P' || o_orderpriority, 'S' || o_orderpriority || o_orderstatus FROM orders
UNION ALL SELECT 'prio', 'S' || o_orderpriority || o_orderstatus, 'O' || o_orderkey FROM orders""",
    "prx_state": """
SELECT 'ROOT' AS node, 1 AS pos, 'A' AS aa
UNION ALL SELECT 'ROOT', 2, 'A'
UNION ALL SELECT 'R' || r_regionkey, 1, substr('ACDEF', CAST(1 + r_regionkey % 5 AS INT), 1) FROM region
UNION ALL SELECT 'R' || r_regionkey, 2, 'A' FROM region
UNION ALL SELECT 'N' || n_nationkey, 1, substr('ACDEF', CAST(1 + n_nationkey % 5 AS INT), 1) FROM nation
UNION ALL SELECT 'N' || n_nationkey, 2, CASE WHEN n_nationkey % 3 = 0 THEN 'C' ELSE 'A' END FROM nation
UNION ALL SELECT 'C' || c_custkey, 1, substr('ACDEF', CAST(1 + length(c_mktsegment) % 5 AS INT), 1) FROM customer
UNION ALL SELECT 'C' || c_custkey, 2, CASE WHEN c_custkey % 4 = 0 THEN 'C' ELSE 'A' END FROM customer
UNION ALL SELECT 'O' || o_orderkey, 1, substr('ACDEF', CAST(substr(o_orderpriority, 1, 1) AS INT), 1) FROM orders
UNION ALL SELECT 'O' || o_orderkey, 2, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'C' ELSE '-' END FROM orders""",
    "prx_change": """
SELECT e.tree, e.parent, e.child, p.pos, p.aa AS aa_from, c.aa AS aa_to
FROM prx_edge e JOIN prx_state p ON p.node = e.parent JOIN prx_state c ON c.node = e.child AND c.pos = p.pos
WHERE p.aa <> c.aa AND p.aa <> '-' AND c.aa <> '-'""",
    "prx_closure": """
SELECT 'geo' AS tree, e1.parent AS ancestor, e1.child AS node, 1 AS depth FROM prx_edge e1
UNION ALL SELECT 'geo', e1.parent, e2.child, 2 FROM prx_edge e1 JOIN prx_edge e2 ON e2.parent = e1.child
UNION ALL SELECT 'geo', e1.parent, e3.child, 3 FROM prx_edge e1 JOIN prx_edge e2 ON e2.parent = e1.child
  JOIN prx_edge e3 ON e3.parent = e2.child
UNION ALL SELECT 'geo', e1.parent, e4.child, 4 FROM prx_edge e1 JOIN prx_edge e2 ON e2.parent = e1.child
  JOIN prx_edge e3 ON e3.parent = e2.child JOIN prx_edge e4 ON e4.parent = e3.child""",
    "prx_atom": """
SELECT label AS chain, vec_id AS resnum, substr('ARNDCQEGHILKMFPSTWYV', CAST(1 + vec_id % 20 AS INT), 1) AS aa,
       a.name AS atom, a.element, 40 * CAST(embedding[3 * a.j + 1] AS DOUBLE) AS x,
       40 * CAST(embedding[3 * a.j + 2] AS DOUBLE) AS y, 40 * CAST(embedding[3 * a.j + 3] AS DOUBLE) AS z
FROM embeddings, (VALUES (0, 'N', 'N'), (1, 'CA', 'C'), (2, 'CB', 'C'), (3, 'O', 'O')) AS a(j, name, element)""",
    "prx_cell2x2": """
SELECT p_brand AS gene, l_returnflag AS stratum,
       count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS a,
       count(*) FILTER (l_linestatus = 'F' AND NOT l_quantity > 25) AS b,
       count(*) FILTER (NOT l_linestatus = 'F' AND l_quantity > 25) AS c,
       count(*) FILTER (NOT l_linestatus = 'F' AND NOT l_quantity > 25) AS d
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "prx_tested": """
SELECT o_orderkey AS pair_id, o_custkey AS ann_id, c_mktsegment AS dar_gene, o_orderpriority AS contact_gene,
       c_nationkey % 2 = 0 AS a_mt, o_orderkey % 3 = 0 AS b_mt,
       CASE WHEN c_nationkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'mt-mt'
            WHEN c_nationkey % 2 <> 0 AND o_orderkey % 3 <> 0 THEN 'nuc-nuc' ELSE 'mt-nuc' END AS contact_type,
       o_totalprice < 20000 AS low_power, o_totalprice / 100000 AS odds_ratio,
       ((o_orderkey * 7919) % 100003) / 100003.0::DOUBLE AS fisher_p,
       ((o_orderkey * 7907) % 50021) / 50021.0::DOUBLE AS fisher_fdr,
       CASE WHEN o_orderstatus = 'F' THEN ((o_orderkey * 104729) % 100019) / 100019.0::DOUBLE END AS pagel_fdr,
       CASE WHEN o_orderkey % 4 = 0 THEN ((o_orderkey * 611953) % 100043) / 100043.0::DOUBLE END AS branch_fdr,
       CASE o_orderkey % 5 WHEN 0 THEN 'contact_first' WHEN 1 THEN 'co_occurring' WHEN 2 THEN 'contact_after'
            WHEN 3 THEN 'no_contact_change' END AS timing,
       o_custkey % 15 AS n_origins, o_custkey % 7 = 0 AS is_ancestral,
       CAST((o_orderkey * 31) % 9 - 4 AS DOUBLE) AS blosum, n_name AS complex_id, o_orderstatus AS status,
       o_orderdate AS day, o_totalprice AS price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
}


def _pick(letters: str, number):
    return F.substring(F.lit(letters), (F.lit(1) + number % len(letters)).cast("int"), F.lit(1))


class Tables:
    """Lazy access to one scale folder: t.orders, t.variant, t.aln, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.__dict__[name] = df
        return df

    @cached_property
    def variant(self) -> DataFrame:
        joined = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            self.part, F.col("l_partkey") == F.col("p_partkey")
        )
        line, mt = F.col("l_linenumber"), F.col("p_size") % 3 == 0
        ref_aa, alt_aa = _pick(AA, F.col("l_partkey")), _pick(AA, F.col("l_suppkey"))
        pos = F.col("l_partkey") + 1
        return joined.select(
            F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("vid"),
            F.when(mt, F.concat(F.lit("MT-"), "p_brand")).otherwise(F.col("p_brand")).alias("gene"),
            F.col("p_brand").alias("brand"),
            pos.alias("pos"),
            F.concat(_pick("ACGT", F.col("l_partkey")), F.when(line == 6, "A").otherwise("")).alias("ref"),
            F.concat(_pick("ACGT", F.col("l_suppkey")), F.when(line >= 6, "G").otherwise("")).alias("alt"),
            ref_aa.alias("ref_aa"),
            alt_aa.alias("alt_aa"),
            F.when(line == 1, "").when(line == 2, "noncoding").when(line == 4, "frameshift").otherwise(
                F.concat(ref_aa, pos.cast("string"), F.when(line == 3, "*").otherwise(alt_aa))
            ).alias("aa_change"),
            F.when(F.col("o_orderstatus") == "F", "GRCh37").otherwise("GRCh38").alias("assembly"),
            F.when(mt, "MT").otherwise(F.col("p_size").cast("string")).alias("chromosome"),
            F.when(mt, "mtDNA").otherwise("nucDNA").alias("genome"),
            F.when(F.col("l_returnflag") == "A", "mito").otherwise("clin").alias("source_db"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            F.col("l_linestatus").alias("linestatus"),
            line.alias("line"),
            F.col("l_orderkey").alias("okey"),
            F.col("l_partkey").alias("pkey"),
            F.col("l_suppkey").alias("skey"),
            F.col("l_quantity").alias("quantity"),
        )

    @cached_property
    def aln(self) -> DataFrame:
        first = self.documents.groupBy("lang").agg(F.min("doc_id").alias("first_id"))
        is_ref = F.col("doc_id") == F.col("first_id")
        # One row a language: a shuffle by it would deal all texts to a handful of tasks.
        return self.documents.join(F.broadcast(first), "lang").select(
            F.col("lang").alias("gene"),
            F.col("doc_id").alias("species"),
            "source",
            F.when(is_ref, F.concat(F.lit("Homo_sapiens|9606|hs|ENST"), F.col("doc_id").cast("string")))
            .otherwise(F.concat("source", F.lit("|"), F.col("doc_id").cast("string"), F.lit("|asm")))
            .alias("header"),
            is_ref.alias("is_ref"),
            F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")).alias("seq"),
        )

    @cached_property
    def codon(self) -> DataFrame:
        return self.aln.withColumn("seq", F.translate("seq", UPPER, TO_BASE))

    @cached_property
    def word(self) -> DataFrame:
        """Short alignments: names, brands and types of the same parts, and addresses of pages."""
        def rows(df, gene, species, seq):
            return df.select(F.lit(gene).alias("gene"), F.col(species).alias("species"), F.upper(seq).alias("seq"))

        own = [rows(self.part, g, "p_partkey", f"p_{g}") for g in ("name", "brand", "type")]
        return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(rows(self.pages, "url", "page_id", "url"))

    @cached_property
    def interval(self) -> DataFrame:
        return self.part.groupBy(
            F.col("p_brand").alias("gene"),
            (F.col("p_size") * 100).alias("start_pos"),
            (F.col("p_size") * 100 + 150).alias("end_pos"),
        ).agg(F.min("p_partkey").alias("ord"))

    @cached_property
    def edge(self) -> DataFrame:
        def part(df, parent, child):
            return df.select(F.lit("geo").alias("tree"), parent.alias("parent"), child.alias("child"))

        def node(letter, key):
            return F.concat(F.lit(letter), F.col(key).cast("string"))

        return (
            part(self.region, F.lit("ROOT"), node("R", "r_regionkey"))
            .unionAll(part(self.nation, node("R", "n_regionkey"), node("N", "n_nationkey")))
            .unionAll(part(self.customer, node("N", "c_nationkey"), node("C", "c_custkey")))
            .unionAll(part(self.orders, node("C", "o_custkey"), node("O", "o_orderkey")))
        )

    @cached_property
    def edge2(self) -> DataFrame:
        p = F.concat(F.lit("P"), "o_orderpriority")
        s = F.concat(F.lit("S"), "o_orderpriority", "o_orderstatus")
        o = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))

        def part(parent, child):
            return self.orders.select(F.lit("prio").alias("tree"), parent.alias("parent"), child.alias("child"))

        return part(F.lit("TOP"), p).distinct().unionAll(part(p, s).distinct()).unionAll(part(s, o))

    @cached_property
    def state(self) -> DataFrame:
        def rows(df, letter, key, one, two):
            node = F.concat(F.lit(letter), F.col(key).cast("string"))
            return df.select(
                node.alias("node"),
                F.explode(F.create_map(F.lit(1), one, F.lit(2), two)).alias("pos", "aa"),
            )

        root = self.region.agg(F.max(F.lit("ROOT")).alias("node")).select(
            "node", F.explode(F.create_map(F.lit(1), F.lit("A"), F.lit(2), F.lit("A"))).alias("pos", "aa")
        )
        return (
            root.unionAll(rows(self.region, "R", "r_regionkey", _pick("ACDEF", F.col("r_regionkey")), F.lit("A")))
            .unionAll(rows(self.nation, "N", "n_nationkey", _pick("ACDEF", F.col("n_nationkey")),
                           F.when(F.col("n_nationkey") % 3 == 0, "C").otherwise("A")))
            .unionAll(rows(self.customer, "C", "c_custkey", _pick("ACDEF", F.length("c_mktsegment")),
                           F.when(F.col("c_custkey") % 4 == 0, "C").otherwise("A")))
            .unionAll(rows(self.orders, "O", "o_orderkey",
                           _pick("ACDEF", F.substring("o_orderpriority", 1, 1).cast("int") - 1),
                           F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "C").otherwise("-")))
        )

    @cached_property
    def atom(self) -> DataFrame:
        kinds = F.array(*[
            F.struct(F.lit(j).alias("j"), F.lit(n).alias("name"), F.lit(e).alias("element"))
            for j, n, e in ((0, "N", "N"), (1, "CA", "C"), (2, "CB", "C"), (3, "O", "O"))
        ])
        a = self.embeddings.withColumn("a", F.explode(kinds))

        def axis(i):
            return 40 * F.element_at("embedding", (F.col("a.j") * 3 + i).cast("int")).cast("double")

        return a.select(
            F.col("label").alias("chain"), F.col("vec_id").alias("resnum"),
            _pick("ARNDCQEGHILKMFPSTWYV", F.col("vec_id")).alias("aa"),
            F.col("a.name").alias("atom"), F.col("a.element").alias("element"),
            axis(1).alias("x"), axis(2).alias("y"), axis(3).alias("z"),
        )

    @cached_property
    def cell2x2(self) -> DataFrame:
        e, h = F.col("l_linestatus") == "F", F.col("l_quantity") > 25
        return (
            self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("gene"), F.col("l_returnflag").alias("stratum"))
            .agg(F.count_if(e & h).alias("a"), F.count_if(e & ~h).alias("b"),
                 F.count_if(~e & h).alias("c"), F.count_if(~e & ~h).alias("d"))
        )

    @cached_property
    def tested(self) -> DataFrame:
        j = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey")
        )
        k = F.col("o_orderkey")
        a, b = F.col("c_nationkey") % 2 == 0, k % 3 == 0

        def frac(mul, mod):
            return (k * mul) % mod / float(mod)

        return j.select(
            k.alias("pair_id"), F.col("o_custkey").alias("ann_id"), F.col("c_mktsegment").alias("dar_gene"),
            F.col("o_orderpriority").alias("contact_gene"), a.alias("a_mt"), b.alias("b_mt"),
            F.when(a & b, "mt-mt").when(~a & ~b, "nuc-nuc").otherwise("mt-nuc").alias("contact_type"),
            (F.col("o_totalprice") < 20000).alias("low_power"), (F.col("o_totalprice") / 100000).alias("odds_ratio"),
            frac(7919, 100003).alias("fisher_p"), frac(7907, 50021).alias("fisher_fdr"),
            F.when(F.col("o_orderstatus") == "F", frac(104729, 100019)).alias("pagel_fdr"),
            F.when(k % 4 == 0, frac(611953, 100043)).alias("branch_fdr"),
            F.when(k % 5 == 0, "contact_first").when(k % 5 == 1, "co_occurring").when(k % 5 == 2, "contact_after")
            .when(k % 5 == 3, "no_contact_change").alias("timing"),
            (F.col("o_custkey") % 15).alias("n_origins"), (F.col("o_custkey") % 7 == 0).alias("is_ancestral"),
            ((k * 31) % 9 - 4).cast("double").alias("blosum"), F.col("n_name").alias("complex_id"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"),
        )
