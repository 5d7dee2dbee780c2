"""Line dedup by a log-template tree, in DataFrame functions only.

Lines, cut at sentence ends, are the records. A record with a digit in a token has that token
masked. The tree has a fixed depth: token count, then the leading tokens; records of one leaf differ further on,
and there a token that few records of the leaf share becomes a wildcard. What is left is the template.
A template that recurs in ``MIN_DOCS`` documents that are mostly their own (at most ``REPEATED`` of their
characters stand in recurring templates) is boilerplate, and its records are dropped everywhere.
Copies of a whole document are not boilerplate: their records recur together, so near-duplicate removal sees them whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import cut_lineage, guarded, keyed

#: Tokens of a record that is parsed; leading tokens of a leaf; share of a template's tokens that may be wildcards.
MIN_TOKENS, DEPTH, WILD = 6, 4, 0.25
MIN_DOCS, REPEATED = 3, 0.6
#: Records end behind a line end, and behind a sentence mark and a space.
ENDS = r"(?<=\n)|(?<=[.!?] )"
MASK, MARK = "<*>", "\x01"


def records(text: Column) -> Column:
    """The records of a text; concatenated they are the text."""
    marked = text
    for end in (". ", "! ", "? ", "\n"):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    # Plain replacements and a one-character split are far cheaper than the look-behind, which serves texts that hold the mark.
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, ENDS, -1)).otherwise(F.split(marked, MARK, -1))


def parsed(rows: DataFrame) -> DataFrame:
    """(_key, i, size, doc_size, n, leaf, form, masked) of each record; leaf is 0 for one with too few tokens."""
    text = F.col("text")
    # Whole texts tell which records need a pattern: without runs of blanks and blanks other than a space, a split at single spaces says the same.
    odd = reduce(or_, [F.contains(text, F.lit(blank)) for blank in ("  ", "\t", "\x0b", "\f", "\r")])
    # Computed in front of the explode, which else carries the text along and reads it once a record.
    whole = rows.select("_key", F.length("text").alias("doc_size"), odd.alias("odd"), text.rlike("[0-9]").alias("digits"), records(text).alias("units"))
    # A text has a record at least. The outer form spares the filter on that, which would split every text once more.
    cut = whole.select("_key", "doc_size", "odd", "digits", F.posexplode_outer("units").alias("i", "unit"))
    bare = F.when(F.col("odd"), F.trim(F.col("unit"), F.lit(" \n\t\r\f"))).otherwise(F.trim(F.replace("unit", F.lit("\n"), F.lit(""))))
    cut = cut.select("_key", "doc_size", "odd", "digits", "i", F.length("unit").alias("size"), bare.alias("bare"))
    masked = F.when(F.col("digits") & F.col("bare").rlike("[0-9]"), F.regexp_replace("bare", r"\S*[0-9]\S*", MASK)).otherwise(F.col("bare"))
    cut = cut.select("_key", "doc_size", "odd", "i", "size", masked.alias("masked"))
    cut = cut.select("*", F.when(F.col("odd"), F.split("masked", r"\s+")).otherwise(F.split("masked", " ")).alias("tokens"))
    leaf = F.when(F.size("tokens") >= MIN_TOKENS, F.xxhash64(F.size("tokens"), F.array_join(F.slice("tokens", 1, DEPTH), " "))).otherwise(F.lit(0).cast("long"))
    return cut.select("_key", "i", "size", "doc_size", F.size("tokens").alias("n"), leaf.alias("leaf"), F.xxhash64("masked").alias("form"), "masked")


def templates(held: DataFrame, min_docs: int = MIN_DOCS, wild: float = WILD) -> DataFrame:
    """(leaf, form, template) of the forms whose template has few enough wildcards."""
    forms = held.groupBy("leaf", "form").agg(F.max("masked").alias("masked"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
    forms = cut_lineage(forms)
    tokens = forms.select("leaf", "form", "n", "c", F.posexplode(F.split("masked", r"\s+")).alias("at", "token"))
    fixed = tokens.groupBy("leaf", "at", "token").agg(F.sum("c").alias("support")).where(F.col("support") >= min_docs)
    placed = tokens.join(fixed, ["leaf", "at", "token"], "left")
    kept = F.when(F.col("support").isNotNull(), F.col("token")).otherwise(F.lit(MASK))
    made = placed.groupBy("leaf", "form", "n").agg(F.count(F.when(F.col("support").isNull(), 1)).alias("gaps"), F.array_sort(F.collect_list(F.struct("at", kept.alias("token")))).alias("line"))
    return made.where(F.col("gaps") <= wild * F.col("n")).select("leaf", "form", F.xxhash64("leaf", F.array_join(F.col("line.token"), " ")).alias("template"))


def crowded(cut: DataFrame, min_docs: int) -> DataFrame:
    """The leaves of at least ``min_docs`` records.

    Leaf 0 is left out by the count: a filter on the leaf would be moved below it, where it cuts every record once more.
    """
    return cut.groupBy("leaf").agg(F.count(F.when(F.col("leaf") != 0, 1)).alias("c")).where(F.col("c") >= min_docs).select("leaf")


def dropped(rows: DataFrame, min_docs: int = MIN_DOCS, repeated: float = REPEATED) -> DataFrame:
    """(_key, drop): the indices of the records that go, for each text that loses any. ``rows`` has _key and text."""
    cut = parsed(rows)
    # A leaf with fewer records than that can hold no recurring template; most of the text goes no further.
    leaves = cut_lineage(crowded(cut, min_docs))
    held = cut_lineage(cut.join(guarded(leaves), "leaf"))
    places = cut_lineage(held.drop("masked").join(templates(held, min_docs), ["leaf", "form"]).select("_key", "i", "size", "doc_size", "template"))
    docs = places.select("_key", "template").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs"))
    again = cut_lineage(places.join(guarded(cut_lineage(docs.where(F.col("docs") >= min_docs).select("template"))), "template"))
    own = again.select("_key", "i", "size", "doc_size").distinct().groupBy("_key", "doc_size").agg(F.sum("size").alias("said")).where(F.col("said") <= repeated * F.col("doc_size"))
    carried = again.select("_key", "template").distinct().join(own.select("_key"), "_key").groupBy("template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    return again.join(guarded(cut_lineage(carried.select("template"))), "template").groupBy("_key").agg(F.collect_set("i").alias("drop"))


def strip_templates(docs: DataFrame, *keep: str, min_docs: int = MIN_DOCS, repeated: float = REPEATED) -> DataFrame:
    """doc_id, the columns named, text without boilerplate records, n_records and n_dropped of every row of ``docs``.

    A null or empty text has one empty record and loses none. Repeated rows count as one document and lose the
    same records; null ids are kept, other columns are ignored, an empty table gives an empty result.
    """
    rows = keyed(docs, *keep)
    drops = guarded(cut_lineage(dropped(rows.select("_key", "text"), min_docs, repeated)))
    cut = rows.select("doc_id", *keep, "_key", "text", records(F.col("text")).alias("_units")).join(drops, "_key", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_units") - 1), F.coalesce("drop", F.array().cast("array<int>")))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("_units", i + 1)), ""))
    return cut.select("doc_id", *keep, text.alias("text"), F.size("_units").cast("long").alias("n_records"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


#: The same rows in DuckDB SQL: doc_id, n_records, n_dropped and the digest of the text that stays.
ORACLE = rf"""
WITH rows_ AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
keyed AS (SELECT DISTINCT doc_id, text FROM rows_),
units AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(1), 'g'), chr(1)) AS u FROM keyed),
cut AS (SELECT doc_id, text, unnest(range(len(u))) AS i, unnest(u) AS unit FROM units),
masked AS (SELECT doc_id, text, i, length(unit) AS size, regexp_replace(regexp_replace(unit, '^[ \n\t\r\f]+|[ \n\t\r\f]+$', '', 'g'), '\S*[0-9]\S*', '{MASK}', 'g') AS m FROM cut),
parsed AS (SELECT *, string_split_regex(m, '\s+') AS tokens FROM masked),
units6 AS (SELECT doc_id, text, i, size, m, tokens, len(tokens) AS n, len(tokens) || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf FROM parsed WHERE len(tokens) >= {MIN_TOKENS}),
leaves AS (SELECT leaf FROM units6 GROUP BY 1 HAVING count(*) >= {MIN_DOCS}),
forms AS (SELECT leaf, m, any_value(tokens) AS tokens, any_value(n) AS n, count(*) AS c FROM units6 SEMI JOIN leaves USING (leaf) GROUP BY 1, 2),
tokens AS (SELECT leaf, m, n, c, unnest(range(n)) AS pos, unnest(tokens) AS token FROM forms),
fixed AS (SELECT leaf, pos, token FROM tokens GROUP BY 1, 2, 3 HAVING sum(c) >= {MIN_DOCS}),
made AS (SELECT t.leaf, t.m, n, count(*) FILTER (f.token IS NULL) AS gaps, string_agg(coalesce(f.token, '{MASK}'), ' ' ORDER BY t.pos) AS line
         FROM tokens t LEFT JOIN fixed f ON t.leaf = f.leaf AND t.pos = f.pos AND t.token = f.token GROUP BY 1, 2, 3),
places AS (SELECT doc_id, text, i, size, u.leaf || chr(1) || line AS template FROM units6 u JOIN made ON u.leaf = made.leaf AND u.m = made.m WHERE gaps <= {WILD} * made.n),
common AS (SELECT template FROM (SELECT DISTINCT doc_id, text, template FROM places) GROUP BY 1 HAVING count(*) >= {MIN_DOCS}),
again AS (SELECT * FROM places SEMI JOIN common USING (template)),
own AS (SELECT doc_id, text FROM again GROUP BY 1, 2 HAVING sum(size) <= {REPEATED} * length(text)),
carried AS (SELECT template FROM (SELECT DISTINCT a.doc_id, a.text, template FROM again a JOIN own o ON a.doc_id IS NOT DISTINCT FROM o.doc_id AND a.text = o.text) GROUP BY 1 HAVING count(*) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT doc_id, text, i FROM again SEMI JOIN carried USING (template)),
kept AS (SELECT c.doc_id, c.text, count(*) AS n_records, count(g.i) AS n_dropped, coalesce(string_agg(c.unit, '' ORDER BY c.i) FILTER (g.i IS NULL), '') AS left_text
         FROM cut c LEFT JOIN gone g ON c.doc_id IS NOT DISTINCT FROM g.doc_id AND c.text = g.text AND c.i = g.i GROUP BY 1, 2)
SELECT r.doc_id, n_records, n_dropped, sha256(left_text) AS text_sha256 FROM rows_ r JOIN kept k ON r.doc_id IS NOT DISTINCT FROM k.doc_id AND r.text = k.text
"""
