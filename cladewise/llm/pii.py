"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall patterns propose spans, which may overlap. Spans that pass the strict rules of their kind are
reported as they are and serve as the label; boosted trees learn from format and context how such a span looks,
and candidates beyond the rules are added if they score above their kind's calibrated threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .columns import cut_lineage

#: Kinds in the order of the results.
KINDS = ["email", "ip", "card", "phone"]
#: Share of labelled spans that a threshold must reach on held-back texts.
PRECISION = 0.8

# Each strict pattern is written so that a run of its characters is entered once, at its start or where the last
# match ended, and never backtracked into: the same matches as the plain form, in linear time on any text.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser generators: written-out addresses, numbers in groups.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?: ?[(\[]at[)\]] ?| at ){_HOST}++(?:(?: ?[(\[]dot[)\]] ?| dot |\.){_HOST}++)++",
    "phone": r"(?:\G|(?<![0-9(]))\(?[0-9]++[) .-](?:[() .-]{0,2}[0-9]++)++",
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|address)\W{0,3}\w{0,8}\W{0,3}$",
    "ip": r"(?i)(\bip|host|server|address|login|from)\W{0,3}\w{0,8}\W{0,3}$",
    "card": r"(?i)(card|visa|credit|payment|account)\W{0,3}\w{0,8}\W{0,3}$",
    "phone": r"(?i)(phone|call|tel|mobile|fax|contact)\W{0,3}\w{0,8}\W{0,3}$",
}
_FOUND = "array<struct<kind:int,strict:boolean,at:int,lead:int,size:int,span:string,before:string,after:string>>"


def _found(kind: str, pattern: str, strict: bool, gate: Column) -> Column:
    """Matches of a pattern with the length of the text before each (since the last match), and what stands beside it."""
    text = F.when(gate, F.col("text")).otherwise(F.lit(""))
    spans, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(spans.alias("span"), pieces.alias("left"), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("right"))
    zipped = zipped.cast("array<struct<span:string,left:string,right:string>>")
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("strict"), i.alias("at"), F.length(x.left).alias("lead"), F.length(x.span).alias("size"),
        x.span.alias("span"), F.right(x.left, F.lit(24)).alias("before"), F.left(x.right, F.lit(1)).alias("after")))
    return F.filter(rows, lambda x: x.span.isNotNull()).cast(_FOUND)


def candidates(rows: DataFrame) -> DataFrame:
    """A row of each span (kind, strict, start, end, span, before, after) and one of each text (kind null) of (_row, doc_id, text).

    Offsets are code points: running sums of the lengths of matches and of what stands between them.
    """
    at, digit = F.contains("text", F.lit("@")), F.col("text").rlike("[0-9]")
    written = F.col("text").rlike(r"(?:[(\[]at[)\]]| at ).{0,200}?(?:dot|\.)")
    gates = {("email", True): at, ("email", False): written, ("ip", True): digit, ("card", True): digit, ("phone", True): F.contains("text", F.lit("+")), ("phone", False): digit}
    lists = [_found(k, p, strict, gates[k, strict]) for strict, patterns in ((True, STRICT), (False, LOOSE)) for k, p in patterns.items()]
    none = F.lit(None)
    head = F.array(F.struct(none.cast("int"), none.cast("boolean"), F.lit(0), F.lit(0), F.lit(0), none.cast("string"), none.cast("string"), none.cast("string"))).cast(_FOUND)
    flat = rows.select("_row", "doc_id", F.concat(head, *lists).alias("found")).select("_row", "doc_id", F.inline("found"))
    order = Window.partitionBy("_row", "kind", "strict").orderBy("at")
    end = F.sum(F.col("lead") + F.col("size")).over(order)
    return flat.withColumn("end", end).select("_row", "doc_id", "kind", "strict", (F.col("end") - F.col("size")).alias("start"), "end", "span", "before", "after")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn sum?"""
    total = F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _kind(name: str) -> Column:
    return F.col("kind") == KINDS.index(name)


def judged(spans: DataFrame) -> DataFrame:
    """Adds ``valid`` (a strict span that passes its kind's rule), ``label`` and the features f0 to f7, small integers."""
    digits = F.regexp_replace("span", "[^0-9]", "")
    n = F.length(digits)
    parts = F.split("span", r"\.")
    small = F.forall(parts, lambda p: F.length(F.ltrim(F.lit("0"), p)) <= 3) & F.forall(parts, lambda p: F.coalesce(F.when(F.length(F.ltrim(F.lit("0"), p)) <= 3, p), F.lit("999")).cast("decimal(38,0)") <= 255)
    card = F.when((n >= 16) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    phone = (n >= 8) & (n <= 15)
    rule = F.when(_kind("email"), F.lit(True)).when(_kind("ip"), small).when(_kind("card"), card).otherwise(phone)
    valid = F.col("strict") & rule
    label = valid | (~F.col("strict") & _kind("phone") & phone & F.col("before").endswith("+"))
    context = F.lit(False)
    for k in KINDS:
        context = F.when(_kind(k), F.col("before").rlike(CONTEXT[k])).otherwise(context)
    edge = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike(r"^[\s,;:()]$"), 1).when(c.rlike("^[.!?\"']$"), 2).otherwise(3)
    groups = F.size(F.split("span", "[^A-Za-z0-9]+"))
    first = F.length(F.regexp_extract("span", r"^\W*([A-Za-z0-9]+)", 1))
    ends = F.length(F.regexp_extract("span", r"([A-Za-z0-9]+)\W*$", 1))
    features = [
        F.when(n == 0, 0).when(n < 8, 1).when(n < 10, 2).when(n < 12, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        F.least(groups, F.lit(6)), F.least(first, F.lit(5)), F.least(ends, F.lit(5)),
        context.cast("int"), edge(F.regexp_replace(F.right("before", F.lit(1)), r"\+", "")), edge(F.col("after")),
        F.when(_kind("card"), F.when((n > 1) & (n < 40), luhn(digits)).otherwise(F.lit(False)).cast("int")).when(_kind("ip"), small.cast("int")).otherwise(F.col("span").rlike(r"[(\[]").cast("int")),
    ]
    # A loose number with too few or too many digits is no candidate.
    spans = spans.where(F.col("kind").isNull() | F.col("strict") | ~_kind("phone") | ((n >= 7) & (n <= 15)))
    return spans.select("*", F.coalesce(valid, F.lit(False)).alias("valid"), F.coalesce(label, F.lit(False)).alias("label"), *(F.coalesce(f, F.lit(0)).cast("int").alias(f"f{i}") for i, f in enumerate(features)))


FEATURES = [f"f{i}" for i in range(8)]


def fit(found: DataFrame, precision: float = PRECISION) -> dict[int, boosting.Model]:
    """A model of each kind from counts of feature cells over all texts; three texts of four fit, the others calibrate.

    At most 7 * 7 * 6 * 6 * 2 * 4 * 4 * 2 cells of a kind can come to the driver.
    """
    fold = (F.pmod(F.xxhash64("_row"), F.lit(4)) == 0).alias("back")
    cells = found.where(F.col("kind").isNotNull()).groupBy("kind", fold, *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label"), 1)).alias("y")).collect()
    out = {}
    for k in range(len(KINDS)):
        parts = {back: sorted((tuple(r[f] for f in FEATURES), r.n, r.y) for r in cells if r.kind == k and r.back == back) for back in (False, True)}
        model = boosting.fit(parts[False]) if parts[False] else boosting.Model(-60.0)
        out[k] = boosting.calibrate(model, parts[True] or parts[False], precision)
    return out


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and spans of every row of ``docs``.

    Counts and base_sha256 hold the spans that pass the strict rules; ``spans`` holds the added ones as well, as
    kind:start:end, code points, end exclusive. A null or empty text has none. Repeated rows each give
    their row, null ids stay null, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut_lineage(judged(candidates(rows)).drop("span", "before", "after"))
    models = fit(found, precision)
    columns = [F.col(f) for f in FEATURES]
    added = F.lit(False)
    for k, model in models.items():
        if model.threshold < 1:
            added = F.when(F.col("kind") == k, model.column(columns) >= model.threshold).otherwise(added)
    item = F.struct("kind", "start", "end", "valid")
    kept = found.withColumn("_kept", F.col("valid") | (added & ~F.col("label")))
    counts = [F.count(F.when(F.col("valid") & _kind(k), 1)).alias(f"n_{k}") for k in KINDS]
    by_text = kept.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), *counts, F.array_sort(F.collect_set(F.when(F.col("_kept"), item))).alias("_spans"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")
    return by_text.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.filter("_spans", lambda s: s.valid)), 256).alias("base_sha256"), joined("_spans").alias("spans"))
