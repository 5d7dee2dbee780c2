"""Order of events on a tree for every tested pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.protein import complementarity
from ..operators import tree as g
from ..session import cut_lineage

C = F.col


def annotate_timing(pairs: DataFrame, edges: DataFrame, states: DataFrame, observed: DataFrame,
                    low_changes: DataFrame | None = None) -> DataFrame:
    """Per pair: ancestral call, gain branches, timing counts, dominant class and mechanism.

    ``pairs``: (pair_id, tree, pos, ref, alt, contact_pos, contact_human, contact_alt). States and changes hold
    (tree, node, pos, aa). Derived variants without a gain in the high tier fall back to
    ``low_changes``; those without any keep ``no_origin`` as a skip reason.
    """
    clo = g.closure(edges)
    cs = cut_lineage(g.with_self(clo, edges))
    ch = cut_lineage(g.branch_changes(states, edges))
    roots = states.join(g.roots(edges).withColumnRenamed("root", "node"), ["tree", "node"], "left_semi").select("tree", "pos", "aa")
    node_states = cut_lineage(g.propagate_changes(cs, roots, ch))
    asked = pairs.select("tree", "pos", "alt").distinct()
    call = g.ancestral_call(asked, roots, observed)
    high = g.gains(ch, asked).withColumn("confidence", F.lit("high_confidence"))
    if low_changes is not None:
        low = g.gains(low_changes, asked).join(high.select("tree", "pos", "alt"), ["tree", "pos", "alt"], "left_anti")
        high = high.unionByName(low.withColumn("confidence", F.lit("low_confidence")))
    lost = g.losses(ch, asked).withColumn("confidence", F.lit("high_confidence"))
    key = ["tree", "pos", "alt"]
    events = high.join(call.where(~C("is_ancestral")), key, "left_semi").unionByName(lost.join(call.where("is_ancestral"), key, "left_semi"))
    # Pairs that ask the same share their branches and counts, so branches meet distinct questions, not pairs.
    question = [*key, "contact_pos", "contact_alt"]
    branches = pairs.select(*question).distinct().join(events, key)
    timed = g.timing_same_labels(branches, node_states, cs)
    counts = g.timing_counts(timed, [*question, "confidence"])
    same = [C(k) == C(f"_{k}") for k in key] + [C(k).eqNullSafe(C(f"_{k}")) for k in question[len(key):]]
    counts = counts.withColumnsRenamed({k: f"_{k}" for k in question})
    out = pairs.join(call, key, "left").join(counts, same, "left").drop(*[f"_{k}" for k in question])
    names = [f"n_{t}" for t in g.TIMINGS]
    out = out.fillna(0, names)
    direction = rules.directional_class("is_ancestral", *names)
    return out.withColumns({
        "direction": direction, "mechanism": complementarity("ref", "alt", "contact_human", "contact_alt"),
        "skip_reason": F.when(C("confidence").isNull() & ~C("is_ancestral"), "no_origin_in_tree").otherwise(""),
    })
