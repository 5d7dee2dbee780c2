"""Registered queries against their SQL on the smallest tables; tests/compare.py runs them all."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PICK = ["q00_contingency_fdr", "p02_variant_flags", "p27_frame_consequence", "j02_locus_by_position", "j07_anchor_search_ascending", "j11_spatial_contacts", "a14_contingency_alt", "a23_compartment_summary",
        "w01_bh_fdr", "w04_rank_all", "u04_species_sets", "m02_position_map", "m07_mutual_information", "m12_effective_count", "t05_mann_whitney", "g07_propagate_changes", "g15_prune_tree", "s04_read_fasta",
        "q01_curate", "q02_classify", "q07_prioritise"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", PICK)
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 190
