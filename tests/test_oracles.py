"""Registered queries against their DuckDB twins on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lociflow.plans import callset_queries, genome_queries, registry, scalar_queries, signal_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
#: One query or two of each group; the driver runs all of them.
CHOSEN = [
    "cigar_ops", "aligned_blocks", "best_position", "get_indels", "svtype_infer", "agg_depth", "sig_union_1d", "sig_union_2d", "join_mates", "win_offset_clip", "gw_clipped14",
    "gw_coverage5", "gw_split_pairs", "lab_decide", "lab_uncovered", "flt_regions_keep", "pr_curve", "dedup_callset", "union_callsets", "ds_genomic_bins", "ds_lobso", "met_average_precision", "src_reads", "snk_bedpe_to_vcf",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = [["" if pd.isna(v) else repr(round(float(v), 6)) if not isinstance(v, (str, bool)) else str(v) for v in r] for r in frame.itertuples(index=False)]
    return sorted(frame.columns), sorted(text)


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())


def test_entry_has_sorted_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
