"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from mdcorpus.plans.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


NAMES = (
    "classify split_frontmatter documents merged_frontmatter bundles tag_filter score find_best_vocab get_doc get_doc_status validate_bundle validate_paths summary gate report_lines tree subtree tree_json subtrees "
    "log_entries log_entries_by_block log_checks_by_block log_notes get_log_since get_log_action get_log_limit get_log_root_limit read_tree doctree_source json_docs json_log json_tags json_validation json_logs json_answers catalog_tables catalog_get_doc catalog_summary"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = queries()[name](spark, DATA)
    want = con.execute(oracle_sql()[name])
    order = [got.columns.index(c[0]) for c in want.description]
    assert sorted((tuple(r[i] for i in order) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
