"""The stored catalog: what it answers, and that its tables join where they lie."""

import pytest

from mdcorpus.operators import catalog, classify, search, tree, validate
from mdcorpus.schemas import FILES, QUERIES
from mdcorpus.sources.stored import KEYS, StoredCatalog, bodies_of, severities_of
from tests.test_catalog import GARDEN


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    files = spark.createDataFrame(GARDEN, FILES).repartition(3)
    parsed = classify.parse(files).cache()
    reserved = catalog.reserved_files(parsed)
    docs, found = catalog.resolve_bundles(classify.documents(parsed), reserved), validate.validate_bundle(parsed)
    reserved = catalog.resolve_bundles(reserved, reserved)
    tables = {"docs": docs, "bodies": bodies_of(parsed), "reserved": reserved, "tree": tree.build_tree(docs, reserved), "findings": found.withColumnRenamed("file", "path"), "checked": validate.bundle_files(parsed, files), "severities": severities_of(found)}
    path = str(tmp_path_factory.mktemp("catalog") / "it's here")
    return files, tables, StoredCatalog.write(tables, path, buckets=4)


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def test_tables_come_back_whole(spark, stored):
    _, tables, held = stored
    for name, df in tables.items():
        assert rows(held[name]) == rows(df), name
    again = spark.newSession()  # knows no table
    opened = StoredCatalog(again, held.path)
    assert sorted(opened.names) == sorted(tables) and rows(opened["docs"]) == rows(tables["docs"])


def test_answers_equal_those_from_files(spark, stored):
    files, tables, held = stored
    asked = spark.createDataFrame([(1, "garden", "compost", None, None), (2, "garden", "iron", ["iron"], "or"), (3, "garden", "", None, None), (4, "desert", "x", None, None), (5, "garden", "zzz", None, "and"), (6, "garden", "x", None, "xor")], QUERIES)
    assert rows(held.get_doc(asked)) == rows(search.get_doc(files, tables["docs"], asked)) == rows(held.get_doc(asked, "vocab"))
    assert rows(held.summary()) == rows(validate.summarise(tables["findings"].withColumnRenamed("path", "file"), tables["checked"]))
    assert {(r.path, r.description) for r in held.tree().collect() if r.description} == {(r.path, r.description) for r in tables["docs"].collect() if r.description}


def exchanges_over(plan, table):
    """Exchanges in a plan below which the table is scanned."""
    found, lines = [], plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if "Exchange" in line and "Reused" not in line:
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            found += [line] * any(table in x and "Scan" in x for x in below)
    return found


def test_stored_tables_are_not_moved(spark, stored):
    _, _, held = stored
    asked = spark.createDataFrame([(1, "garden", "compost", None, None)], QUERIES)
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan(held.summary()) and "Exchange" not in plan(held.summary())
        assert "SortMergeJoin" in plan(held.tree()) and "Exchange" not in plan(held.tree())
        pair = held["docs"].join(held["bodies"], ["root", "path"])
        assert "SortMergeJoin" in plan(pair) and "Exchange" not in plan(pair)
        answer = plan(held.get_doc(asked))
        moved = exchanges_over(answer, "_bodies")  # what was joined goes to its query, and nothing else moves
        assert "_bodies" in answer and len(moved) == 1 and "hashpartitioning(query_id" in moved[0]
        assert set(KEYS) >= set(held.names)
    finally:
        for k in own:
            spark.conf.unset(k)


def test_nothing_to_write():
    with pytest.raises(ValueError):
        StoredCatalog.write({}, "/tmp/none")
