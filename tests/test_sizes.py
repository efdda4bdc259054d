"""Queries over tables with hard keys and of a size that estimates get wrong."""

from impactlake.plans import catalogue

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def parts(spark, folder, rows):
    spark.createDataFrame(rows, PART).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_a_part_numbered_0_has_a_file_of_its_own(spark, tmp_path):
    folder = parts(spark, tmp_path, [(0, "n", "B", "STEEL", 4), (1, "n", "B", "TIN", 1), (2, "n", "B", "TIN", None), (4, "n", "B", "TIN", 8)])
    got = sorted(map(tuple, catalogue.queries()["file_facts_replaced"](spark, folder).collect()))
    assert got == [(0, 0, "core"), (1, 0, "TIN"), (2, 0, "TIN"), (4, 4, "core")]


def test_no_table_goes_through_the_driver_on_an_estimate(spark, tmp_path):
    import __spark_entry__

    folder, before = parts(spark, tmp_path, [(i, "n", "B", "TIN", i % 50) for i in range(20)]), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    queries = __spark_entry__.queries()
    rows = queries["js_symbols"](spark, folder)
    assert "Broadcast" not in rows._jdf.queryExecution().sparkPlan().toString() and rows.count() == 20 * 12
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    queries["op3_pii"](spark, folder)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_texts_are_read_once_and_by_all_tasks(spark, tmp_path):
    import __spark_entry__

    folder = parts(spark, tmp_path, [(i, "n", "B", "TIN", i % 50) for i in range(400)])
    plan = __spark_entry__.queries()["php_facts"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert __spark_entry__.queries()["route_params"](spark, folder).rdd.getNumPartitions() >= 8


def test_objects_of_a_handle_meet_its_scripts_once(spark):
    from impactlake.operators.resolvers import localized_globals

    links = spark.createDataFrame([(n, key, role) for n in range(30) for key, role in (("script-handle:h", "subject"), ("js-module:a.js", "target"))], "fact_id long, key string, role string")
    rows = localized_globals(links, spark.createDataFrame([("h", "O", "v")] * 50, "handle string, object string, value string"))
    assert [tuple(r) for r in rows.collect()] == [("a.js", "O", "v")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 3


def test_only_facts_that_name_files_are_joined_with_modules(spark):
    from impactlake.extract import build as B

    texts = spark.createDataFrame([("a.php", "<?php use A\\B; new B(); f();", "php", None), ("b.ts", "import { x } from './c'; x(); x()", "ts", None), ("c.ts", "export let x = 1", "ts", None)], "path string, text string, language string, framework string")
    raw = B.raw_facts(texts, kinds=["symbol-use"])
    assert {r.kind for r in raw.collect()} == {"symbol-use"}
    rows = B.with_modules(raw, B.resolved_modules(B.raw_facts(texts).selectExpr("path", "get_json_object(payload, '$.specifier') specifier").filter("specifier is not null"), texts))
    assert sorted((r.path, r.anchors[0].key) for r in rows.collect()) == [("a.php", "php-symbol:A\\B"), ("a.php", "php-symbol:f"), ("b.ts", "js-symbol:c.ts:x")]
    # facts of files without modules take a branch that has no exchange
    plan = rows._jdf.queryExecution().sparkPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().apply(1).toString() and "Window" not in plan.children().apply(1).toString()


def test_units_of_one_id_are_dealt_by_their_path_too(spark):
    from impactlake.operators import report as R

    said = '{"unresolved": {"exprHash": "h", "scope": "(file)", "fields": [{"expression": "$b"}]}}'
    facts = spark.createDataFrame([(0, f"f{i:03}", "hook-fire", False, 1, 1, said) for i in range(200)], "fact_id int, file_id string, kind string, resolved boolean, start_line int, end_line int, payload string")
    files = facts.selectExpr("file_id", "concat(file_id, '.php') path", "'x' text")
    rows = R.units(facts, files, spark.createDataFrame([("none",)], "expr_hash string"))
    assert [r.path for r in rows.collect()] == [f"f{i:03}.php" for i in range(200)]
    assert "path" in rows._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string"


def test_shuffles_have_parts_in_proportion_to_the_tables(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from impactlake.plans import session

    folder = parts(spark, tmp_path, [(i, "n", "B", "TIN", i % 50) for i in range(400)])
    monkeypatch.setattr(session, "PARTS_OF", 50)
    assert session.stored_bytes(spark, folder) > 1000 and session.stored_bytes(spark, folder + "/none") == 0
    __spark_entry__.queries()["route_params"](spark, folder)
    assert int(spark.conf.get(session.INITIAL)) >= session.stored_bytes(spark, folder) / 50 > 8
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    __spark_entry__.queries()["op3_pii"](spark, folder)
    assert spark.conf.get(session.INITIAL, None) is None


def test_calls_are_dealt_once_for_the_first_value_of_each(spark, tmp_path):
    spark.createDataFrame([(1, 2, 5, "A", "F"), (1, 1, 5, "A", "F"), (1, 1, 5, "A", "F"), (2, 1, 5, "N", "O")], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalogue.queries()["evidence_first_value"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, rows.collect())) == [(1, "symbol-call", 5, round(0.9 * 0.92, 6)), (2, "hook-mediated-uncertain", 5, round(0.4 * 0.92, 6))]


def test_edges_are_counted_where_their_calls_are(spark):
    from impactlake.plans import session

    session.measured_joins(spark)
    plan = catalogue.edge_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    session.measured_joins(spark, False)
    assert "SortMergeJoin" in plan and "hashpartitioning(test_id" not in plan
