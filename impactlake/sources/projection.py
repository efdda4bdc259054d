"""The driver's tables seen as a code base: files, facts, links and tests.

Parts are source files, customers test files, orders tests; line items are what tests
call.  Ids are arithmetic on the tables' keys, so they are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the ids of test files, and of the facts of tests, parts and line items begin.
TEST_FILES, TEST_FACTS, CALL_FACTS = 1_000_000_000_000, 2_000_000_000_000, 3_000_000_000_000
#: More parts than any table has, so that a call has a number of its own.
PARTS = 1 << 28
FRAMEWORK_OF = {"AUTOMOBILE": "phpunit", "BUILDING": "jest", "FURNITURE": "playwright", "HOUSEHOLD": "qunit", "MACHINERY": "jest"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The table of parts, or some of its columns, dealt to all tasks: it is one small file, while what is made of each row takes time."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "part").select(*columns or "*").repartition(tasks, "p_partkey")


def source_files(part: DataFrame) -> DataFrame:
    ext = F.when(F.col("p_size") % 3 == 0, ".php").when(F.col("p_size") % 3 == 1, ".ts").otherwise(".js")
    path = F.concat(F.when(F.col("p_size") == 50, "vendor/").otherwise(""), F.lit("src/"), F.lower("p_type"), F.lit("/p"), F.col("p_partkey").cast("string"), ext)
    return part.select(F.col("p_partkey").alias("file_id"), path.alias("path"), F.lit(None).cast("string").alias("framework"), (F.col("p_size") == 50).alias("vendor"))


def test_files(customer: DataFrame) -> DataFrame:
    framework = F.element_at(F.create_map(*[F.lit(x) for kv in FRAMEWORK_OF.items() for x in kv]), F.col("c_mktsegment"))
    path = F.concat(F.lit("tests/"), F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".test.ts"))
    return customer.select((F.col("c_custkey") + TEST_FILES).alias("file_id"), path.alias("path"), framework.alias("framework"), F.lit(False).alias("vendor"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(table(spark, sf_dir, "part")).union(test_files(table(spark, sf_dir, "customer")))


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test_id, file_id, framework, framework_class, fact_id)."""
    f = test_files(table(spark, sf_dir, "customer"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + TEST_FILES).alias("file_id"))
    kind = F.when(F.col("framework") == "playwright", "e2e").otherwise("unit")
    return o.join(f, "file_id").select(F.concat("framework", F.lit(":"), "path", F.lit("::o"), F.col("o_orderkey").cast("string")).alias("test_id"), "file_id", "framework", kind.alias("framework_class"), (F.col("o_orderkey") + TEST_FACTS).alias("fact_id"))


def calls(spark: SparkSession, sf_dir: str, by: str = "l_orderkey") -> DataFrame:
    """One row for each distinct (order, line, part, flag, status): what a test calls.

    Rows are dealt by the one column ``by``, so what is counted or joined by it next needs no other shuffle.
    """
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").repartition(by).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def facts_and_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts and links for the walk: each test imports the parts of its order, parts call on through hooks, routes and symbols."""
    none = lambda kind: F.lit(None).cast(kind)
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    src = source_files(p).select("file_id", "path")
    called = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part")).distinct()
    line = (F.col("o_orderkey") * 10).cast("int")

    def row(df, fact_id, file_id, kind, at, until=None, **given):
        types = {"resolved": "boolean", "name": "string", "callable": "boolean", "resolved_path": "string", "type_only": "boolean", "mocked": "boolean", "dynamic": "boolean", "hook": "string", "target": "string", "resolved_by": "string", "scopes": "array<struct<start_line:int,end_line:int>>"}
        cols = {c: (given.get(c) if given.get(c) is not None else (F.lit(True) if c == "resolved" else none(t))).cast(t).alias(c) for c, t in types.items()}
        return df.select(fact_id.cast("long").alias("fact_id"), file_id.cast("long").alias("file_id"), F.lit(kind).alias("kind"), at.cast("int").alias("start_line"), (at if until is None else until).cast("int").alias("end_line"), *cols.values())

    test_file = F.col("o_custkey") + TEST_FILES
    defs = row(o, F.col("o_orderkey") + TEST_FACTS, test_file, "test-def", line, line + 8)
    seen = o.join(called, "o_orderkey").join(src.withColumnRenamed("file_id", "part"), "part")
    imports = row(seen, F.col("o_orderkey") * PARTS + F.col("part") + CALL_FACTS, test_file, "import-edge", line + 1, resolved_path=F.col("path"))
    group = F.col("p_partkey") % 97
    fires = row(p, F.col("p_partkey") * 8 + 1, F.col("p_partkey"), "hook-fire", F.lit(2), hook=F.concat(F.lit("s_"), group.cast("string")), resolved=F.col("p_size") % 5 != 0)
    listens = row(p.filter("p_partkey % 11 = 0"), F.col("p_partkey") * 8 + 2, F.col("p_partkey"), "hook-listener", F.lit(3))
    uses = row(p.filter("p_partkey % 2 = 0"), F.col("p_partkey") * 8 + 3, F.col("p_partkey"), "symbol-use", F.lit(4))
    symbols = row(p, F.col("p_partkey") * 8 + 4, F.col("p_partkey"), "symbol-def", F.lit(10), F.lit(20), callable=F.col("p_size") % 3 == 0, name=F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    facts = defs.union(imports).union(fires).union(listens).union(uses).union(symbols)
    link = lambda df, i, key, role: df.select((F.col("p_partkey") * 8 + i).alias("fact_id"), key.alias("key"), F.lit(role).alias("role"))
    name = lambda c: F.concat(F.lit("php-symbol:P"), c.cast("string"))
    links = (
        link(p, 1, F.concat(F.lit("hook:s_"), group.cast("string")), "target")
        .union(link(p.filter("p_partkey % 11 = 0"), 2, F.when(F.col("p_partkey") % 77 == 0, F.concat(F.lit("hook:s_"), F.floor(group / 10).cast("string"), F.lit("{*}"))).otherwise(F.concat(F.lit("hook:s_"), group.cast("string"))), "subject"))
        .union(link(p.filter("p_partkey % 2 = 0"), 3, name(F.expr("p_partkey div 2")), "subject"))
        .union(link(p, 4, name(F.col("p_partkey")), "target"))
    )
    return facts, links
