import duckdb
import pytest

import __spark_entry__
from lakevec import queries
from lakevec.errors import NotFound, Validation
from lakevec.operators import dml
from lakevec.plans import pivot as pv
from lakevec.plans import sql
from lakevec.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(queries.ORACLE_SQL[name])
    assert canonical(got.columns, rows) == canonical(want.columns, want.fetchall())


def test_pivot_inputs(spark, sf_dir):
    assert pv.name_list(" a, b,a ,") == ["a", "b"] and pv.name_list(None) == []
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for args in (([], "n_orders"), ("nope", "n_orders"), ("status", "nope"), ("status", "n_orders", "status")):
        with pytest.raises(Validation):
            pv.pivot(orders, queries.MODEL, *args)
    assert pv.inferred(["status", "year", "_g_status", "n_orders"], queries.MODEL) == (["status", "year"], "n_orders") and pv.inferred(["status"], queries.MODEL) is None
    text = pv.render(pv.pivot(orders, queries.MODEL, "status,priority", "n_orders"), ["status", "priority"])
    assert text[0][0] == "TOTAL" and text[1][1] == "" and sum(int(r[2].replace(",", "")) for r in text[1:] if r[1]) == orders.count()


def test_subtotals_are_not_data_nulls(spark):
    model = pv.Model.of([pv.Dimension(c, lambda c=c: pv.F.col(f"raw_{c}")) for c in "ab"], [pv.Measure("n", lambda: pv.F.count("*"))])
    fact = spark.createDataFrame([(None, "x"), (None, None), ("p", "x")], "raw_a string, raw_b string")
    got = {(r.a, r.b, r._g_a, r._g_b): r.n for r in pv.pivot(fact, model, "a,b", "n").collect()}
    assert got == {(None, None, 1, 1): 3, (None, None, 0, 1): 2, (None, None, 0, 0): 1, (None, "x", 0, 0): 1, ("p", None, 0, 1): 1, ("p", "x", 0, 0): 1}


def test_only_reads(spark):
    assert sql.run_sql(spark, "-- a\n(SELECT 1 AS x)").first().x == 1
    for bad in ("DROP TABLE x", "insert into t values (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "set x=1", "", "cache table x"):
        with pytest.raises(Validation):
            sql.run_sql(spark, bad)


def test_no_text_changes_a_table(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS lakevec_kept (a INT) USING parquet")
    try:
        for bad in (
            "WITH s AS (SELECT 2 a) INSERT/**/ INTO lakevec_kept SELECT * FROM s", "FROM (SELECT 3 a) INSERT/* */INTO lakevec_kept SELECT a", "EXECUTE IMMEDIATE 'INSERT INTO lakevec_kept VALUES (1)'",
            "BEGIN INSERT INTO lakevec_kept VALUES (1); END", "CREATE TABLE lakevec_other AS SELECT 1", "MERGE INTO lakevec_kept USING (SELECT 1 b) ON a = b WHEN MATCHED THEN DELETE", "SELECT reflect('java.lang.System', 'gc')", "not sql",
        ):
            with pytest.raises(Validation):
                sql.run_sql(spark, bad)
        assert spark.table("lakevec_kept").count() == 0
        for good in ("FROM lakevec_kept |> SELECT a", "DESCRIBE lakevec_kept", "SHOW TABLES", "SELECT 'insert into x' AS y, 'reflect(1)' AS z", "VALUES (1)", "WITH RECURSIVE r AS (SELECT 1 n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r"):
            sql.run_sql(spark, good).collect()
    finally:
        spark.sql("DROP TABLE lakevec_kept")


def test_no_java_method_is_called(spark):
    call = "('java.lang.System', 'setProperty', 'lakevec.reached', '1')"
    spark.sql(f"CREATE OR REPLACE TEMP VIEW lakevec_hidden AS SELECT reflect{call} AS x")
    for bad in (
        f"SELECT `reflect`{call}", f"SELECT reflect/**/{call}", f"SELECT reflect \n {call}", f"SELECT ReFlEcT{call}", f"SELECT `java_method`{call}", f"SELECT try_reflect{call}", f"SELECT system.builtin.reflect{call}", f"SELECT `system`.`builtin`.`reflect`{call}",
        f"SELECT 1 WHERE 'x' IN (SELECT `reflect`{call})", f"WITH a AS (SELECT `reflect`{call} AS x) SELECT * FROM a", f"SELECT transform(array(1), y -> `reflect`{call})", f"SELECT * FROM explode(array(`reflect`{call}))", f"SELECT 1 ORDER BY `reflect`{call}",
        f"SELECT count(*) FILTER (WHERE `reflect`{call} = '1')", f"SELECT * FROM VALUES (`reflect`{call})", "SELECT * FROM lakevec_hidden", f"SELECT (SELECT max(`reflect`{call}))", f"SELECT * FROM (SELECT 1 x) JOIN (SELECT 1 y) ON `reflect`{call} = '1'",
    ):
        with pytest.raises(Validation, match="Java methods"):
            sql.run_sql(spark, bad)
    assert spark._jvm.java.lang.System.getProperty("lakevec.reached") is None
    for good in ("SELECT 'reflect(1)' AS reflect", "SELECT reflect FROM (SELECT 1 AS reflect)", "SELECT transform(array(1, 2), x -> x + 1)", "SELECT (SELECT max(id) FROM range(3)) AS m", "SELECT explode(array(1)) -- reflect('a')"):
        sql.run_sql(spark, good).collect()


def test_headings_of_two_columns_never_collide(spark):
    model = pv.Model.of([pv.Dimension(c, lambda c=c: pv.F.col(f"raw_{c}")) for c in "abr"], [pv.Measure("n", lambda: pv.F.count("*"))])
    fact = spark.createDataFrame([("a_b", "c", "x"), ("a", "b_c", "x"), ("a", "b_c", "x"), ("a", "c", "y")], "raw_a string, raw_b string, raw_r string")
    got = pv.pivot(fact, model, "r", "n", "a,b", rollup=False)
    row = {r.r: r.asDict() for r in got.collect()}
    assert row["x"]["a_b__c"] == 2 and row["x"]["a__b_c"] == 1 and row["y"]["a_c"] == 1
    assert pv.headings([("r",), ("R",), ("x",)], {"r"}) == ["r_2", "R_3", "x"] and pv.headings([("a_", "b"), ("a", "_b")], set()) == ["a___b", "a___b_2"]


def test_rows_that_a_joined_key_confuses_are_merged(spark):
    target, source = (spark.createDataFrame(rows, "x string, y string") for rows in ([("a|b", "c"), ("n", None)], [("a", "b|c"), ("a|b", "c"), ("n", None), (None, "n")]))
    got = {tuple(r) for r in dml.new_rows(target, source, ["x", "y"]).collect()}
    assert got == {("a", "b|c"), (None, "n")} and dml.new_rows(target, source, ["x", "y"], hashed=True).count() == 0
    assert dml.merge_insert(target, target, ["x", "y"]).count() == 2 and dml.new_rows(target.limit(0), source, ["x"]).count() == 4


def test_csv_under_a_declared_schema(spark, tmp_path):
    path = tmp_path / "z.csv"
    path.write_text('LocationID,Borough,"Zone"\n1,EWR,"Newark, ""A"""\nx,Queens,\n3,,Two\n')
    fields = [{"name": n, "type": t} for n, t in (("locationid", "int"), ("zone", "string"), ("borough", "string"), ("service", "string"))]
    assert [tuple(r) for r in tables.read_csv(spark, str(path), fields).collect()] == [(1, 'Newark, "A"', "EWR", None), (None, None, "Queens", None), (3, "Two", None, None)]
    assert tables.read_csv(spark, f"{tmp_path}/none.csv", fields, optional=True).columns == ["locationid", "zone", "borough", "service"]
    with pytest.raises(NotFound):
        tables.read_csv(spark, f"{tmp_path}/none.csv", fields)
    grown = tables.insert_csv(spark.createDataFrame([(9, "own")], "locationid int, zone string"), str(path), fields[:2])
    assert grown.count() == 4 and grown.columns == ["locationid", "zone"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
