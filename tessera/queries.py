"""Queries over the driver's tables, each as text of the dialect and as DuckDB SQL for comparison."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FLAGSHIP = "SELECT o_orderkey, o_totalprice, c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20"

#: Name: the dialect's text, DuckDB's text (the same one if None), how joins are made.
SQL: dict[str, tuple[str, str | None, str]] = {}


def q(name: str, ours: str, duck: str | None = None, strategy: str = "auto") -> None:
    SQL[name] = (ours, duck, strategy)


q("flagship", FLAGSHIP)
# scan, projection, filter
q("scan_region", "SELECT * FROM region")
q("project_expr", "SELECT c_custkey, c_acctbal * 2 AS doubled, c_custkey + 1 AS next_key FROM customer")
q("select_const", "SELECT 1 AS one, 'x' AS x, TRUE AS yes, 1.5 AS half", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x, TRUE AS yes, CAST(1.5 AS DOUBLE) AS half")
q("wildcard_join", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
q("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount <> 0.05 AND l_tax < 0.04")
q("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT o_orderpriority = '5-LOW'")
q("filter_null_3vl", "SELECT c_custkey FROM customer WHERE CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END > 10")
q("filter_true_only", "SELECT n_name FROM nation WHERE NULL", "SELECT n_name FROM nation WHERE NULL::BOOLEAN")
q("scan_key_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 250")
q("point_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
# predicates
q("pred_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_brand LIKE 'Brand#_2'")
q("pred_not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%STEEL'")
q("pred_in", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3, NULL)")
q("pred_not_in", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 3)")
q("pred_not_in_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, NULL)")
q("pred_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15")
q("pred_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45")
q("pred_is_null", "SELECT c_custkey, NULLIF(c_nationkey, 5) AS k FROM customer WHERE NULLIF(c_nationkey, 5) IS NULL")
q("pred_is_not_null", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 5) IS NOT NULL")
q("pred_cross_type_eq", "SELECT n_nationkey, n_name = 1 AS same, n_name <> 1 AS other FROM nation", "SELECT n_nationkey, FALSE AS same, TRUE AS other FROM nation")
# order, limit
q("order_multi_key", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name")
q("order_nulls_default", "SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer ORDER BY NULLIF(c_nationkey, 3) DESC, c_custkey LIMIT 40", "SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer ORDER BY NULLIF(c_nationkey, 3) DESC NULLS FIRST, c_custkey LIMIT 40")
q("order_nulls_explicit", "SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer ORDER BY NULLIF(c_nationkey, 3) ASC NULLS FIRST, c_custkey LIMIT 40")
q("order_by_expr", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice * -1.0, p_partkey LIMIT 25")
q("order_by_unselected", "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
q("topk", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
q("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40")
q("limit_key_order", "SELECT o_orderkey FROM orders LIMIT 15 OFFSET 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 5")
q("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
q("limit_const_expr", "SELECT n_nationkey FROM nation LIMIT 2 + 3", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5")
# joins
q("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey")
q("join_left", "SELECT n.n_name, s.s_name FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0.0")
q("join_right", "SELECT s.s_name, n.n_name FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey")
q("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 3")
q("join_null_keys", "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON NULLIF(n.n_regionkey, 2) = r.r_regionkey")
q("join_cross", "SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b")
q("join_comma_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
q("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
q("join_theta_left", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a LEFT JOIN region b ON a.r_regionkey > b.r_regionkey + 2")
q("join_multiway", "SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND l_quantity > 40.0")
q("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
HINTED = "SELECT o.o_orderkey, c.c_name FROM orders o {} JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000.0"
q("join_hint_merge", HINTED.format("INNER"), strategy="merge")
q("join_hint_merge_full", HINTED.format("FULL"), strategy="merge")
q("join_hint_hash", HINTED.format("LEFT"), strategy="hash")
q("join_hint_hash_full", HINTED.format("FULL"), strategy="hash")
q("join_hint_bnl", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", strategy="nested_loop")
# arithmetic
q("arith_int_trunc_div", "SELECT c_custkey, (c_custkey - 50) / 7 AS d FROM customer", "SELECT c_custkey, CAST(trunc((c_custkey - 50) / 7) AS BIGINT) AS d FROM customer")
q("arith_mod", "SELECT c_custkey, (c_custkey - 50) % 7 AS m FROM customer")
q("arith_widen", "SELECT n_nationkey, n_nationkey + n_regionkey AS s, n_nationkey * 100000000000 AS m FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) + n_regionkey AS s, CAST(n_nationkey AS BIGINT) * 100000000000 AS m FROM nation")
q("arith_float", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
q("arith_decimal", "SELECT s_suppkey, CAST(CAST(s_suppkey AS NUMERIC) + NUMERIC '0.10' AS TEXT) AS t FROM supplier", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || '.1' AS t FROM supplier")
q("arith_negate", "SELECT s_suppkey, -s_acctbal AS neg, -s_suppkey AS k FROM supplier")
q("arith_decimal_product", "SELECT p_partkey, CAST(NUMERIC '0.0000001' * CAST(p_partkey AS NUMERIC) * NUMERIC '1.5' AS TEXT) AS t, NUMERIC '12345678901.5' * NUMERIC '-3.25' = NUMERIC '-40123456429.875' AS big FROM part", "SELECT p_partkey, rtrim(rtrim(CAST(CAST(p_partkey AS DECIMAL(18,0)) * 0.00000015 AS VARCHAR), '0'), '.') AS t, TRUE AS big FROM part")
q("arith_decimal_quotient", "SELECT r_regionkey, CAST(NUMERIC '1' / NUMERIC '3' AS TEXT) AS a, CAST(NUMERIC '-2' / NUMERIC '3' AS TEXT) AS b, CAST(NUMERIC '7.5' / NUMERIC '0.0025' AS TEXT) AS c, CAST(NUMERIC '7.5' % NUMERIC '2' AS TEXT) AS d FROM region", "SELECT r_regionkey, '0.333333333333333333' AS a, '-0.666666666666666667' AS b, '3000' AS c, '1.5' AS d FROM region")
# functions
q("fn_abs", "SELECT c_custkey, ABS(c_acctbal) AS a, ABS(c_nationkey - 10) AS b FROM customer", "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(ABS(c_nationkey - 10) AS BIGINT) AS b FROM customer")
q("fn_round", "SELECT p_partkey, ROUND(p_retailprice) AS r, ROUND(p_size) AS s FROM part", "SELECT p_partkey, round(p_retailprice) AS r, p_size AS s FROM part")
q("fn_ceil_floor", "SELECT p_partkey, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, CEILING(p_size) AS s FROM part", "SELECT p_partkey, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, p_size AS s FROM part")
q("fn_coalesce", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS k FROM customer", "SELECT c_custkey, CAST(COALESCE(NULLIF(c_nationkey, 3), -1) AS BIGINT) AS k FROM customer")
q("fn_nullif", "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer")
q("fn_greatest_least", "SELECT c_custkey, GREATEST(c_custkey, c_nationkey, NULL) AS g, LEAST(c_custkey, c_nationkey) AS l, MAX(c_custkey, 50) AS m, MIN(c_custkey, 50) AS n FROM customer", "SELECT c_custkey, GREATEST(c_custkey, c_nationkey) AS g, LEAST(c_custkey, c_nationkey) AS l, GREATEST(c_custkey, 50) AS m, LEAST(c_custkey, 50) AS n FROM customer")
q("fn_concat", "SELECT n_nationkey, CONCAT(n_name, NULL, '-', n_regionkey, TRUE) AS c FROM nation", "SELECT n_nationkey, n_name || '-' || n_regionkey || 't' AS c FROM nation")
q("op_concat", "SELECT n_nationkey, n_name || '/' || n_regionkey AS c, n_name || NULL AS none FROM nation", "SELECT n_nationkey, n_name || '/' || n_regionkey AS c, CAST(NULL AS VARCHAR) AS none FROM nation")
q("fn_length", "SELECT p_partkey, LENGTH(p_name) AS a, CHAR_LENGTH(p_brand) AS b, CHARACTER_LENGTH('héé') AS c FROM part", "SELECT p_partkey, length(p_name) AS a, length(p_brand) AS b, CAST(3 AS BIGINT) AS c FROM part")
q("fn_repeat", "SELECT n_nationkey, REPEAT('ab', n_nationkey - 20) AS r FROM nation", "SELECT n_nationkey, repeat('ab', greatest(n_nationkey - 20, 0)) AS r FROM nation")
q("fn_upper_lower", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, UCASE('é') AS e, LCASE('É') AS f FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, 'É' AS e, 'é' AS f FROM part")
q("fn_substring", "SELECT n_nationkey, SUBSTRING(n_name FROM 2 FOR 3) AS a, SUBSTRING(n_name, 0, 3) AS b, SUBSTRING(n_name, -2, 4) AS c, SUBSTRING(n_name FROM 4) AS d FROM nation", "SELECT n_nationkey, substring(n_name, 2, 3) AS a, substring(n_name, 1, 2) AS b, substring(n_name, 1, 1) AS c, substring(n_name, 4) AS d FROM nation")
q("fn_trim", "SELECT n_nationkey, TRIM(BOTH 'AI' FROM n_name) AS b, TRIM(LEADING 'AI' FROM n_name) AS l, TRIM(TRAILING 'AI' FROM n_name) AS t, TRIM('  x ') AS x FROM nation", "SELECT n_nationkey, trim(n_name, 'AI') AS b, ltrim(n_name, 'AI') AS l, rtrim(n_name, 'AI') AS t, 'x' AS x FROM nation")
q("case_searched", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 40.0 THEN 'big' WHEN l_quantity > 20.0 THEN 'mid' ELSE 'small' END AS size FROM lineitem")
q("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS s FROM orders")
# casts
q("cast_text_int", "SELECT n_nationkey, CAST('  42 ' AS INT) + n_nationkey AS v, CAST(CAST(n_nationkey AS TEXT) AS SMALLINT) AS s FROM nation", "SELECT n_nationkey, CAST(42 AS BIGINT) + n_nationkey AS v, CAST(n_nationkey AS SMALLINT) AS s FROM nation")
q("cast_text_any_space", "SELECT n_nationkey, CAST('\t42\n' AS INT) AS i, CAST('\n 2.5\t' AS DOUBLE) AS d, CAST('\ttrue ' AS BOOL) AS b, CAST('\t2024-02-29\n' AS DATE) AS day FROM nation", "SELECT n_nationkey, 42 AS i, CAST(2.5 AS DOUBLE) AS d, TRUE AS b, DATE '2024-02-29' AS day FROM nation")
q("cast_text_float", "SELECT n_nationkey, CAST(n_nationkey || '.25' AS DOUBLE) AS d, CAST(n_nationkey || '.5' AS REAL) AS r, CAST('1e3' AS DOUBLE) AS e FROM nation", "SELECT n_nationkey, n_nationkey + CAST(0.25 AS DOUBLE) AS d, CAST(n_nationkey + 0.5 AS FLOAT) AS r, CAST(1000 AS DOUBLE) AS e FROM nation")
q("cast_float_int_round", "SELECT c_custkey, c_acctbal::INT AS i, CAST(c_acctbal AS BIGINT) AS b FROM customer", "SELECT c_custkey, CAST(round(c_acctbal) AS INTEGER) AS i, CAST(round(c_acctbal) AS BIGINT) AS b FROM customer")
q("cast_bool_text", "SELECT c_custkey, (c_acctbal > 0.0)::TEXT AS t, CAST('Yes' AS BOOLEAN) AS y, CAST(' off ' AS BOOL) AS n, c_nationkey::BOOL AS k FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 't' ELSE 'f' END AS t, TRUE AS y, FALSE AS n, c_nationkey <> 0 AS k FROM customer")
q("cast_float_text", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::TEXT AS t FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS t FROM lineitem")
q("cast_text_date", "SELECT n_nationkey, CAST('2024-02-29' AS DATE) AS d FROM nation")
q("cast_ts_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
q("cast_bytes_hex", "SELECT n_nationkey, CAST(CAST(n_name AS BYTEA) AS TEXT) AS h FROM nation", "SELECT n_nationkey, '\\x' || lower(hex(n_name)) AS h FROM nation")
# types
q("array_eq_filter", "SELECT n_nationkey FROM nation WHERE ARRAY[n_regionkey, 1] = ARRAY[2, 1]", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
q("array_order", "SELECT n_nationkey, ARRAY[n_regionkey, n_nationkey] < ARRAY[2, 10] AS lt FROM nation", "SELECT n_nationkey, n_regionkey < 2 OR n_regionkey = 2 AND n_nationkey < 10 AS lt FROM nation")
q("array_text", "SELECT n_nationkey, ARRAY[n_name, 'x']::TEXT AS t FROM nation", "SELECT n_nationkey, '{' || n_name || ',x}' AS t FROM nation")
q("interval_order", "SELECT n_nationkey, INTERVAL '1 mon' = INTERVAL '30 days' AS same, INTERVAL '1 day' < INTERVAL '25 hours' AS less, INTERVAL '90 minutes'::TEXT AS t FROM nation", "SELECT n_nationkey, TRUE AS same, TRUE AS less, '01:30:00' AS t FROM nation")
q("uuid_normalize", "SELECT r_regionkey, CAST('FFFFFFFF-0000-0000-0000-00000000000' || r_regionkey AS UUID)::TEXT AS u FROM region", "SELECT r_regionkey, 'ffffffff-0000-0000-0000-00000000000' || r_regionkey AS u FROM region")
q("json_roundtrip", "SELECT event_id, CAST(CAST(props AS JSON) AS TEXT) AS j, CAST(props AS JSON) = CAST('{\"k\": 7}' AS JSON) AS same FROM events", "SELECT event_id, replace(props, ' ', '') AS j, props = '{\"k\": 7}' AS same FROM events")
q("time_compare", "SELECT n_nationkey, TIME '09:00' < TIME '17:30' AS lt, CAST('9:05' AS TIME)::TEXT AS t FROM nation", "SELECT n_nationkey, TRUE AS lt, '09:05:00' AS t FROM nation")
q("date_compare", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01'")
q("timestamptz_text", "SELECT r_regionkey, TIMESTAMPTZ '2026-06-13 10:00:00+02'::TEXT AS t, TIMESTAMPTZ '1969-12-31 23:30:00'::DATE AS d FROM region", "SELECT r_regionkey, '2026-06-13 08:00:00+00:00' AS t, DATE '1969-12-31' AS d FROM region")
# system relations
q("syscat_types", "SELECT oid, typname, typlen, typcategory FROM pg_catalog.pg_type WHERE typname IN ('int4', 'text', 'uuid')", "SELECT * FROM (VALUES (CAST(23 AS BIGINT), 'int4', 4, 'N'), (25, 'text', -1, 'S'), (2950, 'uuid', 16, 'U')) t(oid, typname, typlen, typcategory)")
q("syscat_schemata", "SELECT schema_name FROM information_schema.schemata", "SELECT 'public' AS schema_name")
q("syscat_stats_empty", "SELECT schemaname, attname FROM st_stats", "SELECT 'a' AS schemaname, 'b' AS attname WHERE FALSE")


def engine_of(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """An engine with views over the tables that the text names."""
    engine = Engine(spark)
    return engine.register_parquet(sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", text)])


def runner(ours: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_of(spark, sf_dir, ours).sql(ours, strategy)


def new_engine(spark: SparkSession) -> Engine:
    """An engine whose catalog lies in the shared folder that the session names."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return Engine(spark, f"{named.rstrip('/')}/tessera-catalog-{uuid.uuid4().hex}")


def script(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, out = new_engine(spark), None
        for s in statements:
            out = engine.sql(s)
        return out

    return run


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = new_engine(spark)
    engine.sql("CREATE TABLE t (k INT, v TEXT)")
    engine.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    engine.catalog.delete(["t"], [2, 9])
    return engine.sql("SELECT * FROM t")


def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was after its first statement."""
    engine = new_engine(spark)
    engine.sql("CREATE TABLE t (k INT, v TEXT)")
    engine.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    engine.sql("INSERT INTO t VALUES (1, 'c'), (3, 'd')")
    return engine.catalog.read(engine.catalog.get_table(["t"]), upto=2 * (1 << 32) - 1)


#: Statements on a catalog of their own, and DuckDB's rows for the result.
SCRIPTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "upsert_roundtrip": (script("CREATE TABLE t (k INT, v TEXT)", "INSERT INTO t VALUES (1, 'a'), (2, 'b'), (1, 'c')", "INSERT INTO t VALUES (2, 'd'), (3, 'e')", "SELECT * FROM t"), "SELECT * FROM (VALUES (1, 'c'), (2, 'd'), (3, 'e')) t(k, v)"),
    "default_fill": (script("CREATE TABLE t (id INT, status TEXT DEFAULT UPPER('hi'), qty INT DEFAULT '42'::INT, note TEXT)", "INSERT INTO t (note, id) VALUES ('n', 1)", "INSERT INTO t VALUES (2), (3, 'x', 7)", "SELECT * FROM t"), "SELECT * FROM (VALUES (1, 'HI', 42, 'n'), (2, 'HI', 42, NULL), (3, 'x', 7, NULL)) t(id, status, qty, note)"),
    "create_or_replace": (script("CREATE TABLE t (id INT, name TEXT)", "INSERT INTO t VALUES (1, 'a')", "CREATE OR REPLACE TABLE t (id BIGINT, label TEXT)", "INSERT INTO t VALUES (10, 'fresh')", "SELECT * FROM t"), "SELECT CAST(10 AS BIGINT) AS id, 'fresh' AS label"),
    "catalog_key_range": (script("CREATE TABLE t (k INT, v TEXT)", "INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd')", "INSERT INTO t VALUES (3, 'e'), (9, 'f')", "SELECT * FROM t WHERE k BETWEEN 2 AND 4"), "SELECT * FROM (VALUES (2, 'b'), (3, 'e'), (4, 'd')) t(k, v)"),
    "catalog_point_get": (script("CREATE TABLE t (k BIGINT, v TEXT)", "INSERT INTO t VALUES (1, 'a'), (2, 'b')", "INSERT INTO t VALUES (2, 'c')", "SELECT v FROM t WHERE k = 2"), "SELECT 'c' AS v"),
    "point_in_time_scan": (point_in_time, "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, v)"),
    "delete_by_key": (deleted, "SELECT * FROM (VALUES (1, 'a'), (3, 'c')) t(k, v)"),
    "syscat_columns": (script("CREATE SCHEMA s", "CREATE TABLE s.w (id INT, name TEXT NOT NULL, price NUMERIC, tags INT[])", "SELECT column_name, ordinal_position, is_nullable, udt_name FROM information_schema.columns WHERE table_schema = 's'"), "SELECT * FROM (VALUES ('id', 1, 'YES', 'int4'), ('name', 2, 'NO', 'text'), ('price', 3, 'YES', 'numeric'), ('tags', 4, 'YES', 'array')) t(column_name, ordinal_position, is_nullable, udt_name)"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: runner(ours, strategy) for name, (ours, _, strategy) in SQL.items()} | {name: run for name, (run, _) in SCRIPTS.items()}
ORACLES: dict[str, str] = {name: duck or ours for name, (ours, duck, _) in SQL.items()} | {name: duck for name, (_, duck) in SCRIPTS.items()}
