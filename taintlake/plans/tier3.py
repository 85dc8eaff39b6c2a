"""Plain SQL through the read-only surface: one text for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .surface import Surface

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

SHARED = {
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders",
    "window_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS after, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events",
    "window_rows_frame": "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM orders",
    "window_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS n FROM orders",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_partkey) AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 5 INTERSECT SELECT p_partkey FROM part WHERE p_size > 20",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 30",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "correlated_subquery": "SELECT p_partkey, (SELECT max(l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS s FROM part",
    "top_k": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "offset_page": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    "having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 55",
    "distinct_aggregate": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey",
    "filtered_aggregate": "SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS even, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY event_type",
    "five_way_join": "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name",
    "full_outer_join": "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3",
    "recursive_cte": "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 40) SELECT n, s FROM t",
    "case_and_null": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE coalesce(nullif(o_orderpriority, '1-URGENT'), 'urgent') END AS p FROM orders",
    "string_functions": "SELECT p_partkey, upper(p_name) AS u, substr(p_type, 2, 5) AS s, replace(p_brand, '#', '-') AS r, length(p_name) AS n FROM part",
    "date_functions": "SELECT extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
}
DIFFERENT = {
    "pivot": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
    ),
    "unpivot": (
        "SELECT p_partkey, what, v FROM (SELECT p_partkey, cast(p_size AS bigint) AS size, p_partkey * 2 AS double_key FROM part) UNPIVOT (v FOR what IN (size, double_key))",
        "SELECT p_partkey, 'size' AS what, p_size::BIGINT AS v FROM part UNION ALL SELECT p_partkey, 'double_key', p_partkey * 2 FROM part",
    ),
    "as_of_latest": (
        "SELECT e.event_id, max_by(p.event_id, p.event_id) AS last_view FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = 'view' WHERE e.event_type = 'purchase' GROUP BY e.event_id",
        "SELECT e.event_id, max(p.event_id) AS last_view FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = 'view' WHERE e.event_type = 'purchase' GROUP BY 1",
    ),
    "time_buckets": (
        "SELECT w.start AS start, event_type, count(*) AS n FROM (SELECT window(ts, '1 hour') AS w, event_type FROM (SELECT cast(ts AS timestamp) AS ts, event_type FROM events)) GROUP BY 1, 2",
        "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}

_SPARK = {k: v for k, v in SHARED.items()} | {k: v[0] for k, v in DIFFERENT.items()}
ORACLE_SQL: dict[str, str] = {f"tier3_{k}": v for k, v in SHARED.items()} | {f"tier3_{k}": v[1] for k, v in DIFFERENT.items()}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Surface(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}).sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"tier3_{k}": _query(v) for k, v in _SPARK.items()}
