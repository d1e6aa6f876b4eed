"""Read-only queries over the relational tables (Q)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import quality, suite
from pairloom.plans.registry import query
from pairloom.plans.sqltext import average, lit, money
from pairloom.sources.tables import COLUMN_NAMES, TABLE_DDL, TABLE_NAMES, Tables


def total(column: str):
    """Sum of two-decimal amounts; decimals, so the order of rows cannot change it."""
    return F.sum(F.col(column).cast("decimal(18,2)"))


def mean(column: str):
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count(column)


# Texts run by the suite; those from 91 on cannot run and must be reported as such.
SUITE = {
    "01_latest_orders": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 "
    "ORDER BY o_orderkey DESC LIMIT 60",
    "02_segment_stats": "SELECT c_mktsegment, COUNT(*) AS n, MAX(c_acctbal) AS top_balance FROM customer "
    "GROUP BY c_mktsegment ORDER BY c_mktsegment",
    "03_nation_customers": "SELECT n.n_name, COUNT(c.c_custkey) AS n_customers FROM nation AS n "
    "JOIN customer AS c ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name ORDER BY n.n_name",
    "04_with_clause": "WITH spent AS (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' "
    "GROUP BY o_custkey) SELECT c.c_name, s.n FROM customer AS c JOIN spent AS s ON c.c_custkey = s.o_custkey "
    "ORDER BY s.n DESC, c.c_name LIMIT 5",
    "05_no_rows": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'NonExistent999'",
    "06_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) "
    "ORDER BY o_orderkey LIMIT 70",
    "07_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier ORDER BY k",
    "91_blocked": "DROP TABLE orders",
    "92_unknown_table": "SELECT * FROM secret_passwords",
    "93_unknown_column": "SELECT fake_column_abc FROM customer",
    "94_hollow": "SELECT c_name FROM WHERE FROM customer",
    "95_bad_cast": "SELECT CAST(c_name AS INT) AS n FROM customer",
    "96_zero_division": "SELECT 1 / (o_orderkey - o_orderkey) AS n FROM orders",
    "97_replaced": "REPLACE INTO orders VALUES (1)",
}
_COLUMNS = {
    "01_latest_orders": "o_orderkey,o_totalprice",
    "02_segment_stats": "c_mktsegment,n,top_balance",
    "03_nation_customers": "n_name,n_customers",
    "04_with_clause": "c_name,n",
    "05_no_rows": "c_custkey",
    "06_subquery": "o_orderkey",
    "07_union": "k",
}
_FAILING = {
    "91_blocked": "SafetyViolation",
    "92_unknown_table": "SafetyViolation",
    "93_unknown_column": "ColumnNotFound",
    "94_hollow": "SafetyViolation",
    "95_bad_cast": "ExecutionError",
    "96_zero_division": "ExecutionError",
    "97_replaced": "SafetyViolation",
}
_STATUS_SQL = " UNION ALL ".join(
    [
        f"SELECT '{name}' AS name, true AS executed, '{columns}' AS columns, CAST(NULL AS VARCHAR) AS error_type, "
        f"count(*) AS row_count FROM ({SUITE[name]}) t"
        for name, columns in _COLUMNS.items()
    ]
    + [f"SELECT '{name}', false, '', '{error}', 0" for name, error in _FAILING.items()]
)
_ROWS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS name, CAST(to_json(["
    + ", ".join(f"CAST({c} AS VARCHAR)" for c in _COLUMNS[name].split(","))
    + f"]) AS VARCHAR) AS cells FROM (SELECT * FROM ({SUITE[name]}) t LIMIT 50) t"
    for name in _COLUMNS
)


def _suite(t: Tables) -> tuple[dict[str, str], dict[str, bool]]:
    t.register_views()
    return SUITE, suite.screen_texts(t.spark, SUITE, TABLE_NAMES, COLUMN_NAMES)


@query("q01_query_capture", _STATUS_SQL)
def query_capture(t: Tables) -> DataFrame:
    """Each suite text with its columns, full row count, or the type of its error."""
    return suite.capture_status(t.spark, *_suite(t))


@query("q01_captured_rows", _ROWS_SQL)
def captured_rows(t: Tables) -> DataFrame:
    """First 50 rows of each suite text that runs."""
    return suite.capture_rows(t.spark, *_suite(t))


@query(
    "e20_suite_status",
    f"""SELECT count(*) AS queries, count(*) FILTER (executed) AS executed_queries,
  count(*) FILTER (NOT executed) AS failed_queries, bool_and(executed) AS all_passed,
  CAST(sum(row_count) AS BIGINT) AS total_rows FROM ({_STATUS_SQL}) s""",
)
def suite_status(t: Tables) -> DataFrame:
    """How many suite texts ran, and whether all did."""
    return suite.suite_status(suite.capture_status(t.spark, *_suite(t)))


@query(
    "q02_filter_sort_limit",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
)
def filter_sort_limit(t: Tables) -> DataFrame:
    """Projection, comparison, order and limit."""
    kept = t.orders.filter(F.col("o_totalprice") > 250000).select("o_orderkey", "o_custkey", "o_totalprice")
    return kept.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query(
    "q03_scalar_aggregates",
    f"""SELECT {average('c_acctbal')} AS avg_balance, max(c_acctbal) AS max_balance
  FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def scalar_aggregates(t: Tables) -> DataFrame:
    """Equality filter with average and maximum."""
    return t.customer.filter(F.col("c_mktsegment") == "BUILDING").agg(
        mean("c_acctbal").alias("avg_balance"), F.max("c_acctbal").alias("max_balance")
    )


@query(
    "q04_top_customers",
    f"""SELECT c_custkey, c_name, {money('o_totalprice')} AS total_spent
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_name IN ('NATION_3', 'NATION_7') AND o_orderstatus = 'F'
  GROUP BY c_custkey, c_name ORDER BY total_spent DESC, c_custkey LIMIT 5""",
)
def top_customers(t: Tables) -> DataFrame:
    """Top five customers of two nations by completed spending.

    Orders shrink to one row per customer before they meet the customers, so a customer
    with a third of all orders is no hot join key.
    """
    spent = t.orders.filter(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(
        total("o_totalprice").alias("total_spent")
    )
    nations = t.nation.filter(F.col("n_name").isin("NATION_3", "NATION_7"))
    people = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        people.join(spent, F.col("c_custkey") == F.col("o_custkey"))
        .select("c_custkey", "c_name", F.col("total_spent").cast("double").alias("total_spent"))
        .orderBy(F.col("total_spent").desc(), "c_custkey")
        .limit(5)
    )


@query(
    "q05_bridge_join",
    """SELECT DISTINCT p_partkey, p_name, p_brand, p_size FROM part JOIN lineitem ON p_partkey = l_partkey
  JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) > 2000""",
)
def bridge_join(t: Tables) -> DataFrame:
    """Parts with an order after 2000, through the lineitem bridge.

    Keys of the bridge are made distinct before they meet the parts.
    """
    recent = t.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select("o_orderkey")
    sold = (
        t.lineitem.select("l_orderkey", "l_partkey")
        .join(recent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .select("l_partkey")
        .distinct()
    )
    return t.part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(
        "p_partkey", "p_name", "p_brand", "p_size"
    )


@query(
    "q06_group_having",
    f"""SELECT n_name, count(s_suppkey) AS num_suppliers, {average('s_acctbal')} AS avg_balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name
  HAVING count(s_suppkey) > 2 ORDER BY avg_balance DESC""",
)
def group_having(t: Tables) -> DataFrame:
    """Suppliers and average balance of nations with more than two."""
    grouped = (
        t.supplier.groupBy("s_nationkey")
        .agg(F.count("s_suppkey").alias("num_suppliers"), mean("s_acctbal").alias("avg_balance"))
        .filter(F.col("num_suppliers") > 2)
    )
    return (
        grouped.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("n_name", "num_suppliers", "avg_balance")
        .orderBy(F.col("avg_balance").desc())
    )


@query(
    "q07_having_alias",
    """SELECT p_name, p_brand, p_retailprice, avg(l_quantity) AS avg_quantity
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_name, p_brand, p_retailprice
  HAVING avg(l_quantity) >= 30 ORDER BY p_retailprice DESC""",
)
def having_alias(t: Tables) -> DataFrame:
    """HAVING on the name of an aggregate, as text."""
    return t.spark.sql(
        """SELECT p_name, p_brand, p_retailprice, avg_quantity FROM {part} AS p
        JOIN (SELECT l_partkey, avg(l_quantity) AS avg_quantity FROM {lineitem}
              GROUP BY l_partkey HAVING avg_quantity >= 30) AS q ON p.p_partkey = q.l_partkey
        ORDER BY p_retailprice DESC""",
        part=t.part,
        lineitem=t.lineitem,
    )


def _spending(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Spending by market segment; orders shrink to customers first."""
    spent = orders.groupBy("o_custkey").agg(total("o_totalprice").alias("spent"))
    return (
        customer.join(spent, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.sum("spent").cast("double").alias("total_volume"))
    )


@query(
    "q08_last_30_days",
    f"""SELECT c_mktsegment, {money('o_totalprice')} AS total_volume FROM customer JOIN orders ON c_custkey = o_custkey
  WHERE o_orderstatus = 'F' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
  GROUP BY c_mktsegment""",
)
def last_30_days(t: Tables) -> DataFrame:
    """Volume of the last thirty days, counted back from the newest order."""
    recent = t.spark.sql(
        """SELECT o_custkey, o_totalprice FROM {orders}
        WHERE o_orderstatus = 'F' AND o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAYS FROM {orders})""",
        orders=t.orders,
    )
    return _spending(recent, t.customer)


@query(
    "q09_filtered_sum",
    f"""SELECT c_mktsegment, {money('o_totalprice')} AS total_volume FROM customer JOIN orders ON c_custkey = o_custkey
  WHERE o_orderstatus = 'F' GROUP BY c_mktsegment""",
)
def filtered_sum(t: Tables) -> DataFrame:
    """Completed volume by market segment."""
    return _spending(t.orders.filter(F.col("o_orderstatus") == "F"), t.customer)


@query(
    "q10_three_way_join",
    f"""SELECT n_name, count(*) AS num_items, {average('l_extendedprice')} AS avg_price
  FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON s_suppkey = l_suppkey
  GROUP BY n_name ORDER BY avg_price DESC""",
)
def three_way_join(t: Tables) -> DataFrame:
    """Items and average price by nation; lineitem shrinks to suppliers before the joins."""
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    items = t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum(price).alias("price"), F.count("l_extendedprice").alias("priced")
    )
    return (
        items.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(
            F.sum("n").alias("num_items"),
            (F.sum("price").cast("double") / F.sum("priced")).alias("avg_price"),
        )
        .orderBy(F.col("avg_price").desc())
    )


@query(
    "q11_cte_top",
    f"""WITH spent AS (SELECT o_custkey, {money('o_totalprice')} AS total_spent FROM orders
    WHERE o_orderstatus = 'F' GROUP BY o_custkey)
  SELECT c_name, c_mktsegment, total_spent FROM customer JOIN spent ON c_custkey = o_custkey
  ORDER BY total_spent DESC, c_name LIMIT 5""",
)
def cte_top(t: Tables) -> DataFrame:
    """A WITH aggregate joined back to its customers, as text."""
    return t.spark.sql(
        """WITH spent AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_spent
                          FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey)
        SELECT c_name, c_mktsegment, total_spent FROM {customer} JOIN spent ON c_custkey = o_custkey
        ORDER BY total_spent DESC, c_name LIMIT 5""",
        orders=t.orders,
        customer=t.customer,
    )


@query(
    "q12_latest_rows",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""",
)
def latest_rows(t: Tables) -> DataFrame:
    """The ten latest completed orders."""
    done = t.orders.filter(F.col("o_orderstatus") == "F")
    return (
        done.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
        .limit(10)
        .select("o_orderkey", "o_totalprice", "o_orderstatus")
    )


@query("q13_empty_result", "SELECT * FROM customer WHERE c_mktsegment = 'NonExistentSegment999'")
def empty_result(t: Tables) -> DataFrame:
    """A filter that nothing passes keeps the schema."""
    return t.customer.filter(F.col("c_mktsegment") == "NonExistentSegment999")


@query(
    "q14_table_listing",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {lit(', '.join(c.split()[0] for c in ddl.split(', ')))} AS column_names, "
        f"count(*) AS row_count FROM {name}"
        for name, ddl in TABLE_DDL.items()
    ),
)
def table_listing(t: Tables) -> DataFrame:
    """Every table with its columns and row count (counted from file footers)."""
    parts = []
    for name in TABLE_NAMES:
        df = getattr(t, name)
        parts.append(
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"), F.lit(", ".join(df.columns)).alias("column_names"), "row_count"
            )
        )
    return reduce(DataFrame.union, parts)


def _keys(t: Tables) -> tuple[DataFrame, DataFrame]:
    customers = t.customer.select(F.col("c_nationkey").alias("nation_key"))
    return customers, t.supplier.select(F.col("s_nationkey").alias("nation_key"))


@query(
    "q15_union",
    "SELECT c_nationkey AS nation_key FROM customer UNION SELECT s_nationkey FROM supplier",
)
def union(t: Tables) -> DataFrame:
    """Nations of customers or suppliers."""
    customers, suppliers = _keys(t)
    return customers.union(suppliers).distinct()


@query(
    "q15_union_all",
    "SELECT c_nationkey AS nation_key FROM customer UNION ALL SELECT s_nationkey FROM supplier",
)
def union_all(t: Tables) -> DataFrame:
    """The same with repetitions."""
    customers, suppliers = _keys(t)
    return customers.unionAll(suppliers)


@query(
    "q15_intersect",
    "SELECT c_nationkey AS nation_key FROM customer INTERSECT SELECT s_nationkey FROM supplier",
)
def intersect(t: Tables) -> DataFrame:
    """Nations of both."""
    customers, suppliers = _keys(t)
    return customers.distinct().intersect(suppliers.distinct())


@query(
    "q15_except",
    """SELECT c_nationkey + c_custkey % 2 * 100 AS nation_key FROM customer
  EXCEPT SELECT s_nationkey FROM supplier""",
)
def except_(t: Tables) -> DataFrame:
    """Keys of customers that no supplier has."""
    shifted = t.customer.select((F.col("c_nationkey") + F.col("c_custkey") % 2 * 100).alias("nation_key"))
    return shifted.distinct().subtract(_keys(t)[1].select(F.col("nation_key").cast("long")).distinct())


@query(
    "q16_key_checks",
    """SELECT 'orders' AS table_name, 'o_orderkey' AS key_columns, CAST(sum(n) AS BIGINT) AS total_rows,
  CAST(coalesce(sum(n) FILTER (o_orderkey IS NULL), 0) AS BIGINT) AS null_keys,
  CAST(coalesce(sum(n - 1) FILTER (o_orderkey IS NOT NULL), 0) AS BIGINT) AS repeated_keys
  FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY ALL)
  UNION ALL SELECT 'lineitem', 'l_orderkey, l_linenumber', CAST(sum(n) AS BIGINT),
  CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT),
  CAST(coalesce(sum(n - 1) FILTER (l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL), 0) AS BIGINT)
  FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def key_checks(t: Tables) -> DataFrame:
    """NOT NULL and UNIQUE of two keys."""
    return quality.null_and_key_report(t.orders, "orders", ["o_orderkey"]).union(
        quality.null_and_key_report(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"])
    )


@query(
    "q17_domain_checks",
    """SELECT 'orders' AS table_name, o_orderstatus AS bad_value, count(*) AS bad_rows FROM orders
  WHERE o_orderstatus NOT IN ('P', 'F') GROUP BY 2
  UNION ALL SELECT 'events', event_type, count(*) FROM events
  WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 2""",
)
def domain_checks(t: Tables) -> DataFrame:
    """CHECK (column IN ...): offending values."""
    status = quality.outside_domain(t.orders, "o_orderstatus", ["P", "F"])
    kinds = quality.outside_domain(t.events, "event_type", ["click", "view", "purchase"])
    return status.select(F.lit("orders").alias("table_name"), "*").union(kinds.select(F.lit("events"), "*"))


@query(
    "q18_range_checks",
    """SELECT 'lineitem.l_quantity' AS check_name, count(l_quantity) AS checked_rows,
  count(*) FILTER (l_quantity NOT BETWEEN 5 AND 45) AS bad_rows,
  min(l_quantity) + 0.0 AS min_value, max(l_quantity) + 0.0 AS max_value FROM lineitem
  UNION ALL SELECT 'lineitem.l_discount', count(l_discount), count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05),
  CAST(min(l_discount + 0.0) AS DOUBLE), CAST(max(l_discount + 0.0) AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'labels.quality', count(quality), count(*) FILTER (quality NOT BETWEEN 1 AND 5),
  CAST(min(quality) AS DOUBLE), CAST(max(quality) AS DOUBLE) FROM labels""",
)
def range_checks(t: Tables) -> DataFrame:
    """CHECK (column BETWEEN ...): offending rows."""
    labels = t.labels.withColumn("quality", F.col("quality").cast("double"))
    items = {"lineitem.l_quantity": ("l_quantity", 5.0, 45.0), "lineitem.l_discount": ("l_discount", 0.0, 0.05)}
    return quality.outside_ranges(t.lineitem, items).union(quality.outside_ranges(labels, {"labels.quality": ("quality", 1.0, 5.0)}))


_ORPHANS = """SELECT '{relation}' AS relation, count(*) AS orphan_rows, count(DISTINCT {key}) AS orphan_keys
  FROM {child} WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {parent_key} = {key}{extra})"""


@query(
    "q19_foreign_keys",
    " UNION ALL ".join(
        [
            _ORPHANS.format(relation="lineitem -> part", key="l_partkey", child="lineitem", parent="part",
                            parent_key="p_partkey", extra=""),
            _ORPHANS.format(relation="orders -> customer", key="o_custkey", child="orders", parent="customer",
                            parent_key="c_custkey", extra=""),
            _ORPHANS.format(relation="lineitem -> orders before 2001", key="l_orderkey", child="lineitem",
                            parent="orders", parent_key="o_orderkey", extra=" AND year(o_orderdate) < 2001"),
        ]
    ),
)
def foreign_keys(t: Tables) -> DataFrame:
    """Rows whose parent is missing; the last parent is restricted so that some are."""
    early = t.orders.filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return (
        quality.orphans(t.lineitem, "l_partkey", t.part, "p_partkey", "lineitem -> part")
        .union(quality.orphans(t.orders, "o_custkey", t.customer, "c_custkey", "orders -> customer"))
        .union(quality.orphans(t.lineitem, "l_orderkey", early, "o_orderkey", "lineitem -> orders before 2001"))
    )


@query(
    "q20_subqueries",
    """SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top_price FROM
  (SELECT * FROM orders WHERE o_orderstatus <> 'P') o
  WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderpriority""",
)
def subqueries(t: Tables) -> DataFrame:
    """Subqueries in FROM, as a scalar, and behind IN, as text."""
    return t.spark.sql(
        """SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top_price FROM
        (SELECT * FROM {orders} WHERE o_orderstatus <> 'P') o
        WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})
        AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) GROUP BY o_orderpriority""",
        orders=t.orders,
        customer=t.customer,
    )
