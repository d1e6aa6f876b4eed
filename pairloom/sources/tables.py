"""Input tables and their fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns of each input table, as DDL.
TABLE_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Rows that one task of heavy work per row takes.
ROWS_A_TASK = 100_000

TABLE_NAMES = sorted(TABLE_DDL)
COLUMN_NAMES = sorted({c.split()[0] for ddl in TABLE_DDL.values() for c in ddl.split(", ")})


class Tables:
    """Lazy access to the tables of one data folder: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        # Event times are stored without a zone; all arithmetic on them is in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_DDL:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table for work that is heavy per row (text patterns), dealt out to tasks of ``ROWS_A_TASK`` rows at most.

        How a table is scanned says nothing about that work: a text built from a row is many times as long
        as the row is on disk, and a split may hold all rows of a file or none. Tasks fill whole rounds of the cores: one
        task too many would take as long as a round.
        """
        df, cores = getattr(self, name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores * max(1, -(-df.count() // (ROWS_A_TASK * cores))))

    def register_views(self) -> None:
        """Register every table as a temp view, for queries given as text."""
        for name in TABLE_NAMES:
            getattr(self, name).createOrReplaceTempView(name)
