"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sales lines in the thirteen-column layout, from the given tables. The text runs in
# Spark SQL and in DuckDB.
LINES_SQL = """
select l_orderkey*10+l_linenumber as trans_id,
       o_orderdate + ((l_orderkey*7919+l_linenumber*3607)%86400)*interval '1' second as trans_date,
       cast(l_suppkey as int) as store_code, o_custkey as cust_id, l_partkey as product_code,
       l_partkey*1000+l_suppkey as barcode, cast(l_quantity as int) as amount,
       l_extendedprice/l_quantity as unit_price, l_extendedprice/l_quantity as no_discount,
       l_extendedprice*(1-3*l_discount)/l_quantity as discounted_unit_price,
       l_extendedprice*(1-3*l_discount) as discounted_total_price,
       l_extendedprice*3*l_discount as total_discount_amount,
       case when l_returnflag='A' then l_extendedprice*l_tax/l_quantity else 0.0e0 end
         as unit_campaign_discount
from {lineitem} join {orders} on l_orderkey=o_orderkey
"""

# Columns that identify a sales line of the given tables.
LINE_KEY = ["trans_id", "product_code", "store_code", "amount"]
KEY_SQL = ", ".join(LINE_KEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines of the given tables as a transaction table."""
    prepare(spark)
    text = LINES_SQL.format(lineitem="{lineitem}", orders="{orders}")
    df = spark.sql(
        text, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders")
    )
    return df.withColumn("trans_date", df["trans_date"].cast("timestamp"))


def with_lines(body: str, *ctes: str) -> str:
    """Oracle text: the lines view, further named parts, then the query."""
    parts = ["lines as (" + LINES_SQL.format(lineitem="lineitem", orders="orders") + ")", *ctes]
    return "with " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL text where there is one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Means of money amounts often end in an exact half; the shift keeps the last bit of a
# sum from deciding which way such a half is rounded.
SHIFT = 3e-7


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Round derived sums and means the way the oracle texts do."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(SHIFT), digits) for c in columns})


def sql_round(expression: str, digits: int = 4) -> str:
    return f"round({expression}+3e-7, {digits})"
