"""Sources, profiles and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions.expressions import comma_double, lenient_timestamp
from riskgraph.operators import features as fe
from riskgraph.operators import profile, v1
from riskgraph.operators.keys import dense_ids, lookup_ids, with_row_key, with_txn_key
from riskgraph.plans.catalog.base import (
    KEY_SQL,
    LINE_KEY,
    lines,
    query,
    rounded,
    table,
    with_lines,
)
from riskgraph.session import prepare
from riskgraph.sources import transactions as src

RAW_COLUMNS = [
    "trans_id", "trans_date", "store_code", "cust_id", "product_code", "barcode", "amount",
    "unit_price",
]

# --- sources and profiles ---------------------------------------------------------------


@query(
    "s2_placeholder_prices",
    with_lines(
        "select trans_id, product_code, store_code, amount, unit_price, unit_price as no_discount,"
        " unit_price as discounted_unit_price, unit_price*amount as discounted_total_price,"
        " 0.0e0 as total_discount_amount, 0.0e0 as unit_campaign_discount from lines"
    ),
)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lines(spark, sf_dir).select(*RAW_COLUMNS).withColumns(src.placeholder_prices())
    return raw.select(*LINE_KEY, *src.PRICE_COLUMNS)


@query(
    "s4_comma_decimals",
    "select l_orderkey, l_linenumber, l_partkey, l_extendedprice as price, l_discount as rate"
    " from lineitem",
)
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(c):
        return F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))

    written = table(prepare(spark), sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        text("l_extendedprice").alias("price"),
        text("l_discount").alias("rate"),
    )
    return written.withColumns({c: comma_double(F.col(c)) for c in ("price", "rate")})


@query(
    "s5_lenient_timestamps",
    "select event_id, try_cast(case when event_id%7=0 then '2024-13-01'"
    " else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp) as ts from events",
)
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("event_id") % 7 == 0, "2024-13-01").otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    events = table(prepare(spark), sf_dir, "events")
    return events.select("event_id", lenient_timestamp(written).alias("ts"))


@query(
    "s7_first_rows",
    with_lines(
        f"select {KEY_SQL}, cust_id from lines"
        " order by trans_id, product_code, store_code, amount limit 1000"
    ),
)
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.first_rows(lines(spark, sf_dir), 1000, LINE_KEY).select(*LINE_KEY, "cust_id")


@query(
    "s8_rename_columns",
    with_lines(
        "select trans_id, trans_date, store_code, cust_id, product_code, barcode, amount,"
        " unit_price from lines"
    ),
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = lines(spark, sf_dir).select([F.col(c).alias(c.upper()) for c in RAW_COLUMNS])
    return src.rename_columns(upper)


@query(
    "s9_required_columns",
    with_lines("select count(*) as valid_rows from lines"),
)
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    src.validate_required_columns(df)
    return df.agg(F.count(F.lit(1)).alias("valid_rows"))


@query(
    "s10_table_info",
    with_lines(
        "select count(*) as rows, 13 as columns, min(trans_date) as date_min,"
        " max(trans_date) as date_max, count(distinct cust_id) as customers,"
        " count(distinct product_code) as products, count(distinct store_code) as stores,"
        " count(*) filter (cust_id is null) as null_cust_id,"
        " count(*) filter (unit_price is null) as null_unit_price from lines"
    ),
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = profile.table_info(lines(spark, sf_dir))
    return info.select(
        *[c for c in info.columns if c not in ("null_counts", "dtypes")],
        *[F.col("null_counts")[c].alias(f"null_{c}") for c in ("cust_id", "unit_price")],
    )


DESCRIBED = ["amount", "unit_price", "discounted_total_price", "total_discount_amount", "cust_id"]


@query(
    "s13_describe",
    with_lines(
        " union all ".join(
            f"select '{c}' as \"column\", count({c}) as count, round(avg({c})+3e-7,4) as mean,"
            f" round(stddev_samp({c})+3e-7,4) as std, min({c})::double as min,"
            f" round(quantile_cont({c}::double,0.25)+3e-7,4) as p25,"
            f" round(quantile_cont({c}::double,0.5)+3e-7,4) as p50,"
            f" round(quantile_cont({c}::double,0.75)+3e-7,4) as p75, max({c})::double as max from lines"
            for c in DESCRIBED
        )
    ),
)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.describe_numeric(lines(spark, sf_dir), DESCRIBED)
    return rounded(stats, ["mean", "std", "p25", "p50", "p75"])


@query(
    "s14_missing_values",
    "with parsed as (select ts, case when event_id%7=0 then null else value end as value,"
    " case when event_type='click' then null else user_id end as user_id from events)"
    + " union all ".join(
        f" select '{c}' as \"column\", count(*)-count({c}) as missing,"
        f" round((count(*)-count({c}))*100.0e0/count(*)+3e-7,4) as missing_pct from parsed"
        for c in ("ts", "value", "user_id")
    ),
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = table(prepare(spark), sf_dir, "events").select(
        "ts",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("user_id")).alias("user_id"),
    )
    return rounded(profile.missing_values(holes), ["missing_pct"])


@query(
    "s15_date_window",
    with_lines(
        f"select {KEY_SQL}, trans_date from lines where trans_date between"
        " timestamp '1996-03-01' and timestamp '1998-06-30 12:00:00'"
        " order by trans_date, trans_id, product_code, store_code, amount limit 5000"
    ),
)
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = src.date_window(
        lines(spark, sf_dir), "1996-03-01", "1998-06-30 12:00:00", 5000, tie_break=tuple(LINE_KEY)
    )
    return window.select(*LINE_KEY, "trans_date")


@query("s16_minimum_size", with_lines("select count(*) as rows from lines"))
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = src.require_rows(lines(spark, sf_dir), 1000)
    return checked.agg(F.count(F.lit(1)).alias("rows"))


@query("s21_comparison_summary")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = lines(spark, sf_dir)
    return profile.comparison_summary(full.select(*RAW_COLUMNS), full)


# --- keys -------------------------------------------------------------------------------


@query("k1_txn_key")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_txn_key(lines(spark, sf_dir)).select("txn_key", *LINE_KEY)


@query(
    "k2_dense_ids",
    with_lines(
        " union all ".join(
            f"select '{kind}' as kind, {c}::bigint as id,"
            f" row_number() over (order by {c})-1 as idx from (select distinct {c} from lines)"
            for kind, c in (
                ("customer", "cust_id"),
                ("product", "product_code"),
                ("store", "store_code"),
            )
        )
    ),
)
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    parts = [
        dense_ids(df, c).select(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id"), "idx")
        for kind, c in (("customer", "cust_id"), ("product", "product_code"), ("store", "store_code"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "k3_lookup_ids",
    with_lines(
        f"select {KEY_SQL}, coalesce(idx, 0) as customer_idx,"
        " case when idx is null then 0 else 1 end as is_known_cust_id from lines left join"
        " (select cust_id as id, row_number() over (order by cust_id)-1 as idx from"
        " (select distinct cust_id from lines where amount > 45)) m on cust_id = id"
    ),
)
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    known = dense_ids(df.filter("amount > 45"), "cust_id")
    return lookup_ids(df, known, "cust_id", "customer_idx").select(
        *LINE_KEY, "customer_idx", "is_known_cust_id"
    )


# --- row features -----------------------------------------------------------------------

STATS_CTE = (
    "stats as (select quantile_cont(discounted_unit_price,0.5) as med,"
    " stddev_samp(discounted_unit_price) as sd, quantile_cont(discounted_unit_price,0.25) as q25,"
    " quantile_cont(discounted_unit_price,0.75) as q75,"
    " quantile_cont(discounted_total_price,0.99) as q99 from lines)"
)

PRICE_SQL = {
    "f1_effective_price": (
        ["effective_price", "total_price"],
        "discounted_unit_price as effective_price, discounted_total_price as total_price",
    ),
    "f3_price_level_flags": (
        ["is_high_price", "is_low_price"],
        "(discounted_unit_price>q75)::int as is_high_price,"
        " (discounted_unit_price<q25)::int as is_low_price",
    ),
    "f4_unusual_amount": (["is_unusual_amount"], "(amount>5)::int as is_unusual_amount"),
    "f5_bulk_purchase": (["is_bulk_purchase"], "(amount>=3)::int as is_bulk_purchase"),
}


def _price_query(name: str, columns: list[str], text: str) -> None:
    @query(name, with_lines(f"select {KEY_SQL}, {text} from lines, stats", STATS_CTE))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fe.price_features(lines(spark, sf_dir)).select(*LINE_KEY, *columns)


for _name, (_columns, _text) in PRICE_SQL.items():
    _price_query(_name, _columns, _text)


@query(
    "f2_price_deviation",
    with_lines(
        f"select {KEY_SQL}, round(abs(discounted_unit_price-med)/(sd+1e-6)+3e-7,6) as price_deviation"
        " from lines, stats",
        STATS_CTE,
    ),
)
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = fe.price_features(lines(spark, sf_dir)).select(*LINE_KEY, "price_deviation")
    return rounded(priced, ["price_deviation"], 6)


PERCENT_SQL = "coalesce(total_discount_amount/greatest(no_discount*amount,0.01e0)*100,0.0e0)"
DISCOUNT_SQL = {
    "f6_discount_rate": (
        ["discount_rate"],
        "coalesce((no_discount-discounted_unit_price)/greatest(no_discount,0.01e0),0.0e0)"
        " as discount_rate",
    ),
    "f7_discount_percentage": (["discount_percentage"], f"{PERCENT_SQL} as discount_percentage"),
    "f8_has_campaign": (["has_campaign"], "(unit_campaign_discount>0)::int as has_campaign"),
    "f9_has_discount": (["has_discount"], "(total_discount_amount>0)::int as has_discount"),
    "f10_discount_per_unit": (
        ["discount_per_unit"],
        "total_discount_amount/greatest(amount,1) as discount_per_unit",
    ),
    "f11_high_discount": (["is_high_discount"], f"({PERCENT_SQL}>20)::int as is_high_discount"),
    "f12_campaign_no_discount": (
        ["campaign_no_discount"],
        "(unit_campaign_discount>0 and not total_discount_amount>0)::int as campaign_no_discount",
    ),
}


def _discount_query(name: str, columns: list[str], text: str) -> None:
    @query(name, with_lines(f"select {KEY_SQL}, {text} from lines"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fe.discount_features(lines(spark, sf_dir)).select(*LINE_KEY, *columns)


for _name, (_columns, _text) in DISCOUNT_SQL.items():
    _discount_query(_name, _columns, _text)

TIME_SQL = {
    "f13_date_parts": (
        ["hour", "day_of_week", "day_of_month", "month", "year"],
        "hour({t}) as hour, isodow({t})-1 as day_of_week, day({t}) as day_of_month,"
        " month({t}) as month, year({t}) as year",
    ),
    "f14_weekend": (["is_weekend"], "(isodow({t})>=6)::int as is_weekend"),
    "f15_night": (
        ["is_night_transaction"],
        "(hour({t})<6 or hour({t})>22)::int as is_night_transaction",
    ),
    "f16_business_hours": (
        ["is_business_hours"],
        "(hour({t})>=9 and hour({t})<=18)::int as is_business_hours",
    ),
    "f17_holiday_season": (
        ["is_holiday_season"],
        "(month({t}) in (11,12,1))::int as is_holiday_season",
    ),
}


def _time_query(name: str, columns: list[str], text: str) -> None:
    @query(name, with_lines(f"select {KEY_SQL}, {text.format(t='trans_date')} from lines"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fe.time_features(lines(spark, sf_dir)).select(*LINE_KEY, *columns)

    @query(f"{name}_events", f"select event_id, {text.format(t='ts')} from events")
    def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(prepare(spark), sf_dir, "events")
        return fe.time_features(events, "ts").select("event_id", *columns)


for _name, (_columns, _text) in TIME_SQL.items():
    _time_query(_name, _columns, _text)

# --- aggregates joined back -------------------------------------------------------------

FLAGGED_CTE = (
    "flagged as (select *, discounted_unit_price as effective_price,"
    " discounted_total_price as total_price,"
    " (unit_campaign_discount>0)::int as has_campaign,"
    " (total_discount_amount>0)::int as has_discount from lines)"
)
CUSTOMER_CTE = (
    "cust as (select cust_id, count(*) as customer_transaction_count,"
    " sum(total_price) as customer_total_spending,"
    " sum(total_price)/count(*) as avg_transaction_value,"
    " count(distinct product_code) as customer_unique_products,"
    " count(distinct store_code) as unique_stores,"
    " avg((amount=1)::int) as return_rate,"
    " count(*)/greatest(floor((epoch_us(max(trans_date))-epoch_us(min(trans_date)))"
    "/86400000000.0e0)+1,1) as transaction_velocity,"
    " avg(has_discount) as customer_discount_rate, avg(has_campaign) as customer_campaign_rate"
    " from flagged group by cust_id)"
)
PRODUCT_CTE = (
    "prod as (select product_code as pc, count(*) as product_popularity,"
    " avg(effective_price) as product_avg_price,"
    " count(distinct cust_id) as product_unique_customers,"
    " avg(has_discount) as product_discount_frequency from flagged group by product_code)"
)


def based(df: DataFrame) -> DataFrame:
    """Lines with the columns the keyed aggregates read."""
    return fe.discount_features(
        df.withColumns(
            {
                "effective_price": F.col("discounted_unit_price"),
                "total_price": F.col("discounted_total_price"),
            }
        )
    )


CUSTOMER_QUERIES = {
    "f20_customer_transaction_count": ("customer_transaction_count", False),
    "f21_customer_total_spending": ("customer_total_spending", True),
    "f22_avg_transaction_value": ("avg_transaction_value", True),
    "f23_customer_unique_products": ("customer_unique_products", False),
    "f24_unique_stores": ("unique_stores", False),
    "f25_transaction_velocity": ("transaction_velocity", True),
    "f26_return_rate": ("return_rate", True),
    "f27_customer_discount_rate": ("customer_discount_rate", True),
    "f28_customer_campaign_rate": ("customer_campaign_rate", True),
}
PRODUCT_QUERIES = {
    "f30_product_popularity": ("product_popularity", False),
    "f31_product_avg_price": ("product_avg_price", True),
    "f33_product_unique_customers": ("product_unique_customers", False),
    "f34_product_discount_frequency": ("product_discount_frequency", True),
}


def _sql_column(column: str, is_real: bool) -> str:
    return f"round({column}+3e-7,4) as {column}" if is_real else column


def _customer_query(name: str, column: str, is_real: bool) -> None:
    text = f"select {KEY_SQL}, {_sql_column(column, is_real)} from flagged join cust using (cust_id)"

    @query(name, with_lines(text, FLAGGED_CTE, CUSTOMER_CTE))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fe.customer_features(based(lines(spark, sf_dir))).select(*LINE_KEY, column)
        return rounded(out, [column]) if is_real else out


def _product_query(name: str, column: str, is_real: bool) -> None:
    text = f"select {KEY_SQL}, {_sql_column(column, is_real)} from flagged join prod on product_code=pc"

    @query(name, with_lines(text, FLAGGED_CTE, PRODUCT_CTE))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fe.product_features(based(lines(spark, sf_dir))).select(*LINE_KEY, column)
        return rounded(out, [column]) if is_real else out


for _name, (_column, _real) in CUSTOMER_QUERIES.items():
    _customer_query(_name, _column, _real)
for _name, (_column, _real) in PRODUCT_QUERIES.items():
    _product_query(_name, _column, _real)


@query(
    "f32_product_price_deviation",
    with_lines(
        f"select {KEY_SQL}, round(abs(effective_price-product_avg_price)"
        "/greatest(product_avg_price,0.01e0)+3e-7,6) as product_price_deviation"
        " from flagged join prod on product_code=pc",
        FLAGGED_CTE,
        PRODUCT_CTE,
    ),
)
def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.product_features(based(lines(spark, sf_dir)))
    return rounded(out.select(*LINE_KEY, "product_price_deviation"), ["product_price_deviation"], 6)


# --- sequences and cleanup --------------------------------------------------------------


@query(
    "f35_extreme_value",
    with_lines(
        f"select {KEY_SQL}, (discounted_total_price>q99)::int as is_extreme_value from lines, stats",
        STATS_CTE,
    ),
)
def f35(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.extreme_value_flag(based(lines(spark, sf_dir)))
    return out.select(*LINE_KEY, "is_extreme_value")


def gap_cte(keys: str, name: str) -> str:
    return (
        f"gaps as (select *, (epoch_us(trans_date)-lag(epoch_us(trans_date)) over"
        f" (partition by {keys} order by trans_date, {KEY_SQL}))/3600000000.0e0 as {name}"
        " from lines)"
    )


@query(
    "f36_time_since_last_trans",
    with_lines(
        "select cust_id, trans_date, coalesce(time_since_last_trans,999.0e0)"
        " as time_since_last_trans from gaps",
        gap_cte("cust_id", "time_since_last_trans"),
    ),
)
def f36(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.customer_gap_features(with_row_key(lines(spark, sf_dir), LINE_KEY))
    return out.select("cust_id", "trans_date", "time_since_last_trans")


@query(
    "f37_rapid_transaction",
    with_lines(
        "select cust_id, trans_date, coalesce(g<1,false)::int as is_rapid_transaction from gaps",
        gap_cte("cust_id", "g"),
    ),
)
def f37(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.customer_gap_features(with_row_key(lines(spark, sf_dir), LINE_KEY))
    return out.select("cust_id", "trans_date", "is_rapid_transaction")


@query(
    "f38_same_product_time_gap",
    with_lines(
        "select product_code, cust_id, trans_date, coalesce(g,999.0e0)"
        " as same_product_time_gap from gaps",
        gap_cte("product_code, cust_id", "g"),
    ),
)
def f38(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.product_gap_features(with_row_key(lines(spark, sf_dir), LINE_KEY))
    return out.select("product_code", "cust_id", "trans_date", "same_product_time_gap")


@query(
    "f39_repeated_product_purchase",
    with_lines(
        "select product_code, cust_id, trans_date, coalesce(g<24,false)::int"
        " as is_repeated_product_purchase from gaps",
        gap_cte("product_code, cust_id", "g"),
    ),
)
def f39(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.product_gap_features(with_row_key(lines(spark, sf_dir), LINE_KEY))
    return out.select("product_code", "cust_id", "trans_date", "is_repeated_product_purchase")


@query(
    "f36_event_gaps",
    "select event_id, coalesce((epoch_us(ts)-lag(epoch_us(ts)) over (partition by user_id"
    " order by ts, event_id))/3600000000.0e0, 999.0e0) as time_since_last_trans,"
    " coalesce((epoch_us(ts)-lag(epoch_us(ts)) over (partition by user_id order by ts,"
    " event_id))/3600000000.0e0<1, false)::int as is_rapid_transaction from events",
)
def f36_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(prepare(spark), sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("cust_id"),
        F.col("ts").cast("timestamp").alias("trans_date"),
        F.format_string("%020d", "event_id").alias("txn_key"),
    )
    out = fe.customer_gap_features(events)
    return out.select("event_id", "time_since_last_trans", "is_rapid_transaction")


@query(
    "f40_no_dates",
    with_lines(
        f"select {KEY_SQL}, 999.0e0 as time_since_last_trans, 0 as is_rapid_transaction from lines"
    ),
)
def f40(spark: SparkSession, sf_dir: str) -> DataFrame:
    undated = lines(spark, sf_dir).withColumn("trans_date", F.lit(None).cast("timestamp"))
    out = fe.customer_gap_features(with_txn_key(undated))
    return out.select(*LINE_KEY, "time_since_last_trans", "is_rapid_transaction")


@query(
    "f42_cleanup",
    with_lines(
        f"select {KEY_SQL}, case when amount%3=0 or amount%4=0 then 0.0e0 else unit_price end"
        " as unit_price, case when amount%5=0 then 0 else cust_id end as cust_id from lines"
    ),
)
def f42(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("amount")
    holes = lines(spark, sf_dir).select(
        *LINE_KEY,
        F.when(amount % 3 == 0, None)
        .when(amount % 4 == 0, F.lit(float("-inf")))
        .otherwise(F.col("unit_price"))
        .alias("unit_price"),
        F.when(amount % 5 != 0, F.col("cust_id")).alias("cust_id"),
        F.lit(1).alias("helper"),
    )
    return fe.cleanup(holes, drop=["helper"])


FULL_INT = [
    "is_high_price", "is_low_price", "is_unusual_amount", "is_bulk_purchase", "has_campaign",
    "has_discount", "is_high_discount", "campaign_no_discount", "hour", "day_of_week",
    "day_of_month", "month", "year", "is_weekend", "is_night_transaction", "is_business_hours",
    "is_holiday_season", "customer_transaction_count", "customer_unique_products",
    "unique_stores", "product_popularity", "product_unique_customers", "is_extreme_value",
]
FULL_REAL = [
    "effective_price", "total_price", "price_deviation", "discount_rate", "discount_percentage",
    "discount_per_unit", "customer_total_spending", "avg_transaction_value", "return_rate",
    "transaction_velocity", "customer_discount_rate", "customer_campaign_rate",
    "product_avg_price", "product_price_deviation", "product_discount_frequency",
]
FEATURES_CTE = (
    "features as (select f.*, abs(effective_price-med)/(sd+1e-6) as price_deviation,"
    " (effective_price>q75)::int as is_high_price, (effective_price<q25)::int as is_low_price,"
    + ", ".join(
        text
        for source in (PRICE_SQL, DISCOUNT_SQL)
        for name, (_, text) in source.items()
        if name.split("_")[0] in ("f4", "f5", "f6", "f7", "f10", "f11", "f12")
    )
    + ", "
    + ", ".join(text.format(t="trans_date") for _, text in TIME_SQL.values())
    + ", (total_price>q99)::int as is_extreme_value, cust.* exclude (cust_id),"
    " prod.* exclude (pc), abs(effective_price-product_avg_price)"
    "/greatest(product_avg_price,0.01e0) as product_price_deviation"
    " from flagged f join cust using (cust_id) join prod on product_code=pc, stats)"
)
FEATURE_CTES = (STATS_CTE, FLAGGED_CTE, CUSTOMER_CTE, PRODUCT_CTE, FEATURES_CTE)


@query(
    "f43_engineer_features",
    with_lines(
        f"select {KEY_SQL}, {', '.join(FULL_INT)}, "
        + ", ".join(f"round({c}+3e-7,4) as {c}" for c in FULL_REAL)
        + " from features",
        *FEATURE_CTES,
    ),
)
def f43(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.engineer_features(lines(spark, sf_dir), LINE_KEY)
    return rounded(out.select(*LINE_KEY, *FULL_INT, *FULL_REAL), FULL_REAL)


@query(
    "f43_feature_totals",
    with_lines(
        "select count(*) as rows, sum(is_rapid_transaction) as rapid, sum(is_repeated) as repeated,"
        " round(sum(t1),2) as customer_gap_hours, round(sum(t2),2) as product_gap_hours from"
        " (select coalesce(g<1,false)::int as is_rapid_transaction,"
        " coalesce(h<24,false)::int as is_repeated, coalesce(g,999) as t1, coalesce(h,999) as t2"
        " from gaps)",
        "gaps as (select (epoch_us(trans_date)-lag(epoch_us(trans_date)) over (partition by"
        " cust_id order by trans_date))/3600000000.0e0 as g,"
        " (epoch_us(trans_date)-lag(epoch_us(trans_date)) over (partition by product_code,"
        " cust_id order by trans_date))/3600000000.0e0 as h from lines)",
    ),
)
def f43_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fe.engineer_features(lines(spark, sf_dir), LINE_KEY)
    return out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_rapid_transaction").alias("rapid"),
        F.sum("is_repeated_product_purchase").alias("repeated"),
        F.round(F.sum("time_since_last_trans"), 2).alias("customer_gap_hours"),
        F.round(F.sum("same_product_time_gap"), 2).alias("product_gap_hours"),
    )


# --- earlier feature set ----------------------------------------------------------------

V1_PRICED_CTE = (
    "priced as (select *, amount*unit_price as total_price, (unit_price<0)::int as is_return"
    " from signed)"
)
# Some unit prices are turned negative so that returns occur.
SIGNED_CTE = (
    "signed as (select * replace (case when product_code%10=3 then -unit_price else unit_price"
    " end as unit_price) from lines)"
)
V1_CUSTOMER_CTE = (
    "cust as (select cust_id, count(*) as transaction_count, sum(total_price) as total_spent,"
    " avg(total_price) as avg_transaction_value, count(distinct store_code) as unique_stores,"
    " floor((epoch_us(max(trans_date))-epoch_us(min(trans_date)))/86400000000.0e0)::bigint+1"
    " as days_active, sum(is_return)::bigint as return_count from priced where cust_id<>0"
    " group by cust_id)"
)
V1_PRODUCT_CTE = (
    "prod as (select product_code, avg(unit_price) as product_avg_price,"
    " stddev_samp(unit_price) as product_price_std, avg(amount) as product_avg_amount,"
    " median(amount) as product_median_amount, count(*) as product_popularity from priced"
    " where cust_id<>0 group by product_code)"
)


def signed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("unit_price")
    return v1.v1_price_features(
        lines(spark, sf_dir).withColumn(
            "unit_price", F.when(F.col("product_code") % 10 == 3, -price).otherwise(price)
        )
    )


@query(
    "a1_price",
    with_lines(
        f"select {KEY_SQL}, total_price, is_return from priced", SIGNED_CTE, V1_PRICED_CTE
    ),
)
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed_lines(spark, sf_dir).select(*LINE_KEY, "total_price", "is_return")


@query(
    "a2_time",
    with_lines(
        f"select {KEY_SQL}, hour(trans_date) as hour, isodow(trans_date)-1 as day_of_week,"
        " day(trans_date) as day_of_month, (isodow(trans_date)>=6)::int as is_weekend,"
        " (hour(trans_date)>=22 or hour(trans_date)<=6)::int as is_night_transaction from lines"
    ),
)
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v1.v1_time_features(lines(spark, sf_dir)).select(
        *LINE_KEY, "hour", "day_of_week", "day_of_month", "is_weekend", "is_night_transaction"
    )


@query(
    "a3_guest_free_aggregates",
    with_lines(
        f"select {KEY_SQL}, coalesce(transaction_count,0)::double as transaction_count,"
        " round(coalesce(total_spent,0)+3e-7,4) as total_spent,"
        " round(coalesce(avg_transaction_value,0)+3e-7,4) as avg_transaction_value,"
        " round(coalesce(transaction_count/days_active,0)+3e-7,4) as transaction_velocity,"
        " coalesce(unique_stores,0)::double as unique_stores,"
        " round(coalesce(return_count/transaction_count,0)+3e-7,4) as return_rate"
        " from priced left join cust using (cust_id)",
        SIGNED_CTE,
        V1_PRICED_CTE,
        V1_CUSTOMER_CTE,
    ),
)
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v1.v1_customer_features(signed_lines(spark, sf_dir))
    real = ["total_spent", "avg_transaction_value", "transaction_velocity", "return_rate"]
    return rounded(out.select(*LINE_KEY, *v1.CUSTOMER_COLUMNS), real)


def _v1_customer_query(name: str, texts: dict[str, str], real: list[str]) -> None:
    body = "select cust_id, " + ", ".join(f"{t} as {c}" for c, t in texts.items()) + " from cust"

    @query(name, with_lines(body, SIGNED_CTE, V1_PRICED_CTE, V1_CUSTOMER_CTE))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = v1.v1_customer_aggregates(signed_lines(spark, sf_dir)).select("cust_id", *texts)
        return rounded(out, real)


_v1_customer_query(
    "a4_customer_totals",
    {
        "transaction_count": "transaction_count",
        "total_spent": "round(total_spent+3e-7,4)",
        "avg_transaction_value": "round(avg_transaction_value+3e-7,4)",
        "unique_stores": "unique_stores",
    },
    ["total_spent", "avg_transaction_value"],
)
_v1_customer_query(
    "a5_activity",
    {
        "days_active": "days_active",
        "transaction_velocity": "round(transaction_count/days_active+3e-7,4)",
    },
    ["transaction_velocity"],
)
_v1_customer_query(
    "a6_returns",
    {"return_count": "return_count", "return_rate": "round(return_count/transaction_count+3e-7,4)"},
    ["return_rate"],
)


@query(
    "a7_product_aggregates",
    with_lines(
        "select product_code, round(product_avg_price+3e-7,4) as product_avg_price,"
        " round(product_price_std+3e-7,4) as product_price_std,"
        " round(product_avg_amount+3e-7,4) as product_avg_amount, product_median_amount,"
        " product_popularity from prod",
        SIGNED_CTE,
        V1_PRICED_CTE,
        V1_PRODUCT_CTE,
    ),
)
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = ["product_avg_price", "product_price_std", "product_avg_amount"]
    return rounded(v1.v1_product_aggregates(signed_lines(spark, sf_dir)), real)


@query(
    "a8_product_deviation",
    with_lines(
        f"select {KEY_SQL}, round(coalesce(abs(unit_price-product_avg_price),0)+3e-7,4)"
        " as price_deviation, coalesce(amount>product_median_amount*3,false)::int"
        " as is_unusual_amount from priced left join prod using (product_code)",
        SIGNED_CTE,
        V1_PRICED_CTE,
        V1_PRODUCT_CTE,
    ),
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v1.v1_product_features(signed_lines(spark, sf_dir))
    return rounded(out.select(*LINE_KEY, "price_deviation", "is_unusual_amount"), ["price_deviation"])


@query(
    "a9_value_flags",
    with_lines(
        f"select {KEY_SQL}, (unit_price<0)::int as is_negative_price,"
        " (total_price>5000)::int as is_high_value, (amount>10)::int as is_bulk_purchase from priced",
        SIGNED_CTE,
        V1_PRICED_CTE,
    ),
)
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v1.v1_value_flags(signed_lines(spark, sf_dir))
    return out.select(*LINE_KEY, "is_negative_price", "is_high_value", "is_bulk_purchase")
