"""Dirty views over the given tables, in SQL that Spark and DuckDB read alike.

The given tables hold no nulls and no badly formatted text, so most rules would have nothing to do
on them. Each view is a whole-table projection of one given table; ``$name`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugework.session import sql_over

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def _padded(expression: str, width: int) -> str:
    return f"lpad(cast({expression} as string), {width}, '0')"


_CUSTOMER_ROW = f"""
    case when k % 100 = 7 then null when k % 100 = 99 then 'CUST-' || {_padded('k - 1', 7)}
        else 'CUST-' || {_padded('k', 7)} end as customer_id,
    case when k % 11 <> 0 then 'u' || cast(k as string) || '@example.test' end as email,
    '555' || {_padded('k', 7)} as phone,
    case when k % 25 = 0 then null when nation % 4 = 0 then 'north' when nation % 4 = 1 then 'south'
        when nation % 4 = 2 then 'east' else 'west' end as region,
    case when k % 211 = 5 then 'unknown' else cast(18 + k % 73 as string) end as age,
    cast(k * 37 % 1000 as string) || '.' || {_padded('k % 100', 2)} as annual_revenue,
    case when k % 173 = 3 then 'bad' else '2026-' || {_padded('k % 12 + 1', 2)} || '-' || {_padded('k % 28 + 1', 2)} end
        as signup_date,
    '2026-' || {_padded('k % 12 + 1', 2)} || '-' || {_padded('k % 28 + 1', 2)} || 'T09:30:00'
        || case when k % 10 = 0 then 'Z' else '' end as last_contact_at,
    case when k % 2 = 0 then case when k % 5 = 0 then 'TRUE' else 'true' end
        else case when k % 5 = 0 then 'FALSE' else 'false' end end as active_flag,
    {_padded('k % 997', 5)} as account_code,
    case when k % 4 = 0 then '+' else '' end || cast(k % 9 as string) as order_count,
    case when k % 9 <> 0 then 'note ' || cast(k % 100 as string) end as notes,
    'x' as plan,
    cast(null as string) as legacy"""

CUSTOMER_COLUMNS = (
    "customer_id", "email", "phone", "region", "age", "annual_revenue", "signup_date", "last_contact_at",
    "active_flag", "account_code", "order_count", "notes", "plan", "legacy",
)

# Rows with k % 200 = 1 come twice with their identifier, those with k % 200 = 7 twice without one.
MESSY_CUSTOMERS_KEYED = f"""
    select k * 2 + copy as row_id, {_CUSTOMER_ROW}
    from (
        select c_custkey as k, c_nationkey as nation, 0 as copy from $customer
        union all
        select c_custkey as k, c_nationkey as nation, 1 as copy from $customer where c_custkey % 200 in (1, 7)
    ) keys"""
MESSY_CUSTOMERS = f"select {', '.join(CUSTOMER_COLUMNS)} from ({MESSY_CUSTOMERS_KEYED}) keyed"

EVENT_COLUMNS = ("event_id", "ts_text", "value_text", "event_type", "country_code", "birth_date")
MESSY_EVENTS = f"""
    select case when event_id % 50 <> 0 then cast(event_id as string) end as event_id,
        '2026-' || {_padded('event_id % 12 + 1', 2)} || '-' || {_padded('event_id % 28 + 1', 2)} || 'T'
            || {_padded('event_id % 24', 2)} || ':00:00'
            || case when event_id % 3 = 0 then 'Z' when event_id % 3 = 1 then '+02:00' else '' end as ts_text,
        cast(event_id % 500 as string) || case when event_id % 4 = 0 then ',' else '.' end
            || {_padded('event_id % 100', 2)} as value_text,
        case when event_id % 7 = 0 then upper(event_type) else event_type end as event_type,
        case when event_id % 3 = 0 then 'ES' when event_id % 3 = 1 then 'PT' else 'FR' end as country_code,
        '19' || {_padded('event_id % 60 + 30', 2)} || '-' || {_padded('event_id % 12 + 1', 2)} || '-'
            || {_padded('event_id % 28 + 1', 2)} as birth_date
    from $events"""

CLEAN_UNIQUE = "select o_orderkey from $orders"
# Cells of one workbook per nation: a hidden sheet, a header, data rows with one formula cell each, a
# blank row between them and blank rows at the end.
CELL_COLUMNS = ("file", "sheet", "sheet_index", "visible", "row", "col", "value", "cell_type")
CELLS = """
    select 'nation-' || cast(c_nationkey as string) as file, sheet, sheet_index, visible, row, col, value, cell_type
    from (
        select c_nationkey, 'hidden' as sheet, 0 as sheet_index, false as visible, c_custkey as row, 0 as col,
            'secret' as value, 's' as cell_type from $customer
        union all
        select distinct c_nationkey, 'data', 1, true, cast(-1 as bigint), 0, 'key', 's' from $customer
        union all
        select distinct c_nationkey, 'data', 1, true, cast(-1 as bigint), 1, 'name', 's' from $customer
        union all
        select distinct c_nationkey, 'data', 1, true, cast(-1 as bigint), 2, 'total', 's' from $customer
        union all
        select c_nationkey, 'data', 1, true, c_custkey * 2, 0, cast(c_custkey as string), 'n' from $customer
        union all
        select c_nationkey, 'data', 1, true, c_custkey * 2, 1, c_mktsegment, 's' from $customer
        union all
        select c_nationkey, 'data', 1, true, c_custkey * 2, 2, '=A1', 'f' from $customer
        union all
        select c_nationkey, 'data', 1, true, c_custkey * 2 + 1, 1, null, 's' from $customer
    ) parts"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the views above over the tables of a folder."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if f"${name}" in sql}
    return sql_over(sql, **used)


def for_duckdb(sql: str) -> str:
    """The same SQL over the registered tables."""
    return sql.replace("$", "")
