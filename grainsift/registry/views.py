"""Faulty tables derived from the given ones, in SQL both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PEOPLE_BASE = """
  SELECT
    c_custkey AS id,
    CASE WHEN c_custkey % 7 = 3 THEN NULL
         WHEN c_custkey % 97 = 5 THEN CAST(210 + c_custkey % 100 AS DOUBLE)
         ELSE CAST(18 + (c_custkey * 13) % 52 AS DOUBLE) END AS age,
    CASE WHEN c_custkey % 5 = 0 THEN 'female' ELSE 'male' END AS gender,
    CASE WHEN c_custkey % 12 = 0
         THEN concat('$', CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING))
         ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS STRING) END AS income,
    CASE c_custkey % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'U.S.A' WHEN 2 THEN ' usa'
                       WHEN 3 THEN 'Canada' WHEN 4 THEN 'canadas' ELSE 'unknown' END AS category,
    CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS score,
    CASE WHEN c_custkey % 100 = 1
         THEN concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
    CASE c_custkey % 3 WHEN 0 THEN 'The customer asked for a refund of the order'
                       WHEN 1 THEN 'El cliente solicita el reembolso de la orden'
                       ELSE 'Le client demande un remboursement et une facture' END AS notes,
    'constant' AS flag
  FROM {customer}
"""

# the repeated rows come after the others, so their row ids are larger
_PEOPLE = f"""
SELECT id AS row_id, base.* FROM ({_PEOPLE_BASE}) base
UNION ALL
SELECT id + 1000000000000 AS row_id, base.* FROM ({_PEOPLE_BASE}) base WHERE id % 17 = 0
"""

_HOLES = """
SELECT row_id,
       CASE WHEN row_id % 50 = 0 THEN NULL ELSE age END AS age,
       CASE WHEN row_id % 50 = 0 THEN NULL ELSE gender END AS gender,
       CASE WHEN row_id % 25 = 0 THEN NULL ELSE category END AS category,
       CASE WHEN row_id % 40 <> 3 THEN 'yes' ELSE 'no' END AS mostly
FROM people
"""

_EVENTS_GAPPY = """
SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value
FROM {events}
"""

_TYPED_TEXT = """
SELECT o_orderkey AS row_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS flag_text,
       CAST(o_custkey AS STRING) AS whole_text,
       CASE WHEN o_orderkey % 20 = 0 THEN 'n.a.' ELSE concat(CAST(o_custkey AS STRING), '.5') END AS decimal_text,
       CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-31' WHEN o_orderkey % 3 = 1 THEN '01/15/2023'
            ELSE '20220630' END AS date_text,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       concat('order ', CAST(o_orderkey AS STRING)) AS free_text,
       CASE o_orderkey % 4 WHEN 0 THEN '2024-01-31T10:00:00Z' WHEN 1 THEN '2024-01-31T10:00:00.250'
            WHEN 2 THEN '2024-01-31 10:00' ELSE '31/12/2024' END AS time_text,
       concat(CAST(o_orderkey % 40 + 1 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'F' END) AS seat_text,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'no' ELSE 'yes' END AS gap_text,
       concat('9999-99-', CAST(10 + o_orderkey % 80 AS STRING)) AS no_date_text,
       CASE WHEN o_orderkey % 11 = 0 THEN '13/02/2024' WHEN o_orderkey % 11 = 1 THEN '05-02-2024 08:30'
            WHEN o_orderkey % 11 = 2 THEN '2024-03-04' ELSE '05/02/2024' END AS day_text,
       CASE WHEN o_orderkey % 60 = 0 THEN '2024-02-15'
            ELSE concat('2024-02-', CAST(10 + o_orderkey % 19 AS STRING), ' at noon') END AS half_text,
       CASE WHEN o_orderkey % 10 = 0 THEN '2024-02-30' WHEN o_orderkey % 10 = 1 THEN '12/31/2023' ELSE '06-07-2023' END AS slip_text,
       CASE WHEN o_orderkey % 2 = 0 THEN '12/31/2023' ELSE '31/12/2023' END AS both_text,
       CAST(NULL AS STRING) AS nothing
FROM {orders}
"""

_ORDERS_TWICE = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       o_custkey AS cust_copy, o_orderstatus AS status_copy, o_custkey + 1 AS cust_next
FROM {orders}
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with planted faults and repeated rows, with a row id."""
    return spark.sql(_PEOPLE, customer=table(spark, sf, "customer"))


def people_holes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_HOLES.replace("FROM people", "FROM {people}"), people=people(spark, sf))


def events_gappy(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_EVENTS_GAPPY, events=table(spark, sf, "events"))


def typed_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_TYPED_TEXT, orders=table(spark, sf, "orders"))


def orders_twice(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_ORDERS_TWICE, orders=table(spark, sf, "orders"))


PEOPLE_CTE = f"people AS ({_PEOPLE.replace('{customer}', 'customer')})"
HOLES_CTE = f"{PEOPLE_CTE}, holes AS ({_HOLES})"
EVENTS_CTE = f"gappy AS ({_EVENTS_GAPPY.replace('{events}', 'events')})"
TYPED_CTE = f"typed AS ({_TYPED_TEXT.replace('{orders}', 'orders')})"
TWICE_CTE = f"twice AS ({_ORDERS_TWICE.replace('{orders}', 'orders')})"

PEOPLE_COLUMNS = ["id", "age", "gender", "income", "category", "score", "email", "notes", "flag"]
PEOPLE_NUMBERS = ["id", "age", "score"]
PEOPLE_TEXTS = ["gender", "income", "category", "email", "notes", "flag"]
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def each(template: str, columns: list[str]) -> str:
    """The template once per column, joined by UNION ALL; ``@`` stands for the column name."""
    return " UNION ALL ".join(f"({template.replace('@', c)})" for c in columns)
