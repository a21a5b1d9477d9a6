"""Stock lists, products, uploads and users derived from the driver's tables.

Each view is one SQL text that Spark and DuckDB both run; names in braces are the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_products_raw": """
WITH r AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
FROM {lineitem} l)
SELECT l_orderkey * 1000 + rn AS id, CAST(l_orderkey % 25 AS BIGINT) AS group_id, l_orderkey AS upload_id, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS mill_id, CASE WHEN l_suppkey % 10 = 0 THEN 'Unknown Mill' ELSE concat('Mill ', CAST(l_suppkey AS VARCHAR(20))) END AS mill_name, split_part('RED OAK|hard maple|Walnut - Steamed|ash|SAP GUM:|white oak rift & quartered|Cherry|poplar|mystery wood|', '|', CAST(l_partkey % 10 AS INT) + 1) AS species_raw, split_part('4/4|5/4|6/4|8/4|10/4 rgh|12/4|13/16|1 inch|2"|odd', '|', CAST(l_suppkey % 10 AS INT) + 1) AS thickness_raw, split_part('FAS|#1C|2 com|s & b|SEL & BTR|#2A/3A|Rustic|1c s1f&btr|weird grade|', '|', CAST((l_partkey + l_linenumber) % 10 AS INT) + 1) AS grade_raw, split_part('White|Brown||Red|', '|', CAST(l_linenumber % 5 AS INT) + 1) AS color_raw, CAST(l_quantity * 100 AS BIGINT) AS qty, l_extendedprice AS price_numeric, rn AS source_row, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS is_flagged, CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS INT) AS is_reviewed, l_shipdate AS created_at
FROM r
""",
    "fx_lines": """
SELECT upload_id, CAST(4 + 2 * source_row AS BIGINT) AS line_no, species_raw AS text
FROM {fx_products_raw} WHERE source_row % 3 = 1
UNION ALL SELECT upload_id, CAST(5 + 2 * source_row AS BIGINT), CASE WHEN source_row % 4 = 0 THEN concat(CAST(qty AS VARCHAR(20)), ''' ', thickness_raw, ' ', grade_raw, ' ', color_raw) WHEN source_row % 4 = 1 THEN concat('T/L ', thickness_raw, ' ', grade_raw) WHEN source_row % 4 = 2 THEN concat(thickness_raw, ' ', grade_raw, ' ', color_raw, ' ', CAST(qty AS VARCHAR(20)), '''') ELSE concat('2 T/L ', thickness_raw, ' ', grade_raw, ' RGH') END
FROM {fx_products_raw}
UNION ALL SELECT o_orderkey, CAST(n AS BIGINT), split_part(concat('Mill ', CAST(o_orderkey % 50 AS VARCHAR(20)), ' Lumber Co.|Email: sales@mill.example.com|Ph: 555-123-4567|Springfield, PA 12345|STOCK LIST'), '|', n + 1)
FROM {orders} CROSS JOIN (SELECT 0 AS n
UNION ALL SELECT 1
UNION ALL SELECT 2
UNION ALL SELECT 3
UNION ALL SELECT 4) k
""",
    "fx_grid": """
SELECT upload_id, CAST(t AS INT) AS table_no, CAST(0 AS INT) AS row, CAST(k AS INT) AS col, CASE k WHEN 0 THEN 'Thickness' WHEN 1 THEN concat(species_raw, ' Grade') WHEN 2 THEN 'Color' WHEN 3 THEN 'Qty (BF)' ELSE 'Length' END AS value
FROM (SELECT DISTINCT upload_id, species_raw, ascii(species_raw) AS t FROM {fx_products_raw}) h CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c
UNION ALL SELECT upload_id, CAST(ascii(species_raw) AS INT), CAST(source_row AS INT), CAST(k AS INT), CASE WHEN k = 0 AND is_flagged = 0 THEN thickness_raw WHEN k = 1 AND is_flagged = 0 THEN grade_raw WHEN k = 2 THEN color_raw WHEN k = 3 THEN CASE qty % 500 WHEN 0 THEN 't/l' WHEN 100 THEN 'Call for tally' WHEN 200 THEN concat('approx. ', CAST(qty AS VARCHAR(20))) WHEN 300 THEN 'some' ELSE CAST(qty AS VARCHAR(20)) END WHEN k = 4 AND qty % 300 = 0 THEN '8-10' END
FROM {fx_products_raw} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c
""",
    "fx_uploads": """
SELECT o_orderkey AS id, CAST(o_orderkey % 25 AS BIGINT) AS group_id, concat('list_', CAST(o_orderkey AS VARCHAR(20)), CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.csv' ELSE '.txt' END) AS original_filename, o_custkey AS user_id, CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'failed' ELSE 'parsed' END AS status, o_orderdate AS uploaded_at
FROM {orders}
""",
    "fx_users": """
SELECT c_custkey AS id, concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') AS email, c_name AS display_name, CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'user' END AS role, CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END AS INT) AS is_active, CAST(CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS INT) AS is_suspended, TIMESTAMP '2024-01-01 00:00:00' - c_custkey % 60 * INTERVAL '1' DAY AS created_at
FROM {customer}
""",
    "fx_groups": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(n_name) AS slug, CAST(CASE WHEN n_nationkey % 7 = 6 THEN 0 ELSE 1 END AS INT) AS is_active
FROM {nation}
""",
    "fx_memberships": """
SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS group_id, c_custkey AS user_id, CASE c_custkey % 10 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' END AS role
FROM {customer} WHERE c_custkey % 9 <> 8
""",
    "fx_activity": """
SELECT event_id AS id, user_id, CAST(user_id % 25 AS BIGINT) AS group_id, event_type AS action, props AS details, ts AS created_at
FROM {events}
""",
    "fx_sessions": """
SELECT event_id AS id, user_id, ts AS created_at, ts + INTERVAL '72' HOUR AS expires_at
FROM {events} WHERE event_type = 'signup'
""",
    "fx_attempts": """
SELECT event_id AS id, concat('10.0.0.', CAST(user_id % 8 AS VARCHAR(20))) AS ip, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed
FROM {events}
""",
    "fx_searches": """
SELECT event_id AS id, user_id, CAST(user_id % 25 AS BIGINT) AS group_id, split_part('red oak|4/4 maple|walnut steamed|fas|#1c ash|kiln dried pine', '|', CAST(event_id % 6 AS INT) + 1) AS query, ts AS searched_at
FROM {events} WHERE event_type = 'view'
""",
    "fx_mills": """
SELECT s_suppkey AS id, CAST(s_suppkey % 25 AS BIGINT) AS group_id, concat('Mill ', CAST(s_suppkey AS VARCHAR(20))) AS name
FROM {supplier}
""",
    "fx_invitations": """
SELECT c_custkey AS id, CAST((c_nationkey + 1) % 25 AS BIGINT) AS group_id, concat(CASE WHEN c_custkey % 2 = 0 THEN 'USER' ELSE 'user' END, CAST(c_custkey AS VARCHAR(20)), '@example.com') AS email, concat('tok', CAST(c_custkey AS VARCHAR(20))) AS token, CASE c_custkey % 4 WHEN 0 THEN 'revoked' WHEN 1 THEN 'accepted' ELSE 'pending' END AS status, TIMESTAMP '2024-01-15 00:00:00' + c_custkey % 40 * INTERVAL '1' DAY AS expires_at
FROM {customer} WHERE c_custkey % 3 = 0
""",
    "fx_products": """
SELECT id, group_id, upload_id, mill_id, mill_name, nullif(species_raw, '') AS species, nullif(thickness_raw, '') AS thickness, nullif(grade_raw, '') AS grade, nullif(color_raw, '') AS color, concat(thickness_raw, ' ', species_raw, ' ', grade_raw) AS product, CASE WHEN qty % 700 = 0 THEN NULL ELSE CAST(qty AS DOUBLE) END AS quantity_numeric, CAST(qty AS VARCHAR(20)) AS quantity, CAST(id % 101 AS DOUBLE) / 100 AS confidence, is_flagged, is_reviewed, source_row, created_at
FROM {fx_products_raw}
""",
}


def _reads(name: str) -> list[str]:
    return sorted({part.split("}")[0] for part in VIEWS[name].split("{")[1:]})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or one of the driver's tables. Timestamps are without a zone, as the driver's are."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spark.sql(VIEWS[name], **{t: view(spark, sf_dir, t) for t in _reads(name)})
    return df.select(*[df[c].cast("timestamp_ntz") if kind == "timestamp" else df[c] for c, kind in df.dtypes])


def with_views(names: str, sql: str) -> str:
    """`sql` behind common table expressions of the views named (those they read come first)."""
    order: list[str] = []

    def add(name: str) -> None:
        for t in _reads(name):
            if t in VIEWS:
                add(t)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    plain = {n: VIEWS[n].format(**{t: t for t in _reads(n)}).strip() for n in order}
    return "WITH " + ",\n".join(f"{n} AS ({plain[n]})" for n in order) + "\n" + sql
