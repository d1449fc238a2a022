"""Entities, relationships and composed texts derived from the base tables.

The same SQL runs in Spark and in the oracle, so that both see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinledger.sources.scratch import sql_over

ENTITIES = """
SELECT concat('C', CAST(c_custkey AS STRING)) AS entity_id,
       concat(p_name, ' ', CASE c_custkey % 6 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Inc.' WHEN 2 THEN 'Corporation'
              WHEN 3 THEN 'Ltd' WHEN 4 THEN 'Holdings Ltd' ELSE 'GmbH' END) AS name,
       'COMPANY' AS entity_type,
       concat(CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING), ' Main Street, New York, NY') AS address,
       concat(lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 90 + 10 AS STRING), 2, '0'), '-',
              lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) * 7919 % 10000000 AS STRING), 7, '0')) AS ein,
       CASE c_nationkey % 4 WHEN 0 THEN 'Panama' WHEN 1 THEN 'Delaware' WHEN 2 THEN 'Iran' ELSE NULL END AS jurisdiction,
       CAST(100 - c_custkey % 10 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM customer JOIN part ON p_partkey = c_custkey
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)), s_name, 'INDIVIDUAL', NULL, NULL, NULL, CAST(1 AS DOUBLE) FROM supplier
UNION ALL
SELECT concat('G', CAST(n_nationkey AS STRING)), n_name, 'GOVERNMENT', NULL, NULL, NULL, CAST(1 AS DOUBLE) FROM nation
"""

RELATIONSHIPS = """
SELECT concat('o', CAST(c_custkey AS STRING)) AS relationship_id,
       concat('C', CAST(CAST(floor((c_custkey - 1) / 2) AS BIGINT) AS STRING)) AS source_entity_id,
       concat('C', CAST(c_custkey AS STRING)) AS target_entity_id, 'OWNS' AS relationship_type,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(30 + c_custkey * 37 % 71 AS DOUBLE) END AS ownership_pct
FROM customer WHERE c_custkey > 0
UNION ALL
SELECT concat('k', CAST(c_custkey AS STRING)), concat('C', CAST(c_custkey AS STRING)),
       concat('C', CAST(CAST(floor((floor((c_custkey - 1) / 2) - 1) / 2) AS BIGINT) AS STRING)), 'CONTROLS', CAST(60 AS DOUBLE)
FROM customer WHERE c_custkey >= 3 AND c_custkey % 50 = 0
UNION ALL
SELECT concat('h', CAST(o_custkey AS STRING)), concat('S', CAST(min(l_suppkey) AS STRING)),
       concat('C', CAST(o_custkey AS STRING)), 'SHAREHOLDER_OF', CAST(25 + o_custkey % 76 AS DOUBLE)
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey
UNION ALL
SELECT DISTINCT concat('d', CAST(l_suppkey AS STRING), '_', CAST(o_custkey AS STRING)), concat('S', CAST(l_suppkey AS STRING)),
       concat('C', CAST(o_custkey AS STRING)), 'DIRECTOR_OF', CAST(NULL AS DOUBLE)
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 20 = 0 AND l_linenumber = 1
"""

ENTITY_DOCS = """
SELECT c_custkey AS doc_id,
       concat('Notice: Acme', CASE c_custkey % 3 WHEN 0 THEN ' Corp' WHEN 1 THEN ' LLC' ELSE ' Limited' END,
              ', EIN ', lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey AS STRING), 7, '0'),
              ', is run by John Smith at 12 Oak Street. Write to desk', CAST(c_custkey AS STRING), '@example.com or 555-123-4567.') AS text
FROM customer
"""

VIEWS = {"entities": ENTITIES, "relationships": RELATIONSHIPS, "entity_docs": ENTITY_DOCS}
BASES = {
    "entities": ("customer", "part", "supplier", "nation"),
    "relationships": ("customer", "orders", "lineitem"),
    "entity_docs": ("customer",),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql_over(spark, VIEWS[name], **{t: base(spark, sf_dir, t) for t in BASES[name]})


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the views as common table expressions; ``sql`` may begin with more of them."""
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"
