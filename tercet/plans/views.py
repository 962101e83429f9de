"""The domain views of ``tercet.sources.tables`` as DuckDB SQL, for the checking queries."""

TXN = """txn AS (SELECT CAST(l_orderkey AS VARCHAR) AS invoice, p_brand AS stock_code, p_name AS description, CAST(l_quantity AS BIGINT) AS quantity,
  l_shipdate AS ts, l_extendedprice / l_quantity AS price, o_custkey AS customer, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

PRICE_TEST = """pt0 AS (SELECT *, CAST((l_orderkey*7 + l_linenumber*3 + l_partkey) % 3 AS INTEGER) AS arm FROM lineitem JOIN part ON l_partkey = p_partkey),
pt1 AS (SELECT *, CASE arm WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.1::DOUBLE END AS m, 1.0::DOUBLE + l_quantity/50 AS w0, 1.0::DOUBLE AS w1, 1.0::DOUBLE/(1.0::DOUBLE + l_quantity/50) AS w2 FROM pt0),
pt AS (SELECT l_orderkey*10 + l_linenumber AS row_id, l_suppkey AS cluster, p_brand, arm, m, CAST(l_extendedprice/l_quantity >= p_retailprice*m AS INTEGER) AS bought,
  l_quantity AS score, l_discount*10 AS gain, w0/(w0+w1+w2) AS p0, w1/(w0+w1+w2) AS p1, w2/(w0+w1+w2) AS p2 FROM pt1)"""


def scored() -> str:
    return f"""sc0 AS (SELECT l_orderkey*10 + l_linenumber AS row_id, CASE WHEN l_quantity <= 16 THEN 2 WHEN l_quantity <= 33 THEN 1 ELSE 0 END AS y,
  round(ln(l_extendedprice/l_quantity/p_retailprice), 4) AS marker FROM lineitem JOIN part ON l_partkey = p_partkey),
sc1 AS (SELECT *, exp(-power(marker - 0.0, 2)) AS r0, exp(-power(marker - 0.5, 2)) AS r1, exp(-power(marker - 1.5, 2)) AS r2 FROM sc0),
sc AS (SELECT row_id, y, marker, r0/(r0+r1+r2) AS p0, r1/(r0+r1+r2) AS p1, r2/(r0+r1+r2) AS p2 FROM sc1)"""


EXPERIMENT = """ex0 AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'H' WHEN '5-LOW' THEN 'L' ELSE 'C' END AS arm, o_totalprice/1000 AS v FROM orders),
ex AS (SELECT o_orderkey AS quote_id, o_custkey AS customer_id, o_orderdate AS quote_timestamp, 1 AS eligible, arm, CAST(o_orderstatus <> 'P' AS INTEGER) AS purchase,
  0.2::DOUBLE AS pi_H, 0.6::DOUBLE AS pi_C, 0.2::DOUBLE AS pi_L, o_totalprice AS base_premium,
  CASE arm WHEN 'H' THEN 1.1::DOUBLE WHEN 'C' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS assigned_multiplier,
  o_totalprice * CASE arm WHEN 'H' THEN 1.1::DOUBLE WHEN 'C' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS displayed_premium,
  v*1.1::DOUBLE AS contribution_H, v AS contribution_C, v*0.9::DOUBLE AS contribution_L, ln(v+1)/10 AS risk FROM ex0)"""
