"""SQL of the panels, for the oracle."""

from ..settings import TARGET

ANNUAL = """annual AS (
  SELECT CAST(year(l_shipdate) AS INT) AS year, r_name AS l1, n_name AS l2, CAST(s_suppkey AS VARCHAR) AS l3, r_name || '-' || n_name || '-' || s_suppkey AS series_key,
    round(sum(l_extendedprice), 4) AS opened,
    round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax * 10 ELSE 0 END), 4) AS transfer_in,
    round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * l_discount * 5 ELSE 0 END), 4) AS transfer_out,
    round(sum(CASE WHEN l_linestatus = 'F' THEN 2 * l_extendedprice * (1 - l_discount) ELSE 0 END), 4) AS committed,
    round(round(sum(l_extendedprice), 4) + round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax * 10 ELSE 0 END), 4)
      - round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * l_discount * 5 ELSE 0 END), 4), 4) AS ceiling
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4, 5)"""
FINE = """fine0 AS (
  SELECT CAST(year(l_shipdate) AS INT) AS year, p_type AS l1, CAST(l_suppkey AS VARCHAR) AS l2, round(sum(l_extendedprice), 4) AS opened,
    round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 4) AS committed
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
fine AS (SELECT year, l1 || '-' || l2 AS series_key, l1, l2, opened, committed, CASE WHEN opened > 0 THEN committed / opened END AS rate FROM fine0)"""
MOVES = f"""moves0 AS (
  SELECT CAST(year(l_shipdate) AS INT) AS year, p_type AS l1, CAST(l_suppkey AS VARCHAR) AS l2,
    round(sum(CASE WHEN l_returnflag = 'N' THEN 1.5 * l_extendedprice ELSE 0 END), 4) AS opened,
    round(sum(CASE WHEN l_returnflag = 'R' THEN 0.5 * l_extendedprice ELSE 0 END), 4) AS transfer_in,
    round(sum(CASE WHEN l_returnflag = 'A' THEN 0.4 * l_extendedprice ELSE 0 END), 4) AS transfer_out,
    round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 4) AS committed
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) < {TARGET + 1} GROUP BY 1, 2, 3),
moves AS (SELECT year, l1 || '-' || l2 AS series_key, l1, l2, opened, transfer_in, transfer_out, committed, round(opened + transfer_in - transfer_out, 4) AS ceiling FROM moves0)"""
QUARTERS = """quarters0 AS (
  SELECT r_name AS category, CAST(s_suppkey AS VARCHAR) AS series_key, CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS quarter,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS amount, round(sum(l_extendedprice), 4) AS lf
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4),
quarters1 AS (SELECT *, round(sum(lf) OVER (PARTITION BY series_key, year), 4) AS annual, sum(amount) OVER (PARTITION BY series_key, year ORDER BY quarter) AS cum FROM quarters0),
quarters AS (SELECT category, series_key, year, quarter, amount, annual, round(cum / annual, 6) AS taux FROM quarters1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n"
