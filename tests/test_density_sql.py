"""The SQL of densities sums the kernel of every value at every point."""

from __future__ import annotations

import math
from collections import defaultdict

import duckdb
import pytest

import mailscope_oracle

NAMES = (
    "daily_status_density_received",
    "per_person_ratio_density_sent",
    "per_person_ratio_density_received",
    "active_people_density_sent",
    "active_people_density_received",
    "compare_density_sent",
)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("""CREATE TABLE customer AS SELECT i AS c_custkey, 'name' || i AS c_name, CAST(i % 7 AS INT) AS c_nationkey,
      CASE i % 3 WHEN 0 THEN 'HOUSEHOLD' WHEN 1 THEN 'MACHINERY' ELSE 'BUILDING' END AS c_mktsegment FROM range(1340, 1400) t(i)""")
    con.execute("""CREATE TABLE orders AS SELECT i AS o_orderkey, 1340 + hash(i) % 60 AS o_custkey,
      TIMESTAMP '1999-01-01' + INTERVAL 1 DAY * (hash(i + 5000) % 90) AS o_orderdate, CASE WHEN i % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus,
      'urgent' AS o_orderpriority FROM range(1, 901) t(i)""")
    con.execute("""CREATE TABLE lineitem AS SELECT 1 + hash(i + 3000) % 900 AS l_orderkey, i % 4 AS l_linenumber, 1340 + hash(i) % 60 AS l_partkey,
      1340 + hash(i + 7000) % 60 AS l_suppkey, 1 AS l_quantity, 1 AS l_extendedprice, 0 AS l_discount, 0 AS l_tax, 'R' AS l_returnflag,
      'O' AS l_linestatus, DATE '1999-01-01' AS l_shipdate FROM range(3600) t(i)""")
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'text ' || i AS text FROM range(1, 500) t(i)")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_density_sql_is_the_direct_sum(engine, name):
    sql = mailscope_oracle.statements()[name]
    values, rest = sql.split("sized AS (")
    sizes = f"sized AS ({rest.split('GROUP BY g)')[0]}GROUP BY g)"
    groups, sized = defaultdict(list), {}
    for group, value in engine.execute(f"{values.rstrip().removesuffix(',')} SELECT g, v FROM vals").fetchall():
        groups[group].append(value)
    for group, low, width, high in engine.execute(f"{values}{sizes} SELECT g, lo, bw, hi FROM sized WHERE bw > 0").fetchall():
        sized[group] = low - 3 * width, (high - low + 6 * width) / 511, width
    curve = engine.execute(sql).fetchall()
    assert sized and sorted(r[:2] for r in curve) == sorted((g, i) for g in sized for i in range(512))
    for group, point, _, found in curve:
        start, step, width = sized[group]
        z = ((start + point * step - v) / width for v in groups[group])
        direct = sum(math.exp(-0.5 * x * x) for x in z) / (len(groups[group]) * width * math.sqrt(2 * math.pi))
        assert found == pytest.approx(direct, rel=1e-9, abs=6e-10)
