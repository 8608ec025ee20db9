"""Registry of queries, and the view text put in front of every SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

VIEWS = """
tok0 AS (
  SELECT l_orderkey AS traj_id, o_custkey AS uid,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) AS t,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask,
         -(0.05 + 10*l_discount) AS old_logp, -(0.05 + 10*l_tax) AS rollout_logp, -(0.05 + l_quantity/50) AS ref_logp,
         l_quantity/100 AS value,
         CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tokens AS (
  SELECT traj_id, uid, t, mask, old_logp, rollout_logp, ref_logp, value,
         exp(old_logp)*exp(old_logp) + 0.5*(1-exp(old_logp))*(1-exp(old_logp)) AS sum_pi_sq,
         CASE WHEN t = max(CASE WHEN mask=1 THEN t END) OVER (PARTITION BY traj_id)
              THEN score ELSE CAST(0 AS DOUBLE) END AS token_reward
  FROM tok0),
lens AS (SELECT traj_id, CAST(sum(mask) AS BIGINT) AS response_len, count(*) AS n_tok FROM tokens GROUP BY traj_id),
rollouts AS (
  SELECT o_custkey AS uid, o_orderkey AS traj_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS sample_idx,
         c_mktsegment AS data_source, o_orderpriority AS pred,
         CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score,
         CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS acc,
         coalesce(response_len, 0) AS response_len, o_orderkey % 7 AS param_version
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lens ON lens.traj_id = o_orderkey),
test_records AS (
  SELECT l_orderkey AS traj_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS BIGINT) AS test_idx,
         'n = ' || l_partkey || chr(10) || 'm = ' || l_suppkey AS input,
         CAST(l_suppkey AS VARCHAR) AS expected,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_suppkey AS VARCHAR)
              WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN 'Error: ' || l_partkey
              WHEN l_returnflag = 'A' AND l_partkey % 7 = 0 THEN 'Time out'
              ELSE 'out ' || l_partkey END AS actual,
         l_linestatus = 'F' AS passed,
         CASE WHEN l_partkey % 3 = 0 THEN 'dbg ' || l_partkey ELSE '' END AS debug
  FROM lineitem)"""


@dataclass
class Catalog:
    queries: dict[str, Callable] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        """Register a query.  SQL that starts with a comma continues the view list."""

        def put(fn):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                body = sql.strip()
                self.sql[name] = f"WITH {VIEWS.strip()}{body}" if body.startswith(",") else f"WITH {VIEWS.strip()}\n{body}"
            return fn

        return put


CATALOG = Catalog()
