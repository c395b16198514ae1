"""The measurement tables, derived from the star schema by SQL that Spark and DuckDB both run.

``Domain`` gives them as DataFrames; ``oracle`` puts the same derivations in front of a query as common
table expressions, so that an operator and its SQL counterpart start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "benchmark")

#: name -> SQL over raw tables and earlier names. MICROS(x) stands for the engine's epoch microseconds.
DERIVED: dict[str, str] = {
    "items": """
        SELECT CAST(row_number() OVER (ORDER BY p_type, p_size) - 1 AS INT) AS item_idx, p_type || '#' || CAST(p_size AS STRING) AS item_id,
               p_type AS subtask, p_size, 0.5e0 + (p_size % 7) / 4e0 AS a, (p_size - 25) / 12.5e0 AS b,
               CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 0 ELSE 1 END AS dim
        FROM (SELECT DISTINCT p_type, p_size FROM part) p""",
    "responses": """
        SELECT l_suppkey AS model_idx, 'model-' || CAST(l_suppkey AS STRING) AS model, i.item_idx, i.item_id, i.subtask, i.dim, i.a, i.b,
               CAST(max(CASE WHEN l_returnflag = 'N' AND (l_partkey + l_suppkey) % 3 > 0 THEN 1 ELSE 0 END) AS INT) AS y
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN items i ON p_type = i.subtask AND part.p_size = i.p_size
        GROUP BY l_suppkey, i.item_idx, i.item_id, i.subtask, i.dim, i.a, i.b""",
    "ev": """
        SELECT event_id, user_id, event_type, value, MICROS(ts) / 1e6 AS t_s, MICROS(ts) AS micros,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
               'run' || CAST(user_id % 3 AS STRING) || ':m' || CAST(user_id AS STRING) AS session_id, 'i' || CAST(event_id % 97 AS STRING) AS item_id
        FROM events""",
    "log": """
        SELECT session_id, step, 'item_selected' AS type, item_id, CAST(NULL AS INT) AS correct, CAST(NULL AS INT) AS cached, CAST(NULL AS DOUBLE) AS cost, t_s FROM ev
        UNION ALL SELECT session_id, step, 'answer_recorded', item_id, CASE WHEN value > 30 THEN 1 ELSE 0 END, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END,
               CASE WHEN event_id % 4 = 0 THEN 0e0 ELSE value / 1000e0 END, t_s + 0.5e0 FROM ev WHERE event_type <> 'error'
        UNION ALL SELECT session_id, step, 'allocation', item_id, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE), t_s FROM ev WHERE event_id % 5 = 0""",
    "sessions": """
        SELECT session_id, 'run' || CAST(user_id % 3 AS STRING) AS run_name, 'm' || CAST(user_id AS STRING) AS model,
               CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider,
               CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN user_id % 5 = 0 THEN 'running' ELSE 'done' END AS status,
               min(t_s) AS started_at, max(t_s) AS finished_at
        FROM ev GROUP BY session_id, user_id""",
    "attempts": """
        SELECT session_id || ':' || CAST(step AS STRING) AS job_id, CAST(k AS INT) AS attempt, session_id, 'm' || CAST(user_id AS STRING) AS model, item_id,
               event_id % 5 = 0 AS speculative, CASE WHEN event_type <> 'error' OR k = 1 THEN 'ok' WHEN event_id % 2 = 0 THEN 'transient' ELSE 'fatal' END AS status,
               value + k AS latency, event_id % 900 AS tokens, value / 1000e0 AS cost, micros, event_id
        FROM ev CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) n WHERE k = 0 OR (event_type = 'error' AND event_id % 2 = 0) OR event_id % 10 = 0""",
    "cache": """
        SELECT 'm' || CAST(user_id AS STRING) || '/' || item_id AS key, min(event_id) AS first_event, min(t_s) AS created_at FROM ev WHERE event_type <> 'error' GROUP BY 1""",
    "providers": """
        SELECT * FROM (VALUES ('alpha', 600e0, 90000e0, 0.5e0, 3e0, 0.0025e0, 0.01e0, 850e0), ('beta', 50e0, 30000e0, 0.2e0, 1e0, 0.001e0, 0.005e0, 600e0), ('gamma', 1200e0, 200000e0, 1e0, 6e0, 0.0005e0, 0.0015e0, 900e0))
        AS p(provider, rpm, tpm, lat_lo, lat_hi, usd_in, usd_out, est_tokens)""",
    "heights": """
        SELECT p_partkey DIV 9 AS scene, CAST(p_partkey % 9 DIV 3 AS INT) AS x, CAST(p_partkey % 3 AS INT) AS y, p_size % 4 AS h FROM part""",
    "replies": """
        SELECT conv_id, turn, role, text || CASE conv_id % 5 WHEN 0 THEN ' I first saw 5, but it is ' || CAST(turn AS STRING) || '.' WHEN 1 THEN ' three' WHEN 2 THEN ' so: Red' ELSE '' END AS reply,
               CASE WHEN conv_id % 5 < 2 THEN CAST(turn AS STRING) WHEN conv_id % 5 = 2 THEN 'red' ELSE 'the' END AS answer,
               CASE WHEN conv_id % 5 = 2 THEN 'red,blue' WHEN conv_id % 5 > 2 THEN 'the,der,le' ELSE '' END AS options
        FROM conversations""",
}


def _uses(sql: str) -> list[str]:
    return [n for n in DERIVED if re.search(rf"\b{n}\b", sql)]


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, after the derivations that it needs."""
    needed: list[str] = []

    def add(name: str) -> None:
        for n in _uses(DERIVED[name]):
            if n != name and n not in needed:
                add(n)
        if name not in needed:
            needed.append(name)

    for n in _uses(sql):
        add(n)
    text = lambda s: s.replace("MICROS(", "epoch_us(").replace(" DIV ", " // ")
    parts = [f"{n} AS ({text(DERIVED[n])})" for n in needed]
    body = text(sql).strip()
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    if body.upper().startswith("WITH"):
        rest = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", body)
        return f"WITH {recursive}{', '.join([*parts, rest])}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Domain:
    """The raw and derived tables of one folder as DataFrames (attributes and ``table(name)``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in DERIVED:
                sql = DERIVED[name].replace("MICROS(ts)", "unix_micros(CAST(ts AS TIMESTAMP))")
                names = [n for n in (*RAW, *DERIVED) if n != name and re.search(rf"\b(FROM|JOIN) {n}\b", sql)]
                for n in names:
                    sql = re.sub(rf"\b(FROM|JOIN) {n}\b(?! AS)", rf"\1 {{{n}}} {n}" if not re.search(rf"\b(FROM|JOIN) {n} [a-z]\b", sql) else rf"\1 {{{n}}}", sql)
                self._made[name] = self.spark.sql(sql, **{n: self.table(n) for n in names})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def wide(self) -> DataFrame:
        """One row for each model: items and results in the order of item_idx."""
        from pyspark.sql import functions as F

        r = self.table("responses")
        return r.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("item_idx", "y"))).alias("cells"))
