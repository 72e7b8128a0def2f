"""Independent SQL for the stand-in tables and shared steps of the checks."""

from __future__ import annotations

import re

from takeup.plans import standins as S


def uniform(text: str) -> str:
    return f"(('0x'||substr(md5({text}),1,8))::BIGINT/4294967296.0)"


def rounded(expr: str, digits: int = 4) -> str:
    return f"floor(({expr})*1e{digits}+0.5)/1e{digits}"


def _types(template: str) -> str:
    return ", ".join(template.format(t=t, low=t.lower()) for t in S.TYPES)


_CROSS = ", ".join(
    f"sum(q) FILTER (WHERE p_brand='Brand#{k}' AND p_type='{t}')::DOUBLE AS num_feature_bt_{k}_{t.lower()}"
    for k in range(1, 26) for t in S.TYPES)
_BRAND = ", ".join(f"sum(q) FILTER (WHERE p_brand='Brand#{k}')::DOUBLE AS num_feature_b_{k}" for k in range(1, 26))
_TYPE = _types("sum(cents) FILTER (WHERE p_type='{t}')/(count(*) FILTER (WHERE p_type='{t}')*100.0) AS num_feature_t_{low}")
_TESTS = ([f"o_orderpriority='{p}'" for p in S.PRIORITIES] + [f"p_type='{t}'" for t in S.TYPES]
          + [f"l_returnflag='{f}'" for f in S.FLAGS]
          + ["true", "p_brand='Brand#1' AND p_type='ECONOMY'",
             "p_brand='Brand#1' AND p_type='ECONOMY' AND p_size>40", "false"])
_TARGETS = ", ".join(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) AS {t}" for t, c in zip(S.TARGETS, _TESTS))
_T0 = ", ".join(f"coalesce({t},0)::INTEGER AS {t}" for t in S.TARGETS)
_LIST = ", ".join(f"({i},'{t}')" for i, t in enumerate(S.TARGETS))

CTES: dict[str, str] = {
    "lines": """SELECT l.*, o.*, p.*, l_quantity::BIGINT AS q,
        floor(l_extendedprice*100+0.5)::BIGINT AS cents,
        o_orderdate < TIMESTAMP '2001-01-01' AS past
      FROM lineitem l JOIN orders o ON l_orderkey=o_orderkey JOIN part p ON l_partkey=p_partkey""",
    "main": f"""SELECT c_custkey AS customer_id,
        CASE WHEN substr(md5(c_custkey||'-split'),1,1) IN ('0','1','2') THEN 'test' ELSE 'train' END AS split,
        c_mktsegment AS cat_1, c_nationkey AS cat_2, n_regionkey AS cat_3, cat_4,
        CASE WHEN {uniform("c_custkey||'-c5'")} >= 0.1 THEN brand END AS cat_5,
        c_acctbal AS num_1, num_2, num_3, num_4, num_5, num_6, num_7, num_8
      FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey
      LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS num_2, sum(floor(o_totalprice*100+0.5))/100.0 AS num_3
                 FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1) a ON a.o_custkey=c_custkey
      LEFT JOIN (SELECT o_custkey, o_orderpriority AS cat_4 FROM (
                   SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) r
                   FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1,2) WHERE r=1) b ON b.o_custkey=c_custkey
      LEFT JOIN (SELECT o_custkey, sum(q)::BIGINT/count(*) AS num_4,
                   sum(floor(l_discount*100+0.5)::BIGINT)::BIGINT/count(*)/100.0 AS num_5, max(l_extendedprice) AS num_6,
                   count(DISTINCT l_partkey)::DOUBLE AS num_7, sum(floor(l_tax*100+0.5)::BIGINT)::BIGINT/count(*)/100.0 AS num_8
                 FROM lines WHERE past GROUP BY 1) d ON d.o_custkey=c_custkey
      LEFT JOIN (SELECT o_custkey, p_brand AS brand FROM (
                   SELECT o_custkey, p_brand, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(q) DESC, p_brand) r
                   FROM lines WHERE past GROUP BY 1,2) WHERE r=1) e ON e.o_custkey=c_custkey""",
    "extra": f"""SELECT c_custkey AS customer_id, h.* EXCLUDE (o_custkey), 1.0::DOUBLE AS num_feature_const
      FROM customer LEFT JOIN (SELECT o_custkey, {_BRAND}, {_TYPE}, {_CROSS} FROM lines WHERE past GROUP BY 1) h
      ON h.o_custkey=c_custkey""",
    "target": f"""SELECT c_custkey AS customer_id, {_T0} FROM customer
      LEFT JOIN (SELECT o_custkey, {_TARGETS} FROM lines WHERE NOT past GROUP BY 1) f ON f.o_custkey=c_custkey""",
    "splits": """SELECT c_custkey AS customer_id,
        CASE WHEN substr(md5(c_custkey||'-split'),1,1) IN ('0','1','2') THEN 'test' ELSE 'train' END AS split FROM customer""",
    "train_target": "SELECT t.* FROM target t JOIN splits USING (customer_id) WHERE split='train'",
    "train_extra": "SELECT e.* FROM extra e JOIN splits USING (customer_id) WHERE split='train'",
    "folds": f"""SELECT customer_id, stratum, ((row_number() OVER (PARTITION BY stratum
          ORDER BY md5(customer_id||'-42'), customer_id) - 1) % 5)::INTEGER AS fold
      FROM (SELECT customer_id, (greatest({", ".join(S.TARGETS)}) > 0)::INTEGER AS stratum FROM train_target)""",
    "names": f"SELECT * FROM (VALUES {_LIST}) v(ord, target)",
    "long_target": f"SELECT * FROM target UNPIVOT (y FOR target IN ({', '.join(S.TARGETS)}))",
    "score": f"""SELECT customer_id, model, target, y,
        floor((a*y + (1-a)*{uniform("customer_id||'-'||model||'-'||target")})*100+0.5)/100.0 AS score
      FROM long_target, (VALUES {", ".join(f"('{m}',{a}::DOUBLE)" for m, a in S.MODELS.items())}) v(model, a)
      WHERE {uniform("customer_id||'-'||model||'-drop'")} >= 0.02""",
    "aligned": """SELECT customer_id, split, model, target, t.y, coalesce(score, 0.5) AS score
      FROM long_target t JOIN splits USING (customer_id)
      CROSS JOIN (VALUES ('m1'),('m2'),('m3'),('m4')) v(model)
      LEFT JOIN (SELECT customer_id, model, target, score FROM score) s USING (customer_id, model, target)""",
    "ranked": """SELECT *, 2*rank() OVER (PARTITION BY split, model, target ORDER BY score)
          + count(*) OVER (PARTITION BY split, model, target, score) - 1 AS rank2,
        count(*) OVER (PARTITION BY split, model, target) AS n FROM aligned""",
    "wide_ranks": """SELECT customer_id, split, target, max(y) AS y, max(n) AS n,
        max(rank2) FILTER (WHERE model='m1') AS r1, max(rank2) FILTER (WHERE model='m2') AS r2,
        max(rank2) FILTER (WHERE model='m3') AS r3, max(rank2) FILTER (WHERE model='m4') AS r4
      FROM ranked GROUP BY 1,2,3""",
    "template": """SELECT customer_id FROM splits WHERE split='test' UNION ALL SELECT -1""",
    "solo_auc": """SELECT model, target, CASE WHEN p>0 AND p<n THEN (s2/2.0 - p*(p+1)/2.0)/(p*(n-p)) END AS auc
      FROM (SELECT model, target, sum(y)::BIGINT AS p, count(*) AS n, (sum(rank2) FILTER (WHERE y=1))::BIGINT AS s2
            FROM ranked WHERE split='train' GROUP BY 1,2)""",
    "extra_cells": f"""SELECT e.customer_id, f.ord, e.feature, e.x FROM
        (SELECT * FROM train_extra UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(S.EXTRAS)}))) e
        JOIN (VALUES {', '.join(f"({k},'{c}')" for k, c in enumerate(S.EXTRAS))}) f(ord, feature) USING (feature)""",
    "corr": f"""SELECT ord, feature, target, CASE WHEN sx < 1e-8 THEN 0.0 ELSE abs(c/(sx*CASE WHEN sy < 1e-8 THEN 1.0 ELSE sy END)) END AS corr
      FROM (SELECT ord, feature, target, covar_pop(coalesce(x,0), y) AS c, stddev_pop(coalesce(x,0)) AS sx, stddev_pop(y) AS sy
            FROM extra_cells JOIN long_target USING (customer_id) GROUP BY 1,2,3)""",
}


def cte(*names: str, **own: str) -> str:
    """``WITH`` clause of the named tables, their dependencies and the caller's own."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", CTES[name])):
            if word in CTES and word != name:
                visit(word)
        order.append(name)

    for n in names:
        visit(n)
    for text in own.values():
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)):
            if word in CTES:
                visit(word)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({t})" for n, t in own.items()]
    return "WITH " + ",\n".join(parts) + "\n"
