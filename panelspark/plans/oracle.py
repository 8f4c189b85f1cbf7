"""SQL building blocks for the checks: the same panels, written independently for DuckDB."""

from __future__ import annotations

import re

_PANEL = """
SELECT {name} AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
  floor((CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6) * 1e4 + 0.5) / 1e4 AS REVENUE,
  CAST(count(*) AS DOUBLE) AS ORDERS,
  floor((100.0::DOUBLE * sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) / count(*)) * 1e4 + 0.5) / 1e4 AS URGENT,
  floor((CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1e3) * 1e4 + 0.5) / 1e4 AS BALANCE,
  floor((CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1e4) * 1e4 + 0.5) / 1e4 AS AVGVAL
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2
"""

CTES: dict[str, str] = {
    "panel": _PANEL.format(name="r_name"),
    "npanel": _PANEL.format(name="n_name"),
    "plong": "SELECT entity, indicator, ts, value FROM (UNPIVOT panel ON REVENUE, ORDERS, URGENT, BALANCE, AVGVAL "
             "INTO NAME indicator VALUE value)",
    "epanel": "SELECT event_type AS entity, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS EVENTS, "
              "floor((CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*)) * 1e4 + 0.5) / 1e4 AS AVGVALUE "
              "FROM events GROUP BY 1, 2",
    "egrid": "SELECT e AS entity, g AS ts, EVENTS, AVGVALUE FROM (SELECT entity AS e, unnest(generate_series(min(ts), "
             "max(ts), INTERVAL 1 HOUR)) AS g FROM epanel GROUP BY entity) LEFT JOIN epanel ON e = entity AND g = ts",
    "spanel": "SELECT n_name AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, "
              "CAST(sum(l_quantity) AS DOUBLE) AS QUANTITY, "
              "floor((CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6) * 1e4 + 0.5) / 1e4 AS PRICE, "
              "floor((100.0::DOUBLE * CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*)) * 1e4 + 0.5) / 1e4 AS DISCOUNT "
              "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
}


def define(name: str, sql: str) -> None:
    """Add a named building block; later ones may use earlier ones."""
    CTES[name] = sql.strip()


def _needs(sql: str) -> set[str]:
    found: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", pending.pop()))
        new = [n for n in CTES if n in words and n not in found]
        found.update(new)
        pending += [CTES[n] for n in new]
    return found


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the building blocks it uses. ``sql`` may itself start with WITH."""
    body = sql.strip()
    blocks = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in CTES if n in _needs(body)]
    if not blocks:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(blocks) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(blocks) + ",\n" + body[5:]
    return "WITH " + ",\n".join(blocks) + "\n" + body


def r(expr: str, digits: int = 6) -> str:
    """Rounded half up to ``digits`` in plain floating-point steps, without negative zero."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits} + 0.0::DOUBLE)"


def t_two_sided(t: str, df: str) -> str:
    """Two-sided t tail for integer degrees of freedom, as the finite trigonometric series."""
    cos2 = f"({df} / ({df} + ({t}) * ({t})))"
    sin = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))"
    odd = (f"(2 / pi()) * (atan(abs({t}) / sqrt({df})) + {sin} * coalesce(list_sum(list_transform(range(0, CAST(({df} - 1) // 2 AS BIGINT)), "
           f"lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow({cos2}, j + 0.5))), 0))")
    even = (f"{sin} * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), "
            f"lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({cos2}, j)))")
    return f"(1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 1 THEN {odd} ELSE {even} END)"


def chi2_even(x: str, df: int) -> str:
    return (f"exp(-({x}) / 2) * list_sum(list_transform(range(0, {df // 2}), "
            f"lambda i: pow(({x}) / 2, i) / factorial(CAST(i AS INTEGER))))")
