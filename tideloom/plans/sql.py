"""DuckDB SQL that says the same as the indicator functions, built in layers:
each layer is a common table expression that adds columns to the one before."""

from __future__ import annotations

DAYS = """t AS (
  SELECT l_returnflag AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / 997 AS p, l_quantity AS q, l_orderkey, l_linenumber
  FROM lineitem
), bars AS (
  SELECT symbol, ts, first(p ORDER BY l_orderkey, l_linenumber, p) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_orderkey, l_linenumber, p) AS close, sum(q) AS volume
  FROM t GROUP BY symbol, ts
)"""


def pairs(portfolio: str) -> str:
    """Daily bars whose symbol is a portfolio and a return flag, with a slash between."""
    return f"""t AS (
  SELECT concat({portfolio}, '/', l_returnflag) AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / 997 AS p, l_quantity AS q, l_orderkey, l_linenumber FROM lineitem
), bars AS (
  SELECT symbol, ts, first(p ORDER BY l_orderkey, l_linenumber, p) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY l_orderkey, l_linenumber, p) AS close, sum(q) AS volume FROM t GROUP BY symbol, ts
)"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORDER = "OVER (PARTITION BY symbol ORDER BY ts)"


def agg(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {f}({x}) {over(n)} END"


def mean(x: str, n: int) -> str:
    return agg("avg", x, n)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {ORDER}" if n >= 0 else f"lead({x}, {-n}) {ORDER}"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def values(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN list({x}) {over(n)} END"


def weighted(x: str, weights) -> str:
    n = len(weights)
    return "(" + " + ".join(f"{w} * ({lag(x, n - 1 - i)})" for i, w in enumerate(weights)) + ")"


class Sql:
    """Layers over a source; ``put`` adds one, ``ema`` the three an average takes."""

    def __init__(self, source: str = DAYS, table: str = "bars"):
        self.text, self.table, self.n = "WITH RECURSIVE " + source, table, 0

    def put(self, **columns: str) -> Sql:
        self.n += 1
        name = f"s{self.n}"
        cells = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        self.text += f", {name} AS (SELECT *, {cells} FROM {self.table})"
        self.table = name
        return self

    def ema(self, x: str, n: int, out: str, alpha: float | None = None) -> Sql:
        """Seeded average: in closed form, or row by row where the weights, which
        grow with the length, would leave the range of numbers within some
        thousand rows."""
        a = 2.0 / (n + 1) if alpha is None else alpha
        self.put(**{f"{out}_k": f"CASE WHEN {x} IS NOT NULL THEN count({x}) {SO_FAR} END"})
        self.put(**{f"{out}_s": f"avg(CASE WHEN {out}_k <= {n} THEN {x} END) OVER (PARTITION BY symbol)"})
        if a > 0.2:
            seed = f"CASE WHEN b.{out}_k = {n} THEN b.{out}_s"
            step = f"WHEN b.{out}_k IS NULL THEN r.{out}_r WHEN b.{out}_k > {n} THEN {a!r} * b.{x} + {1 - a!r} * r.{out}_r"
            return self.scan({f"{out}_r": f"{seed} END"}, {f"{out}_r": f"{seed} {step} END"}).put(**{out: f"CASE WHEN {out}_k >= {n} THEN {out}_r END"})
        k = f"({out}_k - {n})"
        total = f"sum(CASE WHEN {out}_k > {n} THEN {a!r} * {x} * pow({1 - a!r}, -{k}) ELSE 0 END) {SO_FAR}"
        return self.put(**{out: f"CASE WHEN {out}_k >= {n} THEN pow({1 - a!r}, {k}) * ({out}_s + {total}) END"})

    def smma(self, x: str, n: int, out: str) -> Sql:
        return self.ema(x, n, out, 1.0 / n)

    def scan(self, first: dict[str, str], step: dict[str, str]) -> Sql:
        """Columns that depend on their own last value: ``first`` over the first
        row b of a symbol, ``step`` over the last state r and the row b."""
        self.put(_n=f"row_number() {ORDER}")
        self.n += 1
        a, r, out = f"a{self.n}", f"r{self.n}", f"s{self.n}"
        cells = lambda d: ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in d.items())
        self.text += f", {a} AS MATERIALIZED (SELECT * FROM {self.table})"
        self.text += f", {r} AS (SELECT b.symbol, b._n, {cells(first)} FROM {a} b WHERE b._n = 1 UNION ALL SELECT b.symbol, b._n, {cells(step)} FROM {r} r JOIN {a} b ON b.symbol = r.symbol AND b._n = r._n + 1)"
        self.text += f", {out} AS (SELECT b.*, {', '.join(f'r.{c}' for c in first)} FROM {a} b JOIN {r} r ON b.symbol = r.symbol AND b._n = r._n)"
        self.table = out
        return self

    def select(self, *columns: str, digits: int = 4) -> str:
        cells = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
        return f"{self.text} SELECT symbol, ts, {cells} FROM {self.table}"


def cross(s: Sql, x: str, y: str, out: str) -> Sql:
    """Columns out_up, out_down and out: where x comes to be above or below y."""
    s.put(_z=f"CASE WHEN {x} - {y} IS NOT NULL THEN coalesce(last_value(nullif({x} - {y}, 0) IGNORE NULLS) {SO_FAR}, 0) END").put(_before=lag("_z"))
    there = "_before IS NOT NULL AND _z IS NOT NULL"
    s.put(**{f"{out}_up": f"CASE WHEN {there} THEN CASE WHEN _before < 0 AND {x} > {y} THEN 1.0 ELSE 0.0 END END", f"{out}_down": f"CASE WHEN {there} THEN CASE WHEN _before > 0 AND {x} < {y} THEN 1.0 ELSE 0.0 END END"})
    return s.put(**{out: f"{out}_up - {out}_down"})
