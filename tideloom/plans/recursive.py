"""DuckDB SQL for the recursive indicators that have no closed form."""

from __future__ import annotations

from .sql import ORDER, SO_FAR, Sql, agg, lag, mean, values, weighted


def kama(s: Sql, out: str = "v", stepped: bool = False, n: int = 30) -> Sql:
    """From value n + 1 on: first the mean of the last n or, stepped, a step from
    the mean of the first n."""
    s.put(_k=f"count(close) {SO_FAR}", _d=f"abs(close - {lag('close')})").put(_path=agg("sum", "_d", n), _mean=mean("close", n), _far=f"abs(close - {lag('close', n)})").put(_early=lag("_mean"))
    s.put(_sc=f"pow(CASE WHEN _path > 0 THEN _far / _path ELSE 0 END * ({2 / 3!r} - {2 / 31!r}) + {2 / 31!r}, 2)")
    start = "b._early + b._sc * (b.close - b._early)" if stepped else "b._mean"
    return s.scan({out: "NULL"}, {out: f"CASE WHEN b._k = {n + 1} THEN {start} WHEN b._k > {n + 1} THEN r.{out} + b._sc * (b.close - r.{out}) END"})


def zero_lag(s: Sql, out: str = "v", n: int = 30, limit: int = 50) -> Sql:
    """The average whose gain, a tenth of a whole number, comes nearest to the value."""
    a = 2.0 / (n + 1)
    s.ema("close", n, "_e")
    new = f"({a!r} * (b._e + g / 10.0 * (b.close - r.{out})) + {1 - a!r} * r.{out})"
    best = f"list_min(list_transform(range({-limit}, {limit + 1}), lambda g: {{'d': abs(b.close - {new}), 'g': g, 'v': {new}}})).v"
    return s.scan({out: "NULL"}, {out: f"CASE WHEN b._e IS NULL THEN NULL WHEN r.{out} IS NULL THEN b._e ELSE {best} END"})


def dickson(s: Sql) -> str:
    w = lambda x, n: f"({weighted(x, range(1, n + 1))} * {2.0 / (n * (n + 1))})"
    zero_lag(s, "_ec").put(_x=f"2 * {w('close', 3)} - {w('close', 7)}").put(v=f"(_ec + {w('_x', 2)}) / 2")
    return s.select("v")


def laguerre(s: Sql, g: float = 0.5, n: int = 6) -> str:
    l0 = f"({1 - g} * b.close + {g} * r.l0)"
    l1 = f"({-g} * {l0} + r.l0 + {g} * r.l1)"
    l2 = f"({-g} * {l1} + r.l1 + {g} * r.l2)"
    l3 = f"({-g} * {l2} + r.l2 + {g} * r.l3)"
    on = lambda x: f"CASE WHEN b._n >= {n} THEN {x} ELSE 0 END"
    s.scan({f"l{i}": "0" for i in range(4)}, {f"l{i}": on(x) for i, x in enumerate((l0, l1, l2, l3))})
    s.put(_up="greatest(l0 - l1, 0) + greatest(l1 - l2, 0) + greatest(l2 - l3, 0)", _down="greatest(l1 - l0, 0) + greatest(l2 - l1, 0) + greatest(l3 - l2, 0)")
    return s.put(lagf=f"CASE WHEN _n >= {n} THEN (l0 + 2 * l1 + 2 * l2 + l3) / 6 END", lrsi=f"CASE WHEN _n >= {n} THEN CASE WHEN _up + _down = 0 THEN 1.0 ELSE _up / (_up + _down) END END").select("lagf", "lrsi")


def parabolic(s: Sql, step: float = 0.02, most: float = 0.2) -> str:
    """State: stop, side, extreme point, factor. The stop may not pass the last two bars."""
    s.put(_h1=lag("high"), _h2=lag("high", 2), _l1=lag("low"), _l2=lag("low", 2), _c1=lag("close"))
    nxt = "(r.sar + r.af * (r.ep - r.sar))"
    rise = f"least({nxt}, b._l1, coalesce(b._l2, b._l1))"
    fall = f"greatest({nxt}, b._h1, coalesce(b._h2, b._h1))"
    up = "b.close >= b._c1"
    turn = f"((r.side > 0 AND b.low < {rise}) OR (r.side < 0 AND b.high > {fall}))"
    far = "((r.side > 0 AND b.high > r.ep) OR (r.side < 0 AND b.low < r.ep))"
    here = "CASE WHEN r.side > 0 THEN b.high ELSE b.low END"
    other = "CASE WHEN r.side > 0 THEN b.low ELSE b.high END"
    s.scan(
        {"sar": "NULL", "side": "NULL", "ep": "NULL", "af": f"{step}"},
        {
            "sar": f"CASE WHEN b._n = 2 THEN CASE WHEN {up} THEN least(b.low, b._l1) ELSE greatest(b.high, b._h1) END WHEN {turn} THEN r.ep WHEN r.side > 0 THEN {rise} ELSE {fall} END",
            "side": f"CASE WHEN b._n = 2 THEN CASE WHEN {up} THEN 1 ELSE -1 END WHEN {turn} THEN -r.side ELSE r.side END",
            "ep": f"CASE WHEN b._n = 2 THEN CASE WHEN {up} THEN greatest(b.high, b._h1) ELSE least(b.low, b._l1) END WHEN {turn} THEN {other} WHEN {far} THEN {here} ELSE r.ep END",
            "af": f"CASE WHEN b._n = 2 OR {turn} THEN {step} WHEN {far} THEN least({most}, r.af + {step}) ELSE r.af END",
        },
    )
    return s.select("sar", "side")


def counting(s: Sql, k: int = 3, reset: int = 4) -> str:
    s.put(_up="CASE WHEN close > open THEN 1 ELSE 0 END")
    start = {"hits": f"CASE WHEN b._up = 1 AND {k} > 1 THEN 1 ELSE 0 END", "quiet": "1 - b._up", "signal": f"CASE WHEN b._up = 1 AND {k} = 1 THEN 1 ELSE 0 END"}
    full = f"b._up = 1 AND r.hits + 1 >= {k}"
    return s.scan(start, {
        "hits": f"CASE WHEN {full} THEN 0 WHEN b._up = 1 THEN r.hits + 1 WHEN r.quiet + 1 >= {reset} THEN 0 ELSE r.hits END",
        "quiet": "CASE WHEN b._up = 1 THEN 0 ELSE r.quiet + 1 END", "signal": f"CASE WHEN {full} THEN 1 ELSE 0 END",
    }).select("signal")


def hurst(s: Sql, n: int = 40) -> str:
    import math

    lags = list(range(2, n // 2))
    logs = [math.log10(k) for k in lags]
    middle = sum(logs) / len(logs)
    spread = sum((v - middle) ** 2 for v in logs)
    s.put(_a=values("close", n))
    terms = []
    for k, v in zip(lags, logs, strict=True):
        s.put(**{f"_d{k}": f"CASE WHEN _a IS NOT NULL THEN list_transform(range(1, {n - k + 1}), lambda i: _a[i + {k}] - _a[i]) END"})
        var = f"(list_avg(list_transform(_d{k}, lambda y: y * y)) - pow(list_avg(_d{k}), 2))"
        terms.append(f"{(v - middle) / spread!r} * 0.25 * log10(nullif(greatest({var}, 0), 0))")
    return s.put(hurst="2 * (" + " + ".join(f"({t})" for t in terms) + ")").select("hurst")


def day_steps(s: Sql, cells: str, days: int = 10) -> str:
    """Keeps a row, then the next at least so many days later."""
    at = "epoch(b.ts)"
    s.scan({"_last": at, "_keep": "1"}, {"_last": f"CASE WHEN {at} - r._last >= {days * 86400} THEN {at} ELSE r._last END", "_keep": f"CASE WHEN {at} - r._last >= {days * 86400} THEN 1 ELSE 0 END"})
    return f"{s.text} SELECT symbol, ts, {cells} FROM {s.table} WHERE _keep = 1"


def renko(s: Sql, size: float = 5.0) -> str:
    s.scan({"_level": "b.close", "_boxes": "0"}, {"_level": f"r._level + sign(b.close - r._level) * floor(abs(b.close - r._level) / {size}) * {size}", "_boxes": f"floor(abs(b.close - r._level) / {size})"})
    s.put(_was=f"lag(_level) {ORDER}")
    s.put(_way=f"{size} * sign(_level - _was)")
    return f"""{s.text}, boxes AS (SELECT *, unnest(range(0, CAST(_boxes AS BIGINT))) AS i FROM {s.table} WHERE _boxes > 0), ends AS (SELECT symbol, ts, i, _was + i * _way AS o, _was + (i + 1) * _way AS c FROM boxes)
SELECT symbol, ts, CAST(i AS INTEGER) AS box, round(o, 4) AS open, round(greatest(o, c), 4) AS high, round(least(o, c), 4) AS low, round(c, 4) AS close FROM ends"""


def together(*parts: str) -> str:
    """Indicators of several statements side by side."""
    out = f"SELECT * FROM ({parts[0]}) p0"
    for i, p in enumerate(parts[1:], 1):
        out += f" JOIN ({p}) p{i} USING (symbol, ts)"
    return out
