"""DuckDB text for neighbourhood operations, so results can be held against another engine.

Arithmetic is FLOAT with one rounding for each operation, as in the kernels, and in their order.
"""

from __future__ import annotations

import numpy as np

DEM = "SELECT CAST(o_orderkey // 125 AS INT) AS y, CAST(o_orderkey % 125 AS INT) AS x, CAST(o_totalprice AS FLOAT) AS v FROM orders"
MASKED = "SELECT CAST(o_orderkey // 125 AS INT) AS y, CAST(o_orderkey % 125 AS INT) AS x, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_totalprice AS FLOAT) END AS v FROM orders"
WEIGHT = "SELECT CAST(event_id // 100 AS INT) AS y, CAST(event_id % 100 AS INT) AS x, CASE WHEN event_type <> 'error' THEN CAST(value AS FLOAT) END AS v FROM events"


def fl(value: float) -> str:
    """A FLOAT literal."""
    return f"CAST({float(np.float32(value))!r} AS FLOAT)"


def lagged(column: str, by: int, order: str) -> str:
    if by == 0:
        return column
    part = "x" if order == "y" else "y"
    f = "lag" if by < 0 else "lead"
    return f"{f}({column}, {abs(by)}) OVER (PARTITION BY {part} ORDER BY {order})"


def square(source: str, r: int = 1) -> str:
    """CTEs ending in ``n``: y, x, and the neighbours n_j_i (0 .. 2r, row by row), and whether all are valid."""
    k = range(2 * r + 1)
    across = ", ".join(f"{lagged('v', i - r, 'x')} AS a{i}" for i in k)
    down = ", ".join(f"{lagged(f'a{i}', j - r, 'y')} AS n_{j}_{i}" for j in k for i in k)
    whole = " + ".join(f"n_{j}_{i}" for j in k for i in k)
    return f"d AS ({source}), across AS (SELECT y, x, {across} FROM d), around AS (SELECT y, x, {down} FROM across), n AS (SELECT *, ({whole}) IS NOT NULL AS whole FROM around)"


Z = {k + 1: f"n_{k // 3}_{k % 3}" for k in range(9)}


def horn(cell: float, z: float = 1.0) -> tuple[str, str]:
    """Expressions for gx and gy."""
    k = fl(z / (8 * cell))
    gx = f"((({Z[3]} - {Z[1]}) + ({Z[9]} - {Z[7]})) + (({Z[6]} - {Z[4]}) + ({Z[6]} - {Z[4]}))) * {k}"
    gy = f"((({Z[7]} - {Z[1]}) + ({Z[9]} - {Z[3]})) + (({Z[8]} - {Z[2]}) + ({Z[8]} - {Z[2]}))) * {k}"
    return gx, gy


def gradient_ctes(source: str, cell: float) -> str:
    gx, gy = horn(cell)
    return f"WITH {square(source)}, g AS (SELECT y, x, whole, {gx} AS gx, {gy} AS gy FROM n)"


def root(expr: str) -> str:
    return f"CAST(sqrt(CAST({expr} AS DOUBLE)) AS FLOAT)"


def atan_ctes(source: str, column: str, keep: str) -> str:
    """CTEs ending in ``atan``: ``keep`` columns and ``a``, the arc tangent of a FLOAT column that is not negative."""
    big, mid = f"{column} > {fl(2.414213562373095)}", f"{column} > {fl(0.4142135623730950)}"
    one, zero = fl(1), fl(0)
    t = f"CASE WHEN {big} THEN {fl(-1)} / {column} WHEN {mid} THEN ({column} - {one}) / ({column} + {one}) ELSE {column} / {one} END"
    y0 = f"CASE WHEN {big} THEN {fl(np.pi / 2)} WHEN {mid} THEN {fl(np.pi / 4)} ELSE {zero} END"
    p = f"((({fl(8.05374449538e-2)} * zz - {fl(1.38776856032e-1)}) * zz + {fl(1.99777106478e-1)}) * zz - {fl(3.33329491539e-1)})"
    return f"at1 AS (SELECT {keep}, {t} AS t, {y0} AS y0 FROM {source}), at2 AS (SELECT *, t * t AS zz FROM at1), atan AS (SELECT {keep}, y0 + ({p} * zz * t + t) AS a FROM at2)"


def final(expr: str, source: str, name: str = "v") -> str:
    return f"SELECT y, x, CAST(CASE WHEN whole THEN {expr} END AS DOUBLE) AS {name} FROM {source}"


def slope(source: str, cell: float, unit: str) -> str:
    g = gradient_ctes(source, cell)
    m = f"m AS (SELECT y, x, whole, {root('gx * gx + gy * gy')} AS m FROM g)"
    if unit == "percent":
        return f"{g}, {m} {final(f'm * {fl(100)}', 'm')}"
    a = f"{g}, {m}, {atan_ctes('m', 'm', 'y, x, whole')} "
    return a + final("a" if unit == "radians" else f"a * {fl(180 / np.pi)}", "atan")


def aspect(source: str, cell: float, trigonometric: bool = False) -> str:
    yy, xx = ("gy", "w") if trigonometric else ("w", "gy")
    pre = f"{gradient_ctes(source, cell)}, w AS (SELECT *, {fl(0)} - gx AS w FROM g), r AS (SELECT *, {yy} AS yy, {xx} AS xx, CASE WHEN {xx} <> 0 THEN abs({yy}) / abs({xx}) ELSE CAST('inf' AS FLOAT) END AS q FROM w)"
    pre += f", {atan_ctes('r', 'q', 'y, x, whole, gx, gy, yy, xx')}, s AS (SELECT *, CASE WHEN xx < 0 THEN {fl(np.pi)} - a ELSE a END AS b FROM atan)"
    pre += f", e AS (SELECT *, (CASE WHEN yy < 0 THEN -b ELSE b END) * {fl(180 / np.pi)} AS deg FROM s), f AS (SELECT *, CASE WHEN deg < 0 THEN deg + {fl(360)} ELSE deg END AS full_deg FROM e) "
    return pre + final(f"CASE WHEN gx = 0 AND gy = 0 THEN {fl(-1)} WHEN full_deg >= 360 THEN {fl(0)} ELSE full_deg END", "f")


def hillshade(source: str, cell: float, azimuth: float, altitude: float) -> str:
    az, alt = np.radians(azimuth), np.radians(altitude)
    c, bx, by = fl(255 * np.sin(alt)), fl(-255 * np.cos(alt) * np.sin(az)), fl(255 * np.cos(alt) * np.cos(az))
    v = f"({c} + ({bx} * gx + {by} * gy)) / {root(f'{fl(1)} + (gx * gx + gy * gy)')}"
    return f"{gradient_ctes(source, cell)} {final(f'least(greatest({v}, {fl(0)}), {fl(255)})', 'g')}"


def curvature(source: str, cell: float, kind: str) -> str:
    pre = f"""WITH {square(source)}, d1 AS (SELECT y, x, whole, ({Z[6]} - {Z[4]}) * {fl(1 / (2 * cell))} AS p, ({Z[8]} - {Z[2]}) * {fl(1 / (2 * cell))} AS q,
      (({Z[4]} + {Z[6]}) - ({Z[5]} + {Z[5]})) * {fl(1 / cell**2)} AS r, (({Z[2]} + {Z[8]}) - ({Z[5]} + {Z[5]})) * {fl(1 / cell**2)} AS t,
      (({Z[1]} + {Z[9]}) - ({Z[3]} + {Z[7]})) * {fl(1 / (4 * cell * cell))} AS s FROM n),
      d2 AS (SELECT *, p * p AS p2, q * q AS q2, p * q AS pq FROM d1), d3 AS (SELECT *, p2 + q2 AS g, {fl(1)} + (p2 + q2) AS w FROM d2) """
    zero, one = fl(0), fl(1)
    if kind == "mean":
        num = f"((({one} + q2) * r - (pq + pq) * s) + ({one} + p2) * t)"
        return pre + final(f"{zero} - {num} / (w * {root('w')} + w * {root('w')})", "d3")
    if kind == "profile":
        num, v = "((p2 * r + (pq + pq) * s) + q2 * t)", f"/ g / (w * {root('w')})"
    else:
        num, v = "((q2 * r - (pq + pq) * s) + p2 * t)", f"/ g / {root('g')}"
    return pre + final(f"CASE WHEN g = 0 THEN {num} + {zero} ELSE {zero} - {num} {v} END", "d3")


def _others(r: int) -> list[str]:
    k = 2 * r + 1
    return [f"n_{j}_{i}" for j in range(k) for i in range(k) if (j, i) != (r, r)]


def ruggedness(source: str, kind: str, r: int = 1) -> str:
    c, others = f"n_{r}_{r}", _others(r)
    count = f"* {fl(0.125)}" if r == 1 else f"/ {fl(len(others))}"
    total = " + ".join(others)
    v = {
        "tri_riley": "CAST(sqrt(" + " + ".join(f"(CAST({n} AS DOUBLE) - CAST({c} AS DOUBLE)) * (CAST({n} AS DOUBLE) - CAST({c} AS DOUBLE))" for n in others) + ") AS FLOAT)",
        "tri_wilson": "(" + " + ".join(f"abs({n} - {c})" for n in others) + f") {count}",
        "tpi": f"{c} - ({total}) {count}",
        "roughness": f"greatest({c}, {', '.join(others)}) - least({c}, {', '.join(others)})",
    }[kind]
    return f"WITH {square(source, r)} {final(v, 'n')}"


def correlate(source: str, weights) -> str:
    w = np.asarray(weights, np.float32)
    terms = [f"n_{j}_{i} * {fl(w[j, i])}" for j in range(w.shape[0]) for i in range(w.shape[1])]
    return f"WITH {square(source, w.shape[0] // 2)} {final(' + '.join(terms), 'n')}"


def separable(source: str, down: list[float], along: list[float], after: str = "") -> str:
    """Columns first, then rows; ``after`` is applied to the sum."""
    r = len(down) // 2
    cols = ", ".join(f"{lagged('v', j - r, 'y')} AS c{j}" for j in range(2 * r + 1))
    col = " + ".join(f"c{j} * {fl(t)}" for j, t in enumerate(down))
    rows = ", ".join(f"{lagged('s', i - r, 'x')} AS r{i}" for i in range(2 * r + 1))
    row = " + ".join(f"r{i} * {fl(t)}" for i, t in enumerate(along))
    return f"WITH d AS ({source}), c AS (SELECT y, x, {cols} FROM d), s AS (SELECT y, x, {col} AS s FROM c), r AS (SELECT y, x, {rows} FROM s) SELECT y, x, CAST(({row}) {after} AS DOUBLE) AS v FROM r"


def box_extreme(source: str, r: int, f: str) -> str:
    k = 2 * r + 1
    return f"WITH {square(source, r)} {final(f + '(' + ', '.join(f'n_{j}_{i}' for j in range(k) for i in range(k)) + ')', 'n')}"


def double_of_gradient(source: str, cell: float, expr: str) -> str:
    """An expression in DOUBLE gx, gy and g2, rounded to FLOAT once."""
    return f"{gradient_ctes(source, cell)}, h AS (SELECT y, x, whole, CAST(gx AS DOUBLE) AS gx, CAST(gy AS DOUBLE) AS gy, CAST(gx AS DOUBLE) * CAST(gx AS DOUBLE) + CAST(gy AS DOUBLE) * CAST(gy AS DOUBLE) AS g2 FROM g) {final(f'CAST({expr} AS FLOAT)', 'h')}"


#: Rows of the orders raster.
ROWS = "(SELECT max(o_orderkey) // 125 + 1 FROM orders)"


def _kernel(method: str) -> tuple[str, int]:
    """A kernel of d in DOUBLE, and how far it reaches."""
    x = "abs(d)"
    return {
        "bilinear": (f"1 - {x}", 1),
        "cubic": (f"CASE WHEN {x} < 1 THEN ((CAST(1.5 AS DOUBLE) * {x} - CAST(2.5 AS DOUBLE)) * {x}) * {x} + 1 ELSE ((CAST(-0.5 AS DOUBLE) * {x} + CAST(2.5 AS DOUBLE)) * {x} - 4) * {x} + 2 END", 2),
        "lanczos": ("CASE WHEN d = 0 THEN CAST(1 AS DOUBLE) WHEN d = trunc(d) THEN CAST(0 AS DOUBLE) ELSE (3 * sin(pi() * d)) * sin(pi() * d / 3) / ((pi() * d) * (pi() * d)) END", 3),
    }[method]


def axis(name: str, method: str, ratio: float, n: str, src_n: str, widen: bool = True) -> str:
    """CTE ``name`` (c, i, w): the taps of output cells whose coordinates are exact multiples of ``ratio`` source cells."""
    r = f"CAST({ratio!r} AS DOUBLE)"
    cells = f"SELECT CAST(c AS INT) AS c, (c + CAST(0.5 AS DOUBLE)) * {r} AS u, c * {r} AS e0, (c + 1) * {r} AS e1, {src_n} AS src_n FROM range({n}) t(c)"
    if method == "nearest":
        return f"{name} AS (SELECT c, CAST(floor(u) AS INT) AS i, {fl(1)} AS w FROM ({cells}))"
    if method == "average":
        taps = f"SELECT c, i, least(e1, i + 1.0::DOUBLE) - greatest(e0, i::DOUBLE) AS x FROM (SELECT *, unnest(range(CAST(floor(e0) AS BIGINT), least(src_n, CAST(ceil(e1) AS BIGINT)))) AS i FROM ({cells}))"
    else:
        kernel, reach = _kernel(method)
        s = ratio if widen and (ratio > 1 if method == "lanczos" else 1 / ratio < 0.95) else 1.0
        wide = f"CAST({s!r} AS DOUBLE)"
        each = f"SELECT c, i, (i + CAST(0.5 AS DOUBLE) - u) / {wide} AS d FROM (SELECT *, unnest(range(greatest(0, CAST(floor(u - 0.5 - {reach} * {wide}) AS BIGINT)), least(src_n, CAST(ceil(u - 0.5 + {reach} * {wide}) AS BIGINT) + 1))) AS i FROM ({cells}))"
        taps = f"SELECT c, i, {kernel} AS x FROM ({each}) WHERE abs(d) < {reach}"
    total = "list_reduce(list(x ORDER BY i), lambda a, b: a + b)"
    return f"{name}_all AS ({taps}), {name}_sum AS (SELECT c, {total} AS total FROM {name}_all WHERE x <> 0 GROUP BY c), {name} AS (SELECT c, CAST(i AS INT) AS i, CAST(x / total AS FLOAT) AS w FROM {name}_all JOIN {name}_sum USING (c) WHERE x <> 0)"


def resampled(source: str, method: str, ratio: float, width: str, height: str, src_width: str, src_height: str) -> str:
    """A source without invalid cells on a grid from the same corner: rows, then columns, by folded lists."""

    def passes(m, tag, widen=True):
        fold = "list_reduce(list(CAST({v} * t.w AS FLOAT) ORDER BY t.i), lambda a, b: a + b)"
        return (
            f"{axis('tx' + tag, m, ratio, width, src_width, widen)}, {axis('ty' + tag, m, ratio, height, src_height, widen)}, "
            f"h{tag} AS (SELECT d.y, t.c AS x, {fold.format(v='d.v')} AS v FROM d JOIN tx{tag} t ON d.x = t.i GROUP BY d.y, t.c), "
            f"o{tag} AS (SELECT t.c AS y, h.x, {fold.format(v='h.v')} AS v FROM h{tag} h JOIN ty{tag} t ON h.y = t.i GROUP BY t.c, h.x)"
        )

    sql = f"WITH d AS ({source}), {passes(method, '')}"
    if method != "cubic" or 1 / ratio < 0.95:
        return f"{sql} SELECT y, x, CAST(v AS DOUBLE) AS v FROM o"
    j = f"floor((o.{{0}} + CAST(0.5 AS DOUBLE)) * {ratio!r} - 0.5)"
    clipped = " OR ".join(f"{j.format(a)} - 1 < 0 OR {j.format(a)} + 2 >= {n}" for a, n in (("x", src_width), ("y", src_height)))
    return f"{sql}, {passes('bilinear', 'b', False)} SELECT o.y, o.x, CAST(CASE WHEN {clipped} THEN b.v ELSE o.v END AS DOUBLE) AS v FROM o JOIN ob b ON b.y = o.y AND b.x = o.x"


def resampled_masked(source: str, method: str, ratio: float, width: str, height: str, src_width: str, src_height: str) -> str:
    """The same for a source with invalid cells (not for cubic and Lanczos): sums of values and of weights of the valid taps."""
    fold = "list_reduce(list(CAST({} AS FLOAT) ORDER BY t.i), lambda a, b: a + b)".format
    centre = "" if method == "average" else f" AND EXISTS (SELECT 1 FROM d WHERE d.v IS NOT NULL AND d.y = floor((o.y + CAST(0.5 AS DOUBLE)) * {ratio!r}) AND d.x = floor((o.x + CAST(0.5 AS DOUBLE)) * {ratio!r}))"
    return (
        f"WITH d AS ({source}), {axis('tx', method, ratio, width, src_width)}, {axis('ty', method, ratio, height, src_height)}, "
        f"h AS (SELECT d.y, t.c AS x, {fold('coalesce(d.v, 0) * t.w')} AS v, {fold('CASE WHEN d.v IS NULL THEN 0 ELSE t.w END')} AS w, count(d.v) AS k, count(*) AS n FROM d JOIN tx t ON d.x = t.i GROUP BY d.y, t.c), "
        f"o AS (SELECT t.c AS y, h.x, {fold('h.v * t.w')} AS v, {fold('h.w * t.w')} AS w, sum(h.k) AS k, sum(h.n) AS n FROM h JOIN ty t ON h.y = t.i GROUP BY t.c, h.x) "
        f"SELECT y, x, CAST(CASE WHEN w > 0{centre} THEN CASE WHEN k = n THEN v ELSE v / w END END AS DOUBLE) AS v FROM o"
    )
