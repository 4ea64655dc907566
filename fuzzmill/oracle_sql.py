"""Generator of DuckDB SQL that recomputes the FCM plans independently.

Nothing here shares step code with the engine: the maths is re-stated as
SQL text.  Passes are fixed (the engine side runs with ``eps < 0``), each
pass is a chain of CTEs, and centres live in a table with one row per
block (a single row when there is no block key) holding the C x D
coordinates ``v{i}_{j}`` and weights ``w{i}``.  Output columns are
rounded to 4 decimals, as on the Spark side.
"""

from __future__ import annotations

from collections.abc import Sequence


class Sql:
    """Accumulates named CTEs."""

    def __init__(self):
        self.ctes: list[tuple[str, str]] = []
        self._n = 0
        self.last_sums: str | None = None

    def add(self, body: str, hint: str = "t") -> str:
        self._n += 1
        name = f"{hint}_{self._n}"
        self.ctes.append((name, body))
        return name

    def render(self, final: str) -> str:
        if not self.ctes:
            return final
        parts = ",\n".join(f"{n} AS (\n{b}\n)" for n, b in self.ctes)
        return f"WITH {parts}\n{final}"


def _gsq(x: str, v: str) -> str:
    return f"CASE WHEN {x} - {v} = 0 THEN 1e-10 ELSE ({x} - {v}) * ({x} - {v}) END"


def _ident(name: str) -> str:
    return name


def seed_first(q: Sql, pts: str, xs: Sequence[str], k: int, order: str) -> str:
    """One-row centre table from the first k rows of ``pts`` by ``order``."""
    sel = ", ".join(
        f"max(CASE WHEN rn = {i} THEN {x} END) AS v{i}_{j}"
        for i in range(k)
        for j, x in enumerate(xs)
    )
    wsel = ", ".join(f"CAST(NULL AS DOUBLE) AS w{i}" for i in range(k))
    return q.add(
        f"SELECT {sel}, {wsel}, 1 AS one FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS rn FROM {pts}) s WHERE rn < {k}",
        "seed",
    )


def seed_rows(q: Sql, pts: str, xs: Sequence[str], k: int, rank_expr: str) -> str:
    """One-row centre table from the k rows ranked first by ``rank_expr``."""
    sel = ", ".join(
        f"max(CASE WHEN rn = {i} THEN {x} END) AS v{i}_{j}"
        for i in range(k)
        for j, x in enumerate(xs)
    )
    wsel = ", ".join(f"CAST(NULL AS DOUBLE) AS w{i}" for i in range(k))
    return q.add(
        f"SELECT {sel}, {wsel}, 1 AS one FROM (SELECT *, row_number() OVER (ORDER BY {rank_expr}) - 1 AS rn FROM {pts}) s WHERE rn < {k}",
        "seed",
    )


def fcm_pass(
    q: Sql,
    pts: str,
    cen: str,
    k: int,
    dims: int,
    m: float,
    weighted: bool,
    block: str | None = None,
) -> str:
    """One pass: new centre table from ``pts`` (x0.., [w], [blk]) and
    ``cen`` (v{i}_{j}, w{i}, [blk]).  Returns the new centre table."""
    xs = [f"x{j}" for j in range(dims)]
    e = 2.0 / (m - 1.0)
    on = f"p.{block} = c.{block}" if block else "p.one = c.one"
    keep = ", ".join(f"p.{x}" for x in xs) + (", p.w" if weighted else "") + (
        f", p.{block}" if block else ""
    )
    ns = ", ".join(
        f"pow(sqrt({' + '.join(_gsq('p.' + x, f'c.v{i}_{j}') for j, x in enumerate(xs))}), {e!r}) AS n{i}"
        for i in range(k)
    )
    step_n = f"SELECT {keep}, {ns} FROM (SELECT *, 1 AS one FROM {pts}) p JOIN {cen} c ON {on}"
    s_expr = " + ".join(f"1.0 / n{i}" for i in range(k))
    wmul = " * w" if weighted else ""
    us = ", ".join(f"pow(({s_expr}) * n{i}, {-m!r}){wmul} AS u{i}" for i in range(k))
    bcol = f", {block}" if block else ""
    step_u = f"SELECT {', '.join(xs)}{bcol}, {us} FROM ({step_n}) a"
    aggs = ", ".join(
        [f"sum(u{i} * {x}) AS s{i}_{j}" for i in range(k) for j, x in enumerate(xs)]
        + [f"sum(u{i}) AS sw{i}" for i in range(k)]
    )
    group = f" GROUP BY {block}" if block else ""
    sums = q.add(f"SELECT {aggs}{bcol}, 1 AS one FROM ({step_u}) b{group}", "sums")
    q.last_sums = sums
    on2 = f"s.{block} = c.{block}" if block else "s.one = c.one"
    newv = ", ".join(
        f"CASE WHEN s.sw{i} = 0 THEN c.v{i}_{j} ELSE s.s{i}_{j} / s.sw{i} END AS v{i}_{j}"
        for i in range(k)
        for j in range(dims)
    )
    neww = ", ".join(f"s.sw{i} AS w{i}" for i in range(k))
    bsel = f", s.{block}" if block else ""
    return q.add(f"SELECT {newv}, {neww}{bsel}, 1 AS one FROM {sums} s JOIN {cen} c ON {on2}", "cen")


def fcm_passes(q, pts, cen, k, dims, m, passes, weighted=False, block=None) -> str:
    for _ in range(max(1, passes)):
        cen = fcm_pass(q, pts, cen, k, dims, m, weighted, block)
    return cen


def round_weights(q: Sql, cen: str, k: int, dims: int, block: str | None = None) -> str:
    vs = ", ".join(f"v{i}_{j}" for i in range(k) for j in range(dims))
    ws = ", ".join(f"floor(w{i} + 0.5) AS w{i}" for i in range(k))
    b = f", {block}" if block else ""
    return q.add(f"SELECT {vs}, {ws}{b}, 1 AS one FROM {cen}", "rnd")


def centers_as_points(q: Sql, cens: Sequence[str], k: int, dims: int, block: str | None = None) -> str:
    """Unpivot one or more centre tables into weighted points (x.., w)."""
    parts = []
    b = f", {block}" if block else ""
    for cen in cens:
        for i in range(k):
            xs = ", ".join(f"v{i}_{j} AS x{j}" for j in range(dims))
            parts.append(f"SELECT {xs}, w{i} AS w{b} FROM {cen}")
    return q.add("\nUNION ALL\n".join(parts), "cpts")


def output(cen: str, k: int, dims: int, with_w: bool = True, extra: str = "") -> str:
    """Final SELECT: one row per centre, c, x0.., w rounded to 4 decimals."""
    rows = []
    for i in range(k):
        xs = ", ".join(f"round(v{i}_{j}, 4) AS x{j}" for j in range(dims))
        w = f", round(w{i}, 4) AS w" if with_w else ""
        rows.append(f"SELECT CAST({i} AS INTEGER) AS c, {xs}{w}{extra} FROM {cen}")
    return "\nUNION ALL\n".join(rows)


def fold(q: Sql, pts_idx: str, cen: str, k: int, dims: int, m: float, passes: int,
         n_chunks: int, round_w: bool = False) -> str:
    """Chunk fold over ``pts_idx`` (x.., chunk): per chunk, ``passes``
    passes from the current centres; from the second chunk on, weighted
    passes over {current, previous} starting at the current centres."""
    prev = None
    for u in range(n_chunks):
        chunk = q.add(f"SELECT * FROM {pts_idx} WHERE chunk = {u}", "chunk")
        cen = fcm_passes(q, chunk, cen, k, dims, m, passes)
        if round_w:
            cen = round_weights(q, cen, k, dims)
        if prev is not None:
            stacked = centers_as_points(q, [cen, prev], k, dims)
            cen = fcm_passes(q, stacked, cen, k, dims, m, passes, weighted=True)
            if round_w:
                cen = round_weights(q, cen, k, dims)
        prev = cen
    return cen


def output_sums(sums: str, k: int, dims: int) -> str:
    """One row per centre with the raw pass sums: c, s0.., w."""
    rows = []
    for i in range(k):
        ss = ", ".join(f"round(s{i}_{j}, 4) AS s{j}" for j in range(dims))
        rows.append(f"SELECT CAST({i} AS INTEGER) AS c, {ss}, round(sw{i}, 4) AS w FROM {sums}")
    return "\nUNION ALL\n".join(rows)


def tokenise_sql(expr: str, sep: str) -> str:
    """Java-style split: trailing empty tokens dropped; one token kept as is."""
    t = f"string_split_regex({expr}, '{sep}')"
    last = f"list_max(list_transform({t}, lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END))"
    return f"(CASE WHEN len({t}) = 1 THEN {t} ELSE {t}[1:{last}] END)"


# ---- long form, for wide points: (pid, j, x) points, (i, j, v, w) centres ----


def seed_long(q: Sql, pts_long: str, k: int, order: str = "pid") -> str:
    """Centres (i, j, v, w) from the first k points by ``order``."""
    return q.add(
        f"SELECT r.rn AS i, p.j, p.x AS v, CAST(NULL AS DOUBLE) AS w FROM {pts_long} p "
        f"JOIN (SELECT pid, row_number() OVER (ORDER BY {order}) - 1 AS rn "
        f"FROM (SELECT DISTINCT pid FROM {pts_long}) t) r ON p.pid = r.pid WHERE r.rn < {k}",
        "lseed",
    )


def fcm_pass_long(q: Sql, pts_long: str, cen: str, m: float) -> str:
    e = 2.0 / (m - 1.0)
    d = q.add(
        f"SELECT p.pid, c.i, sqrt(sum({_gsq('p.x', 'c.v')})) AS d "
        f"FROM {pts_long} p JOIN {cen} c ON p.j = c.j GROUP BY p.pid, c.i",
        "ld",
    )
    u = q.add(
        f"SELECT pid, i, pow(n * sum(1.0 / n) OVER (PARTITION BY pid), {-m!r}) AS um "
        f"FROM (SELECT pid, i, pow(d, {e!r}) AS n FROM {d}) t",
        "lu",
    )
    s = q.add(
        f"SELECT u.i, p.j, sum(u.um * p.x) AS s FROM {u} u JOIN {pts_long} p ON u.pid = p.pid "
        "GROUP BY u.i, p.j",
        "ls",
    )
    w = q.add(f"SELECT i, sum(um) AS w FROM {u} GROUP BY i", "lw")
    return q.add(
        f"SELECT s.i, s.j, CASE WHEN w.w = 0 THEN c.v ELSE s.s / w.w END AS v, w.w AS w "
        f"FROM {s} s JOIN {w} w ON s.i = w.i JOIN {cen} c ON c.i = s.i AND c.j = s.j",
        "lcen",
    )


def output_long(cen: str, dims: int) -> str:
    xs = ", ".join(f"round(max(CASE WHEN j = {j} THEN v END), 4) AS x{j}" for j in range(dims))
    return f"SELECT CAST(i AS INTEGER) AS c, {xs}, round(max(w), 4) AS w FROM {cen} GROUP BY i"
