"""DuckDB SQL twins of library operators, for the correctness gate.

Each builder returns SQL that recomputes, on the same parquet views, exactly
what the Spark operator computes (same hashes, same arithmetic order), so the
gate can compare values, not just row counts.
"""

from __future__ import annotations

import math

from equipoise.functions.random import hash_normal_sql, hash_u_sql
from equipoise.operators.ordered import group_quantiles_sql
from equipoise.operators.synth import normal_cdf_sql


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def synth_sql(src: str, target: str, num_cols: list[str], cat_cols: list[str], n_sql: str,
              label_sql: str, seed: int = 2020, stream: str = "s", n_knots: int = 101,
              cond_col: str | None = "__first__",
              condition: bool = True) -> tuple[str, str]:
    """(CTE list, final select) drawing ``n_sql`` rows like ``Synthesizer.sample``.

    ``label_sql`` is an expression over ``synth_id`` (conditional mode).
    Returns CTE text (without WITH) and the name of the CTE holding the rows.
    """
    fit = synth_fit_sql(src, target, num_cols, cat_cols, n_knots, cond_col)
    draw, rows = synth_draw_sql("", target, num_cols, cat_cols, n_sql, label_sql, seed, stream,
                                n_knots, cond_col, condition)
    return fit + ",\n" + draw, rows


def synth_fit_sql(src: str, target: str, num_cols: list[str], cat_cols: list[str],
                  n_knots: int = 101, cond_col: str | None = "__first__") -> str:
    """CTEs ``sd, sp, sct, snl, snq, snk``: the fitted tables of ``Synthesizer.fit``."""
    if cond_col == "__first__":
        cond_col = cat_cols[0] if cat_cols else None
    ctes = []
    sel = [f"CAST({q(target)} AS INTEGER) AS y"]
    sel += [f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in num_cols]
    sel += [f"CAST({q(c)} AS VARCHAR) AS {q(c)}" for c in cat_cols]
    ctes.append(f"sd AS (SELECT {', '.join(sel)} FROM {src})")
    ctes.append("sp AS (SELECT y, count(*) AS n, CAST(count(*) AS DOUBLE) / "
                "CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM sd GROUP BY y)")
    if cat_cols:
        parts = []
        for j, c in enumerate(cat_cols):
            par = q(cat_cols[j - 1]) if j > 0 else "''"
            parts.append(f"SELECT {lit(c)} AS col, y, {par} AS parent, {q(c)} AS level FROM sd")
        ctes.append("scl AS (" + " UNION ALL ".join(parts) + ")")
        ctes.append("scc AS (SELECT col, y, parent, level, count(*) AS cnt FROM scl GROUP BY ALL)")
        ctes.append(
            "sct AS (SELECT col, y, parent, level, cnt, "
            "CAST(sum(cnt) OVER w - cnt AS DOUBLE) / CAST(sum(cnt) OVER (PARTITION BY col, y, parent) AS DOUBLE) AS lo, "
            "CAST(sum(cnt) OVER w AS DOUBLE) / CAST(sum(cnt) OVER (PARTITION BY col, y, parent) AS DOUBLE) AS hi "
            "FROM scc WINDOW w AS (PARTITION BY col, y, parent ORDER BY level ASC NULLS FIRST "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
    if num_cols:
        parts = []
        for c in num_cols:
            if cond_col:
                parts.append(f"SELECT {lit(c)} AS col, y, TRUE AS cell, {q(cond_col)} AS cond, {q(c)} AS v FROM sd")
            parts.append(f"SELECT {lit(c)} AS col, y, FALSE AS cell, CAST(NULL AS VARCHAR) AS cond, {q(c)} AS v FROM sd")
        ctes.append("snl AS (" + " UNION ALL ".join(parts) + ")")
        keys = ["col", "y", "cell", "cond"]
        ctes.append(f"snq AS (SELECT * FROM {group_quantiles_sql('snl', keys, 'v', n_knots=n_knots)})")
        ctes.append("snk AS (SELECT a.col, a.y, a.cell, a.cond, a.knots, b.n FROM "
                    "(SELECT col, y, cell, cond, list(value ORDER BY k) AS knots FROM snq GROUP BY ALL) a "
                    "JOIN (SELECT col, y, cell, cond, count(v) AS n FROM snl WHERE v IS NOT NULL GROUP BY ALL) b "
                    "ON a.col = b.col AND a.y = b.y AND a.cell = b.cell AND a.cond IS NOT DISTINCT FROM b.cond)")
    if len(num_cols) == 2:
        ctes.append(_copula_sql(num_cols, cond_col, n_knots))
    elif len(num_cols) > 2:
        raise ValueError("The twin knows the copula of two numeric columns.")
    return ",\n".join(ctes)


def _copula_sql(num_cols: list[str], cond_col: str | None, n_knots: int) -> str:
    """CTE ``scp(y, rho)``: the copula's correlation of two numeric columns."""
    joins, places = [], []
    for i, c in enumerate(num_cols):
        joins.append(f"LEFT JOIN snk w{i} ON w{i}.col = {lit(c)} AND NOT w{i}.cell AND w{i}.y = s.y")
        kn = f"w{i}.knots"
        if cond_col:
            joins.append(f"LEFT JOIN snk c{i} ON c{i}.col = {lit(c)} AND c{i}.cell AND c{i}.y = s.y "
                         f"AND c{i}.cond IS NOT DISTINCT FROM s.{q(cond_col)}")
            kn = f"coalesce(c{i}.knots, w{i}.knots)"
        places.append(f"s.{q(c)} AS v{i}, {kn} AS k{i}, len(list_filter({kn}, lambda k: k <= s.{q(c)})) AS a{i}")
    u = [f"CASE WHEN v{i} IS NULL OR a{i} < 1 THEN NULL WHEN a{i} >= {n_knots} THEN CAST(1 AS DOUBLE) ELSE "
         f"(CAST(a{i} AS DOUBLE) - 1 + (v{i} - k{i}[a{i}]) / (k{i}[a{i} + 1] - k{i}[a{i}])) / {float(n_knots - 1)!r} END AS u{i}"
         for i in range(2)]
    return (f"scp AS (SELECT y, CASE WHEN r IS NULL OR isnan(r) THEN 0.0 ELSE round(CAST(2 AS DOUBLE) * sin(CAST('{math.pi / 6.0!r}' AS DOUBLE) * r), 9) "
            f"END AS rho FROM (SELECT y, corr(u1, u0) AS r FROM (SELECT y, {', '.join(u)} FROM (SELECT s.y, {', '.join(places)} "
            f"FROM sd s {' '.join(joins)})) GROUP BY y))")


def synth_draw_sql(tag: str, target: str, num_cols: list[str], cat_cols: list[str], n_sql: str,
                   label_sql: str, seed: int = 2020, stream: str = "s", n_knots: int = 101,
                   cond_col: str | None = "__first__",
                   condition: bool = True) -> tuple[str, str]:
    """CTEs drawing rows from the fitted tables; names are prefixed by ``tag``."""
    if cond_col == "__first__":
        cond_col = cat_cols[0] if cat_cols else None
    ctes = []
    ids = f"SELECT CAST(unnest(range(0, {n_sql})) AS BIGINT) AS synth_id"
    if condition:
        ctes.append(f"{tag}s0 AS (SELECT synth_id, CAST({label_sql} AS INTEGER) AS y FROM ({ids}))")
    else:
        uy = hash_u_sql("synth_id", seed, f"{stream}:y")
        ctes.append(f"{tag}s0 AS (SELECT synth_id, CASE WHEN {uy} < (SELECT p FROM sp WHERE y = 0) "
                    f"THEN 0 ELSE 1 END AS y FROM ({ids}))")
    prev = f"{tag}s0"
    for j, c in enumerate(cat_cols):
        par = f"s.{q(cat_cols[j - 1])}" if j > 0 else "''"
        u = hash_u_sql("s.synth_id", seed, f"{stream}:c:{c}")
        name = f"{tag}s{j + 1}"
        ctes.append(f"{name} AS (SELECT s.*, t.level AS {q(c)} FROM {prev} s LEFT JOIN sct t "
                    f"ON t.col = {lit(c)} AND t.y = s.y AND t.parent IS NOT DISTINCT FROM {par} "
                    f"AND {u} >= t.lo AND {u} < t.hi)")
        prev = name
    out = ["s.synth_id", f"s.y AS {q(target)}"]
    joins, uniforms = [], []
    km1 = float(n_knots - 1)
    for i, c in enumerate(num_cols):
        joins.append(f"LEFT JOIN snk w{i} ON w{i}.col = {lit(c)} AND NOT w{i}.cell AND w{i}.y = s.y")
        kn = f"w{i}.knots"
        if cond_col:
            joins.append(f"LEFT JOIN snk c{i} ON c{i}.col = {lit(c)} AND c{i}.cell AND c{i}.y = s.y "
                         f"AND c{i}.cond IS NOT DISTINCT FROM s.{q(cond_col)}")
            kn = f"coalesce(c{i}.knots, w{i}.knots)"
        if len(num_cols) == 2:
            z = [hash_normal_sql("s.synth_id", seed, f"{stream}:n:{x}") for x in num_cols]
            rho = "(CAST('0.0' AS DOUBLE) + coalesce(cp.rho, 0.0))"
            u = normal_cdf_sql(z[0] if i == 0 else f"({rho} * {z[0]} + sqrt(1.0 - {rho} * {rho}) * {z[1]})")
        else:
            u = hash_u_sql("s.synth_id", seed, f"{stream}:n:{c}")
        uniforms.append(f"{u} AS u{i}")
        u = f"s.u{i}"
        pos = f"({u} * {km1!r})"
        idx = f"CAST(floor({pos}) AS BIGINT)"
        frac = f"({pos} - CAST({idx} AS DOUBLE))"
        out.append(f"({kn}[{idx} + 1] + {frac} * ({kn}[{idx} + 2] - {kn}[{idx} + 1])) AS {q(c)}")
    out += [f"s.{q(c)}" for c in cat_cols]
    if uniforms:
        copula = "LEFT JOIN scp cp ON cp.y = s.y" if len(num_cols) == 2 else ""
        ctes.append(f"{tag}su AS (SELECT s.*, {', '.join(uniforms)} FROM {prev} s {copula})")
        prev = f"{tag}su"
    ctes.append(f"{tag}srows AS (SELECT {', '.join(out)} FROM {prev} s {' '.join(joins)})")
    return ",\n".join(ctes), f"{tag}srows"


def prep_fit_sql(tag: str, src: str, num_cols: list[str], cat_cols: list[str]) -> str:
    """CTEs ``{tag}mm`` (mean/min/max per numeric column) and ``{tag}lv``
    (sorted levels per categorical column) of ``Preprocessor.fit``."""
    aggs = []
    for i, c in enumerate(num_cols):
        x = f"CAST({q(c)} AS DOUBLE)"
        aggs += [f"avg({x}) AS m{i}", f"min({x}) AS lo{i}", f"max({x}) AS hi{i}"]
    ctes = [f"{tag}mm AS (SELECT {', '.join(aggs) or '1 AS dummy'} FROM {src})"]
    if cat_cols:
        parts = [f"SELECT DISTINCT {lit(c)} AS col, CAST({q(c)} AS VARCHAR) AS level FROM {src} "
                 f"WHERE {q(c)} IS NOT NULL" for c in cat_cols]
        ctes.append(f"{tag}lv AS (SELECT col, level, row_number() OVER (PARTITION BY col ORDER BY level) - 1 AS code "
                    f"FROM ({' UNION ALL '.join(parts)}))")
    return ",\n".join(ctes)


def prep_select_sql(tag: str, num_cols: list[str], cat_levels: dict[str, int], alias: str = "t",
                    scale: bool = True) -> list[str]:
    """Select expressions of ``PreprocessorModel.transform`` over ``alias``
    (joined with ``{tag}mm m``); one-hot columns ``<col>_<i>``."""
    out = []
    for i, c in enumerate(num_cols):
        x = f"coalesce(CAST({alias}.{q(c)} AS DOUBLE), m.m{i})"
        if scale:
            rng = f"(CASE WHEN m.hi{i} - m.lo{i} <> 0 THEN m.hi{i} - m.lo{i} ELSE 1.0 END)"
            x = f"(({x} - m.lo{i}) / {rng})"
        out.append(f"{x} AS {q(c)}")
    for c, k in cat_levels.items():
        for i in range(k):
            out.append(f"CASE WHEN CAST({alias}.{q(c)} AS VARCHAR) = (SELECT level FROM {tag}lv WHERE col = {lit(c)} "
                       f"AND code = {i}) THEN 1.0 ELSE 0.0 END AS {q(f'{c}_{i}')}")
    return out


def r9(expr: str, digits: int = 9) -> str:
    return f"round({expr}, {digits})"
