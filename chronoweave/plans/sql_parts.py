"""SQL fragments shared by the twins."""

from __future__ import annotations

from chronoweave.plans.tables import r


def _by(by):
    return "".join(f"{b}, " for b in by)


def _part(by):
    return f"PARTITION BY {', '.join(by)}" if by else ""


def _group(by):
    return f"GROUP BY {', '.join(by)}" if by else ""


def cdf_sql(src: str, value: str, by=()) -> str:
    """Rows (by, v, r, s, cr, cs): pooled counts and both distribution functions."""
    b, w = _by(by), _part(by)
    return f"""(SELECT {b}v, r, s, sum(r) OVER ({w}) AS rt, sum(s) OVER ({w}) AS st,
      sum(r) OVER ({w} ORDER BY v) / nullif(sum(r) OVER ({w}), 0) AS cr,
      sum(s) OVER ({w} ORDER BY v) / nullif(sum(s) OVER ({w}), 0) AS cs,
      lead(v) OVER ({w} ORDER BY v) AS nv
      FROM (SELECT {b}CAST({value} AS DOUBLE) AS v, count(*) FILTER (WHERE is_real) AS r,
      count(*) FILTER (WHERE NOT is_real) AS s FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL))"""


def ks_sql(src: str, value: str, by=(), name: str = "ks", empty: str = "NULL") -> str:
    b = _by(by)
    return f"""SELECT {b}CASE WHEN max(rt) > 0 AND max(st) > 0 THEN {r('max(abs(cr - cs))')} ELSE {empty} END AS {name}
      FROM {cdf_sql(src, value, by)} {_group(by)}"""


def area_sql(src: str, value: str, by=(), name: str = "wasserstein") -> str:
    return f"""SELECT {_by(by)}{r('coalesce(sum(abs(cr - cs) * (nv - v)), 0)')} AS {name}
      FROM {cdf_sql(src, value, by)} {_group(by)}"""


def shares_sql(src: str, keys, by=()) -> str:
    """Rows (by, keys, rn, sn, p, q)."""
    cols = ", ".join([*by, *keys])
    w = _part(by)
    return f"""(SELECT *, coalesce(rn / nullif(sum(rn) OVER ({w}), 0), 0) AS p, coalesce(sn / nullif(sum(sn) OVER ({w}), 0), 0) AS q
      FROM (SELECT {cols}, count(*) FILTER (WHERE is_real) AS rn, count(*) FILTER (WHERE NOT is_real) AS sn
      FROM {src} GROUP BY ALL))"""


def tv_sql(src: str, keys, by=(), name: str = "tv") -> str:
    return f"SELECT {_by(by)}{r('sum(abs(p - q)) / 2')} AS {name} FROM {shares_sql(src, keys, by)} {_group(by)}"


def grid_sql(src: str, value: str, by=(), name: str = "wasserstein") -> str:
    """Mean quantile gap on the grid of the larger side."""
    b, g = _by(by), "".join(f"{x}, " for x in by)
    using = lambda k: f"USING ({g}{k})"
    return f"""SELECT {b}{r('avg(abs(a - (b_lo + (b_hi - b_lo) * w)))')} AS {name} FROM (
      SELECT *, floor(place)::BIGINT AS lo, ceil(place)::BIGINT AS hi, place - floor(place) AS w FROM (
        SELECT {b}v AS a, CASE WHEN greatest(rn, sn) > 1 THEN i * (least(rn, sn) - 1) / (greatest(rn, sn) - 1) ELSE 0.0 END AS place
        FROM grid_ranked WHERE (rn >= sn) = is_real AND least(rn, sn) > 0))
      JOIN (SELECT {b}i AS lo, v AS b_lo FROM grid_ranked WHERE (rn >= sn) <> is_real) {using('lo')}
      JOIN (SELECT {b}i AS hi, v AS b_hi FROM grid_ranked WHERE (rn >= sn) <> is_real) {using('hi')}
      {_group(by)}"""


def grid_ranked_cte(src: str, value: str, by=()) -> str:
    b = _by(by)
    side = ", ".join(["is_real", *by])
    return f"""grid_ranked AS (SELECT {b}is_real, CAST({value} AS DOUBLE) AS v,
      row_number() OVER (PARTITION BY {side} ORDER BY {value}) - 1 AS i,
      count(*) FILTER (WHERE is_real) OVER ({_part(by)}) AS rn,
      count(*) FILTER (WHERE NOT is_real) OVER ({_part(by)}) AS sn FROM {src} WHERE {value} IS NOT NULL)"""


def rows_sql(source: str, metrics: dict[str, str]) -> str:
    """One-row select to (metric, value) rows."""
    names = ", ".join(f"'{k}'" for k in metrics)
    values = ", ".join(f"CAST({v} AS DOUBLE)" for v in metrics.values())
    return f"SELECT unnest([{names}]) AS metric, unnest([{values}]) AS value FROM {source}"


def melt_sql(src: str, columns, keep=("is_real",)) -> str:
    """Rows (keep..., "column", value)."""
    k = "".join(f"{c}, " for c in keep)
    return " UNION ALL ".join(f"SELECT {k}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {src}" for c in columns)
