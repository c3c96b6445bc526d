"""SQL counterparts of the catalog queries, for DuckDB on the same tables.

Written from the operators' definitions, with plain windows, joins and recursive
queries over whole series; none of the library's blocks or folds appear here.
"""

from __future__ import annotations

import re

Z = "1.959963984540054"
Z90 = "1.2815515655446004"  # normal quantile at 0.9
TARGETS = "('AFRICA', 'AMERICA')"
ORDERED_AREAS = "['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']"
ORDERED_METHODS = "['total_ratio', 'neighbour_ratio', 'linear', 'ar1']"
DIGITS = {"rpn_var": 2, "rpw_var": 2}


def keep(texts: str, doubles: str, source: str) -> str:
    """Final select: plain columns and rounded doubles."""
    rounded = [f"round({c}, {DIGITS.get(c, 6)}) as {c}" for c in doubles.split()]
    return f"select {', '.join(texts.split() + rounded)} from {source}"


def chain(*ctes: str, final: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + final


# --- panels ---------------------------------------------------------------------------

REGIONS = """orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""


def surveyed(area: str, time: str) -> str:
    return f"""(({area} = 'AFRICA' and {time} % 2 = 0) or ({area} = 'AMERICA' and {time} % 2 <> 0)
    or {area} in ('ASIA', 'EUROPE', 'MIDDLE EAST'))"""


def cells(name: str, keys: dict[str, str], price: str, source: str, where: str = "true") -> str:
    heads = ", ".join(f"{v} as {k}" for k, v in keys.items())
    money = f"cast({price} as decimal(18,2))"
    return f"""{name} as (
  select {', '.join(keys)}, cast(n as double) as rpn, cast(n as double) as rpn_var,
    cast(s as double) / 977 as rpw,
    ((cast(q as double) - cast(s as double) * cast(s as double) / n) * n) / nullif(n - 1, 0) / (977 * 977) as rpw_var
  from (select {heads}, count(*) as n, sum({money}) as s, sum({money} * {money}) as q
        from {source} where {where} group by all))"""


ITEMS = f"{REGIONS} join lineitem on o_orderkey = l_orderkey"
YEAR = "cast(year(o_orderdate) as int)"
DAY = "cast(datediff('day', date '1970-01-01', cast(o_orderdate as date)) as int)"
SUPPLIER = {"species": "cast(l_suppkey as varchar)", "year": YEAR, "strata": "r_name"}
PANEL = cells("panel", SUPPLIER, "l_extendedprice", ITEMS, surveyed("r_name", "year(o_orderdate)"))
SEGMENTS = cells(
    "panel",
    {"species": "c_mktsegment", "year": YEAR, "strata": "r_name"},
    "o_totalprice",
    REGIONS,
    surveyed("r_name", "year(o_orderdate)"),
)
DAYS = cells(
    "panel",
    {"species": "c_mktsegment", "year": DAY, "strata": "r_name"},
    "o_totalprice",
    REGIONS,
    surveyed("r_name", DAY),
)
SUPPLIER_DAYS = cells(
    "panel",
    {"species": "cast(l_suppkey as varchar)", "year": DAY, "strata": "r_name"},
    "l_extendedprice",
    ITEMS,
    surveyed("r_name", DAY),
)
TOTAL = cells(
    "published",
    {"species": "cast(l_suppkey as varchar)", "year": YEAR},
    "l_extendedprice",
    "orders join lineitem on o_orderkey = l_orderkey",
)

GRID = """grid as (
  select s.species, y.year, s.strata, p.rpn, p.rpn_var, p.rpw, p.rpw_var
  from (select distinct species, strata from panel) s
  join (select distinct species, year from panel) y on s.species = y.species
  left join panel p on p.species = s.species and p.strata = s.strata and p.year = y.year)"""


# --- fills ----------------------------------------------------------------------------


def lag_self(x: str, part: str) -> str:
    over = f"over (partition by {part} order by year)"
    return f"case when row_number() {over} = 1 then {x} else lag({x}) {over} end"


LAGS = f"""lags as (
  select *, {lag_self('rpn', 'species, strata')} as rpn_lag, {lag_self('rpw', 'species, strata')} as rpw_lag
  from grid)"""


def mean_cv(source: str, start: int) -> str:
    return f"""case when year >= {start} then coalesce(avg(sqrt(rpn_var) / nullif(rpn, 0))
      over (partition by species, strata), 0) else 0.05 end"""


def ratio(name: str, ref: str, start: int = 1996) -> str:
    """Ratio fill against a table ``ref(species, year, rpn, rpw)``."""
    assigned = lambda m: f"""case when strata in {TARGETS} and year between {start} and (select max(year) from panel)
      and {m} is not null and {m}_var is null then (cv * {m}) * (cv * {m}) else {m}_var end as {m}_var"""
    fill = lambda m: f"""case when strata in {TARGETS} and {m} is null
      then {m}_lag * ({m}_ref / nullif({m}_prev, 0)) else {m} end as {m}"""
    return f"""{name}_ref as (
  select species, year, rpn as rpn_ref, rpw as rpw_ref,
    {lag_self('rpn', 'species')} as rpn_prev, {lag_self('rpw', 'species')} as rpw_prev
  from ({ref})),
{name}_filled as (
  select species, year, strata, {fill('rpn')}, rpn_var, {fill('rpw')}, rpw_var, cv
  from (select *, {mean_cv('lags', start)} as cv from lags) left join {name}_ref using (species, year)),
{name} as (
  select species, year, strata, rpn, {assigned('rpn')}, rpw, {assigned('rpw')}, '{name}' as method
  from {name}_filled where year >= {start})"""


REF_TOTAL = f"""select species, year, coalesce(sum(rpn), 0) as rpn, coalesce(sum(rpw), 0) as rpw
    from panel where strata not in {TARGETS} group by species, year"""
REF_ASIA = "select species, year, rpn, rpw from panel where strata = 'ASIA'"
TOTAL_RATIO = ratio("total_ratio", REF_TOTAL)
NEIGHBOUR_RATIO = ratio("neighbour_ratio", REF_ASIA)


def interpolated(name: str, source: str, columns: list[str], others: str, x: str, maxgap: int) -> str:
    """Interpolate columns of ``source`` along (species, strata) by abscissa ``x``."""
    w = "(partition by species, strata order by year rows between {})"
    back = w.format("unbounded preceding and current row")
    ahead = w.format("current row and unbounded following")
    whole = "(partition by species, strata)"
    ends, out = [], []
    for c in columns:
        for suffix, value in (("pos", "pos"), ("x", x), ("v", c)):
            known = f"case when {c} is not null then {value} end"
            ends.append(f"last_value({known} ignore nulls) over {back} as p_{suffix}_{c}")
            ends.append(f"first_value({known} ignore nulls) over {ahead} as q_{suffix}_{c}")
        ends.append(f"count({c}) over {whole} as n_{c}")
        run = f"coalesce(q_pos_{c}, total + 1) - coalesce(p_pos_{c}, 0) - 1"
        line = f"""p_v_{c} + (q_v_{c} - p_v_{c}) * (cast({x} - p_x_{c} as double) / nullif(q_x_{c} - p_x_{c}, 0))"""
        out.append(f"""case when {c} is null and n_{c} >= 2 and {run} <= {maxgap} then
      case when p_v_{c} is null then q_v_{c} when q_v_{c} is null then p_v_{c} else {line} end
      else {c} end as {c}""")
    return f"""{name}_pos as (
  select *, row_number() over (partition by species, strata order by year) as pos,
    count(*) over {whole} as total from {source}),
{name}_ends as (select *, {', '.join(ends)} from {name}_pos),
{name} as (select species, year, strata, {others}{', '.join(out)} from {name}_ends)"""


def linear(start: int | None, maxgap: int = 20) -> str:
    where = "" if start is None else f" where year >= {start}"
    columns = ["rpn", "rpn_cv", "rpw", "rpw_cv"]
    return f"""with_cv as (
  select *, sqrt(rpn_var) / nullif(rpn, 0) as rpn_cv, sqrt(rpw_var) / nullif(rpw, 0) as rpw_cv
  from grid{where}),
{interpolated('lines', 'with_cv', columns, 'rpn_var, rpw_var, ', 'pos', maxgap)},
linear as (
  select species, year, strata, rpn, coalesce(rpn_var, (rpn_cv * rpn) * (rpn_cv * rpn)) as rpn_var,
    rpw, coalesce(rpw_var, (rpw_cv * rpw) * (rpw_cv * rpw)) as rpw_var, 'linear' as method
  from lines)"""


LINEAR = linear(1996)


def shares(measure: str) -> str:
    return f"""shares as (
  select *, mean_a / nullif(total, 0) as share_a, mean_b / nullif(total, 0) as share_b
  from (select *, case when mean_a = mean_b then mean_a else coalesce(mean_a, 0) + coalesce(mean_b, 0) end as total
    from (select species, avg(case when strata = 'AFRICA' and year >= 1996 then {measure} end) as mean_a,
                 avg(case when strata = 'AMERICA' and year >= 1996 then {measure} end) as mean_b
          from panel where strata in {TARGETS} group by species)))"""


def ltmean(measure: str) -> str:
    m = measure
    return f"""{shares(m)},
span as (select species, unnest(range(min(year), max(year) + 1)) as year
  from panel where strata in {TARGETS} group by species),
wide as (
  select s.species, cast(s.year as int) as year, a.{m} as a, b.{m} as b
  from span s
  left join panel a on a.species = s.species and a.year = s.year and a.strata = 'AFRICA'
  left join panel b on b.species = s.species and b.year = s.year and b.strata = 'AMERICA'),
pairs as (
  select w.species, w.year, w.a, w.b, coalesce(w.a, w.b) / nullif(p.share, 0) as total
  from wide w left join (
    select d.species, d.year, case d.strata when 'AFRICA' then share_a else share_b end as share
    from panel d join shares using (species) where d.strata in {TARGETS} and d.{m} is not null) p
  on w.species = p.species and w.year = p.year),
pairs_a as (select species, year, coalesce(a, total - b) as a, b, total from pairs),
pairs_b as (select species, year, a, coalesce(b, total - a) as b from pairs_a),
ltmean as (
  select species, year, 'AFRICA' as strata, a as {m}, 'ltmean' as method from pairs_b where year >= 1996
  union all
  select species, year, 'AMERICA', b, 'ltmean' from pairs_b where year >= 1996)"""


def external(every: int) -> str:
    return f"external as (select * from panel where strata = 'ASIA' and year % {every} = 0)"


# --- AR(1) model ----------------------------------------------------------------------


def natural(log_pe: str, logit_rho: str) -> str:
    return f"""exp({log_pe}) * exp({log_pe}) as p0, -1 + 2 / (1 + exp(-({logit_rho}))) as rho"""


def observations() -> str:
    one = lambda m: f"""select species, '{m}' as measure, strata, year,
    case when {m} > 0 and {m}_var is not null then ln({m}) end as y,
    case when {m} > 0 and {m}_var is not null
      then ln(1 + (sqrt({m}_var) / {m}) * (sqrt({m}_var) / {m})) end as r
    from grid where strata in {TARGETS}"""
    return f"""obs as (
  select *, row_number() over (partition by species, measure, strata order by year) as pos
  from ({one('rpn')} union all {one('rpw')}))"""


def filtered(params: str, per_group: bool = False) -> str:
    """Kalman filter along each series; ``params`` selects ``(k, p0, rho)``.

    With ``per_group`` they are given for each ``(species, measure)``.
    """
    with_params = "obs join params using (species, measure)" if per_group else "obs, params"
    step = lambda mp, pp: f"""{mp} as m_pred, {pp} as p_pred,
      case when y is null then {mp} else {mp} + ({pp}) / (({pp}) + r) * (y - ({mp})) end as m,
      case when y is null then {pp} else ({pp}) * r / (({pp}) + r) end as p,
      case when y is null then 0 else 0.5 * (ln(2 * pi() * (({pp}) + r))
        + (y - ({mp})) * (y - ({mp})) / (({pp}) + r)) end as nll"""
    following = step("f.rho * f.m", "f.rho * f.rho * f.p + f.p0 * (1 - f.rho * f.rho)")
    following = following.replace("y is null", "o.y is null").replace(" r ", " o.r ")
    return f"""params as ({params}),
f as (
  select k, p0, rho, species, measure, strata, year, pos, {step('cast(0 as double)', 'p0')}
  from {with_params} where pos = 1
  union all
  select f.k, f.p0, f.rho, o.species, o.measure, o.strata, o.year, o.pos, {following}
  from f join obs o on o.species = f.species and o.measure = f.measure and o.strata = f.strata and o.pos = f.pos + 1)"""


def fixed(log_pe: float, logit_rho: float) -> str:
    return f"select 0 as k, {natural(f'cast({log_pe} as double)', f'cast({logit_rho} as double)')}"


# Backward pass of the smoother over the filtered states.
SMOOTHED = """last_pos as (
  select species, measure, strata, max(pos) as pos from f group by all),
s as (
  select f.*, f.m as ms, f.p as ps from f join last_pos using (species, measure, strata, pos)
  union all
  select f.*, f.m + (f.p * f.rho / s.p_pred) * (s.ms - s.m_pred),
    f.p + (f.p * f.rho / s.p_pred) * (f.p * f.rho / s.p_pred) * (s.ps - s.p_pred)
  from s join f on f.species = s.species and f.measure = s.measure and f.strata = s.strata and f.pos = s.pos - 1
    and f.k = s.k)"""

PREDICTED = f"""pred as (
  select species, measure, strata, year, ms as log_pred, sqrt(ps) as log_se, exp(ms) as pred,
    exp(ms) * sqrt(ps) as se, exp(ms - {Z} * sqrt(ps)) as lci, exp(ms + {Z} * sqrt(ps)) as uci
  from s)"""

FIXED = [observations(), filtered(fixed(1.0, 3.0)), SMOOTHED, PREDICTED]
FIXED_DAILY = fixed(0.5, 2.0)

# Starting points of a fit, and the best of them per species and measure.
POINTS = """(select unnest([-3, -2, -1, 0, 1, 2, 3, 4]::double[]) as a) x,
  (select unnest([0, 1, 2, 4, 6, 8]::double[]) as b) y"""


def suffixed(text: str, names: str, suffix: str) -> str:
    """The same CTEs under other names."""
    return re.sub(rf"\b({names})\b", rf"\g<1>{suffix}", text)


def fit_step(n: int, points: str) -> str:
    """Objective per group at its points ``(species, measure, k, a, b)``, and the best of them."""
    steps = filtered(f"select *, {natural('a', 'b')} from ({points})", per_group=True)
    return f"""{suffixed(steps, 'params|f', str(n))},
best{n} as materialized (
  select species, measure, a, b, nll from (
    select species, measure, a, b, nll, row_number() over (partition by species, measure order by nll, k) as rank
    from (select species, measure, k, sum(nll) as nll from f{n} group by all) join params{n} using (species, measure, k))
  where rank = 1)"""


FIRST_FIT = fit_step(
    0,
    f"""select species, measure, k, a, b from (select distinct species, measure from obs),
      (select row_number() over (order by a, b) - 1 as k, a, b from {POINTS})""",
)


def zoomed(n: int, step: float) -> str:
    """A finer grid around the best point so far, which is its first point."""
    offsets = "(select unnest(range(-3, 4)) as i) x, (select unnest(range(-3, 4)) as j) y"
    return fit_step(
        n,
        f"""select species, measure, abs(i) * 100 + abs(j) * 10 + cast(i > 0 as int) * 2 + cast(j > 0 as int) as k,
          a + i * {step} as a, b + j * {step} as b from best{n - 1}, {offsets}""",
    )


ZOOM = [2.0, 2.0, 1.0] + [0.4**n for n in range(1, 9)]

BEST_PARAMS = f"select species, measure, 0 as k, {natural('a', 'b')} from best0"

AR1 = f"""ar1 as (
  select g.species, g.year, g.strata, coalesce(g.rpn, n.pred) as rpn, g.rpn_var,
    coalesce(g.rpw, w.pred) as rpw, g.rpw_var, 'ar1' as method
  from grid g
  join pred n on n.species = g.species and n.strata = g.strata and n.year = g.year and n.measure = 'rpn'
  join pred w on w.species = g.species and w.strata = g.strata and w.year = g.year and w.measure = 'rpw'
  where g.year >= 1996
  union all
  select species, year, strata, rpn, rpn_var, rpw, rpw_var, 'ar1' from panel
  where strata not in {TARGETS} and year >= 1996)"""


# --- AR(1) model with an unknown mean ---------------------------------------------------


def demeaned(params: str, over: str = "species, measure, strata") -> list[str]:
    """Generalised least squares mean per ``over``, and the filter of what is left of the values.

    The same filter runs over the values (f), over ones (f1) and over the values less the mean (f2).
    """
    names = "params|f|obs"
    return [
        observations(),
        filtered(params),
        "obs1 as (select * replace (case when y is not null then 1.0::double end as y) from obs)",
        suffixed(filtered(params), names, "1"),
        f"""means as (
  select {over}, sum((o.y - f.m_pred) * (1 - g.m_pred) / (f.p_pred + o.r)) / sum((1 - g.m_pred) * (1 - g.m_pred) / (f.p_pred + o.r)) as mean,
    sum((1 - g.m_pred) * (1 - g.m_pred) / (f.p_pred + o.r)) as info
  from obs o join f using (species, measure, strata, year) join f1 g using (species, measure, strata, year)
  where o.y is not null group by all)""",
        f"obs2 as (select o.* replace (o.y - mean as y) from obs o left join means using ({over}))",
        suffixed(filtered(params), names, "2"),
    ]


def demeaned_prediction(over: str = "species, measure, strata") -> list[str]:
    names = "last_pos|f|s"
    return [
        suffixed(SMOOTHED, names, "1"),
        suffixed(SMOOTHED, names, "2"),
        f"""around as (
  select a.species, a.measure, a.strata, a.year, a.ms + mean as ms, a.ps + (1 - b.ms) * (1 - b.ms) / info as ps
  from s2 a join s1 b using (species, measure, strata, year) left join means using ({over}))""",
        PREDICTED.replace("from s)", "from around)"),
    ]


# --- stacks and scores ----------------------------------------------------------------


def stacked(*methods: str) -> str:
    rows = " union all by name ".join(f"select * from {m}" for m in methods)
    seen = surveyed("strata", "year")
    return f"""stacked as (
  select *, case when {seen} then rpn end as obs_rpn, case when {seen} then rpw end as obs_rpw from ({rows}))"""


def pdiff(a: str, b: str) -> str:
    return f"100 * abs({a} - {b}) / nullif(({a} + {b}) / 2, 0)"


SCORES = f"""scores as (
  select species, strata, method, avg({pdiff('next_rpn', 'rpn')}) as rpn_stat, avg({pdiff('next_rpw', 'rpw')}) as rpw_stat
  from (select *, lead(obs_rpn) over w as next_rpn, lead(obs_rpw) over w as next_rpw
        from stacked where strata in {TARGETS}
        window w as (partition by species, method, strata order by year))
  group by species, strata, method)"""


def strict_total(source: str, extra: str = "method, ") -> str:
    total = lambda m: f"case when count({m}) = count(*) then sum({m}) end as {m}"
    return f"""totals as (
  select species, {extra}year, {total('rpn')}, {total('rpw')} from {source} group by all)"""


CELL = "species year strata"
VALUES = "rpn rpn_var rpw rpw_var"
PRED = "log_pred log_se pred se lci uci"

ORACLE: dict[str, str] = {
    "extract_alternating": chain(
        cells(
            "raw",
            {"country": "c_mktsegment", **SUPPLIER},
            "l_extendedprice",
            ITEMS,
        ),
        final=keep(CELL, VALUES, f"raw where country = 'BUILDING' and year >= 1996 and {surveyed('strata', 'year')}"),
    ),
    "extract_total": chain(TOTAL, final=keep("species year", VALUES, "published where year >= 1996")),
    "cv_table": chain(
        PANEL,
        final=keep(
            CELL,
            "rpn rpw rpn_cv rpw_cv",
            "(select *, sqrt(rpn_var) / nullif(rpn, 0) as rpn_cv, sqrt(rpw_var) / nullif(rpw, 0) as rpw_cv from panel)",
        ),
    ),
    "obs_ci": chain(
        PANEL,
        f"""logs as (select *, case when rpw > 0 then ln(rpw) end as log_rpw,
          case when rpw > 0 then sqrt(ln(1 + (sqrt(rpw_var) / rpw) * (sqrt(rpw_var) / rpw))) end as sd_log_rpw from panel),
        lims as (select *, exp(log_rpw - {Z} * sd_log_rpw) as rpw_lci, exp(log_rpw + {Z} * sd_log_rpw) as rpw_uci from logs)""",
        final=keep(CELL, "log_rpw sd_log_rpw rpw_lci rpw_uci", "lims"),
    ),
    "ci_transforms": chain(
        PANEL,
        """logs as (select *, case when rpw > 0 then ln(rpw) end as par,
          case when rpw > 0 then sqrt(ln(1 + (sqrt(rpw_var) / rpw) * (sqrt(rpw_var) / rpw))) end as se from panel)""",
        f"""kinds as (select species, year, strata,
          par as i_est, se as i_se, par - {Z} * se as i_lci, par + {Z} * se as i_uci,
          exp(par) as e_est, exp(par) * se as e_se, exp(par - {Z} * se) as e_lci, exp(par + {Z} * se) as e_uci,
          2 / (1 + exp(-(par - 8))) - 1 as x_est,
          2 * 2 * (1 / (1 + exp(-2 * (par - 8)))) * (1 - 1 / (1 + exp(-2 * (par - 8)))) * se as x_se,
          -1 + 2 / (1 + exp(-(par - 8 - {Z} * se))) as x_lci, -1 + 2 / (1 + exp(-(par - 8 + {Z} * se))) as x_uci,
          par as n_est, se as n_se, par - {Z90} * se as n_lci, par + {Z90} * se as n_uci from logs)""",
        final=keep(
            CELL, " ".join(f"{k}_{n}" for k in "iexn" for n in ("est", "se", "lci", "uci")), "kinds"
        ),
    ),
    "logit_roundtrip": chain(
        PANEL,
        """shares as (select species, year, strata, rpn / (rpn + rpw) as x from panel),
        logits as (select *, ln(x / (1 - x)) as logit, ln(((x + 1) / 2) / (1 - (x + 1) / 2)) as logit_wide from shares),
        both_ways as (select *, exp(logit) / (1 + exp(logit)) as back,
          exp(logit_wide) / (1 + exp(logit_wide)) * 2 - 1 as back_wide from logits)""",
        final=keep(CELL, "x logit logit_wide back back_wide", "both_ways"),
    ),
    "grid_complete": chain(PANEL, GRID, final=keep(CELL, VALUES, "grid")),
    "grid_complete_panel": chain(
        PANEL,
        """grid as (select s.species, y.year, a.strata, p.rpn, p.rpn_var, p.rpw, p.rpw_var
          from (select distinct species from panel) s, (select distinct strata from panel) a,
               (select distinct year from panel) y
          left join panel p on p.species = s.species and p.strata = a.strata and p.year = y.year)""",
        final=keep(CELL, VALUES, "grid"),
    ),
    "grid_full_range": chain(
        DAYS,
        """span as (select species, unnest(range(min(year), max(year) + 1)) as year from panel group by species),
        grid as (select s.species, cast(s.year as int) as year, a.strata, p.rpn, p.rpn_var, p.rpw, p.rpw_var
          from span s join (select distinct species, strata from panel) a on a.species = s.species
          left join panel p on p.species = s.species and p.strata = a.strata and p.year = s.year)""",
        final=keep(CELL, VALUES, "grid"),
    ),
    "pivot_area": chain(
        PANEL,
        final="select species, year, "
        + ", ".join(
            f"""round(max(case when strata = '{a}' then rpn end), 6) as "{a}" """
            for a in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
        )
        + "from panel group by species, year",
    ),
    "lag_first_default": chain(PANEL, GRID, LAGS, final=keep(CELL, VALUES + " rpn_lag rpw_lag", "lags")),
    "mean_cv": chain(
        PANEL,
        GRID,
        f"""cvs as (select *, {mean_cv('grid', 1996)} as mean_cv from grid)""",
        final=keep(
            CELL,
            VALUES + " mean_cv",
            f"""(select * replace (
              case when strata in {TARGETS} and year between 1996 and (select max(year) from panel)
                and rpn is not null and rpn_var is null then (mean_cv * rpn) * (mean_cv * rpn) else rpn_var end as rpn_var,
              case when strata in {TARGETS} and year between 1996 and (select max(year) from panel)
                and rpw is not null and rpw_var is null then (mean_cv * rpw) * (mean_cv * rpw) else rpw_var end as rpw_var)
              from cvs)""",
        ),
    ),
    "ratio_fill_total": chain(PANEL, GRID, LAGS, TOTAL_RATIO, final=keep(CELL + " method", VALUES, "total_ratio")),
    "ratio_fill_single": chain(
        PANEL, GRID, LAGS, NEIGHBOUR_RATIO, final=keep(CELL + " method", VALUES, "neighbour_ratio")
    ),
    "ratio_fill_daily": chain(
        DAYS,
        GRID,
        LAGS,
        ratio("total_ratio", REF_TOTAL, 9200),
        final=keep(CELL + " method", VALUES, "total_ratio"),
    ),
    "linear_interpolate": chain(
        DAYS,
        GRID,
        interpolated("lines", "grid", ["rpn", "rpw"], "", "year", 4),
        final=keep(CELL, "rpn rpw", "lines"),
    ),
    "linear_fill": chain(PANEL, GRID, LINEAR, final=keep(CELL + " method", VALUES, "linear")),
    "asof_nearest": chain(
        PANEL,
        external(3),
        f"""met as (
          select o.species, o.strata, o.year, o.rpn, e.year as matched_time, e.rpn as near_rpn, e.rpw as near_rpw,
            row_number() over (partition by o.species, o.strata, o.year order by abs(o.year - e.year), e.year) as nth
          from panel o left join external e on o.species = e.species where o.strata in {TARGETS})""",
        final=keep("species strata year matched_time", "rpn near_rpn near_rpw", "met where nth = 1"),
    ),
    "asof_daily": chain(
        DAYS,
        external(10),
        f"""met as (
          select o.species, o.strata, o.year, o.rpn, e.year as matched_time, e.rpn as near_rpn, e.rpw as near_rpw,
            row_number() over (partition by o.species, o.strata, o.year order by e.year desc) as nth
          from panel o left join external e on o.species = e.species and e.year between o.year - 6 and o.year
          where o.strata in {TARGETS})""",
        final=keep("species strata year matched_time", "rpn near_rpn near_rpw", "met where nth = 1"),
    ),
    "interval_closures": chain(
        DAYS,
        """spans as (
          select species, strata, year as start, cast(year + year % 70 + cast(rpn as int) as int) as end, rpw as level
          from panel where year % 25 = 0)""",
        f"""met as (
          select o.species, o.strata, o.year, o.rpn, s.start, s.end, s.level
          from panel o left join spans s on o.species = s.species and o.strata = s.strata and o.year between s.start and s.end
          where o.strata in {TARGETS})""",
        final=keep("species strata year start", "rpn level", "met").replace("start,", 'start, "end",'),
    ),
    "linear_fill_stored": chain(PANEL, GRID, LINEAR, final=keep(CELL + " method", VALUES, "linear")),
    "linear_fill_daily": chain(DAYS, GRID, linear(None, 6), final=keep(CELL + " method", VALUES, "linear")),
    "linear_fill_supplier_days": chain(
        SUPPLIER_DAYS, GRID, linear(None, 6), final=keep(CELL + " method", VALUES, "linear")
    ),
    "ltmean_share": chain(PANEL, shares("rpw"), final=keep("species", "mean_a mean_b share_a share_b", "shares")),
    "ltmean_fill": chain(PANEL, ltmean("rpw"), final=keep(CELL + " method", "rpw", "ltmean")),
    "total_index": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        strict_total("total_ratio"),
        final=keep("species method year", "rpn rpw", "totals"),
    ),
    "segment_index": chain(
        SEGMENTS,
        GRID,
        LAGS,
        TOTAL_RATIO,
        strict_total("total_ratio"),
        final=keep("species method year", "rpn rpw", "totals"),
    ),
    "index_fixed_cv": chain(
        PANEL,
        f"""grid as (select g.* from (
          select s.species, y.year, s.strata, p.rpn, p.rpn_var, p.rpw, p.rpw_var
          from (select distinct species, strata from panel where strata in {TARGETS}) s
          join (select distinct species, year from panel where strata in {TARGETS}) y on s.species = y.species
          left join panel p on p.species = s.species and p.strata = s.strata and p.year = y.year) g)""",
        LINEAR,
        ltmean("rpn"),
        """sums as (select species, method, year, coalesce(sum(rpn), 0) as rpn, coalesce(sum(rpn_var), 0) as v
          from (select species, method, year, rpn, rpn_var from linear
                union all select species, method, year, rpn, null from ltmean) group by all),
        index as (select species, method, year, rpn,
          case when v = 0 then (0.2 * rpn) * (0.2 * rpn) else v end as rpn_var from sums)""",
        final=keep(
            "species method year",
            "rpn rpn_var lci uci",
            """(select species, method, year, rpn / 1000 as rpn, rpn_var,
              (rpn - 1.96 * sqrt(rpn_var)) / 1000 as lci, (rpn + 1.96 * sqrt(rpn_var)) / 1000 as uci from index)""",
        ),
    ),
    "index_older": chain(
        PANEL,
        "panel_older as (select * from panel where year < 1998)",
        f"""grid as (
          select s.species, y.year, s.strata, p.rpn, p.rpn_var, p.rpw, p.rpw_var
          from (select distinct species, strata from panel where strata in {TARGETS}) s
          join (select distinct species, year from panel where strata in {TARGETS}) y on s.species = y.species
          left join panel p on p.species = s.species and p.strata = s.strata and p.year = y.year)""",
        LINEAR,
        ltmean("rpn"),
        suffixed(ltmean("rpn"), "shares|span|wide|pairs|pairs_a|pairs_b|ltmean|panel", "_older"),
        """sums as (select species, method, year, coalesce(sum(rpn), 0) as rpn, coalesce(sum(rpn_var), 0) as v
          from (select species, method, year, rpn, rpn_var from linear
                union all select species, method, year, rpn, null from ltmean
                union all select species, method, year, rpn, null from ltmean_older) group by all),
        index as (select species, method, year, rpn,
          case when v = 0 then (0.2 * rpn) * (0.2 * rpn) else v end as rpn_var from sums)""",
        final=keep(
            "species method year",
            "rpn rpn_var lci uci",
            """(select species, method, year, rpn / 1000 as rpn, rpn_var,
              (rpn - 1.96 * sqrt(rpn_var)) / 1000 as lci, (rpn + 1.96 * sqrt(rpn_var)) / 1000 as uci from index)""",
        ),
    ),
    "reconcile_total": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        strict_total("total_ratio", ""),
        TOTAL,
        """known as (select species, year, rpn as rpn_published, rpw as rpw_published from published where year >= 1996)""",
        final=keep(
            "species year",
            "rpn rpw rpn_published rpw_published rpn_rel_diff rpw_rel_diff",
            """(select *, (rpn - rpn_published) / nullif(rpn_published, 0) as rpn_rel_diff,
              (rpw - rpw_published) / nullif(rpw_published, 0) as rpw_rel_diff
              from totals full join known using (species, year))""",
        ),
    ),
    "method_stack": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        NEIGHBOUR_RATIO,
        LINEAR,
        stacked("total_ratio", "neighbour_ratio", "linear"),
        final=keep(CELL + " method", VALUES + " obs_rpn obs_rpw", "stacked"),
    ),
    "ordered_methods": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        LINEAR,
        stacked("total_ratio", "linear"),
        final=keep(
            "species strata area_order method method_order year",
            "rpn",
            f"""(select *, list_position({ORDERED_AREAS}, strata)::int as area_order,
              list_position({ORDERED_METHODS}, method)::int as method_order from stacked)""",
        ),
    ),
    "method_score": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        NEIGHBOUR_RATIO,
        LINEAR,
        *FIXED,
        AR1,
        stacked("total_ratio", "neighbour_ratio", "linear", "ar1"),
        SCORES,
        final=keep(
            "species strata method score_rank",
            "rpn_stat rpw_stat",
            """(select *, rank() over (partition by species, strata order by rpn_stat asc nulls last)::int
              as score_rank from scores)""",
        ),
    ),
    "select_like": chain(PANEL, final=keep("species year strata", "rpn rpn_var", "panel")),
    "drop_like": chain(PANEL, final=keep("species year strata", "rpn", "panel")),
    "csv_round_trip": chain(PANEL, final=keep("species year strata", "rpn rpn_var rpw rpw_var", "panel")),
    "csv_inferred": chain(
        PANEL,
        # the keys are whole numbers as text, so whole numbers are what is found
        """typed as (
          select * replace (cast(species as int) as species),
            'rpn double, rpn_var double, rpw double, rpw_var double, species int, strata string, year int' as types from panel)""",
        final=keep("species year strata types", "rpn rpn_var rpw rpw_var", "typed"),
    ),
    "schedule_by_pattern": chain(
        PANEL,
        """marked as (
          select species, year, strata, case when seen then rpn end as obs_rpn, case when seen then rpw end as obs_rpw
          from (select *, strata in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') as seen from panel))""",
        final=keep("species year strata", "obs_rpn obs_rpw", "marked"),
    ),
    "unpivot_area": chain(
        PANEL,
        f"""wide as (
          select d.species, d.year, a.strata, p.rpn
          from (select distinct species, year from panel) d cross join (select unnest({ORDERED_AREAS}) as strata) a
          left join panel p on p.species = d.species and p.year = d.year and p.strata = a.strata)""",
        final=keep("species year strata", "rpn", "wide"),
    ),
    "compare_external": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        NEIGHBOUR_RATIO,
        LINEAR,
        *FIXED,
        AR1,
        f"""observed as (
          select s.species, y.year, s.strata, p.rpn as obs
          from (select distinct species, strata from panel where strata in {TARGETS}) s
          join (select distinct species, year from panel where strata in {TARGETS}) y on s.species = y.species
          left join panel p on p.species = s.species and p.strata = s.strata and p.year = y.year),
        compared as (
          select species, year, strata, obs, e.rpn as estimate, e.method as own,
            case when e.method = 'total_ratio' then 'ratio' when e.method is not null then 'others' end as method
          from observed left join (select * from total_ratio union all by name select * from neighbour_ratio
                                   union all by name select * from linear) e
            using (species, year, strata)
          union all
          select species, year, strata, obs, a.rpn, 'ar1', 'ar1'
          from observed left join ar1 a using (species, year, strata)),
        ahead as (select *, lead(obs) over (partition by species, own, strata order by year) as next_obs from compared)""",
        final=keep(
            "species strata method",
            "mean_pdiff",
            f"""(select species, strata, method, avg({pdiff('next_obs', 'estimate')}) as mean_pdiff
              from ahead group by species, strata, method)""",
        ),
    ),
    "compare_methods": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        NEIGHBOUR_RATIO,
        LINEAR,
        *FIXED,
        AR1,
        stacked("total_ratio", "neighbour_ratio", "linear", "ar1"),
        strict_total("stacked"),
        final=keep("species method year", "rpn rpw", "totals"),
    ),
    "ar1_filter": chain(
        PANEL,
        GRID,
        *FIXED[:2],
        final=keep("species measure strata year", "m_pred p_pred m p nll", "f"),
    ),
    "ar1_filter_daily": chain(
        DAYS,
        GRID,
        observations(),
        filtered(FIXED_DAILY),
        final=keep("species measure strata year", "m_pred p_pred m p nll", "f"),
    ),
    "ar1_filter_supplier_days": chain(
        SUPPLIER_DAYS,
        GRID,
        observations(),
        filtered(FIXED_DAILY),
        final=keep("species measure strata year", "m p nll", "f"),
    ),
    "ar1_grid_fit": chain(
        PANEL,
        GRID,
        observations(),
        filtered(
            f"""select (row_number() over (order by a, b)) - 1 as k, a as log_pe, b as logit_rho, {natural('a', 'b')}
            from (select unnest([-3, -2, -1, 0, 1, 2, 3, 4]::double[]) as a) x, (select unnest([0, 1, 2, 4, 6, 8]::double[]) as b) y"""
        ),
        """objective as (select species, measure, k, sum(nll) as nll from f group by all),
        best as (select *, row_number() over (partition by species, measure order by nll, k) as rank from objective)""",
        final="""select species, measure, round(log_pe, 6) as log_pe, round(logit_rho, 6) as logit_rho,
          round(nll, 6) as nll from best join params using (k) where rank = 1""",
    ),
    "ar1_predict": chain(
        PANEL, GRID, *FIXED, final=keep("species measure strata year", PRED, "pred")
    ),
    "ar1_estimate": chain(
        PANEL,
        GRID,
        observations(),
        FIRST_FIT,
        *(zoomed(n, step) for n, step in enumerate(ZOOM, 1)),
        """seen as (select species, measure, count(y) > 0 as converged from obs group by all)""",
        final=f"""select species, measure, round(case when converged then nll end, 3) as nll, converged
          from seen join best{len(ZOOM)} using (species, measure)""",
    ),
    "ar1_mean": chain(
        PANEL,
        GRID,
        *demeaned(fixed(1.0, 3.0)),
        "every_series as (select distinct species, measure, strata from obs)",
        """shared as (
          select species, measure, sum(mean * info) / sum(info) as mean, sum(info) as info from means group by all)""",
        final="""select species, measure, strata, round(mean, 6) as mean, round(1 / sqrt(info), 6) as mean_se
          from every_series left join means using (species, measure, strata)
          union all
          select species, measure, 'all', round(mean, 6), round(1 / sqrt(info), 6)
          from (select distinct species, measure from every_series) left join shared using (species, measure)""",
    ),
    "ar1_filter_demeaned": chain(
        PANEL,
        GRID,
        *demeaned(fixed(1.0, 3.0)),
        "around as (select f2.* replace (m_pred + mean as m_pred, m + mean as m) from f2 left join means using (species, measure, strata))",
        final=keep("species measure strata year", "m_pred p_pred m p nll", "around"),
    ),
    "ar1_predict_demeaned": chain(
        PANEL,
        GRID,
        *demeaned(fixed(1.0, 3.0)),
        *demeaned_prediction(),
        final=keep("species measure strata year", PRED, "pred"),
    ),
    "ar1_predict_demeaned_daily": chain(
        DAYS,
        GRID,
        *demeaned(FIXED_DAILY, "species, measure"),
        *demeaned_prediction("species, measure"),
        final=keep("species measure strata year", "log_pred log_se", "pred"),
    ),
    "ar1_grid_fit_demeaned": chain(
        PANEL,
        GRID,
        observations(),
        filtered(f"select row_number() over (order by a, b) - 1 as k, a, b, {natural('a', 'b')} from {POINTS}"),
        "obs1 as (select * replace (case when y is not null then 1.0::double end as y) from obs)",
        suffixed(
            filtered(f"select row_number() over (order by a, b) - 1 as k, a, b, {natural('a', 'b')} from {POINTS}"),
            "params|f|obs",
            "1",
        ),
        """parts as (
          select species, measure, strata, f.k, sum(f.nll) as nll,
            sum(case when o.y is not null then (o.y - f.m_pred) * (1 - g.m_pred) / (f.p_pred + o.r) end) as total,
            sum(case when o.y is not null then (1 - g.m_pred) * (1 - g.m_pred) / (f.p_pred + o.r) end) as info
          from obs o join f using (species, measure, strata, year) join f1 g using (species, measure, strata, year)
          where f.k = g.k group by all)""",
        """objective as (
          select species, measure, k, sum(nll - coalesce(total * total / (2 * info), 0)) as nll from parts group by all)""",
        "best as (select *, row_number() over (partition by species, measure order by nll, k) as rank from objective)",
        final="""select species, measure, round(a, 6) as log_pe, round(b, 6) as logit_rho,
          round(nll, 6) as nll from best join params using (k) where rank = 1""",
    ),
    "ar1_fill_demeaned": chain(
        PANEL,
        GRID,
        *demeaned(fixed(1.0, 3.0)),
        *demeaned_prediction(),
        AR1,
        final=keep(CELL + " method", VALUES, "ar1"),
    ),
    "ar1_fill_estimated": chain(
        PANEL,
        GRID,
        observations(),
        FIRST_FIT,
        filtered(BEST_PARAMS, per_group=True),
        SMOOTHED,
        PREDICTED,
        AR1,
        final=keep(CELL + " method", VALUES, "ar1"),
    ),
    "compare_methods_estimated": chain(
        PANEL,
        GRID,
        LAGS,
        TOTAL_RATIO,
        NEIGHBOUR_RATIO,
        LINEAR,
        observations(),
        FIRST_FIT,
        filtered(BEST_PARAMS, per_group=True),
        SMOOTHED,
        PREDICTED,
        AR1,
        stacked("total_ratio", "neighbour_ratio", "linear", "ar1"),
        SCORES,
        final=keep("species strata method", "rpn_stat rpw_stat", "scores"),
    ),
    "ar1_predict_total_se": chain(
        PANEL,
        GRID,
        observations(),
        filtered(
            f"""select k, {natural('a', 'b')} from (values (0, 1.0::double, 3.0::double), (1, 1.001, 3.0),
              (2, 0.999, 3.0), (3, 1.0, 3.001), (4, 1.0, 2.999)) v(k, a, b)"""
        ),
        SMOOTHED,
        """sides as (
          select species, measure, strata, year, max(case when k = 0 then ms end) as ms, max(case when k = 0 then ps end) as ps,
            (max(case when k = 1 then ms end) - max(case when k = 2 then ms end)) / 0.002 as sx,
            (max(case when k = 3 then ms end) - max(case when k = 4 then ms end)) / 0.002 as sy
          from s group by all)""",
        PREDICTED.replace("from s)", """from (
    select species, measure, strata, year, ms, ps + 0.04 * sx * sx + 2 * 0.03 * sx * sy + 0.25 * sy * sy as ps from sides))"""),
        final=keep("species measure strata year", PRED, "pred"),
    ),
    "prediction_score": chain(
        PANEL,
        GRID,
        *FIXED,
        f"""ahead as (
          select g.species, g.strata, p.pred, lead(g.rpw) over (partition by g.species, g.strata order by g.year) as next_obs
          from grid g left join pred p on p.species = g.species and p.strata = g.strata and p.year = g.year
            and p.measure = 'rpw'
          where g.strata in {TARGETS})""",
        final=keep(
            "species strata",
            "pred_stat",
            f"(select species, strata, avg({pdiff('next_obs', 'pred')}) as pred_stat from ahead group by all)",
        ),
    ),
    "ar1_predict_daily": chain(
        DAYS,
        GRID,
        observations(),
        filtered(FIXED_DAILY),
        SMOOTHED,
        PREDICTED,
        final=keep("species measure strata year", "log_pred log_se", "pred"),
    ),
    "ar1_fill": chain(PANEL, GRID, *FIXED, AR1, final=keep(CELL + " method", VALUES, "ar1")),
    "ar1_obs_pred": chain(
        PANEL,
        GRID,
        *FIXED,
        f"""logs as (select *, case when rpw > 0 then ln(rpw) end as log_rpw,
          case when rpw > 0 then sqrt(ln(1 + (sqrt(rpw_var) / rpw) * (sqrt(rpw_var) / rpw))) end as sd_log_rpw
          from grid where strata in {TARGETS}),
        lims as (select l.*, exp(log_rpw - {Z} * sd_log_rpw) as rpw_lci, exp(log_rpw + {Z} * sd_log_rpw) as rpw_uci,
          pred as rpw_pred, se as rpw_se, lci as rpw_pred_lci, uci as rpw_pred_uci, coalesce(rpw, pred) as final
          from logs l left join pred p on p.species = l.species and p.strata = l.strata and p.year = l.year
            and p.measure = 'rpw')""",
        final=keep(
            CELL,
            "rpw rpw_var log_rpw sd_log_rpw rpw_lci rpw_uci rpw_pred rpw_se rpw_pred_lci rpw_pred_uci final",
            "lims",
        ),
    ),
}
