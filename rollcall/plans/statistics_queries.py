"""Catalogue: contingency tests, correlation, regression and model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.numeric import with_transforms
from rollcall.operators import contingency, layers, linear
from rollcall.operators import coverage as cov
from rollcall.operators.keys import ENTITY, REGION, attach, stack_lists
from rollcall.plans.coverage_queries import (
    BIG,
    BOTH,
    group_sql,
    policy_left,
    rolled_up,
    rounded,
)
from rollcall.plans.driver_lists import LISTS_SQL, PLANT, ROLLED_TYPES, Lists
from rollcall.plans.registry import query

CELLS = ("not_listed", "listed")
G_PLACES = 6


def counts_sql(grp: str, listing: str, **options: str) -> str:
    """Grouped counts as CTE ``t`` with columns grp, o1 and o2."""
    inner = group_sql(grp, listing, **options)
    head, tail = inner.rsplit("\nselect grp", 1)
    cells = "k as (select grp, not_listed as o1, listed as o2 from t)"
    return f"{head}, t as (\nselect grp{tail}\n), {cells}"


EXACT_G_SQL = """
, cells as (
  select grp, 1 as j, o1::double as o from k union all select grp, 2, o2::double from k
), e as (
  select o, sum(o) over (partition by grp) * sum(o) over (partition by j) / sum(o) over () as ex
  from cells
)
select 2 * sum(case when o > 0 then o * ln(o / ex) else 0 end) as g,
       (select count(*) - 1 from k) as df,
       sum(o)::bigint as n
from e"""

G_SQL = EXACT_G_SQL.replace("select 2 * sum(", "select round(2 * sum(").replace(
    "end) as g", "end), 6) as g"
)

PAIR_SQL = """
, pairs as (
  select a.grp as group_a, b.grp as group_b, a.o1::double as a1, a.o2::double as a2,
         b.o1::double as b1, b.o2::double as b2
  from k a join k b on a.grp < b.grp
), m as (
  select *, a1 + a2 as ra, b1 + b2 as rb, a1 + b1 as c1, a2 + b2 as c2, a1 + a2 + b1 + b2 as n
  from pairs
), g as (
  select group_a, group_b, greatest(0.0, 2 * (
    case when a1 > 0 then a1 * ln(a1 * n / (ra * c1)) else 0 end +
    case when a2 > 0 then a2 * ln(a2 * n / (ra * c2)) else 0 end +
    case when b1 > 0 then b1 * ln(b1 * n / (rb * c1)) else 0 end +
    case when b2 > 0 then b2 * ln(b2 * n / (rb * c2)) else 0 end)) as g
  from m
)"""


def erf_sql(x: str) -> str:
    """The error function as a series of positive terms, for x from 0 to about 10."""
    return f"""case when {x} <= 0 then 0.0 when {x} > 10 then 1.0 else list_sum(list_transform(
      range(0, 400), lambda k: exp((2 * k + 1) * ln({x}) - {x} * {x} - lgamma(k + 1.5)))) end"""


def t_tail_sql(t: str, free: str) -> str:
    """P(|T| >= t) for an odd whole number of degrees of freedom, as a finite sum."""
    angle = f"atan(abs({t}) / sqrt({free}))"
    terms = f"""list_sum(list_transform(range(0, ({free} - 1)::int // 2), lambda k:
      exp(k * ln(4.0) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * cos({angle}) ** (2 * k)))"""
    return f"(1 - 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {terms}))"


def large_t_tail_sql(t: str, free: str) -> str:
    """The same for many degrees of freedom: the normal tail and its first correction."""
    density = f"exp(-{t} * {t} / 2) / sqrt(2 * pi())"
    normal = erf_sql(f"(abs({t}) / sqrt(2.0))")
    return f"(1 - ({normal}) + {density} * (abs({t}) ** 3 + abs({t})) / (2 * {free}))"


def even_t_tail_sql(t: str, free: str) -> str:
    """P(|T| >= t) for an even whole number of degrees of freedom, as a finite sum."""
    angle = f"atan(abs({t}) / sqrt({free}))"
    terms = f"""list_sum(list_transform(range(0, ({free})::int // 2), lambda k:
      exp(lgamma(2 * k + 1) - k * ln(4.0) - 2 * lgamma(k + 1)) * cos({angle}) ** (2 * k)))"""
    return f"(1 - sin({angle}) * {terms})"


def t_quantile_sql(z: float, free: str) -> str:
    """The t quantile for more than a thousand degrees of freedom, from the normal quantile z.

    The expansion in 1 / df; what it leaves out is below 1e-13 there.
    """
    parts = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    powers = " + ".join(f"{c!r} / ({free} ** {i})" for i, c in enumerate(parts, start=1))
    return f"({z!r} + {powers})"


#: 97.5 % of the normal distribution lie below.
NORMAL_975 = 1.959963984540054

PAIR_P = "round(1 - (" + erf_sql("sqrt(g / 2)") + "), 6)"
PAIR_ROWS = f"\nselect group_a, group_b, round(g, 6) as g, 1 as df, {PAIR_P} as p from g"


def test_of(df: DataFrame) -> DataFrame:
    return rounded(contingency.g_test(df, CELLS, with_p=False), "g", places=G_PLACES)


def pairs_of(df: DataFrame, group: str) -> DataFrame:
    return rounded(contingency.pairwise_g_test(df, group, CELLS), "g", "p", places=G_PLACES)


ROLLED = counts_sql(BIG, "local_list", having="count(*) >= 10")
BRANDS = counts_sql("p_brand", "local_list", where="p_type = 'PROMO'", having="count(*) >= 10")


def brands(q: Lists) -> DataFrame:
    return cov.coverage_by(
        q.range_,
        q.local,
        "p_brand",
        attrs=q.attrs.select(ENTITY, "p_type", "p_brand"),
        where=F.col("p_type") == PLANT,
        min_total=10,
    )


@query("g_test", ROLLED + G_SQL)
def g_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return test_of(rolled_up(q, q.local))


@query(
    "g_test_p",
    f"""with t as ({(ROLLED + EXACT_G_SQL)})
select round(g, 6) as g, df, n, round(case df when 2 then exp(-g / 2) when 4 then exp(-g / 2) * (1 + g / 2) end, 6)
  as p from t""",
)
def g_test_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With its p value, which SQL can state for an even number of degrees of freedom."""
    q = Lists(spark, sf_dir)
    out = contingency.g_test(rolled_up(q, q.local), CELLS)
    return rounded(out, "g", "p", places=G_PLACES)


@query("g_test_national", counts_sql(BIG, "national_list", having="count(*) >= 10") + G_SQL)
def g_test_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return test_of(rolled_up(q, q.national))


@query("g_test_either", counts_sql(BIG, BOTH, having="count(*) >= 10") + G_SQL)
def g_test_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return test_of(rolled_up(q, [q.local, q.national]))


@query("g_test_after_policy", counts_sql(BIG, "local_left", having="count(*) >= 10") + G_SQL)
def g_test_after_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return test_of(rolled_up(q, policy_left(q)))


@query("g_test_brand", BRANDS + G_SQL)
def g_test_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_of(brands(Lists(spark, sf_dir)))


@query(
    "g_test_status_by_type",
    f"""{LISTS_SQL}, c as (
  select p_type as i, status as j, count(*)::double as o
  from national_list left join part on p_partkey = entity_key group by 1, 2
), e as (
  select i, j, o, sum(o) over (partition by i) * sum(o) over (partition by j) / sum(o) over () as ex
  from c
)
select round(2 * sum(o * ln(o / ex)), 6) as g,
       ((select count(distinct i) from c) - 1) * ((select count(distinct j) from c) - 1) as df,
       sum(o)::bigint as n
from e""",
)
def g_test_status_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An r x c table straight from list rows."""
    q = Lists(spark, sf_dir)
    return rounded(
        contingency.g_test_long(q.national_typed, "p_type", "status", with_p=False),
        "g",
        places=G_PLACES,
    )


@query("pairwise_g", ROLLED + PAIR_SQL + PAIR_ROWS)
def pairwise_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return pairs_of(rolled_up(q, q.local), "p_type")


@query("pairwise_g_brand", BRANDS + PAIR_SQL + PAIR_ROWS)
def pairwise_g_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(brands(Lists(spark, sf_dir)), "p_brand")


@query(
    "pairwise_matrix",
    ROLLED
    + PAIR_SQL
    + "\nselect group_b, "
    + ", ".join(
        f"coalesce(max({PAIR_P}) filter (where group_a = '{t}'), -1) as \"{t}\""
        for t in ROLLED_TYPES[:-1]
    )
    + " from g group by group_b",
)
def pairwise_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower triangle of p; -1 marks the empty half."""
    q = Lists(spark, sf_dir)
    pairs = pairs_of(rolled_up(q, q.local), "p_type")
    return contingency.to_matrix(pairs, "p", columns=ROLLED_TYPES[:-1]).fillna(-1.0)


@query(
    "counts_long",
    ROLLED
    + "\nselect grp as p_type, 'not_listed' as cell, o1 as n from k "
    + "union all select grp, 'listed', o2 from k",
)
def counts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return contingency.to_long(rolled_up(q, q.local), "p_type", CELLS)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_retailprice", "p_size"]


def measured_lines(q: Lists) -> DataFrame:
    """Order lines with the numeric columns of their part and the nation of their supplier."""
    part = q.table("part").select("p_partkey", "p_retailprice", "p_size")
    supplier = q.table("supplier").select("s_suppkey", F.col("s_nationkey").alias(REGION))
    lines = q.table("lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )


LINES_SQL = """with lines as (
  select l_quantity, l_extendedprice, l_discount, l_tax, p_retailprice, p_size::double as p_size,
         s_nationkey as region_key
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
)"""


@query(
    "corr_matrix",
    LINES_SQL
    + " union all ".join(
        f"\nselect '{a}' as x, '{b}' as y, round(corr({a}, {b}), 8) as r, "
        f"count(*) filter (where {a} is not null and {b} is not null) as n from lines"
        for i, a in enumerate(MEASURES)
        for b in MEASURES[i + 1 :]
    ),
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = measured_lines(Lists(spark, sf_dir))
    return rounded(linear.corr_matrix(lines, MEASURES).drop("p"), "r", places=8)


LINE_COLUMNS = """round(corr(l_extendedprice, l_quantity), 8) as r,
       round(regr_r2(l_extendedprice, l_quantity), 8) as r2,
       round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept"""


def rounded_line(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "r", "r2", places=8), "slope", "intercept", places=4)


@query("fit_line", f"{LINES_SQL}\nselect count(*) as n, {LINE_COLUMNS} from lines")
def fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = measured_lines(Lists(spark, sf_dir))
    return rounded_line(linear.fit_line(lines, "l_quantity", "l_extendedprice", with_p=False))


@query(
    "fit_line_leave_out",
    f"{LINES_SQL}\nselect count(*) as n, {LINE_COLUMNS} from lines where region_key <> 11",
)
def fit_line_leave_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linear.leave_out(measured_lines(Lists(spark, sf_dir)), 11)
    return rounded_line(linear.fit_line(lines, "l_quantity", "l_extendedprice", with_p=False))


@query(
    "scatter_layer",
    f"""with f as (
  select regr_slope(o_totalprice, o_custkey) as b, regr_intercept(o_totalprice, o_custkey) as a,
    count(*) as n, avg(o_custkey) as m, regr_sxx(o_totalprice, o_custkey) as sxx,
    corr(o_totalprice, o_custkey) as r, regr_r2(o_totalprice, o_custkey) as r2,
    regr_syy(o_totalprice, o_custkey) * (1 - regr_r2(o_totalprice, o_custkey)) as rss
  from orders
), g as (
  select *, {t_quantile_sql(NORMAL_975, "(n - 2)")} as reach,
    {even_t_tail_sql("(r * sqrt((n - 2) / (1 - r2)))", "(n - 2)")} as p
  from f
), s as (
  select o_orderkey, o_custkey, o_totalprice, a + b * o_custkey as fitted, reach, r2, p,
    sqrt(rss / (n - 2) * (1.0 / n + (o_custkey - m) * (o_custkey - m) / sxx)) as se_fit
  from orders, g
)
select o_orderkey, o_custkey, o_totalprice, round(fitted, 4) as fitted, round(se_fit, 4) as se_fit,
  round(fitted - reach * se_fit, 4) as ci_low, round(fitted + reach * se_fit, 4) as ci_high,
  round(r2, 8) as r2, round(p, 6) as p
from s""",
)
def scatter_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Lists(spark, sf_dir).table("orders")
    out = layers.scatter_layer(orders, "o_custkey", "o_totalprice", keep=["o_orderkey"])
    out = rounded(out, "fitted", "se_fit", "ci_low", "ci_high", places=4)
    return rounded(rounded(out, "r2", places=8), "p", places=6)


@query(
    "fit_line_by_region",
    f"{LINES_SQL}\nselect region_key, count(*) as n, {LINE_COLUMNS} from lines group by region_key",
)
def fit_line_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = measured_lines(Lists(spark, sf_dir))
    return rounded_line(
        linear.fit_line(lines, "l_quantity", "l_extendedprice", by=REGION, with_p=False)
    )


@query(
    "leave_each_out",
    f"""{LINES_SQL}, s as (
  select region_key, count(*) as n, sum(l_quantity) as x, sum(l_extendedprice) as y,
         sum(l_quantity * l_quantity) as xx, sum(l_quantity * l_extendedprice) as xy
  from lines group by region_key
), rest as (
  select region_key, sum(n) over () - n as n, sum(x) over () - x as x, sum(y) over () - y as y,
         sum(xx) over () - xx as xx, sum(xy) over () - xy as xy
  from s
), f as (
  select region_key, n::bigint as n, x, y, (xy - x * y / n) / (xx - x * x / n) as b from rest
)
select region_key, 'l_quantity' as term, n, round(b, 4) as estimate from f
union all
select region_key, '(Intercept)', n, round((y - b * x) / n, 4) from f""",
)
def leave_each_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line refitted without each nation in turn."""
    lines = measured_lines(Lists(spark, sf_dir))
    fits = linear.ols_leave_each_out(lines, "l_extendedprice", ["l_quantity"])
    return rounded(fits.select(REGION, "term", "n", "estimate"), "estimate", places=4)


def charged_lines(q: Lists) -> DataFrame:
    """Order lines with what was charged for them."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return measured_lines(q).withColumn("charge", charge)


@query(
    "ols_two",
    f"""{LINES_SQL}, c as (
  select l_extendedprice as x1, l_discount as x2,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) as y from lines
), m as (
  select count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2,
         var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12,
         covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y, var_pop(y) as syy
  from c
), b as (
  select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2
  from m
), v as (
  select *, n * (syy - b1 * s1y - b2 * s2y) / (n - 3) as var_e,
         n * (s11 * s22 - s12 * s12) as det from b
), fit as (
  select '(Intercept)' as term, my - b1 * m1 - b2 * m2 as estimate,
         sqrt(var_e * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det))
           as std_error, n - 3 as df_residual from v
  union all select 'l_extendedprice', b1, sqrt(var_e * s22 / det), n - 3 from v
  union all select 'l_discount', b2, sqrt(var_e * s11 / det), n - 3 from v
)
select term, round(estimate, 4) as estimate, round(std_error, 6) as std_error, df_residual
from fit""",
)
def ols_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = linear.ols(
        charged_lines(Lists(spark, sf_dir)), "charge", ["l_extendedprice", "l_discount"]
    )
    out = fit.select("term", "estimate", "std_error", "df_residual")
    return rounded(rounded(out, "estimate", places=4), "std_error", places=6)


PREDICTORS = MEASURES
_NAMES = "[" + ", ".join(f"'{x}'" for x in PREDICTORS) + "]"
_SIZE = len(PREDICTORS) + 1
_COLUMNS = ["charge", *PREDICTORS]
_CROSS = ", ".join(f"count(*) * covar_pop({a}, {b})" for a in _COLUMNS for b in _COLUMNS)


def _eliminated(a: str, k: str) -> str:
    """The cross-products ``a`` after taking out what variable number ``k`` explains."""
    return f"""list_transform(range(0, {_SIZE * _SIZE}), lambda p:
      {a}[p + 1] - {a}[(p // {_SIZE}) * {_SIZE} + {k} + 1] * {a}[{k} * {_SIZE} + p % {_SIZE} + 1]
        / {a}[{k} * {_SIZE} + {k} + 1])"""


def _swept(a: str, k: str) -> str:
    """The sweep by variable ``k``: slopes, minus the inverse, and what is left come out."""
    pivot = f"{a}[{k} * {_SIZE} + {k} + 1]"
    row, column = f"(p // {_SIZE})", f"(p % {_SIZE})"
    return f"""list_transform(range(0, {_SIZE * _SIZE}), lambda p: case
      when {row} = {k} and {column} = {k} then -1 / {pivot}
      when {row} = {k} or {column} = {k} then {a}[p + 1] / {pivot}
      else {a}[p + 1] - {a}[{row} * {_SIZE} + {k} + 1] * {a}[{k} * {_SIZE} + {column} + 1] / {pivot} end)"""


def search_sql(penalty: str, start: int, moves: str) -> str:
    """All subsets of the predictors by elimination, then the path of the search over them."""
    full = len(PREDICTORS)
    return f"""{LINES_SQL.replace("with lines", "with recursive lines")}, c as (
  select *, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge from lines
), size as (select count(*)::double as n from c
), base as (
  select count(*)::double as n, [{_CROSS}] as a, [{", ".join(f"avg({x})" for x in _COLUMNS)}] as means
  from c
), subsets as (
  select 0 as k, 0 as mask, a, n from base
  union all
  select k + 1, mask + b * (1 << k)::int, case b when 1 then {_eliminated("a", "(k + 1)")} else a end, n
  from subsets, (select unnest([0, 1]) as b) where k < {full}
), crit as (
  select mask, n * ln(a[1] / n) + {penalty} * (bit_count(mask) + 1) as c from subsets where k = {full}
), path as (
  select 0 as step, mask, 'start' as move, {_NAMES if start else "[]::varchar[]"} as terms, c
  from crit where mask = {start}
  union all
  select step, mask, move, terms, c from (
    select p.step + 1 as step, x.mask,
      case when x.mask < p.mask then '- ' else '+ ' end || name as move,
      case when x.mask < p.mask then list_filter(terms, lambda t: t <> name)
           else list_append(terms, name) end as terms, x.c
    from (select *, unnest(range(0, {full})) as j from path) p
    join crit x on x.mask = xor(p.mask, (1 << p.j)::int),
    lateral (select ({_NAMES})[p.j + 1] as name)
    where x.c < p.c - 1e-9 and {moves}
    qualify row_number() over (order by x.c, move) = 1)
)"""


@query(
    "step_aic",
    search_sql("2", 63, "true")
    + """
select step::bigint as step, move, terms, round(c, 4) as criterion,
  (step = max(step) over ())::int::bigint as is_final, n::bigint as n, null::varchar as reason
from path, size""",
)
def step_aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = charged_lines(Lists(spark, sf_dir))
    out = linear.step_aic(lines, "charge", PREDICTORS, direction="both")
    return rounded(out, "criterion", places=4)


@query(
    "step_aic_two",
    f"""{LINES_SQL}, c as (
  select l_extendedprice as x1, l_discount as x2,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) as y from lines
), m as (
  select count(*) as n, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12,
         covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y, var_pop(y) as syy
  from c
), a as (
  select n, n * ln(syy) + 2 as a0, n * ln(syy - s1y * s1y / s11) + 4 as a1,
         n * ln(syy - s2y * s2y / s22) + 4 as a2,
         n * ln(syy - (s22 * s1y * s1y - 2 * s12 * s1y * s2y + s11 * s2y * s2y)
                      / (s11 * s22 - s12 * s12)) + 6 as a12
  from m
), b as (select *, least(a1, a2) as one from a), path as (
  select 0 as step, 'start' as move, a0 as criterion, n from b
  union all
  select 1, case when a1 <= a2 then '+ l_extendedprice' else '+ l_discount' end, one, n
  from b where one < a0
  union all
  select 2, case when a1 <= a2 then '+ l_discount' else '+ l_extendedprice' end, a12, n
  from b where one < a0 and a12 < one
)
select step::bigint as step, move, round(criterion, 3) as criterion, n from path""",
)
def step_aic_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forward search small enough for SQL to walk all of it."""
    lines = charged_lines(Lists(spark, sf_dir))
    out = linear.step_aic(lines, "charge", ["l_extendedprice", "l_discount"], direction="forward")
    return rounded(out, "criterion", places=3).select("step", "move", "criterion", "n")


@query(
    "step_fit",
    search_sql("ln(n)", 0, "x.mask > p.mask")
    + f""", chosen as (select mask, terms from path order by step desc limit 1
), sweeps as (
  select 0 as k, a from base
  union all
  select k + 1, case when (mask >> k) & 1 = 1 then {_swept("a", "(k + 1)")} else a end
  from sweeps, chosen where k < {len(PREDICTORS)}
), done as (
  select s.a, b.a[1] as total, means, n, n - len(terms) - 1 as free, s.a[1] / (n - len(terms) - 1) as v,
    list_filter(range(1, {_SIZE}), lambda j: (mask >> (j - 1)) & 1 = 1) as js
  from sweeps s, base b, chosen where s.k = {len(PREDICTORS)}
), fit as (
  select ({_NAMES})[j] as term, a[j + 1] as estimate, sqrt(-v * a[j * {_SIZE} + j + 1]) as std_error,
    n, free, 1 - a[1] / total as r2
  from (select *, unnest(js) as j from done)
  union all
  select '(Intercept)',
    means[1] - coalesce(list_sum(list_transform(js, lambda j: a[j + 1] * means[j + 1])), 0),
    sqrt(v * (1 / n - coalesce(list_sum(list_transform(js, lambda i: list_sum(list_transform(js, lambda j:
      means[i + 1] * a[i * {_SIZE} + j + 1] * means[j + 1])))), 0))), n, free, 1 - a[1] / total
  from done
)
select term, round(estimate, 4) as estimate, round(std_error, 6) as std_error,
  round(estimate / std_error, 3) as t,
  round(greatest(0, {large_t_tail_sql("(estimate / std_error)", "free")}), 5) as p,
  n::bigint as n, round(r2, 8) as r2
from fit""",
)
def step_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = charged_lines(Lists(spark, sf_dir))
    out = linear.step_fit(lines, "charge", PREDICTORS, direction="forward", penalty=None)
    out = out.select("term", "estimate", "std_error", "t", "p", "n", "r2")
    for column, places in (("estimate", 4), ("std_error", 6), ("t", 3), ("p", 5), ("r2", 8)):
        out = rounded(out, column, places=places)
    return out


REGION_FACTS_SQL = f"""{LISTS_SQL}, listed as (
  select region_key, count(*) as n from local_list group by region_key
), facts as (
  select c_nationkey as region_key, count(*) as customers, avg(c_acctbal) as balance
  from customer group by c_nationkey
), t as (
  select n_nationkey, log10(coalesce(n, 0) + 1) as y, log10(coalesce(customers, 0) + 1) as x, balance
  from nation left join listed l on l.region_key = n_nationkey
  left join facts f on f.region_key = n_nationkey
), line as (
  select count(*)::double as n, count(*)::double - 2 as free, avg(x) as mx, regr_sxx(y, x) as sxx,
    regr_slope(y, x) as b, regr_intercept(y, x) as a, corr(y, x) as r, regr_syy(y, x) as syy,
    regr_syy(y, x) * (1 - regr_r2(y, x)) as rss
  from t
)"""


def region_facts(q: Lists) -> DataFrame:
    """One row per region: logged listed entities and logged customers."""
    customers = q.table("customer").select(F.col("c_nationkey").alias(REGION))
    facts = cov.counts_by_region(customers, q.regions, out="customers").drop("n_name")
    table = attach(cov.counts_by_region(q.local, q.regions), facts, REGION, null_safe=())
    return with_transforms(table, log10p1=["n", "customers"])


@query(
    "region_model",
    f"""{REGION_FACTS_SQL}, e as (
  select '(Intercept)' as term, a as estimate, sqrt(rss / free * (1 / n + mx * mx / sxx)) as se, line.* from line
  union all select 'log10p1_customers', b, sqrt(rss / free / sxx), line.* from line
)
select term, round(estimate, 6) as estimate, round(se, 6) as std_error, round(estimate / se, 5) as t,
  round({t_tail_sql("(estimate / se)", "free")}, 6) as p, round(1 - rss / syy, 6) as r2,
  round(1 - rss / free / (syy / (n - 1)), 6) as adj_r2, round((syy - rss) / (rss / free), 4) as f,
  round({t_tail_sql("sqrt((syy - rss) / (rss / free))", "free")}, 6) as f_p, n::bigint as n
from e""",
)
def region_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled counts per region, joined to region facts, logged and fitted."""
    fit = linear.ols(region_facts(Lists(spark, sf_dir)), "log10p1_n", ["log10p1_customers"])
    fit = fit.select("term", "estimate", "std_error", "t", "p", "r2", "adj_r2", "f", "f_p", "n")
    fit = rounded(fit, "estimate", "std_error", "p", "r2", "adj_r2", "f_p", places=6)
    return rounded(rounded(fit, "t", places=5), "f", places=4)


@query(
    "region_line",
    f"""{REGION_FACTS_SQL}
select n::bigint as n, round(r, 6) as r, round(r * r, 6) as r2, round(b, 6) as slope,
  round(a, 6) as intercept, round({t_tail_sql("(r * sqrt(free / (1 - r * r)))", "free")}, 6) as p
from line""",
)
def region_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model as a line with the p value of its correlation."""
    out = linear.fit_line(region_facts(Lists(spark, sf_dir)), "log10p1_customers", "log10p1_n")
    return rounded(out, "r", "r2", "slope", "intercept", "p", places=6)


@query(
    "region_correlations",
    f"""{REGION_FACTS_SQL}, pairs as (
  select 'log10p1_n' as x, 'log10p1_customers' as y, corr(y, x) as r, count(*)::double as n from t
  union all select 'log10p1_n', 'n_nationkey', corr(y, n_nationkey), count(*)::double from t
  union all select 'log10p1_customers', 'n_nationkey', corr(x, n_nationkey), count(*)::double from t
)
select x, y, round(r, 6) as r, n::bigint as n,
  round({t_tail_sql("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")}, 6) as p from pairs""",
)
def region_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of three regional columns with their p values."""
    table = region_facts(Lists(spark, sf_dir)).withColumn("n_nationkey", F.col(REGION))
    out = linear.corr_matrix(table, ["log10p1_n", "log10p1_customers", "n_nationkey"])
    return rounded(out, "r", "p", places=6)


SPLIT_SQL = f"""{LISTS_SQL}, sides as (
  select region_key, case when p_type = '{PLANT}' then 'plants' else 'animals' end as model, count(*) as n
  from local_list join part on p_partkey = entity_key group by 1, 2
), facts as (
  select c_nationkey as region_key, count(*) as customers, avg(c_acctbal) as balance
  from customer group by c_nationkey
), t as (
  select m.model, log10(coalesce(s.n, 0) + 1) as y, f.balance as x1, log10(coalesce(customers, 0) + 1) as x2
  from nation cross join (select unnest(['plants', 'animals']) as model) m
  left join sides s on s.region_key = n_nationkey and s.model = m.model
  left join facts f on f.region_key = n_nationkey
  where f.balance is not null
), m as (
  select model, count(*)::double as n, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12,
         covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y, var_pop(y) as syy
  from t group by model
), a as (
  select model, n, n * ln(syy) + 2 as a0, n * ln(syy - s1y * s1y / s11) + 4 as a1,
         n * ln(syy - s2y * s2y / s22) + 4 as a2,
         n * ln(syy - (s22 * s1y * s1y - 2 * s12 * s1y * s2y + s11 * s2y * s2y)
                      / (s11 * s22 - s12 * s12)) + 6 as a12
  from m
), b as (select *, least(a1, a2) as one, a1 <= a2 as keeps_1 from a
), path as (
  select model, n, 0 as step, 'start' as move, ['balance', 'log10p1_customers'] as terms, a12 as criterion from b
  union all
  select model, n, 1, case when keeps_1 then '- log10p1_customers' else '- balance' end,
    case when keeps_1 then ['balance'] else ['log10p1_customers'] end, one from b where one < a12
  union all
  select model, n, 2, case when keeps_1 then '- balance' else '- log10p1_customers' end,
    []::varchar[], a0 from b where one < a12 and a0 < one
)
select model, step::bigint as step, move, terms, round(criterion, 6) as criterion,
  (step = max(step) over (partition by model))::int::bigint as is_final, n::bigint as n,
  null::varchar as reason
from path"""


@query("region_model_split", SPLIT_SQL)
def region_model_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection rerun on the plant and on the animal rows, both models from one pass."""
    q = Lists(spark, sf_dir)
    typed = attach(q.local, q.types, ENTITY, null_safe=())
    plant = F.col("p_type") == PLANT
    customers = q.table("customer").select(F.col("c_nationkey").alias(REGION), "c_acctbal")
    facts = customers.groupBy(REGION).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("balance")
    )
    sides = [
        cov.counts_by_region(typed, q.regions, where=condition).withColumn("model", F.lit(name))
        for name, condition in (("plants", plant), ("animals", ~plant))
    ]
    table = attach(stack_lists(sides).drop("list_priority"), facts, REGION, null_safe=())
    table = with_transforms(table.fillna(0, ["customers"]), log10p1=["n", "customers"])
    out = linear.step_aic(
        table, "log10p1_n", ["balance", "log10p1_customers"], direction="both", by="model"
    )
    return rounded(out, "criterion", places=6)
