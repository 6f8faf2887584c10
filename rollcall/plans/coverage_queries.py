"""Catalogue: coverage, range completeness, policy what-if and map layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.numeric import percent_int
from rollcall.operators import coverage as cov
from rollcall.operators import keys, layers, scenario
from rollcall.operators.keys import ENTITY, REGION
from rollcall.plans.driver_lists import LISTS_SQL, PLANT, ROLLUP, Lists
from rollcall.plans.registry import query

PLACES = 9


def rounded(df: DataFrame, *cols: str, places: int = PLACES) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def group_sql(
    group: str,
    listing: str,
    *,
    where: str = "true",
    having: str = "true",
    range_: str = "range_list",
) -> str:
    """Entities of a range per group, marked by membership of a listing."""
    return f"""{LISTS_SQL}, status as (
  select r.entity_key, {group} as grp,
         case when exists (select 1 from {listing} l
                           where l.entity_key is not distinct from r.entity_key)
              then 1 else 0 end as is_listed
  from (select distinct entity_key from {range_}) r left join part on p_partkey = r.entity_key
  where {where}
)
select grp, count(*) as total, count(*) - sum(is_listed)::bigint as not_listed,
       sum(is_listed)::bigint as listed,
       (count(*) - sum(is_listed))::double / count(*) as proportion_not_listed
from status group by grp having {having}"""


def named(sql: str, name: str) -> str:
    """Give the group column of ``group_sql`` its name."""
    return sql.replace("select grp, count(*)", f"select grp as {name}, count(*)")


BIG = "case when p_type in ('LARGE', 'MEDIUM') then 'BIG' else p_type end"
BOTH = (
    "(select region_key, entity_key from local_list "
    "union all select region_key, entity_key from national_list)"
)


@query("coverage_by_type", named(group_sql("p_type", "local_list"), "p_type"))
def coverage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.coverage_by(q.range_, q.local, "p_type", attrs=q.types)


@query("coverage_by_type_national", named(group_sql("p_type", "national_list"), "p_type"))
def coverage_by_type_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.coverage_by(q.range_, q.national, "p_type", attrs=q.types)


@query("coverage_by_type_either", named(group_sql("p_type", BOTH), "p_type"))
def coverage_by_type_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.coverage_by(q.range_, [q.local, q.national], "p_type", attrs=q.types)


def rolled_up(q: Lists, listing, **options) -> DataFrame:
    fine = cov.coverage_by(q.range_, listing, "p_type", attrs=q.types)
    return cov.rollup_groups(fine, "p_type", ROLLUP, min_total=10, **options)


@query(
    "coverage_by_type_rollup",
    named(group_sql(BIG, "local_list", having="count(*) >= 10"), "p_type"),
)
def coverage_by_type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return rolled_up(q, q.local)


@query(
    "coverage_by_brand_in_type",
    named(
        group_sql("p_brand", "local_list", where="p_type = 'PROMO'", having="count(*) >= 10"),
        "p_brand",
    ),
)
def coverage_by_brand_in_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.coverage_by(
        q.range_,
        q.local,
        "p_brand",
        attrs=q.attrs.select(ENTITY, "p_type", "p_brand"),
        where=F.col("p_type") == PLANT,
        min_total=10,
    )


@query(
    "coverage_by_brand_compat",
    named(
        group_sql(
            "p_brand", "local_list", where="p_type = 'PROMO'", having="sum(is_listed) < count(*)"
        ),
        "p_brand",
    ),
)
def coverage_by_brand_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.coverage_by(
        q.range_,
        q.local,
        "p_brand",
        attrs=q.attrs.select(ENTITY, "p_type", "p_brand"),
        where=F.col("p_type") == PLANT,
        compat=True,
    )


def entity_sql(keep: str, listings: list[str]) -> str:
    found = " or ".join(
        f"exists (select 1 from {name} l where l.entity_key is not distinct from r.entity_key)"
        for name in listings
    )
    return f"""{LISTS_SQL}
select r.entity_key from (select distinct entity_key from range_list) r where {keep} ({found})"""


@query("covered_entities", entity_sql("", ["local_list"]))
def covered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.on_any(q.range_, q.local)


@query("uncovered_entities", entity_sql("not", ["local_list"]))
def uncovered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.not_on(q.range_, q.local)


@query("uncovered_both", entity_sql("not", ["local_list", "national_list"]))
def uncovered_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.not_on(q.range_, [q.local, q.national])


@query("covered_any", entity_sql("", ["local_list", "national_list"]))
def covered_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.on_any(q.range_, [q.local, q.national])


@query(
    "covered_any_rows",
    f"""{LISTS_SQL}
select r.region_key, r.entity_key from range_list r
where exists (select 1 from {BOTH} l where l.entity_key is not distinct from r.entity_key)""",
)
def covered_any_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return keys.covered_any(q.range_, [q.local, q.national])


@query(
    "listed_not_in_range",
    f"""{LISTS_SQL}
select l.region_key, l.entity_key, l.ranking from local_list l
where not exists (select 1 from range_list r where r.entity_key is not distinct from l.entity_key)""",
)
def listed_not_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return keys.uncovered(q.local, q.range_)


@query(
    "listed_not_in_range_by_type",
    f"""{LISTS_SQL}
select p_type, count(*) as n
from (select distinct entity_key from local_list) l left join part on p_partkey = l.entity_key
where not exists (select 1 from range_list r where r.entity_key is not distinct from l.entity_key)
group by p_type""",
)
def listed_not_in_range_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.composition(
        keys.attach(cov.not_on(q.local, q.range_), q.types, ENTITY, null_safe=()), "p_type"
    )


@query(
    "not_assessed",
    f"""{LISTS_SQL}
select l.entity_key from (select distinct entity_key from local_list) l
where not exists (select 1 from range_list r where r.entity_key is not distinct from l.entity_key)
  and not exists (select 1 from national_list f where f.entity_key is not distinct from l.entity_key)""",
)
def not_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.not_on(q.local, [q.range_, q.national])


@query(
    "covered_by_region",
    f"""{LISTS_SQL}
select r.region_key, r.entity_key from range_list r
where exists (select 1 from local_list l where l.region_key = r.region_key
              and l.entity_key is not distinct from r.entity_key)""",
)
def covered_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.covered_by_region(q.range_, q.local)


def region_sql(range_: str, listing: str) -> str:
    """Per-region coverage of a list by another, with every nation."""
    return f"""{LISTS_SQL}, marked as (
  select r.region_key,
         case when exists (select 1 from {listing} l where l.region_key = r.region_key
                           and l.entity_key is not distinct from r.entity_key)
              then 1 else 0 end as is_listed
  from {range_} r
), counts as (
  select region_key, count(*) as total, sum(is_listed)::bigint as listed
  from marked group by region_key
)
select n_nationkey as region_key, n_name, coalesce(total, 0) as total,
       coalesce(listed, 0) as listed,
       coalesce(listed::double / nullif(total, 0), 0) as proportion_listed,
       coalesce((total - listed)::double / nullif(total, 0), 1) as proportion_not_listed
from nation left join counts on region_key = n_nationkey"""


def by_region(q: Lists, range_: DataFrame, listing) -> DataFrame:
    return cov.coverage_by_region(range_, listing, regions=q.regions)


@query("coverage_by_region", region_sql("range_list", "local_list"))
def coverage_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return by_region(q, q.range_, q.local)


@query("coverage_by_region_national", region_sql("range_list", "national_list"))
def coverage_by_region_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return by_region(q, q.range_, q.national)


@query("coverage_by_region_merged", region_sql("range_list", BOTH))
def coverage_by_region_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return by_region(q, q.range_, [q.national, q.local])


@query("national_coverage_by_region", region_sql("national_list", "local_list"))
def national_coverage_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return by_region(q, q.national, q.local)


@query(
    "national_coverage_by_region_plants",
    region_sql(
        "(select f.* from national_list f join part on p_partkey = f.entity_key "
        "where p_type = 'PROMO')",
        "(select l.* from local_list l join part on p_partkey = l.entity_key "
        "where p_type = 'PROMO')",
    ),
)
def national_coverage_by_region_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    plants = q.types.where(F.col("p_type") == PLANT)
    out = by_region(q, keys.covered(q.national, plants), keys.covered(q.local, plants))
    return out


@query(
    "national_coverage_by_region_animals",
    region_sql(
        "(select f.* from national_list f join part on p_partkey = f.entity_key "
        "where p_type <> 'PROMO')",
        "local_list",
    ),
)
def national_coverage_by_region_animals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the left list is restricted; the local list is taken whole."""
    q = Lists(spark, sf_dir)
    animals = q.types.where(F.col("p_type") != PLANT)
    return by_region(q, keys.covered(q.national, animals), q.local)


@query("national_coverage_by_region_after_policy", region_sql("national_list", "local_left"))
def national_coverage_by_region_after_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return by_region(q, q.national, policy_left(q))


def range_sql(listing: str, where: str = "true", *, within: bool = False) -> str:
    occurs = (
        f"(select count(*) from {listing} l join range_list r2 on r2.region_key = l.region_key "
        "and r2.entity_key = l.entity_key where l.entity_key = o.entity_key)"
        if within
        else "listed.n"
    )
    return f"""{LISTS_SQL}, occur as (
  select entity_key, count(*) as regions_occur from range_list group by entity_key
), listed as (
  select entity_key, count(*) as n from {listing} group by entity_key
), both_lists as (
  select o.entity_key, regions_occur, {occurs} as regions_listed
  from occur o join listed on listed.entity_key is not distinct from o.entity_key
)
select entity_key, regions_occur, regions_listed,
       regions_listed::double / regions_occur as proportion_listed
from both_lists where {where}"""


@query("range_coverage", range_sql("local_list"))
def range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.range_coverage(q.range_, q.local)


@query("range_coverage_national", range_sql("national_list"))
def range_coverage_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.range_coverage(q.range_, q.national)


@query(
    "range_coverage_merged",
    range_sql("(select distinct region_key, entity_key from " + BOTH + ")"),
)
def range_coverage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    # Which list a row comes from does not matter here, so its columns are not read.
    merged = keys.any_of([q.national, q.local], [REGION, ENTITY]).distinct()
    return cov.range_coverage(q.range_, merged)


@query("range_coverage_within", range_sql("local_list", within=True))
def range_coverage_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.range_coverage(q.range_, q.local, within_range=True)


@query("range_coverage_after_policy", range_sql("local_left"))
def range_coverage_after_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.range_coverage(q.range_, policy_left(q))


@query(
    "fully_covered_endemics",
    range_sql("local_list", "regions_listed >= regions_occur and regions_occur = 1"),
)
def fully_covered_endemics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.endemics(cov.fully_covered(cov.range_coverage(q.range_, q.local)))


@query(
    "entire_range_by_type",
    named(
        group_sql(
            "p_type",
            "(select o.entity_key from "
            "(select entity_key, count(*) as n from range_list group by entity_key) o join "
            "(select entity_key, count(*) as n from local_list group by entity_key) s "
            "on s.entity_key is not distinct from o.entity_key where s.n >= o.n)",
        ),
        "p_type",
    ),
)
def entire_range_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage where only entities listed in their whole range count as listed."""
    q = Lists(spark, sf_dir)
    whole = cov.fully_covered(cov.range_coverage(q.range_, q.local))
    return cov.coverage_by(q.range_, whole, "p_type", attrs=q.types)


SINGLE = """(select entity_key, count(*) as regions_occur from national_list
  group by entity_key having count(*) = 1)"""


@query("single_region", f"{LISTS_SQL}\nselect entity_key, regions_occur from {SINGLE}")
def single_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.single_region(Lists(spark, sf_dir).national)


@query(
    "single_region_detail",
    f"""{LISTS_SQL}
select f.entity_key, f.region_key, f.status, s.regions_occur
from national_list f join {SINGLE} s on s.entity_key is not distinct from f.entity_key""",
)
def single_region_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.single_region_detail(Lists(spark, sf_dir).national)


@query(
    "single_region_unprotected",
    f"""{LISTS_SQL}
select p_type, count(*) as n from {SINGLE} s left join part on p_partkey = s.entity_key
where not exists (select 1 from local_list l where l.entity_key is not distinct from s.entity_key)
group by p_type""",
)
def single_region_unprotected(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    lost = cov.not_on(cov.single_region(q.national), q.local)
    return cov.composition(keys.attach(lost, q.types, ENTITY, null_safe=()), "p_type")


@query(
    "single_region_kept_after_policy",
    f"""{LISTS_SQL}
select s.entity_key from {SINGLE} s
where exists (select 1 from local_left l where l.entity_key is not distinct from s.entity_key)""",
)
def single_region_kept_after_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.on_any(cov.single_region(q.national), policy_left(q))


@query(
    "entity_counts",
    f"""{LISTS_SQL}
select l.region_key, l.entity_key, l.ranking, c.regions_listed from local_list l
join (select entity_key, count(*) as regions_listed from local_list group by entity_key) c
  on c.entity_key is not distinct from l.entity_key""",
)
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.with_group_count(Lists(spark, sf_dir).local, ENTITY, "regions_listed")


@query(
    "counts_by_region",
    f"""{LISTS_SQL}
select n_nationkey as region_key, n_name, count(l.region_key) as n
from nation left join local_list l on l.region_key = n_nationkey group by n_nationkey, n_name""",
)
def counts_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.counts_by_region(q.local, q.regions)


@query(
    "counts_by_region_split",
    f"""{LISTS_SQL}
select n_nationkey as region_key, n_name,
       count(*) filter (where p_type = 'PROMO') as n_plants,
       count(*) filter (where p_type <> 'PROMO') as n_animals
from nation left join local_list l on l.region_key = n_nationkey
left join part on p_partkey = l.entity_key group by n_nationkey, n_name""",
)
def counts_by_region_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    typed = keys.attach(q.local, q.types, ENTITY, null_safe=())
    return cov.split_counts_by_region(
        typed, q.regions, F.col("p_type") == PLANT, ("n_plants", "n_animals")
    )


@query(
    "counts_with_placeholders",
    f"""{LISTS_SQL}, stacked as (
  select region_key from range_list union all
  select n_nationkey from nation where n_regionkey = 0
)
select region_key, case when count(*) = 1 then 0 else count(*) end as n
from stacked group by region_key""",
)
def counts_with_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    placeholders = q.table("nation").where("n_regionkey = 0").select(
        F.col("n_nationkey").alias(REGION)
    )
    return cov.placeholder_counts_by_region(q.range_, placeholders, as_zero=True)


@query(
    "headline",
    f"""{LISTS_SQL}, entities as (
  select case when exists (select 1 from local_list l
                           where l.entity_key is not distinct from r.entity_key)
              then 0 else 1 end as missed
  from (select distinct entity_key from range_list) r
), marked as (
  select r.region_key,
         case when exists (select 1 from local_list l where l.region_key = r.region_key
                           and l.entity_key is not distinct from r.entity_key)
              then 1 else 0 end as is_listed
  from range_list r
), regions as (
  select n_nationkey as region_key, coalesce(avg(is_listed), 0) as share
  from nation left join marked on region_key = n_nationkey group by n_nationkey
)
select (select count(*) from entities) as entities,
       (select sum(missed)::bigint from entities) as entities_uncovered,
       (select avg(missed) from entities) as share_uncovered,
       count(*) as n_regions,
       (select region_key from regions order by share desc, region_key desc limit 1) as top_region,
       max(share) as top_proportion_listed,
       count(*) filter (where share > 0.5) as n_above_half,
       count(*) filter (where share <= 0.5) as n_half_or_less,
       count(*) filter (where share < 1.0 / 3) as n_below_third,
       round(avg(1 - share), {PLACES}) as mean_not_listed
from regions""",
)
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    overall = cov.share_uncovered(q.range_, q.local).select(
        F.struct("total", "not_listed", "proportion_not_listed")
    )
    regions = cov.headline(by_region(q, q.range_, q.local)).withColumn("_all", overall.scalar())
    out = regions.select(
        F.col("_all.total").alias("entities"),
        F.col("_all.not_listed").alias("entities_uncovered"),
        F.col("_all.proportion_not_listed").alias("share_uncovered"),
        *(F.col(c) for c in regions.columns if c != "_all"),
    )
    return rounded(out, "mean_not_listed")


@query(
    "merge_priority",
    f"""{LISTS_SQL}, stacked as (
  select region_key, entity_key, status as ranking, 1 as list_priority from national_list
  union all select region_key, entity_key, ranking, 2 from local_list
)
select region_key, entity_key, ranking, list_priority from (
  select *, row_number() over (partition by region_key, entity_key order by list_priority) as k
  from stacked) where k = 1""",
)
def merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return keys.merge_lists([q.national.withColumnRenamed("status", "ranking"), q.local])


@query(
    "merge_one_region",
    f"""{LISTS_SQL}, stacked as (
  select region_key, entity_key, ranking, 1 as list_priority from local_list
  union all select region_key, entity_key, status, 2 from national_list where region_key = 3
)
select region_key, entity_key, ranking, list_priority from (
  select *, row_number() over (partition by region_key, entity_key order by list_priority) as k
  from stacked) where k = 1""",
)
def merge_one_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local list completed by one region's national rows."""
    q = Lists(spark, sf_dir)
    extra = q.national.where(F.col(REGION) == 3).withColumnRenamed("status", "ranking")
    return keys.merge_lists([q.local, extra])


@query(
    "union_fill",
    f"""{LISTS_SQL}
select region_key, entity_key, ranking, null::varchar as status, 1 as list_priority from local_list
union all
select region_key, entity_key, null, status, 2 from national_list""",
)
def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return keys.stack_lists([q.local, q.national])


def policy_left(q: Lists) -> DataFrame:
    return scenario.apply_policy(q.local, q.national_typed, q.policy, rules=q.rules)


def marks(q: Lists) -> DataFrame:
    return scenario.policy_marks(q.range_, q.local, q.national_typed, q.policy, rules=q.rules)


@query("policy_removal", f"{LISTS_SQL}\nselect region_key, entity_key, ranking from local_left")
def policy_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_left(Lists(spark, sf_dir))


@query("coverage_after_policy", named(group_sql("p_type", "local_left"), "p_type"))
def coverage_after_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.coverage_by(q.range_, policy_left(q), "p_type", attrs=q.types)


@query(
    "coverage_delta",
    f"""{LISTS_SQL}, before_rows as (
  select r.region_key, count(*) as n from range_list r
  where exists (select 1 from {BOTH} l where l.region_key = r.region_key
                and l.entity_key is not distinct from r.entity_key) group by r.region_key
), after_rows as (
  select r.region_key, count(*) as n from range_list r
  where exists (select 1 from local_left l where l.region_key = r.region_key
                and l.entity_key is not distinct from r.entity_key) group by r.region_key
)
select n_nationkey as region_key, coalesce(a.n, 0) as after, coalesce(b.n, 0) as before,
       coalesce(b.n, 0) - coalesce(a.n, 0) as lost,
       (coalesce(b.n, 0) - coalesce(a.n, 0))::double / nullif(coalesce(b.n, 0), 0) * 100
         as percent_lost
from nation left join before_rows b on b.region_key = n_nationkey
left join after_rows a on a.region_key = n_nationkey""",
)
def coverage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range rows that lose all cover: on either list before, on the reduced local list after."""
    q = Lists(spark, sf_dir)
    return scenario.policy_change_by_region(marks(q), regions=q.regions.select(REGION))


@query(
    "coverage_delta_by_type",
    f"""{LISTS_SQL}, marked as (
  select p_type,
    case when exists (select 1 from local_list l where l.entity_key is not distinct from r.entity_key)
         then 1 else 0 end as b,
    case when exists (select 1 from local_left l where l.entity_key is not distinct from r.entity_key)
         then 1 else 0 end as a
  from (select distinct entity_key from range_list) r left join part on p_partkey = r.entity_key
)
select p_type, sum(a)::bigint as after, sum(b)::bigint as before,
       (sum(b) - sum(a))::bigint as lost,
       (sum(b) - sum(a))::double / nullif(sum(b), 0) * 100 as percent_lost
from marked group by p_type""",
)
def coverage_delta_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return scenario.policy_change_by_group(marks(q), q.types, "p_type")


@query(
    "region_layer",
    f"""{LISTS_SQL}, counts as (
  select region_key, count(*) as n from range_list group by region_key
)
select n_nationkey as region_key, n_name, coalesce(n, -1) as n,
       case when n is null then 1 else 0 end as is_missing,
       case when n < 0 or n > 400 then 1 else 0 end as off_scale,
       coalesce(case when n < 0 or n > 400 then null when n >= 400 then 4 when n >= 300 then 3
                     when n >= 200 then 2 when n >= 100 then 1 when n >= 0 then 0 end, -1)
         as legend_bin
from nation left join counts on region_key = n_nationkey""",
)
def region_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    metric = q.range_.groupBy(REGION).agg(F.count(F.lit(1)).alias("n"))
    out = layers.region_layer(
        metric, q.regions, "n", limits=(0, 400), breaks=[0, 100, 200, 300, 400]
    )
    return out.fillna(-1, ["n", "legend_bin"])


@query(
    "region_layer_percent",
    f"""{LISTS_SQL}, marked as (
  select f.region_key,
         case when exists (select 1 from local_list l where l.region_key = f.region_key
                           and l.entity_key is not distinct from f.entity_key)
              then 1 else 0 end as is_listed
  from national_list f
), pct as (
  select region_key, trunc(avg(is_listed) * 100)::int as v, avg(is_listed) as share
  from marked group by region_key
), shown as (
  select n_nationkey as region_key, n_name, case when share > 0 then v end as v
  from nation left join pct on region_key = n_nationkey
)
select region_key, n_name, coalesce(v, -1) as percent_listed,
       case when v is null then 1 else 0 end as is_missing,
       case when v < 0 or v > 100 then 1 else 0 end as off_scale,
       coalesce(case when v >= 100 then 4 when v >= 75 then 3 when v >= 50 then 2
                     when v >= 25 then 1 when v >= 0 then 0 end, -1) as legend_bin
from shown""",
)
def region_layer_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of national rows also on the local list, as the whole percentage a map shows."""
    q = Lists(spark, sf_dir)
    metric = by_region(q, q.national, q.local).withColumn(
        "percent_listed", percent_int("proportion_listed")
    )
    out = layers.region_layer(
        metric, q.regions, "percent_listed", limits=(0, 100), breaks=[0, 25, 50, 75, 100]
    )
    return out.fillna(-1, ["percent_listed", "legend_bin"])


# Lists with null keys: every seventh entity and every fifth region is unknown.
HOLES = """, r as (
  select case when region_key % 5 = 1 then null else region_key end as region_key,
         case when entity_key % 7 = 3 then null else entity_key end as entity_key from range_list
), l as (
  select case when region_key % 5 = 2 then null else region_key end as region_key,
         case when entity_key % 7 = 3 then null else entity_key end as entity_key from local_list
)"""


def with_holes(df: DataFrame, turn: int) -> DataFrame:
    region, entity = F.col(REGION), F.col(ENTITY)
    return df.select(
        F.when(region % 5 != turn, region).alias(REGION),
        F.when(entity % 7 != 3, entity).alias(ENTITY),
    )


@query(
    "null_keys_uncovered",
    f"""{LISTS_SQL}{HOLES}
select coalesce(region_key, -1) as region_key, coalesce(entity_key, -1) as entity_key from r
where not exists (select 1 from l where l.region_key = r.region_key
                  and l.entity_key is not distinct from r.entity_key)""",
)
def null_keys_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null entities match null ones, null regions match nothing, and no row is dropped."""
    q = Lists(spark, sf_dir)
    out = keys.uncovered(with_holes(q.range_, 1), with_holes(q.local, 2), [REGION, ENTITY])
    return out.fillna(-1)


@query(
    "null_keys_by_region",
    f"""{LISTS_SQL}{HOLES}, marked as (
  select r.region_key,
         case when exists (select 1 from l where l.region_key = r.region_key
                           and l.entity_key is not distinct from r.entity_key)
              then 1 else 0 end as is_listed
  from r
)
select coalesce(region_key, -1) as region_key, count(*) as total, sum(is_listed)::bigint as listed,
       avg(is_listed) as proportion_listed,
       (count(*) - sum(is_listed))::double / count(*) as proportion_not_listed
from marked group by region_key""",
)
def null_keys_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    return cov.coverage_by_region(with_holes(q.range_, 1), with_holes(q.local, 2)).fillna(
        -1, [REGION]
    )


@query(
    "null_keys_small_listing",
    f"""{LISTS_SQL}{HOLES}
select coalesce(region_key, -1) as region_key, count(*) as total,
       count(*) filter (where exists (select 1 from l where l.region_key = r.region_key
         and l.entity_key is not distinct from r.entity_key)) as listed
from r group by region_key""",
)
def null_keys_small_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts with the range rows marked by a join."""
    q = Lists(spark, sf_dir)
    out = cov.coverage_by_region(
        with_holes(q.range_, 1), with_holes(q.local, 2), small_listing=True
    )
    return out.fillna(-1, [REGION]).select(REGION, "total", "listed")
