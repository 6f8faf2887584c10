"""Catalogue: cleaning, text expressions, transforms and name resolution."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import text
from rollcall.functions.numeric import percent_int, ratio, with_transforms
from rollcall.operators import clean, keys, resolve
from rollcall.plans.coverage_queries import rounded
from rollcall.plans.driver_lists import Lists
from rollcall.plans.registry import query

# The widened \s of the Spark side, spelt the same way for the SQL side.
S = text.SPACE
NATION_FIXES = {"nation_1": "nation_10", "nation_2": "nation_20"}
DROPPED_NATIONS = ["nation_7", "nation_8"]


@query(
    "clean_states",
    """select c_custkey, case lower(n_name) when 'nation_1' then 'nation_10'
       when 'nation_2' then 'nation_20' else lower(n_name) end as state
from customer join nation on c_nationkey = n_nationkey
where lower(n_name) not in ('nation_7', 'nation_8')""",
)
def clean_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    rows = q.table("customer").join(q.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    state = text.fix_values(F.lower("n_name"), NATION_FIXES)
    return rows.select("c_custkey", state.alias("state")).where(
        text.not_in("state", DROPPED_NATIONS)
    )


def raw_list(q: Lists) -> DataFrame:
    """A messy list: mixed-case region, three-word names, ranks, repeated keys."""
    lines = q.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    supplier = q.table("supplier").select("s_suppkey", "s_nationkey")
    nation = q.table("nation").select("n_nationkey", "n_name")
    part = q.table("part").select("p_partkey", "p_name", "p_brand")
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("n_name").alias("state"),
            F.concat_ws(" ", "p_name", "p_brand").alias("species"),
            F.col("l_returnflag").alias("ranking"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
        )
    )


@query(
    "clean_list",
    """with raw as (
  select lower(n_name) as state, p_name || ' ' || p_brand as species,
         nullif(l_returnflag, 'R') as ranking, l_orderkey, l_linenumber, l_partkey
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join part on l_partkey = p_partkey
), first_raw as (
  select * from (select *, row_number() over (partition by state, species
    order by l_orderkey, l_linenumber, ranking nulls first, l_partkey) as k from raw) where k = 1
), ruled as (
  select case state when 'nation_1' then 'nation_10' when 'nation_2' then 'nation_20'
              else state end as state,
         split_part(species, ' ', 1) || ' ' || split_part(species, ' ', 2) as species,
         ranking, l_orderkey, l_linenumber, l_partkey
  from first_raw
)
select state, species, ranking, l_orderkey, l_linenumber, l_partkey from (
  select *, row_number() over (partition by state, species
    order by l_orderkey, l_linenumber, ranking nulls first, l_partkey) as k
  from ruled
  where state not in ('nation_7', 'nation_8')
    and coalesce(ranking not in ('X'), true) and not (state = 'nation_3' and ranking = 'N')
    and not (state = 'nation_4' and coalesce(ranking in ('A', 'R'), false))
) where k = 1""",
)
def clean_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows have no rank: equality drops them in its region, list membership does not."""
    state, ranking = F.col("state"), F.col("ranking")
    unranked = F.nullif(ranking, F.lit("R"))
    return clean.clean_list(
        raw_list(Lists(spark, sf_dir)).withColumn("ranking", unranked),
        ["l_orderkey", "l_linenumber"],
        fixes=NATION_FIXES,
        drop_regions=DROPPED_NATIONS,
        exclusions=[
            text.is_in(ranking, ["X"]),
            (state == "nation_3") & (ranking == "N"),
            (state == "nation_4") & text.is_in(ranking, ["A", "R"]),
        ],
        first_on_clean=True,
    )


@query(
    "binomial",
    """select doc_id, case when contains(text, ' ')
       then split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) end as first_two
from documents""",
)
def binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Lists(spark, sf_dir).table("documents")
    return docs.select("doc_id", text.binomial("text").alias("first_two"))


NAME_PATTERNS = [r"\s(ring)$", r"^(new)\s", r"\s(bo..)$", r"\s(g.)"]


@query(
    "name_filter",
    "select p_partkey, p_name from part where not regexp_matches(p_name, '"
    + "|".join(f"(?:{p.replace(chr(92) + 's', S)})" for p in NAME_PATTERNS)
    + "')",
)
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Lists(spark, sf_dir).table("part").select("p_partkey", "p_name")
    return part.where(text.name_ok("p_name", NAME_PATTERNS))


TEXT_PATTERNS = [*text.PLACEHOLDER, *text.UNRESOLVABLE, r"\s(for)\.$", r"\s(the.)$"]


def _portable(pattern: str) -> str:
    """The Spark pattern for RE2: ``.`` and ``$`` treat every line end as Java does."""
    line_end = r"\n\r\x{85}\x{2028}\x{2029}"
    out = pattern.replace(r"\s", S).replace("$", rf"(?:\r\n|[{line_end}])?\z")
    return re.sub(r"(?<!\\)\.", lambda _: f"[^{line_end}]", out)


@query(
    "name_filter_texts",
    "select doc_id, md5(text) as text_md5 from documents where not regexp_matches(text, '"
    + "|".join(f"(?:{_portable(p)})" for p in TEXT_PATTERNS)
    + "')",
)
def name_filter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that match neither the standard patterns nor two that occur in prose."""
    docs = Lists(spark, sf_dir).table("documents").select("doc_id", "text")
    kept = docs.where(text.name_ok("text", TEXT_PATTERNS))
    return kept.select("doc_id", F.md5("text").alias("text_md5"))


LISTED_NAME = "p_name || ' Wherever found (' || p_name || ' (=' || p_type || ') ' || p_brand || ')'"


@query(
    "strip_parens",
    f"""select p_partkey,
       regexp_replace(regexp_replace(regexp_extract({LISTED_NAME}, '\\(.*'), '[()]', '', 'g'),
                      '=[A-Za-z0-9_]+ *', '', 'g') as name
from part""",
)
def strip_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Lists(spark, sf_dir).table("part")
    return part.select("p_partkey", text.strip_parens(F.expr(LISTED_NAME)).alias("name"))


@query(
    "strip_parens_texts",
    f"""select doc_id, coalesce(md5(case when contains(text, '(') then
       regexp_replace(regexp_replace(regexp_extract(text, '\\([^\n\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*'),
                                     '[()]', '', 'g'),
                      '={text.WORD}+ *', '', 'g') end), '') as inner_md5
from documents""",
)
def strip_parens_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same extraction on whole prose texts, most of which hold no parenthesis."""
    docs = Lists(spark, sf_dir).table("documents").select("doc_id", "text")
    inner = F.md5(text.strip_parens("text"))
    return docs.select("doc_id", F.coalesce(inner, F.lit("")).alias("inner_md5"))


@query(
    "remove_first",
    """select doc_id, md5(regexp_replace(text, '\\.', '')) as text_md5,
       length(regexp_replace(text, '\\.', '')) as n_chars_left
from documents""",
)
def remove_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Lists(spark, sf_dir).table("documents").select("doc_id", "text")
    left = docs.withColumn("text", text.remove_first("text", r"\."))
    return left.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("n_chars_left"),
    )


@query(
    "transforms",
    """select o_orderkey, round(log10(o_totalprice), 8) as log10_o_totalprice,
       round(log10(o_custkey + 1), 8) as log10p1_o_custkey,
       round(sqrt(o_totalprice), 8) as sqrt_o_totalprice,
       o_custkey::double / nullif(o_orderkey, 0) as share,
       coalesce(trunc(o_custkey::double / nullif(o_orderkey, 0) * 100)::int, -1) as percent,
       o_orderkey::varchar || '-' || o_orderstatus as label
from orders""",
)
def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Lists(spark, sf_dir).table("orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    )
    out = with_transforms(
        orders, log10=["o_totalprice"], log10p1=["o_custkey"], sqrt=["o_totalprice"]
    )
    out = out.withColumn("share", ratio("o_custkey", "o_orderkey"))
    out = out.withColumns(
        {
            "percent": F.coalesce(percent_int("share", zero_as_null=False), F.lit(-1)),
            "label": F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderstatus"),
        }
    ).drop("o_custkey", "o_totalprice", "o_orderstatus")
    return rounded(out, "log10_o_totalprice", "log10p1_o_custkey", "sqrt_o_totalprice", places=8)


@query(
    "first_by",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_quantity) as k from lineitem) where k = 1""",
)
def first_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Lists(spark, sf_dir).table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return keys.first_by(lines, "l_orderkey", ["l_linenumber"])


@query(
    "group_total",
    """select p_partkey, p_type, p_size, sum(p_size) over (partition by p_type)::bigint as type_size
from part""",
)
def group_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Lists(spark, sf_dir).table("part").select("p_partkey", "p_type", "p_size")
    return keys.with_group_total(part, "p_type", "p_size", "type_size")


@query("distinct_values", "select distinct p_brand from part where p_type = 'PROMO'")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Lists(spark, sf_dir).table("part")
    return part.where("p_type = 'PROMO'").select("p_brand").distinct()


@query(
    "select_range",
    "select o_custkey, o_orderstatus, o_totalprice as price from orders where o_orderstatus <> 'F'",
)
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column range, rename and a null-dropping inequality."""
    orders = Lists(spark, sf_dir).table("orders")
    picked = keys.select_range(orders, "o_custkey", "o_totalprice")
    return picked.withColumnRenamed("o_totalprice", "price").where(F.col("o_orderstatus") != "F")


NAMES_SQL = """with names as (
  select p_name as scientific_name,
         min(case when p_name like 'old %' then null
                  when p_name like 'cold %' then replace(p_name, 'cold', 'hot')
                  else p_name end) as standard_name
  from part where p_name not like 'new %' group by p_name
)"""


def name_table(q: Lists) -> DataFrame:
    """Entries with a synonym, with a null standard name, and with names missing altogether."""
    name = F.col("p_name")
    standard = F.when(name.like("old %"), F.lit(None)).when(
        name.like("cold %"), F.regexp_replace(name, "cold", "hot")
    )
    return q.table("part").where(~name.like("new %")).select(
        name.alias("scientific_name"),
        F.when(name.like("old %"), F.lit(None)).otherwise(F.coalesce(standard, name)).alias(
            "standard_name"
        ),
    )


@query(
    "resolve_names",
    NAMES_SQL
    + """
select p_partkey, p_name as species,
       case when scientific_name is not null then standard_name else p_name end as accepted_name
from part left join names on scientific_name = p_name""",
)
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    rows = q.table("part").select("p_partkey", F.col("p_name").alias("species"))
    return resolve.resolve_names(rows, name_table(q))


@query(
    "repair_accepted",
    NAMES_SQL
    + """
select p_partkey, p_name as species,
       coalesce(case when scientific_name is not null then standard_name else p_name end,
                regexp_replace(p_name, 'o', '')) as accepted_name
from part left join names on scientific_name = p_name
where (case when scientific_name is not null then standard_name else p_name end) is not null
   or not regexp_matches(p_name, 'ring$')""",
)
def repair_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    rows = q.table("part").select("p_partkey", F.col("p_name").alias("species"))
    resolved = resolve.resolve_names(rows, name_table(q))
    return clean.repair_accepted(resolved, drop=["ring$"], strip=["o"])


@query(
    "unresolved",
    NAMES_SQL
    + """
select distinct p_name as species from part
where p_name not in (select scientific_name from names) and not regexp_matches(p_name, 'bolt$')""",
)
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Lists(spark, sf_dir)
    rows = q.table("part").select(F.col("p_name").alias("species"))
    return resolve.unresolved(rows, name_table(q), patterns=["bolt$"])


def fuzzy_sql(dirty: str, backbone: str, max_dist: int) -> str:
    """Every pair compared, the nearest kept."""
    return f"""with dirty as (select distinct {dirty} as species from part),
known as (select distinct {backbone} as standard_name from part),
pairs as (
  select species, standard_name, levenshtein(species, standard_name) as d
  from dirty join known on levenshtein(species, standard_name) <= {max_dist}
), best as (
  select species, standard_name, d,
         row_number() over (partition by species order by d, standard_name) as k from pairs
)
select dirty.species, coalesce(standard_name, '') as standard_name, coalesce(d, -1) as distance,
       case when d is null then 'none' when d = 0 then 'exact' else 'fuzzy' end as match_type
from dirty left join best on best.species = dirty.species and k = 1"""


def fuzzy(q: Lists, dirty: str, backbone: str, max_dist: int) -> DataFrame:
    part = q.table("part")
    out = resolve.fuzzy_resolve(
        part.select(F.expr(dirty).alias("species")),
        part.select(F.expr(backbone).alias("standard_name")),
        max_dist=max_dist,
    )
    return out.fillna({"standard_name": "", "distance": -1})


DIRTY = (
    "case when p_size % 3 = 0 then p_name when p_size % 3 = 1 "
    "then substr(p_name, 1, 2) || substr(p_name, 4) else p_name || 'x' end"
)


@query("fuzzy_resolve", fuzzy_sql(DIRTY, "p_name", 1))
def fuzzy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy(Lists(spark, sf_dir), DIRTY, "p_name", 1)


LONG_NAME = "p_name || ' ' || p_brand || ' ' || p_type"
LONG_DIRTY = (
    "case p_size % 4 when 0 then p_name || ' ' || p_brand || ' ' || p_type "
    "when 1 then substr(p_name, 2) || ' ' || p_brand || 'z ' || p_type "
    "when 2 then replace(p_name, 'i', 'y') || ' ' || p_brand || ' ' || p_type "
    "else 'zzz ' || p_brand || ' ' || p_type end"
)


@query("fuzzy_resolve_two", fuzzy_sql(LONG_DIRTY, LONG_NAME, 2))
def fuzzy_resolve_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy(Lists(spark, sf_dir), LONG_DIRTY, LONG_NAME, 2)


@query(
    "resolve_with_retry",
    NAMES_SQL
    + """, missing as (
  select distinct p_name as species from part
  where p_name not in (select scientific_name from names)
), known as (
  select distinct p_name as standard_name from part where p_name not like 'new %'
), pairs as (
  select species, standard_name, levenshtein(species, standard_name) as d
  from missing join known on levenshtein(species, standard_name) <= 2
), best as (
  select species, standard_name from (
    select *, row_number() over (partition by species order by d, standard_name) as k from pairs)
  where k = 1
)
select p_partkey, p_name as species,
       case when scientific_name is not null then names.standard_name
            else coalesce(best.standard_name, p_name) end as accepted_name
from part left join names on scientific_name = p_name left join best on best.species = p_name""",
)
def resolve_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names missing from the table get a second, fuzzy lookup before rows are resolved."""
    q = Lists(spark, sf_dir)
    rows = q.table("part").select("p_partkey", F.col("p_name").alias("species"))
    known = q.table("part").where("p_name not like 'new %'").select(
        F.col("p_name").alias("standard_name")
    )
    names = resolve.extend_names(name_table(q), rows, known, max_dist=2)
    return resolve.resolve_names(rows, names)
