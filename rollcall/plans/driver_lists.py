"""The list roles built from the order tables: nations are regions, parts are entities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.keys import ENTITY, REGION
from rollcall.operators.scenario import standard_rules
from rollcall.sources.lists import load

# Declared so that building a query reads no file.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

PLANT = "PROMO"
ROLLUP = {"BIG": ["LARGE", "MEDIUM"]}
ROLLED_TYPES = ["BIG", "ECONOMY", "PROMO", "SMALL", "STANDARD"]


@dataclass(frozen=True)
class Lists:
    """Lazy list views over one directory of tables."""

    spark: SparkSession
    directory: str

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.directory, name, SCHEMAS.get(name))

    @cached_property
    def regions(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias(REGION), "n_name")

    @cached_property
    def attrs(self) -> DataFrame:
        """One row per entity."""
        return self.table("part").select(
            F.col("p_partkey").alias(ENTITY), "p_type", "p_brand", "p_name"
        )

    @cached_property
    def types(self) -> DataFrame:
        return self.attrs.select(ENTITY, "p_type")

    @cached_property
    def range_(self) -> DataFrame:
        lines = self.table("lineitem").where("l_discount <= 0.01").select("l_suppkey", "l_partkey")
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        return (
            lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("s_nationkey").alias(REGION), F.col("l_partkey").alias(ENTITY))
            .distinct()
        )

    def _ordered(self, lines: DataFrame, priorities: list[str]) -> DataFrame:
        """Lines with the nation of the customer who ordered them."""
        orders = (
            self.table("orders")
            .where(F.col("o_orderpriority").isin(priorities))
            .select("o_orderkey", "o_custkey")
        )
        customers = self.table("customer").select("c_custkey", F.col("c_nationkey").alias(REGION))
        placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", REGION
        )
        return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed(
            "l_partkey", ENTITY
        )

    @cached_property
    def local(self) -> DataFrame:
        lines = (
            self.table("lineitem")
            .where("l_returnflag <> 'N' and l_quantity >= 20")
            .select("l_orderkey", "l_partkey", "l_returnflag")
        )
        return (
            self._ordered(lines, ["1-URGENT"])
            .groupBy(REGION, ENTITY)
            .agg(F.min("l_returnflag").alias("ranking"))
        )

    @cached_property
    def national(self) -> DataFrame:
        lines = (
            self.table("lineitem")
            .where("l_quantity >= 40 and l_linestatus = 'O'")
            .select("l_orderkey", "l_partkey", "l_tax")
        )
        return (
            self._ordered(lines, ["1-URGENT", "2-HIGH"])
            .groupBy(REGION, ENTITY)
            .agg(F.max("l_tax").alias("_tax"))
            .select(
                REGION, ENTITY, F.when(F.col("_tax") >= 0.06, "E").otherwise("T").alias("status")
            )
        )

    @cached_property
    def national_typed(self) -> DataFrame:
        """The national list with the entity's type, which two of the policy rules look at."""
        types = self.types.withColumnRenamed(ENTITY, "_entity")
        return self.national.join(types, F.col(ENTITY) == F.col("_entity"), "left").drop("_entity")

    @property
    def rules(self) -> dict[str, Column]:
        return standard_rules("status", "p_type", plant=PLANT)

    @cached_property
    def policy(self) -> DataFrame:
        names = ["ALL", "E_ONLY", "NON_PLANT", "E_NON_PLANT", "NONE"]
        turn = self.table("nation").select(
            F.col("n_nationkey").alias(REGION), F.pmod("n_nationkey", F.lit(5)).alias("_turn")
        )
        rule = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("_turn") + 1)
        return turn.select(REGION, rule.alias("rule"))


# The same lists as SQL, put in front of every oracle that needs them.
LISTS_SQL = """with range_list as (
  select distinct s_nationkey as region_key, l_partkey as entity_key
  from lineitem join supplier on l_suppkey = s_suppkey
  where l_discount <= 0.01
), local_list as (
  select c_nationkey as region_key, l_partkey as entity_key, min(l_returnflag) as ranking
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  where l_returnflag <> 'N' and o_orderpriority = '1-URGENT' and l_quantity >= 20
  group by c_nationkey, l_partkey
), national_list as (
  select c_nationkey as region_key, l_partkey as entity_key,
         case when max(l_tax) >= 0.06 then 'E' else 'T' end as status
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  where l_quantity >= 40 and l_linestatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')
  group by c_nationkey, l_partkey
), policy as (
  select n_nationkey as region_key,
         case n_nationkey % 5 when 0 then 'ALL' when 1 then 'E_ONLY' when 2 then 'NON_PLANT'
              when 3 then 'E_NON_PLANT' else 'NONE' end as rule
  from nation
), imported as (
  select distinct f.region_key, f.entity_key
  from national_list f join policy p on f.region_key = p.region_key
  left join part on p_partkey = f.entity_key
  where p.rule = 'ALL'
     or (p.rule = 'E_ONLY' and f.status = 'E')
     or (p.rule = 'NON_PLANT' and p_type <> 'PROMO')
     or (p.rule = 'E_NON_PLANT' and p_type <> 'PROMO' and f.status = 'E')
), local_left as (
  select l.* from local_list l
  where not exists (select 1 from imported i
                    where i.region_key = l.region_key
                      and i.entity_key is not distinct from l.entity_key)
)"""
