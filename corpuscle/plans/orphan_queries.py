"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import orphans as ops
from corpuscle.sources.tables import table

TABLES = ("articles", "chunks", "claims", "evidence", "citations")
#: The batch queries take the tables in so many increments of about equal size.
INCREMENTS = 2


def _state(spark: SparkSession, root: str) -> ops.OrphanStore:
    tables = {}
    for name in TABLES:
        df = table(spark, root, name)
        fields = [r.field for r in ops.REFERENCES if r.table == name]
        ids = ["evidence_id" if name == "evidence" else "id"]
        tables[name] = df.select(*dict.fromkeys([*ids, *fields, "loaded_at", *(["deleted_at"] if "deleted_at" in df.columns else [])]))
    return ops.orphans(tables, tuple(ops.quantile_cuts(tables, INCREMENTS)))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return ops.report(_state(spark, root))


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    return ops.counts(_state(spark, root)).withColumn("n", F.col("n").cast("bigint"))


_KEY = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^urn:uuid:|^\{{|\}}$', '', 'g'), '')"


def _sql() -> str:
    parents = " union all ".join(f"select '{p}' pt, {_KEY.format('id')} k, loaded_at, deleted_at from {p}" for p in ("chunks", "articles", "claims"))
    refs = " union all ".join(f"select '{r.table}' table_name, '{r.field}' field_name, {r.record_id} record_id, '{r.parent}' pt, {_KEY.format(r.field)} k, loaded_at from {r.table}" for r in ops.REFERENCES)
    return f"""with p as (select pt, k, min(loaded_at) f, arg_max(deleted_at is not null, struct_pack(a := loaded_at, d := deleted_at is not null)) del from ({parents}) group by all),
      r as (select table_name, field_name, record_id, pt, k, min(loaded_at) f from ({refs}) where k is not null and record_id is not null group by all)
      select table_name, field_name, record_id, strftime(r.f, '%Y-%m') as period,
        case when p.k is null then 'missing' when del then 'deleted' when p.f > r.f then 'late' end as kind
      from r left join p on r.pt = p.pt and r.k = p.k
      where p.k is null or del or p.f > r.f"""


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
SQL = {
    "p4_found": _sql(),
    "p4_counts": f"select table_name, field_name, period, kind, count(*) as n from ({_sql()}) group by all",
}
