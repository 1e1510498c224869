"""References to records that do not exist, kept up incrementally.

The state has two keyed tables:

* the parent index, one row per (parent_table, key): first and latest delivery
  and whether the latest delivery carries a deletion mark;
* the references, one row per (table_name, field_name, record_id) with the key
  they wait for, their first delivery and their present kind: ``missing``,
  ``deleted``, ``late`` or null (resolved).

``OrphanStore.advance`` takes one increment: new references probe the parent index,
arriving parents resolve the references that wait for them, deletions reopen resolved
ones. All parts merge with associative aggregates, so one increment or many, in any
order of delivery, and one delivered twice, give the same state.

The state lies in files by bucket, a hash of the key: an increment reads and rewrites
only the buckets it touches, in a new version; a manifest names the version of every
bucket, so a restarted job goes on where the last one committed. Each version keeps the
counts of its buckets: the snapshot of counts after every increment is a sum over these
small tables. Versions that the last two manifests don't name are deleted.

Defined cases: a reference that is null or blank is no reference; a record with a
null id has none; UUIDs are compared in canonical spelling; of two latest
deliveries at the same time, one with a deletion mark wins; records delivered
again count once, by their first ``loaded_at``; a null ``loaded_at`` of all
deliveries of a record gives a null period and is never late.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.columns import canonical_id
from corpuscle.session import discard, shared_dir, store


@dataclass(frozen=True)
class Reference:
    """``table.field`` of the records named by ``record_id`` points to the ids of ``parent``."""

    table: str
    field: str
    record_id: str
    parent: str


REFERENCES = (
    Reference("claims", "chunk_id", "id", "chunks"),
    Reference("claims", "article_id", "id", "articles"),
    Reference("evidence", "claim_id", "evidence_id", "claims"),
    Reference("citations", "target_article_id", "id", "articles"),
)


@dataclass(frozen=True)
class OrphanState:
    """The parent index and the references with their kinds."""

    parents: DataFrame
    references: DataFrame


def parent_events(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """Deliveries of the referred records, merged per key."""
    parts = []
    for name in dict.fromkeys(r.parent for r in references):
        df = tables[name]
        parts.append(df.select(F.lit(name).alias("parent_table"), canonical_id(df["id"]).alias("key"), df["loaded_at"].alias("first_at"), F.struct(df["loaded_at"].alias("at"), df["deleted_at"].isNotNull().alias("deleted")).alias("last")))
    return _merge_parents(reduce(DataFrame.unionByName, parts).filter(F.col("key").isNotNull()))


def _merge_parents(df: DataFrame) -> DataFrame:
    return df.groupBy("parent_table", "key").agg(F.min("first_at").alias("first_at"), F.max("last").alias("last"))


def reference_events(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """New references, merged per record: one pass over each referring table."""
    parts = []
    for name in dict.fromkeys(r.table for r in references):
        df, own = tables[name], [r for r in references if r.table == name]
        entries = F.array(*(F.struct(F.lit(r.field).alias("field_name"), F.lit(r.parent).alias("parent_table"), canonical_id(df[r.field]).alias("key")) for r in own))
        parts.append(
            df.select(df[own[0].record_id].alias("record_id"), df["loaded_at"].alias("first_at"), F.explode(entries).alias("e"))
            .select(F.lit(name).alias("table_name"), "e.field_name", "record_id", "e.parent_table", "e.key", "first_at")
            .filter(F.col("record_id").isNotNull() & F.col("key").isNotNull())
        )
    return _merge_references(reduce(DataFrame.unionByName, parts))


def _merge_references(df: DataFrame) -> DataFrame:
    return df.groupBy("table_name", "field_name", "record_id", "parent_table", "key").agg(F.min("first_at").alias("first_at"))


def _evaluate(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds ``kind``. A hot key lies on the left side, where AQE may split it."""
    p = parents.select("parent_table", "key", F.col("first_at").alias("parent_first"), F.col("last.deleted").alias("parent_deleted"))
    kind = F.when(F.col("parent_deleted").isNull(), "missing").when(F.col("parent_deleted"), "deleted").when(F.col("parent_first") > F.col("first_at"), "late")
    return references.join(p, ["parent_table", "key"], "left").select("table_name", "field_name", "record_id", "parent_table", "key", "first_at", kind.alias("kind"))


def evaluated(new_parents: DataFrame, new_references: DataFrame) -> OrphanState:
    """The state after one increment alone, without files."""
    return OrphanState(new_parents, _evaluate(new_references, new_parents))


#: Parts of the state; one should hold some gigabytes at most.
BUCKETS = 16
PARENTS = "parent_table string, key string, first_at {0}, last struct<at:{0},deleted:boolean>"
REFERENCES_SCHEMA = "table_name string, field_name string, record_id string, parent_table string, key string, first_at {0}, kind string"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("parent_table", "key"), F.lit(buckets))


def _count(references: DataFrame, *more: str) -> DataFrame:
    orphans = references.filter(F.col("kind").isNotNull())
    return orphans.groupBy(*more, "table_name", "field_name", F.date_format("first_at", "yyyy-MM").alias("period"), "kind").agg(F.count("*").alias("n"))


class OrphanStore:
    """The keyed state below ``path``, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
        known = self._manifests()
        #: version: the last one; places: per bucket the version it lies in; kind: the type of times.
        self.manifest = self._read(known[-1]) if known else {"version": 0, "buckets": buckets, "places": {}, "time": None}

    def _manifests(self) -> list[int]:
        if not self._files.exists(self._paths(self.path)):
            return []
        names = (str(f.getPath().getName()) for f in self._files.listStatus(self._paths(self.path)))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, version: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest-{version:08}.json").collect()))

    def _commit(self, manifest: dict) -> None:
        """A manifest is there whole or not at all."""
        target = self._paths(f"{self.path}/manifest-{manifest['version']:08}.json")
        waiting = self._paths(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = self._files.create(waiting, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        self._files.rename(waiting, target)
        self.manifest = manifest
        kept = self._manifests()[-2:]
        used = {v for k in kept for v in (*self._read(k)["places"].values(), k)}
        for status in self._files.listStatus(self._paths(self.path)):
            name = str(status.getPath().getName())
            number = name[9:-5] if name.startswith("manifest-") else name[1:] if name.startswith("v") else ""
            if number.isdigit() and int(number) not in used:
                self._files.delete(status.getPath(), True)

    def _part(self, name: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        places = [(v, b) for b, v in self.manifest["places"].items() if buckets is None or int(b) in buckets]
        found = [p for v, b in places if self._files.exists(self._paths(p := f"{self.path}/v{v}/{name}/bucket={b}"))]
        shape = schema.format(self.manifest["time"] or "timestamp")
        return self.spark.read.schema(shape).parquet(*found) if found else self.spark.createDataFrame([], shape)

    @property
    def parents(self) -> DataFrame:
        return self._part("parents", PARENTS)

    @property
    def references(self) -> DataFrame:
        return self._part("references", REFERENCES_SCHEMA)

    def advance(self, new_parents: DataFrame, new_references: DataFrame) -> None:
        """Takes one increment (outputs of ``parent_events`` and ``reference_events``) into the state."""
        buckets, number = self.manifest["buckets"], self.manifest["version"] + 1
        time = self.manifest["time"] or new_references.schema["first_at"].dataType.simpleString()
        self.manifest["time"] = time
        parents, references, waiting = new_parents, new_references, []
        touched = set(range(buckets))
        if self.manifest["places"]:
            # The events are read several times; at most ``buckets`` numbers come back.
            waiting = [store(new_parents, "orphan-events"), store(new_references, "orphan-events")]
            touched = {r[0] for r in waiting[0].select(_bucket(buckets)).unionByName(waiting[1].select(_bucket(buckets))).distinct().collect()}
            parents = _merge_parents(self._part("parents", PARENTS, touched).unionByName(waiting[0]))
            references = _merge_references(self._part("references", REFERENCES_SCHEMA, touched).drop("kind").unionByName(waiting[1]))
        place = f"{self.path}/v{number}"
        write = lambda df, name: df.withColumn("bucket", _bucket(buckets)).write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(f"{place}/{name}")
        write(parents, "parents")
        merged = self.spark.read.schema(PARENTS.format(time)).parquet(f"{place}/parents")
        write(_evaluate(references, merged), "references")
        written = self.spark.read.schema(REFERENCES_SCHEMA.format(time) + ", bucket int").parquet(f"{place}/references")
        _count(written, "bucket").coalesce(1).write.mode("overwrite").parquet(f"{place}/counts")
        places = self.manifest["places"] | {str(b): number for b in touched}
        self._commit({"version": number, "buckets": buckets, "places": places, "time": time})
        discard(*waiting)

    def counts(self) -> DataFrame:
        """The counts per table, field, month and kind after the last increment, from the counts of the buckets."""
        return self._counts(self.manifest)

    def history(self) -> dict[int, DataFrame]:
        """The counts after each of the increments that are kept."""
        return {v: self._counts(self._read(v)) for v in self._manifests()[-2:]}

    def _counts(self, manifest: dict) -> DataFrame:
        schema = "bucket int, table_name string, field_name string, period string, kind string, n bigint"
        parts = []
        for version in sorted(set(manifest["places"].values())):
            own = [int(b) for b, v in manifest["places"].items() if v == version]
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/v{version}/counts").filter(F.col("bucket").isin(own)))
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        return found.groupBy("table_name", "field_name", "period", "kind").agg(F.sum("n").alias("n"))


def report(state: OrphanState | OrphanStore) -> DataFrame:
    """The orphans: one row per orphan reference."""
    return state.references.filter(F.col("kind").isNotNull()).select("table_name", "field_name", "record_id", F.date_format("first_at", "yyyy-MM").alias("period"), "kind")


def counts(state) -> DataFrame:
    """The snapshot of counts per table, field, month and kind."""
    return state.counts() if isinstance(state, OrphanStore) else _count(state.references)


def quantile_cuts(tables: dict[str, DataFrame], increments: int) -> list:
    """Times that part the deliveries of all tables into increments of about equal size."""
    times = reduce(DataFrame.unionByName, [df.select("loaded_at") for df in tables.values()])
    shares = [i / increments for i in range(1, increments)]
    found = times.agg(F.percentile_approx("loaded_at", shares, 1000).alias("q")).collect()[0]["q"] if shares else None
    return sorted(set(found or []))


def orphans(tables: dict[str, DataFrame], cuts: tuple = (), references=REFERENCES, path: str | None = None) -> OrphanState | OrphanStore:
    """All tables, taken in increments of ``loaded_at`` that part at ``cuts`` (sorted), the state being kept below ``path`` (by default a new folder).

    Rows without a ``loaded_at`` come with the first increment. Without cuts there is one increment and nothing is kept.
    """
    if not cuts:
        return evaluated(parent_events(tables, references), reference_events(tables, references))
    spark = next(iter(tables.values())).sparkSession
    state = OrphanStore(spark, path or f"{shared_dir(spark).rstrip('/')}/orphans-{uuid.uuid4().hex}")
    at, bounds = F.col("loaded_at"), [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        inside = at.isNull() if low is None else F.lit(False)
        between = [at >= F.lit(low)] if low is not None else []
        between += [at < F.lit(high)] if high is not None else []
        part = {name: df.filter(inside | reduce(lambda x, y: x & y, between)) for name, df in tables.items()}
        state.advance(parent_events(part, references), reference_events(part, references))
    return state
