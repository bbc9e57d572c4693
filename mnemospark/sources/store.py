"""The memory store: append-only logs in Parquet, state as a view of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.session import delete_path, move_path, path_exists

_S, _D, _L, _TS, _A = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType(), T.ArrayType(T.StringType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


@dataclass(frozen=True)
class Log:
    """A log: its columns, the key of a row within a user, and the columns that order its versions."""

    schema: T.StructType
    key: tuple[str, ...]
    order: tuple[str, ...]


_COMMON = (("user_id", _S), ("written_at", _TS), ("seq", _L))
LOGS: dict[str, Log] = {
    "chunk": Log(_schema(("chunk_id", _S), ("text", _S), ("vector", T.ArrayType(T.FloatType())), ("timestamp", _TS), ("conversation_id", _S), ("speaker", _S), ("entity_mentions", _A), ("topic_tags", _A), ("confidence", _D), ("importance", _D), ("extra", _S), *_COMMON), ("chunk_id",), ("written_at", "seq")),
    "entity": Log(_schema(("entity_key", _S), ("name", _S), ("entity_type", _S), ("first_seen", _TS), ("last_seen", _TS), ("mention_count", _L), ("attributes", _S), ("aliases", _A), *_COMMON), ("entity_key",), ("written_at", "seq")),
    "relation": Log(_schema(("subject_key", _S), ("predicate", _S), ("object_key", _S), ("confidence", _D), ("first_seen", _TS), ("last_seen", _TS), ("source_chunks", _A), ("mention_count", _L), ("status", _S), *_COMMON), ("subject_key", "predicate", "object_key"), ("written_at", "seq")),
    "contradiction": Log(_schema(("fact_a", _S), ("fact_b", _S), ("kind", _S), ("resolution", _S), ("winner", _S), ("resolved_at", _TS), *_COMMON), ("fact_a", "fact_b"), ("written_at", "seq")),
    "fact_status": Log(_schema(("fact_key", _S), ("status", _S), *_COMMON), ("fact_key",), ("written_at", "seq")),
    "explicit": Log(_schema(("key", _S), ("value", _S), ("entry_type", _S), ("priority", _L), *_COMMON), ("key",), ("written_at", "seq")),
    "profile": Log(_schema(("dimension", _S), ("value", _D), ("confidence", _D), ("signals", T.ArrayType(_D)), *_COMMON), ("dimension",), ("written_at", "seq")),
    "access": Log(_schema(("chunk_id", _S), ("query_id", _S), *_COMMON), ("chunk_id", "query_id"), ("written_at", "seq")),
    "config": Log(_schema(("key", _S), ("value", _S), *_COMMON), ("key",), ("written_at", "seq")),
    "working": Log(_schema(("session_id", _S), ("entry_id", _S), ("entry_type", _S), ("content", _S), *_COMMON), ("session_id", "entry_id"), ("written_at", "seq")),
}
PARTS = 64  # folders of a log; a user lies in one of them


def _part(user):
    return F.pmod(F.xxhash64(user), F.lit(PARTS)).cast("int")


class MemoryStore:
    """Tables under one path, in parts by a hash of the user. Writes append; the last version of a key stands unless it is a tombstone.

    Each append is one job commit, so readers see it whole or not at all; there is no
    transaction over several tables. A user is erased by writing the part of that user
    anew without them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def append(self, name: str, rows: DataFrame, deleted: bool = False) -> None:
        """Append rows; columns of the log that rows lack are null, others are dropped."""
        log = LOGS[name]
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema]
        out = rows.select(*cols).withColumn("written_at", F.coalesce("written_at", F.current_timestamp())).withColumn("deleted", F.lit(deleted))
        out.withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id())).withColumn("part", _part(F.col("user_id"))).write.partitionBy("part").mode("append").parquet(self._at(name))

    def delete(self, name: str, keys: DataFrame) -> None:
        """Append tombstones for keys (user_id and the log's key columns)."""
        self.append(name, keys, deleted=True)

    def _exists(self, name: str) -> bool:
        return path_exists(self.spark, self._at(name))

    def log(self, name: str, user_id: str | None = None) -> DataFrame:
        """All versions; a user's log reads one part only."""
        schema = T.StructType([*LOGS[name].schema.fields, T.StructField("deleted", T.BooleanType())])
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(self._at(name))
        if user_id is not None:
            df = df.filter((F.col("part") == _part(F.lit(user_id))) & (F.col("user_id") == user_id))
        return df.select(*schema.names)

    def state(self, name: str, user_id: str | None = None) -> DataFrame:
        """The last version of every key, without deleted ones: one aggregation with partial combining."""
        log = LOGS[name]
        keys = ["user_id", *log.key]
        rest = [f.name for f in log.schema if f.name not in keys]
        last = F.max_by(F.struct(*rest, "deleted"), F.struct(*log.order))
        df = self.log(name, user_id).groupBy(*keys).agg(last.alias("r"))
        return df.filter(~F.col("r.deleted")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])

    def explicit(self, user_id: str | None = None) -> DataFrame:
        """Settings with the time of their first write, by priority and key."""
        made = self.log("explicit", user_id).groupBy("user_id", "key").agg(F.min("written_at").alias("created"))
        return self.state("explicit", user_id).join(made, ["user_id", "key"]).orderBy(F.desc("priority"), "key")

    def chunks(self, user_id: str | None = None, dims: int | None = None) -> DataFrame:
        """Chunks in time order with their access counts from the log; with `dims`, those with such a vector."""
        c = self.state("chunk", user_id)
        if dims is not None:
            c = c.filter(F.size("vector") == dims)
        a = self.log("access", user_id).groupBy("user_id", "chunk_id").agg(F.count(F.lit(1)).alias("access_count"))
        return c.join(a, ["user_id", "chunk_id"], "left").withColumn("access_count", F.coalesce("access_count", F.lit(0))).orderBy("timestamp")

    def nodes(self, user_id: str | None = None) -> DataFrame:
        """Entities, and ends of relations that no entity row names, as concepts."""
        e = self.state("entity", user_id).select("user_id", "entity_key", "entity_type")
        r = self.state("relation", user_id)
        ends = r.select("user_id", F.col("subject_key").alias("entity_key")).union(r.select("user_id", "object_key")).distinct()
        return e.unionByName(ends.join(e, ["user_id", "entity_key"], "left_anti").withColumn("entity_type", F.lit("concept")))

    def counts(self) -> DataFrame:
        out = None
        for name in LOGS:
            g = self.state(name).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(name))
            out = g if out is None else out.unionByName(g)
        return out

    def erase(self, user_id: str) -> None:
        """Remove everything of one user from every log. The part is written anew beside the log and moved into its place."""
        part = self.spark.range(1).select(_part(F.lit(user_id))).first()[0]
        for name in LOGS:
            old = f"{self._at(name)}/part={part}"
            if not path_exists(self.spark, old):
                continue
            new = f"{self.path}/_erasing-{name}-{uuid.uuid4().hex}"
            keep = self.spark.read.schema(T.StructType([*LOGS[name].schema.fields, T.StructField("deleted", T.BooleanType())])).parquet(old)
            keep.filter(~F.col("user_id").eqNullSafe(user_id)).write.parquet(new)
            delete_path(self.spark, old)
            move_path(self.spark, new, old)

    def version(self) -> int:
        """The version of the layout: the last migration that was noted, 1 for stores older than the notes."""
        at = f"{self.path}/_versions"
        if not path_exists(self.spark, at):
            return 1 if any(self._exists(n) for n in LOGS) else MIGRATIONS[-1][0]
        return self.spark.read.parquet(at).agg(F.max("version")).first()[0]

    def migrate(self) -> list[int]:
        """Run what is pending, in order; each version is noted once its step is done, so a failed run goes on from there."""
        done = []
        for version, what, step in MIGRATIONS:
            if version > self.version():
                step(self)
                self.spark.createDataFrame([(version, what)], "version int, what string").write.mode("append").parquet(f"{self.path}/_versions")
                done.append(version)
        return done

    def snapshot(self, path: str) -> None:
        """The present state of every log as tables under another path."""
        for name in LOGS:
            if self._exists(name):
                self.state(name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    def get_config(self, key: str, default: str | None = None, user_id: str = "") -> str | None:
        row = self.state("config", user_id).filter(F.col("key") == key).select("value").head()
        return row["value"] if row else default


def _folders_to_parts(store: MemoryStore) -> None:
    """Version 2: logs with a folder per user get parts by a hash of the user."""
    for name in LOGS:
        if store._exists(name):
            old, new = store._at(name), f"{store.path}/_moving-{name}-{uuid.uuid4().hex}"
            rows = store.spark.read.parquet(old)
            rows.drop("part").withColumn("user_id", F.col("user_id").cast("string")).withColumn("part", _part(F.col("user_id"))).write.partitionBy("part").parquet(new)
            delete_path(store.spark, old)
            move_path(store.spark, new, old)


MIGRATIONS = [(2, "parts by a hash of the user in the place of a folder per user", _folders_to_parts)]


def prometheus(counts: DataFrame) -> DataFrame:
    """One line of text per count, in the exposition format."""
    label = F.concat(F.lit('{user="'), F.coalesce("user_id", F.lit("")), F.lit('",layer="'), F.col("layer"), F.lit('"} '))
    return counts.select(F.concat(F.lit("memory_rows"), label, F.col("n").cast("string")).alias("line"))
