"""The object store: Parquet versions in, the latest state out; derived tables; file readers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as X
from lorespark.operators import objects, search
from lorespark.session import materialise, shared_path


class ObjectStore:
    """Appended versions and tombstones under one folder; a read takes the latest of each id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, batch: DataFrame) -> None:
        """Append versions; one with a later ``updated_at`` replaces the earlier ones."""
        batch.select("*", F.lit(False).alias("deleted")).write.mode("append").parquet(f"{self.path}/versions")

    def delete(self, ids: DataFrame, at: str) -> None:
        """Append tombstones for ``ids(id)``."""
        names = self._raw().schema
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in names if f.name not in ("id", "updated_at", "deleted")]
        ids.select("id", F.lit(at).cast("timestamp").alias("updated_at"), F.lit(True).alias("deleted"), *empty).write.mode("append").parquet(f"{self.path}/versions")

    def _raw(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions")

    def read(self) -> DataFrame:
        return objects.latest(self._raw(), "id", "updated_at", "deleted").where("not deleted").drop("deleted")

    def compact(self, path: str) -> ObjectStore:
        """Rewrite the latest state as a new store, sorted by id so that point lookups skip row groups."""
        new = ObjectStore(self.spark, path)
        new.put(self.read().repartitionByRange("id").sortWithinPartitions("id"))
        return new

    # -- derived tables -----------------------------------------------------------------------------------------------

    def fan_out(self, batch: DataFrame) -> None:
        """Append what follows from a batch of objects: postings, mentioned entities, relationships and vectors.

        Every row names its object's version, so rows of replaced or deleted versions drop out when they are read.
        """
        version = ["id", "updated_at"]
        fields = search.object_fields()
        rows = batch.select(*version, F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.concat(F.array(F.lit("")), X.tokens(c)).alias("t")) for name, c in fields.items()])).alias("f"))
        rows = rows.select(*version, "f.field", (F.size("f.t") - 1).alias("len"), F.explode("f.t").alias("term"))
        tables = {
            "postings": rows.groupBy("term", "field", *version).agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("len").alias("len")),
            "entities": batch.select(*version, "created_at", F.explode(F.array_distinct(F.concat(X.entities(F.col("content")), F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: F.octet_length(k) > 1)))).alias("entity")),
            "edges": batch.select(F.col("id").alias("src"), "updated_at", F.explode("relationships").alias("r")).select("src", "updated_at", F.col("r.target_id").alias("dst"), F.col("r.relation_type").alias("rel"), F.col("r.weight").cast("double").alias("weight")),
            "vectors": batch.select(*version, F.explode("embeddings").alias("model", "embedding")),
        }
        for name, df in tables.items():
            df.write.mode("append").parquet(f"{self.path}/{name}")

    def derived(self, name: str) -> DataFrame:
        """A derived table, rows of current versions only; as wide as the versions that were written."""
        table = self.spark.read.parquet(f"{self.path}/{name}")
        current = self.read().select(F.col("id").alias("_id"), F.col("updated_at").alias("_at"))
        key = "src" if name == "edges" else "id"
        return table.join(current, (table[key] == current["_id"]) & (table["updated_at"] == current["_at"]), "left_semi").drop("updated_at").distinct()

    def text_index(self) -> search.TextIndex:
        """The full-text index as it stands: terms are looked up in the stored postings, sizes come from their empty terms."""
        held = self.derived("postings")
        sizes = {r.field: r for r in held.where("term = ''").groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")).collect()}
        return search.TextIndex(held.where("term <> ''"), max((r.docs for r in sizes.values()), default=0), {f: float(r["mean"] or 0) for f, r in sizes.items()})

    def rebuild(self) -> dict[str, DataFrame]:
        """Derived tables, recomputed from the objects; what was stored is replaced, and ``derived`` reads the new ones."""
        now = materialise(self.read(), "objects")
        fresh = ObjectStore(self.spark, shared_path(self.spark, "rebuild"))
        fresh.fan_out(now)
        for name in DERIVED:
            self.spark.read.parquet(f"{fresh.path}/{name}").write.mode("overwrite").parquet(f"{self.path}/{name}")
        return {name: self.derived(name) for name in DERIVED}


DERIVED = ("postings", "entities", "edges", "vectors")


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """One object per JSON file: content, keywords, metadata."""
    return spark.read.schema("content string, keywords array<string>, metadata map<string,string>").json(path, multiLine=True)


def read_text_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")


MAGIC = b"KVDB"


def write_vector_file(path: str, vectors: np.ndarray, queries: np.ndarray, truth: np.ndarray) -> None:
    """A benchmark set: magic, n, dim, q, k, then float32 vectors and queries and uint32 neighbours, little-endian."""
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<4I", len(vectors), vectors.shape[1], len(queries), truth.shape[1]))
        f.write(vectors.astype("<f4").tobytes() + queries.astype("<f4").tobytes() + truth.astype("<u4").tobytes())


def read_vector_files(spark: SparkSession, path: str) -> DataFrame:
    """``part (vector, query), row, embedding, neighbours`` of benchmark sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                if data[:4] != MAGIC:
                    raise ValueError("not a vector file")
                n, dim, q, k = struct.unpack_from("<4I", data, 4)
                x = np.frombuffer(data, "<f4", (n + q) * dim, 20).reshape(-1, dim)
                truth = np.frombuffer(data, "<u4", q * k, 20 + 4 * (n + q) * dim).reshape(q, k)
                for a in range(0, n + q, 4096):
                    rows = range(a, min(a + 4096, n + q))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["vector" if r < n else "query" for r in rows]), pa.array([r if r < n else r - n for r in rows], pa.int64()), pa.array([x[r].tolist() for r in rows], pa.list_(pa.float32())), pa.array([None if r < n else truth[r - n].tolist() for r in rows], pa.list_(pa.int64()))],
                        ["part", "row", "embedding", "neighbours"],
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "part string, row long, embedding array<float>, neighbours array<long>")
