"""The object table: building, reading, updating and filtering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.scores import clamp_importance
from lorespark.session import spread

SCHEMA = (
    "id string, content string, metadata map<string,string>, keywords array<string>, "
    "relationships array<struct<relation_type:string,target_id:string,weight:float>>, embeddings map<string,array<float>>, "
    "version_history array<struct<content_hash:string,timestamp:timestamp,description:string>>, importance double, created_at timestamp, updated_at timestamp"
)
EPOCH = "2024-01-01 00:00:00"


def fixture_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels as objects: importance by quality, one hour between creation times."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    created = (F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("created_at")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        F.col("text").alias("content"),
        "lang",
        "source",
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.1).otherwise(0.5).alias("importance"),
        created,
    )


def latest(versions: DataFrame, key: str = "id", order: str = "updated_at", *ties: str) -> DataFrame:
    """The last version of each key: an upsert is an append."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *[F.desc(t) for t in ties])
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def get(objects: DataFrame, id_: str) -> DataFrame:
    return objects.where(F.col("id") == id_)


def delete(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects without those named in ``ids``."""
    return objects.join(ids.select("id"), "id", "left_anti")


def storage_filter(objects: DataFrame, id_: str | None = None, keyword: str | None = None, min_importance: float | None = None, created_after: str | None = None, created_before: str | None = None, metadata: Mapping[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """All given conditions together; the limit takes the smallest ids."""
    conditions: list[Column] = []
    if id_ is not None:
        conditions.append(F.col("id") == id_)
    if keyword is not None:
        conditions.append(F.exists("keywords", lambda k: F.contains(k, F.lit(keyword))))
    if min_importance is not None:
        conditions.append(F.col("importance") >= min_importance)
    if created_after is not None:
        conditions.append(F.col("created_at") >= F.lit(created_after).cast("timestamp"))
    if created_before is not None:
        conditions.append(F.col("created_at") <= F.lit(created_before).cast("timestamp"))
    for k, v in (metadata or {}).items():
        conditions.append(F.col("metadata")[k] == v)
    for c in conditions:
        objects = objects.where(c)
    return objects if limit is None else objects.orderBy("id").limit(limit)


def page(objects: DataFrame, offset: int, limit: int, order: str = "id") -> DataFrame:
    return objects.orderBy(order).offset(offset).limit(limit)


def version_entry(content: Column, at: Column, description: Column) -> Column:
    return F.struct(F.sha2(content, 256).alias("content_hash"), at.alias("timestamp"), description.alias("description"))


def update(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(id, content, metadata, keywords, importance, description, updated_at)``; null leaves a field.

    Metadata keys overwrite, keywords are replaced if any are given, importance is held within 0 and 1, a version is
    appended, and embeddings go where the content changed. Objects without a change stay as they are.
    """
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in ("content", "metadata", "keywords", "importance", "description", "updated_at")])
    j = objects.join(c, "id", "left")
    changed = F.col("_updated_at").isNotNull()
    content = F.coalesce("_content", "content")
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(F.col("_metadata"), k), F.lit(False)))
    new = {
        "content": content,
        "metadata": F.when(F.col("_metadata").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, "_metadata")),
        "keywords": F.when(F.size("_keywords") > 0, F.col("_keywords")).otherwise(F.col("keywords")),
        "importance": F.when(F.col("_importance").isNull(), F.col("importance")).otherwise(clamp_importance(F.col("_importance"))),
        "version_history": F.when(changed, F.concat(F.coalesce("version_history", F.array().cast("array<struct<content_hash:string,timestamp:timestamp,description:string>>")), F.array(version_entry(content, F.col("_updated_at"), F.col("_description"))))).otherwise(F.col("version_history")),
        "embeddings": F.when(F.col("_content").isNotNull() & ~F.col("_content").eqNullSafe(F.col("content")), F.lit(None)).otherwise(F.col("embeddings")),
        "updated_at": F.coalesce("_updated_at", "updated_at"),
    }
    return j.select(*[new[x].alias(x) if x in new else F.col(x) for x in objects.columns])


def with_metadata(objects: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """All pairs must hold; none wanted leaves everything."""
    for k, v in wanted.items():
        objects = objects.where(F.col("metadata")[k] == v)
    return objects


def intersect_ids(sets: Sequence[DataFrame]) -> DataFrame:
    """Ids in every set; one empty set empties the result."""
    out = sets[0].select("id").distinct()
    for s in sets[1:]:
        out = out.join(s.select("id"), "id", "left_semi")
    return out


def load_results(ranked: DataFrame, objects: DataFrame) -> DataFrame:
    """Contents of ranked ids; a missing object shows as ``<Object id>``."""
    found = ranked.join(objects.select("id", "content"), "id", "left")
    return found.withColumn("content", F.coalesce("content", F.concat(F.lit("<Object "), "id", F.lit(">"))))
