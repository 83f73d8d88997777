"""Faces: groups, instances, clusters and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.schemas import library_keys


def face_group_counts(instances: DataFrame, order_by: str = "seen_at") -> DataFrame:
    """Photos per face and where it was first seen, most photographed first."""
    first = F.min(F.struct(F.col(order_by).alias("at"), F.col("asset_id"))).alias("_first")
    return (
        instances.groupBy(*library_keys(instances), "face_id")
        .agg(F.count(F.lit(1)).alias("photo_count"), first)
        .select(
            *library_keys(instances),
            "face_id",
            F.col("_first.asset_id").alias("first_seen_asset_id"),
            "photo_count",
            F.col("_first.at").alias("created_at"),
        )
        .orderBy(F.desc("photo_count"), F.desc("created_at"), "face_id")
    )


def list_face_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("photo_count"), F.desc("created_at"), "face_id")


def face_cluster_assign(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Set the cluster of the faces in ``clusters`` (face_id, cluster_id, and library_id where there is one)."""
    keys = [*library_keys(groups), "face_id"]
    new = clusters.select(*keys, F.col("cluster_id").alias("_cluster"), F.lit(True).alias("_set"))
    return (
        groups.join(new, keys, "left")
        .withColumn("cluster_id", F.when(F.col("_set"), F.col("_cluster")).otherwise(F.col("cluster_id")))
        .drop("_cluster", "_set")
        .select(*groups.columns)
    )


def face_statistics(groups: DataFrame) -> DataFrame:
    """Distinct faces and clusters among clustered faces, of each library."""
    clustered = groups.filter(F.col("cluster_id").isNotNull())
    return clustered.groupBy(*library_keys(groups)).agg(
        F.countDistinct("face_id").alias("total_faces"),
        F.countDistinct("cluster_id").alias("total_clusters"),
    )


#: Registers of a sketch, as a power of two: estimates are off by some 0.8 %.
SKETCH_BITS = 14


def face_sketches(groups: DataFrame) -> DataFrame:
    """HyperLogLog sketches of the clustered faces and of their clusters, for each library and day on which a face was first seen.

    Sketches are kept; those of any days are merged on read, so that a new day costs its own rows only.
    """
    clustered = groups.filter(F.col("cluster_id").isNotNull())
    day = F.to_date(F.timestamp_millis("created_at")).alias("day")
    return clustered.groupBy(*library_keys(groups), day).agg(
        F.hll_sketch_agg("face_id", SKETCH_BITS).alias("faces"), F.hll_sketch_agg("cluster_id", SKETCH_BITS).alias("clusters")
    )


def estimated_statistics(sketches: DataFrame) -> DataFrame:
    """``face_statistics`` from sketches, approximately."""
    merged = sketches.groupBy(*library_keys(sketches)).agg(F.hll_union_agg("faces").alias("faces"), F.hll_union_agg("clusters").alias("clusters"))
    return merged.select(
        *library_keys(sketches), F.hll_sketch_estimate("faces").alias("total_faces"), F.hll_sketch_estimate("clusters").alias("total_clusters")
    )
