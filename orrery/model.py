"""Frame tables in array form and long form.

Array form: traj_id, frame_idx, features ARRAY<DOUBLE>; per-frame work stays in one row
and needs no shuffle. Long form: traj_id, frame_idx, feature_idx, value; for work on
each feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESIDUE = "struct<aaa_code:string,a_code:string,index:int,seqid:int,consensus:string,full_name:string>"
SCHEMAS = {
    "trajectories": "traj_id int, name string, n_frames int, tags array<string>",
    "frames": "traj_id int, frame_idx int, time_ps float, xyz array<float>, box array<float>",
    "atoms": "traj_id int, atom_idx int, name string, element string, residue_index int",
    "residues": "traj_id int, index int, aaa_code string, a_code string, seqid int, consensus string, full_name string",
    "features": "traj_id int, frame_idx int, features array<float>",
    "feature_meta": f"feature_type string, traj_id int, feature_idx int, partners array<struct<residue:{RESIDUE},special_label:string,full_name:string>>",
    "frame_sel": "selector string, traj_id int, frame_idx int",
    "labels": "traj_id int, frame_idx int, label int",
    "importance": "analysis string, sub_comparison string, feature_idx int, score double",
}


def to_long(frames: DataFrame, features: str = "features") -> DataFrame:
    """Array form to long form, numbers as double, classes as they are; other columns stay."""
    rest = [c for c in frames.columns if c != features]
    long = frames.select(*rest, F.posexplode(features).alias("feature_idx", "value"))
    return long if isinstance(long.schema["value"].dataType, T.StringType) else long.withColumn("value", F.col("value").cast("double"))


def to_array(long: DataFrame, keys: tuple[str, ...] = ("traj_id", "frame_idx")) -> DataFrame:
    """Long form to array form, ordered by feature_idx."""
    pairs = F.array_sort(F.collect_list(F.struct("feature_idx", "value")))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("features"))


def trajectories_of(frames: DataFrame) -> DataFrame:
    return frames.groupBy("traj_id").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trajectories: one for each user, frames in time order, one scalar and one class."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value", "event_type")
    return events.select(F.col("user_id").alias("traj_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("value"), F.col("event_type").alias("class"))


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as one matrix: frames are vectors, ``label`` is a cluster label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.lit(0).alias("traj_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("features"), "label")
