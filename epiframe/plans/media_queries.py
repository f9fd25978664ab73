"""Queries of late materialization and decoding over shards that are written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blend, windows
from ..sources import adapters as A
from ..sources import files, media, members, shards
from ..steps import through
from . import pictures
from .registry import query


def shards_for(frames: DataFrame, most: int = 5000) -> int:
    """Shards of so many frames, about."""
    return 1 + frames.count() // most


def event_shards(spark: SparkSession, sf_dir: str) -> str:
    """Packed shards of events as frames, an episode to a user, whose last frame is marked: an image of varying size that
    holds the event's id."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    e = A.table(spark, sf_dir, "events")
    e = e.withColumn("last", last).repartition(shards_for(e), "user_id").sortWithinPartitions("user_id", "ts", "event_id")
    meta = F.to_json(F.struct(F.lit("events").alias("dataset_name"), F.col("user_id").alias("episode_index"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("high_quality"), "last"))
    image = F.encode(F.concat(F.col("event_id").cast("string"), F.repeat(F.lit("."), (F.col("event_id") % 997).cast("int"))), "UTF-8")
    rows = e.select(F.format_string("frame_%08d", "event_id").alias("key"), meta.alias("meta"), F.array(F.col("value").cast("float")).alias("lowdim"), image.alias("image"))
    path = files.shared_path(spark, "event-shards")
    shards.write_frames(rows, path, pack=True)
    return path


def event_windows(spark: SparkSession, path: str) -> DataFrame:
    """Each frame of high quality with the places of itself and of two frames before it, two apart."""
    frames = members.located_frames(spark, f"{path}/*.tar.zst", ["image.jpg"], ["shard", "pos", "key", "dataset_name", "episode_index", "high_quality", "members"])
    spec = Window.partitionBy("dataset_name", "episode_index").orderBy("shard", "pos")
    df = frames.select("shard", "pos", "high_quality", F.substring("key", 7, 8).cast("long").alias("event_id"), windows.history(members.locator(), spec, 3, 2).alias("image_refs"))
    return df.where("high_quality = 1")


IMAGE = {"image": ("image_refs", "image.jpg")}
#: Columns of frames that give nothing but their members' places.
PLACED = ["shard", "pos", "key", "members"]


@query
def late_media_windows(spark, sf_dir):
    """Images of windows that thinning leaves: read by range, in the windows' order."""
    kept = event_windows(spark, event_shards(spark, sf_dir)).where(blend.unit_hash("event_id", seed=4) < 0.3)
    out = members.with_media(kept, ["shard", "pos"], IMAGE)
    ids = F.transform("image", lambda x: F.regexp_replace(x.cast("string"), r"\.", ""))
    return out.select("event_id", F.array_join(ids, ",").alias("images"), F.aggregate("image", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)).alias("bytes"))


@query
def late_media_bytes(spark, sf_dir):
    """Bytes read for the windows that thinning leaves: each image that some window needs, once."""
    all_windows, path, parts = event_windows(spark, event_shards(spark, sf_dir)), files.shared_path(spark, "all-windows"), []
    all_windows.write.parquet(path)  # places alone, written once, as they are read three times
    all_windows = spark.read.schema(all_windows.schema).parquet(path)
    for keep in (1.0, 0.5, 0.1):
        kept = all_windows.where(blend.unit_hash("event_id", seed=4) < keep)
        places = members.media_places(kept, ["event_id"], IMAGE).select("shard", "key", "offset", "size").distinct()
        read = members.fetch(places).agg(F.count("*").alias("members"), F.sum(F.octet_length("data")).alias("bytes"))
        parts.append(read.select(F.lit(keep).alias("keep"), "members", "bytes"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def decoded_frames(spark, sf_dir):
    """Embeddings as pictures and depths in shards, read by range and decoded: size, sums of the three colours, metres."""
    e = A.vectors(spark, sf_dir).select(F.format_string("frame_%08d", "vec_id").alias("key"), F.to_json(F.struct("label")).alias("meta"), F.transform("v", lambda x: F.floor(F.abs(x) * 1000).cast("int")).alias("v"))
    path = files.shared_path(spark, "picture-shards")
    shards.write_frames(e, path, pictures.pictures)
    frames = members.located_frames(spark, f"{path}/*.tar", columns=PLACED).withColumn("image_refs", F.array(members.locator()))
    out = members.with_media(frames.select("shard", "pos", "key", "image_refs"), ["shard", "pos"], {"image": ("image_refs", "image.jpg"), "depth": ("image_refs", "depth.npy")})
    out = out.select("shard", "pos", "key", F.get("image", 0).alias("image"), F.get("depth", 0).alias("metres"))
    return through(media.decode_images(out, ["shard", "key"], "image"), media.depths_of(["shard", "key"], "metres"), pictures.sums)


@query
def qa_images_decoded(spark, sf_dir):
    """Conversations as question samples with one to twelve images, decoded in the order of their names."""
    turns = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.substring("text", 1, 40))).alias("first"))
    rows = turns.select(F.format_string("qa_%08d", "conv_id").alias("key"), F.to_json(F.struct("first")).alias("meta"), "conv_id")
    path = files.shared_path(spark, "qa-shards")
    shards.write_frames(rows, path, pictures.albums, pack=True)
    places = media.qa_images(members.located_frames(spark, f"{path}/*.tar.zst", columns=["shard", "key", "members"]))
    out = media.decode_images(members.dealt(places), ["shard", "key", "suffix"], made=[members.reading()])
    byte = lambda k: F.conv(F.hex(F.substring("pixels", k, 1)), 16, 10).cast("int")
    return out.select(F.substring("key", 4, 8).cast("long").alias("conv_id"), "n", "suffix", "height", "width", byte(1).alias("red"), byte(2).alias("green"), F.octet_length("pixels").alias("size"))
