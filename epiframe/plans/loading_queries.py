"""Queries of loading: resampled and blended streams, shuffles, guarded functions, batches, processed frames, slots."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sampling as S
from ..functions import text as X
from ..operators import attention, blend, collate, guarded, images, metrics, profile, quality_gate, samples, serving, shuffle, vla, windows
from ..sources import adapters as A
from ..sources import files, media, members, shards, store
from ..steps import through
from ..streaming import online, resampled
from ..streaming.blend import blend_streams
from . import pictures
from .media_queries import PLACED, event_shards
from .registry import query, r6

#: Streams side by side that draw shards of an epoch.
LANES = 4


@query
def resampled_epochs(spark, sf_dir):
    """Two epochs of frames of shards in random order, in batches of at most 20,000: each frame twice."""
    streams = resampled.resampled_lanes(spark, f"{event_shards(spark, sf_dir)}/*.tar.zst", LANES, seed=2, epochs=2, rows=20_000, columns=["key", "episode_index", "image", "epoch"])
    out = online.run_to_end(*(s.select("key", "epoch", "episode_index", F.octet_length("image").alias("size")) for s in streams))
    return out.groupBy(F.substring("key", 7, 8).cast("long").alias("event_id"), "episode_index").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("epoch")), ",").alias("epochs"), F.max("size").alias("size"))


@query
def stream_blend_equals_batch(spark, sf_dir):
    """Events and conversations, numbered in eight lanes, blended as streams: slots and numbers are those of a batch."""
    number = lambda lane, order: F.row_number().over(Window.partitionBy(lane).orderBy(*order)) - 1
    first = A.table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("lane"), "event_id")
    first = first.select("lane", number("lane", ["event_id"]).cast("long").alias("n"))
    second = A.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).cast("int").alias("lane"), "conv_id", "turn")
    last = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("conv_id"), F.desc("turn"))) == 1
    second = second.select("lane", number("lane", ["conv_id", "turn"]).cast("long").alias("n"), last.alias("final"))
    paths = [files.shared_path(spark, x) for x in ("first", "second")]
    for df, path in zip((first, second), paths):
        df.write.parquet(path)
    return online.run_available(blend_streams(*(spark.readStream.schema(df.schema).parquet(p) for df, p in zip((first, second), paths)), 5 / 6, 12))


@query
def buffered_shuffle(spark, sf_dir):
    """Events in random order, from four buckets: all there, and none leaves more than a buffer before it came."""
    buffer, low = 512, (1 << 33) - 1
    out = shuffle.buffer_shuffle(A.table(spark, sf_dir, "events").select("event_id"), ["event_id"], buffer, 128, 3, 4)
    # written once: the places are those of this run
    path = files.shared_path(spark, "shuffled")
    out.select("event_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("place")).write.parquet(path)
    came = F.row_number().over(Window.partitionBy("part").orderBy("event_id")) - 1
    return spark.read.parquet(path).select("event_id", (F.col("place") >= came - buffer).alias("bounded"))


def _checked(row: dict) -> dict:
    if row["event_type"] == "error":
        raise guarded.Skip("error event", str(row["event_id"]))
    if row["value"] < 5:
        raise guarded.Skip("small value")
    return {"event_id": row["event_id"], "twice": 2 * row["value"]}


@query
def guarded_events(spark, sf_dir):
    """Events through a function that leaves some out: sums of what came out, and of each reason."""
    out = guarded.map_rows(A.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), _checked, "event_id long, twice double", ["event_id"])
    ok = out.rows.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("twice"), 4).alias("twice")).withColumn("reason", F.lit("ok"))
    lost = out.skipped.groupBy("reason").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("twice", F.lit(None).cast("double"))
    total = spark.createDataFrame([(out.counts["rows_in"], out.counts["rows_out"])], "n long, ids long").withColumns({"twice": F.lit(float(out.counts["skipped"])), "reason": F.lit("counted")})
    return ok.unionByName(lost).unionByName(total).select("reason", "n", "ids", "twice")


@query
def collated_batches(spark, sf_dir):
    """Lengths of conversations' turns as batches of sixteen padded arrays."""
    turns = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").alias("n")))).alias("t"))
    rows = turns.select("conv_id", F.transform(F.filter("t", lambda x: x["n"] % 3 != 0), lambda x: x["n"]).alias("lengths"))
    out = collate.collate(rows, ["conv_id"], 16, {"lengths": F.lit(-1)}, ["conv_id"])
    flat = out.select("batch", "n", F.posexplode(F.arrays_zip("conv_id", "lengths", "lengths_mask", "lengths_length")).alias("place", "r"))
    return flat.select("batch", "n", "place", "r.conv_id", F.array_join("r.lengths", ",").alias("lengths"), F.size(F.filter("r.lengths_mask", lambda x: x)).alias("valid"), F.col("r.lengths_length").alias("length"))


@query
def processed_frames(spark, sf_dir):
    """Pictures and depths at half the size, with the camera's numbers: sums of colours, millimetres."""
    e = A.vectors(spark, sf_dir).select(F.format_string("frame_%08d", "vec_id").alias("key"), F.to_json(F.struct("label")).alias("meta"), F.transform("v", lambda x: F.floor(F.abs(x) * 1000).cast("int")).alias("v"))
    path = files.shared_path(spark, "picture-shards")
    shards.write_frames(e, path, pictures.pictures)
    frames = members.located_frames(spark, f"{path}/*.tar", columns=PLACED).withColumn("image_refs", F.array(members.locator()))
    out = members.with_media(frames.select("shard", "pos", "key", "image_refs"), ["shard", "pos"], {"image": ("image_refs", "image.jpg"), "metres": ("image_refs", "depth.npy")})
    out = out.select("shard", "pos", "key", F.get("image", 0).alias("image"), F.get("metres", 0).alias("metres"))
    out = media.decode_images(out, ["shard", "key"], "image").withColumn("intrinsic", F.array(F.lit(8.0), F.lit(6.0), F.lit(4.0), F.lit(3.0)))
    half = (media.depths_of(["shard", "key"], "metres"), images.processed(["key"], size=(4, 4)))
    kept = through(out, *half, pictures.sums)
    k = through(out, *half).select(F.substring("key", 7, 8).cast("long").alias("vec_id"), F.array_join(F.transform("intrinsic", lambda x: x.cast("string")), ",").alias("intrinsic"))
    return kept.join(k, "vec_id")


@query
def covariance_of_sides(spark, sf_dir):
    """Trace and determinant of the covariances of truth, prediction and error: two numbers of each embedding."""
    v = A.vectors(spark, sf_dir)
    side = F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.get("v", d).alias("gt"), F.get("v", 2 + d).alias("pred")) for d in range(2))))
    out = metrics.covariance_summaries(v.select(F.col("vec_id").alias("sample_id"), F.lit(0).alias("step"), side))
    return out.select("of", "size", F.round("trace", 8).alias("trace"), F.round("determinant", 8).alias("determinant"))


@query
def slots_scattered(spark, sf_dir):
    """Purchases of a user as slots in the order of time: the k-th takes the user's k-th largest value."""
    e = A.table(spark, sf_dir, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")) - 1
    values = e.where("event_type = 'purchase'").select("user_id", k.alias("k"), "value")
    return samples.scatter_slots(e.select("user_id", "place", "event_id", "event_type"), values, "user_id", "place", F.col("event_type") == "purchase").select("event_id", r6("value").alias("value"))


@query
def flow_time_any_beta(spark, sf_dir):
    """Times of Beta(2, 2): its distribution function of them is the uniform number again."""
    t = S.beta_time_of(blend.unit_hash("event_id", seed=5), 2.0, 2.0)
    z = 1 - F.col("t")
    return A.table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", F.round(3 * z * z - 2 * z * z * z, 6).alias("share"))


@query
def model_rows_of_pairs(spark, sf_dir):
    """Embeddings as windows of one state and one action, made relative and padded: the state's numbers, the hands'
    differences, counts and masks."""
    part = lambda c, a, n: F.array(F.slice(c, a + 1, n)).alias(f"{'hand' if a else 'wrist'}_{'states' if c == 'v' else 'actions'}")
    pairs = A.vector_pairs(spark, sf_dir)
    rows = pairs.select("vec_id", *(part(c, a, n) for c in ("v", "nxt") for a, n in ((0, 18), (18, 30))), F.slice("v", 49, 16).alias("extrinsic"))
    out = vla.model_rows(rows, vla.Shape(2, 3, 1, 10, relative=True), locator=["vec_id"])
    steps = F.posexplode(F.arrays_zip(F.get("states", 0).alias("x"), F.get("actions", 0).alias("a"))).alias("dim", "r")
    out = out.select("vec_id", "n_states", "n_actions", "n_later", F.array_join(F.transform("actions_valid", lambda x: x.cast("string")), ",").alias("valid"), steps)
    return out.select("vec_id", "dim", "n_states", "n_actions", "n_later", "valid", r6("r.x").alias("x"), F.when(F.col("dim") >= 18, r6("r.a")).alias("hand"))


@query
def served_observations(spark, sf_dir):
    """Users' last events as states, the first ones as a known prefix, padded and normalized; a chest camera for some."""
    last = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    u = A.table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("e"), F.max("event_type").alias("kind"))
    step = lambda x: F.array(x["value"], (x["event_id"] % 7).cast("double"))
    two, k = F.col("user_id") % 3 == 0, F.col("user_id").cast("double")
    rows = u.select(
        "user_id", F.when(F.col("user_id") % 2 == 0, F.col("kind")).otherwise("").alias("instruction"), F.array(F.lit("a"), F.lit("b")).alias("head_images"), F.when(two, F.array(F.lit("c"))).alias("chest_images"),
        F.when(F.col("user_id") % 2 == 0, F.array(k, k + 1, k + 2, k + 3)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda x: k + x)).alias("head_intrinsic"), F.when(two & (F.col("user_id") % 2 == 0), F.array(k, k, k, k)).alias("chest_intrinsic"),
        F.transform("e", step).alias("states"), F.when(F.col("user_id") % 5 != 0, F.transform(F.slice("e", 1, 2), step)).alias("prefix"),
    )
    out = serving.observations(rows, serving.Horizon(1, 6, 3, 2), "wait", [0.5, 2.0], [1.0, -1.0])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.array_join(F.transform(s, lambda x: F.round(x, 4).cast("string")), " ")), ",")
    return out.select("user_id", "instruction", F.array_join("head_images", "").alias("images"), F.array_join(F.transform("head_intrinsic", lambda x: x.cast("int").cast("string")), ",").alias("intrinsic"), F.array_join("active_views", ",").alias("views"), text("states").alias("states"), "n_states", text("prefix").alias("prefix"), "delay", "video_fps")


@query
def vision_entries(spark, sf_dir):
    """Events as samples of images or of one or two videos: their entries in order."""
    e = A.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "image").otherwise("video").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("head"), F.lit("chest"))).otherwise(F.array(F.lit("head"))).alias("views"),
        (F.col("event_id") % 5).cast("int").alias("n"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 4).cast("int")).alias("n_chest"), F.lit(1.5).alias("fps"),
    )
    out = serving.vision_entries(e, "event_id", "kind", "views", "n", "n_chest", "fps")
    return out.select("event_id", "place", "kind", "view", "frames", "fps", F.array_join("indices", ",").alias("indices"))


@query
def stored_predictions(spark, sf_dir):
    """Predictions and the metrics document, stored and read again."""
    path, pred = files.shared_path(spark, "evaluation"), A.predictions(spark, sf_dir)
    store.save_predictions(pred, f"{path}/predictions")
    back = spark.read.schema(pred.schema).parquet(f"{path}/predictions")  # what is stored is not joined and numbered again
    dealt = back.repartition("sample_id").persist(StorageLevel.DISK_ONLY)  # one shuffle for all metrics
    store.save_metrics(metrics.document(dealt), f"{path}/metrics")
    dealt.unpersist()
    document = spark.read.json(f"{path}/metrics")
    rows = back.agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("samples"), F.count_if("valid").alias("valid"))
    errors = document.select(F.lit(1).alias("_k"), r6("heatmap.mean").alias("mean_error"), r6("heatmap.max").alias("max_error"))
    return rows.withColumn("_k", F.lit(1)).join(F.broadcast(errors), "_k").drop("_k")  # one row each


@query
def attention_steps(spark, sf_dir):
    """Attention at one denoising step, the mean of the first three, and of all; numbers alone count."""
    long = A.vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("k", "x"))
    k = F.col("k")
    rows = long.select("vec_id", (k % 4).cast("int").alias("step"), F.lit(0).alias("layer"), F.lit(0).alias("head"), F.lit(0).alias("query"), F.lit(0).alias("frame"), F.lit(0).alias("y"), F.floor(k / 4).cast("int").alias("x"), F.when((k % 4 == 2) & (F.col("vec_id") % 3 == 0), float("nan")).otherwise(F.abs("x")).alias("w"))
    parts = [attention.at_step(rows, ["vec_id"], step).select("vec_id", F.lit(str(step)).alias("step"), "x", r6("w").alias("w")) for step in (1, "early", "mean")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def view_contrast(spark, sf_dir):
    """Low and high quantile of the first number of each label's embeddings, and of all."""
    v = A.vectors(spark, sf_dir).select(F.col("label").cast("string").alias("label"), F.get("v", 0).alias("x"))
    return profile.contrast(v, "label", "x").select("label", r6("low").alias("low"), r6("high").alias("high"))


@query
def task_prompts(spark, sf_dir):
    """Tasks of one and two cameras, with their numbers and with marks, as turns of a conversation."""
    k, two = F.col("event_id"), F.col("event_id") % 2 == 0
    views = F.when(two, F.array(F.lit("head"), F.lit("chest"))).otherwise(F.array(F.lit("head")))
    numbers = lambda more: F.array(F.col("value"), F.col("value") * 2, k.cast("double") + more, F.lit(1.0))
    e = A.table(spark, sf_dir, "events").select("event_id", "event_type", views.alias("views"), F.create_map(F.lit("head"), numbers(0.25), F.lit("chest"), numbers(0.75)).alias("k"), (k % 4).cast("int").alias("n"))
    args = (F.col("event_type"), F.col("views"), F.col("k"), F.col("n"))
    e = e.withColumns({"plain": X.task_prompt(*args), "marked": X.task_prompt(*args, marks=True, frames=True)})
    turns = X.task_messages(F.col("plain"), F.col("views"), F.col("n"), F.col("event_id") % 3 == 0)
    flat = F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), F.array_join(F.transform(t["content"], lambda c: F.concat(c["type"], F.lit(" "), F.length(F.coalesce(c["text"], F.lit(""))).cast("string"))), "+")))
    return e.select("event_id", "plain", "marked", F.array_join(flat, " | ").alias("turns"))


@query
def decoded_media_gate(spark, sf_dir):
    """Pictures and depths decoded from shards, then judged: too dark or flat an image, too few valid depths."""
    flat = F.transform("v", lambda x: F.when(F.col("vec_id") % 5 == 0, F.lit(3)).when(F.col("vec_id") % 7 == 0, F.floor(F.abs(x) * 10) % 2 * 0).otherwise(F.floor(F.abs(x) * 1000)).cast("int"))
    e = A.vectors(spark, sf_dir).select(F.format_string("frame_%08d", "vec_id").alias("key"), F.to_json(F.struct("label")).alias("meta"), flat.alias("v"))
    path = files.shared_path(spark, "picture-shards")
    shards.write_frames(e, path, pictures.pictures)
    frames = members.located_frames(spark, f"{path}/*.tar", columns=PLACED).withColumn("image_refs", F.array(members.locator()))
    out = members.with_media(frames.select("shard", "pos", "key", "image_refs"), ["shard", "pos"], {"image": ("image_refs", "image.jpg"), "metres": ("image_refs", "depth.npy")})
    out = out.select("shard", "key", F.get("image", 0).alias("image"), F.get("metres", 0).alias("metres"))
    out = through(media.decode_images(out, ["shard", "key"], "image"), images.channel_stats, media.depths_of(["shard", "key"], "metres"), media.depth_values)
    checks = [("image", quality_gate.image_fails(F.col("means"), F.col("stds"))), ("depth", quality_gate.depth_fails(F.col("depths")))]
    out = quality_gate.with_reason(out, checks)
    return out.select(F.substring("key", 7, 8).cast("long").alias("vec_id"), r6(F.get("means", 0)).alias("red"), r6(F.get("stds", 1)).alias("green_std"), F.coalesce("reason", F.lit("ok")).alias("reason"), (quality_gate.depth_fails(F.col("depths"))).alias("no_depth"))


@query
def random_mix(spark, sf_dir):
    """As many slots as events, each drawing a line, an order or a page by weight; pages start anew when they end."""
    slots = blend.number_rows(A.table(spark, sf_dir, "events").select("event_id"), ["event_id"], "slot")
    sizes = [A.table(spark, sf_dir, t).count() for t in ("lineitem", "orders", "pages")]
    return blend.random_mix(slots, [0.5, 0.25, 0.25], sizes, seed=6).select("event_id", "slot", "source", "number")


@query
def windows_of_resampled_shards(spark, sf_dir):
    """A training stream: shards drawn in random order for two epochs, in bounded batches, composed to windows as their
    frames arrive, and thinned; each epoch has the same windows."""
    streams = resampled.resampled_lanes(spark, f"{event_shards(spark, sf_dir)}/*.tar.zst", LANES, seed=4, epochs=2, rows=20_000, image=False, columns=["pos", "key", "episode_index", "high_quality", "lowdim", "meta", "epoch"])
    frame = ("epoch", "episode_index", "pos", F.substring("key", 7, 8).cast("long").alias("event_id"), F.get("lowdim", 0).cast("double").alias("payload"), "high_quality", F.get_json_object("meta", "$.last").cast("boolean").alias("final"))
    config = windows.WindowConfig(windows.Reach(4, 2, "truncate"), windows.Reach(3, 2))
    composed = (online.compose(s.select(*frame), config, ["epoch", "episode_index"], "pos") for s in streams)  # an episode is in one shard
    out = online.run_to_end(*(c.where(blend.unit_hash("event_id", seed=7) < 0.4) for c in composed))
    out = out.groupBy("event_id").agg(F.count("*").alias("epochs"), F.min(F.struct("actions", "states")).alias("a"), F.max(F.struct("actions", "states")).alias("b"))
    flat = out.select("event_id", "epochs", (F.col("a") == F.col("b")).alias("alike"), F.size("a.states").alias("n_states"), F.posexplode("a.actions").alias("k", "x"))
    return flat.select("event_id", "k", "epochs", "alike", "n_states", F.round("x", 4).alias("x"))
