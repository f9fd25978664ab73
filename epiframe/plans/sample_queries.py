"""Queries of sampling, sample rows, texts, attention, evaluation and storage operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import sampling as S
from ..functions import text as X
from ..operators import attention, blend, candidates, metrics, normalizer, profile, quality_gate, samples
from ..sources import adapters as A
from ..sources import files, shards, store
from ..steps import Run
from ..streaming import online
from .registry import query, r6, r10


def u(*keys: str, seed: int = 0):
    return blend.unit_hash(*keys, seed=seed)


def _bits(mask):
    return F.array_join(F.transform(mask, lambda x: F.when(x, "1").otherwise("0")), "")


# sampling


@query
def flow_time_samples(spark, sf_dir):
    batch = F.floor(F.col("event_id") / 64)
    even = S.stratified_time((F.col("event_id") % 64).cast("double"), 64, blend.unit_hash(batch, seed=1))
    return A.table(spark, sf_dir, "events").select("event_id", r6(even).alias("t_uniform"), r6(S.beta_time(u("event_id", seed=2), 1.5, 0.001)).alias("t_beta"))


@query
def position_samples(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select(
        "event_id", S.geometric(u("event_id", seed=1), 3.0).alias("geometric"), S.beta_position(u("event_id", seed=2), 16, 2.5).alias("early"),
        S.beta_position(u("event_id", seed=3), 16, 2.5, early=False).alias("late"), S.poisson(u("event_id", seed=4), 2.0, 10).alias("spans"),
    )


@query
def prefix_delays(spark, sf_dir):
    n = (F.col("event_id") % 9).cast("int")
    return A.table(spark, sf_dir, "events").select("event_id", S.prefix_delay(u("event_id", seed=1), n, "uniform", 6).alias("even"), S.prefix_delay(u("event_id", seed=2), n, "exp", 6).alias("falling"), S.prefix_delay(u("event_id", seed=3), n).alias("open"))


@query
def state_masks(spark, sf_dir):
    each = lambda k: blend.unit_hash("event_id", k, seed=1)
    span = lambda k, name: blend.unit_hash("event_id", k, F.lit(name), seed=3)
    return A.table(spark, sf_dir, "events").select("event_id", _bits(S.bernoulli_mask(each, u("event_id", seed=2), 6, 0.3, True, 0.2)).alias("frames"), _bits(S.span_mask(span, 12, 0.4, 2.0, 1.5, True, 0.1)).alias("spans"))


@query
def view_dropout(spark, sf_dir):
    chest = F.col("event_id") % 3 != 0
    df = A.table(spark, sf_dir, "events").withColumn("views", S.active_views(u("event_id", seed=1), chest, 0.2, 0.3))
    return df.select("event_id", F.array_join("views", "+").alias("views"), F.array_join(S.active_views(u("event_id"), chest, 0.2, 0.3, train=False), "+").alias("val_views"), X.view_order(F.col("views")).alias("text"), X.views_fail(F.col("views")).alias("fails"))


@query
def flow_inputs(spark, sf_dir):
    """Each step of a chunk, replicated twice with a time of its own, under a sampled prefix."""
    pred = A.predictions(spark, sf_dir)
    n_valid = F.count_if("valid").over(Window.partitionBy("sample_id")).cast("int")
    df = pred.withColumn("delay", S.prefix_delay(u("sample_id", seed=1), n_valid, "uniform", 3)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1))))
    c = S.conditioned(F.col("step"), F.col("delay"), S.beta_time(u("sample_id", "copy", seed=2), 1.5), F.col("valid"))
    df = df.withColumns(c)
    return df.groupBy("sample_id", "copy").agg(F.max("delay").alias("delay"), F.count_if("loss_on").alias("n_loss"), r6(F.sum(S.noisy(F.col("pred"), F.col("gt"), F.col("time"), 0.01))).alias("psi"))


@query
def instruction_pick(spark, sf_dir):
    words = F.split("text", " ")
    return A.table(spark, sf_dir, "documents").select("doc_id", S.pick(words, u("doc_id", seed=1)).alias("train_pick"), S.pick(words, u("doc_id"), train=False).alias("val_pick"))


# sample rows


@query
def lowdim_named_slices(spark, sf_dir):
    vector = F.concat("v", "v")
    parts = samples.named_slices(vector, ["head"])
    total = lambda a: r6(F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.size(a).alias("n"), total(a).alias("total")) for name, a in parts.items()))
    return A.vectors(spark, sf_dir).select("vec_id", F.explode(rows).alias("p")).select("vec_id", "p.*")


def _posed(df, *arrays):
    for a in arrays:
        df = G.with_poses(df, a, f"{a}_left", f"{a}_right")
    return df


def _poses(a):
    return G.matrix4(f"{a}_left"), G.matrix4(f"{a}_right")


@query
def state_action_rows(spark, sf_dir):
    """Wrists in the camera's frame, and the first ten numbers of each hand."""
    out = samples.process_state_action(_poses("v"), G.vector("v", 18, 30), G.matrix4("v", 48), 10)
    df = _posed(A.vectors(spark, sf_dir), "v").select("vec_id", F.array(*out).alias("x"))
    return df.select("vec_id", F.posexplode("x").alias("dim", "x")).select("vec_id", "dim", r6("x").alias("x"))


@query
def absolute_action_roundtrip(spark, sf_dir):
    """Relative actions turned back: what is left of the difference, beside two of the relative numbers."""
    df = _posed(A.vector_pairs(spark, sf_dir), "v", "nxt")
    rel = samples.relative_action(_poses("v"), _poses("nxt"), G.vector("v", 18, 30), G.vector("nxt", 18, 30))
    df = _posed(df.withColumn("rel", F.array(*rel)), "rel")
    df = df.withColumn("back", F.array(*samples.absolute_action(_poses("v"), _poses("rel"), G.vector("v", 18, 30), G.vector("rel", 18, 30))))
    apart = [F.abs(F.get("back", F.lit(k)) - F.get("nxt", F.lit(k))) for k in [*range(6), *range(18, 48)]]
    return df.select("vec_id", r6(F.get("rel", F.lit(18))).alias("h0"), r6(F.get("rel", F.lit(47))).alias("h29"), F.round(F.greatest(*apart), 5).alias("max_error"))


@query
def hand_points_camera_frame(spark, sf_dir):
    """Finger points from their wrist's frame to the frame that the wrists' poses are in."""
    out = samples.hand_points_to_camera([G.vector("v", 18 + 3 * k, 3) for k in range(10)], _poses("v"))
    df = _posed(A.vectors(spark, sf_dir), "v").select("vec_id", F.array(*(x for p in out for x in p)).alias("x"))
    points = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(*(r6(F.get("x", 3 * k + i)).alias(c) for i, c in enumerate("xyz"))))
    return df.select("vec_id", F.posexplode(points).alias("point", "p")).select("vec_id", "point", "p.*")


@query
def padded_history(spark, sf_dir):
    """The last six lines of a document, by digest, the first repeated where there are fewer, or left short."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.md5(x))
    full, n = samples.history(lines, 6)
    short, m = samples.history(lines, 6, "truncate")
    return A.table(spark, sf_dir, "documents").select("doc_id", F.array_join(full, " ").alias("full"), n.alias("n_full"), F.array_join(short, " ").alias("short"), m.alias("n_short"))


@query
def qa_rows(spark, sf_dir):
    pairs = A.question_pairs(spark, sf_dir)
    best = candidates.best_row(F.struct(F.col("text").alias("user"), F.col("reply").alias("assistant")), F.col("turn"), F.col("formatting"), F.col("visual"), F.col("relevance"))
    row = samples.qa_row(F.col("best"), F.when(F.col("conv_id") % 3 == 0, F.lit("web")), F.when(F.col("conv_id") % 3 == 1, F.lit("book")), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")))
    df = pairs.groupBy("conv_id").agg(best.alias("best")).select("conv_id", *(v.alias(k) for k, v in row.items()))
    return df.select("conv_id", "question", "answer", "is_vla_data", F.exists("view_mask", lambda x: x).alias("any_view"), "dataset_name", "episode_index")


@query
def chat_messages(spark, sf_dir):
    """Turns of question pairs as a model takes them; every fourth is a prompt alone."""
    pairs = A.question_pairs(spark, sf_dir)
    m = X.messages(F.col("text"), F.col("reply"), F.col("turn") % 4 == 0)
    return pairs.select("conv_id", "turn", F.posexplode(m).alias("place", "m")).select("conv_id", "turn", "place", "m.role", F.md5("m.content").alias("content"))


@query
def view_intrinsic_rows(spark, sf_dir):
    df = A.table(spark, sf_dir, "events").select("event_id", S.active_views(u("event_id", seed=1), F.col("event_id") % 3 != 0, 0.2, 0.3).alias("views"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("head"), F.col("value"), F.lit("chest"), F.col("value") * 2)).otherwise(F.create_map(F.lit("head"), F.col("value"))).alias("k"))
    out = samples.view_intrinsics(df, ["event_id"], "views", "k")
    return out.select("event_id", "place", "view", r6("intrinsic").alias("intrinsic"))


@query
def image_name_order(spark, sf_dir):
    names = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 13).cast("int")), lambda k: F.concat(F.lit("image_"), k.cast("string"), F.when(k % 5 == 4, ".png").otherwise(".jpg")))
    return A.table(spark, sf_dir, "events").select("event_id", F.array_join(X.image_names(names), ",").alias("names"))


# texts


@query
def request_texts(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    address = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 1, F.lit("::")).otherwise(F.concat(F.lit("/"), "c_name", F.lit(": "), "c_mktsegment"))
    size = (F.col("c_custkey") * F.col("c_custkey") * 37)
    return c.select("c_custkey", X.folder_name(address).alias("folder"), X.byte_size(size).alias("size"))


@query
def request_json(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    fields = {"id": F.col("event_id"), "kind": F.col("event_type"), "raw": F.lower(F.hex(F.encode("event_type", "UTF-8"))), "image": F.lit("left out")}
    return e.select("event_id", X.as_json(fields, drop=("image",)).alias("fields"), X.stamp(F.col("ts")).alias("at"))


# gate


@query
def media_gate(spark, sf_dir):
    """Image, depth and schema checks on numbers derived from vectors, and what they find first."""
    px = F.transform(F.slice("v", 1, 3), lambda x: F.abs(x) * 100)
    spread = F.transform(F.slice("v", 4, 3), lambda x: F.abs(x) * 100)
    depth = F.slice("v", 7, 40)
    checks = [("schema", quality_gate.schema_fails(["label"], {"v": 64})), ("image", quality_gate.image_fails(px, spread, 0.5, 30.0, 0.5)), ("depth", quality_gate.depth_fails(depth, 0.45)), ("finite", quality_gate.array_not_finite(F.col("v")))]
    return quality_gate.with_reason(A.vectors(spark, sf_dir), checks).select("vec_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query
def non_finite_values(spark, sf_dir):
    x = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value"))
    df = A.table(spark, sf_dir, "events").select(F.array(x).alias("a"))
    out = quality_gate.non_finite_summary(df, "a")
    return out.select("nan", "inf", *(r6(c).alias(c) for c in ("min", "max", "mean")))


# evaluation


@query
def accuracy_partly_valid(spark, sf_dir):
    """Steps of two dimensions, one of which alone may be valid."""
    pred = A.predictions(spark, sf_dir)
    two = pred.withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumns({"valid": F.col("valid") & ((F.col("dim") == 0) | (F.col("step") % 2 == 0)), "pred": F.col("pred") + F.col("dim") * 0.05})
    return metrics.action_accuracy(two).select("threshold", r6("accuracy").alias("accuracy"))


@query
def error_tables(spark, sf_dir):
    pred = A.predictions(spark, sf_dir)
    heat = metrics.error_heatmap(pred).select(F.lit("heatmap").alias("kind"), "step", "dim", r10("error").alias("x"))
    mae = metrics.per_dim_mae(pred).select(F.lit("mae").alias("kind"), F.lit(-1).alias("step"), "dim", r6("mae").alias("x"))
    loss = metrics.loss_average(metrics.with_error(pred), "err").select(F.lit("loss").alias("kind"), F.lit(-1).alias("step"), F.lit(-1).alias("dim"), r6("average").alias("x"))
    return heat.unionByName(mae).unionByName(loss)


@query
def metrics_document(spark, sf_dir):
    d = metrics.document(samples.scored(A.predictions(spark, sf_dir)))
    return d.select(r6("heatmap.mean").alias("heat_mean"), r6("heatmap.max").alias("heat_max"), r6(F.element_at("accuracy", F.lit("0.1"))).alias("accuracy"), r6("trajectory.mean_error").alias("mean_error"), r6("trajectory.max_error").alias("max_error"), r6("first_diff_error").alias("first_diff"), r6("second_diff_error").alias("second_diff"))


@query
def covariance_summary(spark, sf_dir):
    """Trace of the covariance matrix of the lines' numbers."""
    c = metrics.covariance(A.table(spark, sf_dir, "lineitem"), A.LINE_DIMENSIONS)
    return c.agg(F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))) / 1e6, 4).alias("trace_millions"), F.count("*").alias("cells"))


@query
def worst_first_report(spark, sf_dir):
    rows = samples.report_rows(A.predictions(spark, sf_dir), 1)
    return rows.select("sample_id", r10("mae").alias("mae"), "n", r10("prefix_l1").alias("prefix_l1"))


@query
def eval_subsample(spark, sf_dir):
    return samples.eval_subsample(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 200, 3)


@query
def head_video_entries(spark, sf_dir):
    """Batches of 16 events with as many video entries, twice as many, or another number."""
    batch = F.floor(F.col("event_id") / 16)
    df = A.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 16).alias("sample"), F.when(batch % 3 == 0, 16).when(batch % 3 == 1, 32).otherwise(11).alias("entries"))
    return samples.head_entries(df, "sample", "entries", F.lit(16)).select("event_id", F.col("entry").cast("long").alias("entry"))


@query
def attention_maps(spark, sf_dir):
    """Vectors as 4 layers, 2 heads, 2 queries and 4 patches; some layers hold no number."""
    long = A.vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("k", "x"))
    k = F.col("k")
    rows = long.select("vec_id", F.floor(k / 16).cast("int").alias("layer"), (F.floor(k / 8) % 2).cast("int").alias("head"), (F.floor(k / 4) % 2).cast("int").alias("query"), F.lit(0).alias("frame"), (F.floor(k / 2) % 2).cast("int").alias("y"), (k % 2).alias("x"), F.when((F.floor(k / 16) == 2) & (F.col("vec_id") % 4 == 0), float("nan")).otherwise(F.abs("x")).alias("w"))
    out = None
    for name, layers in (("middle_layers_mean_heads", (1, 3)), ("mean_layers_heads", None), ("max_heads", None), ("last_layer_mean_heads", None)):
        grid = attention.renormalized(attention.aggregate(rows, ["vec_id"], name, layers), ["vec_id"])
        one = grid.select("vec_id", F.lit(name).alias("strategy"), (F.col("y") * 2 + F.col("x")).alias("patch"), r6("w").alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def attention_entropy(spark, sf_dir):
    grid = A.vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("k", "x")).select("vec_id", F.abs("x").alias("w"))
    return attention.entropy(grid, ["vec_id"]).select("vec_id", r6("entropy").alias("entropy"))


@query
def attention_segments(spark, sf_dir):
    counts = (F.col("event_id") % 5 + 1) * 4
    df = attention.segments(A.table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", counts)
    return df.select("user_id", "event_id", F.col("first_token").cast("long").alias("first_token"), F.col("last_token").cast("long").alias("last_token"))


# profiles


@query
def sample_profile(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("worker", (F.col("user_id") % 4).cast("long"))
    out = profile.sample_profile(e, ["value"], "worker", ["event_type"])
    return out.select("event_type", "samples", r6("value_sum").alias("value_sum"), r6("value_avg").alias("value_avg"), F.array_join(F.transform("workers", lambda x: x.cast("string")), ",").alias("workers"))


@query
def observation_stats(spark, sf_dir):
    s = profile.array_stats(F.col("v"))
    return A.vectors(spark, sf_dir).select("vec_id", s.alias("s")).select("vec_id", "s.size", *(r6(F.col("s")[c]).alias(c) for c in ("min", "max", "mean", "std")))


# geometry


@query
def euler_and_quaternions(spark, sf_dir):
    """Angles to a matrix and a quaternion and back; the quaternion's matrix is the angles' matrix."""
    a, b, c = (F.get("v", F.lit(k)) * s for k, s in ((0, 3.0), (1, 1.5), (2, 3.0)))
    df = A.vectors(spark, sf_dir).withColumns({"a": a, "b": b, "c": c})
    angles = [F.col(x) for x in "abc"]
    m, q = G.euler_matrix(*angles), G.euler_quaternion(*angles)
    df = df.withColumns({"m": F.array(*(x for row in m for x in row)), "q": F.array(*q)})
    flat = [[F.get("m", F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    quaternion = [F.get("q", F.lit(k)) for k in range(4)]
    of_q = G.quaternion_matrix(quaternion)
    apart = F.greatest(*(F.abs(of_q[i][j] - flat[i][j]) for i in range(3) for j in range(3)))
    back = G.matrix_euler(flat)
    return df.select("vec_id", *(r6(flat[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)), F.round(apart, 6).alias("apart"), F.round(F.greatest(*(F.abs(x - y) for x, y in zip(back, angles))), 6).alias("angle_error"), G.is_rotation(flat).alias("rotation"))


@query
def relative_motions(spark, sf_dir):
    """A camera's matrix times the inverse of a later one: of rigid ones, by the transposed rotation."""
    df = A.vector_pairs(spark, sf_dir)
    now, later = G.wrist_poses("v")[0], G.wrist_poses("nxt")[0]
    flat = lambda m: F.array(*(x for row in m for x in row))
    df = df.select("vec_id", flat(now).alias("c"), flat(later).alias("l"))
    out = G.relative_motion(G.matrix4("c"), G.matrix4("l"))
    want = G.matmul(G.matrix4("c"), G.rigid_inverse(G.matrix4("l")))
    return df.select("vec_id", F.round(F.greatest(*(F.abs(out[i][j] - want[i][j]) for i in range(4) for j in range(4))), 6).alias("apart"), F.round(out[3][3], 6).alias("corner"))


# storage


def _encoded(_: T.StructType) -> tuple[T.StructType, Run]:
    """Step: frames of events with a vector of 116 numbers and an image of eight bytes."""
    kind = T.StructType.fromDDL("key string, meta string, lowdim array<float>, image binary, depth binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("value", "event_id"))
            vectors = pa.ListArray.from_arrays(np.arange(0, 116 * n + 1, 116, dtype=np.int32), np.repeat(values.astype(np.float32), 116))
            images = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), n, [None, pa.py_buffer(ids.astype("<i8").tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("meta"), vectors, images, pa.array([b"12"] * n, pa.binary())], names=kind.names)

    return kind, run


@query
def frame_shard_roundtrip(spark, sf_dir):
    """Events written as packed tar shards and read back without depths."""
    e = A.table(spark, sf_dir, "events")
    e = e.repartition(1 + e.count() // 5000, "user_id").sortWithinPartitions("user_id", "ts", "event_id")  # shards of about 5000 frames
    meta = F.to_json(F.struct(F.lit("events").alias("dataset_name"), F.col("user_id").alias("episode_index"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("instruction"), F.lit(1).alias("instruction_num"), F.when(F.col("event_type") == "error", 0).alias("high_quality")))
    rows = e.select(F.format_string("frame_%08d", "event_id").alias("key"), meta.alias("meta"), "value", "event_id")
    path = files.shared_path(spark, "shards")
    shards.write_frames(rows, path, _encoded, pack=True)
    f = shards.read_frames(spark, f"{path}/*.tar.zst", depth=False, columns=["key", "dataset_name", "episode_index", "high_quality", "instruction", "lowdim", "image", "depth"])
    return f.select(F.substring("key", 7, 8).cast("long").alias("event_id"), "dataset_name", "episode_index", "high_quality", F.get("instruction", 0).alias("instruction"), F.size("lowdim").alias("n"), F.round(F.get("lowdim", 115).cast("double"), 2).alias("x"), F.octet_length("image").alias("image_bytes"), F.col("depth").isNull().alias("no_depth"))


@query
def stored_parameters(spark, sf_dir):
    """Normalizer parameters and coverage, stored and loaded."""
    path = files.shared_path(spark, "normalizer")
    fitted = normalizer.fit(normalizer.melt(A.table(spark, sf_dir, "lineitem"), A.LINE_DIMENSIONS, "lines"))
    seen = A.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"))
    store.save_parameters(fitted, path, seen)
    loaded = store.load_parameters(spark, path)
    one = store.load_coverage(spark, path).withColumn("key", F.lit("lines"))  # one row
    return loaded.join(F.broadcast(one), "key").select("dim", r6("mean").alias("mean"), r6("min").alias("min"), r6("max").alias("max"), "rows", "schema_version")


@query
def sketched_quantiles(spark, sf_dir):
    """Quantiles by sketch lie within its rank error of the exact ones: shares of rows below them."""
    rows = normalizer.melt(A.table(spark, sf_dir, "lineitem"), A.LINE_DIMENSIONS, "lines")
    s = normalizer.statistics(rows, "sketch").select("key", "dim", "n", "q01", "q99")
    near = rows.join(F.broadcast(s), ["key", "dim"]).groupBy("dim").agg(F.max("n").alias("n"), *(F.abs(F.count_if(F.col("x") < F.col(c)) / F.count("*") - p).alias(f"below_{c}") for c, p in (("q01", 0.01), ("q99", 0.99))), *(F.abs(F.count_if(F.col("x") <= F.col(c)) / F.count("*") - p).alias(f"upto_{c}") for c, p in (("q01", 0.01), ("q99", 0.99))))
    return near.select("dim", "n", ((F.least("below_q01", "upto_q01") < 0.05) & (F.least("below_q99", "upto_q99") < 0.05)).alias("near"))


# streams and joins that Spark has itself


@query
def stream_tumbling_counts(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    out = online.run_available(online.counted(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", ["event_type"], "1 day", "30 days"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def sessions(spark, sf_dir):
    """Runs of a user's events without a gap of six hours."""
    e = A.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return s.select("user_id", "n", "first_event")


@query
def as_of_values(spark, sf_dir):
    """Each purchase with the value of the user's last earlier view: by a window, not a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = A.table(spark, sf_dir, "events").withColumn("seen", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", r6("value").alias("value"), r6("seen").alias("seen"))


@query
def semi_and_anti(spark, sf_dir):
    orders, lines = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    on = orders["o_orderkey"] == lines["l_orderkey"]
    parts = [orders.join(lines, on, kind).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("kind", F.lit(kind)) for kind in ("left_semi", "left_anti")]
    return parts[0].unionByName(parts[1])


@query
def order_cube(spark, sf_dir):
    c = A.table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return c.select("o_orderstatus", "o_orderpriority", "n", "level")
