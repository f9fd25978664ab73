"""Queries of the reference's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import blend, candidates, metrics, normalizer, quality_gate, windows
from ..schema import IGNORED_DIMENSIONS
from ..sources import adapters as A
from ..sources import files
from ..streaming import online
from .registry import QUERIES, query, r6, r10  # noqa: F401


def _episode():
    return Window.partitionBy("dataset_name", "episode_index").orderBy("ts", "event_id")


@query
def episode_windows_truncate(spark, sf_dir):
    df = A.frames_from_events(spark, sf_dir).withColumn("w", windows.future(F.col("payload"), _episode(), 4, 2))
    return df.select("event_id", F.posexplode("w").alias("k", "x")).select("event_id", "k", r6("x").alias("x"))


@query
def episode_windows_history_repeat(spark, sf_dir):
    df = A.frames_from_events(spark, sf_dir).withColumn("w", windows.history(F.col("payload"), _episode(), 3, 2))
    return df.select("event_id", F.posexplode("w").alias("k", "x")).select("event_id", "k", r6("x").alias("x"))


@query
def episode_windows_quality_cut(spark, sf_dir):
    df = A.frames_from_events(spark, sf_dir).withColumn("w", windows.future(F.col("payload"), _episode(), 4, 2, "repeat", quality=F.col("high_quality")))
    df = df.where("high_quality = 1")
    return df.select("event_id", F.posexplode("w").alias("k", "x")).select("event_id", "k", r6("x").alias("x"))


@query
def episode_windows_future_repeat(spark, sf_dir):
    df = A.frames_from_events(spark, sf_dir).withColumn("w", windows.future(F.col("payload"), _episode(), 3, 2, "repeat", base=2))
    return df.select("event_id", F.posexplode("w").alias("k", "x")).select("event_id", "k", r6("x").alias("x"))


@query
def episode_segmentation(spark, sf_dir):
    df = windows.segments(A.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return df.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query
def window_counts_by_episode(spark, sf_dir):
    config = windows.WindowConfig(windows.Reach(4, 2, "truncate"), windows.Reach(3, 2, "truncate"))
    df = windows.compose(A.frames_from_events(spark, sf_dir), config, order=("ts", "event_id"))
    mask = windows.pad_with_mask(F.col("actions"), 4, F.lit(0.0))[1]
    df = df.withColumn("m", F.size(F.filter(mask, lambda x: x)))
    return df.groupBy("episode_index").agg(F.count("*").alias("anchors"), F.sum("n_states").alias("n_states"), F.sum("n_actions").alias("n_actions"), F.sum("m").alias("n_valid"))


def _line_rows(spark, sf_dir):
    return normalizer.melt(A.table(spark, sf_dir, "lineitem"), A.LINE_DIMENSIONS, "lines")


def _params(df, *columns):
    return df.select("dim", *(r6(c).alias(c) for c in columns))


@query
def normalizer_fit_limits(spark, sf_dir):
    return _params(normalizer.fit(_line_rows(spark, sf_dir)), "min", "max", "mean", "std", "q01", "q99", "scale", "offset")


@query
def normalizer_fit_gaussian(spark, sf_dir):
    return _params(normalizer.fit(_line_rows(spark, sf_dir), mode="gaussian"), "scale", "offset")


@query
def normalizer_fit_no_offset(spark, sf_dir):
    return _params(normalizer.fit(_line_rows(spark, sf_dir), fit_offset=False), "scale", "offset")


@query
def normalize_roundtrip(spark, sf_dir):
    rows = _line_rows(spark, sf_dir)
    out = normalizer.normalize(rows, normalizer.fit(rows)).withColumn("back", normalizer.unnormalize(F.col("y"), F.col("scale"), F.col("offset")))
    return out.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.min("y"), 6).alias("min_y"), F.round(F.max("y"), 6).alias("max_y"), F.round(F.max(F.abs(F.col("back") - F.col("x"))), 6).alias("max_error"))


@query
def vector_stats_per_dim(spark, sf_dir):
    params = normalizer.fit(normalizer.melt_array(A.vectors(spark, sf_dir), "v", "states"), ignore=IGNORED_DIMENSIONS)
    return params.select("dim", *(r6(c).alias(c) for c in ("min", "max", "mean", "std", "q01", "q99", "scale", "offset")), "ignored")


@query
def post_normalize_outliers(spark, sf_dir):
    rows = _line_rows(spark, sf_dir)
    out = normalizer.outliers(normalizer.normalize(rows, normalizer.fit(rows, mode="gaussian")), 1.5)
    return out.select("dim", "n", "n_outliers", r6("max_abs").alias("max_abs"))


@query
def instruction_gate(spark, sf_dir):
    kinds = F.array(*(F.lit(x) for x in ("", "none", "TODO", " n/a ")))
    text = F.when(F.col("doc_id") % 50 == 0, F.get(kinds, (F.col("doc_id") / 50).cast("long").cast("int") % 4)).otherwise(F.col("text"))
    df = A.table(spark, sf_dir, "documents").select("doc_id", F.array(text).alias("i"))
    return df.select("doc_id", quality_gate.instruction_fails(F.col("i"), F.lit(1)).alias("skipped"))


def _gate_checks():
    extrinsic = G.matrix4("v", 48)
    return [
        ("intrinsic", quality_gate.intrinsic_fails([F.abs(x) for x in G.vector("v", 44, 4)])),
        ("rot6d_left", quality_gate.rot6d_fails(G.vector("v", 6, 6), 0.6)),
        ("rot6d_right", quality_gate.rot6d_fails(G.vector("v", 12, 6), 0.6)),
        ("determinant", F.abs(G.determinant3(extrinsic)) > 0.001),
        ("extrinsic", quality_gate.extrinsic_fails(extrinsic)),
    ]


@query
def quality_reason_counts(spark, sf_dir):
    return quality_gate.reason_counts(A.vectors(spark, sf_dir), _gate_checks())


@query
def rot6d_orthogonality(spark, sf_dir):
    both = quality_gate.rot6d_fails(G.vector("v", 6, 6)) | quality_gate.rot6d_fails(G.vector("v", 12, 6))
    return A.vectors(spark, sf_dir).select("vec_id", both.alias("skipped"))


@query
def frame_delta_gate(spark, sf_dir):
    a, b = (lambda s, n: G.vector("v", s, n)), (lambda s, n: G.vector("nxt", s, n))
    df = A.vector_pairs(spark, sf_dir)
    return df.select("vec_id", r6(quality_gate.translation_delta(a(0, 6), b(0, 6))).alias("translation"), r6(quality_gate.fingertip_delta(a(18, 30), b(18, 30))).alias("fingertips"), r6(F.greatest(quality_gate.rotation_delta(a(6, 6), b(6, 6)), quality_gate.rotation_delta(a(12, 6), b(12, 6)))).alias("rotation"))


@query
def skip_ratio(spark, sf_dir):
    docs, labels = A.table(spark, sf_dir, "documents").select("doc_id"), A.table(spark, sf_dir, "labels")
    return quality_gate.skip_ratio(docs.join(labels, "doc_id", "left"), F.coalesce(F.col("quality") == 0, F.lit(False)))


@query
def rot6d_matrix(spark, sf_dir):
    m = G.rotation_of(G.vector("v", 6, 6))
    return A.vectors(spark, sf_dir).select("vec_id", *(r6(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)))


@query
def wrist_to_camera(spark, sf_dir):
    out = G.wrist_to_frame("v", G.matrix4("v", 48))
    return A.vectors(spark, sf_dir).select("vec_id", *(r6(x).alias(f"x{k}") for k, x in enumerate(out[:6])))


@query
def relative_action_roundtrip(spark, sf_dir):
    state, action = G.wrist_poses("v")[0], G.wrist_poses("nxt")[0]
    df = A.vector_pairs(spark, sf_dir).select("vec_id", F.array(*(x for row in state for x in row)).alias("s"), F.array(*(x for row in action for x in row)).alias("a"))
    s, a = G.matrix4("s"), G.matrix4("a")
    df = df.select("vec_id", "a", "s", F.array(*(x for row in G.relative_pose(s, a) for x in row)).alias("rel"))
    back = G.matmul(G.matrix4("s"), G.matrix4("rel"))
    error = F.greatest(*(F.abs(back[i][j] - G.matrix4("a")[i][j]) for i in range(3) for j in range(4)))
    rel = G.matrix4("rel")
    return df.select("vec_id", *(r6(rel[i][3]).alias(f"t{i}") for i in range(3)), r6(error).alias("max_error"))


@query
def hand_points_wrist_frame(spark, sf_dir):
    left, right = G.wrist_poses("v")
    df = A.vectors(spark, sf_dir).withColumns({"l": F.array(*(x for row in left for x in row)), "r": F.array(*(x for row in right for x in row))})
    points = [G.vector("v", 18 + 3 * k, 3) for k in range(10)]
    out = G.hand_to_wrist(points, G.matrix4("l"), G.matrix4("r"))
    return df.select("vec_id", F.posexplode(F.array(*(F.struct(*(r6(x).alias(c) for x, c in zip(p, "xyz"))) for p in out))).alias("point", "p")).select("vec_id", "point", "p.*")


@query
def project_points(spark, sf_dir):
    k = [F.lit(x) for x in (388.0, 388.0, 320.0, 240.0)]
    uv = [G.project(G.vector("v", 18 + 3 * i, 3), k) for i in range(10)]
    return A.vectors(spark, sf_dir).select("vec_id", F.posexplode(F.array(*(F.struct(F.round(u, 3).alias("u"), F.round(w, 3).alias("v")) for u, w in uv))).alias("point", "p")).select("vec_id", "point", "p.*")


@query
def action_accuracy(spark, sf_dir):
    pred = A.predictions(spark, sf_dir)
    both = metrics.action_accuracy(pred, masked=True).withColumn("kind", F.lit("masked")).unionByName(metrics.action_accuracy(pred, masked=False).withColumn("kind", F.lit("unmasked_padded")))
    return both.select("kind", "threshold", r6("accuracy").alias("accuracy"))


@query
def masked_part_l1(spark, sf_dir):
    df = A.vector_pairs(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), F.lit(0).alias("step"), F.posexplode(F.zip_with(F.slice("v", 1, 48), F.slice("nxt", 1, 48), lambda a, b: F.struct(a.alias("gt"), b.alias("pred")))).alias("dim", "p"), (F.col("vec_id") % 3 != 0).alias("valid"))
    return metrics.part_l1(df.select("sample_id", "step", "dim", "p.*", "valid")).select("part", r6("l1").alias("l1"))


@query
def smoothness_heatmap(spark, sf_dir):
    return metrics.smoothness(A.predictions(spark, sf_dir)).select("diff", "step", r10("error").alias("error"))


@query
def trajectory_metrics(spark, sf_dir):
    t = metrics.trajectory(A.predictions(spark, sf_dir))
    return t.select("sample_id", *(r10(c).alias(c) for c in ("endpoint_error", "length_error", "mean_error", "max_error")))


@query
def loss_over_time(spark, sf_dir):
    return metrics.loss_over_time(A.predictions(spark, sf_dir)).select("step", r6("l1").alias("l1"), r6("l2").alias("l2"), "n")


@query
def covariance_matrix(spark, sf_dir):
    c = metrics.covariance(A.table(spark, sf_dir, "lineitem"), A.LINE_DIMENSIONS)
    return c.select("i", "j", (F.round("cov", 4) + 0.0).alias("cov"))


def _order_loss(spark, sf_dir):
    return metrics.with_error(A.predictions(spark, sf_dir)).groupBy("sample_id").agg(F.round(F.avg("err"), 9).alias("loss"))


@query
def mean_of_batch_means(spark, sf_dir):
    df = _order_loss(spark, sf_dir).withColumn("batch", F.floor(F.col("sample_id") / 100))
    return metrics.mean_of_batch_means(df, "loss", "batch").select(r6("mean_of_means").alias("mean_of_means"), "batches")


@query
def min_max_loss_sample(spark, sf_dir):
    return metrics.extreme_samples(_order_loss(spark, sf_dir), "loss", ["sample_id"]).select("which", r6("loss").alias("loss"), "sample_id")


def _shards(spark, sf_dir):
    nation = A.table(spark, sf_dir, "nation")
    return A.table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("dataset"), F.col("c_custkey").alias("shard"), "c_mktsegment")


@query
def shard_coverage(spark, sf_dir):
    return blend.coverage(_shards(spark, sf_dir), "dataset", F.col("c_mktsegment") != "BUILDING")


@query
def floor_plus_budget_selection(spark, sf_dir):
    return blend.select_floor_budget(_shards(spark, sf_dir), "dataset", "shard", 3, 100).select("dataset", "shard", "picked_by")


@query
def ratio_interleave(spark, sf_dir):
    first = blend.number_rows(A.table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    turns = A.table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    second = blend.number_rows(turns, ["conv_id", "turn"])
    slots = blend.interleave(first, second, second.count(), 5 / 6, 20)
    a = slots.where("source = 'first'").join(first, "n").select("slot", "source", F.col("event_id").alias("id"))
    b = slots.where("source = 'second'").join(second, "n").select("slot", "source", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return a.unionByName(b)


@query
def validation_chain(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    turns = A.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return blend.chain([docs, turns]).select("source_ord", "id", "lang", "role")


@query
def weighted_blend(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    pages = A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    return blend.weighted_blend([(docs, 3.0), (pages, 1.0)], "id")


@query
def candidate_turn_argmax(spark, sf_dir):
    pairs = A.question_pairs(spark, sf_dir)
    grouped = pairs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "formatting", "visual", "relevance"))).alias("c"))  # the turns of one conversation
    chosen = candidates.best_candidate(F.col("c.formatting"), F.col("c.visual"), F.col("c.relevance"))
    return grouped.select("conv_id", F.size("c").alias("candidates"), chosen.alias("chosen"), F.get(F.col("c.turn"), chosen).alias("turn"))


@query
def prompt_text(spark, sf_dir):
    df = A.table(spark, sf_dir, "events")
    intrinsic = [F.col("value"), F.col("value") / 3, F.lit(320.0), F.lit(240.0)]
    return df.select("event_id", candidates.prompt(F.col("event_type"), (F.col("event_id") % 4).cast("int"), intrinsic).alias("prompt"))


@query
def label_mask_subsequence(spark, sf_dir):
    words = F.split("text", " ")
    at = F.least(F.size(words), (F.col("doc_id") % 40).cast("int"))
    header = F.array(F.lit("<h1>"), F.lit("<h2>"), F.lit("<h3>"))
    tokens = F.when(F.col("doc_id") % 5 == 0, words).otherwise(F.concat(F.slice(words, F.lit(1), at), header, F.slice(words, at + 1, F.size(words))))
    df = A.table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t"))
    df = df.withColumn("start", candidates.answer_start(F.col("t"), ["<h1>", "<h2>", "<h3>"]))
    ids = F.transform("t", lambda x: F.char_length(x))
    labels = candidates.masked_labels(ids, F.col("start"), 0)
    return df.select("doc_id", F.col("start").cast("long").alias("start"), F.size(F.filter(labels, lambda x: x != -100)).cast("long").alias("kept"), F.aggregate(F.filter(labels, lambda x: x != -100), F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query
def prefix_delay_forced(spark, sf_dir):
    pred, delay = A.predictions(spark, sf_dir), 2
    df = pred.withColumns({"time": F.when(F.col("step") < delay, 1.0).otherwise(0.5), "loss_on": (F.col("step") >= delay) & F.col("valid"), "prefix": F.when(F.col("step") < delay, F.col("gt")).otherwise(0.0)})
    return df.groupBy("step").agg(F.count("*").alias("n"), F.max("time").alias("time"), F.count_if("loss_on").alias("n_loss"), r6(F.sum("prefix")).alias("prefix_sum"))


@query
def request_log_timings(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = A.table(spark, sf_dir, "events").withColumns({"request_index": F.row_number().over(w), "prev_infer_ms": F.lag("value").over(w)})
    return df.select(F.col("user_id").alias("conn"), "request_index", r6("value").alias("infer_ms"), r6("prev_infer_ms").alias("prev_infer_ms"))


@query
def stream_stats_equals_batch(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the source takes no single file
    out = online.run_available(online.moments(stream, ["event_type"], "value"), "complete")
    return out.select("event_type", "n", r6("total").alias("total"), F.round("total_sq", 4).alias("total_sq"), r6("low").alias("low"), r6("high").alias("high"))


@query
def stream_windows_equals_batch(spark, sf_dir):
    last = Window.partitionBy("dataset_name", "episode_index").orderBy(F.desc("ts"), F.desc("event_id"))
    frames = A.frames_from_events(spark, sf_dir).withColumn("final", F.row_number().over(last) == 1)
    path = files.shared_path(spark, "frames")
    frames.write.parquet(path)
    config = windows.WindowConfig(windows.Reach(4, 2, "truncate"), windows.Reach(3, 2))
    out = online.run_available(online.compose(spark.readStream.schema(frames.schema).parquet(path), config, ["dataset_name", "episode_index"], "ts"))
    return out.select("event_id", F.posexplode("actions").alias("k", "x"), F.size("states").alias("n_states")).select("event_id", "k", r6("x").alias("x"), "n_states")


from . import loading_queries, media_queries, sample_queries  # noqa: E402, F401  register their queries too
