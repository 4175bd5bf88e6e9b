"""The registered relational queries; each reads the tables of one data folder."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galewise.functions import timefns as tf
from galewise.functions import vectors as v
from galewise.operators import catalog, forecast, itemcf, metrics, positives, sampling, towers, trees
from galewise.operators.indexing import dense_index
from galewise.operators.retrieval import knn_exact
from galewise.plans import inputs
from galewise.session import cut_lineage, scratch_path
from galewise.sources import files, views
from galewise.sources import tables as t

DIM = 64
FEATURES = [str(i) for i in range(1, t.FEATURE_COUNT + 1)]


def _r(col, digits: int = 6):
    return F.round(col, digits)


def _joined(values, fmt: str = "%.6f"):
    """An array of numbers as text, so that other engines can compare it."""
    return F.array_join(F.transform(values, lambda x: F.format_string(fmt, x)), ",")


# --- sources and sinks -------------------------------------------------------


def src_forecast_names(spark: SparkSession, sf: str) -> DataFrame:
    named = files.with_name_parts(t.forecast_files(spark, sf), "file_name")
    return named.select("event_id", "file_name", "init", "gap", "F_time")


def src_station_union(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stations")
    obs = cut_lineage(t.station_obs(spark, sf), "station-obs")
    parts = []
    for name in t.STATIONS:
        parts.append(f"{path}/{name}")
        files.write_csv(obs.where(F.col("StationNum") == name), parts[-1])
    return files.read_stations(spark, parts)


PENGUIN_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("species", "island")]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("bill_length_mm", "bill_depth_mm", "flipper_length_mm", "body_mass_g")
    ]
    + [T.StructField("sex", T.StringType()), T.StructField("year", T.IntegerType())]
)


def src_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "penguins")
    files.write_csv(t.penguins(spark, sf), path)
    return files.read_csv(spark, path, PENGUIN_SCHEMA)


def _ranking(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ranking-text")
    t.ranking_lines(spark, sf).write.text(path)
    return files.read_ranking_text(spark, path, FEATURES)


def src_ranking_text(spark: SparkSession, sf: str) -> DataFrame:
    return _ranking(spark, sf)


def src_snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    labels = forecast.station_labels(t.station_obs(spark, sf))
    stored = files.snapshot(labels, scratch_path(spark, "labels"))
    return stored.select("F_time", F.inline("label")).select(
        "F_time", "StationNum", _r(F.col("ExMaxWindV")).alias("ExMaxWindV")
    )


def src_catalog_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue tables read by SQL text: active courses of a platform with their flags."""
    views.register_views(spark, sf, ["course_platform", "course"])
    return spark.sql(
        """
        WITH offers AS (SELECT course_id AS id, permit_client FROM course_platform WHERE status = 1 AND platform = 1 GROUP BY ALL)
        SELECT string(id) AS course_id, is_vip AS vip_status, is_needbuy AS needbuy_status, permit_client
        FROM course JOIN offers USING (id)
        """
    )


def src_replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """Course flags written as a managed table in place of an older one, then read."""
    name = f"flags_{uuid.uuid4().hex}"
    catalog.replace_table(t.course(spark, sf), name)
    catalog.replace_table(catalog.course_flags(t.course_platform(spark, sf), t.course(spark, sf)), name)
    sizes = spark.table(name).groupBy("vip_status", "needbuy_status").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes, "flag-sizes")
    spark.sql(f"DROP TABLE `{name}`")
    return sizes


def src_report(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration report written as details and summary; both are read back."""
    detail = t.calibration(spark, sf).where("K2962_ecf > 0")
    summary = calib_rmse(spark, sf)
    path = scratch_path(spark, "report")
    files.write_report(detail, summary, path)
    rows = files.read_csv(spark, f"{path}/details", detail.schema)
    sizes = rows.groupBy("gap", "exp").agg(F.count(F.lit(1)).alias("n"))
    return files.read_csv(spark, f"{path}/summary", summary.schema).join(sizes, ["gap", "exp"])


def src_dense_index(spark: SparkSession, sf: str) -> DataFrame:
    return dense_index(t.table(spark, sf, "embeddings").select("vec_id"), "vec_id", "idx")


def retention_victims(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.retention_victims(t.table_names(spark, sf), "video_query_")


# --- filters, flags and retrieval --------------------------------------------


def forecast_lead_filter(spark: SparkSession, sf: str) -> DataFrame:
    named = files.with_name_parts(t.forecast_files(spark, sf), "file_name")
    return forecast.lead_filter(named).select("event_id", "gap", "F_time")


def rank_group_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.parse_ranking_lines(t.ranking_lines(spark, sf), FEATURES)
    return rows.where(F.col("group") == "g_5").drop("relevance", "group")


def prep_features(spark: SparkSession, sf: str) -> DataFrame:
    return t.penguins(spark, sf).select(
        "row_id", (F.col("body_mass_g") / 1000.0).alias("body_mass_kg"), "bill_length_mm"
    )


def catalog_flags(spark: SparkSession, sf: str) -> DataFrame:
    places = F.array(*[F.lit(float(i)) for i in range(1, 33)])  # every element and its place count
    check = lambda c: _r(v.dot(v.as_double(F.col(c)), places, 32))
    return catalog.catalog_flags(*inputs.catalogue(spark, sf)).select(
        "video_id", "vip_status", "needbuy_status",
        check("embedding_query").alias("query_check"), check("embedding_search").alias("search_check"),
    )


def knn_exact_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: for every video, places 5 to 1028 among the free videos."""
    return knn_exact(*inputs.towers(spark, sf))


def itemcf_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return itemcf.itemcf_candidates(
        seed_sample(spark, sf), t.course_sim(spark, sf), t.course_documents(spark, sf)
    )


def tower_join(spark: SparkSession, sf: str) -> DataFrame:
    nce, mapping = t.sim_matrix_nce(spark, sf)
    vectors = t.table(spark, sf, "embeddings").select("vec_id", v.as_double(F.col("embedding")).alias("wide"))
    count = vectors.count()
    contexts = towers.id_index_map(nce, "left_video_id", "c_idx")
    targets = mapping.select("video_id", F.col("p_idx").alias("idx"))

    def tower(numbers: DataFrame, start: int, name: str) -> DataFrame:
        rows = numbers.select("idx", (F.col("idx") % count).alias("vec_id"))
        return rows.join(vectors, "vec_id").select("idx", F.slice("wide", start, 32).alias(name))

    out = towers.tower_join(tower(contexts, 1, "embedding_search"), contexts, tower(targets, 33, "embedding_query"), targets)
    inner = v.dot(F.col("embedding_search"), F.col("embedding_query"), 32)
    return out.select("video_id", _r(inner).alias("ip"))


def bias_fold(spark: SparkSession, sf: str) -> DataFrame:
    vec = t.table(spark, sf, "embeddings").select(
        "vec_id",
        F.slice(v.as_double(F.col("embedding")), 1, 31).alias("w"),
        F.get("embedding", F.lit(31)).cast("double").alias("b"),
        F.slice(v.as_double(F.col("embedding")), 33, 31).alias("h"),
    )
    folded = towers.fold_one(towers.fold_bias(vec, "w", "b"), "h")
    return folded.select(
        "vec_id",
        F.size("embedding_query").alias("width"),
        _r(v.dot(F.col("embedding_query"), F.col("embedding_search"), 32)).alias("ip"),
    )


# A 4×3 layer with bias, then a 3×2 layer without.
LAYER_1 = [[0.5, -0.25, 1.0], [-1.0, 0.75, 0.5], [0.25, 1.0, -0.5], [1.0, -0.5, 0.25]]
BIAS_1 = [0.1, 0.0, -0.1]
LAYER_2 = [[1.0, -1.0], [0.5, 2.0], [-0.75, 1.5]]


def dense_forward(spark: SparkSession, sf: str) -> DataFrame:
    wide = [row for _ in range(16) for row in LAYER_1]  # 64 inputs
    vec = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    out = towers.dense_forward(vec, "vec_id", "x", [(wide, BIAS_1), (LAYER_2, None)])
    return out.select(
        "vec_id", _r(F.get("vec", F.lit(0))).alias("y0"), _r(F.get("vec", F.lit(1))).alias("y1")
    )


# --- forecast ----------------------------------------------------------------


def _spread_features(features: DataFrame) -> DataFrame:
    return features.select("gap", "F_time", F.size("input").alias("width"), F.posexplode("input").alias("pos", "value"))


def forecast_features(spark: SparkSession, sf: str) -> DataFrame:
    return _spread_features(inputs.features(spark, sf))


def forecast_features_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same from cells stored by lead, of which only the wanted leads and the box are read."""
    grid = forecast.store_grid(t.forecast_grid(spark, sf), scratch_path(spark, "grid"))
    return _spread_features(forecast.forecast_features(grid))


def station_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = forecast.station_labels(t.station_readings(spark, sf))
    return labels.select("F_time", F.posexplode("label").alias("pos", "r")).select(
        "F_time", "pos", "r.StationNum", _r(F.col("r.ExMaxWindV")).alias("ExMaxWindV")
    )


def _sample_view(samples: DataFrame) -> DataFrame:
    total = F.aggregate("input", F.lit(0.0), lambda s, x: s + x)
    return samples.select(
        "gap", "F_time", F.size("input").alias("width"), _r(total, 4).alias("input_sum"),
        _r(F.element_at("input", -1)).alias("last_input"), _r(F.col("label")).alias("label"),
    )


def wx_join_valid_time(spark: SparkSession, sf: str) -> DataFrame:
    return _sample_view(forecast.samples_without_lag(inputs.features(spark, sf), inputs.labels(spark, sf)))


def wx_join_lag_issue(spark: SparkSession, sf: str) -> DataFrame:
    return _sample_view(forecast.samples_with_lag(inputs.features(spark, sf), inputs.labels(spark, sf)))


def wx_join_lag_1h(spark: SparkSession, sf: str) -> DataFrame:
    return _sample_view(forecast.samples_with_lag(inputs.features(spark, sf), inputs.labels(spark, sf), 1))


def calib_rmse(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.calibration_rmse(t.calibration(spark, sf))
    return out.select(
        "gap", "exp", _r(F.col("K2962_rmse_calibration")).alias("K2962_rmse_calibration"),
        _r(F.col("K2962_rmse_ecf")).alias("K2962_rmse_ecf"),
    )


def calib_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows per lead and repeat, the size of the experiment's output."""
    samples = forecast.samples_with_lag(inputs.features(spark, sf), inputs.labels(spark, sf), 1)
    keyed = samples.withColumn("key", F.concat("gap", "F_time"))
    repeat = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("exp")
    held = keyed.select("gap", "key", repeat).where(sampling.is_test(F.col("key"), F.col("exp"), 200))
    return held.groupBy(F.col("gap").cast("int").alias("gap"), "exp").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- aggregates and sampling -------------------------------------------------


def vocab_sizes(spark: SparkSession, sf: str) -> DataFrame:
    nce, _ = t.sim_matrix_nce(spark, sf)
    contexts = nce.agg((F.max("c_idx") + 1).alias("c_num"))
    targets = nce.agg(F.countDistinct("p_right_video_id").alias("w_num"))
    return contexts.select("c_num", targets.scalar().alias("w_num"))


def positives_per_context(spark: SparkSession, sf: str) -> DataFrame:
    lists = positives.positives_per_context(t.sim_matrix_nce(spark, sf)[0])
    return lists.select(
        "c_idx", "part", F.size("positives").alias("n"),
        F.array_join(F.transform("positives", lambda x: x.cast("string")), ",").alias("positives"),
    )


def id_index_map(spark: SparkSession, sf: str) -> DataFrame:
    return towers.id_index_map(t.sim_matrix_nce(spark, sf)[0], "left_video_id", "c_idx")


def column_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.column_counts(t.penguins(spark, sf))


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Class numbers in alphabetic order."""
    rows = t.penguins(spark, sf).select("row_id", "species")
    indexer = StringIndexer(inputCol="species", outputCol="code", stringOrderType="alphabetAsc")
    coded = indexer.fit(rows).transform(rows)
    return coded.select("row_id", "species", F.col("code").cast("int").alias("label"))


def seed_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.pick_seeds(t.watch_history(spark, sf), "user_id", "course_id", 20)


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_counts(t.table(spark, sf, "events"), "event_id")


def minibatch_sizes(spark: SparkSession, sf: str) -> DataFrame:
    epochs = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("epoch")
    rows = t.table(spark, sf, "events").select("event_id", epochs)
    return sampling.with_batch(rows, "event_id", F.col("epoch"), 16).groupBy("epoch", "batch_id").agg(
        F.count(F.lit(1)).alias("n")
    )


def rank_top100(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed linear score over all ranking rows, best hundred first."""
    rows = files.parse_ranking_lines(t.ranking_lines(spark, sf), FEATURES)
    score = sum((F.col(f"f_{k}") * F.lit(float(int(k))) for k in FEATURES), F.lit(0.0))
    return (
        rows.withColumn("prediction_score", score)
        .orderBy(F.desc("prediction_score"), "group", "relevance", *[f"f_{k}" for k in FEATURES])
        .limit(100)
        .select("group", "relevance", "f_1", "prediction_score")
    )


# --- scalar functions --------------------------------------------------------


def fn_time(spark: SparkSession, sf: str) -> DataFrame:
    obs = t.station_obs(spark, sf).select("StationNum", "ObservTimes")
    f_time = obs.withColumn("F_time", tf.station_to_forecast_time(F.col("ObservTimes")))
    utc = tf.parse_forecast_time(F.col("F_time"))
    return f_time.select(
        "StationNum", "ObservTimes", "F_time",
        tf.shift_forecast_time(F.col("F_time"), F.lit(6)).alias("F_minus_6"),
        tf.render_in_zone(utc, "Asia/Shanghai").alias("at_utc8"),
        tf.epoch_seconds(utc).alias("epoch_s"),
    )


def fn_strings(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.forecast_files(spark, sf)
    labels = tf.lead_labels()
    return rows.select(
        "event_id",
        F.regexp_replace(F.concat(F.element_at(F.split("file_name", r"\."), 1), F.lit("_")), "_$", "").alias("kind"),
        F.concat_ws(".", F.slice(F.split("file_name", r"\."), 2, 3)).alias("middle"),
        F.get(labels, (F.col("event_id") % 24).cast("int")).alias("lead_label"),
        F.get(F.split(F.concat(F.lit("qid:"), F.col("event_id")), ":"), F.lit(1)).alias("token"),
    )


def fn_wind_uv(spark: SparkSession, sf: str) -> DataFrame:
    uv = forecast.wind_components(t.station_obs(spark, sf))
    return uv.select("StationNum", "ObservTimes", _r(F.col("u10")).alias("u10"), _r(F.col("v10")).alias("v10"))


def fn_math(spark: SparkSession, sf: str) -> DataFrame:
    x = F.get("embedding", F.lit(0)).cast("double")
    return t.table(spark, sf, "embeddings").select(
        "vec_id",
        _r(F.sqrt(F.abs(x))).alias("root"),
        v.relu(x).alias("relu"),
        _r(x / 255.0, 9).alias("scaled"),
    )


def fn_softmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "embeddings").select("vec_id", v.as_double(F.col("embedding")).alias("z"))
    first = F.get("z", F.lit(0))
    return rows.select(
        "vec_id", F.posexplode(v.softmax(F.col("z"))).alias("class", "p"),
        v.sigmoid(first).alias("s"), (-v.softplus(-first)).alias("ls"),
    ).select("vec_id", "class", _r(F.col("p")).alias("p"), _r(F.col("s")).alias("sigmoid"), _r(F.col("ls")).alias("log_sigmoid"))


def fn_arrays(spark: SparkSession, sf: str) -> DataFrame:
    wide = v.as_double(F.col("embedding"))
    rows = t.table(spark, sf, "embeddings").select("vec_id", wide.alias("e"))
    repeated = F.array_repeat(F.element_at("e", forecast.NEAREST_CELL + 1), 3)
    joined = F.flatten(F.array(F.slice("e", 1, 2), repeated, F.slice("e", -1, 1)))
    return rows.select("vec_id", F.posexplode(joined).alias("pos", "value"))


def fn_dot(spark: SparkSession, sf: str) -> DataFrame:
    wide = v.as_double(F.col("embedding"))
    rows = t.table(spark, sf, "embeddings").select(
        "vec_id", F.slice(wide, 1, 32).alias("a"), F.slice(wide, 33, 32).alias("b")
    )
    return rows.select("vec_id", _r(v.dot(F.col("a"), F.col("b"), 32)).alias("ip"))


def fn_endpoint_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Row means of each vector and, per label, column means over its end rows."""
    wide = v.as_double(F.col("embedding"))
    rows = t.table(spark, sf, "embeddings").select("vec_id", "label", wide.alias("e"))
    by_row = rows.select(
        F.lit("row").alias("axis"), F.col("vec_id").alias("key"), F.lit(0).alias("pos"),
        v.endpoint_mean(F.col("e")).alias("m"),
    )
    ends = rows.groupBy("label").agg(
        F.min_by("e", "vec_id").alias("first"), F.max_by("e", "vec_id").alias("last")
    )
    mean = F.zip_with("first", "last", lambda a, b: (a + b) * F.lit(0.5))
    by_column = ends.select(
        F.lit("column").alias("axis"), F.col("label").cast("long").alias("key"),
        F.posexplode(mean).alias("pos", "m"),
    )
    return by_row.unionByName(by_column).select("axis", "key", "pos", _r(F.col("m")).alias("m"))


# --- metrics and trees -------------------------------------------------------


def ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ndcg(inputs.scored_ranking(spark, sf)).select("group", _r(F.col("ndcg")).alias("ndcg"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.get("embedding", F.lit(1)).cast("double")
    return t.table(spark, sf, "embeddings").select(
        (F.col("label") % 2).alias("label"), (x * 5).alias("logit"),
        F.when(x > 0, 1).otherwise(0).alias("prediction"),
    )


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracy(_predictions(spark, sf), "prediction", "label").select(
        _r(F.col("accuracy")).alias("accuracy"), "n"
    )


def logloss(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.logloss(F.col("logit"), F.col("label"))
    return _predictions(spark, sf).agg(_r(F.avg(loss)).alias("logloss"))


def mse_rmse(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.abalone(spark, sf).withColumn("prediction", F.col("LongestShell") * F.lit(0.5) + F.lit(2.0))
    return metrics.mse_rmse(rows, "prediction", "Rings").select(
        _r(F.col("mse")).alias("mse"), _r(F.col("rmse")).alias("rmse")
    )


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    logit = v.dot(F.col("embedding_query"), F.col("context"), 32) * 4
    return t.sort_sample(spark, sf).select("sample_id", "weight", "label", logit.alias("logit"))


def weighted_logloss(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.weighted_logloss(F.col("logit"), F.col("label"), F.col("weight"))
    return _weighted(spark, sf).select("sample_id", _r(loss).alias("loss"))


def epoch_loss_report(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.logloss(F.col("logit"), F.col("label"))
    rows = _weighted(spark, sf).select(
        "sample_id", loss.alias("loss"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("epoch")
    )
    batched = sampling.with_batch(rows, "sample_id", F.col("epoch"), 16)
    return metrics.epoch_loss(batched).select("epoch", _r(F.col("loss")).alias("loss"), "batches")


def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = metrics.learning_curve(t.vote_table(spark, sf), 3)
    return curve.select(
        "trees", _r(F.col("accuracy")).alias("accuracy"), _r(F.col("logloss")).alias("logloss")
    )


def tree_score(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_score(t.tree_inputs(spark, sf))


def tree_inorder(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_inorder(t.tree_nodes(spark, sf))


def tree_inorder_deep(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_inorder(t.order_chains(spark, sf))


def tree_feature_use(spark: SparkSession, sf: str) -> DataFrame:
    return trees.feature_use(t.tree_nodes(spark, sf))
