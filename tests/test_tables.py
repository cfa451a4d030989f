"""Roles, sources, samples, preparation, learning and streaming."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwake.learning import dictionary
from modelwake.learning.importance import individual_expectation, partial_dependence, permutation_importance, tree_importance
from modelwake.learning.pipeline import TabularModel, boosted_classifier, boosted_trees, forest_regression, numeric_scaling
from modelwake.operators import prepare, sampling
from modelwake.roles import TASKS, ColumnRoles, SemanticType, TaskType
from modelwake.session import bounded_broadcast
from modelwake.sources import files, versions
from modelwake.streaming import monitor, panes

TYPES = {
    "id": SemanticType.CATEGORICAL,
    "timestamp": SemanticType.TIMESTAMP,
    "feature1": SemanticType.NUMERICAL,
    "feature2": SemanticType.CATEGORICAL,
    "target": SemanticType.CATEGORICAL,
}
ROLES = ColumnRoles(TYPES, ("id", "timestamp"), "target")


@pytest.fixture
def hundred(frame):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(days=i), (i * 37 % 100) / 10.0 if i % 9 else None, "ABC"[i % 3], int(i * 37 % 100 > 50)) for i in range(100)]
    return frame(rows, "id long, timestamp timestamp_ntz, feature1 double, feature2 string, target int")


def test_roles(hundred):
    assert ROLES.features == ["feature1", "feature2"]
    assert (ROLES.numerical, ROLES.categorical, ROLES.timestamps) == (["feature1"], ["feature2"], [])
    assert (ROLES.id_column, ROLES.timestamp_column) == ("id", "timestamp")
    assert ROLES.project(hundred).columns == ["feature1", "feature2", "target"]
    assert ROLES.project(hundred.drop("target")).columns == ["feature1", "feature2"]
    with pytest.raises(KeyError):
        ROLES.project(hundred.drop("feature1"))
    with pytest.raises(KeyError):
        ColumnRoles(TYPES, ("nothing",), "target")
    assert TASKS["user-churn"].target == "churn"


def test_errors_by_task(frame):
    df = frame([(1.0, 1.5), (2.0, 2.0)], "target double, prediction double")
    assert [r.error for r in prepare.append_error(df, ROLES, TaskType.REGRESSION).collect()] == [0.5, 0.0]
    assert [r.error for r in prepare.append_error(df, ROLES, TaskType.BINARY).collect()] == [True, False]
    with pytest.raises(ValueError):
        prepare.append_error(df, ROLES, "ranking")
    with pytest.raises(ValueError):
        prepare.append_error(df.drop("target"), ROLES, TaskType.BINARY)


def test_csv_with_time_column_and_lower_case(spark, tmp_path):
    path = str(tmp_path / "bikes.csv")
    with open(path, "w") as out:
        out.write("TS,Cnt,Charges\n2011-01-01 01:00:00,4,1.5\n2011-01-01 02:00:00,5, \n")
    schema = T.StructType([T.StructField("TS", T.TimestampNTZType()), T.StructField("Cnt", T.IntegerType()), T.StructField("Charges", T.StringType())])
    df = files.read_time_csv(spark, path, schema)
    assert df.first().TS == datetime(2011, 1, 1, 1) and dict(df.dtypes)["TS"] == "timestamp_ntz"
    lower = files.read_lower_csv(spark, path)
    assert lower.columns == ["ts", "cnt", "charges"]
    assert [r.charges for r in prepare.coerce(lower, ["charges"], ["cnt"]).collect()] == [1.5, None]


def test_splits_round_trip(spark, hundred, tmp_path):
    folder = files.split_folder(str(tmp_path), "shop", "churn", {"year": 2024, "subsample": 0})
    assert folder != files.split_folder(str(tmp_path), "shop", "churn", {"year": 2024, "subsample": 5})
    assert files.read_splits(spark, folder) is None
    split = hundred.withColumn("split", F.when(F.col("id") < 60, "train").when(F.col("id") < 80, "val").otherwise("test"))
    files.write_splits(split, folder)
    assert {s: d.count() for s, d in files.read_splits(spark, folder).items()} == {"train": 60, "val": 20, "test": 20}
    # An empty split is a stored one; a write that did not end is none.
    files.write_splits(split.where("split = 'train'"), folder)
    assert {s: d.count() for s, d in files.read_splits(spark, folder).items()} == {"train": 60, "val": 0, "test": 0}
    torn = files.split_folder(str(tmp_path), "shop", "churn", {"year": 2025})
    split.write.partitionBy("split").parquet(torn)
    assert files.read_splits(spark, torn) is None
    nothing = files.split_folder(str(tmp_path), "shop", "churn", {"year": 2026})
    files.write_splits(split.limit(0), nothing)
    assert {s: d.columns for s, d in files.read_splits(spark, nothing).items()} == dict.fromkeys(files.SPLITS, hundred.columns)
    files.write_splits(split, folder)
    files.write_csv_splits(files.read_splits(spark, folder), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv" / "val"), header=True).count() == 20


def test_stored_tables(spark, hundred, tmp_path):
    assert files.create_or_replace(hundred, "stored_hundred").count() == 100
    assert files.create_or_replace(hundred.limit(7), "stored_hundred").count() == 7
    # A query that has begun keeps its version; the table may be read by what replaces it.
    before = spark.table("stored_hundred")
    assert files.create_or_replace(before.unionByName(hundred), "stored_hundred", ["feature2"]).count() == 107
    assert before.count() == 7 and spark.table("stored_hundred").where("feature2 = 'A'").count() > 30
    spark.sql("CREATE TABLE plain_one USING parquet AS SELECT 1 AS a")
    assert files.create_or_replace(hundred, "plain_one").count() == 100
    files.ingest({"a": hundred}, str(tmp_path))
    files.write_by_month(hundred, "timestamp", str(tmp_path / "months"))
    february = spark.read.parquet(str(tmp_path / "months")).where("month = '2024-02'")
    assert february.count() == 29 and "PartitionFilters: [isnotnull(month" in february._jdf.queryExecution().executedPlan().toString()
    files.write_scored(hundred, hundred.limit(3), str(tmp_path / "scored"))
    assert spark.read.parquet(str(tmp_path / "scored" / "current")).count() == 3


def test_json_reports(spark, hundred, tmp_path):
    nested = hundred.select("id", F.struct("timestamp", "feature1").alias("r"))
    files.write_json_report(nested, str(tmp_path / "r"))
    schema = "id long, r struct<timestamp: timestamp_ntz, feature1: double>"
    assert files.read_json_report(spark, str(tmp_path / "r"), schema).where("id = 3").first().r.timestamp == datetime(2024, 1, 4)
    text = files.as_json(nested)
    assert '"timestamp":"2024-01-04T00:00:00.000000"' in {r.report for r in text.collect() if '"id":3,' in r.report}.pop()
    parsed = files.parse_json(text, "report", f"struct<{schema.replace('id long', 'id: long').replace('r struct', 'r: struct')}>", ["r"])
    assert parsed.schema["report"].dataType.fieldNames() == ["id"]


def test_samples_repeat_under_repartition(hundred):
    first = {r.id for r in sampling.hash_sample(hundred, ["id"], 20, 1).collect()}
    assert first == {r.id for r in sampling.hash_sample(hundred.repartition(7), ["id"], 20, 1).collect()}
    assert len(first) == 20 and first != {r.id for r in sampling.hash_sample(hundred, ["id"], 20, 2).collect()}
    assert sampling.hash_sample(hundred, ["id"], 500).count() == 100
    shares = sampling.hash_split(hundred, ["id"]).groupBy("split").count().collect()
    assert {r.split for r in shares} == {"train", "test"}


def test_corruption(spark):
    df = spark.range(4000).select("id", (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 5).cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("y"))
    noisy = sampling.add_noise(df, ["id"], ["x"], seed=1).join(df.withColumnRenamed("x", "x0").select("id", "x0"), "id")
    row = noisy.agg(F.avg(F.col("x") - F.col("x0")).alias("m"), F.stddev_samp(F.col("x") - F.col("x0")).alias("s"), F.stddev_samp("x0").alias("s0")).first()
    assert abs(row.m) < 0.15 and row.s / row.s0 == pytest.approx(0.5, abs=0.03)

    shuffled = sampling.shuffle_values(df, ["id"], "c", seed=2)
    assert sorted(r.c for r in shuffled.collect()) == sorted(r.c for r in df.collect())
    moved = shuffled.join(df.select("id", F.col("c").alias("c0")), "id").where("c <> c0").count()
    assert moved / 4000 == pytest.approx(0.3 * 0.8, abs=0.04)

    flipped = sampling.flip_labels(df, ["id"], "y", seed=3).join(df.select("id", F.col("y").alias("y0")), "id").where("y <> y0").count()
    assert flipped / 4000 == pytest.approx(0.15, abs=0.03)
    assert sampling.corrupt(df, ["id"], ["x"], ["c"], "y").count() == 4000


def test_alignment_and_labels(frame):
    train, test = frame([("a",), ("b",), (None,)], "c string"), frame([("a",), ("z",), (None,)], "c string")
    assert sorted(str(r.c) for r in prepare.align_categories(train, test, ["c"]).collect()) == ["None", "None", "a"]
    assert [r.c for r in prepare.yes_no_label(frame([("Yes",), ("No",), (None,)], "c string"), "c").collect()] == [1, 0, 0]


def test_scaling_ignores_gaps(frame):
    df = frame([(1.0, None), (None, None), (3.0, None), (8.0, None)], "a double, b double")
    median, mean, deviation = numeric_scaling(df, ["a", "b"], 4)["a"]
    assert (median, mean) == (3.0, 3.75) and deviation == pytest.approx(2.5860201)
    assert numeric_scaling(df, ["a", "b"], 4)["b"] == (0.0, 0.0, 1.0)


def test_tabular_model_round_trip(hundred, tmp_path):
    estimator = boosted_trees(TaskType.BINARY, "target", "prediction", maxIter=3, maxDepth=2)
    train, test = hundred.where("id < 60"), hundred.where("id >= 60").withColumn("feature2", F.lit("unseen"))
    model = TabularModel(ROLES, TaskType.BINARY).fit(train, estimator)
    scored = model.predict_with_error(test)
    assert scored.columns == [*hundred.columns, "prediction", "error"] and scored.count() == 40
    values = {r.metric: r.value for r in model.evaluate(test).collect()}
    assert set(values) == {"accuracy", "precision", "recall", "f1"} and all(0 <= v <= 1 for v in values.values())
    model.save(str(tmp_path / "model"))
    loaded = TabularModel.load(str(tmp_path / "model"))
    assert loaded.predict(test).select("id", "prediction").collect() == model.predict(test).select("id", "prediction").collect()
    assert loaded.roles == model.roles and model.record.n_rows == 60
    with pytest.raises(ValueError):
        model.fit(train.drop("target"))
    with pytest.raises(ValueError):
        boosted_trees("ranking", "y", "p")
    with pytest.raises(ValueError):
        TabularModel(ColumnRoles({"id": SemanticType.NUMERICAL}, ("id",), "target"), TaskType.BINARY).fit(train.select("id", "target"))


def test_forest_and_its_explanations(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("noise"), (F.col("id") % 20 * 2.0).alias("y"))
    with pytest.raises(ValueError):
        forest_regression(df, [], [], "y")
    model = forest_regression(df, ["x", "noise"], [], "y", trees=5)
    importance = {r.feature: r.importance for r in tree_importance(model, ["x", "noise"], spark).collect()}
    assert importance["x"] > 0.9
    growth = {r.feature: r.importance for r in permutation_importance(model, df, ["id"], ["x", "noise"], "y", "prediction").collect()}
    assert growth["x"] > 10 * max(growth["noise"], 0.1)
    curve = [r.mean_prediction for r in partial_dependence(model, df, "x", [0, 10, 19], "prediction").orderBy("grid_value").collect()]
    assert curve[0] < curve[1] < curve[2]
    assert individual_expectation(model, df, ["id"], "x", [0, 19], "prediction").count() == 800


def test_permutation_importance_numbers_the_rows_once(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "if(id % 7 = 0, null, id % 20 * 1.0D) AS x", "id % 3 * 1.0D AS noise", "id % 20 * 2.0D AS y")
    beside = sampling.shuffled_beside(df, ["id"], ["x", "noise"], seed=4)
    for i, c in enumerate(["x", "noise"]):
        alone = sampling.shuffle_values(df, ["id"], c, share=1.0, seed=4 + i)
        assert sorted(map(str, beside.select("id", f"_new_{i}").collect())) == sorted(str(r).replace(f"{c}=", f"_new_{i}=") for r in alone.select("id", c).collect())
    filled = df.fillna(0.0)
    model = forest_regression(filled, ["x", "noise"], [], "y", trees=3)
    base = model.transform(filled).selectExpr("avg(pow(prediction - y, 2))").first()[0]
    ranked, rank = [], sampling.global_rank
    monkeypatch.setattr(sampling, "global_rank", lambda df, order, name: (ranked.append(order), rank(df, order, name))[1])
    rows = permutation_importance(model, filled, ["id"], ["x", "noise"], "y", "prediction").collect()
    assert [r.feature for r in rows] == ["x", "noise"] and ranked.count(["id"]) == 1 and len(ranked) == 3
    for i, r in enumerate(rows):
        shuffled = model.transform(sampling.shuffle_values(filled, ["id"], r.feature, share=1.0, seed=i))
        assert abs(r.mse - shuffled.selectExpr("avg(pow(prediction - y, 2))").first()[0]) < 1e-9 and abs(r.base_mse - base) < 1e-9


def test_boosted_classifier(spark):
    df = spark.range(300).select("id", (F.col("id") % 30).cast("double").alias("x"), (F.col("id") % 4).cast("string").alias("c"), (F.col("id") % 30 > 14).cast("int").alias("y"))
    model = boosted_classifier(df.where("id < 200"), df.where("id >= 200"), ["x"], ["c"], "y", rounds=5)
    assert model.transform(df).where("prediction = y").count() > 280


def test_broadcast_needs_a_bound(frame):
    df = frame([(1,)], "a int")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(bounded_broadcast(df, 10)) and not hinted(bounded_broadcast(df, 10**7))


def test_stream_equals_batch(spark, frame, tmp_path):
    from modelwake.streaming import monitor

    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=10 * i), float(i % 7), i % 7 + (i % 3) / 4) for i in range(900)]
    df = frame(rows, "ts timestamp_ntz, y double, p double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stats = monitor.ReferenceStats.of(df, "y", "p")
    for slide in (None, "12 hours"):
        stream = monitor.read_events(spark, str(tmp_path / "in"), "ts timestamp_ntz, y double, p double")
        out, state = str(tmp_path / f"out{slide}"), str(tmp_path / f"state{slide}")
        monitor.run_to_table(monitor.windowed_metrics(stream, "ts", "y", "p", stats, "1 day", slide), out, state)
        got = {r.window_start: r for r in spark.read.parquet(out).collect()}
        batch = {r.window_start: r for r in monitor.windowed_metrics(df, "ts", "y", "p", stats, "1 day", slide).collect()}
        last = max(r[0] for r in rows) - timedelta(hours=1)
        assert set(got) == {s for s, r in batch.items() if r.window_end <= last}
        for s, r in got.items():
            assert list(r)[:2] == list(batch[s])[:2] and list(r)[2:] == pytest.approx(list(batch[s])[2:])


def test_versions_are_replaced_at_one_stroke(spark, hundred, tmp_path):
    root = str(tmp_path / "table")
    assert versions.current(spark, root) is None
    first = versions.publish(hundred, root, {"load": 1})
    old = first.read(spark)
    versions.publish(old.limit(5), root, {"load": 2})
    # A writer that dies before the pointer moves changes nothing.
    hundred.write.parquet(f"{root}/version-unfinished")
    now = versions.current(spark, root)
    assert now.notes == {"load": 2} and now.read(spark).count() == 5 and old.count() == 100
    assert now.read(spark).schema == hundred.schema
    versions.publish(hundred, root)
    assert not os.path.exists(first.folder) and os.path.exists(now.folder)


def panes_of(spark, df, tmp_path, y="y", p="p"):
    base = panes.Reference.of(df.limit(400), y, p, 400)
    schema = "ts timestamp_ntz, y double, p double"
    stream = monitor.read_events(spark, str(tmp_path / "in"), schema)
    return base, panes.paned(stream, "ts", y, p, base)


def test_stream_restarts_without_double_rows(spark, frame, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=10 * i), float(i % 7) if i % 50 else None, i % 7 + (i % 3) / 4) for i in range(1200)]
    df = frame(rows, "ts timestamp_ntz, y double, p double").cache()
    root, state = str(tmp_path / "panes"), str(tmp_path / "state")
    for low, high in ((0, 500), (500, 900), (900, 1200)):
        df.where(f"ts >= '{rows[low][0]}' AND ts <= '{rows[high - 1][0]}'").write.mode("append").parquet(str(tmp_path / "in"))
        base, cells = panes_of(spark, df, tmp_path)
        stored = panes.run_panes(cells, root, state)
        assert stored.agg(F.sum("n")).first()[0] == high
    batch = panes.paned(df, "ts", "y", "p", base)
    key = lambda r: [str(x) for x in r[:3]]
    got, want = sorted(stored.collect(), key=key), sorted(batch.collect(), key=key)
    assert len(got) == len(want) and all(list(a)[:5] == list(b)[:5] and list(a)[5:] == pytest.approx(list(b)[5:]) for a, b in zip(got, want, strict=True))
    # A batch that comes again is known by its number, and has no effect.
    number = versions.current(spark, root).notes["batch"]
    panes.upsert_panes(batch, number, root)
    assert panes.stored_panes(spark, root, batch.schema).agg(F.sum("n")).first()[0] == 1200
    # A later batch replaces the panes it has and leaves the others.
    day = batch.where("pane = '2024-01-02'").withColumn("n", F.lit(1).cast("long"))
    panes.upsert_panes(day, number + 1, root)
    panes.upsert_panes(day, number + 1, root)
    assert panes.stored_panes(spark, root, batch.schema).agg(F.sum("n")).first()[0] == 1200 - 144 + day.count()
    assert panes.stored_panes(spark, str(tmp_path / "none"), batch.schema).count() == 0


def test_windows_of_panes_equal_windows_of_rows(spark, frame):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=25 * i), 1e6 + i % 11, 1e6 + i % 11 + (i % 5) * i / 400) for i in range(900)]
    df = frame(rows, "ts timestamp_ntz, y double, p double")
    reference = df.limit(300)
    base = panes.Reference.of(reference, "y", "p", 300)
    assert sum(base.shares[0]) == pytest.approx(1) and len(base.edges[0]) + 1 == len(base.shares[0]) <= panes.CLASSES
    stats = monitor.ReferenceStats.of(reference, "y", "p")
    for days in (1, 5):
        view = {r.window_start: r for r in panes.window_view(panes.paned(df, "ts", "y", "p", base), base, days).collect()}
        rows_view = monitor.windowed_metrics(df, "ts", "y", "p", stats, f"{days} days", "1 day").collect()
        assert set(view) == {r.window_start for r in rows_view}
        for r in rows_view:
            v = view[r.window_start]
            assert (v.window_end, v.n_rows) == (r.window_end, r.n_rows)
            for c in ("r2_score", "rmse", "mean_error", "target_shift", "prediction_shift"):
                assert v[c] == pytest.approx(r[c], rel=1e-6, abs=1e-9)
        late = view[max(view)]
        assert late.is_critical and "prediction" in late.drifted


def test_drift_of_classes(frame):
    base = panes.Reference((0.0, 0.0), (1.0, 1.0), ((0.0,), (0.0, 1.0)), ((0.5, 0.5), (0.4, 0.6, 0.0)))
    start = datetime(2024, 1, 1)
    rows = [(start, i % 2 or -1.0, 0.5 if i % 5 < 3 else -1.0) for i in range(100)]
    rows += [(start + timedelta(days=1), 1.0 if i < 60 else -1.0, 5.0 if i == 0 else -1.0) for i in range(100)]
    df = frame([(t, float(y), p) for t, y, p in rows], "ts timestamp_ntz, y double, p double")
    first, second = panes.window_view(panes.paned(df, "ts", "y", "p", base), base, 1).orderBy("window_start").collect()
    assert (first.target_statistic, first.target_p_value, first.prediction_statistic) == (0.0, 1.0, pytest.approx(0.0, abs=1e-9))
    assert first.drifted == [] and second.drifted == ["prediction", "target"]
    assert second.target_statistic == pytest.approx(4.0) and second.target_p_value == pytest.approx(0.0455, abs=1e-4)
    assert second.prediction_p_value == 0.0
    assert panes.window_view(panes.paned(df.limit(0), "ts", "y", "p", base), base, 3).count() == 0


def test_dictionary_of_many_values(spark):
    df = spark.range(300_000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("wide"), (F.col("id") % 3).alias("narrow"))
    known = dictionary.fit_dictionary(df.unionByName(df), ["wide", "narrow"])
    assert known.where("feature = 'wide' AND index <> cast(substr(value, 2) as long)").count() == 0
    assert known.count() == 300_003 and known.where("feature = 'narrow'").orderBy("index").first().value == "0"
    unseen = spark.createDataFrame([("v0000005", 1), ("nothing", None)], "wide string, narrow long")
    rows = {r.wide: r for r in dictionary.one_hot(dictionary.encode(unseen, known, ["wide", "narrow"]), known, ["narrow"]).collect()}
    assert (rows["v0000005"].wide_index, rows["v0000005"].narrow_hot) == (5, [0, 1, 0])
    assert (rows["nothing"].wide_index, rows["nothing"].narrow_index, rows["nothing"].narrow_hot) == (300_000, 3, [0, 0, 0])
    with pytest.raises(ValueError):
        dictionary.one_hot(unseen, known, ["wide"])
    nothing = dictionary.fit_dictionary(df.limit(0), ["wide"])
    assert {r.wide_index for r in dictionary.encode(unseen, nothing, ["wide"]).collect()} == {0}


def test_means_of_a_random_category_tell_nothing(spark):
    df = spark.range(6000).select("id", F.xxhash64("id").alias("random"), (F.col("id") % 4).alias("real"), F.when(F.col("id") % 50 != 0, (F.col("id") % 4 == 0).cast("int")).alias("y"))
    got = dictionary.out_of_fold_means(df, ["id"], ["random", "real"], "y").cache()
    assert got.columns == [*df.columns, "random_mean", "real_mean"] and got.count() == 6000
    # A category of one row has the prior of the other folds only, so at most one value per fold.
    assert got.select("random_mean").distinct().count() <= 5
    assert abs(got.agg(F.corr("random_mean", "y")).first()[0]) < 0.1 and got.agg(F.corr("real_mean", "y")).first()[0] > 0.95
    means = dictionary.fit_target_means(df, ["real"], "y", weight=1.0)
    new = dictionary.apply_target_means(spark.createDataFrame([(0,), (9,), (None,)], "real long"), means, ["real"])
    prior = df.agg(F.avg("y")).first()[0]
    values = {r.real: r.real_mean for r in new.collect()}
    assert values[0] > 0.99 and values[9] == values[None] == pytest.approx(prior)


def test_training_rows_are_dealt_out_in_bounded_tasks(spark, monkeypatch):
    from modelwake.learning import pipeline

    monkeypatch.setattr(pipeline, "TRAINING_ROWS", 50)
    df = spark.range(0, 2000, 1, 1).selectExpr("id", "id % 5 AS x", "1.0D AS y")
    dealt = pipeline.dealt_rows(df, ["x", "y"])
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert dealt.columns == ["x", "y"] and sum(sizes) == 2000 and len(sizes) == 40 and max(sizes) < 100
