"""Cases that reviews found: ties, zero scores, and long groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assign, metrics
from tessera.operators.tracking import Kalman
from tessera.queries import ORACLES, QUERIES

from .oracle import connection, same


def events(spark, folder, rows):
    """A folder with a table of events; rows: (event_id, user_id)."""
    import datetime

    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(e, at, u, "view", 1.0, "{}") for e, u in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def twin(folder, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return c.sql(ORACLES[name]).df()


def test_result_rows_of_equal_scores_in_an_image(spark, tmp_path):
    sf = events(spark, tmp_path, [(i + 100003 * k, 7) for i in (1, 4, 5) for k in (0, 3, 6)])  # scores repeat after 100003 ids
    got = QUERIES["coco_result_rows"](spark, sf).toPandas()
    assert len(got) == len(set(got["det_id"])) == 9
    same(got, twin(sf, "coco_result_rows"))


def test_a_score_of_zero_is_kept(spark, tmp_path):
    sf = events(spark, tmp_path, [(100003, 7), (1, 7), (2, 7)])  # the first has score 0
    got = QUERIES["greedy_suppression"](spark, sf).toPandas()
    assert 100003 in set(got["det_id"])
    same(got, twin(sf, "greedy_suppression"))


def test_runs_are_not_sent_through_the_driver(spark):
    from tessera.operators import runs as RL

    r = spark.range(3).selectExpr("id AS image_id", "id AS mask_id", "10L AS start", "20L AS end")
    for x in (RL.common(r, r.withColumnRenamed("mask_id", "other")), RL.on_top(r, [F.col("mask_id")], ["mask_id"])):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_of_boxes_are_walked_in_batches(spark, tmp_path):
    """A call for each image and class costs milliseconds, so plans over many small groups must not have one."""
    sf = events(spark, tmp_path, [(i, i % 40) for i in range(400)])
    for name in ("weighted_fusion", "map_imagenet", "jaccard_index"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan, name
        assert "MapInArrow" in plan, name


def test_states_of_many_tracks_move_as_those_of_one():
    k, r = Kalman(), np.random.default_rng(1)
    one = [k.start(np.array([*r.uniform(0, 90, 2), 0.5, r.uniform(20, 60)])) for _ in range(5)]
    m, c = (np.array(v) for v in zip(*[k.predict(*s) for s in one], strict=True))
    zs, sure = m[:, :4] + r.normal(0, 1, (5, 4)), r.uniform(0, 1, (5, 1))
    far, (um, uc) = k.gate(m, c, zs), k.update(m, c, zs, sure)
    for i, s in enumerate(one):
        a, b = k.predict(*s)
        assert (a == m[i]).all() and (b == c[i]).all()
        assert np.allclose(far[i], k.gate(a, b, zs), rtol=1e-12)
        assert all(np.allclose(x, y, rtol=1e-12) for x, y in zip(k.update(a, b, zs[i], sure[i, 0]), (um[i], uc[i]), strict=True))


def test_small_and_large_assignments_agree():
    for seed in range(60):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 7))
        a = r.integers(0, 4, (n, n + int(r.integers(0, 4)))).astype(float)  # many ties
        assert (assign._paths(a) == assign._paths_of_few(a)).all()


def test_videos_are_not_merged_into_one_task(spark, tmp_path):
    sf = events(spark, tmp_path, [(i, i % 40) for i in range(400)])
    rows = QUERIES["track_videos"](spark, sf).select("video_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in rows}) > 1


def test_no_pair_of_vectors_is_shuffled(spark):
    """What ``reid`` shuffles are its rows: the gallery does not go to each block of queries, and no pair leaves its task."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist(), None if i % 50 == 7 else int(i % 3)) for i in range(300)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    r = metrics.reid(x, block=16)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
    v, labels, aps = np.array([v for _, v, _ in rows]), [c for _, _, c in rows], []
    for q in (i for i, c in enumerate(labels) if c is not None):
        order = sorted((i for i in range(300) if i != q), key=lambda i: ((v[i] - v[q]) ** 2).sum())
        hits = [k + 1 for k, i in enumerate(order) if labels[i] == labels[q]]
        aps.append(np.mean([(k + 1) / h for k, h in enumerate(hits)]))
    assert abs(r.first().map - np.mean(aps)) < 6e-4
    far = x.withColumn("embedding", F.transform("embedding", lambda e: e + 1e6))  # large numbers: distances by differences
    assert abs(metrics.reid(far, block=16).first().map - np.mean(aps)) < 2e-3


def plain_reid(ids, v, labels):
    """ap and the place of the first positive of each query; at equal distances rows of its label come first."""
    out = {}
    for q in range(len(ids)):
        d = ((v - v[q]) ** 2).sum(1).round(9)
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (d[i], labels[i] != labels[q]))
        hits = [k + 1 for k, i in enumerate(order) if labels[i] == labels[q]]
        if hits:
            out[q] = float(np.mean([(k + 1) / h for k, h in enumerate(hits)])), hits[0]
    return out


def test_distances_are_counted_not_sorted_if_that_decides(spark, monkeypatch):
    """No row is put in order, as the bounds of the mean round to one number; rows have copies."""

    def sorts(kind):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    raise RuntimeError("distances are sorted")
            yield from ()

        return run

    monkeypatch.setattr(metrics, "_places", sorts)
    rng = np.random.default_rng(10)
    v = np.repeat(rng.normal(size=(60, 5)).astype(np.float32), 3, axis=0)
    labels = np.repeat(rng.integers(0, 3, 60), 3).tolist()
    want = plain_reid(range(180), v.astype(float), labels)
    x = spark.createDataFrame([(i, v[i].tolist(), labels[i]) for i in range(180)], "vec_id long, embedding array<float>, label int")
    r = metrics.reid(x.repartition(3), block=16).first()
    assert abs(r.map - np.mean([a for a, _ in want.values()])) < 6e-4
    assert [r[f"r{k}"] for k in (1, 5, 10)] == [pytest.approx(np.mean([f <= k for _, f in want.values()]), abs=6e-4) for k in (1, 5, 10)]


@pytest.mark.parametrize("cells", [64, 1 << 12])
def test_bounds_of_a_query_enclose_its_ap(monkeypatch, cells):
    monkeypatch.setattr(metrics, "CELLS", cells)
    monkeypatch.setattr(metrics, "COUNTED", 50)
    monkeypatch.setattr(metrics, "TILE", (4, 16))
    rng = np.random.default_rng(11)
    v, labels = np.repeat(rng.normal(size=(90, 6)), 2, axis=0), rng.integers(0, 3, 180)
    want = plain_reid(range(180), v, labels.tolist())
    queries = np.flatnonzero(labels == 1)
    b = metrics._Counted(queries, v[queries], float((v**2).sum(1).max()), 10)
    for at in range(0, 180, 7):
        ids = np.arange(at, min(at + 7, 180))
        for own in (True, False):
            some = ids[(labels[ids] == 1) == own]
            b.add(own, some, v[some])
    got = b.bounds().to_pydict()
    for q, lo, hi, first in zip(queries, got["lo"], got["hi"], got["first"], strict=True):
        assert lo - 1e-12 <= want[q][0] <= hi + 1e-12 and min(first, 11) == min(want[q][1], 11)
    if cells > 64:
        assert np.mean(got["hi"]) - np.mean(got["lo"]) < 0.02


def test_masks_of_an_image_are_fused_in_one_pass(spark):
    """One shuffle of the runs by image and no call for each image; void fills what neither things nor stuff cover."""
    from tessera.operators import runs as RL

    things = spark.createDataFrame([(1, 10, 0, 0.9, 5, 20), (1, 11, 1, 0.8, 10, 40), (1, 12, 1, 0.7, 6, 19)], "image_id long, mask_id long, label int, score double, start long, end long")
    stuff = spark.createDataFrame([(1, 3, 30, 60), (1, 4, 60, 63)], "image_id long, label int, start long, end long")
    sizes = spark.createDataFrame([(1, 100, 10), (2, 50, 10)], "image_id long, size long, height long")
    x = RL.fuse_panoptic(things, stuff, sizes, least_stuff=10, fill=True)
    want = {(1, 255, 0, 5), (1, 1000, 5, 20), (1, 2001, 20, 40), (1, 3, 40, 60), (1, 255, 60, 100), (2, 255, 0, 50)}
    parts = things.withColumn("p", F.lit(0.9))
    for y in (x, RL.fuse_queries(parts, sizes, things=3)):
        plan = y._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "FlatMapGroups" not in plan and "Window" not in plan
    assert {tuple(r) for r in x.collect()} == want


def test_stacked_runs_show_what_is_on_top(spark):
    from tessera.operators import runs as RL

    rng = np.random.default_rng(4)
    rows = [(int(i), m, int(a), int(a + n)) for m, (i, a, n) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 3000, 60), rng.integers(1, 900, 60), strict=True))]
    r = spark.createDataFrame(rows, "image_id long, mask_id long, start long, end long")

    def positions(x):
        return sorted((v.image_id, p, v.mask_id) for v in x.collect() for p in range(v.start, v.end))

    assert positions(RL.stacked(r, [F.col("mask_id") % 7, F.col("mask_id")], ["mask_id"])) == positions(RL.on_top(r, [F.col("mask_id") % 7, F.col("mask_id")], ["mask_id"]))


def test_a_caption_is_cut_once_for_all_spans(spark):
    from tessera.plans.convert import phrases_of

    x = spark.createDataFrame([([[6, 9], [3, 5], [12, 14], [4, 5]], "ab cd efg hi jk")], "s array<array<int>>, c string").select(phrases_of(F.col("s"), F.col("c")).alias("p"))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(c#") <= 1  # for each span the caption would be passed from its start
    assert x.first().p == ["cd", "d efg", " j"]


def test_atss_shuffles_boxes_and_not_pairs(spark, monkeypatch):
    from pyspark.sql.window import Window

    r = np.random.default_rng(3)

    def boxes(n):
        x = r.integers(0, 90, (n, 2)) / 2
        return np.concatenate([x, x + r.integers(10, 60, (n, 2)) / 2], axis=1).tolist()

    names = "image_id long, x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(i, i % 3, int(r.integers(0, 4)), *b) for i, b in enumerate(boxes(150))], f"prior_id long, level long, {names}")
    g = spark.createDataFrame([(i, 0, int(r.integers(0, 5)), *b) for i, b in enumerate(boxes(60))], f"gt_id long, label long, {names}")

    def plain(p, k):
        """The definition, with a window over all pairs."""
        (px, py), (gx, gy) = assign._p().center, assign._g().center
        x = assign.crossed(p, g).withColumn("_d", F.sqrt((px - gx) ** 2 + (py - gy) ** 2))
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy("gt_id", *[c for c in ("level",) if c in p.columns]).orderBy("_d", "prior_id"))).where(F.col("_n") <= k)
        per = Window.partitionBy("gt_id")
        x = x.withColumn("_t", F.avg("iou").over(per) + F.coalesce(F.stddev_samp("iou").over(per), F.lit(0.0))).where((F.col("iou") >= F.col("_t")) & assign._center_inside())
        return {(x.prior_id, x.gt_id, x.state) for x in assign._states(p, assign._one(x, F.desc("iou"), F.col("gt_id"))).collect()}

    monkeypatch.setattr(assign, "_STEP", 100)
    for q, k in ((p, 3), (p.drop("level"), 9), (p.drop("level"), 1), (p.drop("level"), 500)):
        out = assign.atss(q, g, k)
        assert {(x.prior_id, x.gt_id, x.state) for x in out.collect()} == plain(q, k)
    assert "_d" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "Join Inner" not in plan
    assert assign.atss(p, g.limit(0)).where("state = 0").count() == 150
