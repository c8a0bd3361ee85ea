"""Published small examples and second implementations of what SQL does not express."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.functions import masks, text
from tessera.operators import assign, matching, metrics, suppress, tracking
from tessera.sources import annotations as N

BOXES = [(50, 60, 70, 80), (100, 120, 130, 150), (150, 160, 190, 200), (250, 260, 350, 360)]


def perfect(spark, labels=(0, 0, 1, 0), scores=(1.0, 0.98, 0.96, 0.95)):
    cols = "x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([(i, 0, c, 0, 0, *map(float, b)) for i, (c, b) in enumerate(zip(labels, BOXES, strict=True))], f"gt_id long, image_id long, label long, ignored int, group_of int, {cols}")
    det = spark.createDataFrame([(i, 0, c, s, *map(float, b)) for i, (c, s, b) in enumerate(zip(labels, scores, BOXES, strict=True))], f"det_id long, image_id long, label long, score double, {cols}")
    return det, gt


def test_identical_boxes_have_map_one(spark):
    det, gt = perfect(spark)
    assert matching.mean_ap(matching.map_table(det, gt)).first()[0] == pytest.approx(1.0)


def test_proposal_recall_of_identical_boxes(spark):
    det, gt = perfect(spark)
    got = {r.top: r.recall for r in metrics.proposal_recall(det, gt, (2, 4, 100)).collect()}
    assert got == {2: 0.5, 4: 1.0, 100: 1.0}


def test_trapezoid_ap_loses_the_first_step(spark):
    rows = [(i, 1.0, 1, 0) for i in range(6)]
    m = spark.createDataFrame(rows, "det_id long, score double, tp int, fp int")
    assert metrics.trapezoid_ap(m, 6).first()[0] == pytest.approx(5 / 6)
    assert metrics.miss_rate(m, 6, 1).first()[0] == 0.0


def test_reid_example(spark):
    labels = (0, 0, 1, 1, 1, 1)
    f = [(1, 0, 0.1), (0.8, 0, 0), (0.1, 1, 0.1), (0, 0.9, 0.1), (0.9, 0.1, 0), (0, 0.1, 1)]
    x = spark.createDataFrame([(i, list(map(float, v)), c) for i, (v, c) in enumerate(zip(f, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    r = metrics.reid(x).first()
    assert (r.map, r.r1, r.r5) == (0.719, 0.5, 1.0)


def test_one_perfect_openimages_box(spark):
    det, gt = perfect(spark)
    counts = matching.label_counts(gt)
    ap = matching.average_precision(matching.match_groups(det, gt), counts, ["label"])
    assert {r.ap for r in ap.collect()} == {1.0}


def test_window_matching_equals_a_loop(spark, sf_dir):
    from tessera.plans import views

    det, gt = views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir)
    got = {r.det_id: (r.tp, r.fp) for r in matching.match_default(det, gt).collect()}
    d, g = det.toPandas(), gt.toPandas()
    c = ["x1", "y1", "x2", "y2"]
    for (image, label), part in d.groupby(["image_id", "label"]):
        of = g[(g.image_id == image) & (g.label == label)].sort_values(["ignored", "gt_id"])
        o = matching.overlaps(part[c].to_numpy(), of[c].to_numpy())
        taken = set()
        for i in np.lexsort((part.det_id, -part.score)):
            best = int(o[i].argmax()) if len(of) else -1
            want = (0, 1)
            if best >= 0 and o[i, best] >= 0.5:
                want = (0, 0) if of.ignored.iloc[best] else (0, 1) if best in taken else (1, 0)
                taken |= {best} if want[0] else set()
            assert got[part.det_id.iloc[i]] == want


def test_greedy_suppression_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    xy = rng.integers(0, 60, (40, 2))
    rows = [(i, i % 2, i % 3, float(i * 37 % 41 + 1) / 42, float(x), float(y), float(x + 30), float(y + 25)) for i, (x, y) in enumerate(xy)]
    det = spark.createDataFrame(rows, "det_id long, image_id long, label long, score double, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_id for r in suppress.greedy_suppression(det, 0.4).collect()}
    want = set()
    for key in {(r[1], r[2]) for r in rows}:
        kept = []
        for r in sorted([r for r in rows if (r[1], r[2]) == key], key=lambda r: (-r[3], r[0])):
            if all(matching.overlaps(np.array([r[4:]]), np.array([k[4:]]))[0, 0] <= 0.4 for k in kept):
                kept.append(r)
        want |= {k[0] for k in kept}
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_has_least_cost(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    rows, cols = assign.solve(cost)
    assert len(set(rows)) == len(rows) == len(set(cols)) == min(n, m)
    small, big = min(n, m), max(n, m)
    table = cost if n <= m else cost.T
    best = min(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert cost[rows, cols].sum() == pytest.approx(best)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=3, max_size=3), min_size=1, max_size=6))
def test_run_lengths_round_trip(rows):
    bitmap = np.array(rows, np.uint8)
    assert (masks.decode_runs(masks.encode_runs(bitmap), *bitmap.shape) == bitmap).all()


def test_mask_functions(spark):
    square = [1.0, 1.0, 5.0, 1.0, 5.0, 4.0, 1.0, 4.0]
    assert masks.fill_polygon(square, 8, 8).sum() == 12
    assert masks.bitmap_box(masks.fill_polygon(square, 8, 8)) == [1, 1, 5, 4]
    df = spark.createDataFrame([([square],), ([[0.0, 0.0]],)], "p array<array<double>>")
    got = [r[0] for r in df.select(masks.polygons_area(F.col("p"))).collect()]
    assert got == [12.0, 0.0]


def test_box_properties(spark):
    rows = [tuple(map(float, r)) for r in ((0, 0, 10, 10), (5, 5, 15, 20), (30, 30, 30, 30))]
    x = spark.createDataFrame([(*a, *b) for a in rows for b in rows], ", ".join(f"{p}{n} double" for p in "ab" for n in ("x1", "y1", "x2", "y2")))
    a, b = B.Box.named("a"), B.Box.named("b")
    flipped = a.flip(40, 40, "diagonal").flip(40, 40, "diagonal")
    for r in x.select(B.iou(a, b).alias("u"), B.iou(b, a).alias("v"), B.giou(a, b).alias("g"), *flipped.columns("f"), *a.columns("a")).collect():
        assert r.u == r.v and 0 <= r.u <= 1 and r.g <= r.u + 1e-12
        assert (r.fx1, r.fy1, r.fx2, r.fy2) == (r.ax1, r.ay1, r.ax2, r.ay2)
    with pytest.raises(ValueError):
        a.flip(1, 1, "sideways")
    with pytest.raises(KeyError):
        B.convert(list(a.corners), "xyxy", "unknown")


def test_text_functions(spark):
    df = spark.createDataFrame([("Dining_Table (large)_x (y)", "a cat and a dog", [[2, 5], [12, 15]], [5, 3, 5])], "n string, c string, s array<array<int>>, i array<int>")
    r = df.select(text.clean_name(F.col("n")).alias("n"), text.span_text(F.col("c"), F.col("s")).alias("s"), text.dense_ids(F.col("i")).alias("i"), text.merged_spans(F.expr("array(array(8, 9), array(0, 3), array(4, 7))")).alias("m")).first()
    assert (r.n, r.s, r.i, r.m) == ("dining table ", "cat dog", [1, 0, 1], [[0, 9]])


def test_coco_reader_and_cleaning(spark, tmp_path):
    data = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 80}, {"id": 2, "file_name": "b.jpg", "width": 20, "height": 20}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 20], "area": 400, "iscrowd": 0},
            {"id": 2, "image_id": 1, "category_id": 9, "bbox": [0, 0, 5, 5], "area": 25, "iscrowd": 1},
            {"id": 3, "image_id": 1, "category_id": 7, "bbox": [200, 10, 20, 20], "area": 400, "iscrowd": 0},
            {"id": 4, "image_id": 2, "category_id": 7, "bbox": [1, 1, 0.5, 9], "area": 4.5, "iscrowd": 0},
            {"id": 5, "image_id": 2, "category_id": 8, "bbox": [1, 1, 9, 9], "area": 81, "ignore": 1},
        ],
        "categories": [{"id": 9, "name": "z"}, {"id": 7, "name": "a"}, {"id": 8, "name": "b"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(data))
    t = N.read_coco(spark, str(tmp_path / "c.json"))
    labels = N.labels_of(t["categories"])
    assert {r.name: r.label for r in labels.collect()} == {"z": 0, "a": 1, "b": 2}
    clean = N.clean(N.require_unique(t["annotations"], "id"), t["images"], labels)
    assert {(r.id, r.label, r.ignored, r.x2) for r in clean.collect()} == {(1, 1, 0, 30.0), (2, 0, 1, 5.0)}
    assert {r.id for r in N.filter_images(t["images"], t["annotations"], labels).collect()} == {1, 2}  # by raw annotations
    assert {r.id: len(r.instances) for r in N.nested(t["images"], clean).collect()} == {1: 2, 2: 0}
    with pytest.raises(ValueError):
        N.require_unique(t["annotations"], "image_id")


def test_other_readers(spark, tmp_path):
    (tmp_path / "v.xml").write_text(
        "<annotation><filename>000001.jpg</filename><size><width>353</width><height>500</height><depth>3</depth></size>"
        "<object><name>dog</name><difficult>0</difficult><bndbox><xmin>48</xmin><ymin>240</ymin><xmax>195</xmax><ymax>371</ymax></bndbox></object>"
        "<object><name>car</name><difficult>1</difficult><bndbox><xmin>8.6</xmin><ymin>12</ymin><xmax>352</xmax><ymax>498</ymax></bndbox></object></annotation>"
    )
    rows = N.read_voc(spark, str(tmp_path / "v.xml"), ["car", "dog"]).orderBy("pos").collect()
    assert [(r.label, r.x1, r.y2, r.ignored) for r in rows] == [(1, 47.0, 370.0, 0), (0, 7.0, 497.0, 1)]
    (tmp_path / "h.odgt").write_text(json.dumps({"ID": "i1", "gtboxes": [{"tag": "person", "fbox": [1, 2, 3, 4], "extra": {"ignore": 0}}, {"tag": "mask", "fbox": [0, 0, 9, 9], "extra": {"ignore": 1}}]}) + "\n")
    assert [(r.label, r.ignored, r.x2) for r in N.read_crowdhuman(spark, str(tmp_path / "h.odgt")).orderBy("pos").collect()] == [(0, 0, 4.0), (-1, 1, 9.0)]
    (tmp_path / "o.jsonl").write_text(
        json.dumps({"filename": "f", "height": 5, "width": 6, "grounding": {"caption": "a cat", "regions": [{"bbox": [1, 2, 3, 4], "phrase": "a cat", "tokens_positive": [[0, 5]]}, {"bbox": [[1, 2, 3, 4], [5, 6, 7, 8]], "phrase": "x"}]}}) + "\n"
        + json.dumps({"filename": "g", "height": 5, "width": 6, "detection": {"instances": [{"bbox": [1, 2, 3, 4], "label": 3, "category": "k"}]}}) + "\n"
    )
    objects, phrases = N.read_odvg(spark, str(tmp_path / "o.jsonl"))
    assert [(r.filename, r.label, r.y2) for r in objects.collect()] == [("g", 3, 4.0)]
    assert [len(r.boxes) for r in phrases.orderBy("pos").collect()] == [1, 2]
    (tmp_path / "m.txt").write_text("1,7,10,20,30,40,1,1,0.8\n2,7,12,20,30,40,1,1,0.7\n")
    assert [(r.frame_id, r.x2, r.visibility) for r in N.read_mot(spark, str(tmp_path / "m.txt")).orderBy("frame_id").collect()] == [(1, 40.0, 0.8), (2, 42.0, 0.7)]
    (tmp_path / "p.txt").write_text("a/b.jpg 3\nc.jpg 0\n")
    assert {(r.path, r.label) for r in N.read_pairs(spark, str(tmp_path / "p.txt")).collect()} == {("a/b.jpg", 3), ("c.jpg", 0)}
    (tmp_path / "b.txt").write_text("# 0\nx.jpg\n1024 683\n2\n5 0.1 0.2 0.3 0.4 0\n9 0 0 1 1 1\n")
    assert [(r.file_name, r.label, r.group_of) for r in N.read_blocks(spark, str(tmp_path / "b.txt")).orderBy("pos").collect()] == [("x.jpg", 4, 0), ("x.jpg", 8, 1)]


def test_tracks_follow_moving_boxes(spark):
    rows = []
    for f in range(12):
        for k in range(3):
            rows.append((0, f, f * 3 + k, 0, 0.9, 100.0 * k + 3 * f, 50.0, 100.0 * k + 3 * f + 40, 120.0))
    det = spark.createDataFrame(rows, "video_id long, frame_id long, det_id long, label long, score double, x1 double, y1 double, x2 double, y2 double")
    got = tracking.track(det).toPandas()
    ids = got.assign(k=got.det_id % 3).groupby("k").track_id.unique()
    assert all(len(v) == 1 and v[0] >= 0 for v in ids) and len({v[0] for v in ids}) == 3
    scores = tracking.tracking_scores(tracking.track(det), det.withColumn("track_id", F.col("det_id") % 3)).first()
    assert (scores.mota, scores.idf1, scores.switches) == (1.0, 1.0, 0)


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.tracks import track_stream

    rows = [(v, f, v * 1000 + f * 2 + k, 0, 0.9, 100.0 * k + 2 * f, 10.0, 100.0 * k + 2 * f + 30, 60.0) for v in range(2) for f in range(8) for k in range(2)]
    schema = "video_id long, frame_id long, det_id long, label long, score double, x1 double, y1 double, x2 double, y2 double"
    det = spark.createDataFrame(rows, schema)
    for i, (lo, hi) in enumerate(((0, 4), (4, 8))):
        det.where(f"frame_id >= {lo} and frame_id < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = track_stream(stream, idle=None).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.det_id, r.track_id) for r in spark.sql("SELECT det_id, track_id FROM tracks").collect()}
    finally:
        q.stop()
    assert got == {(r.det_id, r.track_id) for r in tracking.track(det).collect()}


def test_reid_equals_loops(spark):
    rng = np.random.default_rng(6)
    f = rng.integers(0, 4, (60, 3)).astype(float)  # many equal distances
    labels = rng.integers(0, 5, 60)
    x = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(f, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    aps, firsts = [], []
    for q in range(60):
        d = ((f - f[q]) ** 2).sum(1)
        order = sorted((i for i in range(60) if i != q), key=lambda i: (d[i], labels[i] != labels[q], i))
        hits = [k + 1 for k, i in enumerate(order) if labels[i] == labels[q]]
        aps.append(np.mean([(k + 1) / h for k, h in enumerate(hits)]))
        firsts.append(hits[0])
    for block in (4, 1000):
        r = metrics.reid(x, block=block).first()
        assert (r.map, r.r1, r.r5) == pytest.approx((np.mean(aps), np.mean(np.array(firsts) <= 1), np.mean(np.array(firsts) <= 5)), abs=6e-4)


def test_draws_differ_for_many_keys(spark):
    from tessera.operators import sampling

    d = spark.range(3_000_000).select(sampling.draw(1, "id").alias("u"))
    r = d.agg(F.count_distinct("u").alias("n"), F.avg("u").alias("m"), F.stddev("u").alias("s"), F.min("u").alias("a"), F.max("u").alias("b")).first()
    assert r.n > 2_990_000 and abs(r.m - 0.5) < 0.002 and abs(r.s - 12**-0.5) < 0.002 and 0 <= r.a < r.b < 1


def test_numbers_go_on_over_shards(spark):
    from tessera.operators import sampling

    rows = [(i * 37 % 101, i % 3, i % 7) for i in range(101)]
    x = spark.createDataFrame(rows, "k long, g long, t long")
    got = {(r.k, r.g): r.n for r in sampling.numbered(x, ["k"], "n", ["g"], shards=8).collect()}
    for g in range(3):
        assert [got[k, g] for k in sorted(k for k, h, _ in rows if h == g)] == list(range(sum(h == g for _, h, _ in rows)))
    tied = [r.n for r in sampling.numbered(x, ["t", "k"], "n", shards=50).orderBy("t", "k").collect()]
    assert tied == list(range(101)) and sampling.numbered(x.limit(0), ["k"], "n").count() == 0


def test_triplets(spark):
    from tessera.operators import prepare

    rows = [(c, c % 6) for c in range(40)]
    x = spark.createDataFrame(rows, "crop_id long, person_id long")
    got = prepare.triplets(x, ids=4, per_id=3).collect()
    assert len(got) == 40 * 12
    for a in range(40):
        own = sorted((r.place, r.person, r.crop) for r in got if r.anchor == a)
        assert [p for p, _, _ in own] == list(range(12)) and all(c % 6 == p for _, p, c in own)
        people = [{p for k, p, _ in own if k // 3 == i} for i in range(4)]
        assert people[0] == {a % 6} and all(len(p) == 1 for p in people) and len(set().union(*people)) == 4
    with pytest.raises(ValueError):
        prepare.triplets(x, ids=7)


def test_nested_inputs_and_clips(spark):
    from tessera.operators import prepare

    images = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "image_id long, width int, height int")
    boxes = spark.createDataFrame([(7, 1, 3, 0, 0.0, 0.0, 1.0, 1.0), (6, 1, 4, 1, 0.0, 0.0, 2.0, 2.0)], "gt_id long, image_id long, label long, ignored int, x1 double, y1 double, x2 double, y2 double")
    r = {x.image_id: x for x in prepare.instances(images, boxes).collect()}
    assert (r[1].labels, r[1].ignore_flags, r[1].bboxes[0]) == ([4, 3], [True, False], [0.0, 0.0, 2.0, 2.0]) and r[2].bboxes == []
    p = {x.image_id: x for x in prepare.packed(images, boxes).collect()}
    assert [v.label for v in p[1].gt_instances] == [3] and [v.label for v in p[1].ignored_instances] == [4] and p[2].metainfo.width == 30
    frames = spark.createDataFrame([(0, f) for f in range(7)], "video_id long, frame_id long")
    assert sorted(x.frames for x in prepare.clips(frames, count=2, stride=2).collect()) == [[0, 2], [1, 3], [4, 6], [5]]
    assert [x.frames for x in prepare.clips(frames).collect()] == [list(range(7))]
    refs = spark.createDataFrame([(0, 3, [5, 1])], "video_id long, frame_id long, refs array<long>")
    assert prepare.clips(frames, refs).first().frames == [1, 3, 5]
    b = prepare.branches(images, {"all": F.lit(True), "big": F.col("width") > 20})
    assert sorted((x.image_id, x.branch) for x in b.collect()) == [(1, "all"), (2, "all"), (2, "big")]


def test_bucket_coder_round_trip(spark):
    from tessera.functions import coders

    rng = np.random.default_rng(2)
    p = rng.uniform(0, 100, (50, 2))
    rows = [tuple(map(float, (x, y, x + 40, y + 30, x + 40 * a, y + 30 * b, x + 40 * c, y + 30 * d))) for (x, y), (a, b, c, d) in zip(p, rng.uniform([-0.8, -0.8, 0.6, 0.6], [0.4, 0.4, 1.8, 1.8], (50, 4)), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n}{c} double" for n in "pb" for c in ("x1", "y1", "x2", "y2")))
    prior, box = B.Box.named("p"), B.Box.named("b")
    code = coders.encode_buckets(prior, box)
    back = coders.decode_buckets(prior, code)
    for r in df.select("*", *back.columns("d"), *[v.alias(k) for k, v in code.items()]).collect():
        assert [r.dx1, r.dy1, r.dx2, r.dy2] == pytest.approx([r.bx1, r.by1, r.bx2, r.by2])
        assert all(0 <= r[k] < 7 for k in "lrtd") and all(abs(r[f"{k}_offset"]) <= 0.5 + 1e-9 for k in "lrtd")
        edge, step = r.px1 - 40, 120 / 14  # the left side's nearest bucket centre among the left half
        centres = edge + (np.arange(7) + 0.5) * step
        assert abs(centres[r.l] - r.bx1) == pytest.approx(np.abs(centres - r.bx1).min())


def test_state_of_ended_videos_is_removed(spark, tmp_path):
    import time

    from tessera.streaming.tracks import track_stream

    schema = "video_id long, frame_id long, det_id long, label long, score double, x1 double, y1 double, x2 double, y2 double"
    row = lambda v, f: (v, f, v * 100 + f, 0, 0.9, 0.0, 0.0, 10.0, 10.0)
    folder = tmp_path / "in"
    spark.createDataFrame([row(1, 0)], schema).coalesce(1).write.parquet(str(folder / "a"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
    q = track_stream(stream, idle=1).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        rows, end = None, time.time() + 60
        while rows != 0 and time.time() < end:  # batches without data go on, and remove the state
            time.sleep(0.5)
            done = [p for p in q.recentProgress if p["stateOperators"]]
            rows = done[-1]["stateOperators"][0]["numRowsTotal"] if len(done) > 1 else None
        assert rows == 0 and spark.sql("SELECT * FROM ended").count() == 1
    finally:
        q.stop()
