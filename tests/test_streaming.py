"""Versions of the streamed map: replays, restarts, failures, late scans, moving windows, rays, and agreement with the batch plan."""

import pytest
from pyspark.sql import functions as F

from groundswell.functions.sensors import Constant
from groundswell.plans.config import Mapping, Node, Postprocess, Raycasting
from groundswell.plans.mapper import Mapper
from groundswell.streaming.mapper import StreamingMapper, pooled_states, scans
from groundswell.streaming.node import MappingNode

from .test_mapper import providers

SCHEMA = "point_id long, scan_id long, scan_ts double, frame_id string, x double, y double, z double, intensity double, color int"


def points(spark, scan_ids, per=30):
    rows = [(1000 * s + i, s, float(s), "lidar", 0.4 * (i % 6) - 1.0 + 0.07 * s, 0.4 * (i // 6) - 1.0, -0.3 - 0.01 * ((7 * i + 3 * s) % 11), 0.1 * (i % 5), 100 * s + i) for s in scan_ids for i in range(per)]
    return spark.createDataFrame(rows, SCHEMA)


def settings(**more):
    return Mapper(Mapping(**{"mode": "global", "sensor": Constant(), "length_x": 8.0, "length_y": 8.0, "resolution": 0.5} | more))


def rows_of(layers):
    names = sorted(set(layers.columns) - {"row", "col"})
    return {(r["row"], r["col"]): {n: round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names} for r in layers.collect()}


def modes(spark):
    place = [0.3 * k for k in range(12)]
    extrinsics, poses = providers(spark, place)
    local = {"mode": "local", "length_x": 2.0, "length_y": 2.0}
    yield "global", settings()
    yield "rays", settings(raycasting=Raycasting(True))
    yield "p2", settings(estimator="p2_quantile", raycasting=Raycasting(True))
    yield "local", settings(**local).with_providers(extrinsics, poses, 0.5)
    yield "local p2", settings(**local, estimator="p2_quantile").with_providers(extrinsics, poses, 0.5)


@pytest.mark.parametrize("mode", ["global", "rays", "p2", "local", "local p2"])
def test_batches_give_the_whole_map(spark, tmp_path, mode):
    """Scan after scan, with replays, a restart in between and compaction, as in one go; slices of scans give the same too."""
    mapper = dict(modes(spark))[mode]
    whole = mapper.mapped(points(spark, range(9)))
    want = rows_of(whole)
    assert len(want) > 8 and {"elevation_min", "obstacle", "color", "intensity"} <= set(whole.columns)
    one = StreamingMapper(spark, mapper, f"file://{tmp_path}/m", compact_every=3)
    for k, ids in enumerate(([0, 1], [2], [3, 4], [5])):
        assert one.integrate(points(spark, ids), k, "s") and not one.integrate(points(spark, ids), k, "s")
    two = StreamingMapper(spark, mapper, f"file://{tmp_path}/m", compact_every=3)
    assert two.version == one.version and not two.integrate(points(spark, [5]), 3, "s")
    for k, ids in enumerate(([6], [7, 8]), 4):
        assert two.integrate(points(spark, ids), k, "s")
    assert rows_of(two.layers()) == want
    import dataclasses

    assert rows_of(dataclasses.replace(mapper, slice_scans=4).mapped(points(spark, range(9)))) == want


def test_a_batch_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    mapper = StreamingMapper(spark, settings(), f"file://{tmp_path}/m")
    mapper.integrate(points(spark, [0]), 0)
    before = rows_of(mapper.layers())
    monkeypatch.setattr(StreamingMapper, "_commit", lambda self, version: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        mapper.integrate(points(spark, [1]), 1)
    monkeypatch.undo()
    again = StreamingMapper(spark, settings(), f"file://{tmp_path}/m")
    assert rows_of(again.layers()) == before
    assert again.integrate(points(spark, [1]), 1)
    assert max(r["n_points"] for r in rows_of(again.layers()).values()) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        mapper.integrate(points(spark, [1]), 1)


def test_late_scans_are_left_out_and_reset_begins_anew(spark, tmp_path):
    mapper = StreamingMapper(spark, settings(), f"file://{tmp_path}/m", lateness=2.0)
    mapper.integrate(points(spark, [0, 9]), 0)
    mapper.integrate(points(spark, [5, 8]), 1)  # scan 5 lies four seconds behind
    assert mapper.version.late == 1 and mapper.version.newest == 9.0
    assert max(r["n_points"] for r in rows_of(mapper.layers()).values()) == 3
    mapper.integrate(points(spark, [3]), 2)
    assert mapper.version.late == 2
    mapper.reset()
    assert mapper.layers().count() == 0 and not mapper.integrate(points(spark, [8]), 2)
    mapper.integrate(points(spark, [10]), 3)
    assert {r["n_points"] for r in rows_of(StreamingMapper(spark, settings(), mapper.folder).layers()).values()} == {1}


def test_stream_of_files_goes_on_after_a_restart(spark, tmp_path):
    source, folder, offsets = f"file://{tmp_path}/in", f"file://{tmp_path}/m", f"file://{tmp_path}/offsets"
    for ids in ([0, 1], [2, 3]):
        points(spark, ids).coalesce(1).write.mode("append").parquet(source)
        StreamingMapper(spark, settings(), folder).start(scans(spark, source, SCHEMA), offsets).awaitTermination()
    got = StreamingMapper(spark, settings(), folder)
    assert got.version.number == 1 and rows_of(got.layers()) == rows_of(settings().mapped(points(spark, range(4))))
    stream = pooled_states(spark.readStream.schema(SCHEMA).parquet(source), settings().grid)
    stream.writeStream.format("memory").queryName("pooled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    pooled = {(r["row"], r["col"]): r["elevation_min"] for r in spark.table("pooled").collect()}
    assert pooled == {k: pytest.approx(r["elevation_min"]) for k, r in rows_of(got.layers()).items()}


def test_node_publishes_at_its_rates_and_serves_snapshots(spark, tmp_path):
    mapper = StreamingMapper(spark, settings(), f"file://{tmp_path}/m")
    seen = []
    node = MappingNode(mapper, Node(local_rate=4.0, global_rate=1.0, post_rate=2.0, post=Postprocess(inpaint=True, fuse=True, features=True, feature_radius=1.0, fusion_radius=1.0)), lambda name, df: seen.append((name, df.count())))
    assert node.tick(0.0) == []
    mapper.integrate(points(spark, [0, 1, 2]), 0)
    assert node.tick(1.0) == ["local_map", "global_map", "post_processed"]
    assert [node.due(t) for t in (1.1, 1.25, 1.5, 1.75, 2.0)] == [[], ["local_map"], ["local_map", "post_processed"], ["local_map"], ["local_map", "global_map", "post_processed"]]
    assert len(seen) == 3 and seen[0][1] == seen[1][1] <= seen[2][1]
    post = node.run_postprocess()
    assert {"slope", "uncertainty_range", "lower_bound", "elevation"} <= set(post.columns)
    assert node.run_inpainting().count() >= node.snapshot().count() == node.run_uncertainty_fusion().count()
    assert node.run_feature_extraction().count() > 0 and node.snapshot().columns == ["row", "col", "elevation", "lower_bound", "upper_bound"]

    class Query:
        left = 2
        isActive = property(lambda self: self.left > 0)
        exception = lambda self: None

    query, now = Query(), [10.0]

    def sleep(t):
        now[0] += t
        query.left -= 1

    seen.clear()
    node.run(query, lambda: now[0], sleep)
    assert [n for n, _ in seen].count("local_map") == 3
    node.reset()
    assert node.global_map().count() == 0
