import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import vastgrain.api as api


def test_dataset(spark, tmp_path):
    t = pa.table({"x": np.arange(1000, dtype=np.int32), "v": np.arange(1000) / 10.0})
    (tmp_path / "d").mkdir()
    pq.write_table(t.slice(0, 600), tmp_path / "d" / "a.parquet", row_group_size=100)
    pq.write_table(t.slice(600), tmp_path / "d" / "b.parquet", row_group_size=100)
    d = api.open(spark, str(tmp_path / "d"), budget="1MB")
    assert {(r.row_groups, r.rows) for r in d.describe().collect()} == {(6, 600), (4, 400)}
    assert {r["column"]: r.high_number for r in d.stats().collect()} == {"x": 999, "v": 99.9}
    r = d.prune("x", 150, 249).first()
    assert (r["groups"], r["all_groups"], r["rows"]) == (2, 10, 200)
    assert d.search("x", 150, 249, ["v"]).count() == 100 and d.window("x", 0, 10).count() == 10
    assert d.sample(3).count() == 300 and d.sample(3, seed=1).columns == ["x", "v"]
    sizes = [b.num_rows for b in d.batches(["x"], rows=300)]
    assert sum(sizes) == 1000 and max(sizes) == 300 and d.budget.used == 0 and d.budget.peak > 0
    assert sum(c["x"].sum() for c in d.numpy(["x"])) == 499_500
    assert d.plan("1KB").agg({"chunks": "sum"}).first()[0] >= 2
    assert d.materialize(str(tmp_path / "out"), ["x"], 5).count() == 5
    assert api.view(spark, str(tmp_path / "d"), "x").select((10, 20)).load().count() == 10
    assert api.scan(spark, str(tmp_path / "d" / "a.parquet"), ["v"]).columns == ["v"]
    assert api.to_frame(spark, np.zeros((2, 3))).columns == ["c0", "c1", "c2"] and api.to_frame(spark, {"a": [1]}).count() == 1 and api.to_frame(spark, t).count() == 1000
