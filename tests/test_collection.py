"""Vector collections: conflicts, readers of old versions, deletes over compaction, pruned parts."""

import pytest
from pyspark.sql import functions as F

from docmill.sources.collection import Collection, ConflictError

SCHEMA = "point_id long, embedding array<double>, payload map<string,string>"


def _points(spark, *rows):
    return spark.createDataFrame([(i, [float(x), 1.0], p) for i, x, p in rows], SCHEMA)


def _held(df):
    return {r.point_id: (r.embedding[0], dict(r.payload)) for r in df.collect()}


def test_versions(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c", 2)
    assert c.versions() == [] and c.read().count() == 0
    assert c.put(_points(spark, (1, 1, {"lang": "de"}), (2, 2, {"lang": "en"}), (3, 3, None))) == 1
    reader = c.read()
    assert c.put(_points(spark, (2, 20, {"lang": "fr"}), (4, 4, {"lang": "en"}))) == 2
    now = {1: (1.0, {"lang": "de"}), 2: (20.0, {"lang": "fr"}), 3: (3.0, {}), 4: (4.0, {"lang": "en"})}
    assert _held(c.read()) == now
    assert _held(reader) == _held(c.read(1)) == {1: (1.0, {"lang": "de"}), 2: (2.0, {"lang": "en"}), 3: (3.0, {})}
    assert c.delete(spark.createDataFrame([(3,), (99,), (None,)], "id long")) == 3
    del now[3]
    assert _held(c.read()) == now
    assert c.put(_points(spark, (3, 30, {"lang": "de"}))) == 4  # after a delete a point may come back
    now[3] = (30.0, {"lang": "de"})
    assert _held(c.read()) == now and c.compact() == 5 and _held(c.read()) == now
    assert len(c.manifest()["parts"]) == 1 and not c.manifest()["deletes"] and 3 not in _held(c.read(3))
    assert c.delete_where({"lang": "de"}) == 6 and set(_held(c.read())) == {2, 4}
    assert len(c.vacuum(1)) == 6 and set(_held(c.read())) == {2, 4} and c.versions() == [6]


def test_of_two_writers_one_loses_cleanly(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c", 2)
    base = c.put(_points(spark, (1, 1, None)))
    assert c.put(_points(spark, (2, 2, None)), base) == 2
    with pytest.raises(ConflictError):
        c.put(_points(spark, (3, 3, None)), base)
    with pytest.raises(ConflictError):
        c.delete(spark.createDataFrame([(1,)], "id long"), base)
    assert c.versions() == [1, 2] and set(_held(c.read())) == {1, 2}
    assert c.put(_points(spark, (3, 3, None))) == 3 and set(_held(c.read())) == {1, 2, 3}


def test_a_bad_point_publishes_nothing(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c", 2)
    for bad in ([(1, [1.0], None)], [(1, None, None)], [(None, [1.0, 2.0], None)], [(1, [1.0, 2.0], None), (1, [3.0, 2.0], None)]):
        with pytest.raises(Exception, match="point"):
            c.put(spark.createDataFrame(bad, SCHEMA))
    assert c.versions() == []


def test_payload_limits_prune_parts(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c", 2)
    for i, lang in enumerate(["de", "en", "fr"]):
        c.put(_points(spark, (i, i, {"lang": lang}), (i + 10, i, {"lang": lang, "x": "1"})))
    assert len(c.parts(equals={"lang": "en"})) == 1 and len(c.parts(equals={"none": "1"})) == 0 and len(c.parts()) == 3
    rows = c.read(equals={"lang": "en", "x": "1"})
    assert [r.point_id for r in rows.collect()] == [11]
    assert len({f.rsplit("/", 2)[1] for f in c.read(equals={"lang": "en"}).inputFiles() if "/parts/" in f}) == 1
    c.delete(spark.createDataFrame([(1,)], "id long"))
    assert set(_held(c.read(equals={"lang": "en"}))) == {11}
    wide = spark.range(300).select(F.col("id").alias("point_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.create_map(F.concat(F.lit("k"), "id"), F.lit("v")).alias("payload"))
    c.put(wide)
    assert c.manifest()["parts"][-1]["limits"] is None and c.read(equals={"k250": "v"}).count() == 1
