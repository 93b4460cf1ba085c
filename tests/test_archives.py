"""Archives of predictions, and values of their own types."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.sources.archives import members, read_archives, write_archives
from corvane.sources.files import read_values


@pytest.fixture
def archives(spark, tmp_path):
    own = np.random.default_rng(3)
    for method, extra in (("edl", ["vacuity"]), ("softmax", [])):
        for part, n in (("cifar10", 9000), ("corruption/blur/3", 5)):
            arrays = {"probs": own.random((n, 4)).astype(np.float32), "labels": np.arange(n), **{e: own.random(n) for e in extra}}
            np.savez_compressed(tmp_path / f"{method}__{part.replace('/', '__')}.npz", **arrays)
    return str(tmp_path)


def test_members_are_rows_by_method_and_set(spark, archives):
    rows = read_archives(spark, archives)
    assert dict(rows.dtypes) == {"method": "string", "part": "string", "row": "bigint", "labels": "bigint", "probs": "array<double>", "vacuity": "double"}
    assert rows.rdd.getNumPartitions() == 4
    counts = {(r.method, r.part): (r.n, r.v) for r in rows.groupBy("method", "part").agg(F.count("labels").alias("n"), F.count("vacuity").alias("v")).collect()}
    assert counts == {("edl", "cifar10"): (9000, 9000), ("edl", "corruption/blur/3"): (5, 5), ("softmax", "cifar10"): (9000, 0), ("softmax", "corruption/blur/3"): (5, 0)}
    with np.load(f"{archives}/edl__cifar10.npz") as z:
        got = rows.where("method = 'edl' and part = 'cifar10'").orderBy("row").toPandas()
        assert np.array_equal(np.stack(got["probs"]), z["probs"].astype(float)) and np.array_equal(got["vacuity"], z["vacuity"]) and np.array_equal(got["labels"], z["labels"])


def test_members_that_are_not_asked_for_stay_unopened(spark, archives, tmp_path):
    for name in ("broken__cifar10.npz", "edl__broken.npz"):
        (tmp_path / name).write_bytes(b"no archive")
    assert read_archives(spark, archives, ["edl"], ["cifar10"]).count() == 9000
    rows = read_archives(spark, archives, ["softmax", "none"])
    assert (rows.where("part = 'cifar10'").count(), rows.count(), rows.where("part = 'corruption/blur/3' and labels > 1").count()) == (9000, 9005, 3)
    assert read_archives(spark, archives, parts=["corruption/blur/3"]).count() == 10
    assert rows.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="not a zip file"):
        read_archives(spark, archives, ["edl"]).count()


def test_what_is_written_is_read_again_and_members_that_are_there_stay(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b/c").alias("part"), F.lit("edl").alias("method"), F.col("id").alias("row"), (F.col("id") % 10).alias("labels"), F.array(F.col("id") / 4, F.lit(0.5)).alias("probs"))
    assert write_archives(rows.repartition(4), path) == ["edl__a.npz", "edl__b__c.npz"]
    back = read_archives(spark, path)
    want = sorted((r.part, r.labels, tuple(r.probs)) for r in rows.collect())
    assert sorted((r.part, r.labels, tuple(r.probs)) for r in back.collect()) == want
    assert [r.row for r in back.where("part = 'a'").orderBy("probs").select("row").collect()] == list(range(2500))
    more = rows.where("part = 'a'").withColumn("labels", F.lit(-1)).unionByName(rows.withColumn("part", F.lit("new")))
    assert write_archives(more, path) == ["edl__new.npz"]
    assert back.where("part = 'a' and labels < 0").count() == 0
    assert write_archives(more.where("part = 'a'"), path, force=True) == ["edl__a.npz"]
    assert [m.part for m in members(path)] == ["a", "b/c", "new"] and not list((tmp_path / "out").glob("*.part"))


def test_values_keep_their_own_types(spark, tmp_path):
    values = ["1", "2.5", "True", "x", "", "-7", "1e3", "nan", "-inf", "007", "1_000", "false", " 5 ", "12345678901234567890", ".5", "5.", "+3", "1__0", "e3"]
    path = tmp_path / "t.csv"
    path.write_text("value,other\n" + "\n".join(f'"{v}",a' for v in values) + "\n")

    def plain(v):
        if v in ("True", "False"):
            return v == "True"
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    rows = read_values(spark, str(path))
    assert [k for _, k in rows.dtypes] == ["variant", "variant"]
    got = [r.value.toPython() for r in rows.collect()]
    want = [plain(v) for v in values]
    names = {"Decimal": "int"}
    assert [(names.get(type(g).__name__, type(g).__name__), str(g)) for g in got] == [(type(w).__name__, str(w)) for w in want]
    assert json.loads(rows.select(F.to_json(F.struct("value")).alias("j")).first().j) == {"value": 1}
