import types

import pytest
from pyspark.sql import functions as F

from quillgraph import session as S


def test_small_by_rows_and_bytes(spark):
    ids = spark.range(100)
    assert S.is_small(ids, 100) and not S.is_small(ids, 99) and not S.is_small(ids, 1000, size=8 * 99)
    texts = ids.withColumn("t", F.repeat(F.lit("x"), 1000))
    assert S.is_small(texts, 100) and not S.is_small(texts, 100, size=50_000) and S.is_small(texts.limit(0), 0)


def test_a_cluster_must_name_its_shared_folder(spark):
    for master, fails in (("spark://h:7077", True), ("local-cluster[2,1,1024]", True), ("local[4]", False), ("local", False)):
        conf = {}
        fake = types.SimpleNamespace(
            conf=types.SimpleNamespace(get=lambda k, d=None, conf=conf: conf.get(k, d), set=conf.__setitem__), sparkContext=types.SimpleNamespace(master=master, applicationId=f"test-{master}")
        )
        if fails:
            with pytest.raises(RuntimeError):
                S.shared_dir(fake)
        else:
            assert S.shared_dir(fake).startswith("file://")
    assert S.shared_dir(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: "hdfs://x/y/"))) == "hdfs://x/y"


def test_written_steps_can_be_discarded(spark):
    import os

    step = S.materialize(spark.range(3), "probe")
    path = step._qg_path.removeprefix("file://")
    assert step.count() == 3 and os.path.isdir(path)
    S.discard(step)
    assert not os.path.exists(path)
    S.discard(spark.range(1))
