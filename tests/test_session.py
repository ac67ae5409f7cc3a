"""Sizes before a broadcast, and the folder for checkpoints."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loreweave import session


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_broadcast_is_sized_in_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.lit("x" * 100).alias("t"))
    assert hinted(session.sized_broadcast(df)) and not hinted(session.sized_broadcast(df, limit=99)) and not hinted(session.sized_broadcast(df, most_bytes=9_000))
    assert hinted(session.sized_broadcast(df.limit(0)))


@pytest.mark.parametrize(("master", "named", "raises"), [("spark://a:7077", None, True), ("local-cluster[2,1,1024]", None, True), ("yarn", "hdfs://x", False), ("local[4]", None, False), ("local", None, False)])
def test_checkpoint_folder(master, named, raises):
    kept = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=kept.append)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))
    if raises:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoints(fake)
    else:
        session.checkpoints(fake)
        assert len(kept) == 1 and (named is None or kept == [named])
