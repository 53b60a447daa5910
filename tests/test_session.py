from tablegov import session


def test_cut_writes_to_the_checkpoint_folder(spark):
    df = session.cut(spark.range(5))
    assert spark.sparkContext.getCheckpointDir()
    assert df.count() == 5 and "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_needs_a_small_count(spark, monkeypatch):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    assert hinted(session.sized(spark.range(10)))
    assert not hinted(session.sized(spark.range(11)))
    assert not hinted(session.sized(spark.range(5), rows=11))


def test_held_frames_are_released(spark):
    df = spark.range(7)
    with session.held(df) as kept:
        assert kept.is_cached and kept.count() == 7
    assert not df.is_cached
