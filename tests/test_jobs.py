"""Runs that are lost and started again, imports that rebuild what they reach, and issues that come late, twice and out of order."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import parse, rebuild
from marquee.plans import jobs
from marquee.sources.runstore import RunError, RunStore, run_id
from marquee.streaming import issues


@pytest.fixture
def runs(spark, tmp_path):
    return RunStore(spark, f"file://{tmp_path}/store")


def contents(df):
    return sorted(map(str, df.collect()))


def placement(spark, n=40, first=0):
    rows = [("s", "x", k, [str(k), "Acme", "SW", "Lagos", f"City {k % 3}", f"{k % 4} Road", "Brand", "Beer", "Billboard", "Static", "A", "1,200", "-", "2021" if k % 9 else "21", "Q2", "April"]) for k in range(first, n)]
    return spark.createDataFrame(rows, "source string, sheet string, row int, cells array<string>")


def test_a_lost_job_goes_on_and_ends_alike(spark, runs, tmp_path):
    rows = placement(spark)
    whole = RunStore(spark, f"file://{tmp_path}/whole")
    want_run = jobs.drive(whole, rows, "a")
    calls = []

    def steps(fail):
        def watched(name, build):
            def run(tables):
                calls.append(name)
                if name == fail:
                    raise ConnectionError("lost")
                return build(tables)

            return run

        return [(name, watched(name, build)) for name, build in jobs.drive_steps(rows, lambda: None)]

    run = run_id(name="a", after=None)
    assert run == want_run
    with pytest.raises(ConnectionError):
        runs.run(run, steps("resolve"))
    assert calls == ["seed", "persist", "resolve"] and runs.commits() == [] and runs.latest() is None
    with pytest.raises(RunError, match="RUN_NOT_COMMITTED"):
        runs.read(run, "persist", "facts")
    with pytest.raises(RunError, match="RUN_STORE_LOCKED"):
        runs.acquire("another")
    # What a lost job left of a step is not taken for its result.
    spark.range(3).write.parquet(f"{runs.root}/runs/{run}/resolve/sites")
    calls.clear()
    runs.run(run, steps(None))
    assert calls == ["resolve", "derive"] and runs.commits() == [run]
    for step, tables in (("seed", ("records", "quarantine")), ("persist", ("facts",)), ("resolve", ("sites", "site_rows", "review")), ("derive", ("activity",))):
        for t in tables:
            assert contents(runs.read(run, step, t)) == contents(whole.read(run, step, t))
    calls.clear()
    runs.run(run, steps("seed"))
    assert calls == [] and runs.commits() == [run]
    runs.acquire("another")


def test_runs_build_on_the_last_commit_and_readers_stay_with_theirs(spark, runs):
    first = jobs.drive(runs, placement(spark, 20), "first")
    pinned = runs.read(first, "persist", "facts")
    second = jobs.drive(runs, placement(spark, 40), "second")
    assert runs.commits() == [first, second] == [*runs.commits()] and runs.latest() == second and runs.commit(first) == 0
    good = [k for k in range(40) if k % 9]
    assert sorted(r.row for r in runs.read(second, "persist", "facts").collect()) == good and pinned.count() == len([k for k in good if k < 20])
    assert {r.n_rows for r in runs.read(second, "derive", "activity").collect()} == {len(good)}
    changed = placement(spark, 5).withColumn("cells", F.transform("cells", lambda c: F.when(c == "Lagos", "Abuja").otherwise(c)))
    with pytest.raises(ValueError, match="REPLAY_DRIFT"):
        jobs.drive(runs, changed, "third")
    assert runs.commits() == [first, second]


def test_run_ids_follow_inputs():
    assert run_id(a=1, b="x") == run_id(b="x", a=1) != run_id(a=1, b="y")


def test_alias_import_equals_the_full_rebuild(spark):
    draw = random.Random(5)
    names = spark.createDataFrame([(f"Port {k}", f"st{k % 6}") for k in range(120)], "label string, state string")
    aliases = spark.createDataFrame([(f"port {k}", f"ap{k % 7}", k % 2) for k in range(0, 120, 2)] + [("port 4", "ap9", 2)], "key string, airport string, rank int")
    anchors = spark.createDataFrame([("st0", "apx"), ("st1", None), ("st2", "apy")], "state string, airport string")
    later = spark.createDataFrame([("st0", "apx"), ("st1", "apz"), ("st2", "apy")], "state string, airport string")
    before = parse.airport_links(names, aliases, anchors)
    manual = spark.createDataFrame([(k, f" PORT {draw.randrange(120)} ", f"man{k}") for k in range(12)] + [(50, "Port 0", "ap0"), (51, "??", "none")], "alias_id int, literal string, airport string")
    merged, after, affected = rebuild.import_airport_aliases(before, names, aliases, manual, later, anchors)
    assert contents(after) == contents(parse.airport_links(names, merged, later))
    keys = {" ".join(r.literal.split()).lower() for r in manual.where("alias_id < 50").collect()}
    reached = {(r.label, r.state) for r in affected.collect()}
    # "port 0" is linked to the airport it had, so it is not touched; of st1 only labels without an alias are.
    assert reached == {(f"Port {k}", f"st{k % 6}") for k in range(120) if f"port {k}" in keys or (k % 6 == 1 and k % 2 == 1)} and len(reached) < 40
    assert rebuild.import_airport_aliases(after, names, merged, manual, later)[2].count() == 0


def test_overrides_reach_their_literals_and_go_back(spark):
    held = spark.createDataFrame([(k, f" L{k % 5}", "auto", "automatic", "auto") for k in range(20)], "record_id int, literal string, airport_id string, method string, automatic string")
    none = spark.createDataFrame([], "alias_id int, literal string, airport_id string")
    manual = spark.createDataFrame([(2, "L1", "b"), (1, "L1 ", "a"), (3, "L9", "c")], "alias_id int, literal string, airport_id string")
    after, again = rebuild.import_manual_overrides(held, manual, none)
    assert sorted(r.record_id for r in again.collect()) == [1, 6, 11, 16]
    got = {r.record_id: (r.airport_id, r.method) for r in after.collect()}
    assert got[6] == ("a", "manual_review") and got[2] == ("auto", "automatic") and len(got) == 20
    back, again = rebuild.import_manual_overrides(after, none, manual)
    assert contents(back) == contents(held) and again.count() == 4
    assert rebuild.import_manual_overrides(after, manual, manual)[1].count() == 0


def test_changed_rows(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", None), ("w", 4), ("z", 5)], "k string, v int")
    assert sorted(r.k for r in rebuild.changed_rows(a, b, ["k"]).collect()) == ["w", "x", "z"] and rebuild.changed_rows(a, a, ["k"]).count() == 0


def test_issues_as_a_stream_equal_the_batch(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"d{k}", f"2026-01-01 {k // 60:02}:{k % 60:02}:00", f"s{k % 4}", 2020 + k % 3, k // 3, k, k / 2) for k in range(90)]
    schema = "delivery_id string, at timestamp, source string, year long, revision long, n_rows long, total double"
    table = spark.createDataFrame(rows, "delivery_id string, at string, source string, year long, revision long, n_rows long, total double").withColumn("at", F.to_timestamp("at"))
    want = contents(issues.current_issues(table))
    shuffled = [*rows, *draw.sample(rows, 30)]
    draw.shuffle(shuffled)
    for k in range(4):
        part = spark.createDataFrame(shuffled[k::4], "delivery_id string, at string, source string, year long, revision long, n_rows long, total double").withColumn("at", F.to_timestamp("at"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key, store = issues.STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = issues.issue_changes(stream, "1 day").writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert contents(issues.folded(changes)) == want
    n = changes.groupBy("source", "year").agg(F.count_if(F.col("status") == "current").alias("c"), F.count_if(F.col("status") == "superseded").alias("s"), F.count_distinct("sequence").alias("q")).collect()
    assert all(r.c == r.s + 1 == r.q for r in n) and len(n) == 12
