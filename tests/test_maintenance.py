from pyspark.sql import functions as F

from docloom.operators import catalog_deltas, incremental
from docloom.sources.bucketed_cache import BucketedCache
from docloom.sources.bucketed_chunks import BucketedChunks

SCHEMA = "user_id int, source string, chunk_index int, content_hash string, chunk string"


def rows(spark, users=2, files=40, chunks=5, mark="a"):
    return spark.createDataFrame([(u, f"f{f}", k, mark, f"{u} {f} {k}") for u in range(users) for f in range(files) for k in range(chunks)], SCHEMA)


def state(frame):
    return sorted((r.user_id, r.source, r.chunk_index, r.content_hash, r.chunk) for r in frame.collect())


def test_an_update_equals_replace_modified_and_touches_only_its_buckets(spark, tmp_path):
    table = BucketedChunks(spark, str(tmp_path / "t"), 20, SCHEMA)
    first = rows(spark)
    table.append(first)
    assert state(table.read()) == state(first) and {r.n_buckets for r in table.sizes().collect()} == {10}
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    fresh = spark.createDataFrame([(0, "f3", 0, "b", "new"), (1, "f9", 0, "b", "never stored"), (5, "x", 0, "b", "a new user")], SCHEMA)
    modified = spark.createDataFrame([(0, "f4", "b")], "user_id int, source string, content_hash string")
    gone = spark.createDataFrame([(1, "f7")], "user_id int, source string")
    failed = spark.createDataFrame([(1, "f9", "broken")], "user_id int, source string, error string")
    report = {(r.user_id, r.bucket): r.n_rows for r in table.update(fresh, modified, gone, failed).collect()}
    expected = incremental.replace_modified(incremental.delete_sources(first, gone), fresh, failed, modified)
    assert state(table.read()) == state(expected)
    assert len(report) <= 5 and sum(report.values()) < 200
    touched = {f"user_id={u}/bucket={b}" for u, b in report}
    for path, stamp in stamps.items():
        if not any(part in str(path) for part in touched):
            assert path.exists() and path.stat().st_mtime_ns == stamp
    assert {r.user_id: r.n_buckets for r in table.sizes().collect()} == {0: 10, 1: 10, 5: 1}


def test_emptied_buckets_go(spark, tmp_path):
    table = BucketedChunks(spark, str(tmp_path / "t"), 1000, SCHEMA)
    table.append(rows(spark))
    gone = rows(spark).where("user_id = 1").select("user_id", "source")
    report = table.update(rows(spark).limit(0), gone=gone)
    assert [(r.user_id, r.n_rows) for r in report.collect()] == [(1, 0)]
    assert {r.user_id for r in table.read().collect()} == {0} and not (tmp_path / "t" / "user_id=1" / "bucket=0").exists()
    assert table.update(rows(spark).limit(0)).count() == 0


def test_sizes_are_counted_without_bringing_a_user_to_one_task(spark, tmp_path):
    table = BucketedChunks(spark, str(tmp_path / "t"), 20, SCHEMA)
    table.append(rows(spark))
    more = rows(spark, users=3, files=80)
    assert [tuple(r) for r in table.new_sizes(more).collect()] == [(2, 20)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = table.new_sizes(more)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_changed_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docloom.sources.bucketed_chunks.LISTED", 1)
    table = BucketedChunks(spark, str(tmp_path / "t"), 20, SCHEMA)
    table.append(rows(spark))
    fresh = rows(spark, chunks=1, mark="z")
    table.update(fresh)
    assert state(table.read()) == state(fresh)


def test_changed_partitions_prune_the_scan(spark, tmp_path):
    table = BucketedChunks(spark, str(tmp_path / "t"), 20, SCHEMA)
    table.append(rows(spark))
    plan = table.partitions(spark.createDataFrame([(0, 3), (0, 4), (1, 2)], "user_id int, bucket int"))._jdf.queryExecution().executedPlan().toString()
    filters = plan.partition("PartitionFilters:")[2].partition("PushedFilters")[0]
    assert "user_id" in filters and "bucket" in filters


def test_the_cache_side_is_not_shuffled(spark, tmp_path):
    cache = BucketedCache(spark, f"{tmp_path}/cache", "size int", 4)
    made = spark.createDataFrame([(f"d{i:03}", i) for i in range(100)] * 2, "digest string, size int")
    cache.add(made)
    cache.add(made.where("size < 50").withColumn("size", F.lit(-1)))  # known ones keep their value
    assert cache.read().count() == 100 and cache.read().agg(F.sum("size")).first()[0] == 4950
    cache.add(spark.createDataFrame([("more", 7)], "digest string, size int"))
    asked = spark.createDataFrame([("d001", "x"), ("more", "y"), ("none", "z"), ("none", "z")], "digest string, content string")

    def check():
        assert sorted(((r.digest, r["size"], r.hit) for r in cache.look_up(asked).collect()), key=str) == [("d001", 1, True), ("more", 7, True)] + [("none", None, False)] * 2
        assert sorted(map(tuple, cache.misses(asked, "content").collect())) == [("none", "z")]
        lines = cache.look_up(asked)._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(k for k, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x)
        join = max(k for k, x in enumerate(lines[:scan]) if "SortMergeJoin" in x)
        depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
        way = [x for x in lines[join + 1 : scan] if len(x) - len(x.lstrip(" :+-")) < depth and not x.lstrip(" ").startswith(":")]
        assert not [x for x in way if "Exchange" in x], lines

    check()
    cache.compact()
    check()
    again = BucketedCache(spark, f"{tmp_path}/cache", "size int", 4)
    assert again.read().count() == 101
    spark.sql(f"DROP TABLE {cache.name}")  # a new session knows nothing of it
    assert again.read().count() == 101


def test_totals_follow_changes(spark):
    kinds = "user_id int, file_type string, source string, chunk_index int"
    frame = lambda *r: spark.createDataFrame(list(r), kinds)
    totals = catalog_deltas.totals_of(frame((1, ".txt", "a", 0), (1, ".txt", "a", 1), (1, None, "b", 0), (2, ".md", "c", 0)))
    before = frame((1, ".txt", "a", 0), (1, ".txt", "a", 1), (2, ".md", "c", 0))
    after = frame((1, ".txt", "a", 0), (1, ".txt", "d", 0), (1, None, "e", 0), (3, ".md", "c", 0))
    now = catalog_deltas.merged(totals, catalog_deltas.file_changes(before, after))
    report = sorted(tuple(r) for r in catalog_deltas.type_report(now).collect())
    assert report == [(1, ".txt", 2, 2, 2), (1, "unknown", 2, 2, 2), (3, ".md", 1, 1, 1)]
    assert sorted(map(tuple, catalog_deltas.user_report(now).collect())) == [(1, 4, 4), (3, 1, 1)]
    assert catalog_deltas.stale(now).count() == 0
    gone = catalog_deltas.merged(now, catalog_deltas.file_changes(frame((1, None, "b", 0)), frame()))
    assert [tuple(r) for r in catalog_deltas.stale(gone).collect()] == [(1, None)]
    left = frame((1, None, "e", 0), (1, ".txt", "a", 0), (1, ".txt", "d", 0), (3, ".md", "c", 0))
    whole = catalog_deltas.rebuilt(gone, left)
    assert sorted(tuple(r) for r in catalog_deltas.type_report(whole).collect()) == [(1, ".txt", 2, 2, 2), (1, "unknown", 1, 1, 1), (3, ".md", 1, 1, 1)]
