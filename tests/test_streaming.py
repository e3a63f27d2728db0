import random
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadloom.operators import candidates
from leadloom.operators.extraction import observations
from leadloom.streaming import ingest

T0 = datetime(2024, 1, 1)


def write(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(folder)


def test_streams_pick_up_where_they_left_off(spark, tmp_path):
    pages, work = str(tmp_path / "pages"), str(tmp_path / "work")
    first = [(0, "https://a.com/", "<title>A</title>"), (1, "https://www.a.com/1", "<a href='mailto:x@a.com'>")]
    second = [(2, "https://b.com/", "<title>B</title>"), (3, "https://a.com/", "<title>A2</title>")]
    hours = iter(range(10))

    def clock():
        return F.lit(f"2024-01-01 0{next(hours)}:00:00").cast("timestamp")

    def run():
        stream = ingest.page_stream(spark, pages)
        ingest.start_discovery(stream, f"{work}/domains", f"{work}/c1").awaitTermination()
        ingest.start_ingest(stream, f"{work}/obs", f"{work}/cache", f"{work}/c2", clock).awaitTermination()
        domains = [r[0] for r in ingest.read_domains(spark, f"{work}/domains").collect()]
        cache = {r.url: r.content_hash for r in ingest.read_page_cache(spark, f"{work}/cache").collect()}
        return sorted(domains), ingest.read_observations(spark, f"{work}/obs"), cache

    assert ingest.read_page_cache(spark, f"{work}/cache").count() == ingest.read_observations(spark, f"{work}/obs").count() == 0
    assert ingest.read_domains(spark, f"{work}/domains").count() == 0
    write(spark, pages, first)
    domains, seen, cache = run()
    assert domains == ["a.com"] and seen.count() == 2 and len(cache) == 2
    write(spark, pages, second)
    domains, seen, cache = run()
    everything = spark.createDataFrame(first + second, "page_seq long, url string, raw_html string")
    assert domains == ["a.com", "b.com"]
    assert sorted(seen.collect()) == sorted(observations(everything).collect())
    assert len(cache) == 3 and cache["https://a.com/"] == spark.range(1).select(F.sha2(F.lit(second[1][2]), 256)).first()[0]


def test_a_compacted_cache_needs_only_later_batches(spark, tmp_path):
    pages, cache = str(tmp_path / "pages"), str(tmp_path / "cache")

    def run(*rows):
        write(spark, pages, rows)
        ingest.start_ingest(ingest.page_stream(spark, pages), str(tmp_path / "obs"), cache, str(tmp_path / "c"),
                            lambda: F.lit("2024-01-01 00:00:00").cast("timestamp")).awaitTermination()
        return sorted(map(tuple, ingest.read_page_cache(spark, cache).collect()))

    run((0, "https://a.com/", "one"), (1, "https://b.com/", "two"))
    before = run((2, "https://a.com/", "three"))
    ingest.compact_page_cache(spark, cache)
    for batch in (0, 1):
        shutil.rmtree(f"{cache}/batch={batch}")
    assert sorted(map(tuple, ingest.read_page_cache(spark, cache).collect())) == before
    after = run((3, "https://c.com/", "four"))
    assert len(after) == 3 and set(before) <= set(after)
    ingest.compact_page_cache(spark, cache)
    shutil.rmtree(f"{cache}/batch=2")
    assert sorted(map(tuple, ingest.read_page_cache(spark, cache).collect())) == after


def test_discovery_keeps_no_state_and_reads_touched_folders(spark, tmp_path):
    pages, out, checkpoint = str(tmp_path / "pages"), str(tmp_path / "out"), tmp_path / "c"
    for first in (0, 20):
        write(spark, pages, [(i, f"https://d{i % 30}.com/{i}", "") for i in range(first, first + 20)])
        ingest.start_discovery(ingest.page_stream(spark, pages), out, str(checkpoint)).awaitTermination()
    assert sorted(r[0] for r in ingest.read_domains(spark, out).collect()) == sorted(f"d{i}.com" for i in range(30))
    assert not (checkpoint / "state").exists()  # no stateful operator
    ingest._domain_batch(out, None)(spark.createDataFrame([(f"https://d{i % 30}.com/{i}",) for i in range(20, 40)], "url string"), 1)
    assert ingest.read_domains(spark, out).count() == 30  # a batch that is repeated overwrites itself
    assert 0 < ingest.read_domains(spark, out, buckets=[3, 4]).count() < 30
    ingest.compact_domains(spark, out)
    for batch in (0, 1):
        shutil.rmtree(f"{out}/batch={batch}")
    write(spark, pages, [(50, "https://d3.com/", ""), (51, "https://new.com/", "")])
    ingest.start_discovery(ingest.page_stream(spark, pages), out, str(checkpoint)).awaitTermination()
    assert ingest.read_domains(spark, out).count() == 31


def test_known_domains_are_not_new(spark, tmp_path):
    pages, work = str(tmp_path / "pages"), str(tmp_path / "work")
    write(spark, pages, [(0, "https://a.com/", ""), (1, "https://b.com/", ""), (2, "https://b.com/1", "")])
    known = spark.createDataFrame([("a.com",)], "canonical_domain string")
    ingest.start_discovery(ingest.page_stream(spark, pages), f"{work}/d", f"{work}/c", known).awaitTermination()
    assert [r[0] for r in ingest.read_domains(spark, f"{work}/d").collect()] == ["b.com"]


def test_states_of_late_and_repeated_outcomes(spark, tmp_path):
    rng = random.Random(2)
    log = [(rng.choice([*[0] * 50, *range(100)]), e, T0 + timedelta(minutes=rng.randrange(200)),
            rng.choice(["success", "blocked", "failed", "failed", "failed", "timeout", "timeout"])) for e in range(300)]
    expected = candidates.states_from_trail(candidates.attempt_trail(spark.createDataFrame(log, ingest.OUTCOMES)))
    folder, state = str(tmp_path / "log"), str(tmp_path / "state")
    assert ingest.read_states(spark, state).count() == 0
    arrived = rng.sample(log, len(log))  # in no order
    for at in range(0, 300, 100):
        rows = arrived[at : at + 100] + rng.choices(arrived[: at + 100], k=40)  # some again
        spark.createDataFrame(rows, ingest.OUTCOMES).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ingest.OUTCOMES).parquet(folder)
        ingest.start_outcomes(stream, state, str(tmp_path / "c"), buckets=4).awaitTermination()
    ingest._outcome_batch(state, 4)(spark.createDataFrame(log[:50], ingest.OUTCOMES), 9)  # a repeated batch
    assert sorted(map(str, ingest.read_states(spark, state).collect())) == sorted(map(str, expected.collect()))
    moment = F.lit(T0 + timedelta(hours=5))
    due = [tuple(r) for r in ingest.due_now(spark, state, moment).collect()]
    assert due == [tuple(r) for r in candidates.due_retries(expected, moment).collect()] and due
