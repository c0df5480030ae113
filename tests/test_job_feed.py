import datetime
import json
import random

import pytest

from skerry.streaming import feeds, job_feed

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def page(url, after=None, items=1, status=200):
    return (url, status, after, [(f"{url}-{k}", "ACTIVE", "Firma", START) for k in range(items)])


@pytest.mark.parametrize(
    ("pages", "most", "read", "report"),
    [
        ([page("a", "b"), page("b", "c"), page("c"), page("x", "a")], 450, "abc", ("available", 3, 3, None)),
        ([page("a", "b"), page("b", "c", 0), page("c")], 450, "ab", ("available", 2, 1, None)),
        ([page("a", "b"), page("b", "c", 1, 500), page("c")], 450, "ab", ("available", 1, 1, "Feed read stopped early after 1 pages: 500")),
        ([page("a", "b"), page("b", "lost")], 450, "ab", ("available", 2, 2, "Feed read stopped early after 2 pages: a page was not saved")),
        ([page("a", "b", 1, 503)], 450, "a", ("failed", 0, 0, "Feed page failed: 503")),
        ([page("b")], 450, "", ("failed", 0, 0, "Feed page failed: not saved")),
        ([page("a", "b"), page("b", "a")], 450, "ab", ("available", 2, 2, "Feed read stopped early after 2 pages: it came back to a page")),
        ([page(chr(97 + k), chr(98 + k)) for k in range(20)], 7, "abcdefg", ("available", 7, 7, None)),
    ],
)
def test_pages_of_a_read(spark, pages, most, read, report):
    got = job_feed.read_pages(spark.createDataFrame(pages, job_feed.PAGE), "a", most)
    assert [r["url"] for r in got.orderBy("place").collect()] == list(read)
    assert tuple(job_feed.read_report(got, "a", most).first()) == report


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(2)
    pages = []
    for p in range(6):
        items = [{"uuid": f"u{r.randint(0, 25)}", "status": r.choice(["ACTIVE", "ACTIVE", "INACTIVE"]), "business_name": f"F{p}", "modified": (START + (p * 5 + r.random() * 4) * DAY).isoformat(timespec="milliseconds")} for _ in range(12)]
        pages.append({"url": f"/{p}", "status": 200, "next_url": f"/{p + 1}", "place": p, "items": items + [{"uuid": None, "status": "ACTIVE", "business_name": "x", "modified": START.isoformat()}]})
    seen = []

    def run():
        changes = job_feed.latest_jobs(job_feed.entries(job_feed.saved_pages(spark, str(tmp_path / "in"))), 14 * DAY)
        keep = lambda batch, number: seen.extend((number, *x) for x in batch.collect())
        changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    (tmp_path / "in").mkdir()
    for p in pages[:3]:
        (tmp_path / "in" / f"{p['place']}.json").write_text(json.dumps(p))
    run()
    first = len(seen)
    for p in pages[3:]:
        (tmp_path / "in" / f"{p['place']}.json").write_text(json.dumps(p))
    run()
    assert 0 < first < len(seen)
    last = {x[1]: x for x in sorted(seen, key=lambda x: x[0])}
    log = job_feed.entries(spark.read.schema(job_feed.PAGE + ", place int").json(str(tmp_path / "in")))
    wanted = {x["uuid"]: (x["sequence"], x["business_name"]) for x in job_feed.active_jobs(log, 14 * DAY).collect()}
    assert {u: (x[3], x[5]) for u, x in last.items() if x[6] == "active"} == wanted and wanted
    assert any(x[6] == "expired" for x in last.values()) and any(x[6] == "inactive" for x in last.values())


def test_events_once_and_by_window(spark, tmp_path):
    rows = [(1, START), (1, START), (2, START + DAY), (3, START + DAY * 3)]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    feeds.deduplicated(read(), ["k"], "ts", "1 day").writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x["k"] for x in spark.table("once").collect()) == [1, 2, 3]
    feeds.activity(read(), "ts", "k", "1 day", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((x["k"], x["window_start"], x["n"]) for x in spark.table("windows").collect()) == [(1, START, 2), (2, START + DAY, 1), (3, START + DAY * 3, 1)]
