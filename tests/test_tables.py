"""Stored tables, streams into them, and state: what is there before and after, and when something fails."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.sources import sinks, tables
from stratalens.streaming import latest, streams

SCHEMA = "id bigint, ticker string, text string, embedding array<float>"


def _rows(n=60):
    names = ["AAA", "B/B", "ü=1", "", None]
    return [(i, names[i % 5], f"text {i}" if i % 7 else None, [1.0, float(i)] if i % 3 == 0 else None) for i in range(n)]


@pytest.fixture()
def table(spark, tmp_path):
    return tables.Table(spark, f"file://{tmp_path}/table", SCHEMA, "ticker")


def _read(table, *args):
    return sorted(((r.id, r.ticker, r.text, r.embedding) for r in table.read(*args).collect()), key=lambda r: r[0])


def test_rows_come_back_from_all_or_some_partitions(spark, table):
    assert table.read().count() == 0 and table.version() == 0
    assert table.append(spark.createDataFrame(_rows(), SCHEMA)) == 60
    assert table.append(spark.createDataFrame(_rows(5), SCHEMA).withColumn("id", F.col("id") + 100)) == 5
    assert _read(table) == _rows() + [(i + 100, *x) for i, *x in _rows(5)]
    for value in ("AAA", "B/B", "ü=1", "", None):
        assert {r[1] for r in _read(table, None, [value])} == {value}
    assert _read(table, None, ["missing"]) == [] and _read(table, 1) == _rows()


def test_fill_and_delete_count_and_touch_only_their_partitions(spark, table):
    table.append(spark.createDataFrame(_rows(), SCHEMA))
    before = table.state()["partitions"]
    embed = lambda t: F.when(t.isNotNull(), F.array(F.length(t).cast("float")))
    missing = [r for r in _rows() if r[3] is None]
    assert sinks.fill_stored_embeddings(table, embed, "AAA") == sum(r[1] == "AAA" for r in missing)
    after = table.state()["partitions"]
    assert {k for k in before if before[k] != after[k]} == {"=AAA"}
    assert sinks.fill_stored_embeddings(table, embed, "AAA") == sum(r[1] == "AAA" and r[2] is None for r in missing)
    assert _read(table) == [(i, t, x, e if e is not None or t != "AAA" or x is None else [float(len(x))]) for i, t, x, e in _rows()]
    assert sinks.delete_company(table, "B/B") == 12 and sinks.delete_company(table, "B/B") == 0
    assert {r[1] for r in _read(table)} == {"AAA", "ü=1", "", None}
    assert table.delete(F.col("id") < 10) == 8 and table.delete(F.col("text") == "nothing") == 0
    assert _read(table, 1) == _rows()  # the first version is still what it was


def test_a_failing_task_leaves_the_old_state(spark, table):
    table.append(spark.createDataFrame(_rows(), SCHEMA))
    state = table.state()
    with pytest.raises(Exception, match="no model"):
        table.fill("embedding", F.when(F.col("id") == 7, F.raise_error(F.lit("no model")).cast("array<float>")).otherwise(F.array(F.lit(1.0).cast("float"))))
    assert table.state() == state and _read(table) == _rows()
    with pytest.raises(Exception, match="no rows"):
        table.append(spark.createDataFrame(_rows(), SCHEMA).withColumn("id", F.raise_error(F.lit("no rows")).cast("bigint")))
    assert table.version() == 1


def test_two_writers_both_count(spark, table, monkeypatch):
    """Another commit between a writer's read and its own: the second starts again from the new state."""
    table.append(spark.createDataFrame(_rows(), SCHEMA))
    other = tables.Table(spark, table.path, SCHEMA, "ticker")
    write, done = table._write, []

    def slow(df):
        out = write(df)
        if not done:
            done.append(other.delete(F.col("id") == 1))
        return out

    monkeypatch.setattr(table, "_write", slow)
    assert table.delete(F.col("id") < 5) == 4 and done == [1]
    assert [r[0] for r in _read(table)] == list(range(5, 60)) and table.version() == 3
    with pytest.raises(tables.Conflict):
        table._commit(3, table.state())


def test_vacuum_drops_what_no_version_holds(spark, table):
    table.append(spark.createDataFrame(_rows(), SCHEMA))
    table.delete(F.col("id") < 30)
    table.delete(F.col("ticker") == "AAA")
    rows = _read(table)
    assert table.vacuum(hours=24) == 0
    assert table.vacuum(hours=-1) == 2  # the first version's files, and the folder of a partition of which nothing is left
    assert _read(table) == rows


def test_a_batch_that_comes_again_adds_nothing(spark, table):
    df = spark.createDataFrame(_rows(), SCHEMA)
    assert [table.append(df, ("s", 0)), table.append(df, ("s", 0)), table.append(df, ("other", 0)), table.append(df, ("s", 1)), table.append(df, ("s", 0))] == [60, 0, 60, 60, 0]
    assert table.read().count() == 180


def test_arriving_files_are_stored_once(spark, tmp_path):
    """Files in two goes, one of them bad; the stream stops between the table and its status, and the batch comes again."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = tables.Table(spark, f"file://{tmp_path}/rows", "path string, line string", "path")
    status = tables.Table(spark, f"file://{tmp_path}/status", streams.STATUS, "status")

    def parse(files):
        bad = F.col("content").contains("BAD")
        lines = F.when(bad, F.array(F.lit(""))).otherwise(F.filter(F.split("content", "\n"), lambda x: x != ""))
        return files.select("path", F.when(bad, F.lit("no filing")).alias("error"), F.explode(lines).alias("line"))

    def go():
        q = streams.ingest(streams.arriving_files(spark, str(folder), "*.txt"), parse, rows, status, "in", f"{tmp_path}/check")
        q.awaitTermination()

    (folder / "a.txt").write_text("one\ntwo\n")
    (folder / "b.txt").write_text("BAD")
    (folder / "c.txt").write_text("\n")
    (folder / "d.csv").write_text("not asked for")
    append, calls = status.append, []

    def breaks(df, batch=None):
        calls.append(batch)
        if len(calls) == 1:
            raise RuntimeError("the driver stops here")
        return append(df, batch)

    status.append = breaks
    with pytest.raises(Exception, match="stops here"):
        go()
    assert rows.read().count() == 2 and status.read().count() == 0
    go()
    (folder / "e.txt").write_text("three")
    go()
    assert sorted(r.line for r in rows.read().collect()) == ["one", "three", "two"]
    said = {r.path[-5:]: (r.status, r.error, r.rows) for r in status.read().collect()}
    assert said == {"a.txt": ("processed", None, 2), "b.txt": ("failed", "no filing", 0), "c.txt": ("empty", None, 0), "e.txt": ("processed", None, 1)}


FILINGS = "ticker string, filing_date date, source_file string, filing_type string, arrived timestamp"


def _run(spark, tmp_path, parts, name, idle=10**6, late="1 day"):
    """Every batch's output of the stream over parts, one file a batch."""
    folder = tmp_path / name
    for i, part in enumerate(parts):
        spark.createDataFrame(part, FILINGS).coalesce(1).write.mode("append").parquet(f"file://{folder}/{i:03d}")
    out = []
    with latest.state_store(spark):
        for i in range(len(parts)):
            stream = spark.readStream.schema(FILINGS).parquet(f"file://{folder}/{{{','.join(f'{k:03d}' for k in range(i + 1))}}}")
            q = latest.latest_filings(stream, idle, late).writeStream.outputMode("update").foreachBatch(lambda df, n: out.append(df.collect())).option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
            q.awaitTermination()
    return out


def test_state_equals_batch_in_any_order_of_arrival(spark, tmp_path):
    import datetime as dt

    r = random.Random(4)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [(f"T{r.randrange(6)}", r.choice([None, *map(day, range(20))]), r.choice([None, f"f{r.randrange(9)}"]), r.choice(["10-K", "8-K"]), dt.datetime(2024, 3, 1, 0, i % 60)) for i in range(120)]
    # a date and a name say which form it is, so that ties are the same filing
    rows = [(t, d, s, "10-K" if hash((str(d), s)) % 2 else "8-K", a) for t, d, s, _, a in rows]
    want = {tuple(x) for x in latest.batch_latest(spark.createDataFrame(rows, FILINGS)).collect()}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        last = {}
        for batch in _run(spark, tmp_path, [rows[:50], rows[50:]], f"order{seed}"):
            last |= {x.ticker: x for x in batch}
        assert {(x.ticker, x.filing_date, x.source_file, x.filing_type, x.n_filings) for x in last.values()} == want
        assert {x.status for x in last.values()} == {"latest"}


def test_companies_that_are_not_heard_of_expire(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
    one = [("A", dt.date(2024, 1, 1), "a", "10-K", at(0)), ("B", dt.date(2024, 1, 2), "b", "8-K", at(0))]
    two = [("B", dt.date(2023, 1, 1), "late", "8-K", at(60))]
    three = [("A", dt.date(2022, 1, 1), "again", "10-Q", at(61))]
    seen = [(x.ticker, x.status, x.source_file, x.n_filings) for batch in _run(spark, tmp_path, [one, two, three], "idle", 48 * 3600, "1 hour") for x in batch]
    assert ("A", "expired", "a", 1) in seen and ("B", "latest", "b", 2) in seen or ("B", "expired", "b", 1) in seen
    assert seen[-1][0] == "A" and ("A", "latest", "again", 1) in seen
