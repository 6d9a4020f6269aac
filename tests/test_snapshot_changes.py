import random
from datetime import datetime, timedelta

from corpusloom.operators.snapshot_changes import SnapshotIndex, snapshot_changes, with_values

SCHEMA = "snapshot_no int, record_table string, record_id string, chunk_hash string, content_sha256 string, delivered_at timestamp, fp string"
T0 = datetime(2026, 1, 1)


def row(no, table, rid, h=None, at=0, sha=None):
    return (no, table, rid, h, sha, T0 + timedelta(seconds=at), "clashing name")


def found(spark, rows):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), 3).collect()}


def test_kinds_of_change_and_gaps_in_numbers(spark):
    rows = [row(1, "source_chunks", "a", "x"), row(1, "source_chunks", "b", "x"), row(4, "source_chunks", "b", " SHA256:Y\n"), row(4, "source_chunks", "c", "z")]
    assert found(spark, rows) == {("source_chunks", "a", 4, "removed"), ("source_chunks", "b", 4, "changed"), ("source_chunks", "c", 4, "added")}


def test_spelling_of_a_hash_and_absent_hashes_are_no_change(spark):
    rows = [row(1, "source_chunks", "a", "ab"), row(2, "source_chunks", "a", "sha256:AB　"), row(1, "source_chunks", "b", "x"), row(2, "source_chunks", "b", None), row(1, "sources", "s", "1"), row(2, "sources", "s", "2"), row(1, "work_editions", "e", None, 0, "p"), row(2, "work_editions", "e", "", 0, "q")]
    assert found(spark, rows) == {("work_editions", "e", 2, "changed")}


def test_latest_delivery_counts_and_repeated_rows_are_one(spark):
    rows = [row(1, "source_chunks", "a", "old", 5), row(1, "source_chunks", "a", "new", 9), row(2, "source_chunks", "a", "new"), row(2, "source_chunks", "a", "new")]
    assert found(spark, rows) == set()


def test_nulls_empty_table_and_one_snapshot(spark):
    assert found(spark, []) == set()
    assert found(spark, [row(1, "source_chunks", "a")]) == set()
    assert found(spark, [row(None, "source_chunks", "a"), row(1, None, "a"), row(1, "source_chunks", None), row(2, "source_chunks", "a")]) == set()


def test_against_brute_force_and_values(spark):
    random.seed(1)
    rows = [row(no, "source_chunks", f"r{k}", random.choice(["h1", "h2", None]), random.randint(0, 3) * 10 + n) for no in (1, 2, 3, 5) for k in range(40) for n in range(random.randint(0, 2))]
    last = {}
    for r in sorted(rows, key=lambda r: r[5]):
        last[r[0], r[2]] = r[3]
    want, values = set(), set()
    for a, b in ((1, 2), (2, 3), (3, 5)):
        for k in {k for _, k in last}:
            old, new = (a, k) in last, (b, k) in last
            x, y = last.get((a, k)), last.get((b, k))
            kind = "added" if new and not old else "removed" if old and not new else "changed" if x and y and x != y else None
            if kind:
                want.add(("source_chunks", k, b, kind))
            if kind == "changed":
                values.add(("source_chunks", k, b, x, y))
    assert found(spark, rows) == want
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in with_values(snapshot_changes(df, 3), df).collect()} == values


def test_deliveries_may_come_one_at_a_time(spark):
    index = SnapshotIndex(spark, 2)
    index.ingest(spark.createDataFrame([row(1, "source_chunks", "a", "x")], SCHEMA))
    assert index.advance() is None
    index.ingest(spark.createDataFrame([row(2, "source_chunks", "a", "y")], SCHEMA))
    assert [r.change_type for r in index.advance().collect()] == ["changed"]
    assert index.current == 2 and index.pending() == []


def test_late_rows_equal_one_delivery_and_make_both_neighbours_due(spark):
    first = [row(1, "source_chunks", "a", "x"), row(1, "source_chunks", "b", "x"), row(2, "source_chunks", "a", "x"), row(2, "source_chunks", "b", "x", 5), row(3, "source_chunks", "a", "x")]
    late = [row(2, "source_chunks", "c", "z"), row(2, "source_chunks", "b", "y", 9), row(2, "source_chunks", "a", "old", -5)]
    index = SnapshotIndex(spark, 2)
    index.ingest(spark.createDataFrame(first, SCHEMA))
    while index.pending():
        index.advance()
    index.ingest(spark.createDataFrame(late, SCHEMA))
    assert index.pending() == [2, 3]
    got = set()
    while index.pending():
        got |= {tuple(r) for r in index.advance().collect()}
    assert got == found(spark, first + late) and ("source_chunks", "b", 2, "changed") in got and ("source_chunks", "c", 3, "removed") in got
    # A delivery that comes between two others.
    index.ingest(spark.createDataFrame([row(0, "source_chunks", "a", "x")], SCHEMA))
    assert index.pending() == [0, 1]
    # Another index takes up the folder, then all of it goes.
    other = SnapshotIndex(spark, 5, index.folder, current=1)
    assert other.pending() == [2, 3] and {tuple(r) for r in other.advance().collect()} == {r for r in got if r[2] == 2}
    other.close()
    assert SnapshotIndex(spark, 2, other.folder).pending() == []


def test_equal_times_take_the_larger_fingerprint_and_a_hash_before_none(spark):
    two = [row(1, "source_chunks", "a", "x"), row(2, "source_chunks", "a", "x"), row(2, "source_chunks", "a", None)]
    assert found(spark, two) == set()
    both = [row(1, "source_chunks", "a", "x"), row(1, "source_chunks", "a", "y"), row(2, "source_chunks", "a", "y"), row(2, "source_chunks", "a", "x")]
    assert found(spark, both) == set()
