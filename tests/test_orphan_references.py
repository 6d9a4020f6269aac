from datetime import datetime

import pytest

from corpusloom import runtime
from corpusloom.operators import orphan_references
from corpusloom.operators.orphan_references import Edge, cascade, cascade_report

A, B = datetime(2026, 1, 5), datetime(2026, 2, 5)


def tables(spark, chunks, cards):
    return {
        "chunks": spark.createDataFrame(chunks, "chunk_id string, source_id string, created_at timestamp, ref string"),
        "cards": spark.createDataFrame(cards, "card_id string, ids array<string>, created_at timestamp, via string"),
    }


KEYS = {"chunks": "chunk_id", "cards": "card_id"}
EDGES = [Edge("cards", "ids", "chunks")]


def references(spark, chunks, cards, gone=()):
    log = {"chunks": spark.createDataFrame([(g,) for g in gone], "chunk_id string")}
    return {(r.record_id, r.ref, r.period, r.reason) for r in cascade(tables(spark, chunks, cards), KEYS, EDGES, log).references.collect()}


def test_reasons_and_spelling_of_ids(spark):
    chunks = [("C_1", "s", A, "x"), ("c_2 ", "s", B, "x"), ("C_2", "s", B, "x")]
    cards = [("K", ["Ｃ＿１", "　c_2\n", "C_3", "C_4", "c_4", "", None], A, "x"), ("L", None, A, "x"), (None, ["C_9"], A, "x"), ("K", ["C_4"], A, "x")]
    want = {("K", "C_2", "2026-01", "late"), ("K", "C_3", "2026-01", "deleted"), ("K", "C_4", "2026-01", "missing")}
    assert references(spark, chunks, cards, ["c_3", "C_1", "C_1", None]) == want


def test_empty_tables(spark):
    assert references(spark, [], []) == set()
    assert references(spark, [], [("K", ["C"], A, "")]) == {("K", "C", "2026-01", "missing")}


@pytest.mark.parametrize("hot", [runtime.HOT_ROWS, 1])
def test_inherited_orphans_circles_and_report(spark, monkeypatch, hot):
    monkeypatch.setattr(orphan_references, "joined_hot", lambda *a: runtime.joined_hot(*a, hot))
    nodes = [("a", "gone", A), ("b", "a", A), ("c", "b", B), ("d", "d", A), ("e", "f", A), ("f", "e", A), ("g", None, A), ("c", "b", B), ("c", "a", A)]
    t = {"nodes": spark.createDataFrame(nodes, "id string, parent string, created_at timestamp")}
    found = cascade(t, {"nodes": "id"}, [Edge("nodes", "parent", "nodes")])
    assert {(r.record_id, r.kind, r.round) for r in found.records.collect()} == {("A", "direct", 0), ("B", "inherited", 1), ("C", "inherited", 1)}
    assert {tuple(r) for r in cascade_report(found).collect()} == {("nodes", "2026-01", "direct", 1), ("nodes", "2026-01", "inherited", 2)}
    chain = {"nodes": spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else "gone", A) for k in range(5)], "id string, parent string, created_at timestamp")}
    assert {(r.record_id, r.round) for r in cascade(chain, {"nodes": "id"}, [Edge("nodes", "parent", "nodes")]).records.collect()} == {(f"N{k}", k) for k in range(5)}
    with pytest.raises(ValueError):
        cascade(chain, {"nodes": "id"}, [Edge("nodes", "parent", "nodes")], most_rounds=3)
