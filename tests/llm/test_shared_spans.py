import random

import numpy as np
import pytest

from corpusloom import runtime
from corpusloom.llm import shared_spans as S

SCHEMA = "chunk_id string, text string, rid string, content string"


def brute(tables):
    spans, out = {}, {}
    rows = {(t, i, x) for t, part in tables.items() for i, x in part if i is not None and x}
    for _, i, x in rows:
        for p in range(len(x) - S.SPAN + 1):
            spans.setdefault(x[p : p + S.SPAN], set()).add(i)
    for t, i, x in rows:
        covered = set()
        for p in range(len(x) - S.SPAN + 1):
            if len(spans[x[p : p + S.SPAN]]) > 1:
                covered.update(range(p, p + S.SPAN))
        if covered:
            out[t, i] = len(covered)
    return out


def run(spark, tables):
    frames = {t: spark.createDataFrame([(i, x, "r", "c") for i, x in part], SCHEMA) for t, part in tables.items()}
    got = {(r.record_table, r.chunk_id): r.shared_chars for r in S.shared_report(frames).collect()}
    assert {tuple(r) for r in S.records_with_shared_spans(frames).collect()} == set(got)
    return got


@pytest.mark.parametrize("hot", [runtime.HOT_ROWS, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "joined_hot", lambda *a: runtime.joined_hot(*a, hot))
    random.seed(4)
    word = lambda n: "".join(random.choice("あいうえおかきくけこ\nab") for _ in range(n))
    passages = [word(n) for n in (58, 59, 60, 61, 90, 400)]
    tables = {"one": [], "two": []}
    for k in range(60):
        text = word(random.randint(0, 80)) + random.choice(passages)[random.randint(0, 3) :] + word(random.randint(0, 80))
        tables[random.choice(["one", "two"])].append((f"c{k}", text))
    tables["one"] += [("none", None), ("empty", ""), ("short", "あ" * 59), (None, passages[-1])]
    assert run(spark, tables) == brute(tables)


def test_redelivered_rows_and_repeats_inside_a_record_are_not_shared(spark):
    text = "".join(chr(0x4E00 + k) for k in range(100))
    assert run(spark, {"one": [("a", text), ("a", text), ("b", "x" * 300)], "two": [("a", text)]}) == {}


def test_many_copies_very_long_text_and_one_letter(spark):
    random.seed(6)
    passage = "".join(random.choice("abcdefgh") for _ in range(200))
    long = "".join(random.choice("ijklmnop") for _ in range(200_000))
    tables = {"one": [(f"c{k}", f"{k:03d}" + passage + "!" * (k % 3)) for k in range(300)] + [("long", long + passage), ("y1", "y" * 500), ("y2", "y" * 70)], "two": []}
    got = run(spark, tables)
    assert got["one", "long"] == 200 and got["one", "y1"] == 500 and got["one", "y2"] == 70 and len(got) == 303


def test_empty_tables(spark):
    assert run(spark, {"one": [], "two": []}) == {}


def test_cartesian_tree_against_its_definition():
    random.seed(7)
    for n in (1, 2, 50, 300):
        for top in (3, 10**6):
            v = np.array([random.randint(0, top) for _ in range(n)], np.uint64)
            before, after = S.cartesian_tree(v)
            for i in np.flatnonzero(v):
                assert before[i] == max((j for j in range(i) if v[j] <= v[i]), default=-1)
                assert after[i] == min((j for j in range(i + 1, n) if v[j] < v[i]), default=n)


def test_one_id_with_two_texts(spark):
    random.seed(8)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    a, b = word(100), word(100)
    tables = {"one": [("a", a), ("a", a), ("b", "x" + b)], "two": [("a", b), ("c", word(20) + a[:70])]}
    assert run(spark, tables) == brute(tables) and len(brute(tables)) == 4
