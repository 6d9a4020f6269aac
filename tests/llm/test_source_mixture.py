import random

import pytest

from corpusloom.llm import source_mixture as M

DOC = "doc_id long, source string, text string, tokens long, rate double"
GOAL = "source string, target_share double, max_repeats int"


def frames(spark, docs, goals):
    return spark.createDataFrame([(*d, 0, 0.0) for d in docs], DOC), spark.createDataFrame(goals, GOAL)


def test_shares_and_caps(spark):
    random.seed(1)
    docs = [(k, random.choice(["a", " A ", "b", "b", "b", "c", None, "other"]), "word " * random.randint(1, 60)) for k in range(3000)]
    docs += [(9000, "a", None), (9001, "a", ""), (9002, "", "x")]
    goals = [("a", 0.4, 2), ("b", 0.3, 3), ("c", 0.2, None), ("nowhere", 0.1, 2)]
    d, g = frames(spark, docs, goals)
    mixed = M.mixture(d, g)
    got = {r.source: r for r in M.shares(mixed, g).collect()}
    assert got["nowhere"].actual_share == 0 and set(got) == {"a", "b", "c", "nowhere"}
    for s, share, cap in goals[:3]:
        assert abs(got[s].actual_share - share / 0.9) < 0.0005
        assert got[s].most_copies <= (cap or 10**9)
    rows = mixed.collect()
    assert all(0 <= r.copies <= r.rate + 1 and r.copies >= int(r.rate) for r in rows)
    assert len(rows) == len({r.doc_id for r in rows})


def test_rates_solve_the_dual(spark):
    counted = spark.createDataFrame([(k, "a" if k % 3 else "b", 1 + k % 17) for k in range(600)], "doc_id long, source string, tokens long")
    state = M.balance(counted, {"a": (0.5, 4.0), "b": (0.5, M.NO_CAP)}, 6000.0)
    import math

    for s, l, scale, cap, _ in state:
        tokens = [r.tokens for r in counted.where(f"source = '{s}'").collect()]
        assert math.isclose(sum(t * min(cap, math.exp(l * t / scale)) for t in tokens), 3000.0, rel_tol=1e-6)


def test_out_of_reach_empty_and_double_targets(spark):
    d, g = frames(spark, [(1, "a", "one two three")], [("a", 1.0, 1)])
    with pytest.raises(ValueError):
        M.mixture(d, g, total_tokens=1e6)
    assert M.mixture(d.where("false"), g).count() == 0 and M.mixture(d, g.where("false")).count() == 0
    assert M.shares(M.mixture(d.where("false"), g), g).first().actual_share == 0
    with pytest.raises(ValueError):
        M.mixture(d, g.union(g))


def test_few_documents_reach_their_tokens_within_one_of_them(spark):
    random.seed(2)
    docs = [(k, random.choice("abc"), "word " * random.choice([3, 10, 40, 150])) for k in range(120)]
    d, g = frames(spark, docs, [("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.3, None)])
    mixed = M.mixture(d, g)
    goals = {s: goal for s, *_, goal in M.balance(M.token_counts(d), M._target_rows(g))}
    for r in mixed.groupBy("source").agg({"tokens": "min"}).collect():
        rows = mixed.where(f"source = '{r.source}'").collect()
        assert all(int(x.rate) <= x.copies <= x.rate + 1 for x in rows)
        free = [x.tokens for x in rows if x.rate > int(x.rate)]
        assert not free or abs(sum(x.tokens * x.copies for x in rows) - goals[r.source]) < max(free)
