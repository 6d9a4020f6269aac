import random

import numpy as np

from corpusloom.operators import retrieval, transcripts
from corpusloom.operators.mutations import replaced, revisions, updated
from corpusloom.plans import reference_evidence
from pyspark.sql import functions as F

OWN, OTHER = ["本人"], ["質問者"]
TEXT = "前書き\n[00:01]\n本人：はじめに。\n本人：もう一つ。\n[00:02]\n質問者：一つ目は。\n続き。\n質問者：二つ目は。\n\n[00:05]\n本人: 答え。\n[0:00:07]\n本人：また答え。\n質問者：最後の問い。"


def turns(spark, rows):
    return transcripts.turns(spark.createDataFrame(rows, "doc_id long, text string, turn string"), OWN, OTHER)


def test_turns_pairs_and_monologues(spark):
    spoken = turns(spark, [(1, TEXT, ""), (2, None, ""), (3, "", ""), (4, "質問者：誰も答えない。", ""), (5, "誰の言葉でもない。", "")])
    got = [tuple(r) for r in spoken.where("doc_id = 1").orderBy("turn").select("turn", "speaker", "stamped", "said").collect()]
    assert got[0] == (1, "self", "00:01", "はじめに。") and got[2] == (3, "other", "00:02", "一つ目は。続き。") and got[5][2] == "0:00:07" and len(got) == 7
    assert [tuple(r) for r in transcripts.pairs(spoken).collect()] == [(1, 1, "一つ目は。続き。 二つ目は。", "答え。 また答え。", "00:02", "0:00:07")]
    assert [r.said for r in transcripts.monologues(spoken).orderBy("doc_id", "turn").collect()] == ["はじめに。", "もう一つ。"]


def test_answer_chunks_and_segments(spark):
    answer = "あ" * 399 + "。"
    found = spark.createDataFrame([(1, 1, "問い", answer * 5), (1, 2, None, "短い。")], "doc_id long, pair long, question string, answer string")
    got = [(r.pair, r.number, r.question, len(r.text)) for r in transcripts.answer_chunks(found).orderBy("pair", "number").collect()]
    assert got == [(1, 1, "問い", 1200), (1, 2, "問い", 800), (2, 1, None, 3)]
    text = "い\n" * 40 + "\n" + "う。" * 60
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    parts = transcripts.segments(docs, 50).orderBy("number").collect()
    assert "".join(r.text for r in parts) == text and max(len(r.text) for r in parts) <= 50


def test_fillers(spark):
    words = ["うん、うん。", "はいはい", "何ですって。", "うんと言った", "", None, "えー、あの、その……", "うん" * 9]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    assert [r.f for r in df.select(transcripts.is_filler(F.col("text")).alias("f")).collect()] == [True, True, True, False, False, None, True, False]


def test_web_queries_and_named_terms(spark):
    df = spark.createDataFrame([(1, "Tea and cake"), (2, "tea only"), (3, "cake or milk"), (4, None)], "id int, text string")
    match = lambda q: {r.id for r in df.where(retrieval.web_query(F.col("text"), q)).collect()}
    assert match("tea") == {1, 2} and match("tea -cake") == {2} and match("milk OR only") == {2, 3} and match('"and cake"') == {1} and match("tea milk OR cake") == {1}
    terms = spark.createDataFrame([("ea",), ("cake",), ("",), (None,), ("zz",), ("ea",)], "term string")
    for block in (50_000, 1):
        assert {tuple(r) for r in retrieval.named_terms(df, terms, block).collect()} == {("1", "ea", 1), ("1", "cake", 1), ("2", "ea", 1), ("3", "cake", 1)}
    assert retrieval.named_terms(df, terms.where("false")).count() == 0


def test_keyword_hits_see_the_latest_row_only(spark):
    chunks = spark.createDataFrame([("a", 1, "x y", "p"), ("a", 2, "x", "p"), ("b", 1, "y x x", "q"), ("b", 1, "y x x", "q"), (None, 1, "x y", "p"), ("c", 1, None, "p")], "chunk_id string, updated_at long, text string, person_id string")
    queries = spark.createDataFrame([("q1", ["x", "y"], "q"), ("q2", ["x"], "p"), ("q3", [], "p"), ("q4", None, "p")], "query string, terms array<string>, person_id string")
    hits = lambda *same: {(r.query, r.chunk_id, r.score, r.position) for r in retrieval.keyword_hits(chunks, queries, 5, same).collect()}
    assert hits() == {("q1", "b", 3, 1), ("q2", "b", 2, 1), ("q2", "a", 1, 2)}
    assert hits("person_id") == {("q1", "b", 3, 1), ("q2", "a", 1, 1)}


def test_updates_revisions_and_repeated_rows(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", None, "x"), ("b", None, "x"), (None, 3, "y")], "k string, v int, s string")
    assert sorted(map(str, updated(rows, rows.where("k = 'b'"), "k", {"s": F.lit("z")}).collect())) == sorted(["Row(k='a', v=1, s='x')", "Row(k='b', v=None, s='z')", "Row(k='b', v=None, s='z')", "Row(k=None, v=3, s='y')"])
    now, before = revisions(rows.distinct(), "k", "v", F.col("s") == "x", {"s": F.lit("w")})
    assert {tuple(r) for r in now.collect()} == {("a", 2, "w"), ("b", 1, "w"), (None, 3, "y")} and before.count() == 2
    lists = spark.createDataFrame([("a", ["p", "p"]), ("a", ["p", "p"]), ("a", ["r"]), (None, ["p"])], "k string, xs array<string>")
    pairs = spark.createDataFrame([("p", "q")], "old string, new string")
    assert sorted((r.k or "", r.xs) for r in replaced("xs", pairs, lists, "k").collect()) == [("", ["q"]), ("a", ["q", "q"]), ("a", ["q", "q"]), ("a", ["r"])]


def test_stamps_and_their_spoken_form(spark):
    from corpusloom.functions.text import without_stamp

    lines = {"3:08 3分8秒 はい": "はい", "0:16 16秒 はい": "はい", "3:00 3分 はい": "はい", "3:08 4分8秒 はい": "4分8秒 はい", "3:08": None, "3分8秒": None, " 8秒 ": None, "3:08 はい": "はい", "はい 3分": "はい 3分", "": None, "16秒待った": "16秒待った", "[00:16]16秒待った": "待った"}
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "line string")
    assert {r.line: r.t for r in df.select("line", without_stamp(F.col("line")).alias("t")).collect()} == {**lines, None: None}


def test_links_of_one_section(spark):
    from corpusloom.sources.readers import section_links

    page = '<h2><a name="a">1</a></h2><a href="card1.html">no</a><h2><a name="b">2</a></h2>\n<a href="card22.html"><b>T &amp; <i>U</i></b></a>\n<a href="card3.html">V</a><h2>x</h2><a href="card4.html">no</a>'
    df = spark.createDataFrame([("p", page), ("q", "<p>nothing</p>"), ("r", None)], "id string, html string")
    assert {tuple(r) for r in section_links(df, "b").collect()} == {("p", "22", "T & U"), ("p", "3", "V")}


def test_one_row(spark):
    import pytest

    from corpusloom.operators.mutations import one_row

    df = spark.range(3)
    assert one_row(df.where("id = 1")).id == 1 and one_row(df.where("id > 5"), none_allowed=True) is None
    for bad in (df, df.where("id > 5")):
        with pytest.raises(ValueError):
            one_row(bad)


def test_named_entries_by_brute_force(spark):
    rng = random.Random(5)
    words = [a + b for a in "abcdef" for b in "xyz"] + list("abc")
    names = [(f"e{k}", w) for k in range(120) for w in rng.sample(words, rng.choice([1, 2, 2, 2, 3, 5, 20]))] + [("e1", ""), (None, "ax"), ("e2", None), ("e3", "zzz")]
    texts = [(rng.choice([None, *map(str, range(60))]), "".join(rng.choice("abcdefxyz ") for _ in range(rng.choice([0, 3, 8, 300])))) for _ in range(150)] + [("7", None), ("no", "zz")]
    want = {}
    for i, text in texts:
        want.setdefault(i, set()).update(e for e, w in names if e and w and text and w in text)
    want = {(i, min(found), len(found)) for i, found in want.items() if found}
    t, n = spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(names + names[:9], "entry string, term string")
    for blocks in ((50_000, 500_000), (5, 40)):
        assert {tuple(r) for r in retrieval.named_entries(t, n, *blocks).collect()} == want
    assert retrieval.named_entries(t, n.where("false")).count() == 0 and retrieval.named_entries(t.where("false"), n).count() == 0


def test_excess_is_the_same_by_pairs_and_by_names(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(40, k, replace=False)) for k in rng.choice([2, 2, 2, 3, 4, 25], 500)]
    entries, rows = rng.integers(1, 9, 500), [np.sort(rng.choice(40, k, replace=False)) for k in (1, 2, 3, 5, 8, 20, 40)]
    want = [int(sum(n * max(0, len(np.intersect1d(s, row)) - 1) for s, n in zip(sets, entries))) for row in rows]
    values, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    for paired, at_once in ((16, 2_000_000), (1, 50), (99, 1), (2, 300)):
        monkeypatch.setattr(retrieval, "MOST_PAIRED", paired)
        monkeypatch.setattr(retrieval, "MOST_AT_ONCE", at_once)
        assert retrieval.NameSets(sets, entries, 40).excess(values, sizes).tolist() == want


def test_no_row_per_chunk_and_card_is_shuffled(spark, tmp_path):
    spark.range(300).selectExpr("concat('c', id) as card_id", "timestamp'2024-01-01' as updated_at", "concat('山と川', id % 7) as title").write.parquet(f"{tmp_path}/thought_cards.parquet")
    spark.range(301).selectExpr("if(id = 300, null, concat('k', id)) as chunk_id", "concat('山の上', id) as text").write.parquet(f"{tmp_path}/source_chunks.parquet")
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    # As with tables too large for a broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = reference_evidence.j9_named_in_chunks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled() - before < 10_000
    assert {tuple(r) for r in got} == {(c, "c0", 300) for c in [None, *(f"k{n}" for n in range(300))]}
