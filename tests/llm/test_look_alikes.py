import itertools
import random

from corpusloom.llm import look_alikes as L

SCHEMA = "canonical_work_id string, person_id string, canonical_title string, canonical_title_reading string, title_variants array<string>, form string"


def found(spark, rows):
    return {tuple(r) for r in L.look_alike_works(spark.createDataFrame([(*r, "f") for r in rows], SCHEMA)).collect()}


def test_what_looks_the_same_and_what_does_not(spark):
    same = ["ポストとカフェ Élan 2", "ポス卜と力フェ Élan ２", "ﾎﾟｽﾄとカフ​ェ　Él­an 2", "ポストとカフェ  Ёlan 2".replace("Ё", "É")]
    other = ["ポストとカフエ Élan 2", "ポストとカフェ Elan 2", "ポストとカフェ élan 2", "ホストとカフェ Élan 2", "ぽすとトカフェ Élan 2", "ポストとカフェÉlan 2"]
    rows = [(f"w{k}", "p", t, None, None) for k, t in enumerate(same + other)]
    want = {("canonical_title", f"w{a}", f"w{b}") for a, b in itertools.combinations(range(len(same)), 2)}
    assert found(spark, rows) == want


def test_fields_persons_nulls_and_repeated_rows(spark):
    rows = [
        ("a", "p", "Сode", "よみ", ["x", "ニ"]), ("b", "p", "Code", "よみ", ["二", None]), ("b", "p", "Code", "よみ", ["二"]),
        ("c", "q", "Code", None, []), ("d", None, "Code", None, None), (None, "p", "Code", None, None), ("e", "p", None, "よ​み", None), ("f", "p", "​", " ", [""]),
    ]
    assert found(spark, rows) == {("canonical_title", "a", "b"), ("title_variants", "a", "b"), ("canonical_title_reading", "a", "e"), ("canonical_title_reading", "b", "e")}
    assert found(spark, []) == set()


def test_canonical_spelling_is_the_most_frequent(spark):
    values = spark.createDataFrame([("ポスト x",), ("ポスト y",), ("ポス卜 z",), ("力",)], "value string")
    forms = {r.value: r.form for r in L.consistent_forms(values).collect()}
    assert forms == {"ポスト x": "ポスト x", "ポスト y": "ポスト y", "ポス卜 z": "ポスト z", "力": "カ"}


def test_automaton_costs(spark):
    table = L.look_alike_table(spark)
    trie = L.Trie(table)
    for s in ("カラー", "力ラー", "カ​ラー", "カラ", "からー", "ガラー", "カラーズ"):
        trie.insert(s, 1)
    assert {s for s, _ in trie.reach("ｶﾗ一")} == {"カラー", "力ラー", "カ​ラー"}
    assert {s for s, _ in trie.reach("ｶﾗ一", 1)} == {"カラー", "力ラー", "カ​ラー", "カラ", "ガラー"} | ({"カラーズ"} if len(L.atoms("ズ", table)) == 1 else set())
    # Against the edit distance of atoms.
    random.seed(5)
    words = ["".join(random.choice("カ力ラーー一a а") for _ in range(random.randint(1, 5))) for _ in range(60)]
    trie = L.Trie(table)
    for w in set(words):
        trie.insert(w, 1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for w in words:
        for most in (0, 1, 2):
            assert {s for s, _ in trie.reach(w, most)} == {s for s in words if distance(L.atoms(s, table), L.atoms(w, table)) <= most}


def test_table(spark):
    table = L.look_alike_table(spark)
    form = lambda x: L.table_form(x, table)
    for same in ("ɑa", "һh", "ԁd", "工エ", "ΙIІ", "оoο", "べベ", "⼀一ー", "ーｰ-", "ﾄ卜ト", "～〜", "·・"):
        assert len({form(c) for c in same}) == 1, same
    for other in ("lI1", "0O", "①1", "²2", "㌔キ", "えゑ", "國国", "éeÉ", "かがカ", "ツッ", "mn", "ノ/", "いイ"):
        assert len({form(c) for c in other}) == len(other), other


def test_hot_form(spark, monkeypatch):
    rows = [(f"w{k:02d}", "p", "カフェ" if k % 3 else "力フェ", None, None) for k in range(30)]
    want = found(spark, rows)
    assert len(want) == 200
    monkeypatch.setattr(L, "HOT_FORM", 4)
    assert found(spark, rows) == want


def test_very_long_value(spark):
    rows = [("a", "p", "ロ" * 30_000, None, None), ("b", "p", "口" * 30_000, None, None)]
    assert found(spark, rows) == {("canonical_title", "a", "b")}
