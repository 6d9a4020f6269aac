import duckdb
import pytest

from corpusloom.llm import wrong_encodings as W

DATA = "/root/testdata/sf0.01"
CLEAN = "公園へ行った朝、志津の手紙は静かなものであった。それは鳥のように、ふと立ち止まった。"
FRENCH = "À Nobeta, Lurile répondit à l’élève et la forêt fût obscure. Le lecteur d’été, près de la rivière, copia la préface."


@pytest.fixture(scope="module")
def language():
    texts = [r[0] for r in duckdb.sql(f"select text from '{DATA}/source_chunks.parquet' where text is not null").fetchall()]
    return W.Language(W.byte_bigrams([t for t in texts if not W.suspicious(t)]))


SWAPS = [("cp1252", "utf-8"), ("latin_1", "utf-8"), ("koi8_r", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("latin_1", "cp932"), ("latin_1", "euc_jp")]


def swapped(text, page, true):
    data = text.encode(true)
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in data)


@pytest.mark.parametrize("page, true", SWAPS)
def test_round_trip(language, page, true):
    bad = swapped(CLEAN, page, true)
    assert W.suspicious(bad)
    assert W.restore(bad, language)[0] == CLEAN
    part = CLEAN + bad + CLEAN
    assert W.restore(part, language)[0] == CLEAN * 3


@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437", "cp932"])
def test_round_trip_french(language, page):
    bad = FRENCH.encode("utf-8").decode(page, "strict" if page != "cp1252" else "replace") if page == "cp932" else swapped(FRENCH, page, "utf-8")
    assert W.restore(bad, language)[0] == FRENCH


def test_twice_garbled_and_seven_bit(language):
    once = swapped(CLEAN, "cp1252", "utf-8")
    assert W.restore(swapped(once, "cp1252", "utf-8"), language)[0] == CLEAN
    jis = CLEAN.encode("iso2022_jp").decode("ascii").replace("\x1b$B", "").replace("\x1b(B", "")
    assert W.restore(jis, language)[1] == "7bit>euc_jp"


def test_lost_bytes_are_found(language):
    for bad in (CLEAN.encode("cp932").decode("utf-8", "replace"), CLEAN.encode("utf-8").decode("euc_jp", "replace"), "d�fendit la rivi�re"):
        assert "lost bytes" in W.restore(bad, language)[1]


@pytest.mark.parametrize("text", [CLEAN, FRENCH, "宛名は Łódź の Żółw 書房", "欄外に «São João, coração» とある", "電文は「ｱｽｱｻ ﾂｸ ﾑｶｴﾀﾉﾑ」", "看板の ﾀﾊﾞｺ の字", "扉に Ἀρχή と Конец", "見出しは ÀÉÎÕÜ を並べ", "数式は ∑aᵢ ≤ ½√π", "表紙の〓と※", "", "Price $5 and $6 a week"])
def test_odd_but_right(language, text):
    assert not W.suspicious(text) or W.restore(text, language)[1] is None


def test_mapping_is_learned_where_the_page_is_unknown(language):
    # A page of one's own: every high byte is another symbol; only some of them are known.
    texts = [r[0] for r in duckdb.sql(f"select text from '{DATA}/source_chunks.parquet' where text is not null and source_id = 'AOZORA_99000001'").fetchall()]
    data = "\n".join(t for t in texts if not W.suspicious(t)).encode("cp932", "ignore")
    counts = W.byte_bigrams([data.decode("cp932")], "cp932")
    hidden = {0x82, 0xCC}
    symbols = [0x2500 + b if b in hidden else b for b in data]
    pairs = {}
    for a, b in zip(symbols, symbols[1:]):
        if a >= 0x80 or b >= 0x80:
            pairs[a, b] = pairs.get((a, b), 0) + 1
    import pandas as pd

    found = W.learn_mapping(pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["first", "second", "n"]), ("cp1252", "cp932"), counts)
    assert {s: found[s] for s in found if s >= 0x2500} == {0x2500 + b: b for b in hidden}


def test_in_spark_with_nulls_and_repeats(spark):
    bad = swapped(CLEAN, "cp1252", "cp932")
    rows = [("t", f"c{k}", "s", CLEAN * 3, "x") for k in range(50)] + [("t", "bad", "s", CLEAN + bad, "x"), ("t", "bad", "s", CLEAN + bad, "x"), ("t", "nosource", None, bad, "x"), ("t", "null", "s", None, "x"), ("t", "empty", "s", "", "x"), ("t", None, "s", bad, "x"), ("t", "long", "s", CLEAN * 3000 + bad, "x")]
    df = spark.createDataFrame(rows, "record_table string, record_id string, source string, text string, maps string")
    got = {r.record_id: r.restored for r in W.garbled(df).collect()}
    assert set(got) == {"bad", "nosource", "long"}
    assert W.garbled(df.where("false")).count() == 0


def test_a_page_in_no_list_is_learned_and_texts_restored(spark):
    texts = [r[0] for r in duckdb.sql(f"select distinct text from '{DATA}/source_chunks.parquet' where text is not null and length(text) > 150 order by 1").fetchall()]
    texts = [t for t in texts if not W.suspicious(t) and len(t.encode()) > 2 * len(t)]
    order = [37 * k % 128 for k in range(128)]
    bad = ["".join(chr(b) if b < 0x80 else chr(0x0620 + order[b - 0x80]) for b in t.encode()) for t in texts[:40]]
    rows = [("t", f"c{k}", f"s{k % 7}", t) for k, t in enumerate(texts)] + [("t", f"bad{k}", "odd", b) for k, b in enumerate(bad)]
    got = {r.record_id: r.restored for r in W.garbled(spark.createDataFrame(rows, "record_table string, record_id string, source string, text string")).collect()}
    assert set(got) == {f"bad{k}" for k in range(40)}
    assert sum(got[f"bad{k}"] == texts[k] for k in range(40)) >= 38


def test_a_symbol_leaves_the_table_only_for_a_free_byte_and_a_gain(language):
    import pandas as pd

    bad = [swapped(CLEAN, "cp1252", "utf-8") for _ in range(5)]
    pairs = pd.DataFrame([(ord(a), ord(b), 1) for t in bad for a, b in zip(t, t[1:])], columns=["first", "second", "n"]).groupby(["first", "second"], as_index=False).sum()
    counts = W.byte_bigrams([CLEAN * 50])
    assert W.learn_mapping(pairs, ("cp1252", "utf-8"), counts) == {}
    # One symbol exchanged for one the page lacks.
    moved = pairs.replace({"first": {0xE3: 0x3B1}, "second": {0xE3: 0x3B1}})
    assert W.learn_mapping(moved, ("cp1252", "utf-8"), counts) == {0x3B1: 0xE3}


def test_foreign_letters_beside_a_garbled_piece(language):
    text = FRENCH + "扉に «Конец и начало» とある。"
    bad = swapped("la forêt fût près de la rivière", "cp1252", "utf-8") + "。" + "扉に «Конец и начало» とある。" * 3
    assert W.restore(bad, language)[0].startswith("la forêt fût près de la rivière") and W.restore(text, language)[1] is None
