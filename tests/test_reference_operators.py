import io
import random
import re
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.vectors import nearest
from corpusloom.operators import chunking, mutations, quality, retrieval
from corpusloom.plans import reference
from corpusloom.sources import readers
from corpusloom.streaming import jobs

DATA = "/root/testdata/sf0.001"


def lcs(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(i + best + 1, len(a) + 1):
            if a[i:j] not in b:
                break
            best = j - i
    return best


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 5)).round(1)
    vectors[7] = vectors[3]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(98, None), (99, [1.0])], "id long, vector array<double>").repartition(3)
    got = {}
    for r in nearest(rows, rows.where("id < 5"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(5):
        assert got[q] == sorted(range(60), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:4]
    assert nearest(rows, rows.where("id < 0"), 4).count() == 0
    assert nearest(rows.where("id < 0"), rows.where("id < 2"), 4).count() == 0


def test_shared_grams_and_runs_against_brute_force(spark):
    random.seed(3)
    word = lambda n: "".join(random.choice("abc") for _ in range(n))
    texts = [(f"t{k}", word(60)) for k in range(20)] + [("n", None), ("e", "")]
    drafts = [(f"d{k}", word(30)) for k in range(6)] + [("n", None), ("short", "ab")]
    df = retrieval.shared_grams(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(drafts, "draft_id string, text string"), 4)
    got = {(r.draft_id, r.id): (r.grams, r.longest) for r in df.collect()}
    want = {}
    for d, a in drafts:
        for t, b in texts:
            if a and b and (n := lcs(a, b)) >= 4:
                want[d, t] = (len({a[k : k + 4] for k in range(len(a) - 3)} & {b[k : k + 4] for k in range(len(b) - 3)}), n)
    assert got == want


def test_shared_grams_of_texts_without_any(spark):
    texts = spark.createDataFrame([("a", "xxxxxxxxxxxx"), ("b", ""), ("c", None)], "id string, text string")
    drafts = spark.createDataFrame([("d", "yyyyyyyyyyyyyy"), ("e", "short"), ("f", None)], "draft_id string, text string")
    assert retrieval.shared_grams(texts, drafts).count() == 0 and retrieval.shared_grams(texts, drafts.where("false")).count() == 0
    assert {(r.draft_id, r.longest, r.ratio, r.passed) for r in retrieval.similarity_verdicts(texts, drafts).collect()} == {("d", 0, 0.0, True), ("e", 0, 0.0, True)}


def test_similarity_verdicts_against_brute_force(spark):
    random.seed(6)
    noise = re.compile(r"[\s、。，．・「」『』（）()\[\]〔〕【】…―ー−—’'\"“”！？!?：:；;]")
    bare = lambda t: noise.sub("", unicodedata.normalize("NFKC", t))
    word = lambda n: "".join(chr(random.randint(0x4E00, 0x9000)) for _ in range(n))
    noisy = lambda t: "".join(x + random.choice(["", "", "、", "\n", "　", "」"]) for x in t)
    texts = [(f"t{k}", noisy(word(80) + "Ａｂｃ１２３ｶﾞ")) for k in range(8)] + [("n", None), ("e", "")]
    cut = lambda k, a, n: bare(texts[k][1])[a : a + n]
    drafts = [
        ("own", word(60)), ("run", noisy(word(50) + cut(0, 5, 20) + word(50))), ("short runs", noisy(word(30) + cut(1, 0, 14) + word(30) + cut(2, 9, 12))), ("few", word(300) + noisy(cut(3, 3, 12))),
        ("width", cut(4, 70, 17) + word(9)), ("twice", (cut(5, 2, 11) + word(40)) * 2), ("tiny", "短い"), ("none", "。、"),
    ]
    rows = retrieval.similarity_verdicts(spark.createDataFrame(texts, "id string, text string").repartition(3), spark.createDataFrame(drafts, "draft_id string, text string"))
    grams = lambda t: {t[k : k + 10] for k in range(len(t) - 9)}
    union, want = set().union(*[grams(bare(t)) for _, t in texts if t]), {}
    for name, draft in drafts:
        runs = [n for _, t in texts if t and (n := lcs(bare(draft), bare(t))) >= 10]
        own = grams(bare(draft))
        ratio = len(own & union) / len(own) if own else 0.0
        want[name] = (max(runs, default=0), len(runs), round(ratio, 4), max(runs, default=0) < 20 and ratio <= 0.05)
    assert {r.draft_id: (r.longest, r.chunks, r.ratio, r.passed) for r in rows.collect()} == want
    assert {k for k, v in want.items() if not v[3]} == {"run", "short runs", "width"} and 0 < want["few"][2] <= 0.05


def test_diversified_is_the_plain_fold(spark):
    random.seed(5)
    rows = [("q", f"c{k}", random.choice("st"), random.choice(["r1", "r2", None]), k) for k in range(40)]
    df = spark.createDataFrame(rows, "query string, chunk_id string, source_id string, role string, position int")
    kept, s, r = [], {}, {}
    for _, c, source, role, _ in rows:
        if len(kept) < 10 and s.get(source, 0) < 5 and (role is None or r.get(role, 0) < 3):
            kept.append(c)
            s[source] = s.get(source, 0) + 1
            if role:
                r[role] = r.get(role, 0) + 1
    assert sorted(x.chunk_id for x in retrieval.diversified(df).collect()) == sorted(kept)
    assert retrieval.diversified(df.where("false")).count() == 0


def test_search_needs_every_term(spark):
    df = spark.createDataFrame([("a", "Tea tea cup"), ("b", "tea"), ("c", None), ("d", "")], "chunk_id string, text string")
    assert [(r.chunk_id, r.score) for r in retrieval.search(df, ["TEA", "cup"], 5).collect()] == [("a", 3)]


def test_chunks_against_their_rule(spark):
    random.seed(2)
    rows = [(k, [(random.randint(1, 9), random.choice("ab")) for _ in range(random.randint(0, 12))]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, parts array<struct<size: int, kind: string>>")
    for most, least, joint in ((12, 7, 1), (10, None, 0)):
        got = {r.id: r.c for r in df.select("id", chunking.chunks_of(F.col("parts"), most, least, joint).alias("c")).collect()}
        for k, parts in rows:
            groups = dict(enumerate([[tuple(x) for x in c] for c in got[k]]))
            assert [x for c in groups.values() for x in c] == parts
            total = lambda g: sum(s for s, _ in g) + joint * (len(g) - 1)
            for c, g in groups.items():
                assert len({kind for _, kind in g}) == 1 and (len(g) == 1 or total(g[:-1]) + g[-1][0] <= most)
                assert least is None or all(total(g[: n + 1]) < least for n in range(len(g) - 1))
                if (following := groups.get(c + 1)) is not None:
                    assert following[0][1] != g[0][1] or total(g) + following[0][0] > most or (least is not None and total(g) >= least)


def test_sentence_pieces(spark):
    df = spark.createDataFrame([(1, "い。う！え」お"), (2, "い。」う！"), (3, "あ" * 9), (4, "")], "id int, text string")
    cut = lambda most, pattern: {(r.id, r.piece): r.text for r in chunking.sentence_pieces(df, ["id"], most, pattern).collect()}
    assert cut(2, chunking.SENTENCE) == {(1, 0): "い。", (1, 1): "う！え」お", (2, 0): "い。", (2, 1): "」う！", (3, 0): "あ" * 9, (4, 0): ""}
    assert cut(3, chunking.CLOSED_SENTENCE) == {(1, 0): "い。", (1, 1): "う！」"[:2], (1, 2): "え」お", (2, 0): "い。」", (2, 1): "う！", (3, 0): "あ" * 9, (4, 0): ""}


def test_book_chunks_are_numbered_by_chapter(spark):
    text = "はしがき。\n# One\n\n" + "あ" * 700 + "\n\n## Part\n" + "い" * 300 + "\n\n短い。\n# Two\nう。\n## Part\nえ\nお。\n" + "か" * 600
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.chunk_id, r.title, r.section, len(r.text)) for r in chunking.book_chunks(docs).orderBy("chunk_id").collect()]
    assert got == [("1_CH00_001", None, None, 5), ("1_CH01_001", "One", None, 700), ("1_CH01_002", "One", "Part", 304), ("1_CH02_001", "Two", None, 2), ("1_CH02_002", "Two", "Part", 603)]
    small = spark.createDataFrame([(1, "# A\n" + "あ" * 700 + "\n## B\nい。\n## C\n" + "う" * 250)], "doc_id long, text string")
    assert [(r.chapter, r.number, len(r.text)) for r in chunking.book_chunks(small).orderBy("number").collect()] == [(1, 1, 703), (1, 3, 250)]
    long = spark.createDataFrame([(1, "あ。" * 90_000)], "doc_id long, text string")
    got = [len(r.text) for r in chunking.book_chunks(long).orderBy("number").collect()]
    assert got == [1500] * 120


def test_running_totals_by_blocks(spark):
    rows = [("g", f"{k:03d}", k) for k in range(57)] + [("h", "000", 5), (None, "000", 1), (None, "011", 2)]
    df = spark.createDataFrame(rows, "g string, id string, v long").repartition(5)
    got = {(r.g, r.id): r.v_total for r in chunking.running_totals(df, ["g"], ["id"], F.substring("id", 1, 2), ["v"]).collect()}
    assert got == {(g, i): sum(v for h, j, v in rows if h == g and j <= i) for g, i, _ in rows}


def test_as_of_against_brute_force(spark):
    random.seed(8)
    left = [(f"l{k}", random.choice("gh"), random.randint(0, 300)) for k in range(60)] + [("n", None, 5), ("m", "g", None)]
    right = [(random.choice("gh"), random.randint(0, 300), random.choice([1, 2, 3, None])) for _ in range(40)] + [(None, 1, 9), ("g", None, 9)]
    got = chunking.as_of(spark.createDataFrame(left, "id string, g string, at int"), spark.createDataFrame(right, "g string, at int, page int"), "g", "at", "page", 25)
    want = {i: max(((a, p) for h, a, p in right if h == g and None not in (g, a, at, p) and a <= at), default=(0, None))[1] for i, g, at in left}
    assert {r.id: r.page_at for r in got.collect()} == want


def test_line_chunks_are_slices_of_their_text(spark):
    random.seed(9)
    texts = {k: "".join(random.choice("あい。「」\n　 ") for _ in range(random.randint(0, 3000))) for k in range(20)}
    docs = spark.createDataFrame([*[(k, k % 2 == 0, t) for k, t in texts.items()], (99, False, None)], "doc_id long, fiction boolean, text string")
    rows = sorted(chunking.line_chunks(docs, ["doc_id"], 50).collect(), key=lambda r: (r.doc_id, r.number))
    bare = lambda t: [x for x in t.split("\n") if x.strip()]
    assert rows and all(bare(texts[r.doc_id][r.char_start : r.char_end]) == bare(r.text) for r in rows)
    for k, t in texts.items():
        assert "".join(r.text.replace("\n", "") for r in rows if r.doc_id == k) == "".join(bare(t))


def test_corpus_chunks_are_packed(spark):
    a, b, c = "　" + "あ" * 299 + "。", "い" * 299 + "。", "う" * 298 + "。"
    long = ("え" * 499 + "。」") * 2
    plain = f"{a}\n\n{b}\n「{c}\n{long}"
    file = f"題\n作者\n{'-' * 12}\n《》：ルビ\n{'-' * 12}\n前。\n［＃３字下げ］一［＃「一」は中見出し］\n　空《そら》の｜あお色《いろ》［＃「色」に傍点］。\n「はい。」\n「ええ。」\n去った。\n［＃３字下げ］二［＃「二」は中見出し］\n二夜。\n\n底本：「x」\n"
    docs = spark.createDataFrame([(1, plain, "essay", False), (2, file, "annotated_file", True), (3, file, "annotated_file", None), (4, None, "letter", None), (5, " \n", "letter", None)], "doc_id long, text string, doc_kind string, fiction boolean")
    rows = chunking.corpus_chunks(docs, F.col("doc_kind") == "annotated_file", F.col("fiction")).orderBy("doc_id", "chapter", "number").collect()
    got = {k: [(r.chapter, r.number, r.title, r.char_start, r.char_end, r.kind, r.text) for r in rows if r.doc_id == k] for k in range(1, 6)}
    half = long[:501]
    assert got[1] == [(1, 1, None, 0, 603, "body", f"{a}\n{b}"), (1, 2, None, 604, 904, "body", "「" + c), (1, 3, None, 905, 1406, "body", half), (1, 4, None, 1406, 1907, "body", half)]
    assert got[2] == [(1, 1, "一", 0, 6, "narration", "空のあお色。"), (1, 2, "一", 7, 18, "dialogue", "「はい。」\n「ええ。」"), (1, 3, "一", 19, 23, "narration", "去った。"), (2, 1, "二", 0, 3, "narration", "二夜。")]
    assert got[3] == [(1, 1, "一", 0, 23, "body", "空のあお色。\n「はい。」\n「ええ。」\n去った。"), (2, 1, "二", 0, 3, "body", "二夜。")]
    assert got[4] == got[5] == []


def test_mutations(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("n", None, "z")], "k string, h string, keep string")
    new = spark.createDataFrame([("b", "3"), ("c", "4"), ("n", None)], "k string, h string")
    assert {tuple(r) for r in mutations.captured_changes(old, new, "k", "h").collect()} == {("a", "stale"), ("b", "changed"), ("c", "new"), ("n", "unchanged")}
    assert {tuple(r) for r in mutations.upsert(old, new, ["k"], ["h"]).collect()} == {("a", "1", "x"), ("b", "3", "y"), ("c", "4", None), ("n", None, "z")}
    assert mutations.insert_ignore(old.drop("keep"), new, ["k"]).count() == 4
    renamed = mutations.replaced("xs", spark.createDataFrame([("p", "q")], "old string, new string"), spark.createDataFrame([("a", ["p", "r", "p"]), ("b", []), ("c", None)], "k string, xs array<string>"), "k")
    assert {(r.k, None if r.xs is None else tuple(r.xs)) for r in renamed.collect()} == {("a", ("q", "r", "q")), ("b", ()), ("c", None)}
    assert mutations.captured_changes(old.where("false"), new.where("false"), "k", "h").count() == 0


def test_latest_breaks_ties_and_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 9, "w")], "k string, t int, v string")
    assert [tuple(r) for r in mutations.latest(df, ["k"], "t").select("k", "v").collect()] == [("a", "z")]


def test_quality_of_no_rows(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert [(r.hits, r.value, r.passed) for r in quality.checks(df, {"x": (F.col("a").isNull(), 0.1)}).collect()] == [(0, 0.0, True)]
    assert quality.value_counts(df, ["a", "b"]).count() == 0


def test_fingerprint_ignores_order(spark):
    rows = [("g", str(k), None if k == 3 else "h") for k in range(20)]
    one, two = (quality.fingerprint(spark.createDataFrame(r, "g string, a string, b string"), "g", "a", "b").collect() for r in (rows, rows[::-1]))
    assert one == two
    assert one != quality.fingerprint(spark.createDataFrame(rows[1:], "g string, a string, b string"), "g", "a", "b").collect()


def test_readers_round_trip(spark, tmp_path):
    text = "一行目\n二行目。"
    (tmp_path / "a.txt").write_bytes(text.encode("utf-8"))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("readme.md", "no")
        z.writestr("work.txt", text.encode("cp932"))
    (tmp_path / "b.zip").write_bytes(data.getvalue())
    (tmp_path / "c.zip").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.garbled) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (text, 0.0) and got["b.zip"] == (text, 0.0) and got["c.zip"][0] is None
    (tmp_path / "m.csv").write_text("﻿id,name\n1, x \n2,\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("1", "x"), ("2", None)]


@pytest.mark.parametrize("text, want", [('say ```json\n{"b": 1, "a": [2]}\n``` ok', '{"a":[2],"b":1}'), ('x {"a": "１"} y', '{"a":"１"}'), ("nothing", None), (None, None), ("{broken", None)])
def test_lenient_json(text, want):
    assert readers.lenient_json(text) == want


def test_text_expressions(spark):
    df = spark.createDataFrame([("　｜青空《あおぞら》の漢字《かんじ》\x07 ［＃「空」に傍点］",), (None,), ("",)], "t string")
    t = F.col("t")
    got = df.select(tx.without_ruby(tx.without_notes(tx.without_controls(t))), tx.displayed_ruby(t), tx.slug(t, "none"), tx.folded_title(tx.nfkc("t"))).collect()
    assert got[0][0] == "青空の漢字 " and "青空（あおぞら）の漢字（かんじ）" in got[0][1]
    assert got[1][0] is None and got[1][2] == "none" and got[2][2] == "none"


def test_stream_windows_agree_with_the_batch(spark):
    stream = jobs.run_to_end(jobs.windowed_counts(jobs.table_stream(spark, DATA, "events"), "1 day", "1 hour"), "w")
    batch = jobs.windowed_counts(spark.read.parquet(f"{DATA}/events.parquet"), "1 day", "1 hour")
    closed = {(r.window_start, r.event_type, r.events) for r in stream.collect()}
    every = {(r.window_start, r.event_type, r.events) for r in batch.collect()}
    assert closed and closed <= every and len(every - closed) <= 12


def test_streams_of_many_files_in_any_order_are_whole(spark, tmp_path):
    for name in ("events", "corpus_snapshots"):
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        rows.orderBy(F.rand(4)).repartition(40).write.parquet(str(tmp_path / f"{name}.parquet"))
    windows = lambda df: {(r.window_start, r.event_type): (r.events, None if r.total is None else round(r.total, 6)) for r in df.collect()}
    assert windows(reference.st11_stream_windows(spark, str(tmp_path))) == windows(jobs.windowed_counts(spark.read.parquet(f"{DATA}/events.parquet"), "6 hours", "1 hour"))
    rows = spark.read.parquet(f"{DATA}/corpus_snapshots.parquet").select("snapshot_no", "record_table", "record_id", F.col("delivered_at").cast("timestamp"))
    got = [tuple(r) for r in reference.st6_stream_changes(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in rows.collect()}


def test_stream_without_rows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").where("false").write.parquet(str(tmp_path / "events.parquet"))
    assert reference.st11_stream_windows(spark, str(tmp_path)).count() == 0


def test_stream_state_keeps_the_last_heartbeat(spark):
    seen = {}
    stream = jobs.latest_state(jobs.table_stream(spark, DATA, "events"))

    def each(rows, _):
        seen.update({r.user_id: (r.last_ts, r.events) for r in rows.collect()})

    from corpusloom.runtime import fresh_path

    q = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", fresh_path(spark, "hb")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = spark.read.parquet(f"{DATA}/events.parquet").where("user_id is not null and ts is not null").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("t"), F.count("*").alias("n"))
    assert seen == {r.user_id: (r.t, r.n) for r in want.collect()}
