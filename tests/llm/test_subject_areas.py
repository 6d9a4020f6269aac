import random

from pyspark.sql import functions as F

from corpusloom.llm import subject_areas as S

DATA = "/root/testdata/sf0.1"


def made(seed, n):
    random.seed(seed)
    words = {"law": "court judge verdict statute appeal contract".split(), "music": "violin sonata rhythm choir opera melody".split()}
    rest = "the of and a house river stone garden letter evening walked slowly".split()
    docs, truth = [], {}
    for k in range(n):
        found = set(random.sample(["law", "music"], random.choice([0, 1, 1, 2])))
        parts = []
        for s in found:
            parts += [" ".join(random.choice(words[s] + rest[:6]) for _ in range(9)) for _ in range(4)]
        parts += [" ".join(random.choice(rest) for _ in range(9)) for _ in range(5)]
        random.shuffle(parts)
        docs.append((k, ". ".join(parts) + "."))
        truth[k] = found
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = made(3, 400)
    labels = [(k, s) for k in range(80) for s in (truth[k] or {None})] + [(9999, "law"), (5, "unknown"), (None, "law")]
    df = spark.createDataFrame([(*d, "x") for d in docs] + [(500, None, "x"), (501, "", "x")], "doc_id long, text string, share string")
    subjects = spark.createDataFrame([("law",), ("music",), (None,)], "subject string")
    got = {tuple(r) for r in S.subjects_of_documents(df, subjects, spark.createDataFrame(labels, "doc_id long, subject string")).collect()}
    want = {(k, s) for k, found in truth.items() for s in found if k >= 80}
    tested = {x for x in got if x[0] >= 80}
    assert 2 * len(tested & want) / (len(tested) + len(want)) > 0.95


def test_half_of_the_labels_predict_the_other(spark):
    t = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    labels = t("subject_labels").where("doc_id is not null")
    got = {tuple(r) for r in S.subjects_of_documents(t("documents"), t("subject_areas"), labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").select("doc_id", "subject").distinct().collect()
    ids, want = {r.doc_id for r in held}, {tuple(r) for r in held if r.subject}
    tested = {x for x in got if x[0] in ids}
    assert 2 * len(tested & want) / (len(tested) + len(want)) > 0.85


def test_every_labelled_document_counts(spark):
    # By hash of the id, the first 5,000 labelled documents are about law or about nothing, the last ones about music.
    ids = [r[0] for r in spark.range(5_400).orderBy(F.xxhash64("id"), "id").collect()]
    rng = random.Random(8)
    words = {"law": "court judge verdict statute appeal contract".split(), "music": "violin sonata rhythm choir opera melody".split(), None: "river stone garden letter evening walked".split()}
    subject = {k: "music" if n >= 5_050 else rng.choice(["law", None]) for n, k in enumerate(ids)}
    text = lambda s: ". ".join(" ".join(["the", "of", "and", *rng.choices(words[s], k=5)]) for _ in range(2)) + "."
    wanted = {k: rng.choice(["law", "music", None]) for k in range(10_000, 10_300)}
    docs = spark.createDataFrame([(k, text(s)) for k, s in (subject | wanted).items()], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list(subject.items()), "doc_id long, subject string")
    subjects = spark.createDataFrame([("law",), ("music",)], "subject string")
    got = {tuple(r) for r in S.subjects_of_documents(docs, subjects, labels).where("doc_id >= 10000").collect()}
    assert got == {(k, s) for k, s in wanted.items() if s}


def test_fit_does_not_depend_on_tasks(spark, monkeypatch):
    docs, truth = made(6, 300)
    labels = spark.createDataFrame([(k, s) for k in range(200) for s in (truth[k] or {None})], "doc_id long, subject string")
    df, subjects = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("law",), ("music",)], "subject string")
    shares = []
    for per_task in (1_000, 60):
        monkeypatch.setattr(S, "LABELLED_PER_TASK", per_task)
        monkeypatch.setattr(S, "MOST_BROADCAST", per_task)
        scored, least = S.scored_subjects(df, subjects, labels)
        shares.append((least, {(r.doc_id, r.subject): r.share for r in scored.collect()}))
    (least, one), (again, many) = shares
    assert least == again and one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-3


def test_no_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the court.")], "doc_id long, text string")
    subjects = spark.createDataFrame([("law",)], "subject string")
    labels = spark.createDataFrame([(1, "law")], "doc_id long, subject string")
    assert S.subjects_of_documents(df, subjects, labels.where("false")).count() == 0
    assert S.subjects_of_documents(df.where("false"), subjects, labels).count() == 0
    assert S.subjects_of_documents(df, subjects.where("false"), labels).count() == 0


def test_tokens():
    t = S.Tokens(["量子と光《ひかり》の\n屈折。", "Le parfum d’été!", None, "The end of it"])
    assert t.language.tolist()[:2] == [0, 2] and t.language[3] == 1
    assert [int(x) for x in t.length[t.text == 0]] == [2, 1, 1, 1, 2, 1, 1]
