import random
import unicodedata

from corpusloom.llm import formatting_duplicates as D

SCHEMA = "chunk_id string, chunk_type string, text string, key string, kept_id string"


def canonical(kind, text):
    letters = lambda s: "".join(c for c in s if unicodedata.category(c)[0] in "LN").lower()
    if kind == "qa_pair":
        import re

        return "q" + "\n".join(sorted(x for x in map(letters, re.split("[\n\r／]", text)) if x))
    return "t" + letters(text)


def brute(rows):
    groups = {}
    for i, kind, text in rows:
        if i is not None and text is not None and len((c := canonical(kind, text)).replace("\n", "")) - 1 >= D.MIN_LETTERS:
            groups.setdefault(c, set()).add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}, {(min(g), len(g)) for g in groups.values()}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "k", "k") for r in rows], SCHEMA)
    return {tuple(r) for r in D.duplicate_members(df).collect()}, {tuple(r) for r in D.collapsed(df).collect()}


def test_against_brute_force(spark, monkeypatch):
    random.seed(1)
    base = ["The quick brown fox jumps over the lazy dog 42", "質問：雨は降るか降らないかどうかと思う\n答：まだ分からないと言われたようだ", "短い"]
    rows = []
    for k in range(300):
        text, kind = random.choice(base), random.choice(["qa_pair", "body", None])
        if kind == "qa_pair":
            parts = text.split("\n")
            random.shuffle(parts)
            text = random.choice(["\n", " ／ "]).join(parts)
        text = "".join(c + random.choice(["", "", "、", " ", "　"]) for c in text)
        rows.append((f"c{k % 280:03d}", kind, random.choice([text, text.upper(), text.lower()])))
    rows += [(None, "body", base[0]), ("n", "body", None), ("e", "qa_pair", "")]
    assert run(spark, rows) == brute(rows)
    # Every key of more than two rows as a hot one: the two-level path must agree.
    for most in (1, 2, 10**6):
        monkeypatch.setattr(D, "HOT_ROWS", most)
        assert run(spark, rows) == brute(rows)


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == (set(), set())
    rows = [("a", "body", "x" * 300_000), ("b", "body", "X " * 300_000)]
    assert run(spark, rows) == ({("a", "b")}, {("a", 2)})
