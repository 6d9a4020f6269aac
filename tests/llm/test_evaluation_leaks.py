import random

from corpusloom.llm import evaluation_leaks as E

ITEM = "item_id long, text string, length long"
DOC = "doc_id long, text string, covered long"


def brute(items, docs):
    out = set()
    for i, a in items:
        a = E.canonical(a)
        if len(a) < E.WINDOW:
            continue
        for d, b in docs:
            b = E.canonical(b)
            grams = {b[k : k + E.WINDOW] for k in range(len(b) - E.WINDOW + 1)}
            covered = {p for k in range(len(a) - E.WINDOW + 1) if a[k : k + E.WINDOW] in grams for p in range(k, k + E.WINDOW)}
            if 2 * len(covered) >= len(a):
                out.add((i, d))
    return out


def frames(spark, items, docs):
    return spark.createDataFrame([(*x, 0) for x in items], ITEM), spark.createDataFrame([(*x, 0) for x in docs], DOC)


def noisy(text):
    text = "".join(c + random.choice(["", "", "", " ", "、", "\n"]) for c in text)
    return random.choice([text, text.upper(), text.replace("漢", "漢《かん》"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" or "0" <= c <= "9" else c for c in text)])


def test_against_brute_force(spark, monkeypatch):
    random.seed(2)
    word = lambda n: "".join(random.choice("漢字仮名交じり文abckm019カナ年") for _ in range(n))
    items = [(k, word(random.randint(15, 90))) for k in range(25)] + [(90, None), (91, ""), (3, None)]
    docs = []
    for d in range(80):
        _, a = items[random.randrange(25)]
        cut = random.randint(0, len(a))
        docs.append((d, word(30) + noisy(a[cut:]) + word(25) + noisy(a[:cut][-40:]) + "［＃注］"))
    docs += [(900, None), (901, ""), (5, docs[5][1])]
    want = brute([x for x in items if x[1]], [x for x in docs if x[1]])
    assert len(want) > 20
    assert {tuple(r) for r in E.leaks(*frames(spark, items, docs)).collect()} == want
    monkeypatch.setattr(E, "BLOCK_WINDOWS", 200)  # many blocks of items
    assert {tuple(r) for r in E.leaks(*frames(spark, items, docs)).collect()} == want


def test_reparameterised_questions_need_consistent_slots(spark):
    item = "ある商人が三人にリンゴを 12 個ずつ配り、さらに 7 個を買い足して 12 個を市場で売った。残りは何個か求めよ。"
    good = "前置き。" + item.replace("12", "45").replace("7", "3") + "後書き。"
    mixed = item.replace("12", "45", 1)
    got = {tuple(r)[:2] for r in E.reparameterised(*frames(spark, [(1, item)], [(1, good), (2, mixed), (3, item), (4, "無関係" * 50)])).collect()}
    assert got == {(1, 1)}


def test_names_and_units_are_slots():
    a, slots = E.collapse("Then Alice bought 12 km of rope for Bob.")
    b, others = E.collapse("Then Carol bought 7 miles of rope for Dan.")
    assert [v for _, v in slots] == ["alice", "12", "km", "bob"] and a.startswith("then\ua002bought\ua000\ua001of")
    assert E.collapse(None) == ("", []) and [v for _, v in others] == ["carol", "7", "dan"]


def test_empty_tables_and_long_document(spark):
    items, docs = frames(spark, [(1, "あ" * 10 + "いろはにほへとちりぬるをわかよたれそつね")], [(1, "い" * 400_000 + "いろはにほへとちりぬるをわかよたれそつね")])
    assert E.leaks(items.where("false"), docs).count() == 0 and E.leaks(items, docs.where("false")).count() == 0
    assert E.leaks(items, docs).count() == len(brute([(1, "あ" * 10 + "いろはにほへとちりぬるをわかよたれそつね")], [(1, "い" * 400_000 + "いろはにほへとちりぬるをわかよたれそつね")]))


def test_reparameterised_copies_are_judged_one_by_one(spark):
    body = "ある商人が三人にリンゴを 12 個ずつ配り、さらに 7 個を買い足して 12 個を市場で売った。残りは何個か求めよ。"
    told = "次の問いを読み 5 行以内で必ず日本語だけで答えなさい。"
    other, third = body.replace("12", "45").replace("7", "3"), body.replace("12", "86").replace("7", "9")
    docs = [
        (1, f"{body}つなぎの文。{other}"), (2, f"{other}つなぎの文。{third}"), (3, f"{other}つなぎの文。{body}"), (4, f"{body}つなぎの文。{body}"),
        (5, body.replace("12", "45", 1) + "つなぎの文。" + body), (6, body),
    ]
    got = {tuple(r)[:2] for r in E.reparameterised(*frames(spark, [(1, body)], docs)).collect()}
    assert got == {(1, 1), (1, 2), (1, 3)}
    repeated = [(1, told.replace("5", "8") + "別の話 4 つ。" + told.replace("5", "2") + other), (2, told + "別の話 4 つ。" + told + body)]
    assert {tuple(r)[:2] for r in E.reparameterised(*frames(spark, [(1, told + body)], repeated)).collect()} == {(1, 1)}


def test_a_verbatim_list_is_no_copy_of_itself(spark):
    item = "".join(f"つぎの品物の値段は {k} 円である。" for k in range(1, 9))
    assert E.reparameterised(*frames(spark, [(1, item)], [(1, "前置き。" + item)])).count() == 0


def test_equal_windows_have_equal_templates_and_slots_wherever_they_stand():
    random.seed(9)
    word = lambda n: "".join(random.choice("12kminutes年カa") for _ in range(n))
    inner = [word(E.WINDOW) for _ in range(300)]
    texts = [word(random.randint(0, 9)) + x + word(random.randint(0, 9)) for x in inner for _ in range(4)]
    b = E.Batch(texts)
    seen, templates = {}, set()
    for t, p, template, slots in zip(b.text, b.position, b.template, b.slots):
        window = texts[t][p : p + E.WINDOW]
        assert seen.setdefault(window, (template, slots)) == (template, slots)
        templates.add(template)
    assert len({x for x, _ in seen.values()}) == len(templates) < len(set(seen)) == len(set(seen.values()))


def test_typed_slots():
    a, b, c = (E.Batch([x]) for x in ("彼はカナの町まで12km歩いて帰ったという話である", "彼はミヨの町まで35mm歩いて帰ったという話である", "彼はカナの町まであと年歩いて帰ったという話である"))
    assert (a.template == b.template).sum() >= 3 and not (a.slots == b.slots)[a.template == b.template].any() and not set(a.template) & set(c.template[:9])
