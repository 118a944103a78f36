"""Decontamination: short items, quotes in part and quotes with a word put in."""

from __future__ import annotations

import random

from tidemark.llm import decontaminate


def leaks(spark, items, docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, bench).collect()}


def test_short_items_are_found_inside_documents(spark):
    around = "quite another text that goes on for a while {} and then it ends somewhere else"
    items = [(1, "who painted the old ceiling"), (2, "why is the sky so blue"), (3, " ".join(f"w{i}" for i in "abcdefghij"))]
    docs = [(1, around.format("who painted the old ceiling")), (2, around.format("why is the sky so blue")), (3, around.format("who painted the ceiling")), (4, "why is the sky so blue"), (5, "who painted")]
    assert leaks(spark, items, docs) == {(1, 1), (2, 2), (4, 2)}


QUESTION = "a farmer keeps 12 hens and sells eggs every morning at the market near the bridge because 12 hens lay more than the family eats in one long summer week"


def test_values_outside_the_quoted_part_do_not_matter(spark):
    part = " ".join(QUESTION.split()[:20])  # holds the 12 at one place, and 12 again beyond the middle
    goes_on = f"{part} lay 77 other things that go 99 on quite differently from here until the text is over"
    assert QUESTION.split()[17:19] == ["12", "hens"]
    away = part.rsplit(" ", 4)[0] + " and then something else 55 hens of another kind that nobody asked about in this text"
    assert leaks(spark, [(1, QUESTION)], [(1, goes_on), (2, away)]) >= {(1, 1)}
    late = "one two three four five six seven 12 nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen 12 nineteen twenty"
    cut = " ".join(late.split()[:16]) + " other 55 words follow"
    assert leaks(spark, [(1, late)], [(1, cut), (2, late.replace("12", "31", 1))]) == {(1, 1)}


def test_an_inserted_word_does_not_hide_an_item(spark):
    w = QUESTION.split()
    put_in = " ".join([*w[:14], "quietly", *w[14:]])
    left_out = " ".join([*w[:14], *w[15:]])
    other = " ".join([*w[:14], "quietly", *w[14:]]).replace("12", "13", 1)
    assert leaks(spark, [(1, QUESTION)], [(1, put_in), (2, left_out), (3, other), (None, put_in)]) == {(1, 1), (2, 1), (None, 1)}


def test_values_correspond_one_to_one(spark):
    item = "first 3 birds saw 7 cats and then 3 dogs chased 7 birds and many cats over the hill"
    docs = [(1, item.replace("3", "5").replace("7", "9")), (2, item.replace("7", "3")), (3, item.replace("3", "8", 1)), (4, item)]
    assert leaks(spark, [(1, item)], docs) == {(1, 1), (4, 1)}  # 2 has one value for two, 3 two values for one


def test_windows_of_placeholders_match_by_their_words(spark):
    table = "3 5 7 9 11 13 15 17 19 21"
    other = "4 6 8 10 12 14 16 18 20 22"
    assert leaks(spark, [(1, table)], [(1, f"look at {table} here"), (2, f"look at {other} here")]) == {(1, 1)}


def test_texts_of_one_id_are_judged_apart(spark):
    half = QUESTION.split()
    first, second = " ".join(half[:13]) + " and so on", "then " + " ".join(half[17:])
    rows = [(1, first), (1, second), (2, QUESTION), (2, "quite another text of the same id"), (None, QUESTION), (None, "no leak"), (3, None)]
    assert leaks(spark, [(1, QUESTION)], rows) == {(2, 1), (None, 1)}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")
    left = decontaminate.without_leaks(docs, spark.createDataFrame([(1, QUESTION)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted(((i, t, "x") for i, t in rows if t != QUESTION), key=str)


def test_windows_equal_brute_force_both_ways(spark):
    """Random texts over few words, some of them numbers: every pair with enough consistent windows, and no other."""
    rng = random.Random(12)
    vocabulary = [*"abcdefgh", "1", "2", "3"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, make(rng.randint(12, 24))) for i in range(25)]
    docs = []
    for d in range(150):
        text = make(rng.randint(0, 20))
        if d % 3:
            words = rng.choice(items)[1]
            low = rng.randint(0, 4)
            part = words[low : low + rng.randint(8, 24)]
            if d % 3 == 2:
                renamed = dict(zip("123", rng.choices("456", k=3) if d % 2 else rng.sample("456", k=3), strict=True))
                part = [renamed.get(w, w) for w in part]
            text += part
        docs.append((d, text + make(rng.randint(0, 20))))

    def canonical(words):
        return ["#" if w.isdigit() else w for w in words]

    want = set()
    for i, a in items:
        ca, total = canonical(a), len(a) - 7
        for d, b in docs:
            cb = canonical(b)
            by_offset = {}
            for p in range(total):
                for q in range(len(b) - 7):
                    if ca[p : p + 8] == cb[q : q + 8]:
                        by_offset.setdefault(q - p, []).append(p)
            for offset, places in by_offset.items():
                slots = {k for p in places for k in range(p, p + 8) if ca[k] == "#"}
                pairs = {(a[k], b[k + offset]) for k in slots}
                if 2 * len(places) >= total and len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    want.add((d, i))
    got = leaks(spark, [(i, " ".join(w)) for i, w in items], [(d, " ".join(w)) for d, w in docs])
    assert len(want) > 30 and want <= got
    assert len(got - want) <= 3  # chains of neighbouring offsets may add a pair
