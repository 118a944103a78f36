"""Operators over documents: edge cases and brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import bloom_lm, decontaminate, hashing, line_dedup, mixing, ngram_join, pii, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, n long, copies string"
LONG = "lorem ipsum dolor " * 20_000
EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (5, LONG), (None, "x y z w v u"), (6, "one two"), (7, "a\n\nb\n")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 0, 9, 9, 9, "x") for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) + "p" for _ in range(60))
    out = []
    for i in range(120):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(2, 14))]
        if i % 6 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 10 == 1:
            base = out[-1].split("\n")
            lines = [" ".join("changed" if rng.random() < 0.01 else w for w in line.split(" ")) for line in base]
        out.append("\n".join(lines))
    out[50] = out[49]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)


def test_word_hashes_are_those_of_words():
    sample = pa.array(["The  Cat\tthe", None, "", "É é cat\x0b", "cat"])
    word, first = hashing.word_hashes(sample)
    assert np.diff(first).tolist() == [3, 0, 0, 3, 1]
    assert word[0] == word[2] and word[1] == word[5] == word[6] and word[3] != word[4]
    long = "ab" * hashing.STEP
    again, _ = hashing.word_hashes(pa.array([f"x {long} y {long}"]))
    assert again[1] == again[3] and len(set(again.tolist())) == 3


# --- n-gram join


def sets_of(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(pairs):
    sets = dict(pairs)
    parent = {d: d for d in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("chunk", "elements"), [(4000, 2_000_000), (3, 2_000_000), (4000, 300)])
def test_ngram_join_equals_brute_force(spark, texts, chunk, elements):
    rng = random.Random(9)
    rows = list(enumerate(texts))
    base = texts[7].split()
    for i in range(200, 215):  # a large group of near copies, each with other changes
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"new{i}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, elements=elements).collect()}
    want = brute_components((i, sets_of(t)) for i, t in rows)
    assert got == {i: (len(sets_of(t)), want[i]) for i, t in rows}


def test_trie_equals_pairs():
    rng = np.random.default_rng(1)
    base = rng.choice(10_000, 60, replace=False)
    sets = [np.sort(np.concatenate([rng.choice(base, rng.integers(30, 60), replace=False), rng.choice(np.arange(20_000, 30_000), rng.integers(0, 12), replace=False)])) for _ in range(60)]
    links = ngram_join.trie_links(sets)
    want = brute_components((i, frozenset(s.tolist())) for i, s in enumerate(sets))
    parent = {i: i for i in range(60)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert 100 * len({*sets[a].tolist()} & {*sets[b].tolist()}) >= 80 * len({*sets[a].tolist()} | {*sets[b].tolist()})
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(60)} == want


def test_ngram_join_judges_texts_of_one_id_apart(spark, texts):
    one, two, other = texts[2], texts[3], texts[4]
    changed = " ".join([*one.split()[:-1], "changed"])
    rows = [(1, one), (1, one), (2, two), (3, one), (3, other), (4, changed), (None, one), (5, ""), (5, ""), (6, None), (None, "some words of its own here")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, t int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.jaccard_components(docs).collect())
    n = lambda t: len(sets_of(t))
    assert got == sorted([(1, n(one), 1), (1, n(one), 1), (2, n(two), 2), (3, n(one), 1), (3, n(other), 3), (4, n(changed), 1), (0, n(one), 1), (5, 0, 5), (5, 0, 5), (6, 0, 6), (0, 2, 0)])
    left = ngram_join.without_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, one), (2, two), (3, other), (5, ""), (5, ""), (6, None), (None, rows[-1][1])], key=str)
    assert ngram_join.without_near_copies(docs.limit(0)).count() == 0


def test_without_near_copies_keeps_one_of_each_group(docs, texts):
    kept = {r.doc_id for r in ngram_join.without_near_copies(docs).collect()}
    assert kept == set(brute_components((i, sets_of(t)) for i, t in enumerate(texts)).values())


def test_ngram_join_edges(edges, empty):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(edges).collect())
    assert got == [(0, 2, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 3, 5), (6, 1, 4), (7, 1, 7)]
    assert ngram_join.jaccard_components(empty).count() == 0


# --- line dedup


def test_line_dedup_removes_repeated_passages_only(docs, texts):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    count = collections.Counter(line for t in texts for line in set(t.split("\n")))
    left = collections.Counter(line for r in out.values() for line in r.text.split("\n"))
    long = [line for line, n in count.items() if n > 1 and len(line.split()) > 50]
    assert long and all(left[line] == 1 for line in long)
    for i, t in enumerate(texts):
        if not any(count[line] > 1 for line in t.split("\n")):
            assert out[i].text == t and out[i].n_removed == 0
        lines = t.split("\n")
        gone = {k for s in out[i].removed for k in range(s["first"], s["last"] + 1)}
        assert out[i].n_lines == len(lines) and out[i].n_removed == len(gone)
        assert out[i].text == "\n".join(x for k, x in enumerate(lines, 1) if k not in gone)
        for k in gone:  # what is cut is still there elsewhere
            assert left[lines[k - 1]] >= 1
    assert out[50].text == "" and 49 in out[50].kept_in


def spark_hash(value, seed=42):
    data = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(data, seed & (2**64 - 1))))[0]


def brute_chunks(text):
    """(number, first line, lines) of the chunks that aren't blank."""
    lines = text.split("\n")
    h = [spark_hash(x) for x in lines]
    solid = [x.count(" ") >= line_dedup.SOLID_LINE - 1 for x in lines]
    starts = [i for i in range(len(lines)) if i == 0 or solid[i] or solid[i - 1] or spark_hash(h[i], spark_hash(h[i - 1])) % line_dedup.MODULUS == 0]
    chunks = [(a, lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
    return [(k, a, c) for k, (a, c) in enumerate(x for x in chunks if any(x[1]))]


def chunk_words(lines):
    return sum(x.count(" ") + (len(x) > 0) for x in lines)


def brute_dedup(rows):
    """Text of each (doc_id, text), by plain dictionaries of the chunks' bytes."""
    distinct = {(i, t): brute_chunks(t) for i, t in rows if t}
    number = collections.Counter(row for row in rows if row[1])
    places = collections.defaultdict(list)
    for (i, t), chunks in distinct.items():
        for k, _, c in chunks:
            places["\n".join(c)] += [(i, spark_hash(t), k)] * number[i, t]
    keep = {body: min(at) for body, at in places.items() if len(at) > 1}
    out = {}
    for (i, t), chunks in distinct.items():
        held = [(k, a, c, keep["\n".join(c)]) for k, a, c in chunks if "\n".join(c) in keep]
        gone = set()
        for n, (k, a, c, first) in enumerate(held):
            low = high = n
            while low and held[low - 1][0] == held[low][0] - 1:
                low -= 1
            while high + 1 < len(held) and held[high + 1][0] == held[high][0] + 1:
                high += 1
            several = any(low <= n + s <= high and held[n + s][3] == (*first[:2], first[2] + s) for s in (-1, 1))
            total = sum(chunk_words(x[2]) for x in held[low : high + 1])
            if (len(c) > 1 or several or chunk_words(c) >= line_dedup.LONG_LINE or total >= line_dedup.RUN_WORDS) and first != (i, spark_hash(t), k):
                gone |= set(range(a, a + len(c)))
        out[i, t] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return [(i, out.get((i, t), t)) for i, t in rows]


def test_line_dedup_equals_brute_force(spark, texts):
    rng = random.Random(13)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 1, 2, 4, 7, 12, 30)))) for _ in range(40)]
    rows = [*enumerate(texts), *((1000 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(80))]
    rows += [rows[3], rows[3], (3, "another text\nof the same id"), (2000, None), (2001, "")]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(brute_dedup(rows), key=str)
    assert sum(a != b for a, b in zip(sorted(got, key=str), sorted(rows, key=str), strict=True)) > 30


@pytest.mark.parametrize(("lines", "low", "high"), [(3, 18, 24), (4, 14, 20), (6, 10, 10), (9, 6, 8)])
def test_line_dedup_finds_passages_between_short_lines(spark, lines, low, high):
    rng = random.Random(lines)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, passages = [], []
    for i in range(60):
        passages.append([make(rng.randint(low, high)) for _ in range(lines)])
        for k in (2 * i, 2 * i + 1):
            rows.append((k, "\n".join([*(make(rng.randint(1, 5)) for _ in range(rng.randint(0, 4))), *passages[-1], *(make(rng.randint(1, 5)) for _ in range(rng.randint(0, 4)))])))
    assert all(sum(len(x.split()) for x in p) > 50 for p in passages)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, passage in enumerate(passages):
        assert out[2 * i] == rows[2 * i][1]
        assert out[2 * i + 1] == "\n".join(x for x in rows[2 * i + 1][1].split("\n") if x not in passage)


def test_line_dedup_repeated_rows_and_null_ids(spark):
    block = "\n".join(" ".join(f"{c}{i}" for c in "abcdefgh") for i in range(8))
    rows = [(1, block), (1, block), (2, "own line here\n\n" + block), (None, "null id\n" + block), (3, None)]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "", 8), (1, "", 8), (2, "own line here\n", 8), (None, "null id\n" + block, 0), (3, None, 0)], key=str)


def test_line_dedup_is_shift_resistant(spark):
    block = "\n".join(f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}" for i in range(14))
    rows = [(1, "head one\n" + block + "\ntail"), (2, "a\nb\nc\n" + block + "\nend of two")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[2].n_removed >= 10 and out[2].kept_in == [1]


def test_line_dedup_edges(edges, empty):
    out = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(edges).collect()]
    assert sorted(out, key=str) == sorted(((i, t, 0) for i, t in EDGES), key=str)
    assert line_dedup.dedup_lines(empty).count() == 0


# --- mixing


def test_mixing_meets_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    assert [r.taken for r in sorted(rows, key=lambda r: r.doc_id)] == [r.taken for r in sorted(mixing.mix_sources(docs.repartition(3)).collect(), key=lambda r: r.doc_id)]
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    assert math.isclose(sum(target.values()), 1.5 * sum(r.size for r in rows))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_targets_reshare_the_excess():
    got = mixing.targets([("b", 10), (None, 100), ("a", 1000), ("B", 500)])
    assert got["a"] == pytest.approx(1610 * 1.5 - 20 - 200 - got["B"]) and got["b"] == 20 and got[None] == 200
    assert got["B"] <= 1000 and got["a"] <= 2000  # weights by code point: B 5, a 2, b 1, null 5


def test_mixing_edges(edges, empty):
    rows = mixing.mix_sources(edges).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((i or 0, len(words(t))) for i, t in EDGES)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix_sources(empty).count() == 0


# --- decontamination

ITEM = "Every morning Maria walks 12 km to the mill and then carries 30 kg of flour back along the old road to her village"


def test_decontamination_finds_leaks_and_templates(spark):
    clean = "some quite different words about a river and a bridge over it that nobody ever asked a question about in any test"
    other = ITEM.replace("Maria", "Peter").replace("12", "15").replace("30", "45")
    mixed = "first 3 birds saw 3 cats and then 7 dogs chased 3 birds and 7 cats over the hill"
    bench = spark.createDataFrame([(1, ITEM), (2, mixed), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, f"before it. {ITEM} after it"), (2, f"x y. {other}"), (3, clean), (4, None), (5, ""), (6, mixed.replace("3", "4").replace("7", "9")), (7, "first 3 birds saw 4 cats and then 7 dogs chased 8 birds and 9 cats over the hill")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, words string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (6, 2)}  # 7 has the template with inconsistent slots
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [3, 4, 5, 7]


def test_decontamination_equals_brute_force(docs, texts, spark):
    items = [(i, " ".join(texts[i].split()[5:30])) for i in range(0, 120, 17)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.windows for r in decontaminate.leaks(docs, bench).collect()}

    def canonical(t):
        return re.sub("[0-9]+", "#", t).split()

    want = {}
    for i, t in items:
        a = canonical(t)
        for d, x in enumerate(texts):
            b = canonical(x)
            best = max((sum(b[o + k : o + k + 8] == a[k : k + 8] for k in range(len(a) - 7) if o + k >= 0) for o in range(-len(a), len(b))), default=0)
            plain = best >= 0.5 * (len(a) - 7)
            if plain:
                want[d, i] = best
    for key, n in got.items():  # slots may only take away
        assert want[key] == n
    assert all((i, i) in got for i, _ in items)


def test_decontamination_edges(edges, empty, spark):
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(edges, bench).collect()) == [4, 6]
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.without_leaks(edges, bench.limit(0)).count() == len(EDGES)


# --- personal data

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def test_pii_base_equals_regex(spark):
    rng = random.Random(5)
    pieces = ["a@b.c_d@e.f", "x..y@host-name.co.uk.", "1.2.3.4", "256.1.1.1", "01.002.0003.4.5", "4785 3805-9239 1138", "4785380592391139", "+1 (835) 555-0199", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
              "é😀 5500 0000 0000 0004", "a@b", "@x.y", "9" * 19, "0" * 16, "1" * 5000, "3.4", "+44.20.7946.0958", "q@q.q@q.q", "1.2.3.4.5.6.7.8"]
    texts = [None, "", *pieces, *(" ".join(rng.choice(pieces) for _ in range(8)) for _ in range(150)), *("".join(rng.choice("+1 2.3-(4)@ab5670é ") for _ in range(60)) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(rows).collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, t) if valid(kind, m.group()))
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r.base] == want, t
        assert all(s["value"] == t[s["start"] : s["end"]] for s in [*r.base, *r.found])


def spans_of(row, source="found"):
    return [(s["kind"], s["value"]) for s in row[source]]


def test_pii_bootstraps_unseen_identifiers(spark):
    rows = [
        *((i, f"please write to contact mail: user{i}@host{i}.org today") for i in range(30)),
        *((100 + i, f"for help ring me on +1 (974) 555-34{i:02d} tonight") for i in range(30)),
        *((200 + i, f'config holds access token = "{i:02d}ab34cd56ef7890ab{i:02d}" since then') for i in range(10)),
        (300, "please write to contact mail: someone.9@localhost today, room 12345678 is free"),
        (301, "for help ring me on 0800-555-0199 tonight"),
        (302, "for help ring me on 0800 555 0198 tonight"),
        (303, 'config holds access token = "zz99yy" since then'),
        (304, "someone.9@otherhost 0800-555-0777 and 12345678 stand alone here, token or not"),
    ]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(len(out[i].base) == 1 and not out[i].found for i in [*range(30), *range(100, 130)])
    assert all(spans_of(out[200 + i]) == [("secret", f"{i:02d}ab34cd56ef7890ab{i:02d}")] for i in range(10))
    assert {i: spans_of(out[i]) for i in range(300, 305)} == {
        300: [("email", "someone.9@localhost")], 301: [("phone", "0800-555-0199")], 302: [("phone", "0800 555 0198")], 303: [("secret", "zz99yy")], 304: [],
    }
    assert all(not out[i].base for i in range(300, 305))
    assert all(s["value"] == texts[i][s["start"] : s["end"]] for i in out for s in out[i].found)


def test_pii_rounds_reach_patterns_without_seeds(spark):
    """A value only seen after ``dial this`` is found through values that ``ring me on`` made believed."""
    rows = [
        *((i, f"for help ring me on +1 (974) 555-34{i:02d} tonight") for i in range(60)),
        *((100 + i, f"for help ring me on 0800-77{i:02d} tonight") for i in range(12)),
        *((200 + i, f"you may dial this 0800-77{i:02d} instead") for i in range(12)),
        (300, "you may dial this 0900-5555 instead"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {n: {r.doc_id: spans_of(r) for r in pii.personal_data(docs, rounds=n).collect()} for n in (1, 3)}
    assert found[1][300] == [] and found[1][100] == [("phone", "0800-7700")]
    assert found[3][300] == [("phone", "0900-5555")] and found[3][205] == [("phone", "0800-7705")]


def test_pii_confidence_equals_brute_force(spark):
    rng = random.Random(6)
    edges = {(f"p{rng.randrange(12)}", f"v{rng.randrange(60)}") for _ in range(260)}
    seed = {f"v{i}": rng.choice(("email", "phone")) for i in range(0, 60, 2)}
    rows = [(p, v, seed.get(v, "")) for p, v in sorted(edges)]
    got = pii.score_patterns(spark.createDataFrame(rows, "pattern string, value string, kind string"), pii.Scratch(spark, "t"), 4, 0.3, 2).collect()
    width = collections.Counter(p for p, _ in edges)
    belief, kept = {(v, k): 1.0 for v, k in seed.items()}, {}
    for _ in range(4):
        mass = collections.Counter()
        for p, v in edges:
            for k in ("email", "phone"):
                if (v, k) in belief:
                    mass[p, k] += belief[v, k]
        kept = {(p, k): m / (width[p] + 0.5) for (p, k), m in mass.items() if m >= 2 and m / (width[p] + 0.5) >= 0.3}
        belief = {(v, k): 1.0 for v, k in seed.items()}
        for p, v in edges:
            for k in ("email", "phone"):
                if (p, k) in kept:
                    belief[v, k] = max(belief.get((v, k), 0.0), kept[p, k])
    assert kept and {(r.pattern, r.kind): pytest.approx(r.conf) for r in got} == kept


def test_pii_long_texts_take_linear_time(spark):
    many = " ".join(f"user{i}@host{i % 97}.org" for i in range(20_000))
    texts = ["ab" * 1_500_000, "12" * 500_000, "a" * 1_000_000 + "1", "a@" * 250_000, "1." * 100_000, "+1 " * 100_000, many]
    began = time.time()
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert len(out[6].base) == 20_000 and all(s["value"] == many[s["start"] : s["end"]] for s in out[6].base)
    assert len(out[4].base) == 25_000 and not out[0].base and not out[0].found


def test_pii_query_digest(spark, tmp_path):
    """Counts, hash and joined spans of the registered query, from plain regular expressions."""
    texts = [None, "", "é a@b.cc, 10.0.0.1 and +1 (835) 555-0199; 4785 3805-9239 1138 or 5500000000000004", "999.1.1.1 only", "+44 20 7946 0958 x@y.z"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op4_pii(spark, str(tmp_path)).collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, t) if valid(kind, m.group()))
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == joined
        assert [r[f"n_{kind}"] for kind, _ in KINDS] == [sum(w[3] == kind for w in want) for kind, _ in KINDS] and r.n_spans == len(want)


def test_pii_edges(edges, empty):
    rows = pii.personal_data(edges).collect()
    assert len(rows) == len(EDGES) and all(not r.base and not r.found for r in rows)
    assert pii.personal_data(empty).count() == 0


# --- language model


def test_bloom_lm_base_is_exact(docs, texts):
    out = {r.doc_id: r for r in bloom_lm.score_texts(docs).collect()}
    small = {r.doc_id: r for r in bloom_lm.score_texts(docs, table_words=100).collect()}  # most words come by the join
    none = {r.doc_id: r for r in bloom_lm.score_texts(docs, table_words=0).collect()}
    tokens = {i: [*words(t), "</s>"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i in tokens:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        for r in (out[i], small[i], none[i]):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
            assert r.base_score == pytest.approx(base, rel=1e-9)
        assert out[i].score <= 0 and small[i].score == pytest.approx(out[i].score) == pytest.approx(none[i].score)


def quantised(count):
    return float(bloom_lm.TYPICAL[bloom_lm.level_of(np.array([count]))[0]]) if count else 0.0


def test_bloom_lm_score_equals_brute_force(docs, texts):
    """The same model from plain dictionaries of counts; with many bits a key the filter reads hardly any count too high."""
    out = {r.doc_id: r for r in bloom_lm.score_texts(docs, bits_per_key=1024).collect()}
    tokens = {i: [*words(t), "</s>"] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for i in train for w in tokens[i])
    pairs = {i: list(zip(["<s>", *tokens[i][:-1]], tokens[i], strict=True)) for i in tokens}
    two = collections.Counter(p for i in train for p in pairs[i])
    n, v = sum(one.values()), len(one)
    once, twice = (sum(k == x for k in two.values()) for x in (1, 2))
    delta = once / (once + 2 * twice)
    size, kinds = collections.Counter(), collections.Counter()
    group = lambda a: "<s>" if a == "<s>" else quantised(one[a])
    for i in train:
        for a, b in pairs[i]:
            size[group(a)] += 1
            kinds[group(a)] += 1 / quantised(two[a, b])
    assert len(two) * 0.9 < sum(kinds.values()) < len(two) * 1.1  # every distinct pair counts about once
    for i in tokens:
        score = 0.0
        for a, b in pairs[i]:
            single = (quantised(one[b]) + 0.5) / (n + 0.5 * (v + 1))
            count = float(len(train)) if a == "<s>" else quantised(one[a])
            p = max(min(quantised(two[a, b]), count) - delta, 0) / count + delta * kinds[group(a)] / size[group(a)] * single if count else single
            score += math.log10(min(p, 1.0))
        assert out[i].score == pytest.approx(score, rel=1e-3)


def test_bloom_lm_knows_pairs_seen_once(spark):
    """A held-out copy of a training text scores above other held-out texts."""
    rng = random.Random(8)
    make = lambda: " ".join(f"v{rng.randrange(3000)}" for _ in range(80))
    rows = [(i, make()) for i in range(200)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    kept = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    copies = dict(zip(held[: len(held) // 2], kept, strict=False))
    rows = [(i, rows[copies[i]][1] if i in copies else t) for i, t in rows]
    out = {r.doc_id: r.score for r in bloom_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(out[i] for i in copies) > max(out[i] for i in held if i not in copies)


def test_filter_reads_counts_back():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64)) << np.uint64(1)
    known, other = key[::2], key[1::2]
    level = rng.integers(1, 12, len(known))
    bucket = (known >> np.uint64(62)).astype(int)
    parts = [(b, bloom_lm._segment(known[bucket == b], level[bucket == b], 12, 1 << 30).tobytes()) for b in range(4)]
    read = bloom_lm.Filter(parts, 2)
    assert (read.level(known) >= level).all() and (read.level(known) == level).mean() > 0.97
    assert (read.level(other) > 0).mean() < 0.03
    assert (bloom_lm.Filter(parts[:2], 2).level(known[bucket > 1]) == 0).all()
    tight = bloom_lm.Filter([(b, bloom_lm._segment(known[bucket == b], level[bucket == b], 12, 500).tobytes()) for b in range(4)], 2)
    assert tight.data.nbytes <= 8 * 2001 and (tight.level(known) >= level).all()
    assert (bloom_lm.TYPICAL[bloom_lm.level_of(np.arange(1, 4))] == np.arange(1, 4)).all()


def test_word_table_finds_its_words():
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 2**63, 5_000).astype(np.uint64)) << np.uint64(1)
    table = bloom_lm.Words(rng.permutation(key[::2]), np.arange(len(key[::2])))
    place = table.find(key)
    assert (table.key[place[::2]] == key[::2]).all() and (place[1::2] == -1).all()
    assert (bloom_lm.Words(np.empty(0, np.uint64), np.empty(0, np.int64)).find(key) == -1).all()


def test_bloom_lm_edges(edges, empty):
    rows = bloom_lm.score_texts(edges).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(words(t)) + 1) for i, t in EDGES)
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert bloom_lm.score_texts(empty).count() == 0


# --- quality


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85])
    votes = np.where(rng.random((20_000, 3)) < right, good[:, None], ~good[:, None]).astype(int)
    known = np.where(rng.random(20_000) < 0.3, good.astype(int), -1)
    rows, count = np.unique(np.column_stack([votes, known]), axis=0, return_counts=True)
    model = quality.expectation_maximisation(rows[:, :3], count.astype(float), rows[:, 3])
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.95
    assert np.abs(model.table[:, 0, 1] - right).max() < 0.05


def test_quality_separates_junk_and_insults(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(800)]

    def prose(n=80):
        return ". ".join(" ".join(rng.choice(vocabulary) for _ in range(10)).capitalize() for _ in range(n // 10))

    rows, labels = [], []
    for i in range(600):
        t, kind = prose(), i % 12
        if kind == 0:
            t = " ".join(w + "###" for w in t.split())
        elif kind == 1:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif kind == 2:
            t = " ".join(t.split()[:6] * 14)
        elif kind == 3:
            w = t.split()
            for k in (5, 20, 40):
                w[k] = rng.choice(quality.INSULTS)
            t = " ".join(w)
        rows.append((i, t))
        if i % 3:
            labels.append((i, int(kind > 2), int(kind == 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), None):
        out = {r.doc_id: r.accepted for r in quality.classify(docs, table).collect()}
        assert sum(out[i] == (i % 12 > 3) for i in out) >= 588
    assert all(out[i] for i in out if i % 12 > 3)


def test_quality_edges(edges, empty, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(edges, labels).collect()
    assert len(rows) == len(EDGES) and not any(r.accepted for r in rows if not words(r.text))
    assert rows[0]["copies"] == "x"
    assert quality.classify(empty, labels).count() == 0
