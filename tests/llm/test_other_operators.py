"""Operators over vectors, pages and URLs, graph helper and pipeline."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import embed_dedup, graph, store, url_filter, warc


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4), *((i, i + 1) for i in range(100, 180))]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), store.Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 181)}


def test_embedding_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 64))
    x[300:330] = x[0] + 0.1 * rng.standard_normal((30, 64))  # a dense group
    x[400:500] = x[1:101] + 0.2 * rng.standard_normal((100, 64))
    x[600:640] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = sum(r.n_links for r in got.values())
    assert links <= near.sum() and links >= 0.97 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert len({got[i].component_id for i in range(600, 640)} | {got[5].component_id}) == 1


@pytest.mark.parametrize("part", [1024, 16])
def test_embedding_counts_in_wide_and_dense_components(spark, part):
    """Chains, tight groups and repeated ids; small parts take the path of large components."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((400, 32))
    x[100:160] = x[3] + 0.02 * rng.standard_normal((60, 32))  # tight: all linked
    for i in range(200, 290):  # a chain: neighbours linked, ends not
        x[i] = x[i - 1] + 0.2 * rng.standard_normal(32)
    x[300:340] = x[7] + 0.15 * rng.standard_normal((40, 32))
    x[350:356] = x[9]
    ids = list(range(400))
    ids[355], ids[354] = 350, 9
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), block=64, part=part).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(400)
    while (new := np.minimum(label, np.where(near, label[None, :], 400).min(axis=1))).tolist() != label.tolist():
        label = new
    low = {c: min(ids[i] for i in range(400) if label[i] == c) for c in set(label.tolist())}
    assert got == sorted((ids[i], int(near[i].sum()), low[label[i]], ids[i] == low[label[i]]) for i in range(400))


def test_embedding_repeated_ids_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


@pytest.mark.parametrize("n", [4_000, 24_000])
def test_embedding_recall_of_lone_pairs_at_the_threshold(spark, n):
    """Production parameters: pairs at cosine 0.95 to 0.96 that have no other partner."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = n // 8
    side = rng.standard_normal((half, 64))
    side -= (side * x[:half]).sum(axis=1, keepdims=True) * x[:half]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9505, 0.96, (half, 1))
    x[half : 2 * half] = cosine * x[:half] + np.sqrt(1 - cosine**2) * side
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    out = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(rows).collect()}
    found = sum(out[half + i] == (1, i) for i in range(half))
    assert found >= 0.97 * half and all(out[i] == (0, i) for i in range(2 * half, n))


def test_passes_follow_the_number_of_vectors():
    passes = [embed_dedup.passes_for(n) for n in (0, 1, 10**3, 10**5, 10**7, 10**9)]
    assert passes == sorted(passes) and passes[0] == 8 and passes[-1] > 40


def test_embedding_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1.0, float("inf")]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (11, [1e-30, 2e-30])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    single = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)]
    assert got == sorted([(0, 0, None, True), *single, (7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (9, 4, 7, False), (10, 0, 10, True), (11, 4, 7, False)])
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_url_rules_and_parts(spark):
    rows = [
        ("http://A.Example.com/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("https://example.com/en/8#f", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/71", "notexample.com", "/en/71", "com/en/", "block"),
        ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("http://w.example.net/de/81", "w.example.net", "/de/81", "example.net/de/8", "block"),
        ("ftp://b.org/es/", "b.org", "/es/", "org/es/", "block"),
        ("http://b.org/es", "b.org", "/es", None, None),
        ("http://É.org?q=://z", "É.org", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("://h/p", "h", "/p", None, None),
    ]
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(rows)], "page_id long, url string, host string")
    for r in url_filter.filter_urls(df).collect():
        _, host, path, rule, verdict = rows[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_model_generalises(spark):
    rng = random.Random(1)

    def word(letters):
        return "".join(rng.choice(letters) for _ in range(8))

    def rows(n, letters, rejected):
        return [(f"http://{word(letters)}.info/{word(letters)}", rejected) for _ in range(n)]

    train = spark.createDataFrame([*rows(400, "abcde", False), *rows(400, "vwxyz", True)], "url string, rejected boolean")
    bits = url_filter.scorer(spark, url_filter.train(train))
    test = spark.createDataFrame([*rows(100, "abcde", False), *rows(100, "vwxyz", True)], "url string, rejected boolean").withColumn("bits", bits("url"))
    cut = url_filter.calibrate(test)
    assert test.filter((F.col("bits") < cut) == F.col("rejected")).count() >= 196


@pytest.mark.parametrize("split", [200, 5000, 1 << 20])
def test_warc_ranges_own_every_record_once(spark, split):
    rng = random.Random(2)
    payload = [bytes(rng.getrandbits(8) for _ in range(rng.randint(0, 600))) + warc._MAGIC * 3 + b"WARC/1.0" for _ in range(150)]
    rows = [("response", f"urn:page:{i}", f"http://u/{i}", bytearray(p), "d", len(p), None) for i, p in enumerate(payload)]
    scratch = store.Scratch(spark, "warc-test")
    files = scratch.table(warc.write_warc(spark.createDataFrame(rows, "kind string, record_id string, uri string, payload binary, digest string, length long, refers_to string"), scratch.path + "/a"))
    back = warc.read_warc(spark, files, scratch.path + "/a", split).collect()
    assert sorted(r.record_id for r in back) == sorted(f"urn:page:{i}" for i in range(150))
    assert all(bytes(r.payload) == payload[int(r.record_id[9:])] for r in back)


def test_archive_round_trip(spark):
    big = "é" * 80
    rows = [(3, "http://a", big), (1, "http://b\nc", big), (2, None, big), (4, "u", None), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", ""), (8, "u", "y" * 300_000), (1, "again", big), (None, "n", big)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.length, r.digest) for r in warc.archive(df).collect())

    def want(i, first, html):
        body = (html or "").encode()
        return (i or 0, "revisit" if first is not None and first != i and i else "response", first if first is not None and first != i and i else None, len(body), hashlib.sha256(body).hexdigest())

    expected = sorted(want(i, 1 if html == big else None, html) for i, _, html in rows)
    none = [r for r in got if r[0] == 0]
    assert [r for r in got if r[0]] == [r for r in expected if r[0]] and len(none) == 1
    assert warc.archive(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.Scratch(spark, "t").table(stage(spark, docs, sf))
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns) and 0 < docs.count() <= n, name
        n = docs.count()
    assert docs.filter("copies < 1 or taken < 1").isEmpty()


def test_stages_take_edge_rows(spark):
    """What each stage keeps of nulls, repeats and shared ids; an empty table stays empty."""
    sf = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").select("text").orderBy("item_id").first()[0]
    own = [f"a line of its own number {i} with some more words about nothing much" for i in range(4)]
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (3, own[0]), (None, "a b"), (4, "word " * 30_000), (5, leak), (5, own[1]), (None, own[2])]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    out = {name: collections.Counter((r.doc_id, r.text) for r in stage(spark, docs, sf).collect()) for name, stage in corpus_pipeline.STAGES}
    every = collections.Counter(rows)
    assert not out["quality_classifier"].keys() & {(1, None), (2, "")} and out["quality_classifier"] <= every
    assert out["line_dedup"] == every
    assert out["ngram_join"] == every - collections.Counter([(3, "one two three")])
    assert out["decontamination"] == every - collections.Counter([(5, leak)])
    assert out["mixing"] <= every and not out["mixing"].keys() & {(1, None), (2, "")}
    mixed = stages["mixing"](spark, docs, sf).collect()
    assert all(r.taken == r.copies * len((r.text or "").split()) for r in mixed if r.text != "one two three")


def test_ngram_stage_keeps_other_texts_of_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, b), (3, a), (3, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, docs, "").collect()) == [(1, a), (2, b), (3, c)]
