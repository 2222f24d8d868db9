"""Sharding, vectors, urls, components and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import texts
from pyspark.sql import functions as F
from plumbline.llm import embedding_dedup, prefix_forest, sharding, url_filter
from plumbline.llm.components import connected_components
from plumbline.llm.oracles import ORACLES
from plumbline.llm.queries import QUERIES, RULES

VECTORS = "vec_id long, embedding array<float>, label int, vector string, uid int, t int"


def vectors(seed: int = 4) -> list[tuple]:
    """Clusters, copies, scaled copies and vectors that cannot be used."""
    rng = np.random.default_rng(seed)
    out: list[tuple] = []
    add = lambda v: out.append((len(out), None if v is None else [None if x is None else float(x) for x in v], 1, "c", 2, 3))
    for i in range(120):
        centre = rng.standard_normal(16)
        add(centre)
        for _ in range(i % 4):
            add(centre + rng.standard_normal(16) * 0.2)
    for _ in range(30):
        add(out[3][1])
    add([2 * x for x in out[7][1]])
    for bad in (None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []):
        add(bad)
    return out


def usable(v) -> bool:
    return v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_duplicates_match_all_pairs(spark, monkeypatch):
    data = vectors()
    for block in (512, 8):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = embedding_dedup.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()
        good = {r[0]: np.array(r[1], np.float32).astype(float) for r in data if usable(r[1])}
        union, links = texts.Union([r[0] for r in data]), Counter()
        for a in good:
            for b in good:
                if a < b and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.95:
                    links[a] += 1
                    links[b] += 1
                    union.join(a, b)
        expected = {(r[0], links[r[0]], union.find(r[0]), union.find(r[0]) == r[0]) for r in data}
        assert {tuple(r) for r in got} == expected and len(got) == len(data)
        assert max(links.values()) >= 30


def test_hash_plan_keeps_its_promise():
    rng = np.random.default_rng(9)
    hashes = embedding_dedup.Hashes.plan(10_000, 0.95, 0.99)
    a = embedding_dedup.unit_rows(rng.standard_normal((600, 32)))
    other = embedding_dedup.unit_rows(rng.standard_normal((600, 32)) - 0)
    other = embedding_dedup.unit_rows(other - (other * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * other
    assert (hashes.keys(a) == hashes.keys(b)).any(axis=1).mean() > 0.97


def nearest_by_force(data: list[tuple], k: int, every: int) -> dict:
    good = {r[0]: np.array(r[1], np.float32).astype(float) for r in data if usable(r[1])}
    out = {}
    for q in good:
        if q % every == 0:
            scores = sorted((-math.fsum(good[q] * good[v]), v) for v in good if v != q)
            out[q] = [(v, -s) for s, v in scores[:k]]
    return out


@pytest.mark.parametrize("cell", [16_384, 32])
def test_forest_finds_the_nearest(spark, monkeypatch, cell):
    monkeypatch.setattr(prefix_forest, "CELL_ROWS", cell)
    data = vectors()
    got = prefix_forest.nearest(spark.createDataFrame(data, VECTORS), "vec_id % 5 = 0", k=10).collect()
    expected = nearest_by_force(data, 10, 5)
    found: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == expected.keys()
    hit = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hit >= 0.9 * sum(map(len, expected.values()))
    for q, answers in found.items():
        assert len(answers) == 10 and answers == sorted(answers, key=lambda x: (-x[1], x[0]))


def test_forest_returns_all_of_a_few(spark):
    data = vectors()[:6]
    got = prefix_forest.nearest(spark.createDataFrame(data, VECTORS), "vec_id % 2 = 0", k=20).collect()
    expected = nearest_by_force(data, 20, 2)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {
        (q, i + 1, v, s) for q, answers in expected.items() for i, (v, s) in enumerate(answers)
    }


@pytest.mark.parametrize("visits", [16_384, 8])
def test_forest_ascends_above_its_cells(spark, monkeypatch, visits):
    """Small cells, random vectors and an outlying norm: all candidates asked for are scored, and k rows found."""
    monkeypatch.setattr(prefix_forest, "CELL_ROWS", 16)
    monkeypatch.setattr(prefix_forest, "VISITS", visits)
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in v], 1, "c", 2, 3) for i, v in enumerate(rng.standard_normal((300, 16)))]
    data += [(300 + i, [float(x) * 1e4 for x in v], 1, "c", 2, 3) for i, v in enumerate(rng.standard_normal((5, 16)))]
    frame = spark.createDataFrame(data, VECTORS)
    expected = nearest_by_force(data, 20, 25)
    every = prefix_forest.nearest(frame, "vec_id % 25 = 0", candidates=1e9).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in every} == {
        (q, i + 1, v, s) for q, answers in expected.items() for i, (v, s) in enumerate(answers)
    }
    few = Counter(r["query_id"] for r in prefix_forest.nearest(frame, "vec_id % 25 = 0", trees=2, candidates=0.0).collect())
    assert few == dict.fromkeys(expected, 20)


def test_forest_searches_each_length_by_itself(spark, monkeypatch):
    """One vector of length 1, some of length 5 and many of length 16: each meets its own kind only."""
    monkeypatch.setattr(prefix_forest, "CELL_ROWS", 16)
    rng = np.random.default_rng(2)
    shapes = [1] + [5] * 40 + [16] * 200 + [16] * 3
    data = [(i, [float(x) for x in rng.standard_normal(n)], 1, "c", 2, 3) for i, n in enumerate(shapes)]
    frame = spark.createDataFrame(data, VECTORS).repartition(3)
    got = prefix_forest.nearest(frame, "vec_id % 4 = 0", k=6, candidates=1e9).collect()
    expected = {}
    for q, v, *_ in data:
        if q % 4 == 0:
            same = [(-math.fsum(np.array(v, np.float32).astype(float) * np.array(o, np.float32).astype(float)), i) for i, o, *_ in data if i != q and len(o) == len(v)]
            expected[q] = [(i, -s) for s, i in sorted(same)[:6]]
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {
        (q, n + 1, v, s) for q, answers in expected.items() for n, (v, s) in enumerate(answers)
    }
    assert expected[0] == [] and len(expected[4]) == 6


def test_shards_hold_every_row_once_and_grow_only_into_the_new_one(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_SLICE", 5)
    docs = texts.documents(spark)
    rows = sharding.assign(docs, [1.0, 1.0, 2.0, 1.0]).collect()
    source = docs.collect()
    size = lambda t: len((t or "").encode()) + 16
    expected = Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in source)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    for shard in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    by_key: dict = {}
    for r in rows:
        assert by_key.setdefault(r["doc_id"], r["shard"]) == r["shard"]


def test_shards_follow_their_weights(spark):
    keys = spark.range(20_000).select("id", sharding.choose_shard(F.col("id"), [1.0, 3.0]).alias("s"), sharding.choose_shard(F.col("id"), [1.0, 4.0]).alias("more"))
    assert abs(keys.where("s = 1").count() / 20_000 - 0.75) < 0.02
    assert keys.where("s = 1 AND more = 0").count() == 0
    with pytest.raises(ValueError):
        sharding.choose_shard(F.col("id"), [0.0])


URLS = [
    ("http://WWW.Example.com/en/a?b#c", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("https://a.net/fr/x", "a.net", "/fr/x", "net/fr/", "block"),
    ("https://a.net/FR/x", "a.net", "/FR/x", None, "allow"),
    ("https://a.com?x=/en/", "a.com", "", None, "allow"),
    ("ftp://h.org#://com/", "h.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
]


def test_urls_are_cut_and_judged_by_rule(spark):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, good string")
    labels = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels, RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}


def test_bad_hosts_are_blocked_and_little_known_ones_are_not(spark):
    rng = random.Random(1)
    data, labels = [], []
    for i in range(400):
        host = ("good.a.org", "bad.b.org", "other.a.org", "new.c.org")[i % 4 if i < 390 else 3]
        data.append((i, f"https://{host}/p{i}"))
        if i % 4 != 3 and i < 390:
            labels.append((i, int(rng.random() < (0.02 if i % 4 == 1 else 0.95))))
    labels.append((3, 0))
    labels.append((5, None))
    judged = url_filter.judge(spark.createDataFrame(data, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), RULES)
    verdicts = {(r["host"], r["verdict"]) for r in judged.collect()}
    assert verdicts == {("good.a.org", "allow"), ("bad.b.org", "block"), ("other.a.org", "allow"), ("new.c.org", "allow")}


def test_url_query_equals_its_sql(spark, sf_dir):
    got = QUERIES["op5_url_filter"](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    want = con.execute(ORACLES["op5_url_filter"]).df()[list(got.columns)]
    order = list(got.columns)
    assert got.sort_values(order).astype(str).values.tolist() == want.sort_values(order).astype(str).values.tolist()


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(5, 5), (1, 0), (7, 3)]
    random.Random(2).shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(30), 0), **dict.fromkeys(range(100, 141), 100)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(none).count() == 0
    assert prefix_forest.nearest(none, "true").count() == 0
    assert sharding.assign(texts.empty(spark), [1.0, 1.0]).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([], "page_id long, good int"), RULES).count() == 0


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "packing"]


def test_pipeline_stages_keep_clean_documents_and_columns(spark, sf_dir):
    docs = texts.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    out = docs
    stages = dict(corpus_pipeline.STAGES)
    out = stages["language_id"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {k for k in rows if not any(c.isalpha() for c in rows[k] or "")} <= gone
    clean = {k for k, t in rows.items() if k is not None and k < 60 and len(t) > 60}
    assert not clean & gone
    near = stages["ngram_jaccard_join"](spark, docs, sf_dir)
    assert near.columns == docs.columns
    kept = [r["doc_id"] for r in near.collect()]
    assert {k for k in rows if rows[k] is None or not rows[k].strip()} <= set(kept) and len(kept) < docs.count()
    cut = stages["suffix_array_dedup"](spark, near, sf_dir)
    assert cut.columns == docs.columns and cut.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sum(r["n_chars"] for r in cut.collect()) < sum(len(r["text"] or "") for r in near.collect())
    packed = stages["packing"](spark, cut, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in cut.collect()}


def test_one_row_of_each_near_duplicate_group_stays_whatever_the_ids(spark, sf_dir):
    text = lambda seed: " ".join(texts.words(texts.random.Random(seed), "en", 80))
    data = [(1, text(1)), (7, text(1)), (7, text(2)), (7, text(3)), (7, text(3)), (None, text(2)), (None, text(4)), (None, text(4)), (None, text(5)), (7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf_dir)
    assert near.columns == docs.columns
    expected = [(1, text(1)), (7, text(2)), (7, text(3)), (None, text(4)), (None, text(5)), (7, ""), (None, None)]
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter(expected)


CLASHES = ["kept", "n_bytes", "n_removed", "spans", "_row", "_place", "score", "lang_pred", "_score", "row", "doc", "_c0", "a.b"]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, sf_dir, stage):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = texts.documents(spark).select(*own)
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    run = dict(corpus_pipeline.STAGES)[stage]
    out, plain = run(spark, wide, sf_dir), run(spark, docs, sf_dir)
    if stage != "packing":
        assert out.columns == [*own, *CLASHES]
        assert [f.dataType for f in out.schema.fields] == [f.dataType for f in wide.schema.fields]
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in CLASHES)
        assert out.count() == plain.count()
    else:
        assert out.columns == plain.columns
    assert run(spark, wide.limit(0), sf_dir).count() == 0
