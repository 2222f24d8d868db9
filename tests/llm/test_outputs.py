"""Token files, filter interactions and Merkle proofs against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import texts
from checking import connect, difference
from plumbline.llm import filter_audit, merkle, ranks, token_files
from plumbline.llm.oracles import ORACLES
from plumbline.llm.queries import QUERIES, TOKENIZERS
from pyspark.sql import functions as F

VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def ordered(data: list[tuple]) -> list[tuple]:
    return sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("file_bytes", [1 << 27, 3000])
def test_token_files_hold_the_ids_in_order(spark, tmp_path, encode, file_bytes):
    data = texts.rows()
    corpus, index = token_files.write(texts.documents(spark, data), VOCABULARY, 2, folder=str(tmp_path / "c"), file_bytes=file_bytes)
    got = token_files.read(spark, corpus, index).collect()
    expected = [[*encode(r[1]), 2] for r in ordered(data)]
    by_key = Counter((r[0], tuple(ids)) for r, ids in zip(ordered(data), expected))
    assert Counter((r["key"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == by_key
    place = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == place and r["n_tokens"] == len(r["ids"]) // 4
        place += r["n_tokens"]
    keys = [r["key"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == [r[0] for r in ordered(data)]

    again = token_files.Corpus.open(corpus.folder)
    whole = [i for ids in expected for i in ids]
    assert (again == corpus) and again.dtype == "<u2" and again.n_tokens == len(whole) and again.n_documents == len(data)
    if file_bytes == 3000:
        assert len(again.shards) > 5
    assert again.window(0, len(whole) + 5).tolist() == whole
    for start in (0, 1, 699, 1400, len(whole) - 1, len(whole)):
        assert again.window(start, 900).tolist() == whole[start : start + 900]
    for number in (0, 7, len(data) - 1):
        assert again.document(number).tolist() == expected[number]
    for shard in again.shards:
        name = f"{corpus.folder}/{{}}-{shard['shard']:05d}.bin"
        assert np.fromfile(name.format("tokens"), "<u2").size == shard["tokens"]
        assert np.fromfile(name.format("offsets"), "<i8")[-1] == shard["tokens"]


def test_token_files_of_long_texts_hot_keys_and_nothing(spark, encode, monkeypatch):
    rng = random.Random(5)
    long = " ".join(texts.words(rng, "de", 3000)) + "\n" + "x" * 5000 + " <|endoftext|> " + " ".join(texts.words(rng, "fr", 500))
    monkeypatch.setattr(token_files, "LONG_TEXT", 1000)
    from pyarrow import array

    pieces, first = token_files.cut_long(array([long, None, "short one", long]), 1000)
    assert len(pieces) > 20 and b"".join(pieces[: first[1]].to_pylist()) == long.encode() and np.diff(first)[1:3].tolist() == [1, 1]
    data = [(7, t) for t in ["a", "b c", None, "d"] * 20] + [(3, long), (None, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    corpus, index = token_files.write(docs, VOCABULARY, 2, file_bytes=40)
    got = token_files.read(spark, corpus, index).collect()
    assert Counter((r["key"], r["n_tokens"]) for r in got) == Counter((k, len(encode(t)) + 1) for k, t in data)
    assert len(corpus.shards) > 2

    corpus, index = token_files.write(texts.empty(spark), VOCABULARY, 2)
    assert corpus.shards == [] and token_files.read(spark, corpus, index).collect() == [] and corpus.window(0, 4).size == 0


def test_pieces_of_long_texts_encode_like_the_whole(encode):
    from pyarrow import array

    text = "Ça va? don't (stop)\t" * 200 + "é" * 50 + "\n\n  end "
    pieces, _ = token_files.cut_long(array([text]), 64)
    assert [i for p in pieces.to_pylist() for i in encode(p.decode())] == encode(text)


def test_op11_reads_back_what_the_tokenizer_gives(spark, sf_dir, encode):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected, place = set(), 0
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = np.array([*encode(r["text"]), 2], "<u4")
        expected.add((r["doc_id"], place, len(ids), zlib.crc32(ids.tobytes())))
        place += len(ids)
    assert {tuple(r) for r in QUERIES["op11_token_files"](spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_merkle_manifest"])
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir).sql(ORACLES[name])) is None


def measures(text: str | None) -> tuple:
    raw = (text or "").encode()
    found = raw.split()
    capitals = sum(65 <= b <= 90 for b in raw)
    return len(found), len(set(found)), capitals, len(text or ""), any(c in raw for c in b"#$%&*|"), hashlib.sha256(raw).digest()


def test_text_counts(monkeypatch):
    samples = [r[1] for r in texts.rows()] + ["a\x0bb\x0cc\r\nd e", "A" * 50 + " é#", "x " * 4000]
    for size in (1 << 20, 7):
        monkeypatch.setattr(filter_audit, "PIECE_BYTES", size)
        for text in samples:
            assert filter_audit.text_counts((text or "").encode()) == measures(text)


def audit_by_force(rows: list[tuple], filters: str, losses: list[str]) -> set[tuple]:
    """``rows``: part, set of failed filters, set of labels."""
    out = set()
    orders = list(permutations(filters))
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed, lines = Counter(), []
        for order in orders:
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in own if f in r[1] and not before & r[1]]
                removed[f] += len(gone)
                lines.append(
                    (
                        ("".join(order), k + 1, sum(not (before | {f}) & r[1] for r in own), len(gone)),
                        sum(f in r[1] and bool(before & r[1]) for r in own),
                        sum(r[1] == {f} for r in own),
                        *[sum(label in r[2] for r in gone) for label in losses],
                        f,
                    )
                )
        out |= {(part, *head, *rest, removed[f]) for head, *rest, f in lines}
    return out


@pytest.mark.parametrize("filters", ["XYZ", "ABCDE"])
def test_audit_matches_brute_force(spark, filters):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        fails = {f for f in filters if rng.random() < 0.3 and f != "Y"}
        rows.append((rng.choice(["en", "en", "", "fr"]), fails, {x for x in ("good", "bad") if rng.random() < 0.4}))
    rows += [("clean", set(), {"good"})] * 3
    ids = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "row long, part string")
    pick = lambda test: spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows) if test(r)], "row long, part string")
    failing = {f: pick(lambda r, f=f: f in r[1]) for f in filters}
    labelled = {x: pick(lambda r, x=x: x in r[2]) for x in ("good", "bad")}
    got = filter_audit.audit(ids, failing, labelled).collect()
    assert {tuple(r) for r in got} == audit_by_force(rows, filters, ["good", "bad"])
    assert len(got) == 4 * len(list(permutations(filters))) * len(filters)


@pytest.mark.parametrize("hot", [1000, 1])
def test_audit_of_awkward_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT_TEXTS", hot)
    data = texts.rows()
    data += [(2000 + i, "common text", "en", "s", 11, "clash", 7, 1, 2, "x", True, "y") for i in range(40)]
    data += [(3000 + i % 3, "rarer text", "fr", "s", 11, "clash", 7, 1, 2, "x", True, "y") for i in range(9)]
    docs = texts.documents(spark, data)
    labels = spark.createDataFrame([(0,), (0,), (5,), (None,)], "doc_id long")
    filters = {"W": lambda m: m.where("n_words < 40"), "E": filter_audit.copies}
    got = filter_audit.audit_texts(docs, filters, {"lost": labels}).collect()
    least = {}
    for r in data:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    rows = []
    for r in data:
        fails = {"W"} if measures(r[1])[0] < 40 else set()
        if r[0] is not None and r[0] > least[r[1] or ""]:
            fails.add("E")
        rows.append((r[2] or "", fails, {"lost"} if r[0] in (0, 5) else set()))
    assert {tuple(r) for r in got} == audit_by_force(rows, "WE", ["lost"])
    assert filter_audit.audit_texts(texts.empty(spark), filters, {"lost": labels}).collect() == []


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and the siblings before and after each node on its way up."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, groups = [], []
        for lo in range(0, len(nodes), 16):
            run = nodes[lo : lo + 16]
            for k in range(len(run)):
                for i in owners[lo + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            groups.append([i for own in owners[lo : lo + 16] for i in own])
        nodes, owners = up, groups
    return nodes[0], paths


def manifest_by_force(data: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for key, group, leaf in data:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, over in zip(names, tops, strict=True):
        subroot, paths = trees[g]
        for (known, key, leaf), path in zip(sorted(groups[g]), paths, strict=True):
            out.append((g, key if known else None, leaf, tuple(path + over), subroot, root))
    return out


@pytest.mark.parametrize("digits", [3, 1])
def test_manifest_matches_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    sizes = {None: 3, "": 1, "one": 1, "b" * 3: 16, "hot": 600, "é": 17, "z": 33, "Z": 257}
    data = [(i, g, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    data += [(None, "hot", sha("null")), (5, "hot", sha("twin")), (5, "hot", sha("twin")), (1, None, sha("x"))]
    data += [(i, f"s{i:03d}", sha(str(i))) for i in range(40)]
    random.Random(1).shuffle(data)
    leaves = spark.createDataFrame([(*r, 7, "clash") for r in data], "doc_id long, source string, leaf string, node int, steps string").repartition(5)
    got = merkle.manifest(leaves, "source", "doc_id", "leaf", ["node"])
    assert got.columns == ["source", "doc_id", "leaf", "node", "steps", "subroot", "root"]
    rows = [(r[0], r[1], r[2], tuple(tuple(s) for s in r["steps"]), r["subroot"], r["root"]) for r in got.collect()]
    assert Counter(rows) == Counter(manifest_by_force(data))
    bad = got.where(merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root"))
    assert bad.count() == 0
    wrong = got.where(merkle.fold(F.lit(sha("other")), F.col("steps")) == F.col("root"))
    assert wrong.count() == 0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few(spark, n):
    leaves = spark.createDataFrame([(i, "s", sha(str(i))) for i in range(n)], "doc_id long, source string, leaf string")
    got = merkle.manifest(leaves, "source", "doc_id", "leaf").collect()
    assert len(got) == n
    if n == 1:
        assert got[0]["root"] == got[0]["subroot"] == got[0]["leaf"] == sha("0") and got[0]["steps"] == []


def test_fields_do_not_run_together(spark):
    row = spark.sql("SELECT '1:a' AS a, CAST(NULL AS STRING) AS b, 12 AS c, 'é' AS d")
    assert row.select(merkle.leaf_hash([F.col(c) for c in "abcd"])).first()[0] == sha("3:1:a-2:122:é")


def test_ranks_of_hot_and_null_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, "hot", "hot", "hot", f"g{i % 9}"]), rng.choice([None, *range(50)]), i) for i in range(2000)]
    rows = spark.createDataFrame(data, "g string, k int, i long").repartition(7)
    got = ranks.with_rank(rows, "g", ["k", "i"]).collect()
    seen: dict = {}
    for g, k, i in sorted(data, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        seen.setdefault(g, []).append(i)
    assert {(r["g"], r["i"], r["_rank"]) for r in got} == {(g, i, n) for g, own in seen.items() for n, i in enumerate(own)}


def test_corpus_json_is_plain(spark, tmp_path):
    corpus, _ = token_files.write(texts.documents(spark), VOCABULARY, 2, folder=f"file://{tmp_path}/c")
    saved = json.loads((tmp_path / "c" / "corpus.json").read_text())
    assert saved["dtype"] == "<u2" and sum(s["tokens"] for s in saved["shards"]) == corpus.n_tokens
