"""Text operators against brute force, on whole texts with nulls, blanks, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import texts
from pyspark.sql import functions as F
from plumbline.llm import bytetext, jaccard, language_id, lm_scoring, packing, piece_coding, repeats
from plumbline.llm.queries import TOKENIZERS, remainder

WORD_BPE, PIECES = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    return texts.documents(spark).cache()


def test_words_and_hashes_follow_the_definition():
    column = pa.array(["The  the\tTHE", None, "", "é é", "x" * 50])
    flat, offsets = bytetext.buffers(column)
    hashes, rows = bytetext.word_hashes(flat, offsets)
    assert np.diff(rows).tolist() == [3, 0, 0, 2, 1]
    assert len(set(hashes[:3].tolist())) == 1 and hashes[3] == hashes[4] != hashes[0]


def test_shingle_sets_match_brute_force():
    column = pa.array([r[1] for r in texts.rows()])
    for n in (1, 3, 5):
        for first, grams, offsets in bytetext.shingle_sets(column, n):
            for i in range(len(offsets) - 1):
                w = texts.plain_words(column[first + i].as_py())
                expected = len({tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) if len(w) >= n else min(len(w), 1)
                assert offsets[i + 1] - offsets[i] == expected


def test_language_model_counts_and_smoothing(spark, docs):
    held = remainder("doc_id", 7) == 2
    got = lm_scoring.score(docs, ~held, filter_bits=1 << 22, prior=50.0).collect()
    rows = docs.select("doc_id", "text", held.alias("held")).collect()
    tokens = {(r["doc_id"], r["text"]): [*texts.plain_words(r["text"]), None] for r in rows}
    learned = [tokens[r["doc_id"], r["text"]] for r in rows if not r["held"]]
    count = Counter(w for t in learned for w in t)
    pairs = Counter(p for t in learned for p in zip([None, *t[:-1]], t, strict=True))
    n, v = sum(count.values()), len(count)
    expected = Counter()
    for r in rows:
        t = tokens[r["doc_id"], r["text"]]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip([None, *t[:-1]], t, strict=True):
            c = pairs[h, w]
            seen = 1 << (c.bit_length() - 1) if c else 0
            score += math.log10((seen + 50 * (count[w] + 1) / (n + v + 1)) / (count[h] + 50))
        expected[r["doc_id"], not r["held"], len(t), sum(count[w] > 0 for w in t), n, round(base, 6), round(score, 4)] += 1
    found = Counter((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 4)) for r in got)
    assert found == expected


def test_language_model_joins_what_the_head_leaves_out(spark, docs):
    train = F.lit(True)
    whole = lm_scoring.score(docs, train, filter_bits=1 << 20).select("doc_id", "n_known", F.round("base_score", 6).alias("b")).collect()
    tiny = lm_scoring.score(docs, train, filter_bits=1 << 20, max_head=5).select("doc_id", "n_known", F.round("base_score", 6).alias("b")).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, tiny))


def test_filter_reads_back_quantised_counts():
    filt = lm_scoring.Filter(1 << 16, 4, 3)
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)
    counts = rng.integers(1, 200, 300)
    bits = np.zeros((1 << 16) // 8, np.uint8)
    size = filt.segment_bits // 8
    for s in range(4):
        own = filt.segment(keys) == s
        short = keys[own] & np.uint64((1 << 40) - 1)
        bits[s * size : (s + 1) * size] = filt.fill(short, counts[own])
    read = filt.read(bits, keys)
    assert (read >= 2 ** np.floor(np.log2(counts))).all() and (read == 2 ** np.floor(np.log2(counts))).mean() > 0.99


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join_matches_all_pairs(spark, docs, n, num):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, n, num, 100).collect()}
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = texts.plain_words(r["text"])
        key = -1 if r["doc_id"] is None else r["doc_id"]
        sets[key] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    union = texts.Union([k for k in sets])
    named = sorted(sets)
    for i, a in enumerate(named):
        for b in named[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    expected = set()
    for k in named:
        members = [m for m in named if union.find(m) == union.find(k) and m >= 0]
        expected.add((None if k < 0 else k, len(sets[k]), min(members) if members else None))
    assert got == expected


@pytest.mark.parametrize(("n", "num"), [(1, 50), (1, 34), (1, 30), (1, 12), (2, 50)])
def test_jaccard_join_at_low_thresholds(spark, n, num):
    """Tiny sets that link over one common element, and large ones that share less than four."""
    import random

    rng = random.Random(num)
    data = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + rng.choice("xyz") for _ in range(rng.choice([1, 1, 2, 3, 6, 12, 16])))) for i in range(120)]
    data += [(900, "solo"), (901, "solo duo"), (902, "duo trio quartet"), (903, None)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(data, "doc_id long, text string"), n, num, 100).collect()}
    sets = {}
    for k, t in data:
        w = texts.plain_words(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    union = texts.Union(list(sets))
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    assert got == {(k, union.find(k)) for k in sets}


def test_jaccard_join_of_documents_that_share_an_id(spark):
    """Half the rows have no id and a third one id: each text is still compared as itself."""
    import random

    rng = random.Random(6)
    data = []
    for i in range(60):
        body = texts.words(rng, "en", 61)
        data += [((None, 7, i)[i % 3], " ".join(body)), ((None, 7, 1000 + i)[i % 3], " ".join([*body[:-1], "other"]))]
    data += [(7, data[1][1])] * 30
    got = jaccard.jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 5, 80, 100).collect()
    assert len(got) == len(data)
    by_key = Counter((r["doc_id"], r["component_id"]) for r in got)
    assert by_key[None, None] == 38 and by_key[None, 7] == 2 and by_key[7, 7] == 70
    for i in range(2, 60, 3):
        assert by_key[i, i] == 1 and by_key[1000 + i, i] == 1


def test_jaccard_join_does_not_multiply_rows_of_one_id(spark, monkeypatch):
    """Texts of documents without an id are joined by their hash, so as many leave the join as entered it."""
    import random

    rng = random.Random(9)
    data = []
    for _ in range(40):
        body = texts.words(rng, "fr", 61)
        data += [(None, " ".join(body)), (None, " ".join([*body[:-1], "autre"]))]
    stored = {}
    keep = jaccard.store
    monkeypatch.setattr(jaccard, "store", lambda df, name: stored.setdefault(name, keep(df, name)))
    jaccard.jaccard_join(spark.createDataFrame(data, "doc_id long, text string"), 5, 80, 100).collect()
    assert stored["texts"].count() == 80


def test_jaccard_join_with_long_lists_and_blocks(spark, monkeypatch):
    """Many near copies: lists are long, cells are blocks, and the links are those of all pairs."""
    import random

    rng = random.Random(5)
    base = texts.words(rng, "en", 120)
    data = []
    for i in range(90):
        body = list(base)
        for _ in range(rng.randint(0, 4)):
            body[rng.randrange(len(body))] = f"w{rng.randrange(30)}"
        data.append((i, " ".join(body), *texts.rows()[0][2:]))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    frame = texts.documents(spark, data)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(frame, 3, 90, 100).collect()}
    sets = [{tuple(d[1].split()[k : k + 3]) for k in range(118)} for d in data]
    union = texts.Union(range(90))
    for i in range(90):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                union.join(i, j)
    assert got == {(i, union.find(i)) for i in range(90)}


def brute_repeats(data: list[tuple], length: int) -> dict:
    """Kept bytes and number of runs by key; rows of one key are one document."""
    first: dict[bytes, tuple] = {}
    order = sorted({((-1 if r[0] is None else r[0]), r[1] or "") for r in data})
    for key, text in order:
        raw = text.encode()
        for at in range(len(raw) - length + 1):
            piece = raw[at : at + length]
            first[piece] = min(first.get(piece, (key, at)), (key, at))
    out = {}
    for key, text in order:
        raw = text.encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if first[raw[at : at + length]] < (key, at):
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_match_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    cut = repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    expected = brute_repeats([tuple(r) for r in docs.collect()], 100)
    got = cut.collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["s"], r["h"]) == expected[-1 if r["doc_id"] is None else r["doc_id"]]


@pytest.mark.parametrize("hot", [20_000, 0])
@pytest.mark.parametrize("key", [None, 4])
def test_repeats_of_rows_that_share_a_key_are_cut_row_by_row(spark, monkeypatch, key, hot):
    """A passage, clean text and copies under one key; the same rows with keys of their own lose the same bytes."""
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    text = lambda seed, n: " ".join(texts.words(texts.random.Random(seed), "en", n))
    passage = text(1, 60)[:150]
    bodies = [passage + text(2, 300), text(3, 120)[:500] + passage + text(4, 60), text(5, 200), text(5, 200), text(2, 300) + passage]
    other = texts.rows()[0][2:]

    def removed(keys: list) -> list[tuple]:
        data = [(k, t, *other) for k, t in zip(keys, bodies, strict=True)]
        frame = spark.createDataFrame(data, texts.SCHEMA).coalesce(1)
        return [(bytes(r["kept"]), r["n_removed"], r["spans"]) for r in repeats.remove_repeats(frame, keep=["text"]).orderBy(F.col("n_bytes"), F.col("n_removed")).collect()]

    shared, own = removed([key] * len(bodies)), removed(list(range(len(bodies))))
    assert shared == own
    kept = {k for k, _, _ in shared}
    assert bodies[0].encode() in kept and bodies[2].encode() in kept and b"" in kept
    assert sum(n for _, n, _ in shared) >= 150 + len(bodies[2].encode()) + len(bodies[4].encode()) - 150


def test_repeats_of_a_long_text_are_found_in_parts():
    text = ("".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))) * 2
    column = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], ["doc", "text"])
    whole = list(repeats.find_runs(100, 32)(iter([column])))
    parts = list(repeats.find_runs(100, 32, segment=777)(iter([column])))
    windows = lambda batches: sorted(
        (int(lo) + k) for b in batches for lo, n in zip(b["lo"].to_pylist(), b["n"].to_pylist(), strict=True) for k in range(n)
    )
    assert windows(whole) == windows(parts) == list(range(len(text) - 99))


def test_bucket_refinement_tells_equal_strings():
    rng = np.random.default_rng(2)
    flat = rng.integers(97, 99, 4000).astype(np.uint8)
    flat[2000:2400] = flat[100:500]
    left = 4000 - np.arange(4000)
    pointer = repeats.refine_buckets(flat, left, 100)
    seen: dict[int, bytes] = {}
    names: dict[bytes, int] = {}
    for i in range(3901):
        s = flat[i : i + 100].tobytes()
        assert seen.setdefault(int(pointer[i]), s) == s and names.setdefault(s, int(pointer[i])) == pointer[i]
    assert (pointer[3901:] == -1).all()


def test_whole_characters_leave_text(spark):
    rng_text = "é" * 300
    frame = texts.documents(spark, [(1, rng_text, *texts.rows()[0][2:]), (2, "x" + rng_text, *texts.rows()[0][2:])])
    for r in repeats.remove_repeats(frame, whole_characters=True).collect():
        assert bytes(r["kept"]).decode()


def test_language_is_learned_and_pooled(spark, docs):
    net = language_id.fit(docs, remainder("doc_id", 3) != 1)
    assert net.languages == ["de", "en", "fr"]
    got = language_id.label(docs, net)
    assert "lang_pred" in got.columns and got.schema["score"].dataType.simpleString() == "double"
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    long = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 5 and r["n_chars"] > 100]
    assert len(long) > 15 and sum(r["lang"] == r["lang_pred"] for r in long) >= 0.95 * len(long)


def test_recurrent_gradients_match_differences():
    net = language_id.Network.fresh(["a", "b"], 4, 1)
    for d in (net.ahead, net.back):
        d.table, d.weights = d.table.astype(np.float64), d.weights.astype(np.float64)
    x, y = language_id.as_steps([b"abc", b"bca", b"cab"]), np.array([0, 1, 0])
    loss = lambda: -net.log_probabilities(x)[0][:, np.arange(3), y].mean()
    trace = ([], [])
    logp, _ = net.log_probabilities(x, trace)
    grad = np.exp(logp)
    grad[:, np.arange(3), y] -= 1
    grad = (grad / (grad.shape[0] * 3)) @ net.out.T
    _, ahead = net.ahead.backward(x, grad[:, :, :4], trace[0])
    _, back = net.back.backward(x[::-1], grad[::-1, :, 4:], trace[1])
    for d, found in ((net.ahead, ahead), (net.back, back)):
        for i, j in ((0, 0), (1, 5), (2, 9), (3, 11)):
            keep = d.weights[i, j]
            d.weights[i, j] = keep + 1e-3
            up = loss()
            d.weights[i, j] = keep - 1e-3
            slope = (up - loss()) / 2e-3
            d.weights[i, j] = keep
            assert abs(slope - found[i, j]) < 1e-4


def test_pieces_match_plain_viterbi_and_round_trip(spark, docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    scores = {model.id_to_piece(i).replace("▁", " "): (model.get_score(i), i) for i in range(3, model.get_piece_size()) if not model.is_byte(i) and model.get_score(i) > -1e8}
    low = min(s for s, _ in scores.values()) - 10

    def best(word: str) -> list[int]:
        value, back = [0.0], [None]
        for e in range(1, len(word) + 1):
            choices = []
            for s in range(e):
                if word[s:e] in scores:
                    choices.append((value[s] + scores[word[s:e]][0], -s, [scores[word[s:e]][1]], s))
                elif e - s == 1:
                    choices.append((value[s] + low, -s, [3 + b for b in word[s:e].encode()], s))
            top = max(choices, key=lambda c: (c[0], c[3] * -1))
            value.append(top[0])
            back.append((top[2], top[3]))
        ids, e = [], len(word)
        while e:
            ids, e = back[e][0] + ids, back[e][1]
        return ids

    coded = piece_coding.decode(piece_coding.encode(docs, PIECES), PIECES)
    for r in coded.where("n_chars < 2000").collect():
        text = (r["text"] or "").replace("▁", " ")
        assert r["decoded"] == text
        cut = (" " + text).split(" ")[1:] if text else []
        assert r["ids"] == [i for w in cut for i in best(" " + w)]
    long = coded.where("n_chars >= 2000").collect()
    assert long and all(r["decoded"] == r["text"] for r in long)


def test_packing_cuts_and_joins_exactly(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    window = 256
    pieces = packing.pack(docs, WORD_BPE, window=window, open_windows=4).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
    total = Counter()
    for p in pieces:
        own = ids[p["doc_id"]][0]
        assert bytes(p["ids"]) == own[p["start"] : p["start"] + p["length"]].tobytes() and p["doc_tokens"] == len(own)
        for k in range(p["start"], p["start"] + p["length"]):
            total[p["doc_id"], k] += 1
    assert total == Counter({(d, k): len(v) for d, v in ids.items() for k in range(len(v[0]))})
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < 0.05 * sum(total.values())


def test_checksums_of_pieces():
    ids = np.array([1, 2, 49407], "<u4").tobytes()
    assert zlib.crc32(ids) == zlib.crc32(bytes([1, 0, 0, 0, 2, 0, 0, 0, 255, 192, 0, 0]))


def test_empty_tables(spark):
    none = texts.empty(spark)
    assert lm_scoring.score(none, F.lit(True), filter_bits=1 << 16).count() == 0
    assert jaccard.jaccard_join(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert packing.pack(none, WORD_BPE).count() == 0
    assert piece_coding.decode(piece_coding.encode(none, PIECES), PIECES).count() == 0
    net = language_id.fit(none, F.lit(True))
    assert net.languages == [] and language_id.label(none, net).count() == 0
    unlearned = language_id.label(texts.documents(spark), net)
    assert unlearned.where("lang_pred != 'und' OR score != 0").count() == 0


def test_the_most_frequent_languages_are_learned_and_rows_of_one_id_suffice(spark, monkeypatch):
    import random

    rng = random.Random(4)
    data = [(i, " ".join(texts.words(rng, "en", 40)), "en") for i in range(30)]
    data += [(5, " ".join(texts.words(rng, "de", 40)), "de") for _ in range(25)]
    data += [(100 + i, " ".join(texts.words(rng, "fr", 40)), f"rare{i}") for i in range(9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    net = language_id.fit(docs, F.lit(True))
    assert net.languages == ["de", "en"]
    assert {r["lang_pred"] for r in language_id.label(docs, net).collect()} <= {"de", "en"}
    same = spark.createDataFrame([(3, "der die das", "de")] * 50_0 + data[:30], "doc_id long, text string, lang string")
    assert language_id.fit(same, F.lit(True)).languages == ["de", "en"]
