"""Small awkward tables for the tests of the corpus operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row long, n int, kind int, uid string, kept boolean, score string"
SYLLABLES = {"en": "the and ing tion er wh st", "fr": "le de eau ou é ai que", "de": "der sch ü ung ei ge ß"}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    parts = SYLLABLES[lang].split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, blanks, a long text and a repeated row."""
    rng = random.Random(seed)
    texts: list[tuple[str | None, str | None]] = []
    passage = " ".join(words(rng, "en", 60))
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        body = words(rng, lang, rng.choice([1, 2, 3, 5, 12, 40, 90, 200]))
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        texts.append((" ".join(body), lang))
    for i in range(0, n, 4):
        near = (texts[i][0] or "").split()
        for _ in range(i % 3):
            near[rng.randrange(len(near))] = "changed" + str(rng.randrange(9))
        texts.append((" ".join(near), texts[i][1]))
    texts += [(None, None), ("", "en"), (" \t\n", None), ("12 345 !!", "en"), ("Über-Größe ÇA VA? <|endoftext|> don't ​▁x", "de"), (texts[0][0].upper(), None)]
    texts.append((" ".join(words(rng, "fr", 9000)), "fr"))
    texts.append(("ab" * 4000, None))
    out = [(i, t, lang, "s", len(t or ""), "clash", 7, 1, 2, "x", True, "y") for i, (t, lang) in enumerate(texts)]
    out.append((None, *out[1][1:]))
    out.append(out[2])
    return out


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def plain_words(text: str | None) -> list[bytes]:
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", lowered)


class Union:
    """Components of numbered things, named by their least."""

    def __init__(self, things):
        self.to = {x: x for x in things}

    def find(self, x):
        while self.to[x] != x:
            x = self.to[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        self.to[max(a, b)] = min(a, b)
