"""Spelling variants against brute force, with odd texts, frequent halves and blocks of any size; the SQL is held equal in test_llm."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import spelling
from quillon.llm.spelling import BidirectionalIndex, group_variants, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    near = {w: sorted((-counts[v], v) for v in counts if v != w and one_edit(v, w)) for w in counts}
    form = {w: found[0][1] if found and -found[0][0] >= 2 * counts[w] else None for w, found in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def made_words(n, letters="abcdé", seed=5):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)})


def test_index_finds_all_words_one_edit_away():
    words = made_words(400)
    asked = [*words[:200], "zzzz", "abzcd", "é"]
    q, w = BidirectionalIndex(words).near(asked)
    assert set(zip(q.tolist(), w.tolist(), strict=True)) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if one_edit(a, b)}


def test_long_words_with_repeats():
    words = ["a" * 3000, "a" * 2999, "a" * 2998 + "b", "b" + "a" * 2999]
    q, w = BidirectionalIndex(words).near(words)
    assert set(zip(q.tolist(), w.tolist(), strict=True)) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}


@pytest.mark.parametrize("block", [7, 50, 20_000])
def test_groups_equal_brute_force_whatever_the_blocks(spark, block):
    rng = random.Random(9)
    # a third of the words share their first half
    words = [*made_words(250, seed=6), *{"shared" + w for w in made_words(150, "abcdefg", 8)}]
    counts = {w: rng.choice([1, 1, 2, 3, 3, 8, 20]) for w in words}
    got = group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), block)
    assert {tuple(r) for r in got.collect()} == expected(counts)


def test_odd_texts(spark):
    rng = random.Random(2)
    words = ["Haus", "hausé", "maison", "Maisons", "×÷×÷×", "Ünder", "ünder", "façade", "facade", "İstanbul", "x1yy", "ſtraße", "straße", "naïve", "naive", "éa"]
    texts = [None, "", " ", "12 34", "maison" * 20_000, *(rng.choice([" ", "-", "漢"]).join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(120))]
    rows = [*enumerate(texts), (None, "Maison maison maison"), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "form", "near", "cell")})
    counts = collections.Counter()
    for i, t in rows:
        for run in RUN.findall((t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {tuple(r) for r in spelling_variants(docs, drop_every=7).collect()} == expected(counts) and len(counts) > 10
    assert spelling_variants(docs.where("false")).count() == 0


def test_crc_of_spans():
    import numpy as np

    data = np.frombuffer(b"hello world", np.uint8)
    state = np.array([zlib.crc32(b"12:"), 0], np.uint32)
    assert spelling.crc_of_spans(data, np.array([0, 6]), np.array([5, 11]), state).tolist() == [zlib.crc32(b"12:hello"), zlib.crc32(b"world")]
