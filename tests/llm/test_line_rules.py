"""Line rules against plain Python on odd texts; the SQL is held equal in test_llm."""

import collections
import random
import re

from pyspark.sql import functions as F

from quillon.llm import line_rules
from quillon.llm.line_rules import BOILERPLATE, CLOSING, SYMBOLS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, n_dup, lost, by, kept = collections.Counter(), 0, 0, collections.Counter(), []
    for line in text.split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        n_dup += seen[line] > 0
        chars = sum(map(len, w))
        links = sum(x in ("|", ">", "/", "-", "*") for x in w)
        rules = {
            "punctuation": (w[-1][-1] not in CLOSING and len(w) < 8) or 100 * sum(c in SYMBOLS for c in line) > 10 * chars or sum(c in "!?" for c in line) > len(w),
            "navigation": links >= 2 and 3 * links >= len(w),
            "boilerplate": (any(p in line.translate(LOWER) for p in BOILERPLATE) and len(w) < 30) or seen[line] >= 2,
        }
        seen[line] += 1
        by.update(k for k, failed in rules.items() if failed)
        if any(rules.values()):
            lost += chars
        else:
            kept.append(line)
    n, chars = len(words), sum(map(len, words))
    base_failed = n < 10 or 100 * len(repeated) > 20 * n
    return (n, chars, sum(c in SYMBOLS for c in text), n_dup, len(repeated), sum(seen.values()), by["punctuation"], by["navigation"], by["boilerplate"], lost, base_failed, not base_failed and 100 * lost <= 30 * chars, "\n".join(kept))


def odd_texts():
    rng = random.Random(3)
    words = ["ab", "Cd.", "É…", "|", ">", "&&&", "漢字。", "🎉!", "read", "more", "Sign", "up", "it", "a", "b", "c", "wow!!", "”", "»", "\x85x", "Log in", "tok#", "x" * 30]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    made = ["\n".join(line() for _ in range(rng.randint(1, 8))) for _ in range(300)]
    twice = ["\n".join([x := line(), line(), x, x + " ", x, ""]) for _ in range(40)]
    return [None, "", " ", "\n", "\n\n a\n", "\t\r\n.", "one", "。", "x" * 200_000, "a b c d e. " * 40_000, "a b c d e " * 2, "no end\n" * 5000, *made, *twice, made[3]]


def test_rules_equal_plain_python(spark):
    texts = odd_texts()
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "a null id", 2), (3, "again", None)], "doc_id long, text string, n_words int").withColumns({c: F.lit("x") for c in ("id", "cleaned", "kept")})
    got = line_rules.clean_lines(docs).collect()
    assert len(got) == len(texts) + 2 and sum(r["id"] is None for r in got) == 1 and sum(r["id"] == 3 for r in got) == 2
    for r in got:
        if r["id"] is not None and not (r["id"] == 3 and r["n_words"] == 1):
            assert tuple(r)[1:] == plain(texts[r["id"]]), texts[r["id"]]


def test_empty_table(spark):
    assert line_rules.clean_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_and_documents_that_go(spark):
    clean = "The river ran high in the spring of that year, and nobody crossed it.\nWe waited for the water to fall."
    menu = "Home | About | Contact | Products | Press\nSign up\nRead more\n" + clean
    shout = "BUY!! NOW!! ONLY!! TODAY!! FOR!! YOU!! AND!! ALL!! YOUR!! FRIENDS!! HERE!!"
    docs = spark.createDataFrame(list(enumerate([clean, menu, shout])), "doc_id int, text string")
    got = {r["id"]: r for r in line_rules.clean_lines(docs).collect()}
    assert [got[i]["kept"] for i in range(3)] == [True, False, False]
    assert got[1]["cleaned"] == clean and got[1]["n_navigation"] == 1 and got[1]["n_boilerplate"] == 2 and got[2]["cleaned"] == ""
    assert line_rules.clean_lines(docs, rules=line_rules.Rules(max_lost_percent=40)).where("id = 1").first()["kept"]
