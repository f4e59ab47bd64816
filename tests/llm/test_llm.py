"""The corpus operators against brute force, exact round trips, SQL and held-out labels, with the odd cases of their docstrings."""

import hashlib
import itertools
import random
import re
import wave
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, entries, importance, license_scan, media, mixing, neardup, piece_count, planes, toxicity, transcripts
from tests.compare import same
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


CLASHING = ("kept", "size", "n_words", "id", "key", "_key", "_log_weight", "log_weight", "_wanted", "wanted", "_is_target", "target_id", "copies", "_copies", "copy", "_copy", "_mix_id", "mix_id", "row", "chunk", "_place", "place", "kept_id", "_hit_id", "text_hash", "rep", "pos", "block")


def odd_texts():
    rng = random.Random(7)
    words = ["ab", "Cd", "É", "ßx", "the", "MIT", "License", "general", "public", "x1", "漢字", "🎉", "a.b", "--"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return [None, "", " ", "\n\t", "one", "One two", "\x00\x1c a\x85b c", "x" * 5000, "word " * 3000, *made, made[3], made[3] + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 1) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, (None, "a null id", None, None, None), (3, "\n\t", "en", "s3", 1)], DOCS).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same(entries.QUERIES[name](spark, SF), duck, entries.ORACLE_SQL[name])


# 2 media

def test_media_round_trip(docs, empty):
    out = media.fingerprint_media(docs)
    assert out.count() == docs.count() and media.fingerprint_media(empty).count() == 0
    got = by_id(out)
    for i, t in enumerate(odd_texts()):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        r = got[i]
        with wave.open(BytesIO(bytes(r["media"]))) as f:
            assert f.readframes(f.getnframes()) == payload and f.getsampwidth() == 1
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()


def test_landmarks_of_two_tones():
    t = np.arange(8000) / 8000
    wav = (128 + 60 * np.sin(2 * np.pi * 1000 * t) + 40 * np.sin(2 * np.pi * 2500 * t)).astype(np.uint8).tobytes()
    times, bins, _ = media.spectral_peaks(wav)
    assert set(bins) == {64, 160}  # 1000 and 2500 Hz at 15.6 Hz a bin
    codes = media.landmarks(times, bins)
    assert set((codes >> 32).tolist()) <= set(times.tolist()) and set((codes & 63).tolist()) <= set(range(1, media.REACH + 1))
    assert len(media.landmarks(*media.spectral_peaks(bytes(64))[:2])) == 0


def test_the_end_of_a_text_lies_in_a_frame():
    rng = np.random.default_rng(6)
    for size, frames in ((64, 1), (576, 2), (704, 2), (768, 2), (832, 3)):
        found = set()
        text = rng.integers(32, 127, size, dtype=np.uint8)
        for _ in range(20):
            text[-64:] = rng.integers(32, 127, 64, dtype=np.uint8)
            times, bins, n = media.spectral_peaks(text.tobytes())
            assert n == frames
            found.add((*times.tolist(), *bins.tolist()))
        assert len(found) > 1


# 3 token planes

@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n, width in itertools.product((0, 1, 7, 1000), (1, 2, 3, 4)):
        ids = rng.integers(0, 1 << (8 * width), n, dtype=np.uint64).astype(np.uint32)
        payload, index = planes.encode_ids(ids, width, bits, 256)
        assert (planes.decode_ids(payload, index, width) == ids).all()


def test_word_encoder_is_the_library():
    encoder = planes.WordEncoder(planes.default_tokenizer())
    rng = random.Random(3)
    odd = ["".join(map(chr, rng.choices(range(1, 256), k=30))) for _ in range(300)] + ["".join(map(chr, range(1, 700))), "<|endoftext|> a<|endoftext|>b", "It's WE'LL 'S", "ΑΣ ΑΣΣ", "é é", *(t or "" for t in odd_texts())]
    want = [np.array(e.ids, np.uint32).tobytes() for e in encoder.whole.encode_batch(odd, add_special_tokens=False)]
    assert encoder.by_word and encoder.encode(odd) == want


@pytest.mark.parametrize("shards", [1, 3])
def test_store_reads_back(spark, docs, empty, tmp_path, shards):
    store = planes.write_store(docs, f"file://{tmp_path}/s", planes.default_tokenizer(), shards=shards, segment_ids=500, block_ids=64)
    rows = planes.id_digests(store).orderBy("start").collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    encoder, start, want = planes.WordEncoder(planes.default_tokenizer()), 0, []
    for i, t in texts:
        ids = np.append(np.array(encoder.whole.encode(t or "", add_special_tokens=False).ids, np.uint32), np.uint32(2))
        want.append((i is not None, i or 0, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    got = [(r["id"] is not None, r["id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows]
    assert [x[:2] for x in got] == sorted(x[:2] for x in want) and sorted(got) == sorted(want)
    assert planes.id_digests(planes.write_store(empty, f"file://{tmp_path}/e", planes.default_tokenizer())).count() == 0


# 4 near-dedup

def shingles(text, k):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets, root = [(i, shingles(t, k)) for i, t in rows if i is not None], {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, docs, k, percent):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(6)]
    for n in range(260):  # a large family of near copies around one text, smaller ones around others
        words = list(base[0] if n < 160 else base[1 + n % 5])
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 900)}"
        rows.append((1000 + n, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=k, percent=percent).collect()
    want = brute_components(rows, k, percent)
    assert len(got) == len(rows)
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got if r["id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["id"] is None] == [(None, True)]


def family(n, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in range(200)]
        for k in rng.sample(range(200), rng.randint(*spread)):
            words[k] = f"v{rng.randint(0, 10**6)}" if rng.random() < 0.8 else f"u{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("exact", "spread"), [(False, (4, 4)), (True, (0, 9))])
def test_families_just_below_the_threshold(spark, monkeypatch, exact, spread):
    met, pairs = [], neardup.frame_pairs
    monkeypatch.setattr(neardup, "frame_pairs", lambda *a, **k: (met.append((found := pairs(*a, **k)).count()), found)[1])
    rows = family(300, 1, spread)
    got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85, exact=exact).collect()}
    assert got == brute_components(rows, 3, 85)
    assert sum(met) < 10 * len(rows)  # of 44,850 pairs


def test_frames_in_frames_lose_no_link(spark, tmp_path):
    rng = random.Random(9)
    sets = []
    for i in range(240):  # long lists of differences: groups within groups
        own = set(range(200)) - set(range(10 * (i % 3), 10 * (i % 3) + 10)) - set(rng.sample(range(40, 60), 6)) | {1000 + 10 * (i % 5) + k for k in range(6)} | {5000 + i}
        sets.append(("1", i, len(own), sorted(own ^ set(range(200))), 240))
    frames = spark.createDataFrame(sets, "frame string, rep long, n long, delta array<long>, often long")
    near = []

    def relabel(links, at):
        near.extend((r["a"], r["b"]) for r in links.collect())
        return frames.select("rep", F.col("rep").alias("component"))

    met = {(r["a"], r["b"]) for r in neardup.frame_pairs(frames, 85, f"file://{tmp_path}/f", relabel, short=2).collect()} | set(near)
    full = [set(range(200)) ^ set(x[3]) for x in sets]
    links = [(i, j) for i, j in itertools.combinations(range(240), 2) if 100 * len(full[i] & full[j]) >= 85 * len(full[i] | full[j])]
    root = list(range(240))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in met:
        if 100 * len(full[a] & full[b]) >= 85 * len(full[a] | full[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert links and all(find(i) == find(j) for i, j in links)


def test_components_of_few_links_equal_those_of_rounds(spark, tmp_path):
    rng = random.Random(3)
    links = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(5, 5), (200, 201), (201, 200), *((300 + i, 301 + i) for i in range(40))]
    edges = spark.createDataFrame(links, "a long, b long")
    few = sorted(map(tuple, neardup.components_of_few(edges).collect()))
    assert few == sorted(map(tuple, neardup.connected_components(edges, str(tmp_path)).collect())) and dict(few)[340] == 300


def test_small_link_tables_need_no_rounds_of_joins(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(12)] + ["something else entirely here"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: sorted(map(tuple, neardup.near_duplicates(table, words=3, percent=80).collect()))
    with monkeypatch.context() as m:
        m.setattr(neardup, "FEW_LINKS", -1)
        m.setattr(neardup, "FEW_FRAMES", -1)
        slow = found()
    monkeypatch.setattr(neardup, "connected_components", lambda *a: pytest.fail("rounds of joins"))
    assert found() == slow and len({r[2] for r in slow}) < 13


def test_drop_near_duplicates_keeps_columns(docs, empty):
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 3 in ids
    assert neardup.drop_near_duplicates(empty).count() == 0


# 5 licenses

def test_license_places(docs, empty):
    out = license_scan.scan_licenses(docs)
    assert out.count() == docs.count() and license_scan.scan_licenses(empty).count() == 0
    got = by_id(out)
    for i, t in enumerate(odd_texts()):
        w = PLAIN.findall((t or "").translate(LOWER))
        want = sorted((n.label, k) for n in license_scan.NOTICES if n.base for k in range(len(w)) if w[k : k + len(n.phrase.split())] == n.phrase.split())
        assert got[i]["n_words"] == len(w)
        assert sorted((s["label"], s["word"]) for s in got[i]["spans"] if s["base"]) == want


@pytest.mark.parametrize(("text", "labels"), [("under the MIT-Licence today", {"mit"}), ("limit license", set()), ("it license", set()), ("the genral publik license", {"gpl"}), ("Apache\nlicense apache license", {"apache"}), ("mozila public license 2", {"mpl"}), ("a licence of mit", set())])
def test_fuzzy_notices(text, labels):
    _, spans = license_scan.NoticeScanner(license_scan.NOTICES).scan(text.encode())
    assert {s["label"] for s in spans} == labels


def edit_distance_labels(plain):
    scanner, found = license_scan.NoticeScanner(license_scan.NOTICES), set()
    for notice in license_scan.NOTICES:
        p, k = notice.phrase, notice.errors
        for at in [0, *(m.end() for m in re.finditer(" ", plain))]:
            row = list(range(len(p) + 1))
            for j, c in enumerate(plain[at : at + len(p) + k], 1):
                before, row = row, [j]
                for i in range(1, len(p) + 1):
                    row.append(min(before[i] + 1, row[i - 1] + 1, before[i - 1] + (p[i - 1] != c)))
                if row[-1] <= k and (at + j == len(plain) or plain[at + j] == " ") and scanner._short_words_kept(notice, plain[at : at + j]):
                    found.add(notice.label)
    return found


def test_fuzzy_notices_match_an_edit_distance_scan():
    rng, scanner = random.Random(12), license_scan.NoticeScanner(license_scan.NOTICES)
    for _ in range(600):
        parts = []
        for _ in range(rng.randint(1, 3)):
            p = list(rng.choice(license_scan.NOTICES).phrase)
            for _ in range(rng.randint(0, 5)):
                i, kind = rng.randrange(len(p)), rng.randrange(3)
                p[i : i + (kind != 0)] = [] if kind == 1 else [rng.choice("abcils e")]
            parts.append("".join(p) if rng.random() < 0.7 else "use the license")
        plain = " ".join(" ".join(parts).split())
        assert {license_scan.NOTICES[n].label for n, *_ in scanner.spans(plain)} == edit_distance_labels(plain), plain


# 6 transcripts

def test_transcripts_recover_roles_of_held_out_conversations(spark):
    raw = transcripts.as_transcripts(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/conversations.parquet"))
    model = transcripts.fit_roles(raw.where("conv_id % 2 = 0"))
    held = raw.where("conv_id % 2 = 1")
    found = {(r["conv"], r["turn"]): r["role"] for r in transcripts.parse_transcripts(held, model).where("line = 0").collect()}
    gold = {(r["conv_id"], r["turn"]): r["role"] for r in held.collect()}
    assert sum(found.get(k) == v for k, v in gold.items()) >= 0.9 * len(gold)


def test_blocks_change_nothing(spark):
    raw = transcripts.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))
    long = raw.select(F.lit(1).alias("conv_id"), F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("conv_id", "turn")).alias("turn"), "text", "role").union(spark.createDataFrame([(None, 1, None, "user"), (None, None, "", "user"), (2, 5, "User: a", "user")], "conv_id int, turn int, text string, role string"))
    model = transcripts.fit_roles(raw)
    whole, cut = (transcripts.parse_transcripts(long, model, block_lines=b).collect() for b in (100_000, 3))
    turns = lambda rows: sorted((str(r["conv"]), str(r["turn"]), r["line"], r["part"], r["role"], r["n_lines"], r["rendered"]) for r in rows)
    assert turns(whole) == turns(cut) and all(r["part"] == 0 for r in whole)
    parts = transcripts.parse_transcripts(long, model, block_lines=3, joined_chars=0).collect()
    assert {t[:3] + t[4:5] for t in turns(parts) if not t[3]} == {t[:3] + t[4:5] for t in turns(whole)}
    assert sum(r["n_lines"] for r in whole) == sum(r["n_lines"] for r in parts)
    assert transcripts.parse_transcripts(long.where("false"), model).count() == 0


def test_transcripts_take_the_best_of_all_paths(spark):
    raw = transcripts.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))
    model = transcripts.fit_roles(raw)
    rng = random.Random(8)
    lines = ["User: hi", "what is it?", "it is a long answer " * 9, "AI> yes", "", "Speaker 1: so", "[SYS] > be kind", "a"]
    convs = [[rng.choice(lines) for _ in range(rng.randint(1, 4))] for _ in range(30)]
    # one row per line, all of one turn, or with turns that are NULL or equal
    rows = [(c, None if c % 3 == 0 else 1 if c % 3 == 1 else k, t) for c, ls in enumerate(convs) for k, t in enumerate(ls) if c % 3 == 2] + [(c, None if c % 3 == 0 else 1, "\n".join(ls)) for c, ls in enumerate(convs) if c % 3 < 2]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    features = {(r["conv"], r["pos"]): (r["mark"], r["shape"]) for r in transcripts.lines_of(table).collect()}
    found = {}
    for r in transcripts.parse_transcripts(table, model, block_lines=2).orderBy("conv", F.col("turn").asc_nulls_first(), "line").collect():
        found.setdefault(r["conv"], []).extend([2 * transcripts.ROLES.index(r["role"]), *[2 * transcripts.ROLES.index(r["role"]) + 1] * (r["n_lines"] - 1)])

    def score(states, seen):
        return sum(model.move[a, b] + model.show[(b, *x)] for a, b, x in zip([transcripts.START, *states], states, seen))

    for c in range(len(convs)):
        seen = [features[k] for k in sorted(k for k in features if k[0] == c)]
        best = max(score(p, seen) for p in itertools.product(range(transcripts.START), repeat=len(seen)))
        assert len(found[c]) == len(seen) and abs(score(found[c], seen) - best) < 1e-9


# 7 decontamination

def test_decontamination_matches_brute_force(spark, docs, empty):
    items = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "é É"), (3, None), (4, "..."), (None, "one two"), (10, "iota kappa lambda mu nu xi omicron pi rho sigma")]
    hits = ["alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "x É é É y", "é É é É", "One, two!"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(hits)], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(table, bench))
    words = lambda t: PLAIN.findall((t or "").translate(LOWER))
    windows = [(str(i) if i is not None else None, tuple(w[k : k + 10])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))]
    for r in table.collect():
        if r["doc_id"] in (None, 3):
            continue
        w, mark, found = words(r["text"]), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    mark |= set(range(k, k + len(x)))
                    found.add(item)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["items"]) == (len(w), len(mark), sorted(x for x in found if x))
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(table, bench).collect()}
    assert not clean & {500, 501, 503} and 9 in clean
    assert by_id(decontaminate.remove_spans(table, bench))[500]["text"] == "tau"
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(table, bench.where("false")).where("n_hit > 0").count() == 0


def test_rows_of_places_carry_no_texts(spark, docs):
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    plan = decontaminate.find_windows(docs.select(F.col("doc_id").alias("id"), "text"), decontaminate.benchmark_windows(items))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.strip(" :+-").startswith("Generate") and re.search(r"\[\d+(, \d+)*\]", line) is None]


def test_decontamination_runs_no_python(spark, docs):
    plan = decontaminate.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 8 importance, 1 toxicity

@pytest.fixture(scope="module")
def labelled(spark):
    d = SF.replace("0.001", "0.01")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_importance_keeps_good_and_rejects_junk(labelled):
    docs, labels = labelled
    got = importance.resample(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("id", "doc_id").join(labels.where("doc_id % 2 = 1"), "doc_id")
    share = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.1
    kept = importance.keep_resampled(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["id"] for r in importance.resample(docs, labels).where("kept").collect()}


def test_importance_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(9, 1), (10, 1), (11, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = importance.resample(docs, labels, keep=0.5).collect()
    assert len(got) == docs.count()
    assert all(r["log_weight"] is None and not r["kept"] for r in got if r["id"] in (0, 1, 2))
    scored = [r for r in got if r["key"] is not None]
    assert sum(r["kept"] for r in scored) >= -(-len(scored) // 2)
    assert min(r["key"] for r in scored if r["kept"]) > max(r["key"] for r in scored if not r["kept"])
    assert importance.resample(empty, labels).count() == 0
    assert all(r["kept"] for r in importance.resample(docs, labels.where("false")).collect() if r["key"] is not None)


@pytest.mark.parametrize("times", [3, 900, 1100, 50_000])
def test_own_ngrams_do_not_count(spark, times):
    other = 200_000
    counts = spark.createDataFrame([(1, times, times), (2, times, 0), (3, times + other, times + 700), (4, other, 700)], "bucket int, raw bigint, target bigint")
    ratios = importance.Ratios(counts)
    buckets = np.repeat([1, 2, 3, 4], [times, times, times, 1])
    got = ratios.of(buckets, np.repeat([0, 1, 0, 1], [times, times, times, 1]), np.array([True, False]))
    assert (got[: 2 * times] == 0).all()  # words of one document alone tell nothing, however often it says them
    assert np.allclose(got[2 * times : -1], np.log((700 + importance.SMOOTH) / (ratios.share * other + importance.SMOOTH)))


def test_importance_matches_plain_python(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "x1!", "GAMMA", "delta,", "é"]
    rows = [(i, " ".join(rng.choice(words[: 3 if i % 2 else 6]) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    labels = [(i, 1 if i % 2 else 0) for i in range(0, 60, 3)]

    def grams(text):
        ws = text.encode().split()
        h = lambda w: int(importance.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        m = lambda x: int(importance.mix(np.array([x % 2**64], np.uint64))[0])
        c, low = 0x9E3779B97F4A7C15, [h(w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w)) for w in ws]
        shape = [m(min(sum(65 <= b <= 90 for b in w), 3) + 4 * min(sum(b < 128 and not chr(b).isalnum() for b in w), 3) + 16 * min(len(w) // 3, 5) + 128 * (k > 0 and low[k] == low[k - 1]) + 0x51ED270B) for k, w in enumerate(ws)]
        out = [*low, *(m(a * c + b) for a, b in itertools.pairwise(low)), *shape, *(m((a * c + b) * c + d) for a, b, d in zip(shape, shape[1:], shape[2:]))]
        return [x >> (64 - importance.BUCKET_BITS) for x in out]

    bags, good = {i: grams(t) for i, t in rows}, {i for i, q in labels if q}
    raw, target = ({}, {})
    for i, bag in bags.items():
        for b in bag:
            raw[b] = raw.get(b, 0) + 1
            target[b] = target.get(b, 0) + (i in good)
    share = sum(target.values()) / sum(raw.values())
    want = {}
    for i, bag in bags.items():
        total = sum(np.log((max(target[b] - bag.count(b) * (i in good), 0) + importance.SMOOTH) / (share * (raw[b] - bag.count(b)) + importance.SMOOTH)) for b in bag)
        weight = importance.PASSAGE * total / (len(bag) + importance.PRIOR_GRAMS)
        u = (int(hashlib.md5(f"{importance.SEED}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        want[i] = (weight, weight - np.log(-np.log(u)))
    got = by_id(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), keep=0.25))
    assert all(np.allclose((got[i]["log_weight"], got[i]["key"]), want[i]) for i in want)
    top = sorted(want, key=lambda i: -want[i][1])[:15]
    assert {i for i in got if got[i]["kept"]} == set(top)


def test_smallest_kept_is_the_order_statistic(spark):
    values = [random.Random(2).choice([0.0, -1.5, 3.25, random.Random(i).gauss(0, 1e3)]) for i in range(500)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 250, 499):
        assert importance.smallest_kept(keys, k) == sorted(values, reverse=True)[k - 1]
    assert importance.smallest_kept(keys, 500) is None


def test_toxicity_on_held_out_labels(spark):
    d = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 4000"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score_toxicity(docs, model).select(F.col("id").alias("doc_id"), F.col("toxic").alias("flag"), "severity").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    bad, good = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert np.mean([r["flag"] for r in bad]) >= 0.75 and np.mean([r["flag"] for r in good]) <= 0.02
    assert list(model.cuts) == sorted(model.cuts)


def test_toxicity_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(9, 1), (10, 0), (None, 1), (12, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["severity"] <= toxicity.GRADES - 1 and abs(sum(r["grade_probabilities"]) - 1) < 1e-9 for r in got)
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 1")).weights == {}
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_severity_is_the_formula(spark, docs):
    weights = {"the": 0.7, "publi-": -0.4, "publ-": 1.1, "license": 0.3, "é": 2.0}
    model = toxicity.OrdinalModel(weights, (-0.5, 1.0, 2.5))
    got = toxicity.score_toxicity(docs.withColumn("doc_id", F.col("doc_id").cast("int")), model)
    for r in got.join(docs.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"]), "id").collect():
        words = re.findall(r"[^\W_]+", (r["text"] or "").lower())
        score = sum(w * np.log1p(sum(x == t if t[-1] != "-" else len(x) > len(t) - 1 and x.startswith(t[:-1]) for x in words)) for t, w in weights.items())
        below = [1 / (1 + np.exp(-(c - score))) for c in model.cuts] + [1.0]
        assert np.allclose(r["grade_probabilities"], np.diff([0.0, *below])) and abs(r["severity"] - sum(1 - b for b in below)) < 1e-9
    labels = spark.createDataFrame([(9, 1), (10, 0)], "doc_id int, toxic int")
    assert toxicity.fit_toxicity(docs.withColumn("doc_id", F.col("doc_id").cast("int")), labels).cuts


def test_cumulative_link_gradient_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 600)
    grades = np.clip(x + rng.integers(-1, 2, 600) * (rng.random(600) < 0.1), 0, 3)
    w, cuts = toxicity.fit_cumulative_link(np.arange(600), np.zeros(600, int), x.astype(float), grades, 1, 4)
    assert w[0] > 0 and (np.diff(cuts) > 0).all()
    score = x * w[0]
    assert np.mean((score[:, None] > cuts).sum(1) == grades) > 0.85


# 9 piece counts

def test_piece_counts_are_the_library_s():
    from tokenizers import Tokenizer, models, normalizers

    pieces = piece_count.read_pieces(piece_count.default_model())
    low = min(s for _, s in pieces)
    library = Tokenizer(models.Unigram([("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256)), *pieces], unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rng = random.Random(4)
    texts = [t or "" for t in odd_texts()] + ["".join(rng.choice(list("abcdefgh   é\n\t☃漢🎉▁ßtheio.,!")) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    counter = piece_count.PieceCounter(pieces)
    assert counter.by_word
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.viterbi("▁" + t.replace(" ", "▁")) if t else 0 for t in texts] == [counter.count(t) for t in texts]


def test_piece_counts_table(docs, empty):
    got = piece_count.count_pieces(docs, piece_count.default_model())
    assert got.count() == docs.count() and by_id(got)[0]["n_pieces"] == 0
    assert piece_count.count_pieces(empty, piece_count.default_model()).count() == 0


# 10 mixing

def test_mix_meets_targets(docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        sizes.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(rows[0]["target"] for rows in sizes.values()) - total) < 1e-6 * max(1, total)
    for rows in sizes.values():
        s = sum(r["size"] for r in rows)
        assert all(r["source_size"] == s and r["taken"] in {k * r["size"] for k in range(4)} for r in rows)
        assert rows[0]["target"] <= 3 * s + 1e-9
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
    assert {(r["id"], r["taken"]) for r in got} == {(r["id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert mixing.mix_sources(empty).count() == 0
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns and copies.where("length(text) > 4000").count() == sum(r["copies"] for r in got if r["size"] == 3000 or r["id"] == 7)


def test_ranges_narrow_to_the_cut(spark):
    rows = [(i % 700 if i % 3 else None, f"t {'w ' * (i % 4)}{i % 5}", "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, [1e-3, 1e-6, 0.0, -1.0, 5.0, float("nan")][i % 6]) for i in range(0, 700, 2)] + [(1, 2.0), (1, 4.0)], "doc_id long, weight double")
    wide, narrow = (mixing.mix_sources(docs, quality=quality, buckets=b, sorted_rows=n).collect() for b, n in ((1024, 10**6), (4, 5)))
    count = lambda got: sorted((r["id"] is not None, r["id"] or 0, r["text_hash"], r["source"], r["taken"]) for r in got)
    assert len(wide) == 2000 and count(wide) == count(narrow)
    for s in "ab":
        own = [r for r in wide if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    mixed = mixing.mixed_rows(docs, quality=quality)
    assert sorted(mixed.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()) == sorted((s, sum(r["taken"] for r in wide if r["source"] == s)) for s in "ab")


def test_very_long_texts(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in rng.integers(0, 60_000, 500_000))
    table = spark.createDataFrame([(1, long, "a"), (2, long + " MIT License", "a"), (3, "short", "b")], "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(long) > 3_000_000
    media_rows = by_id(media.fingerprint_media(table, keep_media=False))
    assert media_rows[1]["payload_sha256"] == hashlib.sha256(long.encode() + bytes(-len(long) % 64)).hexdigest() and media_rows[1]["n_frames"] > 4096
    assert {r["id"]: r["component_id"] for r in neardup.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3}
    scanned = by_id(license_scan.scan_licenses(table))
    assert scanned[2]["n_words"] == 500_002 and [s["word"] for s in scanned[2]["spans"]] == [500_000]
    bench = spark.createDataFrame([(7, " ".join(long.split()[499_980:499_995]))], "item_id long, text string")
    assert {i: r["n_hit"] for i, r in by_id(decontaminate.contamination(table, bench)).items()} == {1: 15, 2: 15, 3: 0}
    assert importance.resample(table, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).count() == 3
    assert sum(r["size"] for r in mixing.mix_sources(table).collect()) == 1_000_003
    assert piece_count.count_pieces(table, piece_count.default_model()).where("n_pieces > 500000").count() == 2
    lines = spark.createDataFrame([(1, None, long.replace(" w1", "\nw1"))], "conv_id long, turn long, text string")
    model = transcripts.RoleModel(np.log(np.full((transcripts.START + 1, transcripts.START), 1 / 6)), np.log(np.full((transcripts.START, len(transcripts.CLASSES), transcripts.SHAPES), 0.1)))
    assert transcripts.parse_transcripts(lines, model).agg(F.sum("n_lines")).first()[0] == long.count(" w1") + 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_targets_share_out_what_full_sources_leave(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 3 and abs(got["a"] + got[None] - 146) < 1e-9 and abs(got["a"] - got[None]) < 1e-9


# the pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, before = source, None
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [PLAIN.findall(r["text"].translate(LOWER)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 10]) for w in bench if w for k in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        rows = docs.collect()
        if name != "token_planes":
            assert docs.columns == source.columns
        if name == "quality":
            kept = {r["doc_id"] for r in rows}
            assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.95 and not any(i in kept for i, q in labels.items() if q == 0)
        if name == "near_dedup":
            want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in rows} == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            hit = lambda t: (w := PLAIN.findall((t or "").translate(LOWER))) and any(tuple(w[k : k + 10]) in grams for k in range(len(w)))
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect() if not hit(r["text"])}
        if name == "mixing":
            want = {r["id"]: r["copies"] for r in mixing.mix_sources(before, quality=mixing.label_weights(spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, k in want.items() for _ in range(k))
        if name == "token_planes":
            assert len(rows) == before.count()
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    assert got == [tuple(r) for r in docs.orderBy("start").collect()]
