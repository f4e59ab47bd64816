"""Spelling variants: words one edit apart are found by search schemes in bidirectional FM-indexes over the delimited vocabulary.

A word that is one edit from another leaves a half of it untouched: the other word begins with its first half or ends with
its second. So the vocabulary is dealt by halves: a word stands in the block of its beginning and in that of its end, and
asks in the blocks of its own halves. Each block is one text of words between delimiters with a bidirectional FM-index: an
interval of suffix ranks in the text and one in the reversed text that keep step, so that a match grows either way. The
first half is matched right to left up to the delimiter and then extended to the right, the second half left to right down
to the delimiter and then extended to the left, both with one error.

A half with more words than a block holds is dealt over several blocks, all of which are asked, by several tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._batches import LOWER, holds_cache, shared_folder, small_batches, text_slices, word_spans, written

MIN_LENGTH = 5
MIN_COUNT = 3
DROP_EVERY = 97
#: Words of an index block, and words that ask in one block within one task, about.
BLOCK = 20_000
QUERIES = 4_000
BROADCAST_HALVES = 100_000

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def run_mask(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes of `[A-Za-z\\u00C0-\\u00FF]`: ASCII letters, and C3 with the byte after it."""
    mask = _ASCII[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    mask[wide] = True
    mask[wide + 1] = True
    return mask


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """zlib.crc32 of each span, going on from the crc32 of what stands before it."""
    crc, at, live = state ^ np.uint32(0xFFFFFFFF), 0, np.arange(len(starts))
    while len(live := live[ends[live] - starts[live] > at]):
        c = crc[live]
        crc[live] = _CRC[(c ^ data[starts[live] + at]) & np.uint32(255)] ^ (c >> np.uint32(8))
        at += 1
    return crc ^ np.uint32(0xFFFFFFFF)


def slice_words(ids: list, data: np.ndarray, offsets: np.ndarray, min_length: int, drop_every: int) -> pa.StructArray:
    """Counts of the runs of a slice, with one code point left out where drop_every divides the run's crc32."""
    data = LOWER[data]
    mask = run_mask(data, offsets)
    flags = np.ones(256, dtype=bool)
    flags[0] = False
    starts, ends, first = word_spans(np.where(mask, data | 1, 0).astype(np.uint8), offsets, flags)
    prefix = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], dtype=np.uint32)
    h = crc_of_spans(data, starts, ends, np.repeat(prefix, np.diff(first)))
    dropped = np.flatnonzero(h % np.uint32(drop_every) == 0) if drop_every else np.zeros(0, np.int64)
    raw, changed = data.tobytes(), []
    for k, a, b, x in zip(dropped.tolist(), starts[dropped].tolist(), ends[dropped].tolist(), h[dropped].tolist(), strict=True):
        word = raw[a:b].decode()
        at = x % len(word)
        changed.append(word[:at] + word[at + 1 :])
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    keep = points[ends] - points[starts] >= min_length
    keep[dropped] = False
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    taken = data[np.arange(to[-1]) + np.repeat(starts - to[:-1], sizes)]
    words = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(to), pa.py_buffer(taken)])
    more = pa.array([w for w in changed if len(w) >= min_length], pa.large_string())
    return pc.value_counts(pa.chunked_array([words, more]))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = 0) -> DataFrame:
    """(word, n) over all texts: runs of letters (A-Z lower-cased) of min_length code points, found min_count times at least.

    With drop_every, a run loses its code point h % length where drop_every divides h, the crc32 of `<id>:<run>`; a NULL id
    counts as empty. Counts of each slice of text are taken before the shuffle, so that a frequent word is few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("spelling")
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                found = slice_words(part.column("id").to_pylist(), data, offsets, min_length, drop_every)
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WaveletMatrix:
    """Ranks and counts of smaller symbols in any range of a sequence, for many ranges at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for k in reversed(range(bits)):
            bit = (symbols >> k) & 1
            self.levels.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(len(bit) - self.levels[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of lo, place of hi, smaller) per range: where the symbol's entries of the range stand in the sorted order of levels, and how many smaller ones the range has."""
        smaller = np.zeros(len(lo), np.int64)
        for k, ones, zeros in zip(reversed(range(self.bits)), self.levels, self.zeros, strict=True):
            a, b, up = ones[lo].astype(np.int64), ones[hi].astype(np.int64), (symbol >> k) & 1 == 1
            smaller += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return lo, hi, smaller

    def distinct(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(range, symbol, lo, hi, smaller) of every symbol that a range holds."""
        at, symbol, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            low, high = (hi - lo) > (b - a), b > a
            at = np.concatenate([at[low], at[high]])
            smaller = np.concatenate([smaller[low], (smaller + (hi - lo) - (b - a))[high]])
            symbol = np.concatenate([symbol[low] * 2, symbol[high] * 2 + 1])
            lo, hi = np.concatenate([(lo - a)[low], (zeros + a)[high]]), np.concatenate([(hi - b)[low], (zeros + b)[high]])
        return at, symbol, lo, hi, smaller


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the rotations of text in order, by doubling; its last symbol, found nowhere else, makes them differ."""
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    while True:
        key = rank.astype(np.int64) * len(text) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        step *= 2
        if rank[order[-1]] == len(text) - 1:
            return order


END, BETWEEN = 0, 1


class BidirectionalIndex:
    """FM-index of words between delimiters, forwards and reversed; states are rows (lo, back, size, q): suffix ranks in both and the query."""

    def __init__(self, words: list[str]):
        self.words = words
        joined = "\n" + "\n".join(words) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(np.concatenate([points, [10]]))
        codes = np.where(points == 10, BETWEEN, np.searchsorted(self.alphabet, points) + 2)
        text, turned = np.concatenate([codes, [END]]), np.concatenate([codes[::-1], [END]])
        bits = int(len(self.alphabet) + 2).bit_length()
        self.order = suffix_array(text)
        self.left, self.right = WaveletMatrix(text[self.order - 1], bits), WaveletMatrix(turned[suffix_array(turned) - 1], bits)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(codes, minlength=(1 << bits)))]) + 1
        self.before[0] = 0
        self.where = np.cumsum([0, *(len(w) + 1 for w in words)])
        self.size = len(text)
        # the place of a symbol's first entry among the sorted levels of either matrix
        every = np.arange(1 << bits)
        none = np.zeros(1 << bits, np.int64)
        self.origin = [m.rank(none, none, every)[0] for m in (self.left, self.right)]

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; those that no word has are a symbol without entries."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, len(self.alphabet) + 2)

    def extend(self, state: np.ndarray, symbol: np.ndarray, right: bool) -> np.ndarray:
        """States whose match is longer by the symbol on one side; those without a match are left out."""
        own, other = (1, 0) if right else (0, 1)
        matrix = self.right if right else self.left
        lo, hi, smaller = matrix.rank(state[:, own], state[:, own] + state[:, 2], symbol)
        out = state.copy()
        out[:, own] = self.before[symbol] + lo - self.origin[right][symbol]
        out[:, other] += smaller
        out[:, 2] = hi - lo
        return out[out[:, 2] > 0]

    def extend_any(self, state: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(states, symbols): every longer match by any one letter on one side."""
        own, other = (1, 0) if right else (0, 1)
        matrix = self.right if right else self.left
        at, symbol, lo, hi, smaller = matrix.distinct(state[:, own], state[:, own] + state[:, 2])
        out = state[at]
        out[:, own] = self.before[symbol] + lo - self.origin[right][symbol]
        out[:, other] += smaller
        out[:, 2] = hi - lo
        letter = symbol > BETWEEN
        return out[letter], symbol[letter]

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): numbers of all pairs one edit apart, once for each way to find them."""
        sizes = np.array([len(q) for q in queries], np.int64)
        points = self.codes(np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[:-1]
        found = [self._scheme(points, at, sizes, first) for first in (True, False)]
        q, rank = np.concatenate([f[:, 3] for f in found]), np.concatenate([f[:, 0] for f in found])
        return q, np.searchsorted(self.where, self.order[rank], "right") - 1

    def _scheme(self, points: np.ndarray, at: np.ndarray, sizes: np.ndarray, first: bool) -> np.ndarray:
        """States of whole words: one half and its delimiter exactly, the other half with one error, its delimiter exactly."""
        half = sizes // 2
        n_exact, n_other = (half, sizes - half) if first else (sizes - half, half)
        # symbols of either half from the middle outwards
        inner = (lambda q, k: points[at[q] + half[q] - 1 - k], lambda q, k: points[at[q] + half[q] + k])
        exact, other = inner if first else inner[::-1]
        state = np.zeros((len(sizes), 4), np.int64)
        state[:, 2], state[:, 3] = self.size, np.arange(len(sizes))
        done, k = [], 0
        while len(state):
            full = n_exact[state[:, 3]] == k
            done.append(state[full])
            state = state[~full]
            state = self.extend(state, exact(state[:, 3], k), not first)
            k += 1
        state = np.concatenate(done)
        state = self.extend(state, np.full(len(state), BETWEEN), not first)

        # columns beside the state: how many symbols of the other half are matched, with the error behind them
        wrong = np.zeros((0, 5), np.int64)
        k, out = 0, []
        while len(state) or len(wrong):
            left = n_other[state[:, 3]] - k
            more, symbol = self.extend_any(state, first)
            out_left = n_other[more[:, 3]] - k
            inserted = np.column_stack([more, np.full(len(more), k)])
            can = out_left > 0
            own = np.full(len(more), -1)
            own[can] = other(more[can, 3], k)
            replaced = np.column_stack([more, np.full(len(more), k + 1)])[can & (symbol != own)]
            deleted = np.column_stack([state, np.full(len(state), k + 1)])[left > 0]
            wrong = np.concatenate([wrong, inserted, replaced, deleted])
            # those that have their whole half end at a delimiter
            full = wrong[:, 4] == n_other[wrong[:, 3]]
            out.append(self.extend(wrong[full, :4], np.full(int(full.sum()), BETWEEN), first))
            wrong = wrong[~full]
            wrong = self.extend(wrong, other(wrong[:, 3], wrong[:, 4]), first)
            wrong[:, 4] += 1
            state = more[can & (symbol == own)]
            k += 1
        return np.concatenate(out) if out else state


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, asks, word, n), a cell's words before those that ask, to (word, n, near, near_n)."""
    holds_cache("spelling")
    cell, words, counts, index, asking = None, [], [], None, []

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal index
        if asking and words:
            if index is None:
                index = BidirectionalIndex(words)
            q, w = index.near([a for a, _ in asking])
            q, w = np.unique(np.column_stack([q, w]), axis=0).T if len(q) else (q, w)
            q, w = q.tolist(), w.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([asking[i][0] for i in q], pa.string()), pa.array([asking[i][1] for i in q], pa.int64()), pa.array([words[i] for i in w], pa.string()), pa.array([counts[i] for i in w], pa.int64())], names=["word", "n", "near", "near_n"])
        asking.clear()

    for batch in batches:
        for at, asks, word, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if at != cell:
                yield from answers()
                cell, words, counts, index = at, [], [], None
            # a word may be in a cell by both of its halves
            if asks:
                if not asking or asking[-1][0] != word:
                    if len(asking) >= QUERIES:
                        yield from answers()
                    asking.append((word, n))
            elif not words or words[-1] != word:
                words.append(word)
                counts.append(n)
    yield from answers()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n), a row or more for every two words one edit (insertion, deletion, replacement of a code point) apart, both ways round.

    words: (word, n), each word once, of two code points at least. A block's index is built in one task from some `block`
    words, whatever halves are frequent; the words that ask stream past it.
    """
    # a word of l code points is found by its first (l - 1) div 2 and its last l div 2; those that ask may be longer or shorter by 1
    starts = lambda d: F.expr(f"left(word, (length(word) - 1 + {d}) div 2)")
    ends = lambda d: F.expr(f"right(word, (length(word) + {d}) div 2)")
    side = lambda name, halves: F.transform(F.array_distinct(F.array(*halves)), lambda h: F.struct(F.lit(name).alias("side"), h.alias("half")))
    at = lambda d: F.concat(side("start", map(starts, d)), side("end", map(ends, d)))
    of = lambda d, asks: words.select("word", "n", F.lit(asks).alias("asks"), F.explode(at(d)).alias("at")).select("word", "n", "asks", "at.side", "at.half")
    rows = of([0], False).union(of([-1, 0, 1], True))
    blocks = max(1, -(-2 * words.count() // block))
    held = rows.groupBy("side", "half").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asking"))
    # at most 8 rows for each `block` words: a word is held by two halves and asks at no more than six
    parts = lambda c, size: F.greatest(F.ceil(F.col(c) / size), F.lit(1)).alias("parts" if c == "held" else "groups")
    frequent = held.where(f"held > {block} OR asking > {4 * block}").select("side", "half", parts("held", block), parts("asking", 4 * block))
    if frequent.isEmpty():
        dealt = rows.withColumn("cell", F.pmod(F.xxhash64("side", "half"), F.lit(blocks)))
    else:
        every = lambda c: F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(c), F.lit(1)) - 1)
        own = lambda c: F.array(F.pmod(F.xxhash64("word"), F.coalesce(F.col(c), F.lit(1))))
        dealt = rows.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_HALVES else frequent, ["side", "half"], "left")
        dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), every("parts")).otherwise(own("parts"))))
        dealt = dealt.withColumn("group", F.explode(F.when(F.col("asks"), own("groups")).otherwise(every("groups"))))
        dealt = dealt.withColumn("cell", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("side", "half"), F.lit(blocks))).otherwise(F.xxhash64("side", "half", "part", "group")))
    dealt = dealt.select("cell", "asks", "word", "n").repartition("cell").sortWithinPartitions("cell", "asks", "word")
    return dealt.mapInArrow(_lookups, "word string, n bigint, near string, near_n bigint")


def group_variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n), each word once.

    A word's form is the near word of largest n (ties: smallest in code-point order) if that n is twice the word's or
    more, else NULL; root is the end of the chain of forms, the word itself without one. n at least doubles along a
    chain, so that chains are short and have no circle. Chains are followed by doubling, in a few joins.
    """
    folder = shared_folder(words.sparkSession)
    words = written(words, f"{folder}/words")
    pairs = near_words(words, block).distinct()
    best = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("x"))
    told = best.withColumn("twice", F.expr("-x.less >= 2 * n"))
    told = written(told.select("word", "n_near", F.when(F.col("twice"), F.col("x.near")).alias("form"), F.when(F.col("twice"), -F.col("x.less")).alias("form_n")), f"{folder}/near")
    roots, step = written(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), f"{folder}/roots0"), 0
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        moved = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{folder}/roots{step}")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    out = words.join(told, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = 0, block: int = BLOCK) -> DataFrame:
    """group_variants over the vocabulary of all texts: maximal runs `[A-Za-z\\u00C0-\\u00FF]+` with A-Z in lower case.

    NULL and empty texts have no words, NULL ids count as empty ids, repeated rows count as often as they stand there; an
    empty table gives an empty one; other columns are not read. A run or text of any length is taken whole.
    """
    return group_variants(vocabulary(docs, id_col, text_col, min_length, min_count, drop_every), block)


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), drop_every=DROP_EVERY)


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c // 2, (c % 2) * 3988292384)) AS v FROM range(256) AS r(i))
), d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), r AS (
  SELECT id, run, count(*) AS k FROM (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM d) GROUP BY ALL
), b AS (
  SELECT id, run, k, hex(encode(id || ':' || run)) AS x FROM r
), c AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda p: ('0x' || substr(x, 2 * p + 1, 2))::BIGINT)), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM b, t
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM c
), v AS (
  SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), p AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), e AS (
  SELECT DISTINCT p.word, p.n, v.word AS near, v.n AS near_n FROM p JOIN v ON p.rest = v.word
), m AS (
  SELECT * FROM e UNION ALL SELECT near, near_n, word, n FROM e UNION ALL SELECT DISTINCT x.word, x.n, y.word, y.n FROM p x JOIN p y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
), g AS (
  SELECT word, n, count(*) AS n_near, min((-near_n, near)) AS best FROM m GROUP BY word, n
), f AS (
  SELECT word, n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n FROM g
), q AS (
  SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT q.word, f.form FROM q JOIN f ON f.word = q.root WHERE f.form IS NOT NULL
), z AS (
  SELECT q.word, q.root FROM q LEFT JOIN f ON f.word = q.root WHERE f.form IS NULL
)
SELECT v.word, form, coalesce(z.root, v.word) AS root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n FROM v LEFT JOIN f USING (word) LEFT JOIN z USING (word)
"""
