"""MinHash near-dedup by a signature-coordinate inverted join.

Documents are posted under the (coordinate, value) pairs of their MinHash signature. A link at the similarity asked for
shares at least `needed` of the pairs but with a tiny probability (MISS), so a prefix of each signature, its rarest
pairs, is enough for two linked documents to meet (prefix filter), and pairs that no other document has are skipped.
Who meets is told by counts of collisions; candidates are confirmed on full shingle sets. With exact=True documents
are posted under their rarest shingles instead, as many as any linked set must share one of, and no link is missed.

Equal sets are one node from the start (by a 128-bit print; a shingle is a 64-bit hash of its words). In a posting list
of near copies all pairs would be far too many; but only components are asked for, so rounds link each node to a leader
of its lists, the most central one first. Of what is then still in different components, short lists meet pair by pair.
The members of a long list meet in a frame: each is told by its differences from the list's leader alone, with what most
members have in common taken out. Two members whose differences add up to few enough are linked, and the one with the
fewest stands for all of these; any others that are linked share one of their rarest differences. Lists of differences
are short as a rule; a long one is a frame again, of half the members at most. So families of documents that are nearly
linked, but not quite, don't meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import LOWER, SPACED_WORD, free_names, holds_cache, mix, shared_folder, span_hashes, text_slices, word_spans, written

COORDINATES = 40
MISS = 1e-12
ROUNDS = 3
BROADCAST_IDS = 500_000
#: Links that are broadcast, and whose components one task finds; more go through rounds of joins.
FEW_LINKS = 20_000
#: Frames whose counts and centres (not their sets) are broadcast.
FEW_FRAMES = 1000
#: Lists of up to so many nodes, or a quarter of their differences, meet pair by pair.
SHORT = 8
#: Nodes of one list that a task joins with what is known of the list; longer ones are dealt over several.
DEALT = 512
#: Differences of one frame that are counted in one task, about; a frame with more is dealt by hashes of the differences.
PART = 50_000

_C = np.uint64(0x9E3779B97F4A7C15)
_KEYS = np.random.default_rng(20240501).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


def needed_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of equal coordinates that a pair of this similarity reaches but with probability `miss` at most."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row; a row of fewer words, but not none, has its whole sequence as one."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACED_WORD)
    w = span_hashes(data, starts, ends)
    h = w.copy()
    for k in range(1, words):
        h = mix(h[:-1] * _C + w[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(h[a : b - words + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for v in w[a:b]:
                x = mix(x * _C + v)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        a, b = mix(grams + _C).sum(dtype=np.uint64), mix(grams ^ _C).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of (coordinate, value) hashes per non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, coordinates), np.int64)
    grams, at = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
    out = np.empty((len(full), coordinates), np.uint64)
    for k in range(coordinates):
        out[:, k] = mix(np.minimum.reduceat((grams ^ _KEYS[0, k]) * _KEYS[1, k], at) ^ _KEYS[0, 255 - k])
    return out.view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def _signed(rows: DataFrame, words: int, coordinates: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("neardup")
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                sets = shingle_sets(data, offsets, words)
                prints = [fingerprint(s) for s in sets]
                tokens = iter(signatures(sets, coordinates))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array([next(tokens) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "tokens"])

    return rows.mapInArrow(sign, "id bigint, n bigint, f1 bigint, f2 bigint, tokens array<bigint>")


def _sets_of(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, n, grams) of the wanted nodes (rep, f1, f2), from their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("neardup")
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                grams = shingle_sets(data, offsets, words)
                same = [fingerprint(s) == p for s, p in zip(grams, zip(part.column("f1").to_pylist(), part.column("f2").to_pylist(), strict=True), strict=True)]
                keep = pa.array(same)
                yield pa.RecordBatch.from_arrays([part.column("id").filter(keep), pa.array([len(s) for s, ok in zip(grams, same, strict=True) if ok], pa.int64()), pa.array([s.view(np.int64) for s, ok in zip(grams, same, strict=True) if ok], pa.list_(pa.int64()))], names=["rep", "n", "grams"])

    wanted = wanted.withColumnRenamed("rep", "id")
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "id").mapInArrow(sets, "rep bigint, n bigint, grams array<bigint>")


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b); nodes without edges aren't listed.

    Alternating large-star and small-star steps: each keeps at most as many edges as it got, whatever a node's degree.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    at, step = written(pairs, f"{folder}/0"), 0
    seen = mark(at)
    while seen[0]:
        step += 1
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        at = written(small, f"{folder}/{step}")
        if (now := mark(at)) == seen:
            break
        seen = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def components_of_few(edges: DataFrame) -> DataFrame:
    """What connected_components() gives, for FEW_LINKS edges at most: one task finds them, without rounds of joins."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
        nodes = [*root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "root"])

    return edges.where("a <> b").select("a", "b").repartition(1).mapInArrow(found, "node bigint, root bigint")


def dealt_join(many: DataFrame, few: DataFrame, on: list[str], small: bool = False) -> DataFrame:
    """many joined with few (one row per key), both with a column `often`: a bound on the key's rows; keys of more than DEALT rows are dealt over tasks. A small table is broadcast."""
    if small:
        return many.join(F.broadcast(few.drop("often")), on)
    parts = lambda: F.greatest(F.ceil(F.col("often") / DEALT), F.lit(1))
    one = many.withColumn("_part", F.pmod(F.xxhash64("rep"), parts()))
    two = few.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts() - 1))).drop("often")
    return one.join(two, [*on, "_part"]).drop("_part")


def post_coordinates(reps: DataFrame, needed: int) -> DataFrame:
    """(rep, token, central, often): each node under the rarest of its signature's pairs, `needed` - 1 of the shared ones left out."""
    tokens = reps.select("rep", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    # pairs that are skipped stand first in the order by rarity, so of m shared ones the rarest m - needed + 1 remain of the prefix
    prefix = tokens.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("shared")).where(F.size("shared") >= needed)
    # the node most like all that it meets: its pairs are the most frequent ones
    prefix = prefix.withColumn("central", F.aggregate("shared", F.lit(0).cast("bigint"), lambda a, x: a + x["often"]))
    posted = prefix.select("rep", "central", F.explode(F.expr(f"slice(shared, 1, size(shared) - {needed - 1})")).alias("x"))
    return posted.groupBy("rep", F.col("x.token").alias("token")).agg(F.max("central").alias("central"), F.max("x.often").alias("often"))


def post_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, token, central, often): each node under the rarest of its shingles, as many as any linked set must share one of."""
    grams = sets.select("rep", "n", F.explode("grams").alias("token"))
    often = grams.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    by_rep = Window.partitionBy("rep", "n")
    place = F.row_number().over(by_rep.orderBy("often", "token")) + F.col("n") - F.count("*").over(by_rep)  # those of no other node stand first
    placed = grams.join(often, "token").withColumn("central", F.sum("often").over(by_rep)).withColumn("place", place)
    return placed.where(f"place <= n - (({percent} * n + 99) DIV 100) + 1").groupBy("rep", "token").agg(F.max("central").alias("central"), F.max("often").alias("often"))


def _pairs_of_few(listed: DataFrame, on: list[str], where: str = "true") -> DataFrame:
    """(a, b) of different components in the same list, once each; of each pair one at least is `far`, outside the list's main component."""
    own = listed.where("far").select(*on, "often", *(F.col(c).alias(f"{c}_a") for c in listed.columns if c not in (*on, "often")))
    other = listed.select(*on, "often", "rep", *(F.col(c).alias(f"{c}_b") for c in listed.columns if c not in (*on, "often")))
    met = dealt_join(other, own, on).where(f"component_a <> component_b AND (rep_a < rep_b OR NOT far_b) AND {where}")
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _in_parts(members: DataFrame) -> DataFrame:
    """A frame's members with their differences in parts: rows (..., part, grams) in place of (..., parts, delta), one for each part that a member has differences in."""
    cut = F.expr("transform(sequence(0L, parts - 1), p -> struct(p AS part, filter(delta, g -> pmod(g, parts) = p) AS grams))")
    rows = members.withColumn("_x", F.explode(cut)).select(*(c for c in members.columns if c not in ("delta", "parts")), "_x.part", "_x.grams")
    return rows.where(F.size("grams") > 0).repartition("frame", "part").sortWithinPartitions("frame", "part")


def _part_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, all differences, the row of each) of one frame and part after the other."""

    def given(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        grams = rows.column("grams").chunk(0)
        return rows, grams.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(rows)), np.diff(np.asarray(grams.offsets)))

    held, now = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(batch.column("frame").to_pylist(), batch.column("part").to_pylist(), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[i] != now and held:
                yield given(held)
                held = []
            now = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield given(held)


def usual_grams(members: DataFrame) -> DataFrame:
    """(frame, gram): differences of more than half of the members (frame, members, parts, delta)."""

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("neardup")
        for rows, grams, _ in _part_tables(batches):
            values, counts = np.unique(grams, return_counts=True)
            common = values[2 * counts > rows.column("members")[0].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([rows.column("frame")[0].as_py()] * len(common), pa.string()), pa.array(common)], names=["frame", "gram"])

    return _in_parts(members).mapInArrow(usual, "frame string, gram bigint")


def shared_grams(members: DataFrame) -> DataFrame:
    """(frame, rep, known): the differences, with how many members have them, that a member (frame, rep, far, parts, delta) shares with others, a far one among them; an array for each part."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("neardup")
        kind = pa.list_(pa.struct([("often", pa.int64()), ("gram", pa.int64())]))
        for rows, grams, owner in _part_tables(batches):
            _, at, counts = np.unique(grams, return_inverse=True, return_counts=True)
            far = rows.column("far").to_numpy(zero_copy_only=False).astype(bool)
            told = np.bincount(at, weights=far[owner], minlength=len(counts)) > 0
            use = (told & (counts > 1))[at]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[use], minlength=len(rows)))]).astype(np.int32)
            known = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(counts[at][use].astype(np.int64)), pa.array(grams[use])], names=["often", "gram"])).cast(kind)
            out = pa.RecordBatch.from_arrays([rows.column("frame").chunk(0), rows.column("rep").chunk(0), known], names=["frame", "rep", "known"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return _in_parts(members).mapInArrow(shared, "frame string, rep bigint, known array<struct<often: bigint, gram: bigint>>")


def frame_pairs(frames: DataFrame, percent: int, folder: str, relabel: Callable[[DataFrame, str], DataFrame], short: int = SHORT) -> DataFrame:
    """(a, b): candidates among the members of frames (frame, rep, n, delta, often), no link between components left out.

    n is the size of a member's set, delta its differences from the frame's centre, often a bound on the frame's members;
    relabel(links, name) takes links (a, b) into account and gives (rep, component) after them. With
    y = (100 + percent) * size(delta) - (100 - percent) * n, two members are linked just if their deltas share
    (y_a + y_b) / (2 * (100 + percent)) differences or more: none if y_a + y_b <= 0, and then the member with the least y
    is linked to both of them. All of its component are one side; only far members, those outside, are to be compared.
    """
    whole, found, step = 100 + percent, [], 0
    while not frames.isEmpty():
        at = f"{folder}/{step}"
        rows = frames.groupBy("frame").agg(F.count("*").alias("members"), F.max("often").alias("often"), F.greatest(F.ceil(F.sum(F.size("delta")) / PART), F.lit(1)).alias("parts"))
        rows = written(rows, f"{at}-frames")
        small = rows.limit(FEW_FRAMES + 1).count() <= FEW_FRAMES
        sized = written(dealt_join(frames, rows.select("frame", "often", "members", "parts"), ["frame"], small), f"{at}-sized")
        # what more than half of the members differ in belongs to the centre
        usual = usual_grams(sized.select("frame", "members", "parts", "delta")).groupBy("frame").agg(F.collect_list("gram").alias("usual"))
        moved = dealt_join(sized, rows.join(usual, "frame", "left").select("frame", "often", "usual"), ["frame"])
        moved = moved.withColumn("delta", F.when(F.col("usual").isNull(), F.col("delta")).otherwise(F.concat(F.array_except("delta", "usual"), F.array_except("usual", "delta")))).drop("usual")
        moved = written(moved.withColumn("y", whole * F.size("delta") - (100 - percent) * F.col("n")), f"{at}-moved")
        nearest = written(moved.groupBy("frame").agg(F.min(F.struct("y", "rep")).alias("x"), F.max("often").alias("often")), f"{at}-nearest")
        near = dealt_join(moved.select("frame", "rep", "y", "often"), nearest, ["frame"], small).where("y + x.y <= 0 AND rep <> x.rep")
        component = relabel(near.select(F.col("x.rep").alias("a"), F.col("rep").alias("b")), f"near{step}")

        centres = (F.broadcast(nearest) if small else nearest).join(component.select(F.col("rep").alias("_r"), F.col("component").alias("main")), F.col("x.rep") == F.col("_r")).drop("_r")
        moved = dealt_join(moved.join(component, "rep"), centres, ["frame"], small).withColumn("far", F.expr("component <> main"))
        outside = moved.where("far").groupBy("frame").agg(F.min("y").alias("far_y"))
        moved = written(dealt_join(moved, rows.select("frame", "often").join(outside, "frame"), ["frame"], small), f"{at}-open")
        kept = F.size("delta") - F.greatest(F.lit(1).cast("bigint"), -F.floor(-(F.col("y") + F.when(F.col("far"), F.col("x.y")).otherwise(F.col("far_y"))) / (2 * whole))) + 1
        open_ = moved.select("frame", "rep", "component", "far", "n", "y", F.size("delta").alias("size"), kept.alias("kept"), "parts", "delta").where("kept > 0")
        # only what a far member differs in, too, can be shared with one; all else stands first in the order, with what nobody shares
        known = shared_grams(open_.select("frame", "rep", "far", "parts", "delta")).groupBy("frame", "rep").agg(F.array_sort(F.flatten(F.collect_list("known"))).alias("known"))
        ordered = open_.drop("delta", "parts").join(known, ["frame", "rep"]).withColumn("first", F.col("size") - F.size("known"))
        chosen = ordered.withColumn("known", F.expr("slice(known, 1, CAST(greatest(kept - first, 0) AS INT))"))
        posted = chosen.select("frame", "rep", "component", "far", "n", "y", "size", "first", F.posexplode("known").alias("at", "x"))
        posted = written(posted.select("frame", "rep", "component", "far", "n", "y", "size", "x.gram", "x.often", (F.col("first") + F.col("at") + 1).alias("place")), f"{at}-posted")
        lists = posted.groupBy("frame", "gram").agg(F.count_if("far").alias("n_far"), F.avg("size").alias("mean"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("often").alias("often")).where("low <> high")
        tagged = written(dealt_join(posted, lists.select("frame", "gram", "often", F.expr(f"n_far <= greatest({short}, mean / 2)").alias("short")), ["frame", "gram"]), f"{at}-tagged")
        enough = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND 2 * {whole} * (1 + least(size_a - place_a, size_b - place_b)) >= y_a + y_b"
        found.append(written(_pairs_of_few(tagged.where("short").drop("short"), ["frame", "gram"], enough), f"{at}-pairs"))

        again = tagged.where("NOT short").select("frame", "rep", F.concat_ws("/", "frame", F.hex("gram")).alias("inner"), F.col("often").alias("inner_often"))
        frames = written(moved.select("frame", "rep", "n", "delta").join(again, ["frame", "rep"]).select(F.col("inner").alias("frame"), "rep", "n", "delta", F.col("inner_often").alias("often")), f"{at}-inner")
        step += 1
    out = frames.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    for more in found:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coordinates: int = COORDINATES, rounds: int = ROUNDS, exact: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    A document's set: the distinct shingles of `words` words `[^\\x20\\x09-\\x0D]+` after A-Z went to lower case; with fewer
    words, the whole sequence as one. Documents with 100 * intersection >= percent * union are linked; component_id is
    the smallest id reachable, kept tells whether it is the row's own. NULL, empty and wordless texts have an empty set and
    are linked with nothing. Rows with a NULL id take no part: component_id NULL, kept true. Rows that repeat an id are one
    node, with the links of each of their texts. An empty table gives an empty one. Other columns are not read.

    A link may be missed with a probability of MISS at most; exact=True posts documents by shingles and misses none.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = _rows(docs, id_col, text_col)
    signed = written(_signed(rows, words, coordinates), f"{folder}/signed")
    full = signed.where("n > 0 AND id IS NOT NULL")
    needed = needed_matches(percent, coordinates)

    classes = written(full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), f"{folder}/classes")
    reps = full.join(classes, ["f1", "f2", "n"]).where("id = rep").select("rep", "f1", "f2", "n", "tokens").dropDuplicates(["rep", "f1", "f2"])
    reps = written(reps, f"{folder}/reps")
    if exact:
        sets = written(_sets_of(rows, reps.select("rep", "f1", "f2"), words), f"{folder}/sets")
        posted = written(post_shingles(sets, percent), f"{folder}/posted")
        nodes = written(reps.join(posted.select("rep").distinct(), "rep", "left_semi"), f"{folder}/nodes")
    else:
        posted = written(post_coordinates(reps, needed), f"{folder}/posted")
        nodes = written(reps.join(posted.select("rep").distinct(), "rep", "left_semi"), f"{folder}/nodes")
        sets = written(_sets_of(rows, nodes.select("rep", "f1", "f2"), words), f"{folder}/sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        own, other = (sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"grams_{c}")) for c in "ab")
        met = pairs.join(own, "a").join(other, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        shared = F.size(F.array_intersect("grams_a", "grams_b"))
        return met.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b").distinct()

    own = written(full.join(classes, ["f1", "f2", "n"]).select("id", "rep").distinct(), f"{folder}/own")
    # rows of one id are one node even where their texts fall into several classes
    several = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a <> high").select("id", "a")
    alike = own.join(several, "id").where("rep <> a").select("a", F.col("rep").alias("b"))
    some_alike = not alike.isEmpty()
    if some_alike:
        alike = written(alike, f"{folder}/alike")
        component = written(nodes.select("rep").union(alike.select("a")).union(alike.select("b")).distinct().select("rep", F.col("rep").alias("component")), f"{folder}/first-components")
    else:
        component = nodes.select("rep", F.col("rep").alias("component"))

    def merged(links: DataFrame, at: str) -> DataFrame:
        """component after links between components."""
        of = lambda c: component.select(F.col("rep").alias(c), F.col("component").alias(f"c_{c}"))
        few = links.limit(FEW_LINKS + 1).count() <= FEW_LINKS
        held = F.broadcast if few else lambda x: x
        edges = held(held(links).join(of("a"), "a").select("b", "c_a")).join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        roots = held(written(components_of_few(edges), f"{folder}/{at}-roots") if few else connected_components(edges, f"{folder}/{at}-stars"))
        moved = component.join(roots.withColumnRenamed("node", "component"), "component", "left").select("rep", F.coalesce("root", "component").alias("component"))
        return written(moved, f"{folder}/{at}-components")

    def split_lists(choice: Column) -> DataFrame:
        """(token, often, leader, leads, n_far): the lists that hold several components, with the member first by `choice` and how many are not in its component."""
        by_side = lists.groupBy("token", "component").agg(F.min(F.struct(choice.alias("h"), F.col("rep").alias("leader"))).alias("x"), F.count("*").alias("k"), F.max("often").alias("often"))
        found = by_side.groupBy("token").agg(F.min(F.struct("x.h", "x.leader", F.col("component").alias("leads"), "k")).alias("x"), F.sum("k").alias("members"), F.max("often").alias("often"), F.count("*").alias("sides"))
        return found.where("sides > 1").select("token", "often", "x.leader", "x.leads", (F.col("members") - F.col("x.k")).alias("n_far"))

    if some_alike:
        component = merged(alike, "alike")
    n_nodes = nodes.count()
    for k in range(rounds):
        lists = posted.join(component, "rep")
        leaders = split_lists(F.xxhash64("rep", F.lit(k)) if k else -F.col("central"))
        met = dealt_join(lists, leaders, ["token"]).where("component <> leads").groupBy("rep", "leader").agg(F.count("*").alias("collisions"), F.min("often").alias("often"))
        # each node is tried with the leader it meets most often and with that of its rarest list
        best = met.groupBy("rep").agg(F.max(F.struct("collisions", "leader")).alias("x"), F.min(F.struct("often", "leader")).alias("y"))
        best = best.select(F.col("rep").alias("b"), F.explode(F.array_distinct(F.array("x.leader", "y.leader"))).alias("a"))
        links = written(confirmed(best), f"{folder}/{k}-links")
        joined = links.count()
        if joined:
            component = merged(links, str(k))
        if joined < n_nodes // 100:
            break  # a further round would cost more than what is left to the lists

    lists = posted.join(component, "rep")
    tagged = dealt_join(lists, split_lists(-F.col("central")), ["token"])
    tagged = written(tagged.withColumn("far", F.expr("component <> leads")), f"{folder}/tagged")
    near = _pairs_of_few(tagged.where(f"n_far <= {SHORT}").select("token", "often", "rep", "component", "far"), ["token"])
    if not exact:
        of = lambda c: nodes.select(F.col("rep").alias(c), F.col("tokens").alias(f"tokens_{c}"))
        near = near.join(of("a"), "a").join(of("b"), "b").where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= needed).select("a", "b")
    # long lists with the same main component are one frame, so that a node is in few of them; the leader of the longest is its centre
    long = tagged.where(f"n_far > {SHORT}").select(F.col("leads").alias("frame"), "rep", "often", "leader")
    framed = long.groupBy("frame", "rep").agg(F.max("often").alias("often"))
    centres = long.groupBy("frame").agg(F.max(F.struct("often", "leader")).alias("x")).select("frame", "x.often", "x.leader").join(sets.select(F.col("rep").alias("leader"), F.col("grams").alias("centre")), "leader").drop("leader")
    placed = dealt_join(framed.join(sets, "rep"), centres, ["frame"])
    frames = written(placed.select(F.col("frame").cast("string").alias("frame"), "rep", "n", F.concat(F.array_except("grams", "centre"), F.array_except("centre", "grams")).alias("delta"), "often"), f"{folder}/frames")

    def relabel(links: DataFrame, at: str) -> DataFrame:
        nonlocal component
        links = written(links.distinct(), f"{folder}/{at}-links")
        if not links.isEmpty():
            component = merged(links, at)
        return component

    met = near.union(frame_pairs(frames, percent, f"{folder}/frame", relabel)).distinct()
    links = written(confirmed(met), f"{folder}/last-links")
    if not links.isEmpty():
        component = merged(links, "last")

    return _labelled(signed, own, component)


def _labelled(signed: DataFrame, own: DataFrame, component: DataFrame) -> DataFrame:
    roots = own.join(component, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = signed.select("id", F.col("n").alias("n_shingles")).join(roots, "id", "left")
    label = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", label.alias("component_id"), F.coalesce(label == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the smallest id, all columns as they were.

    Of rows that repeat a kept id, the first by text stays; rows with a NULL id all stay.
    """
    found = written(near_duplicates(docs, id_col, text_col, **options).select("id", "kept"), f"{shared_folder(docs.sparkSession)}/kept")
    ids = found.where("kept AND id IS NOT NULL").groupBy("id").agg(F.count("*").alias("times"))
    gone_id, place = free_names(docs, "gone_id", "place")
    gone = found.where("NOT kept").select(F.col("id").alias(gone_id)).distinct()
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)  # then texts are not shuffled
    own = docs.join(gone, F.col(id_col).cast("bigint") == F.col(gone_id), "left_anti")
    if ids.where("times > 1").isEmpty():
        return own
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    return own.withColumn(place, F.when(F.col(id_col).isNotNull(), nth).otherwise(1)).where(F.col(place) == 1).drop(place)


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words=3, percent=85).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), s AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
