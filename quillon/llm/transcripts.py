"""Transcript parsing: a hidden Markov model over speaker markers and line features, Viterbi roles, canonical turns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import shared_folder, written

ROLES = ("system", "user", "assistant")
#: Hidden states: each role, at the first line of a turn and further on.
STATES = tuple((r, first) for r in ROLES for first in (True, False))
START = len(STATES)
#: Lines of one block, and the characters up to which a turn that spans blocks is put together again.
BLOCK_LINES = 4096
JOINED_CHARS = 1 << 24

# Names by which speakers are marked.
MARKS = {"system": "system|sys|instructions?|context", "user": "user|human|question|q|customer|me", "assistant": "assistant|ai|bot|answer|a|agent|model", "any": "speaker(?: \\d+)?|unknown|guest"}
_MARK = r"^\s*[\[<*(#>]*\s*({})\s*[\]>*)]*\s*[:>|]\s*"
CLASSES = (*MARKS, "none")
SHAPES = 8


def marked_class(text: Column) -> Column:
    """Index into CLASSES of the speaker marker in front of a line."""
    out = F.lit(len(MARKS))
    for k, names in reversed(list(enumerate(MARKS.values()))):
        out = F.when(text.rlike("(?i)" + _MARK.format(names)), k).otherwise(out)
    return out.cast("int")


def unmarked(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + _MARK.format("|".join(MARKS.values())), "")


def line_shape(text: Column) -> Column:
    """0 to SHAPES - 1: four classes of length, and whether there is a question mark."""
    n = F.char_length(text)
    return (F.when(n < 40, 0).when(n < 120, 1).when(n < 400, 2).otherwise(3) + F.when(text.contains("?"), 4).otherwise(0)).cast("int")


def numbered(rows: DataFrame, order: list[str], text: str, block_rows: int) -> DataFrame:
    """rows with `pos`, which rises in the order given (NULLs first, then a hash of the text), and `block`: at most block_rows neighbours, whatever the values are."""
    by = [*(F.col(c).asc_nulls_first() for c in order), F.xxhash64(text)]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    # the number of the partition stands above the lower 33 bits
    return placed.withColumn("block", F.shiftright("pos", 33) * (1 << 33) + F.floor(F.col("pos").bitwiseAND((1 << 33) - 1) / block_rows))


def lines_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", block_lines: int = BLOCK_LINES) -> DataFrame:
    """(conv, block, pos, turn, line, mark, shape, text): each line with its features and without its marker; NULL text is an empty line."""
    cut = turns.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "raw"))
    return numbered(cut, ["conv", "turn", "line"], "raw", block_lines).select("conv", "block", "pos", "turn", "line", marked_class(F.col("raw")).alias("mark"), line_shape(F.col("raw")).alias("shape"), unmarked(F.col("raw")).alias("text"))


@dataclass(frozen=True)
class RoleModel:
    """Log-probabilities: move[from, to] with the start as last `from`; show[state, mark, shape]."""

    move: np.ndarray
    show: np.ndarray


def fit_roles(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> RoleModel:
    """Count moves and features over all turns whose role is known; what comes to the driver is one row per state pair or state and feature."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.col(role_col))) - 1
    known = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text"), role.cast("int").alias("role")).where("role >= 0")
    state = lambda r, line: r * 2 + F.when(line == 0, 0).otherwise(1)
    cut = known.select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    seen = cut.groupBy(state(F.col("role"), F.col("line")).cast("int").alias("state"), marked_class(F.col("raw")).alias("mark"), line_shape(F.col("raw")).alias("shape")).agg(F.count("*").alias("n")).collect()
    # a turn's own lines, and the first line of the turn that follows it, in the next block as well
    sized = known.select("conv_id", "turn", "role", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    rows = written(numbered(sized, ["conv_id", "turn", "role"], "text", BLOCK_LINES).select("conv_id", "block", "pos", "role", "lines", F.least("lines", F.lit(3)).alias("few")), f"{shared_folder(turns.sparkSession)}/roles")
    own = rows.groupBy("role", "few").agg(F.sum("lines").alias("lines"), F.count("*").alias("n")).collect()
    inside = rows.withColumn("next", F.lead("role").over(Window.partitionBy("conv_id", "block").orderBy("pos"))).where("next IS NOT NULL").groupBy("role", "few", "next").agg(F.count("*").alias("n"))
    ends = rows.groupBy("conv_id", "block").agg(F.min_by("role", "pos").alias("start"), F.max_by(F.struct("role", "few"), "pos").alias("end"))
    blocks = Window.partitionBy("conv_id").orderBy("block")  # one row per block
    ends = ends.withColumn("next", F.lead("start").over(blocks)).withColumn("first", F.row_number().over(blocks) == 1)
    across = ends.where("next IS NOT NULL").groupBy("end.role", "end.few", "next").agg(F.count("*").alias("n"))
    begun = ends.where("first").groupBy("start").agg(F.count("*").alias("n")).collect()
    move, show = np.full((START + 1, START), 0.1), np.full((START, len(CLASSES), SHAPES), 0.05)
    for r in seen:
        show[r["state"], r["mark"], r["shape"]] += r["n"]
    for r in own:
        b, i, n = 2 * r["role"], 2 * r["role"] + 1, r["n"]
        if r["few"] > 1:
            move[b, i] += n
            move[i, i] += r["lines"] - 2 * n
    for r in inside.union(across).collect():
        move[2 * r["role"] + (r["few"] > 1), 2 * r["next"]] += r["n"]
    for r in begun:
        move[START, 2 * r["start"]] += r["n"]
    for a in range(START):  # a later line follows a line of its own role only
        for b in range(1, START, 2):
            if a // 2 != b // 2:
                move[a, b] = 0
    move[START, 1::2] = 0
    with np.errstate(divide="ignore"):
        return RoleModel(np.log(move / move.sum(1, keepdims=True)), np.log(show / show.sum((1, 2), keepdims=True)))


def transfer(model: RoleModel, marks: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """best[p, s]: score of the best way from p before the first line to s at the last; blocks chain by such tables."""
    best = model.move + model.show[:, marks[0], shapes[0]]
    inner = model.move[:START]
    for m, h in zip(marks[1:], shapes[1:], strict=True):
        best = (best[:, :, None] + inner[None]).max(1) + model.show[:, m, h]
    return best


def viterbi(model: RoleModel, marks: np.ndarray, shapes: np.ndarray, entry: int, end: int | None) -> list[int]:
    """The best states from `entry` before the first line on, ending in `end` if that is given; ties go to the lower state."""
    v, back = model.move[entry] + model.show[:, marks[0], shapes[0]], []
    inner = model.move[:START]
    for m, h in zip(marks[1:], shapes[1:], strict=True):
        ways = v[:, None] + inner
        back.append(ways.argmax(0))
        v = ways.max(0) + model.show[:, m, h]
    states = [int(v.argmax()) if end is None else end]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns in a sorted stream."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_TABLES = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("best", pa.list_(pa.float64()))])
_BOUNDS = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("end", pa.int32()), ("more", pa.bool_())])
_PIECES = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("piece", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("line", pa.int32()), ("begins", pa.bool_()), ("open", pa.bool_()), ("role", pa.string()), ("n_lines", pa.int32()), ("text", pa.string())])


def parse_transcripts(turns: DataFrame, model: RoleModel, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", block_lines: int = BLOCK_LINES, joined_chars: int = JOINED_CHARS) -> DataFrame:
    """(conv, turn, line, part, role, n_lines, text, rendered): the turns that Viterbi finds in each conversation's lines.

    Rows of `turns` are pieces of transcript in the order of turn_col; speakers are hidden, and a found turn may begin at
    any line and span rows. turn and line tell where it begins. rendered is `<|role|>`, a line end and its lines. Roles are
    the three of ROLES; what others say is given to the likeliest of these.

    All lines are sorted and cut into blocks of block_lines by their place alone, so that a conversation of any length,
    NULL turns, equal turns or one row of a million lines are spread over tasks. Each block becomes a table of best scores
    between its borders; the tables of a conversation, a few numbers each, are chained, which fixes the state at each
    border of the exact best path, and each block is then solved alone. A turn that spans blocks is put together again
    while its later lines have joined_chars characters at most; else it comes in parts from 0 on.

    NULL conversations form one conversation, NULL turns come first in it; NULL and empty texts are one empty line; rows
    that tie in a turn go by line, then by a hash of the text. An empty table gives an empty one; other columns are not read.
    """
    folder = shared_folder(turns.sparkSession)
    lines = written(lines_of(turns, conv_col, turn_col, text_col, block_lines), f"{folder}/lines")
    fields = [*lines.columns]
    at = {c: k for k, c in enumerate([*fields, "entry", "end", "more"])}
    marks = lambda g: (np.array([r[at["mark"]] for r in g]), np.array([r[at["shape"]] for r in g]))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((*key, transfer(model, *marks(g)).ravel().tolist()) for key, g in _groups(batches, 2)), _TABLES)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bounds() -> Iterator[tuple]:
            for (conv,), g in _groups(batches, 1):
                best = [np.array(r[2]).reshape(START + 1, START) for r in g]
                upto = [best[0][START]]
                for b in best[1:]:
                    upto.append((upto[-1][:, None] + b[:START]).max(0))
                end, out = int(upto[-1].argmax()), []
                for k in range(len(g) - 1, -1, -1):
                    entry = int((upto[k - 1] + best[k][:START, end]).argmax()) if k else START
                    out.append((conv, g[k][1], entry, end, k < len(g) - 1))
                    end = entry
                yield from reversed(out)

        yield from _batched(bounds(), _BOUNDS)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for key, g in _groups(batches, 2):
                states = viterbi(model, *marks(g), g[0][at["entry"]], g[0][at["end"]])
                starts = [k for k, s in enumerate(states) if not k or s % 2 == 0]
                for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(g)], strict=True)):
                    first = g[a]
                    yield (*key, p, first[at["pos"]], first[at["turn"]], first[at["line"]], states[a] % 2 == 0, b == len(g) and first[at["more"]], ROLES[states[a] // 2], b - a, "\n".join(r[at["text"]] for r in g[a:b]))

        yield from _batched(pieces(), _PIECES)

    order = [F.col(c).asc_nulls_first() for c in ("conv", "block", "pos")]
    spread = lines.repartition("conv", "block").sortWithinPartitions(*order)
    tabled = spread.mapInArrow(tables, "conv bigint, block bigint, best array<double>")
    chained = tabled.repartition("conv").sortWithinPartitions(*order[:2]).mapInArrow(chain, "conv bigint, block bigint, entry int, end int, more boolean")
    bounds = chained.select(F.col("conv").alias("c"), F.col("block").alias("b"), "entry", "end", "more")
    bound = lines.join(bounds, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(*fields, "entry", "end", "more")
    solved = bound.repartition("conv", "block").sortWithinPartitions(*order).mapInArrow(solve, "conv bigint, block bigint, piece int, pos bigint, turn bigint, line int, begins boolean, open boolean, role string, n_lines int, text string")
    solved = written(solved, f"{folder}/pieces")

    # parts that run on from an earlier block belong to the last turn that began before: one row per block tells which
    by_block = Window.partitionBy("conv").orderBy("block")
    last = solved.groupBy("conv", "block").agg(F.max(F.when(F.col("begins"), F.struct("piece", "pos", "turn", "line"))).alias("x"))
    last = last.withColumn("number", F.row_number().over(by_block))
    last = last.withColumn("from", F.last(F.when(F.col("x").isNotNull(), F.struct("number", "x.pos", "x.turn", "x.line")), ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)))
    runs_on = solved.where("NOT begins").join(last.select(F.col("conv").alias("c"), F.col("block").alias("b"), "number", "from"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    runs_on = written(runs_on.select("conv", F.col("from.pos").alias("pos"), F.col("from.turn").alias("turn"), F.col("from.line").alias("line"), (F.col("number") - F.col("from.number")).cast("int").alias("part"), "role", "n_lines", "text"), f"{folder}/runs-on")
    short = runs_on.groupBy("pos").agg(F.sum(F.char_length("text") + 1).alias("chars")).where(F.col("chars") <= joined_chars).select("pos")
    tail = runs_on.join(short, "pos").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("part", "n_lines", "text"))).alias("tail"))
    begun = solved.where("begins").select("conv", "pos", "turn", "line", F.lit(0).alias("part"), "open", "role", "n_lines", "text")
    longer = begun.where("open").join(tail, "pos", "left")
    longer = longer.withColumn("n_lines", F.col("n_lines") + F.coalesce(F.aggregate("tail", F.lit(0), lambda a, x: a + x["n_lines"]), F.lit(0)))
    longer = longer.withColumn("text", F.when(F.col("tail").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.array("text"), F.transform("tail", lambda x: x["text"])), "\n")))
    columns = ["conv", "turn", "line", "part", "role", "n_lines", "text"]
    out = begun.where("NOT open").select(columns).unionByName(longer.select(columns)).unionByName(runs_on.join(short, "pos", "left_anti").select(columns))
    return out.withColumn("rendered", F.when(F.col("part") == 0, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))).otherwise(F.col("text")))


# How transcripts mark system, user and assistant; the last one leaves speakers unnamed.
STYLES = (("System: ", "User: ", "Assistant: "), ("[SYS] > ", "Human> ", "AI> "), ("Context: ", "Q: ", "A: "), ("## system: ", "** user **: ", "** assistant **: "), ("Speaker 0: ", "Speaker 1: ", "Speaker 2: "))


def as_transcripts(turns: DataFrame) -> DataFrame:
    """conversations as raw transcripts: (conv_id, turn, text, role), each text with its conversation's kind of speaker marker, or for one turn in eight without any."""
    pick = lambda key, n: F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(n))
    style = (pick(F.concat(F.lit("style:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))), len(STYLES)) + 1).cast("int")
    bare = pick(F.concat_ws(":", F.lit("bare"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), 8) == 0
    mark = F.lit("")
    for k, role in enumerate(ROLES):
        mark = F.when(F.col("role") == role, F.element_at(F.array(*(F.lit(s[k]) for s in STYLES)), style)).otherwise(mark)
    return turns.select("conv_id", "turn", F.concat(F.when(bare, "").otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"), "role")


def op6_transcripts(spark, sf_dir: str) -> DataFrame:
    raw = as_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return parse_transcripts(raw, fit_roles(raw)).select(F.col("conv").alias("conv_id"), "turn", "line", "part", "role", "n_lines", "rendered")
