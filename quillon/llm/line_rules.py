"""Quality rules, line first: rules for punctuation, navigation and boilerplate judge each line, what fails is taken out, and documents that lose too much go."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm._batches import LOWER, SPACED_WORD, holds_cache, mix, small_batches, span_hashes, text_slices, word_spans

# Marks that close a line, words that separate links, symbols, and what boilerplate says.
CLOSING = ".!?:;\"')…”»。！？"
SEPARATORS = "|>/-*"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript", "click here", "read more", "sign up", "log in", "subscribe to", "skip to content")


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules, for whole documents and for lines."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    open_words: int = 8
    symbol_percent: int = 10
    link_words: int = 3
    notice_words: int = 30
    same_lines: int = 3
    max_lost_percent: int = 30


RULES = Rules()

SCHEMA = "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_punctuation bigint, n_navigation bigint, n_boilerplate bigint, lost_chars bigint, base_failed boolean, kept boolean, cleaned string"

_C = np.uint64(0x9E3779B97F4A7C15)
_NOTICE = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars if ord(c) < 128]] = True
    return t


_IS_CLOSING, _IS_SEPARATOR, _IS_SYMBOL, _IS_CALL = _table(CLOSING), _table(SEPARATORS), _table(SYMBOLS), _table("!?")
_WIDE_CLOSING = [c.encode() for c in CLOSING if ord(c) >= 128]


def _between(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sums[b] - sums[a]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])


def _nth(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many equal (group, value) stand before each entry."""
    order = np.lexsort((values, groups))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (groups[order][1:] != groups[order][:-1]) | (values[order][1:] != values[order][:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - first[np.cumsum(new) - 1]
    return out


def _repeated(row: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """Flags of the words that stand in a window of words which the row has twice or more."""
    out = np.zeros(len(row) + 1, np.int64)
    if len(row) < window:
        return out[:-1] > 0
    n, h = len(row) - window + 1, hashes
    for k in range(1, window):
        h = mix(h[:-1] * _C + hashes[k:])
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(inside):
        return out[:-1] > 0
    rows, h = row[inside], h[inside]
    order = np.lexsort((h, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[:-1] |= same
    twice[1:] |= same
    at = inside[order[twice]]
    np.add.at(out, at, 1)
    np.add.at(out, np.minimum(at + window, len(row)), -1)
    return np.cumsum(out[:-1]) > 0


def judge(data: np.ndarray, offsets: np.ndarray, rules: Rules = RULES) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(columns of SCHEMA per row, line starts, line ends, which lines stay) of the rows' texts in UTF-8."""
    n_rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, SPACED_WORD)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    chars = _sums((data & 0xC0) != 0x80)
    symbols, calls = _sums(_IS_SYMBOL[data]), _sums(_IS_CALL[data])
    word_chars = _between(chars, starts, ends)
    repeats = _repeated(row, span_hashes(data, starts, ends), rules.window)

    breaks = np.flatnonzero(data == 10)
    # empty rows begin where the next one does, and a break at a row's end begins a line of that row
    owner = np.concatenate([np.arange(n_rows), np.searchsorted(offsets, breaks, "right") - 1])
    at = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((at, owner))
    line_start, line_row = at[order], owner[order]
    last_of_row = np.ones(len(line_start), dtype=bool)
    last_of_row[:-1] = line_row[1:] != line_row[:-1]
    line_end = np.where(last_of_row, offsets[line_row + 1], np.concatenate([line_start[1:], offsets[-1:]]) - 1)

    line_first, line_last = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    n = line_last - line_first
    full = np.flatnonzero(n > 0)
    s, e, n, row_of = line_start[full], line_end[full], n[full], line_row[full]
    a, b = line_first[full], line_last[full]
    in_words = _sums(word_chars)
    line_chars = in_words[b] - in_words[a]
    close = ends[b - 1]
    closed = _IS_CLOSING[data[close - 1]]
    for mark in _WIDE_CLOSING:
        fits = close - s >= len(mark)
        for k, byte in enumerate(reversed(mark)):
            fits[fits] = data[close[fits] - 1 - k] == byte
        closed = closed | fits
    punctuation = (~closed & (n < rules.open_words)) | (100 * _between(symbols, s, e) > rules.symbol_percent * line_chars) | (_between(calls, s, e) > n)
    links = _sums(_IS_SEPARATOR[data[starts]] & (ends - starts == 1))
    between = _between(links, a, b)
    navigation = (between >= 2) & (rules.link_words * between >= n)
    said = np.array([m.start() for m in _NOTICE.finditer(LOWER[data].tobytes())], np.int64)
    notice = (np.searchsorted(said, e) > np.searchsorted(said, s)) & (n < rules.notice_words)
    nth = _nth(row_of, span_hashes(data, s, e))
    boilerplate = notice | (nth >= rules.same_lines - 1)
    failed = punctuation | navigation | boilerplate

    per_row = lambda flags: np.bincount(row_of, weights=flags, minlength=n_rows).astype(np.int64)
    per_word = lambda values: np.bincount(row, weights=values, minlength=n_rows).astype(np.int64)
    out = {
        "n_words": np.diff(first).astype(np.int64), "word_chars": per_word(word_chars), "n_symbols": _between(symbols, offsets[:-1], offsets[1:]), "n_dup_lines": per_row(nth > 0),
        "n_repeat_words": per_word(repeats), "n_lines": per_row(np.ones(len(full))), "n_punctuation": per_row(punctuation), "n_navigation": per_row(navigation), "n_boilerplate": per_row(boilerplate),
        "lost_chars": per_row(np.where(failed, line_chars, 0)),
    }
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["lost_chars"] <= rules.max_lost_percent * out["word_chars"])
    return out, s[~failed], e[~failed], row_of[~failed]


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = RULES, with_text: bool = True) -> DataFrame:
    """SCHEMA's columns, one row per input row, without a shuffle; `cleaned` has the lines that stay (NULL unless with_text).

    Lines are parted by \\n, words are `[^\\x20\\x09-\\x0D]+`. A line with a word fails by
    - punctuation: no closing mark at the end of fewer than `open_words` words; symbols over `symbol_percent` of the code
      points in words; more ! and ? than words;
    - navigation: two words or more that are a separator alone, one for `link_words` words at least;
    - boilerplate: one of the phrases in a line of fewer than `notice_words` words, or a line that the text has had
      `same_lines` - 1 times before, byte by byte.
    A document goes if its failing lines hold more than `max_lost_percent` of the code points in its words, or by the whole
    text: under `min_words` words, or over `max_repeat_percent` of them in windows of `window` words found twice or more.

    NULL and empty texts, and those without a word, have 0 everywhere and go. NULL ids stay NULL, repeated rows give equal
    rows (no order is used, so nothing can tie), an empty table gives an empty one, other columns are not read. A text of any
    length is judged whole, in one task. Windows and lines are told by 64-bit hashes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("line_rules")
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                found, s, e, owner = judge(data, offsets, rules)
                if with_text:
                    raw, kept = data.tobytes(), [[] for _ in range(len(part))]
                    for i, a, b in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True):
                        kept[i].append(raw[a:b])
                    cleaned = pa.array([b"\n".join(x).decode("utf-8", "replace") for x in kept], pa.string())
                else:
                    cleaned = pa.nulls(len(part), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, found.values()), cleaned], names=["id", *found, "cleaned"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(rows, SCHEMA)


def op13_line_rules(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("cleaned").withColumnRenamed("id", "doc_id")


_SAID = "|".join(BOILERPLATE)

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM p
), twice AS (
  SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), v AS (
  SELECT doc_id, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l
), q AS (
  SELECT doc_id, line, len(w) AS n, length(array_to_string(w, '')) AS chars, right(w[-1], 1) AS mark, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^!?]', '', 'g')) AS calls,
    len(list_filter(w, lambda y: y IN ('|', '>', '/', '-', '*'))) AS links,
    regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SAID}') AS said
  FROM v WHERE len(w) > 0
), f AS (
  SELECT *, (position(mark IN '.!?:;"'')…”»。！？') = 0 AND n < 8) OR 100 * symbols > 10 * chars OR calls > n AS punctuation,
    links >= 2 AND 3 * links >= n AS navigation, (said AND n < 30) OR nth >= 3 AS boilerplate FROM q
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (punctuation) AS n_punctuation, count(*) FILTER (navigation) AS n_navigation,
    count(*) FILTER (boilerplate) AS n_boilerplate, sum(chars) FILTER (punctuation OR navigation OR boilerplate) AS lost_chars FROM f GROUP BY doc_id
), r AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_punctuation, 0)::BIGINT AS n_punctuation,
    coalesce(n_navigation, 0)::BIGINT AS n_navigation, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN g USING (doc_id) LEFT JOIN repeats USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r
)
SELECT *, NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept FROM b
"""
