"""License scans: pigeonhole seeds locate candidates of short notices, bounded-error regular expressions verify them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm._batches import PLAIN_WORD, small_batches


@dataclass(frozen=True)
class Notice:
    """A short notice in lower-case words; `errors` edits at most, none of them in words of under four letters; base: exact places count."""

    label: str
    phrase: str
    errors: int
    base: bool = False


# The notices searched for.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("mit", "permission is hereby granted free of charge", 3),
    Notice("apache", "licensed under the apache license", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc", "creative commons attribution", 2),
)

SCHEMA = "id bigint, n_words bigint, spans array<struct<label: string, base: boolean, word: bigint, words: int, errors: int, similarity: double, text: string>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("words", pa.int32()), ("errors", pa.int32()), ("similarity", pa.float64()), ("text", pa.string())]))

_PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if PLAIN_WORD[b] else 32 for b in range(256))


class NoticeScanner:
    """Finds notices in texts reduced to words with one space between."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            # `errors` edits leave one of errors + 1 pieces untouched
            cuts = np.linspace(0, len(notice.phrase), notice.errors + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at.setdefault(notice.phrase[a:b], []).append((n, int(a)))
        for seed, places in at.items():
            self.seeds.add_word(seed, (len(seed), tuple(places)))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{self._fuzzy(x)}){{e<={x.errors}}}(?![^ ])") for x in notices]

    @staticmethod
    def _fuzzy(notice: Notice) -> str:
        return regex.escape(notice.phrase, special_only=True)

    @staticmethod
    def _short_words_kept(notice: Notice, found: str) -> bool:
        have = found.split(" ")
        return all(w in have for w in notice.phrase.split(" ") if len(w) < 4)

    def spans(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) in `plain`, sorted; of fuzzy spans of a notice that overlap, and of those over an exact one, one stays."""
        exact: set[tuple[int, int]] = set()
        maybe: set[tuple[int, int]] = set()
        n_chars = len(plain)
        for last, (size, places) in self.seeds.iter(plain):
            for n, offset in places:
                start, phrase = last + 1 - size - offset, self.notices[n].phrase
                end = start + len(phrase)
                if start >= 0 and plain.startswith(phrase, start) and (not start or plain[start - 1] == " ") and (end == n_chars or plain[end] == " "):
                    exact.add((n, start))
                else:
                    maybe.add((n, start))
        out = [(n, s, s + len(self.notices[n].phrase), 0) for n, s in exact]
        taken: dict[int, list[tuple[int, int]]] = {}
        for n, s, e, _ in sorted(out):
            taken.setdefault(n, []).append((s, e))
        for n, start in sorted(maybe):
            notice, own = self.notices[n], taken.setdefault(n, [])
            k, size = notice.errors, len(notice.phrase)
            # one character more on either side shows whether a word ends there
            a, b = max(0, start - k - 1), min(n_chars, start + size + k + 1)
            near = own if len(own) < 8 else own[-8:] + [x for x in own if x[0] < b and x[1] > a]
            if any(s < start + size and e > start for s, e in near):
                continue
            # no letter can be inserted where a search starts, so that a space must stand in front of the text
            lead = 1 if a == 0 else 0
            m = self.patterns[n].search(" " * lead + plain[a:b])
            if m and (lead or m.start() > 0) and (b == n_chars or m.end() < lead + b - a) and self._short_words_kept(notice, m[0]):
                span = (max(0, a - lead + m.start()), a - lead + m.end())  # that space may stand for a letter left out
                out.append((n, *span, sum(m.fuzzy_counts)))
                own.append(span)
        return sorted(out, key=lambda x: (x[1], x[0]))

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        """(words, spans as SCHEMA has them) of a text in UTF-8."""
        words = text.translate(_PLAIN).split()
        plain = b" ".join(words).decode("utf-8", "replace")
        out, at, word = [], 0, 0
        for n, s, e, errors in self.spans(plain):
            word += plain.count(" ", at, s)
            at = s
            notice = self.notices[n]
            out.append({"label": notice.label, "base": notice.base and not errors, "word": word, "words": plain.count(" ", s, e) + 1, "errors": errors, "similarity": 1 - errors / len(notice.phrase), "text": plain[s:e]})
        return len(words), out


@lru_cache(maxsize=4)
def _scanner(notices: tuple[Notice, ...]) -> NoticeScanner:
    return NoticeScanner(notices)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(id, n_words, spans): every whole text's words, and the notices in it with their first word, size and edits.

    Words are runs of ASCII letters and digits and of characters from U+0080 on, with A-Z in lower case. One row per input
    row, without a shuffle: NULL and empty texts have 0 words and no spans, NULL ids stay NULL, repeated rows give equal
    rows, an empty table gives an empty one; other columns are not read. Every exact place of a notice is a span with 0
    errors, overlapping ones too; inexact spans of one notice don't overlap.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(notices)
        for batch in batches:
            found = [scanner.scan(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], _SPANS)], names=["id", "n_words", "spans"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(rows, SCHEMA)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    base = "filter(spans, s -> s.base)"
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr(
        "id AS doc_id", "n_words", f"CAST(size({base}) AS BIGINT) AS n_base",
        f"array_min(transform({base}, s -> s.word)) AS first_word", f"array_max(transform({base}, s -> s.word)) AS last_word",
        f"array_join(array_sort(array_distinct(transform({base}, s -> s.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(transform(spans, s -> s.label))), ',') AS labels",
        "coalesce(array_max(transform(spans, s -> s.similarity)), 0D) AS score",
    )
