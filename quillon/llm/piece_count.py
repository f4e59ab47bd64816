"""Token counts: count-only Viterbi over the unigram vocabulary matches that an Aho-Corasick automaton enumerates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm._batches import small_batches


UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 600_000
MARK = "▁"


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class PieceCounter:
    """Pieces on the best-scored path through a text, without building it.

    The text is taken as a unigram tokenizer with byte fallback takes it: spaces become a mark and one mark is put in
    front; the path with the largest sum of scores wins. Ties go as in the tokenizers library: at each end the candidate
    with the smallest start stays, since a later one must be strictly better. A character no piece covers alone may be
    passed as unknown, scored the smallest score less UNKNOWN_PENALTY, and counts its UTF-8 bytes.

    Best paths need not be searched across marks when no piece holds a mark after another character: every path
    then passes the start of each run of marks, so counts add up by word and are remembered by word. That needs sums
    of scores without rounding; scores that aren't whole numbers, or pieces across marks, make it take whole texts.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.by_word = all(MARK not in p.lstrip(MARK) and s == int(s) for p, s in pieces)
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Pieces of the best path over text, whose spaces are marks already."""
        n = len(text)
        best, count = [-inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.singles.issuperset(text):
            # matches come by their ends, longest first at each: a start is settled before it is used, and strictly better wins
            for last, (size, score) in self.automaton.iter(text):
                s = best[last + 1 - size] + score
                if s > best[last + 1]:
                    best[last + 1], count[last + 1] = s, count[last + 1 - size] + 1
            return count[n]
        done = 0  # ends up to here are settled, the way over an unknown character included

        def settle(upto: int) -> None:
            for e in range(done, upto):
                if text[e] not in self.singles and best[e] + self.unknown > best[e + 1]:
                    best[e + 1], count[e + 1] = best[e] + self.unknown, count[e] + len(text[e].encode())

        for last, (size, score) in self.automaton.iter(text):
            if last > done:
                settle(last)
                done = last
            s = best[last + 1 - size] + score
            if s > best[last + 1]:
                best[last + 1], count[last + 1] = s, count[last + 1 - size] + 1
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.viterbi(MARK + text.replace(" ", MARK))
        # a mark in the text is a space to the tokenizer
        words = text.replace(MARK, " ").split(" ")
        known, total, blanks = self.known, 0, 0
        if "" not in words:
            if new := [w for w in {*words} if w not in known]:
                if len(known) > CACHED_WORDS:
                    known.clear()
                    new = list({*words})
                for w in new:
                    known[w] = self.viterbi(MARK + w)
            return sum(map(known.__getitem__, words))
        for i, w in enumerate(words):
            if not w and i < len(words) - 1:
                blanks += 1
            else:  # a run of marks belongs to the word after it
                run = MARK * (blanks + 1) + w
                total += self._learn(run, run if blanks or not w else w)
                blanks = 0
        return total

    def _learn(self, run: str, key: str) -> int:
        if (n := self.known.get(key)) is None:
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            n = self.known[key] = self.viterbi(run)
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(read_pieces(path))


def count_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces) of every whole text by the vocabulary and scores of a sentencepiece model file taken as a unigram model.

    One row per input row, without a shuffle: repeated rows give equal rows, NULL and empty texts 0 pieces, NULL ids stay
    NULL, an empty table gives an empty one; other columns are not read. Each worker remembers counts of up to
    CACHED_WORDS words, then starts anew; that changes the time alone.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.count(t.as_py() or "") for t in batch.column(1)], pa.int64())], names=["id", "n_pieces"])

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(rows, "id bigint, n_pieces bigint")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_piece_counts(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return count_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model()).withColumnRenamed("id", "doc_id")
