"""Token counts by count-only Viterbi over a unigram vocabulary (operator 2).

An Aho-Corasick automaton enumerates the pieces that end at each character; the best path carries
its score and its number of pieces and nothing else.  Of paths of equal score the one whose last
piece starts first stays, as in the usual unigram tokenizers, and scores are added left to right in
double precision as they do.  A character that is no piece costs the least score less ten, and counts
as its UTF-8 bytes if the vocabulary has byte pieces.

The pieces come from a public vocabulary file, whose order of merit becomes Zipf's log probabilities.
No piece has a space after another character and line ends are in none, so a text decouples before
every run of spaces; what lies between is worked out once and remembered.  A vocabulary for which that
does not hold is run over whole texts.

Defined results: a null or empty text has no tokens; repeated rows, and rows without an id, get equal
rows each; a text is counted whole, however long; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words remembered by one Python worker; the memory starts anew beyond it.
CACHE_WORDS = 800_000
#: A run of spaces with the word after it, a word at the beginning of a line, or a line end.
_RUNS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+|\n")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a vocabulary file with log probabilities that fall with their place."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (r + 1) for r in range(len(plain)))
    return [(p, -math.log((r + 1) * total)) for r, p in enumerate(plain)]


class CountingViterbi:
    """Counts the pieces of the best segmentation of a word."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool = True) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        #: Texts decouple only if no piece holds a line end, or a space behind something else.
        self.splits = not any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in pieces)
        self.known: dict[str, int] = {}

    @staticmethod
    @lru_cache(maxsize=2)
    def cached(path: str) -> CountingViterbi:
        return CountingViterbi(unigram_pieces(path))

    def count_word(self, word: str) -> int:
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0
        best, number = -math.inf, 0

        def close(upto: int) -> None:
            # Ends without a piece of one character may be reached by an unknown one; it starts last, so it loses ties.
            nonlocal done, best, number
            while done < upto:
                c = word[done]
                if c not in self.single:
                    s = score[done] + self.unknown
                    if s > best:
                        best, number = s, count[done] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_pieces else 1)
                done += 1
                score[done], count[done] = best, number
                best, number = -math.inf, 0

        for last, (length, piece_score) in self.automaton.iter(word):
            if last > done:
                close(last)
            start = last + 1 - length
            s = score[start] + piece_score
            if s > best:
                best, number = s, count[start] + 1
        close(n)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE_MARK, " ")
        if not text.startswith(" "):
            text = " " + text
        if not self.splits:
            return self.count_word(text.replace(" ", SPACE_MARK))
        if "  " in text or "\0" in text:
            words = _RUNS.findall(text.replace(" ", SPACE_MARK))
        else:
            words = text.replace(" ", "\0" + SPACE_MARK).replace("\n", "\0\n\0").split("\0")
        known = self.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            if len(known) >= CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.count_word(w)
            return sum([known[w] for w in words])


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CountingViterbi.cached(path)
        for batch in batches:
            counts = [model.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for each document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_count(vocabulary or vocabulary_path()), "doc_id long, n_tokens long")


def op2_count_only_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
