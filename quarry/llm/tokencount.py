"""Token counts under a unigram vocabulary: a Viterbi pass that carries counts, not pieces.

White space is folded into one mark (``▁``) before each word, and words are segmented one by one.  An
Aho-Corasick automaton over the vocabulary lists all pieces that occur in a word; dynamic programming keeps,
per position, the best score and how many pieces reach it, and nothing else, for the positions that a piece can reach.  Ties are decided as the
tokenizers library decides them: starts are taken from the left, a piece replaces what ends at its end only
if its score is strictly better, and where no piece of one character starts, an unknown character with the
lowest score less 10 does.  Runs of unknown characters fall apart into their bytes if the vocabulary has all
byte pieces, else they count as one.

The vocabulary's files give scores by rank, so equal words cost the same everywhere; counts of words are
kept in a bounded memo.  Null and empty texts and texts of white space alone count 0.  Very long texts and words are
counted whole in constant memory besides the text.  Repeated rows are counted each, empty tables give empty results,
and further columns stay, whatever their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, MEMO, UNKNOWN_PENALTY = "▁", 400_000, 10.0


def load_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """((piece, score) by id, id of the unknown piece) of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int):
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.bad = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.memo: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of one marked word.  Only the last ``longest`` places are kept, so long words take no more memory."""
        size = self.longest + 1
        best, count, run = [0.0] * size, [0] * size, [0] * size  # run: whether an unknown character ends here
        matches = self.auto.iter(text)
        match = next(matches, None)
        for end in range(1, len(text) + 1):
            found = []
            while match is not None and match[0] == end - 1:
                found.append(match[1])
                match = next(matches, None)
            top, n, unknown, single = None, 0, 0, False
            for length, score in sorted(found, reverse=True):  # starts from the left
                i = (end - length) % size
                single |= length == 1
                if top is None or best[i] + score > top:
                    top, n = best[i] + score, count[i] + 1
            if not single:
                i = (end - 1) % size
                if top is None or best[i] + self.bad > top:
                    width = len(text[end - 1].encode("utf-8", "replace"))
                    top, n, unknown = best[i] + self.bad, count[i] + (width if self.bytes else (0 if run[i] else 1)), 1
            i = end % size
            best[i], count[i], run[i] = top, n, unknown
        return count[len(text) % size]

    def count(self, text: str | None) -> int:
        total, memo = 0, self.memo
        for w in (text or "").split():
            c = memo.get(w)
            if c is None:
                c = self.word(MARK + w)
                if len(w) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = c
            total += c
        return total


def count_tokens(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of pieces of every text (replacing a column of that name)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(*load_vocabulary(path))
        for s in batches:
            yield pd.Series([counter.count(t) for t in s], dtype="int64")

    return df.withColumn(name, run(F.col(text)))
