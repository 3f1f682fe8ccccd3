"""Token counts by a Viterbi pass that carries best score and piece count only.

An Aho-Corasick automaton over the unigram vocabulary lists all pieces that end at each character. For every
character the best score of a segmentation up to it is kept, with its number of pieces. The rules are those of the
``tokenizers`` library's unigram model: among equal scores the segmentation whose last piece starts first wins,
a character without a piece of its own may stand as unknown at the lowest score less ten, and unknown characters in a row
are one piece.
"""

from __future__ import annotations

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from callharmony.llm.tables import column
from callharmony.llm.words import words_of

# Default vocabulary file; its pieces and scores make up the unigram model.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"  # stands before every word
UNKNOWN_PENALTY = 10.0
# Words a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 400_000, 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """``(piece, score)`` of all ordinary pieces of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary]


class Counter(dict):
    """Maps a word to its number of pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: bytes) -> int:
        count = self.count(MARK + word.decode("utf-8"))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def count(self, text: str) -> int:
        """Pieces of the best segmentation of ``text``.

        No piece is longer than the longest of the vocabulary, so only so many places are kept, in turn.
        """
        size, kept = len(text), self.longest + 1
        scores, counts, unknown = [0.0] * kept, [0] * kept, [False] * kept
        matches = iter(self.automaton.iter(text)) if len(self.automaton) else iter(())
        match = next(matches, None)
        for end in range(1, size + 1):
            ending = []
            while match is not None and match[0] == end - 1:
                ending.append(match[1])
                match = next(matches, None)
            at, best, single, strange = end % kept, None, False, False
            for length, score in sorted(ending, reverse=True):
                single |= length == 1
                total = score + scores[(end - length) % kept]
                if best is None or total > best:
                    best, count = total, counts[(end - length) % kept] + 1
            if not single:
                before = (end - 1) % kept
                total = self.unknown + scores[before]
                if best is None or total > best:
                    best, strange = total, True
                    count = counts[before] + (not unknown[before])
            scores[at], counts[at], unknown[at] = best, count, strange
        return counts[size % kept]


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Counter(vocabulary(path))
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary_path: str = PIECES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, n_words, n_tokens`` of the whole text.

    Words are what ASCII white space parts; each is segmented by itself behind a word mark. Nulls, empty and blank
    texts have none. Rows are handled one by one; other columns play no part.
    """

    @F.arrow_udf("n_words long, n_tokens long")
    def count(texts: pa.Array) -> pa.Array:
        pieces = counter(vocabulary_path)
        words = [words_of(body.as_py()) for body in texts]
        counts = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(pieces.__getitem__, w)) for w in words], pa.int64())]
        return pa.StructArray.from_arrays(counts, names=["n_words", "n_tokens"])

    rows = docs.select(column(docs, doc_id).alias("doc_id"), count(column(docs, text)).alias("counts"))
    return rows.select("doc_id", "counts.*")
