"""Unigram token counts of texts by dynamic programming over a trie of distinct words.

The distinct words of a run of documents are put in a trie; in the order of the
sorted words a walk of the trie keeps the best scores of the prefix it stands on, so
every shared prefix is scored once. ``best[i]`` is the score of the best split of
the first ``i`` characters into pieces of the vocabulary. The count at a word's
terminal node is stored and added up over its occurrences.

A word is a run without ASCII white space, with the vocabulary's word mark before
it. A character outside the vocabulary costs one token per UTF-8 byte. Of splits
with equal scores the one with fewer tokens counts.

Defined results: null and empty texts have no words and no tokens; a word of any
length is scored whole; repeated rows are counted each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenfold.llm.common import text_batches

WORD_MARK = "▁"
BYTE_SCORE = -20.0
RUN_CHARS = 8_000_000


def rank_scores(model_file: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with Zipf's log probabilities of their ranks; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    norm = math.log(sum(1 / (i + 1) for i in range(model.get_piece_size())))
    return {
        model.id_to_piece(i): -math.log(i + 1) - norm for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class PieceScores:
    """A unigram vocabulary by piece, with its longest piece."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)

    def counts(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """(tokens, score) of every word, by one walk of the trie of the sorted words."""
        get, longest = self.scores.get, self.longest
        stored: dict[str, tuple[int, float]] = {}
        path = ""
        best, tokens = [0.0], [0]
        for word in sorted(words):
            marked = WORD_MARK + word
            shared = 0
            for a, b in zip(path, marked):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(marked) + 1):
                char = marked[end - 1]
                # A lone character is a piece, or falls back to bytes.
                lone = get(char)
                size = 1
                if lone is None:
                    size = len(char.encode("utf-8", "surrogatepass"))
                    lone = BYTE_SCORE * size
                top, fewest = best[end - 1] + lone, tokens[end - 1] + size
                for start in range(max(0, end - longest), end - 1):
                    score = get(marked[start:end])
                    if score is not None:
                        total = best[start] + score
                        if total > top or (total == top and tokens[start] + 1 < fewest):
                            top, fewest = total, tokens[start] + 1
                best.append(top)
                tokens.append(fewest)
            path = marked
            stored[word] = (tokens[-1], best[-1])
        return stored


_VOCABULARIES: dict[str, PieceScores] = {}


def vocabulary(model_file: str) -> PieceScores:
    if model_file not in _VOCABULARIES:
        _VOCABULARIES[model_file] = PieceScores(rank_scores(model_file))
    return _VOCABULARIES[model_file]


def space_split(text: str | None) -> list[str]:
    """Words between ASCII white space; a word may hold any other white space."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if text else []


def token_counts(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, score) per row; score is the log probability of the best split.

    The trie of a run of documents lives only in its task and is bounded by the
    run's characters, so nothing is shuffled or gathered.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run_counts(texts: list[str | None], pieces: PieceScores):
        split = [space_split(t) for t in texts]
        stored = pieces.counts(list(set().union(*split)))
        for words in split:
            found = [stored[w] for w in words]
            yield len(words), sum(n for n, _ in found), math.fsum(s for _, s in found)

    def apply(batches):
        pieces = vocabulary(model_file)
        for batch in batches:
            out, run, size = [], [], 0
            for t in batch.column("t"):
                run.append(t.as_py())
                size += len(run[-1] or "")
                if size >= RUN_CHARS:
                    out += run_counts(run, pieces)
                    run, size = [], 0
            out += run_counts(run, pieces)
            n_words, n_tokens, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(score, pa.float64())], names=["k", "n_words", "n_tokens", "score"])

    return text_batches(rows).mapInArrow(apply, f"k {kind}, n_words bigint, n_tokens bigint, score double").withColumnRenamed("k", key)
