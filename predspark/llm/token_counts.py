"""Token counts by a count-only Viterbi pass over a unigram vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

#: What an unknown character costs below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
REMEMBERED = 500_000
_runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class UnigramCounter:
    """Counts the pieces of the best segmentation of a text over the scored vocabulary of a sentencepiece model.

    The vocabulary's scores are used as unigram log probabilities, whatever the file's own algorithm.  Ties: pieces are
    tried by rising start and replace what stands only when strictly better, so of equal paths the one whose last piece
    is longest wins.  A character that no single piece covers may also be unknown, at the least score minus a
    penalty; it counts as its UTF-8 bytes where the model falls back to bytes, else one for each run of unknowns."""

    def __init__(self, path: str) -> None:
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {m.id_to_piece(i): m.get_score(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.by_bytes = any(m.is_byte(i) for i in range(m.vocab_size()))
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p in pieces if len(p) == 1}
        # segments can be solved apart only if no piece goes on over a mark
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best path through s; carries only the best score and its count for each end."""
        n, low = len(s), float("-inf")
        best, count, unknown_end = [low] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(s)
        end, found = -1, []
        pending = next(matches, None)
        for e in range(n):
            found = []
            while pending is not None and pending[0] == e:
                found.append(pending[1])
                pending = next(matches, None)
            found.sort(key=lambda x: -x[0])  # by rising start
            top, pieces, was = low, 0, False
            for length, score in found:
                if (c := best[e + 1 - length] + score) > top:
                    top, pieces, was = c, count[e + 1 - length] + 1, False
            if s[e] not in self.singles and (c := best[e] + self.unknown) > top:
                add = len(s[e].encode("utf-8", "surrogatepass")) if self.by_bytes else int(not unknown_end[e])
                top, pieces, was = c, count[e] + add, True
            best[e + 1], count[e + 1], unknown_end[e + 1] = top, pieces, was
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        text = self.model.normalize(text)
        if not self.apart:
            return self.viterbi(text)
        if MARK + MARK in text:
            segments = _runs.findall(text)
        else:
            first, *rest = text.split(MARK)
            segments = [*([first] if first else ()), *[MARK + x for x in rest]]
        known, total, score = self.known, 0, 0.0
        for s in segments:
            if (got := known.get(s)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[s] = got = self.viterbi(s)
            total += got[0]
            score += got[1]
        return total, score


_loaded: dict[str, UnigramCounter] = {}


def loaded(path: str) -> UnigramCounter:
    if path not in _loaded:
        _loaded[path] = UnigramCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score (of the best segmentation) of every text.  No ids are made and nothing is shuffled.

    Defined cases: a null or empty text counts 0 at score 0; null and repeated doc_ids and repeated rows are counted
    each; an empty table gives an empty result; other columns are ignored.  The model file must be readable on every
    executor."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(model_path)
        for batch in batches:
            got = [counter.count(t) if t else (0, 0.0) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")
