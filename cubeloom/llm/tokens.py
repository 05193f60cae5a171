"""Operator 1: token counts by a count-only Viterbi search.

An Aho-Corasick automaton lists every vocabulary piece that ends at a
position; the dynamic programme keeps, for each position, only the best score
and its number of pieces.  No segmentation is stored.  The rules are those of
the tokenizers library's unigram model: of two equal scores the earlier start
(the longer last piece) wins; a character that no one-character piece covers
costs ten below the lowest score; such characters become their UTF-8 bytes.

The text is cut before each space, and each distinct chunk is searched once
in a worker; the store of known chunks is bounded.

Null and empty texts have no tokens.  Repeated rows are counted each; an empty
table gives no rows; the table's other columns are not read.  A very long text
is searched chunk by chunk, in memory that does not grow with it.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, column_of, kept, only

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks a worker remembers.
KNOWN_CHUNKS = 1 << 20


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score  # of equal pieces the last counts, as in the library
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def search(self, chunk: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation of one chunk."""
        n = len(chunk)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        if self.single.issuperset(chunk):  # every position ends a match
            at, top, pieces = -1, 0.0, 0
            for end, (length, score) in self.automaton.iter(chunk):
                if end != at:
                    best[at + 1], count[at + 1] = top, pieces
                    candidate = best[end + 1 - length] + score
                    at, top, pieces = end, candidate, count[end + 1 - length] + 1
                    continue
                candidate = best[end + 1 - length] + score
                if candidate > top:
                    top, pieces = candidate, count[end + 1 - length] + 1
            return pieces, top
        at, top, pieces = 0, None, 0  # the position whose matches come now, and the best so far
        for end, (length, score) in self.automaton.iter(chunk):  # by end, the longest (earliest start) first
            while at < end:
                self._close(chunk, at, top, pieces, best, count)
                at, top = at + 1, None
            candidate = best[end + 1 - length] + score
            if top is None or candidate > top:
                top, pieces = candidate, count[end + 1 - length] + 1
        while at < n:
            self._close(chunk, at, top, pieces, best, count)
            at, top = at + 1, None
        return count[n], best[n]

    def _close(self, chunk, at, top, pieces, best, count):
        """All matches that end at ``at`` are known: weigh the unknown character last."""
        if chunk[at] not in self.single:
            candidate = best[at] + self.unknown
            if top is None or candidate > top:
                top, pieces = candidate, count[at] + len(chunk[at].encode("utf-8", "surrogatepass"))
        best[at + 1], count[at + 1] = top, pieces

    def lookup(self, chunk: str) -> tuple[int, float]:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) >= KNOWN_CHUNKS:
                self.known.clear()
            found = self.search(chunk)
            if len(chunk) <= 64:
                self.known[chunk] = found
        return found

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and scores of whole texts."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), " ", SPACE)
        empty = np.asarray(pc.binary_length(texts)) == 0
        led = pc.starts_with(texts, SPACE)
        body = pc.if_else(led, pc.utf8_slice_codeunits(texts, 1), texts)
        lists = pc.split_pattern(body.cast(pa.large_string()), SPACE)
        flat = lists.flatten().dictionary_encode()
        found = [self.lookup(SPACE + c) for c in flat.dictionary.to_pylist()]
        codes = np.asarray(flat.indices)
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])
        out = []
        for k, kind in ((0, np.int64), (1, np.float64)):
            each = np.array([f[k] for f in found], dtype=kind)[codes]
            total = np.add.reduceat(each, ends[:-1]) if len(each) else np.zeros(len(texts), kind)
            out.append(np.where(empty, 0, total))
        return out[0], out[1]


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, n_tokens and best_score of every row, in one pass without a shuffle."""

    def run(batches):
        counter = kept(("tokens", model_path), lambda: UnigramCounter(vocabulary(model_path)))
        for part in chunks(batches, text_column):
            n, score = counter.count(column_of(part, text_column))
            yield pa.RecordBatch.from_arrays([column_of(part, id_column), pa.array(n, pa.int64()), pa.array(score.astype(np.float64))], names=[id_column, "n_tokens", "best_score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return only(docs, id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, best_score double")
