"""Token counts under a unigram segmentation, by dynamic programming shared along a trie of pre-tokens.

The best segmentation of a pre-token is a path of pieces with the largest sum of log-probabilities. The
forward score of a prefix depends on the prefix alone, so pre-tokens are put into a trie and each node's
score (and the number of pieces on its best path) is computed when the node is made: once for all the
pre-tokens that share the prefix. Terminal counts are kept by pre-token.

The public vocabulary files hold pieces in the order of their making, without probabilities. The score of
a piece is by rule that of its rank under the Zipf-Mandelbrot law, ``log((1 / (rank + shift)) / sum)``;
nothing is fitted. A character without a piece costs the smallest score less 10 and counts as its UTF-8
bytes (byte fallback). Ties go to the longer last piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tarifa.llm.tokens import tokenizer_path

PIECES = "piece_bpe_32k.model"
#: Begins every pre-token, for the space before it.
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def scored_pieces(model: str, shift: float = 2.7) -> dict[str, float]:
    """Log-probabilities of a sentencepiece model's ordinary pieces by rank; control and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    total = math.log(sum(1 / (r + shift) for r in range(len(pieces))))
    return {piece: -math.log(r + shift) - total for r, piece in enumerate(pieces)}


class PreTokenTrie(dict):
    """Counts by pre-token (bytes); a missing one is put into the trie. Past max_nodes nodes it starts anew."""

    def __init__(self, scores: dict[str, float], max_nodes: int = 600_000):
        super().__init__()
        self.scores, self.max_nodes = scores, max_nodes
        # Beginnings of pieces with the scores of those that are pieces: only these can still grow into one.
        self.begun = {piece[:n]: -math.inf for piece in scores for n in range(1, len(piece))} | scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self._restart()

    def _restart(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}  # by node and code point
        self.best, self.pieces = [0.0], [0]
        self.open: list[tuple] = [()]  # by node: where in the prefix the beginnings of pieces that end with it begin

    def __missing__(self, word: bytes) -> int:
        if len(self.best) > self.max_nodes:
            self._restart()
        text = MARK + word.decode("utf-8", "surrogatepass")
        child, best, pieces, opened, begun = self.child, self.best, self.pieces, self.open, self.begun
        path, at = [0], 0
        for end, ch in enumerate(text, 1):
            key = at << 21 | ord(ch)
            node = child.get(key)
            if node is None:
                score, count, still = -math.inf, 0, []
                for begin in (*opened[at], end - 1):
                    s = begun.get(text[begin:end])
                    if s is not None:
                        still.append(begin)
                        s += best[path[begin]]
                        if s > score:
                            score, count = s, pieces[path[begin]] + 1
                if ch not in self.scores and best[at] + self.unknown > score:
                    score, count = best[at] + self.unknown, pieces[at] + len(ch.encode("utf-8", "surrogatepass"))
                node = child[key] = len(best)
                best.append(score)
                pieces.append(count)
                opened.append(tuple(still))
            path.append(node)
            at = node
        self[word] = pieces[path[-1]]
        return self[word]


_tries: dict[tuple, PreTokenTrie] = {}


def token_counts(docs: DataFrame, model: str | None = None, shift: float = 2.7, max_nodes: int = 600_000) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every whole text of docs (doc_id, text), without a shuffle.

    Pre-tokens are the runs without ASCII white space. Null and empty texts count 0; a null doc_id is kept;
    repeated rows give a row each; an empty table gives none; other columns are ignored. A worker holds one
    trie of at most max_nodes nodes (and a word's) whatever the input. model is a file every machine has.
    """
    path = model or tokenizer_path(PIECES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, shift, max_nodes)
        if key not in _tries:
            _tries[key] = PreTokenTrie(scored_pieces(path, shift), max_nodes)
        of = _tries[key].__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(of, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
