"""Greedy word-piece lengths by a longest-match automaton.

The vocabulary is a trie; a node that cannot read the next character hands over, by its
failure link, to the node that stands for what is left after the greedy pieces are popped,
and only the number of popped pieces is kept.  A word is read once, in time linear in its
length, and no piece is ever built.

Words are ``[^\\x20\\x09-\\x0D]+``.  A word starts with the mark (``\\u2581``), which only
pieces at its start have.  A word that the pieces cannot cover counts as one unknown piece.
Null and empty texts have no words and no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.words import slices

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words that one worker remembers; beyond it the memo starts anew.
MEMO_WORDS = 400_000

_UNKNOWN = 1 << 40  # a memo entry holds pieces in the low bits and unknown words above


class Automaton:
    """Trie of initial pieces (with the mark) and of continuing pieces, with failure links."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        self.start, self.inner = 0, 1
        final = [False, False]
        for piece in pieces:
            node = self.start if piece.startswith(MARK) else self.inner
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    final.append(False)
                node = self.children[node][c]
            final[node] = final[node] or bool(piece)
        n = len(self.children)
        self.fail: list[int] = [-1] * n
        self.popped: list[int] = [0] * n
        queue = deque([self.inner, self.start])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = self.inner, 1
                else:
                    z, count = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.children[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.children[z][c], count
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of one word (without the mark), or -1 if they cannot cover it."""
        children, fail, popped = self.children, self.fail, self.popped
        node, total = self.start, 0
        for c in MARK + word:
            while c not in children[node]:
                if fail[node] < 0:
                    return -1
                total += popped[node]
                node = fail[node]
            node = children[node][c]
        while node != self.inner:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total


def read_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentence-piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        pieces = self.automaton.count(word.decode())
        value = pieces if pieces >= 0 else _UNKNOWN + 1
        if len(word) <= 64:
            self[word] = value
        return value


@lru_cache(maxsize=2)
def _memo(path: str) -> _Memo:
    return _Memo(Automaton(read_pieces(path)))


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_pieces``, ``n_unknown`` (all long), a row for each row of ``docs``.

    Unknown words count as one piece each.  Repeated rows stay; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(vocabulary)
        for batch in slices(batches):
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            sums = [sum(map(memo.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([s % _UNKNOWN for s in sums], pa.int64()), pa.array([s // _UNKNOWN for s in sums], pa.int64())],
                names=["doc_id", "n_words", "n_pieces", "n_unknown"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")
