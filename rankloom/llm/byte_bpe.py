"""Byte-level BPE: texts to token ids and back.

A text is cut by the public pattern, every piece is encoded on its own: its bytes are
folded by ranked merges (the adjacent pair of lowest rank first, leftmost among equals)
until no pair has a rank.  Decoding concatenates the bytes of the ids.

Two forms of the same fold:

* ``encoded_words``: distinct words as rows; higher-order functions fold the byte array
  of each word over a literal rank map.  A map literal of 50,000 entries is searched
  linearly, so the literal is an array of small maps, addressed by the hash of the pair.
* ``encoded``: whole texts.  Distinct words are folded once per task in a bounded memo.
  Joining distinct words back to all places of all texts would shuffle every piece of the
  corpus twice, which is more than the texts themselves (README has the figures).

Nulls count as empty texts; empty texts have no ids.  Special tokens are never produced.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.words import slices

TOKENIZERS = "/opt/tokenizers"
#: Distinct words that one worker remembers; beyond it the memo starts anew.
MEMO_WORDS = 300_000
#: Small maps of the literal rank map.
RANK_SLOTS = 1 << 14

_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def public_tokenizers(folder: str = TOKENIZERS):
    """The package in ``folder`` (``path(name)``, ``PATTERN``), wherever it is installed."""
    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def folded(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the pair of lowest rank until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _folded_long(parts, ranks)
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        low = min((r for r in pairs if r is not None), default=None)
        if low is None:
            return [ranks[p] for p in parts]
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _folded_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n for very long words: a heap of pairs over a linked list."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p]


class Fold:
    """The merges of many words at once, one merge of every word per step, over flat arrays of ids.

    A pair of ids has the rank of its concatenated bytes; the table holds every cut of every
    piece of the vocabulary into two pieces.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.base = max(ranks.values()) + 1
        cuts = [(ranks[p[:i]] * self.base + ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        made = np.array(sorted(cuts) or [(-1, self.base)], dtype=np.int64)
        self.pairs, self.rank = made[:, 0].copy(), made[:, 1].copy()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair; ``base`` where there is none."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank[at], self.base)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of non-empty words, as little-endian bytes."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        out: list[bytes] = [b""] * len(words)
        open_words = np.arange(len(words))
        # pair[i] is the rank of ids[i] and ids[i + 1], none at the end of a word.
        pair = np.append(self._ranks(ids[:-1], ids[1:]), self.base)
        pair[np.cumsum(sizes) - 1] = self.base
        while len(open_words):
            first = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(pair, first)
            done = low == self.base
            if done.any():
                for w, a, n in zip(open_words[done].tolist(), first[done].tolist(), sizes[done].tolist()):
                    out[w] = ids[a : a + n].astype("<u4").tobytes()
                left = np.repeat(~done, sizes)
                ids, pair = ids[left], pair[left]
                open_words, sizes, low = open_words[~done], sizes[~done], low[~done]
                if not len(open_words):
                    break
                first = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(pair == np.repeat(low, sizes))
            word = np.searchsorted(first, hits, side="right") - 1
            at = hits[np.append(True, word[1:] != word[:-1])]  # the leftmost of every word
            ids[at] = low
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ends = np.zeros(len(ids), dtype=bool)
            ends[first + sizes - 1] = True
            ends[at] |= ends[at + 1]
            ids, pair, ends = ids[keep], pair[keep], ends[keep]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                inner = i[~ends[i]]
                pair[inner] = self._ranks(ids[inner], ids[inner + 1])
                pair[i[ends[i]]] = self.base
            sizes = sizes - 1
        return out


class _Memo(dict):
    """word -> its ids as little-endian bytes, folded when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.fold = Fold(ranks)

    def learn(self, words: set[str]) -> None:
        """Fold what is not known yet of the short ones of ``words`` in one go."""
        if len(self) + len(words) > MEMO_WORDS:
            self.clear()
        new = [w for w in words if w not in self and len(w) <= 64]
        whole = [w.encode() for w in new]
        known = {w: np.array([r], dtype="<u4").tobytes() for w, b in zip(new, whole) if (r := self.ranks.get(b)) is not None}
        self.update(known)
        rest = [(w, b) for w, b in zip(new, whole) if w not in known]
        if rest:
            self.update(zip([w for w, _ in rest], self.fold.words([b for _, b in rest])))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = np.array(folded(word.encode(), self.ranks), dtype="<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _coder(folder: str, name: str):
    import regex

    public = public_tokenizers(folder)
    ranks = read_ranks(public.path(name))
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    # \s of the library that defines the result is Unicode's White_Space.
    pattern = regex.compile(public.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
    return pattern, _Memo(ranks), pieces


def encode_text(text: str, folder: str, name: str) -> np.ndarray:
    pattern, memo, _ = _coder(folder, name)
    return np.frombuffer(b"".join(map(memo.__getitem__, pattern.findall(text))), dtype="<u4")


def encode_texts(texts: list[str], folder: str, name: str) -> list[np.ndarray]:
    """Ids of every text; the new words of all of them are folded together."""
    pattern, memo, _ = _coder(folder, name)
    pieces = [pattern.findall(t) for t in texts]
    memo.learn(set().union(*pieces))
    return [np.frombuffer(b"".join(map(memo.__getitem__, x)), dtype="<u4") for x in pieces]


def decode_ids(ids: np.ndarray, folder: str, name: str) -> bytes:
    pieces = _coder(folder, name)[2]
    return b"".join(map(pieces.__getitem__, ids.tolist()))


def encoded(docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", keep: str = "ids") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens`` and, by ``keep``,

    * ``ids``: ``ids`` (array of int) and ``decoded`` (binary, the text's bytes again),
    * ``digest``: SHA-256 of the ids as little-endian 32-bit integers and of the decoded bytes.

    Repeated rows stay repeated; a null id stays null; other columns are left out.
    """
    digest = keep == "digest"
    schema = _RESULT if digest else "doc_id long, n_tokens long, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches):
                ids = encode_texts([t or "" for t in batch.column("text").to_pylist()], folder, name)
                back = [decode_ids(x, folder, name) for x in ids]
                counts = pa.array([len(x) for x in ids], pa.int64())
                if digest:
                    rest = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
                else:
                    rest = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, *rest], names=[f.split()[0] for f in schema.split(", ")])
        finally:
            # The worker lives on for tasks of other stages, beside which the words would stay.
            _coder(folder, name)[1].clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def rank_literal(ranks: dict[bytes, int], slots: int = RANK_SLOTS) -> Column:
    """The rank map as a literal: an array of maps from the hex of a piece to its rank.

    Slot of a piece: crc32 of its hex, modulo the slots.  Bounded by the vocabulary.
    """
    import json
    import zlib

    table: list[dict[str, int]] = [{} for _ in range(slots)]
    for piece, rank in ranks.items():
        key = piece.hex()
        table[zlib.crc32(key.encode()) % slots][key] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def encoded_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """``word``, ``ids`` (array of int) for a table of distinct words (null: no ids).

    The accumulator holds the pieces of the word (hex) and the rank of every adjacent
    pair; a step joins the leftmost pair of lowest rank, and steps without one do nothing.
    """
    table, slots, none = rank_literal(ranks), RANK_SLOTS, (1 << 31) - 1

    def rank(key: Column) -> Column:
        return F.coalesce(F.element_at(F.element_at(table, (F.pmod(F.crc32(key), F.lit(slots)) + 1).cast("int")), key), F.lit(none))

    def ranked(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))).otherwise(
            F.array().cast("array<int>")
        )

    def step(acc: Column, _: Column) -> Column:
        parts, pairs = acc["parts"], acc["pairs"]
        low = F.array_min(pairs)
        at = F.array_position(pairs, low).cast("int")
        after = F.concat(
            F.slice(parts, F.lit(1), at - 1),
            F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))),
            F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))),
        )
        return F.when(F.coalesce(low, F.lit(none)) == none, acc).otherwise(F.struct(after.alias("parts"), ranked(after).alias("pairs")))

    text_hex = F.lower(F.hex(F.coalesce(F.col(word_col), F.lit("")).cast("binary")))
    bytes_of = F.filter(F.regexp_extract_all(text_hex, F.lit("[0-9a-f]{2}"), F.lit(0)), lambda x: x != "")
    start = F.struct(bytes_of.alias("parts"), ranked(bytes_of).alias("pairs"))
    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(F.coalesce(F.col(word_col), F.lit(""))), F.lit(1)))
    parts = F.aggregate(steps, start, step, lambda acc: acc["parts"])
    return words.select(F.col(word_col).alias("word"), F.transform(parts, rank).alias("ids"))
