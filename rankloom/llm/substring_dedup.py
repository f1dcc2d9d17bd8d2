"""Removal of repeated word sequences by recompression.

Words are symbols.  A round names maximal runs of one symbol, then pairs of neighbours of
which the first is in the left half of the symbols and the second in the right half (a bit
of the symbol's name).  Names are functions of what they stand for, so every task gives
equal sequences equal names, whatever they stand in, except for what may join with the
outside at their two ends.  Dropping exactly that at every round leaves a window's own
interior; its last one is a high-level symbol that all occurrences of the window share: the
window's anchor.

1. Consecutive windows with one anchor form a stretch.  Every task names its stretches:
   (anchor, sequence, place).  Only anchors that occur twice can lie in a repeat.
2. If all stretches of an anchor are the same sequence, every window in them is repeated.
3. Otherwise stretches that occur several times are repeated as a whole; the windows of the
   others, and of one copy of each repeated one, are compared by 128-bit names (anchor and
   sequence).
4. Repeated windows are gathered per document and their words removed.

A sequence found in a third of all documents is one row per task before it is shuffled.
Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.staging import discarded, stored
from rankloom.llm.words import Words, chained, find_words, mixed, slices

#: Rounds, and those that name runs (the others name pairs).
ROUNDS, RUN_TURNS = 6, (0,)
_SEED, _SEQUENCE_SEED = 101, 202
_RUN, _RANK = np.uint64(0x5555555555555555), np.uint64(77)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(n, base, dtype=np.uint64), out=out[1:])
    return out


class Sequences:
    """Names of any word sequence of a slice in constant time (polynomial over a second word name)."""

    def __init__(self, words: Words):
        n = len(words.starts)
        second = words.names(_SEQUENCE_SEED)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(second * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(_INVERSE, n)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of a slice, and for each the name and the first word of its anchor.

    A window stops at the last level that leaves something of its interior; the symbol of
    most words is its anchor, then the one with the smallest mixed name, the first among equals.
    """
    many = np.maximum(np.diff(words.first) - size + 1, 0)
    starts = np.arange(int(many.sum())) + np.repeat(words.first[:-1] - (np.cumsum(many) - many), many)
    anchor, place = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    names, doc, begin = words.names(_SEED), words.doc, np.arange(len(words.starts) + 1)
    live, left, right = np.arange(len(starts)), starts, starts + size
    for turn in range(ROUNDS):
        if not len(live):
            break
        if turn in RUN_TURNS:
            head = np.ones(len(names), dtype=bool)
            head[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
            group, at = np.cumsum(head) - 1, np.flatnonzero(head)
            count = np.diff(np.append(at, len(names))).astype(np.uint64)
            fresh = np.where(count > 1, chained(names[at] ^ _RUN, count), names[at])
            # A run at an end of the interior may go on outside.
            left_next, right_next = group[left] + 1, group[right - 1]
        else:
            second = (mixed(names + np.uint64(turn)) >> np.uint64(63)).astype(bool)
            joins = np.zeros(len(names), dtype=bool)
            joins[1:] = second[1:] & ~second[:-1] & (doc[1:] == doc[:-1])
            group, at = np.cumsum(~joins) - 1, np.flatnonzero(~joins)
            fresh = names[at]
            pair = np.flatnonzero(joins)
            fresh[group[pair]] = chained(names[pair - 1], names[pair])
            # A second symbol at the left end, or a first one at the right end, may join the outside.
            left_next = left + second[left]
            right_next = right - ~second[right - 1]
            some = left_next < right_next
            left_next = np.where(some, group[np.minimum(left_next, len(names) - 1)], 0)
            right_next = np.where(some, group[right_next - 1] + 1, 0)
        stops = right_next <= left_next
        if turn == ROUNDS - 1:
            stops[:] = True
        done = np.flatnonzero(stops)
        spans = np.minimum(np.diff(begin), 63).astype(np.uint64)
        rank = (np.uint64(63) - spans) << np.uint64(58) | mixed(names + _RANK) >> np.uint64(6)
        where = _smallest(rank, left[done], right[done])
        anchor[live[done]], place[live[done]] = names[where], begin[where]
        goes = ~stops
        live, left, right = live[goes], left_next[goes], right_next[goes]
        names, doc, begin = fresh, doc[at], np.append(begin[at], begin[-1])
    return starts, anchor, place


def _smallest(rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of the smallest rank in every [left, right), the first among equals."""
    where, least = left.copy(), rank[left]
    open_, k = np.flatnonzero(right - left > 1), 1
    while len(open_):
        at = left[open_] + k
        better = rank[at] < least[open_]
        least[open_[better]], where[open_[better]] = rank[at[better]], at[better]
        k += 1
        open_ = open_[right[open_] - left[open_] > k]
    return where


def stretches(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, sequence, first window, windows, times) of the maximal rows of windows with one anchor.

    Neighbouring stretches that are equal, as inside a long run of one word, are one row with
    the number of ``times``.
    """
    starts, anchor, place = anchors(words, size)
    if not len(starts):
        return anchor, anchor, starts, starts, starts
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (place[1:] != place[:-1]) | (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    at = np.flatnonzero(head)
    many = np.diff(np.append(at, len(starts)))
    first = starts[at]
    sequence = chained(Sequences(words).names(first, first + many + size - 1), (place[at] - first).astype(np.uint64))
    anchor = anchor[at]
    fresh = np.ones(len(first), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (sequence[1:] != sequence[:-1]) | (first[1:] != first[:-1] + many[:-1])
    rows = np.flatnonzero(fresh)
    return anchor[rows], sequence[rows], first[rows], np.add.reduceat(many, rows), np.diff(np.append(rows, len(first)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and ``k``, the name of the text: equal texts share it and have equal results."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("k", F.unhex(F.md5("text")))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def stretch_rows(rows: DataFrame, size: int) -> DataFrame:
    """``k``, ``anchor``, ``sequence``, ``at`` (first window of the text's windows), ``many``, ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = find_words(batch.column("text"))
            anchor, sequence, first, many, times = stretches(words, size)
            doc = words.doc[first] if len(first) else first
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").take(pa.array(doc, pa.int64())), _signed(anchor), _signed(sequence), pa.array(first - words.first[doc], pa.int32()), pa.array(many, pa.int32()), pa.array(times, pa.int32())],
                names=["k", "anchor", "sequence", "at", "many", "times"],
            )

    return rows.select("text", "k").mapInArrow(run, "k binary, anchor long, sequence long, at int, many int, times int")


def window_rows(texts: DataFrame, size: int) -> DataFrame:
    """Windows of the listed stretches: ``anchor``, ``name``, ``place`` (64-bit name of text and position);
    with ``k`` and ``at`` if the stretch is ``open``, that is not known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = find_words(batch.column("text"))
            names = Sequences(words)
            listed = batch.column("listed")
            lengths = np.diff(np.asarray(listed.offsets))
            flat = listed.flatten()
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            at, many = (np.asarray(flat.field(f), dtype=np.int64) for f in ("at", "many"))
            which = np.repeat(np.arange(len(at)), many)
            begin = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            start = words.first[doc[which]] + begin
            is_open = np.asarray(flat.field("open").cast(pa.int8()), dtype=np.int8)[which].astype(bool)
            text_name = np.asarray(batch.column("k_name"), dtype=np.int64).view(np.uint64)[doc[which]]
            keys = batch.column("k").take(pa.array(np.where(is_open, doc[which], 0), pa.int64(), mask=~is_open))
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("anchor").take(pa.array(which, pa.int64())),
                    _signed(names.names(start, start + size)),
                    _signed(chained(text_name, begin.astype(np.uint64))),
                    keys,
                    pa.array(begin.astype(np.int32), pa.int32(), mask=~is_open),
                ],
                names=["anchor", "name", "place", "k", "at"],
            )

    columns = texts.select("text", "k", F.xxhash64("k").alias("k_name"), "listed")
    return columns.mapInArrow(run, "anchor long, name long, place long, k binary, at int")


def repeated(rows: DataFrame, size: int) -> DataFrame:
    """``k``, ``spans`` (array of at, many): windows of each text whose word sequence also starts elsewhere."""
    found = stored(stretch_rows(rows, size), "substring-stretches")
    anchor_counts = found.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    shared = stored(anchor_counts.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("same")), "substring-anchors")
    known = stored(found.join(shared, "anchor"), "substring-shared")
    discarded(found, shared)

    mixed_up = known.where("not same")
    place = F.struct("k", "at", "many")
    sequences = mixed_up.groupBy("anchor", "sequence").agg(F.sum("times").alias("n"), F.min(place).alias("one"))
    sequences = stored(sequences.select("anchor", "sequence", (F.col("n") == 1).alias("open"), "one"), "substring-sequences")
    whole = known.where("same").select("k", "at", "many").union(
        mixed_up.join(sequences.where("not open").select("anchor", "sequence"), ["anchor", "sequence"]).select("k", "at", "many")
    )
    whole = stored(whole.distinct(), "substring-whole")
    discarded(known)

    lists = sequences.groupBy("one.k").agg(F.collect_list(F.struct("anchor", "one.at", "one.many", "open")).alias("listed"))
    lists = stored(lists, "substring-lists")
    discarded(sequences)
    windows = stored(window_rows(rows.select("text", "k").join(lists.hint("shuffle_hash"), "k"), size), "substring-windows")
    # Equal texts list the same places; a window is repeated if two different places have it.
    places = windows.groupBy("anchor", "name").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").select("anchor", "name")
    places = stored(places, "substring-places")
    single = windows.where("k is not null").join(places, ["anchor", "name"]).select("k", "at", F.lit(1).alias("many")).distinct()
    out = stored(whole.union(single).groupBy("k").agg(F.collect_list(F.struct("at", "many")).alias("spans")), "substring-spans")
    discarded(whole, lists, windows, places)
    return out


def _kept(docs: DataFrame, size: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    spans = repeated(rows, size)
    last = "kept_sha256 string" if digest else "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, removed, results = [], [], []
            for text, listed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                totals.append(len(words))
                if listed:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.array([s["at"] for s in listed])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array([s["many"] for s in listed]) + size - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                removed.append(totals[-1] - len(words))
                out = b" ".join(words)
                results.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(results, pa.string())], names=["doc_id", "n_words", "n_removed", last.split()[0]])

    both = rows.join(spans.hint("shuffle_hash"), "k", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last}")


def deduplicated(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``text`` (kept words joined by one blank).

    Null and empty texts have no words.  A repeated row repeats its text, so nothing of it
    stays if it has ``size`` words.  Null ids stay null.  Other columns are not read.
    """
    return _kept(docs, size, id_col, text_col, digest=False)


def digest(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with ``kept_sha256`` in place of the text."""
    return _kept(docs, size, id_col, text_col, digest=True)
