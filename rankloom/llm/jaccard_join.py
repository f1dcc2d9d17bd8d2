"""Exact Jaccard self-join on word shingles with a token-group matrix.

1. A document is its set of five-word shingles, named by 64-bit hashes.  Documents with
   equal sets are one class.
2. Similar classes are grouped: a class is assigned to the most popular of its eight
   smallest-hash shingles, whose hub is what most of the others resemble.  Classes at the
   threshold with their hub form one connected group, in which no pair is needed any more,
   however large it is; the hub's other classes form groups of at most ``BLOCK``; all other
   classes are groups of their own.
3. The matrix holds which groups have which shingle, for the shingles of each class's
   prefix: the ``n - ceil(0.8 n) + 1`` shingles that come first when rare ones lead.  Two
   sets at the threshold always share one of these.  Rarity is taken from counters of fixed
   size; any order gives right results, this one keeps widely copied passages last.
4. Groups that share a matrix entry are candidates.  They meet in cells of two blocks of
   members.  The shingle counts of the members (by hash bin) bound each overlap from above,
   for a query against a block's union first, then for each member; only members with a
   possible partner in the cell are opened.
5. A cell with its sets joins what is linked at once: closest pairs first, and a pair is
   compared only while its ends are still apart, so that a cell returns fewer links than it
   has members, however many of its pairs are similar.  All links are contracted to components.

A shingle found in a third of all documents is one matrix row per group.  Sets travel only
for members that are opened, selected by a bit filter of fixed size (false hits are dropped
by the join that follows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import staging
from rankloom.llm.components import components
from rankloom.llm.staging import discarded
from rankloom.llm.words import Words, chained, find_words, mixed, slices

SHINGLE = 5
HASHES = 8
#: Bins of a set's histogram (one byte each); the difference of two histograms bounds the overlap.
BIN_BITS = 9
#: Counters that rank shingles by rarity, in slices of one row each; bits of the filter.
COUNTERS, SLICE = 1 << 21, 1 << 11
FILTER_BITS = 1 << 24
#: Members of a group that are looked at together, and their shingles (8 MB of sets).
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
#: What a Python worker gets at once, in bytes, and looks at together: bytes of texts, rows with histograms or sets.
BATCH_BYTES, TEXT_BYTES, ROWS = 4 << 20, 1 << 20, 512
_SEED = 11


def shingle_names(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle names of every row; a shorter text is one shingle, no word is none."""
    names = words.names(_SEED)
    n = len(names)
    whole = names[: max(n - size + 1, 0)].copy()
    for k in range(1, size):
        whole = chained(whole, names[k : k + len(whole)])
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            short = names[a : a + 1]
            for k in range(a + 1, b):
                short = chained(short, names[k : k + 1])
            out.append(mixed(short + np.uint64(b - a)))
        else:
            out.append(names[:0])
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _class(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _needed(tokens: int, percent: int) -> int:
    return -(-percent * tokens // 100)


def stored(frame: DataFrame, name: str) -> DataFrame:
    return staging.stored(frame, name, BATCH_BYTES)


def _cut(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut to a number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def profiles(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``n``, ``k`` (class), ``mins``, ``bins``; and counter slices (``part``, ``counts``) from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype="<u4")
        for batch in slices(batches, limit=TEXT_BYTES):
            sets = shingle_names(find_words(batch.column("text"), lower=True))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys = [_class(s) if len(s) else 0 for s in sets]
            mins = np.zeros((len(sets), HASHES), dtype=np.int64)
            bins = np.zeros((len(sets), 1 << BIN_BITS), dtype=np.uint8)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                counter, times = np.unique(every % np.uint64(COUNTERS), return_counts=True)
                counters[counter] = np.minimum(counters[counter] + times, (1 << 32) - 1)
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                place = (np.repeat(full, sizes[full]) << BIN_BITS) + (every >> np.uint64(64 - BIN_BITS)).astype(np.int64)
                bins = np.minimum(np.bincount(place, minlength=len(sets) << BIN_BITS), 255).astype(np.uint8).reshape(len(sets), -1)
                for h in range(HASHES):
                    mins[full, h] = np.minimum.reduceat(mixed(every + np.uint64(7919 * (h + 1))), at).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(list(mins), pa.list_(pa.int64())), pa.array([x.tobytes() for x in bins], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names=["doc_id", "h", "n", "k", "mins", "bins", "part", "counts"],
            )
        rows = counters.reshape(-1, SLICE)
        for first in range(0, len(rows) if counters.any() else 0, 64):
            some = rows[first : first + 64]
            m = len(some)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(m, pa.int64()) for _ in range(4)), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()), pa.array(range(first, first + m), pa.int32()), pa.array([r.tobytes() for r in some], pa.binary())],
                names=["doc_id", "h", "n", "k", "mins", "bins", "part", "counts"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, k long, mins array<long>, bins binary, part int, counts binary")


def rarity(counts: DataFrame) -> np.ndarray:
    """Bit length of every counter's sum: 2 MB, whatever the corpus."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<u4").astype(np.float64) for c in rows["counts"])
        return pd.DataFrame({"part": [key[0]], "level": [np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()]})

    out = np.zeros(COUNTERS, dtype=np.uint8)
    for row in counts.groupBy("part").applyInPandas(add, "part int, level binary").collect():
        out[row.part * SLICE : (row.part + 1) * SLICE] = np.frombuffer(row.level, np.uint8)
    return out


def prefixes(docs: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """``doc_id``, ``k``, ``prefix`` (array of long): the leading shingles of every set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in slices(batches, limit=TEXT_BYTES):
            sets = shingle_names(find_words(batch.column("text"), lower=True))
            first = []
            for s in sets:
                order = np.lexsort((s, level[(s % np.uint64(COUNTERS)).astype(np.int64)]))
                first.append(s[order[: len(s) - _needed(len(s), percent) + 1]].view(np.int64) if len(s) else s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_class(s) if len(s) else 0 for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "k", "prefix"]
            )

    return docs.mapInArrow(run, "doc_id long, k long, prefix array<long>").where(F.size("prefix") > 0)


def _slots(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64) + mixed(ids.view(np.uint64))) % np.uint64(FILTER_BITS)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(-1), dtype=np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """``k``, ``shingles`` (binary) of the classes ``wanted`` (``k``, ``doc_id`` of one row that has the text)."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
        for batch in batches:
            slot = _slots(_ids(batch.column("k")), _ids(batch.column("doc_id")))
            np.bitwise_or.at(mine, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(mine[at].view(np.int64), pa.int64())], names=["at", "bits"])

    whole = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    rows = wanted.select("k", "doc_id").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    whole[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(whole.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = shared.value
        for batch in slices(batches, limit=TEXT_BYTES):
            sets = shingle_names(find_words(batch.column("text"), lower=True))
            keys = np.array([_class(s) if len(s) else 0 for s in sets], dtype=np.int64)
            slot = _slots(keys, _ids(batch.column("doc_id")))
            asked = present[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)
            hit = [i for i in np.flatnonzero(asked).tolist() if len(sets[i])]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit], pa.int64()), pa.array([sets[i].tobytes() for i in hit], pa.binary())], names=["k", "shingles"])

    found = docs.mapInArrow(run, "k long, shingles binary").join(wanted.select("k").distinct(), "k", "left_semi")
    return stored(found.dropDuplicates(["k"]), name)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def hub_pairs(classes: DataFrame, least_agreement: int = 3) -> DataFrame:
    """(``k``, ``hub``): each class with the hub of its most popular smallest-hash shingle.

    The hub is the member whose eight shingles are the most popular ones, which is what the
    others were copied from.  A pair that hardly agrees is left to the matrix.
    """
    mins = classes.select("k", F.posexplode("mins").alias("h", "token"))
    popular = stored(mins.groupBy("h", "token").agg(F.count("*").alias("members")).where("members > 1"), "jaccard-popular")
    chosen = (
        mins.join(popular, ["h", "token"])
        .groupBy("k")
        .agg(F.max(F.struct("members", "h", "token")).alias("best"), F.sum("members").alias("score"))
        .select("k", F.col("best.h").alias("h"), F.col("best.token").alias("token"), "score")
        .join(classes.select("k", "mins"), "k")
    )
    chosen = stored(chosen, "jaccard-chosen")
    hubs = stored(chosen.groupBy("h", "token").agg(F.max(F.struct("score", "k", "mins")).alias("hub")), "jaccard-hubs")
    agree = F.aggregate(F.zip_with("mins", "hub.mins", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    return chosen.join(hubs, ["h", "token"]).where((F.col("k") != F.col("hub.k")) & (agree >= least_agreement)).select("k", F.col("hub.k").alias("hub"))


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (``k``, ``hub``) whose histograms allow the threshold, and how far they are ``apart``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int16) for c in ("x", "y"))
            sizes = np.asarray(batch.column("n")) + np.asarray(batch.column("m"))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            out = pa.RecordBatch.from_arrays([batch.column("k"), batch.column("hub"), pa.array(apart)], names=["k", "hub", "apart"])
            yield out.filter(pa.array((100 + percent) * apart <= (100 - percent) * sizes))

    both = pairs.join(classes.select("k", "n", F.col("bins").alias("x")), "k").join(classes.select(F.col("k").alias("hub"), F.col("n").alias("m"), F.col("bins").alias("y")), "hub")
    return both.select("k", "hub", "n", "m", "x", "y").mapInArrow(run, "k long, hub long, apart long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``k``, ``hub``) whose sets are at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            good = [
                _linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            ]
            yield batch.select(["k", "hub"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select("k", F.col("shingles").alias("a")), "k").join(sets.select(F.col("k").alias("hub"), F.col("shingles").alias("b")), "hub")
    return both.select("k", "hub", "a", "b").mapInArrow(run, "k long, hub long")


def exact(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (``k``, ``hub``) compared by their sets, which are made from the texts of the classes concerned."""
    wanted = stored(pairs.select("k").union(pairs.select("hub")).distinct().join(classes.select("k", "doc_id"), "k"), "jaccard-wanted")
    sets = sets_of(docs, wanted, "jaccard-sets")
    out = stored(verified(pairs, sets, percent), "jaccard-verified")
    discarded(wanted, sets)
    return out


def _portions() -> Column:
    """Portions of bounded size that the rows of a group are dealt to."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def grouped(classes: DataFrame, assigned: DataFrame, stars: DataFrame) -> DataFrame:
    """``k``, ``doc_id``, ``n``, ``bins``, ``g`` (group), ``node`` (what links join), ``connected``, ``size`` and ``blocks`` of the group."""
    hubs = stars.groupBy(F.col("hub").alias("k")).agg(F.lit(True).alias("is_hub"))
    every = classes.join(assigned.withColumnRenamed("hub", "of"), "k", "left").join(stars, "k", "left").join(hubs, "k", "left")
    node = F.coalesce("hub", "k")
    alone = F.col("hub").isNull() & F.col("is_hub").isNull()
    far = alone & F.col("of").isNotNull()
    crowd = every.where(far).groupBy("of").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = every.join(crowd, "of", "left").select(
        "k", "doc_id", "n", "bins", node.alias("node"), (~far).alias("connected"), F.when(far, F.xxhash64("of", F.pmod(F.xxhash64("k"), F.col("parts")))).otherwise(node).alias("g")
    )
    placed = stored(placed, "jaccard-placed")
    sizes = placed.groupBy("g").agg(F.count("*").alias("size"), _portions().alias("blocks")).where("size > 1")
    one = [F.coalesce(c, F.lit(1).cast(t)).alias(c) for c, t in (("size", "long"), ("blocks", "int"))]
    out = stored(placed.join(sizes, "g", "left").select("g", "k", "doc_id", "n", "bins", "node", "connected", *one), "jaccard-members")
    discarded(placed)
    return out


def shared_entries(matrix: DataFrame) -> DataFrame:
    """The matrix entries (``token``, ``g``) of shingles that several groups have; a frequent one is met by partial minima."""
    several = matrix.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("token")
    return matrix.join(several, "token", "left_semi").select("token", "g")


def candidate_groups(shared: DataFrame) -> DataFrame:
    """(``g``, ``other``), g < other: groups that share a matrix entry."""
    return shared.join(shared.withColumnRenamed("g", "other"), "token").where("g < other").select("g", "other").distinct()


def worth_a_look(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(``asking``, ``target``, ``size``) of the candidate groups whose sizes allow the threshold; the larger group is the target.

    Groups that are not connected are candidates for themselves.
    """
    groups = members.groupBy("g").agg(F.max("size").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = (groups.select(*[F.col(c).alias(f"{p}_{c}") for c in groups.columns]) for p in ("l", "r"))
    sized = pairs.join(left, F.col("g") == F.col("l_g")).join(right, F.col("other") == F.col("r_g"))
    fits = (100 * F.col("l_high") >= percent * F.col("r_low")) & (100 * F.col("r_high") >= percent * F.col("l_low"))
    turned = F.col("l_size") > F.col("r_size")
    between = sized.where(fits).select(F.when(turned, F.col("other")).otherwise(F.col("g")).alias("asking"), F.when(turned, F.col("g")).otherwise(F.col("other")).alias("target"), F.greatest("l_size", "r_size").alias("size"))
    own = members.where("not connected and size > 1").select(F.col("g").alias("asking"), F.col("g").alias("target"), "size").distinct()
    return between.union(own)


def possible_pairs(asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(``k``, ``hub``) of the candidate groups of one member whose histograms allow the threshold."""
    one = members.where("size = 1")
    alone = asked.where("size = 1").join(one.select(F.col("g").alias("asking"), "k"), "asking").join(one.select(F.col("g").alias("target"), F.col("k").alias("hub")), "target")
    return bounded(alone.select("k", "hub"), one, percent).select("k", "hub")


def _histograms(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles by hash bin, at most 255, of every set."""
    sizes = [len(s) for s in sets]
    place = (np.repeat(np.arange(len(sets)), sizes) << BIN_BITS) + (np.concatenate(sets) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=len(sets) << BIN_BITS), 255).astype(np.uint8).reshape(len(sets), -1)


def _feasible(x: np.ndarray, queries: pd.DataFrame, y: np.ndarray, block: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query row that can reach the threshold: its place, the places in the block of another node, and how far apart."""
    x, y = x.astype(np.int16), y.astype(np.int16)
    most, sizes, nodes = y.max(axis=0), block["n"].to_numpy(), block["node"].to_numpy()
    for i, (n, node) in enumerate(zip(queries["n"].tolist(), queries["node"].tolist())):
        # The overlap with the union, by bins, cannot be larger than this (full bins have no bound).
        if 100 * (np.minimum(x[i], most).sum() + max(n - int(x[i].sum()), 0)) < percent * n:
            continue
        apart = np.abs(y - x[i]).sum(axis=1)
        good = np.flatnonzero(((100 + percent) * apart <= (100 - percent) * (sizes + n)) & (nodes != node))
        if len(good):
            yield i, good, apart[good]


CELL = ["target", "block", "portion"]


def opened_members(asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(cell, ``k``, ``n``, ``node``, ``asks``): members of both groups with a possible partner in their cell.

    A target is cut into blocks; the other group's members are the queries, in portions of
    the same size.  Only groups of several members, on either side, are looked at here.
    """
    asked = asked.where("size > 1")
    placed = members.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    cut = members.groupBy(F.col("g").alias("target")).agg(F.max("blocks").alias("blocks"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    queries = asked.join(cut, "target").join(placed.select(F.col("g").alias("asking"), "k", "n", "node", "bins"), "asking").select("k", "n", "node", "bins", "target", blocks)
    load = stored(queries.groupBy("target", "block").agg(_portions().alias("portions")), "jaccard-load")
    asking = queries.join(load, ["target", "block"]).withColumn("portion", F.pmod(F.xxhash64("k"), F.col("portions")).cast("int")).select(*CELL, "k", "n", "node", "bins")
    answering = (
        placed.select(F.col("g").alias("target"), "block", "k", "n", "node", "bins")
        .join(load, ["target", "block"])
        .select("target", "block", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), "k", "n", "node", "bins")
    )

    def compare(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({c: [] for c in [*CELL, "k", "n", "node", "asks"]})
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (queries["bins"], block["bins"]))
        some, met = [], np.zeros(len(block), dtype=bool)
        for i, good, _ in _feasible(x, queries, y, block, percent):
            some.append(i)
            met[good] = True
        columns = [*CELL, "k", "n", "node"]
        return pd.concat([queries.iloc[some][columns].assign(asks=True), block[met][columns].assign(asks=False)])

    cells = asking.groupBy(*CELL).cogroup(answering.groupBy(*CELL))
    return cells.applyInPandas(compare, "target long, block int, portion int, k long, n long, node long, asks boolean")


def cell_links(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``): links between nodes that connect what every cell connects, a forest of each cell."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        queries, block = rows[rows["asks"]], rows[~rows["asks"]]
        if len(queries) and len(block):
            left, right = ([np.frombuffer(x, np.uint64) for x in c["shingles"]] for c in (queries, block))
            pairs = [(d, i, j) for i, good, apart in _feasible(_histograms(left), queries, _histograms(right), block, percent) for j, d in zip(good.tolist(), apart.tolist())]
            a, b = queries["node"].tolist(), block["node"].tolist()
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := above.get(x, x)) != x:
                    above[x] = above.get(up, up)
                    x = up
                return x

            for _, i, j in sorted(pairs):
                x, y = root(a[i]), root(b[j])
                if x != y and _linked(left[i], right[j], percent):
                    above[x] = y
                    out.append((a[i], b[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return opened.join(sets, "k").groupBy(*CELL).applyInPandas(join, "a long, b long")


def class_components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``h``, ``n``, ``k``) of (``doc_id``, ``text``), and for every class ``k`` its ``root`` and ``component_id``."""
    made = stored(profiles(docs), "jaccard-profiles")
    rows = made.where("part is null").select("doc_id", "h", "n", "k", "mins", "bins")
    levels = rarity(made.where("part is not null").select("part", "counts"))
    classes = rows.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("mins").alias("mins"), F.first("bins").alias("bins"))
    classes = stored(classes, "jaccard-classes")

    assigned = stored(hub_pairs(classes), "jaccard-assigned")
    near = stored(bounded(assigned, classes, percent).select("k", "hub"), "jaccard-near")
    stars = exact(near, classes, docs, percent)
    members = grouped(classes, assigned, stars)
    discarded(assigned, near, stars)

    leading = prefixes(docs, levels, percent).join(members.select("k", "g", "size", F.col("doc_id").alias("of")), "k").where(F.col("doc_id").eqNullSafe(F.col("of")))
    entries = leading.select("g", "size", F.explode("prefix").alias("token"))
    several = entries.where("size > 1").groupBy("token", "g").agg(F.lit(1).alias("one")).select("token", "g")
    shared = stored(shared_entries(entries.where("size = 1").select("token", "g").union(several)), "jaccard-matrix")
    candidates = stored(candidate_groups(shared), "jaccard-candidates")
    asked = stored(worth_a_look(candidates, members, percent), "jaccard-asked")
    discarded(shared, candidates)
    nodes = members.select("k", "node")
    pairs = stored(possible_pairs(asked, members, percent), "jaccard-pairs")
    opened = stored(opened_members(asked, members, percent), "jaccard-opened")
    wanted = stored(pairs.select("k").union(pairs.select("hub")).union(opened.select("k")).distinct().join(classes.select("k", "doc_id"), "k"), "jaccard-wanted")
    sets = sets_of(docs, wanted, "jaccard-sets")
    named = nodes.select(F.col("k").alias("hub"), F.col("node").alias("b"))
    single = verified(pairs, sets, percent).join(nodes.select("k", F.col("node").alias("a")), "k").join(named, "hub").select("a", "b")
    every = stored(single.union(cell_links(opened, sets, percent)), "jaccard-every-link")
    discarded(asked, pairs, opened, wanted, sets, classes)

    roots = stored(components(every), "jaccard-final-roots")
    parts = members.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("k", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = parts.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = stored(parts.join(smallest, "root").select("k", "root", "component_id"), "jaccard-names")
    discarded(members, every, roots)
    return rows, names


def linked(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id that links reach).

    Documents without words have no shingles, are linked with nothing and keep their own id.
    Rows with a null id are linked by their text and never name a component, unless all of it
    is null.  Repeated rows stay.  Other columns are not read.
    """
    rows, names = class_components(_rows(docs, id_col, text_col), percent)
    joined = rows.where("n > 0").select("doc_id", "n", "k").join(names.select("k", "component_id"), "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, with all its columns: the smallest id (nulls last), then the smallest hash of the text.

    Documents without words are linked with nothing and stay.
    """
    rows, names = class_components(_rows(docs, id_col, text_col), percent)
    first = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "h")
    chosen = rows.where("n > 0").join(names.select("k", "root"), "k").select("root", "doc_id", "h").withColumn("place", F.row_number().over(first)).where("place = 1")
    chosen = chosen.select("doc_id", "h", F.lit(False).alias("every")).union(rows.where("n = 0").select("doc_id", "h", F.lit(True)).distinct())
    # Rows are found again by id and text; they do not travel through Python.
    keys = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "h"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).select("row", *keys)
    found = whole.join(chosen.select(*keys, "every"), ["id", "no_id", "h"])
    same = Window.partitionBy("id", "no_id", "h").orderBy("id")
    return found.withColumn("place", F.row_number().over(same)).where("every or place = 1").select("row.*")
