"""What a Python worker of the near-copy join holds at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, staging
from rankloom.llm import jaccard_join as J
from rankloom.llm.words import find_words


class Captured:
    """Stands in for a table: keeps the function that a task would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def text_batch(rows, words):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(words)) for _ in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(range(rows), pa.int64()), pa.array(texts)], names=["doc_id", "h", "text"])


def test_profiles_hold_little_at_once(spark):
    batch = text_batch(3000, 500)  # some 10 MB of texts
    run, counts, rows = J.profiles(Captured()), np.zeros(J.COUNTERS, dtype=np.int64), 0
    tracemalloc.start()
    for out in run(iter([batch])):
        for part, c in zip(out.column("part").to_pylist(), out.column("counts").to_pylist()):
            if part is None:
                rows += 1
            else:
                counts[part * J.SLICE : (part + 1) * J.SLICE] += np.frombuffer(c, "<u4")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6
    want = np.zeros(J.COUNTERS, dtype=np.int64)
    for s in J.shingle_names(find_words(batch.column("text"), lower=True)):
        np.add.at(want, (s % np.uint64(J.COUNTERS)).astype(np.int64), 1)
    assert rows == 3000 and (counts == want).all()


def test_batches_to_workers_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["size", "n"])

    before = spark.conf.get(staging.BATCH_CONF)
    wide = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    out = J.stored(wide.mapInArrow(sizes, "size long, n long"), "sizes").agg(F.max("size").alias("most"), F.sum("n").alias("n")).first()
    assert out.n == 4000 and out.most < 1.1 * J.BATCH_BYTES
    assert spark.conf.get(staging.BATCH_CONF) == before


def test_filter_is_sent_packed(spark, monkeypatch):
    sent = []
    context = type(spark.sparkContext)
    real = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or real(self, value))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    keys = {r.doc_id: r.k for r in J.profiles(J._rows(docs, "doc_id", "text")).where("part is null").collect()}
    wanted = spark.createDataFrame([(keys[2], 2)], "k long, doc_id long")
    found = J.sets_of(J._rows(docs, "doc_id", "text"), wanted, "sets").collect()
    assert [r.k for r in found] == [keys[2]]
    assert all(value.nbytes <= J.FILTER_BITS // 8 for value in sent if isinstance(value, np.ndarray))


def test_a_task_forgets_its_words(spark):
    run = byte_bpe.encoded(Captured())
    assert sum(len(out) for out in run(iter([text_batch(5, 50)]))) == 5
    assert not byte_bpe._coder(byte_bpe.TOKENIZERS, "byte_bpe_multi_50k.tiktoken")[1]
