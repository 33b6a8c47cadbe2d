"""Helpers that the training-data operators share: shared folders, word counts, filters by id."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quoin-shared-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, with no lineage behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quoin/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As stored, in buckets of a key, so that a grouping by it that reads the table needs no shuffle."""
    name = f"quoin_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(df.sparkSession)}/quoin/{name}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(texts: list, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` characters together; a longer text is alone in its range."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow whose function gets and gives pyarrow tables; empty batches are left out."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                for out in f(b):
                    if out.num_rows:
                        yield from pa.Table.from_batches([out]).to_batches() if isinstance(out, pa.RecordBatch) else out.to_batches()

    return df.mapInArrow(run, schema)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int = 4 << 20):
    """What runs meanwhile sends Python workers batches of about so many bytes at most, not of 10,000 rows however long:
    an executor holds some copies of a batch outside its heap for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BLOOM_K = 4


def _bloom_bits(ids: np.ndarray, log2_bits: int) -> list[np.ndarray]:
    return [(mix64(ids, 11 + k) >> np.uint64(64 - log2_bits)).astype(np.int64) for k in range(_BLOOM_K)]


def bloom_has(packed: bytes, x: np.ndarray) -> np.ndarray:
    """False only where x (64-bit integers) is surely not in the filter."""
    bits, ok = np.frombuffer(packed, np.uint8), np.ones(len(x), bool)
    for at in _bloom_bits(x.view(np.uint64), (8 * len(bits)).bit_length() - 1):
        ok &= ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
    return ok


#: Bytes of a slice of a filter, by which parts of it are merged.
_SLICE = 4096


def bloom(ids: DataFrame) -> bytes:
    """A bloom filter of a long column, of a fixed size: at most 2**27 bits (16 MB).

    Each of at most 256 tasks fills a filter of its own; their slices are merged by slice, so that the driver
    gets one filter however many tasks there are. Beyond some ten million ids it lets more through, which costs
    time and not correctness, as an exact join follows wherever it is used.
    """
    log2_bits = min(27, max(16, int(np.ceil(np.log2(16 * max(1, ids.count()))))))

    def batch(at: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], names=["at", "bits"])

    def build(batches):
        packed = np.zeros((1 << log2_bits) // 8, np.uint8)  # never a byte a bit, as each core holds one
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(x):
                at = np.sort(np.concatenate(_bloom_bits(x, log2_bits)))
                first = np.flatnonzero(np.diff(at >> 3, prepend=-1))
                packed[at[first] >> 3] |= np.bitwise_or.reduceat(np.uint8(128) >> (at & 7).astype(np.uint8), first)
        packed = packed.reshape(-1, _SLICE)
        held = np.flatnonzero(packed.any(1))
        for i in range(0, len(held), 1024):
            yield batch(held[i : i + 1024], packed[held[i : i + 1024]])

    def merge(batches):
        merged: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(part.as_buffer(), np.uint8)
                if at in merged:
                    merged[at] |= part
                else:
                    merged[at] = part.copy()
        if merged:
            yield batch(np.fromiter(merged, np.int32), np.stack(list(merged.values())))

    out = np.zeros(((1 << log2_bits) // 8 // _SLICE, _SLICE), np.uint8)
    parts = ids.select(F.col(ids.columns[0]).cast("long")).coalesce(256).mapInArrow(build, "at int, bits binary")
    for row in parts.repartition(min(16, len(out)), "at").mapInArrow(merge, "at int, bits binary").collect():  # 16 MB at most
        out[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def id_bloom(ids: DataFrame):
    """A function of a long column: False only where the id is null or surely not among `ids`."""
    shared = ids.sparkSession.sparkContext.broadcast(bloom(ids))  # 16 MB at most

    @F.pandas_udf("boolean")
    def has(x: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(shared.value, x.to_numpy().astype(np.int64)))

    # pandas would turn a batch with nulls into doubles, which do not hold ids over 2**53.
    return lambda x: x.isNotNull() & has(F.coalesce(x.cast("long"), F.lit(0)))


def arrow_bloom(ids: DataFrame):
    """As id_bloom, for use inside map_arrow, whose task then needs no second Python worker: a function of an Arrow
    column of longs that gives a mask, False only where the id is surely not among `ids`; null ids stay."""
    shared = ids.sparkSession.sparkContext.broadcast(bloom(ids))  # 16 MB at most

    def has(x: pa.Array) -> np.ndarray:
        found = bloom_has(shared.value, x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
        return found | x.is_null().to_numpy(zero_copy_only=False)

    return has


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in ids (one column, doc_id). Rows with a null id stay.

    Only rows that pass a bloom filter of the ids go through the exact anti-join, so that the texts of
    all the others are not shuffled.
    """
    ids = stored(ids.where("doc_id IS NOT NULL").distinct(), "ids")
    maybe = id_bloom(ids)
    may = "_maybe"
    while may in docs.columns:
        may += "_"
    marked = docs.withColumn(may, maybe(F.col("doc_id").cast("long")))
    sure = marked.where(~F.col(may)).drop(may)
    rest = marked.where(F.col(may)).drop(may).join(ids.hint("shuffle_merge"), "doc_id", "left_anti")
    return sure.unionByName(rest.select(*docs.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, label) per node, label its least reachable node.

    Labels spread along edges and then jump to their label's label, so that long chains take few rounds.
    Every minimum over a node's edges is combined before the shuffle, and each round is written to the shared folder.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.n).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = step.join(top, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label"))
        step = stored(step, "labels")
        labels = step.select("node", "label")
        if not step.where("label <> was").limit(1).count():
            return labels
