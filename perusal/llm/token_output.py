"""Token-ID output in training order.

Every document's token ids and one end id are laid end to end in the order of the scan, and
the stream is cut into sequences of fixed length. A keyed Feistel permutation with
cycle-walking gives each sequence its slot in the training order. Slots are dealt in ranges
to shards; a shard is one file of records of fixed stride, so a reader finds slot s at byte
(s mod slots a shard) * stride of shard s div slots, and a stopped run resumes at any slot.

Two passes over the same scan: the first counts the tokens of each part, which is what one
task reads of a file (two numbers each, summed on the driver), the second starts each part at
its place in the stream. Token ids are shuffled once, by range of slots: a task's range is one
shard, or several whole ones where there are more than MOST_TASKS. An input that isn't a
deterministic scan of files is written to the shared folder first, so both passes see the same
rows in the same parts; the second pass fails if they don't. Keeping the ids of the first pass
would save tokenising twice, and cost their size once more on disk.

Files are written by Spark's committed text writer, whose record is the ids' little-endian
bytes and whose line separator ends it; they reach any store that Spark writes, and the tasks
of a lost executor are written again without leaving parts behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, broadcast_if_small, shared_dir, table
from .permute import permuted

LENGTH, SHARD_SLOTS, SEED = 1024, 8192, 29
#: Tasks that write shards at most.
MOST_TASKS = 20_000
_encodings: dict = {}


def encoding(data: bytes, pattern: str):
    """The tokenizer of this worker process, from the bytes of a rank file."""
    if (len(data), pattern) not in _encodings:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        # without any special string the library looks for the empty one, at every place of a text; this one is never
        # allowed, so it is ordinary text where it occurs
        never = {"<|no special token|>": max(ranks.values(), default=0) + 1}
        _encodings[len(data), pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=never)
    return _encodings[len(data), pattern]


def by_part(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one part."""
    part = b.column("part").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for x, y in zip(cuts, cuts[1:]):
        if y > x:
            yield int(part[x]), b.slice(x, y - x)


class Stream:
    """Cuts the tokens of one part, which are [start, stop) of the whole stream, at multiples of length."""

    def __init__(self, length: int, start: int, stop: int, kind: str):
        self.length, self.at, self.stop, self.kind, self.held, self.size = length, start, stop, kind, [], 0

    def add(self, ids: np.ndarray) -> int:
        self.held.append(ids)
        self.size += len(ids)
        return self.size

    def pieces(self, final: bool) -> pa.RecordBatch:
        """(sequence, at, ids) of what is held; unless final, up to the last whole sequence."""
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        first, head = divmod(self.at, self.length)
        upto = len(flat) if final else max(0, (head + len(flat)) // self.length * self.length - head)
        cuts = [0, *range(self.length - head, upto, self.length), upto]
        rows = [(first + i, 0 if i else head, flat[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        self.held, self.size, self.at = [flat[upto:]], len(flat) - upto, self.at + upto
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["sequence", "at", "ids"])

    def end(self) -> pa.RecordBatch:
        out = self.pieces(True)
        if self.at != self.stop:
            raise RuntimeError("the two passes read different rows; write the input to files first")
        return out


class Materialised:
    """Where the shards are and how to find a sequence in them."""

    def __init__(self, path: str, index: DataFrame, total: int, length: int, shard_slots: int, kind: str):
        self.path, self.index, self.total, self.length, self.shard_slots, self.kind = path, index, total, length, shard_slots, kind
        self.stride = np.dtype(kind).itemsize * length + 1

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte offset) of a slot."""
        return slot // self.shard_slots, slot % self.shard_slots * self.stride


def plain_scan(df: DataFrame) -> bool:
    """Whether the plan reads stored files, row by row, with the same result every time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def materialise(df: DataFrame, ranks: str, pattern: str, end: int, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Materialised:
    """Write all of ``df`` as shards under ``path`` and describe them.

    index: a row per sequence - slot, shard, byte_offset, sequence (its number in the stream),
    n_tokens (less than ``length`` in the last one only, which is filled up with ``end``),
    doc_ids (of the documents with a token in it, in order; ids of any type). Ids take two bytes,
    or four where the vocabulary or ``end`` needs them. Null and empty texts have no tokens and no
    end id; a null doc_id stays null in doc_ids; repeated rows are written as often as they
    occur, long texts whole; other columns are not read, whatever their names; an empty table
    gives no sequence and no shard. Special strings within a text are ordinary text. ``ranks``
    is a rank file on the driver.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    if not plain_scan(df):
        df = scratch.keep(df, "input")
    # a part is what a task reads of one file: the second pass meets the same rows in it
    part = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), part.alias("part"))
    ranked = open(ranks, "rb").read()
    kind = "<u2" if max(end, max(int(x.split()[1]) for x in ranked.splitlines())) < 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    data = spark.sparkContext.broadcast(ranked)

    def encoded(texts: pa.Array) -> Iterator[np.ndarray | None]:
        encode = encoding(data.value, pattern).encode_to_numpy
        for t in texts.to_pylist():
            yield encode(t, disallowed_special=()) if t else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            for name, run in by_part(b):
                last, at = name, at if name == last else 0
                n = pa.array([0 if x is None else len(x) + 1 for x in encoded(run.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([run.column("part"), pa.array(range(at, at + run.num_rows), pa.int64()), run.column("doc_id"), n], ["part", "row", "doc_id", "n"])
                at += run.num_rows

    kept = StructType([StructField("part", LongType()), StructField("row", LongType()), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", LongType())])
    counted = scratch.keep(docs.mapInArrow(count, kept), "counts")
    # a part's hash and its tokens: two numbers for what a task reads
    sums = sorted((r.part, r.n) for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect())
    names, sizes = np.array([p for p, _ in sums], np.int64), np.array([n for _, n in sums], np.int64)
    stops = np.cumsum(sizes)
    tokens = int(stops[-1]) if len(stops) else 0
    total = -(-tokens // length)
    bases = spark.sparkContext.broadcast((names, stops - sizes, stops))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stream, last_id = None, None, np.array([end], kind)
        for b in batches:
            for name, run in by_part(b):
                if name != last:
                    if stream:
                        yield stream.end()
                    known, starts, ends = bases.value
                    i = int(np.searchsorted(known, name))
                    last, stream = name, Stream(length, int(starts[i]), int(ends[i]), kind)
                for ids in encoded(run.column("text")):
                    if ids is not None:
                        stream.add(ids.astype(kind))
                        if stream.add(last_id) > 1 << 18:
                            yield stream.pieces(False)
        if stream:
            yield stream.end()

    key = F.lit(seed).cast("long")
    pieces = docs.select("text", "part").mapInArrow(cut, "sequence long, at int, ids binary")
    slot = permuted(F.col("sequence"), F.lit(total).cast("long"), key)
    shards = max(1, -(-total // shard_slots))
    tasks = min(shards, MOST_TASKS)
    pieces = pieces.withColumn("slot", slot).withColumn("shard", F.expr(f"slot div {shard_slots}"))
    pieces = pieces.withColumn("task", F.expr(f"cast(shard * {tasks} div {shards} as int)"))
    # by range of slots; the pieces of a slot are together then, without a further exchange
    whole = pieces.repartitionById(tasks, "task").groupBy("task", "shard", "slot").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    fill = np.full(length, end, kind).tobytes()
    record = F.concat(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])), F.lit(fill))
    record = F.substring(record, 1, width * length).cast("string")
    if total:
        whole.select("shard", "slot", record.alias("value")).sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").text(path, lineSep="\n")
    # the index, from the counts alone
    run = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = spark.createDataFrame([(int(p), int(a)) for p, a in zip(names, stops - sizes)], "part long, base long")
    spans = counted.join(broadcast_if_small(ends, len(names)), "part").filter("n > 0").withColumn("stop", F.col("base") + F.sum("n").over(run)).withColumn("start", F.col("stop") - F.col("n"))
    spans = spans.withColumn("sequence", F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(stop - 1) div {length}"))))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("start", "doc_id"))), lambda x: x["doc_id"])
    index = spans.groupBy("sequence").agg(ids.alias("doc_ids"), F.least(F.lit(length), F.max("stop") - F.col("sequence") * length).cast("int").alias("n_tokens"))
    index = index.withColumn("slot", permuted(F.col("sequence"), F.lit(total).cast("long"), key))
    index = index.select("slot", F.expr(f"slot div {shard_slots}").alias("shard"), (F.expr(f"slot % {shard_slots}") * (width * length + 1)).alias("byte_offset"), "sequence", "n_tokens", "doc_ids")
    return Materialised(path, index, total, length, shard_slots, kind)


def standard(df: DataFrame, path: str | None = None) -> Materialised:
    """With the public byte-level vocabulary, to a new folder beside the session's checkpoints."""
    import public_tokenizers

    path = path or f"{shared_dir(df.sparkSession)}/shards-{uuid.uuid4().hex}"
    return materialise(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256, path)


def op7(spark, sf_dir: str) -> DataFrame:
    return standard(table(spark, sf_dir, "documents")).index
