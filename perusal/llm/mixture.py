"""Mixing sources to target weights.

Documents of a source are packed, in an order fixed by hash, into a stream of words that is
cut into blocks of fixed length. Output shards have a fixed number of slots, each for one
block. The blocks of each source in each shard are multinomial draws given that every source's
draws sum to its quota: a tree over the shards splits the quotas by hypergeometric draws, whose
seeds are the places in the tree, so a task draws its own shards' counts, and the numbers of
a source's slots before them, from the path to them alone. Slot k of a source is place k mod
blocks of pass k div blocks; a keyed permutation per pass gives every block its place, and
blocks join slots by (source, pass, place).

No window or task holds a whole source: packing sums sizes within hash buckets of bounded
size, then over groups of buckets, then over those. Rows that are equal in all columns are
packed as one with a count. Only numbers are shuffled until texts are cut. What comes to the
driver and travels to tasks is a few numbers per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table
from .permute import permuted

#: Weights of the sources in order of their names, repeating; share of all words that is taken, in per cent; most times of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 150, 2
BLOCK, SLOTS, BUCKET_ROWS, SEED = 128, 8192, 1024, 17
#: Buckets whose sums are added up by one task; copies of a row that one task numbers; blocks that one task places.
RUN, COPIES, PLACED = 4096, 100_000, 200_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, sidx, target) of sources (source, source_size): a row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` per
    cent of all words; a target stops at ``most`` times its source, and the excess is shared
    by weight among the rest until none is above. With sources in order of size by weight, that
    is the first k capped and the others at a common rate, for the least k that fits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sidx", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("sidx", F.lit(len(weights)))))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "sidx")
    before, rest, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    s = s.withColumns({"capped": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "left": F.sum("w").over(rest), "total": F.sum("source_size").over(all_) * share / 100})
    s = s.withColumn("rate", (F.col("total") - F.col("capped")) / F.col("left"))
    fits = F.when(F.col("rate") * F.col("w") <= most * F.col("source_size"), F.col("rate"))
    # the first that stays below its cap sets the rate of all after it
    s = s.withColumn("rate", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cap = (most * F.col("source_size")).cast("double")
    return s.select("source", "source_size", "sidx", F.coalesce(F.least(F.col("rate") * F.col("w"), cap), cap).alias("target"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, size, tie, rows) as a row per row, told apart by ``dup`` from 1. A count
    beyond COPIES is dealt to several tasks."""
    many = docs.filter(F.col("rows") > COPIES).limit(1).count()
    docs = docs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {COPIES}"))))
    if many:
        docs = docs.repartition("doc_id", "tie", "part")
    docs = docs.withColumn("dup", F.explode(F.sequence(F.expr(f"part * {COPIES} + 1"), F.least(F.col("rows"), F.expr(f"(part + 1) * {COPIES}")))))
    return docs.drop("rows", "part")


def packed(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, source, size, tie, dup) with ``start``, the words of the source's stream before a row."""
    rows = docs.count()
    buckets = max(1, -(-rows // bucket_rows))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", "size", "dup"), F.lit(buckets)))
    own = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie", "size", "dup")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("inner", F.sum("size").over(upto(own)) - F.col("size"))
    # words of a source before a run of buckets, and before a bucket within its run
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("run", F.expr(f"bucket div {RUN}"))
    runs = sums.groupBy("source", "run").agg(F.sum("words").alias("all"))
    runs = runs.select(F.col("source").alias("rs"), F.col("run").alias("rr"), (F.sum("all").over(upto(Window.partitionBy("source").orderBy("run"))) - F.col("all")).alias("far"))
    sums = sums.withColumn("near", F.sum("words").over(upto(Window.partitionBy("source", "run").orderBy("bucket"))) - F.col("words"))
    sums = sums.join(runs, sums["source"].eqNullSafe(runs["rs"]) & (sums["run"] == runs["rr"]))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("near") + F.col("far")).alias("base"))
    got = docs.join(sums, docs["source"].eqNullSafe(sums["s"]) & (docs["bucket"] == sums["b"]))
    return got.select("doc_id", "source", "size", "tie", "dup", (F.col("base") + F.col("inner")).alias("start"))


def quotas(t: DataFrame, block: int, seed: int) -> DataFrame:
    """Blocks, whole passes, last pass and slots of each source with words and a target."""
    last, rest = F.col("blocks") - 1, F.col("rest")
    t = t.filter("source_size > 0").withColumns({"blocks": F.ceil(F.col("source_size") / block), "goal": F.round("target").cast("long")})
    t = t.withColumns({"passes": F.expr("goal div source_size"), "rest": F.expr("goal % source_size"), "short": (F.col("blocks") * block - F.col("source_size")).cast("long")})
    t = t.withColumn("short_place", permuted(last, F.col("blocks"), pass_key(F.col("sidx"), F.col("passes"), seed)))
    m = F.ceil(rest / block)
    m = F.when(F.col("short_place") < m, F.ceil((rest + F.col("short")) / block)).otherwise(m)
    return t.withColumn("quota", F.col("passes") * F.col("blocks") + m)


def pass_key(sidx, passes, seed: int):
    return F.xxhash64(F.lit(seed), sidx.cast("long"), passes.cast("long"))


def _taken(block: int):
    """Words that a slot takes of its block: all, but for the end of the last pass."""
    before = F.col("place") * block - F.when(F.col("short_place") < F.col("place"), F.col("short")).otherwise(0)
    length = F.lit(block) - F.when(F.col("place") == F.col("short_place"), F.col("short")).otherwise(0)
    full = F.lit(block)  # in whole passes; pieces end with the stream anyway
    return F.when(F.col("pass") < F.col("passes"), full).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before))).cast("long")


def split(counts: np.ndarray, some: int, seed: list[int]) -> np.ndarray:
    """How many of ``counts`` (per source) are among ``some`` drawn of all of them without replacement.

    Beyond what the exact draw can count to, each source's share is drawn from the normal law of
    the same mean and spread, and what the sum is off by is dealt out where there is room."""
    total = int(counts.sum())
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed)))
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, some, method="marginals")
    share = some / total
    spread = np.sqrt(counts * share * (1 - share) * (1 - counts / total))
    got = np.clip(np.rint(counts * share + spread * rng.standard_normal(len(counts))), 0, counts).astype(np.int64)
    off = some - int(got.sum())
    room = counts - got if off > 0 else got
    before = np.cumsum(room) - room
    return got + np.sign(off) * np.clip(abs(off) - before, 0, room)


def draws(quota: np.ndarray, per_shard: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, slots of each source in it) of shards first to last - 1.
    Each step halves a range of shards and splits its counts between the halves."""
    total = int(quota.sum())
    todo = [(0, -(-total // per_shard), np.zeros(len(quota), np.int64), quota.astype(np.int64))]
    while todo:
        lo, hi, before, counts = todo.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, before, counts
            continue
        mid = (lo + hi) // 2
        left = split(counts, (mid - lo) * per_shard, [seed, lo, hi])
        todo += [(mid, hi, before + left, counts - left), (lo, mid, before, left)]


def slots(t: DataFrame, scratch: Scratch, block: int, per_shard: int, seed: int) -> DataFrame:
    """(shard, sidx, k, pass, place, taken): every slot of the mix; t has ``quotas``."""
    spark = t.sparkSession
    quota = t.select("sidx", "quota").orderBy("sidx").collect()  # one number a source
    number, share = np.array([r.sidx for r in quota], np.int64), np.array([r.quota for r in quota], np.int64)
    shards = -(-int(share.sum()) // per_shard)
    known = spark.sparkContext.broadcast((number, share))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, quotas_ = known.value
        for b in batches:
            ids = b["id"].to_numpy()
            for shard, before, c in draws(quotas_, per_shard, int(ids[0]), int(ids[-1]) + 1, seed) if len(ids) else ():
                hit = c > 0
                yield pd.DataFrame({"shard": shard, "sidx": names[hit], "from": before[hit], "c": c[hit]})

    # shards of a batch of spark.range follow one another
    drawn = scratch.keep(spark.range(shards).mapInPandas(draw, "shard long, sidx long, from long, c long"), "drawn")
    k = F.explode(F.sequence(F.col("from"), F.col("from") + F.col("c") - 1))
    out = drawn.select("shard", "sidx", k.alias("k")).join(t.drop("source", "target"), "sidx")
    out = out.withColumns({"pass": F.expr("k div blocks"), "place": F.expr("k % blocks")})
    return out.select("shard", "sidx", "k", "pass", "place", _taken(block).alias("taken"))


def row_hash(df: DataFrame):
    """Hash of all columns of a row: rows with equal hashes (and ids, sources, sizes) stand for one another."""
    hashed = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{f.name}`")
    return F.xxhash64(*[hashed(f) for f in df.schema.fields])


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Plan a mix of all rows of ``df``.

    Returns (documents, pieces). documents: doc_id, source, size, tie, dup, source_size,
    target, a row per row of df. pieces: doc_id, source, tie, dup, size, shard, slot, pass,
    from, to - the words [from, to) of a document that a slot takes. Null text has size 0; null
    source is a source of its own, the last; documents without words have no pieces; rows equal
    in all columns are told apart by ``dup``; ties in the order of packing cannot be, as hashes
    and numbers of copies order all rows; long texts are split like any; an empty table, or
    one without words, has no pieces; other columns are only hashed, whatever their names.
    """
    scratch = Scratch(df.sparkSession)
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    size = F.greatest(size, F.lit(0).cast("long"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), row_hash(df).alias("tie"))
    rows = scratch.keep(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("rows")), "sizes")
    t = scratch.keep(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"))), "targets")
    docs = numbered(rows)
    q = scratch.keep(quotas(t, block, seed), "quotas")
    place = scratch.keep(packed(docs, bucket_rows), "packed")
    got = place.join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    span = got.filter("size > 0").join(q.select("sidx", "blocks", "passes"), "sidx")
    blocks = q.agg(F.sum(F.col("blocks") * (F.least(F.col("passes"), F.lit(MOST - 1)) + 1))).first()[0] or 0
    span = span.repartition(max(1, -(-blocks // PLACED), span.sparkSession.sparkContext.defaultParallelism), "doc_id", "tie", "dup")
    span = span.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    span = span.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("passes"), F.lit(MOST - 1)))))
    span = span.withColumn("place", permuted(F.col("block"), F.col("blocks"), pass_key(F.col("sidx"), F.col("pass"), seed)))
    taken = span.join(slots(q, scratch, block, per_shard, seed), ["sidx", "pass", "place"])
    a, b = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)), F.least(F.col("block") * block + F.col("taken") - F.col("start"), F.col("size"))
    order = F.xxhash64(F.lit(seed), "shard", "sidx", "k")
    taken = taken.select("doc_id", "source", "tie", "dup", "size", "shard", order.alias("slot"), "pass", a.alias("from"), b.alias("to")).filter("to > from")
    return got.drop("start", "sidx"), scratch.keep(taken, "pieces")


_ROW = ["doc_id", "source", "size", "tie", "dup"]


def _same(a: DataFrame, b: DataFrame):
    on = None
    for c in _ROW:
        is_ = a[c].eqNullSafe(b[f"_{c}"])
        on = is_ if on is None else on & is_
    return on


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    sums = pieces.groupBy(*_ROW).agg(F.sum(F.col("to") - F.col("from")).alias("taken")).withColumnsRenamed({c: f"_{c}" for c in _ROW})
    got = documents.join(sums, _same(documents, sums), "left")
    return got.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as rows with the columns of ``df``: for each document and pass, the words that the
    mix takes (whole texts as they are, else the taken words joined by single spaces)."""
    documents, pieces = mix(df, doc_id, text, source, block, per_shard, seed)
    spans = pieces.groupBy(*_ROW, "pass").agg(F.sum(F.col("to") - F.col("from")).alias("words"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in _ROW], "words", "spans")
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    rows = df.withColumns({"__tie": row_hash(df), "__size": F.size(words).cast("long"), "__doc_id": F.col(doc_id), "__source": F.col(source)})
    if documents.filter("dup > 1").limit(1).count():
        # equal rows: one of them stands for all, and meets the pieces of each
        rows = rows.dropDuplicates(["__doc_id", "__source", "__tie", "__size"])
    on = (F.col("__doc_id").eqNullSafe(F.col("_doc_id"))) & F.col("__source").eqNullSafe(F.col("_source")) & (F.col("__tie") == F.col("_tie")) & (F.col("__size") == F.col("_size"))
    got = rows.join(spans, on)
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " ")
    got = got.withColumn(text, F.when(F.col("words") == F.col("__size"), F.col(text)).otherwise(cut))
    if n_chars in df.columns:
        got = got.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType))
    return got.select(*[F.col(f"`{c}`") for c in df.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    return taken_words(*mix(table(spark, sf_dir, "documents")))
