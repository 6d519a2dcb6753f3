"""N-gram Jaccard self-join by signature trees, and the groups its links make.

Exact for any rational threshold. The work is spread in four steps:

1. Shingle sets. Each text gives its set of 64-bit shingle hashes; a fingerprint of the set
   stands for all documents with equal sets, so copies collapse before anything is compared.
2. Routing. Sets of similar size that link differ in at most D shingles, for sizes up to a
   band's limit. Shingles are dealt by hash to 1.6 (D + 1) parts, so linked sets agree as a
   whole on more than a third of them. Every part is a key; keys are counted, and each set
   keeps just the D + 1 rarest of its own, one of which it shares with all it links to. So
   passages that many documents have make keys that are counted, not compared.
3. Clusters. Fingerprints that share such a key are tied to the key's least one (a star: rows grow
   with members, not pairs); connected components of the stars are the clusters. Every link
   lies within one cluster.
4. Signature trees. A cluster is dealt to blocks of bounded weight. A block's sets become the
   leaves of a tree whose nodes hold the OR of their bitmaps, the range of their sizes and the
   most shingles a set has beyond one per bit. Trees are traversed in pairs: a node pair is
   pruned when its greatest possible overlap is too small for its least sizes, or when both
   sides are already connected as a whole. Leaf pairs that are left are intersected exactly.
   Only links that connect something are emitted, so n near copies cost about n links.

A cluster of several blocks is joined block by block together with the cluster's hub; then
only the sets outside its largest component meet the other blocks. Near copies connect in the
first step, so a cluster that holds a third of all rows costs one task per block. Texts are
read twice; only those of clusters are shuffled, as long as those are few enough to be told by a
broadcast of their hashes (CHOSEN).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, broadcast_if_small, table
from .graph import components

#: Shingles that the sets of one block hold at most (a longer set is a block of its own), and sets.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 4096
FANOUT, BITS = 16, 2048
#: A key with more than one in HEAVY of all key rows is counted by aggregates; there are fewer than HEAVY of them.
HEAVY, CELLS = 5000, 65_536
#: Rows (of two numbers) that are broadcast at most to choose texts by.
CHOSEN = 2_000_000

_RNG = np.random.Generator(np.random.PCG64(7))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UPPER = bytes(range(256)).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_powers_of: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """The first n powers of base; tables are kept and grown by doubling."""
    out = _powers_of.get(int(base))
    if out is None or len(out) < n:
        out = np.full(max(1024, 1 << n.bit_length()), base, np.uint64)
        out[0] = 1
        out = _powers_of[int(base)] = np.cumprod(out, dtype=np.uint64)
    return out[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many words each text has."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if begin.size and end.size and end[0] < begin[0]:
        end = end[1:]
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, stops), prepend=0)
    # polynomial hash of each word from prefix sums, made independent of its place by the inverse power
    out = np.empty(len(begin), np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    step = 1 << 16
    for a in range(0, len(begin), step):
        lo, hi = int(begin[a]), int(end[min(a + step, len(begin)) - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * powers(hi - lo, _BASE), out=sums[1:])
        back = powers(hi - lo, inverse)
        b, e = begin[a : a + step] - lo, end[a : a + step] - lo
        out[a : a + step] = (sums[e] - sums[b]) * back[b] + (e - b).astype(np.uint64)
    return mix(out), counts


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of n lower-cased words; with fewer
    words, all of them as one shingle; without words, none."""
    raw = [(t or "").encode().translate(_UPPER) for t in texts]
    words, counts = word_hashes(raw)
    out, at = [], 0
    weights = powers(n + 1, np.uint64(0xD1342543DE82EF95))
    for c in counts.tolist():
        w = words[at : at + c]
        at += c
        if not c:
            out.append(np.empty(0, np.uint64))
        elif c < n:
            out.append(mix((w * weights[1 : c + 1]).sum(keepdims=True) + np.uint64(c)))
        else:
            h = np.zeros(c - n + 1, np.uint64)
            for k in range(n):
                h += w[k : c - n + 1 + k] * weights[k + 1]
            out.append(np.unique(mix(h)))
    return out


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set (its size goes beside it wherever it is compared)."""
    return int((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))).astype(np.int64))


def edge(g: int) -> int:
    """Least size of band g: bands double every two."""
    return 2 ** (g // 2) if g % 2 == 0 else -(-(2 ** (g // 2)) * 141421356 // 100000000)


class Rule:
    """Link rule: b * |x & y| >= a * |x | y|."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def need(self, total):
        """Least overlap of two sets whose sizes sum to ``total``."""
        return -(-self.a * total // (self.a + self.b))

    def bands(self, size: int) -> list[tuple[int, int, int]]:
        """(band, differ, parts) for a set of ``size`` > 0. Band g is for links whose lesser set has
        edge(g) to edge(g + 1) - 1 shingles; a set is in its own band and in those below where it
        can link. differ: most shingles that the sets of such a link do not share."""
        g = 2 * (size.bit_length() - 1)
        g += size >= edge(g + 1)
        out = []
        while g >= 0 and self.a * size <= self.b * (less := edge(g + 1) - 1):
            if less >= edge(g):
                total = less + less * self.b // self.a
                differ = total * (self.b - self.a) // (self.a + self.b)
                out.append((g, differ, -(-8 * (differ + 1) // 5)))
            g -= 1
        return out

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Routing keys of a set, one per part that has shingles; how many rare ones are enough; and
        how many there are in the key's band.

        Sets of a link differ in at most ``differ`` parts. With K filled parts they share K - differ
        keys or more, so in any order of all keys the first shared one is among the first
        differ + 1 of either set. A set with too few filled parts for that sends keys for empty
        ones too, and all of them count.
        """
        keys, enough, have = [], [], []
        h = mix(s + np.uint64(0x2545F4914F6CDD1D))
        for g, differ, parts in self.bands(len(s)):
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.intp)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, h)
            filled = np.bincount(part, minlength=parts)
            k = mix(sums + filled.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + mix(np.arange(parts, dtype=np.uint64) + np.uint64(g << 32)))
            few = (filled > 0).sum() <= differ
            k = k if few else k[filled > 0]
            keys.append(k)
            enough.append(np.full(len(k), len(k) if few else differ + 1, np.int32))
            have.append(np.full(len(k), len(k), np.int32))
        return np.concatenate(keys).astype(np.int64), np.concatenate(enough), np.concatenate(have)


class Tree:
    """Signature tree over sets: leaves in order of size, FANOUT children a node.

    A level holds for each node the OR of its leaves' bitmaps, their least and greatest size,
    and their greatest slack (shingles of a set beyond one per bit)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        bits = np.zeros((len(sets), BITS), bool)
        for row, i in enumerate(self.order):
            bits[row, (sets[i] >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.intp)] = True
        sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        maps = np.packbits(bits, axis=1).view(np.uint64)
        self.levels = [(maps, sizes, sizes, sizes - bits.sum(1))]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, sl = self.levels[-1]
            cuts = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(sl, cuts)))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]

    def children(self, k: int, i: int) -> tuple[int, int]:
        """Nodes of level k - 1 below node i of level k; a tree too low for k stands still."""
        if k >= len(self.levels):
            return i, i + 1
        return i * FANOUT, min((i + 1) * FANOUT, len(self.levels[k - 1][0]))

    def leaves(self, k: int, i: int) -> list[int]:
        k = min(k, len(self.levels) - 1)
        return self.order[i * FANOUT**k : (i + 1) * FANOUT**k]


class Joined:
    """Union-find over the sets of up to two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def dual(x: Tree, y: Tree, rule: Rule, known: Joined, shift: int) -> Iterator[tuple[int, int]]:
    """Links between the sets of x and y that connect something not yet connected. The sets of
    x are numbers from 0 in ``known``, those of y from ``shift``; x is y for a self-join.

    Each step takes a node pair that survived and bounds all pairs of their children at once."""
    same = x is y
    stack = [(max(len(x.levels), len(y.levels)), 0, 0)]
    while stack:
        k, i, j = stack.pop()
        if k == 0:
            p, q = x.order[i], y.order[j] + shift
            if known.root(p) != known.root(q):
                s, t = x.sets[x.order[i]], y.sets[y.order[j]]
                if len(np.intersect1d(s, t, assume_unique=True)) >= rule.need(len(s) + len(t)):
                    known.join(p, q)
                    yield p, q
            continue
        if k < max(len(x.levels), len(y.levels)):
            r = known.root(x.leaves(k, i)[0])
            if all(known.root(u) == r for u in x.leaves(k, i)) and all(known.root(u + shift) == r for u in y.leaves(k, j)):
                continue
        (a, b), (c, d) = x.children(k, i), y.children(k, j)
        ma, la, ha, sa = (v[a:b] for v in x.level(k - 1))
        mb, lb, hb, sb = (v[c:d] for v in y.level(k - 1))
        # least sizes that can take part in a link, and the overlap that they need
        need = rule.need(np.maximum(la[:, None], -(-rule.a * lb // rule.b)) + np.maximum(lb, -(-rule.a * la[:, None] // rule.b)))
        most = np.minimum(np.minimum(ha[:, None], hb), np.bitwise_count(ma[:, None] & mb).sum(2, dtype=np.int64) + np.minimum(sa[:, None], sb))
        fits = (most >= need) & (rule.a * la[:, None] <= rule.b * hb) & (rule.a * lb <= rule.b * ha[:, None])
        for u, v in np.argwhere(fits)[::-1].tolist():
            u, v = u + a, v + c
            if not same or u < v or u == v and k > 1:
                stack.append((k - 1, u, v))


#: Texts that are held as sets at once.
TEXTS = 128


def signatures(batches: Iterator[pa.RecordBatch], n: int, rule: Rule, seen_limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (others..., text) as (others..., fp, n, keys, enough, have) (see Rule.keys); keys are null where
    this task gave them for an equal set already, so copies send no more rows than there are tasks."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            part = b.slice(at, TEXTS)
            fps, sizes, keys = [], [], []
            for s in shingle_sets(part.column("text").to_pylist(), n):
                fp = fingerprint(s)
                fps.append(fp)
                sizes.append(len(s))
                keys.append(None if (fp, len(s)) in seen or not len(s) else rule.keys(s))
                seen.add((fp, len(s)))
            lists = [pa.array([k and k[i] for k in keys], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            others = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *lists], [*others, "fp", "n", "keys", "enough", "have"])
        if len(seen) > seen_limit:
            seen.clear()


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of sorted rows, across batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        new = (b[keys] != b[keys].shift()).any(axis=1).to_numpy()
        if held and (held[-1][keys].iloc[-1].to_numpy() == b[keys].iloc[0].to_numpy()).all():
            new[0] = False
        cuts = [*np.flatnonzero(new).tolist(), len(b)]
        if cuts[0]:
            held.append(b.iloc[: cuts[0]])
        for x, y in zip(cuts, cuts[1:]):
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [b.iloc[x:y]]
    if held:
        yield pd.concat(held, ignore_index=True)


def block_links(batches: Iterator[pd.DataFrame], n: int, rule: Rule, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of each task: rows (keys, side, fp, text). Rows of side 0 meet those of side
    1; without side 0, those of side 1 meet one another."""
    for task in runs(batches, keys):
        task = task.drop_duplicates(["side", "fp"])
        sets = shingle_sets(list(task["text"]), n)
        right = [fingerprint(s) == f for s, f in zip(sets, task["fp"])]  # a repeated doc_id brings other texts along
        rows = [(side, fp, s) for side, fp, s, ok in zip(task["side"], task["fp"], sets, right) if ok]
        one, two = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        ids = [r[1] for r in one + two]
        known, tree = Joined(len(ids)), Tree([r[2] for r in two]) if two else None
        if one and two:
            found = list(dual(Tree([r[2] for r in one]), tree, rule, known, len(one)))
        else:
            found = list(dual(tree, tree, rule, known, 0)) if two else []
        yield pd.DataFrame({"a": np.array([ids[p] for p, _ in found], np.int64), "b": np.array([ids[q] for _, q in found], np.int64)})


def _tasks(rows: DataFrame, keys: list[str], n: int, rule: Rule) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(partial(block_links, n=n, rule=rule, keys=keys), "a long, b long")


def cluster_links(members: DataFrame, docs: DataFrame, n: int, rule: Rule, scratch: Scratch, block_sets: int, block_shingles: int) -> DataFrame:
    """Links that connect whatever links connect, of members (fp, n, cluster, doc_id, tie)."""
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).alias("blocks"), F.min("fp").alias("hub"))
    placed = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    # only texts whose hash a member has are exchanged, unless the members are too many to tell them by
    if members.count() <= CHOSEN:
        docs = docs.join(F.broadcast(members.select("tie").distinct()), "tie", "left_semi")
    # by id and hash of the text: ids may be null or repeated, and the hash deals them out evenly
    texts = docs.withColumnsRenamed({"doc_id": "id", "tie": "hash"}).hint("merge")
    placed = texts.join(placed, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tie"))).select("cluster", "blocks", "block", "hub", "fp", "n", "text")
    placed = scratch.keep(placed, "placed")
    # each block with itself and its cluster's hub, which ties the blocks of near copies together
    hubs = placed.filter("fp = hub and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = placed.select("cluster", "block", F.lit(1).alias("side"), "fp", "text").unionByName(hubs.select("cluster", "block", F.lit(1).alias("side"), "fp", "text"))
    links = scratch.keep(_tasks(first, ["cluster", "block"], n, rule), "links")
    if not placed.filter("blocks > 1").limit(1).count():
        return links
    # what is not connected to its cluster's largest component meets every other block
    many = placed.filter("blocks > 1").select("cluster", "blocks", "block", "fp", "n").distinct()
    roots = many.join(components(links, scratch).withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    body = roots.groupBy("cluster", "root").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("body"))
    rest = roots.join(body, "cluster").filter("root <> body")
    parts = rest.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).alias("parts"))
    rest = scratch.keep(rest.join(parts, "cluster").select("fp", "cluster", "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part")), "rest")
    one = placed.join(rest.select("fp", "part"), "fp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = placed.join(rest.select("cluster", "parts").distinct(), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keep = ["cluster", "part", "block", "side", "fp", "text"]
    pairs = one.withColumn("side", F.lit(0)).select(keep).unionByName(two.withColumn("side", F.lit(1)).select(keep))
    return scratch.keep(links.unionByName(_tasks(pairs, ["cluster", "part", "block"], n, rule)), "links")


def shared_keys(keyed: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(key, fp, enough, have, sets) of the keys that several sets have; ``sets`` orders keys by how
    many rows they have.

    Rows go to tasks by key. A key that near copies share may have a third of all rows: such keys
    are found first, by counts of hash cells and then of the full cells' keys, and theirs are
    counted by aggregates that combine before the exchange."""
    rows = keyed.select("fp", F.inline(F.arrays_zip("keys", "enough", "have"))).withColumnRenamed("keys", "key")
    cell = F.pmod("key", F.lit(CELLS))
    counts = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("c")).collect()  # at most CELLS numbers
    limit = sum(r.c for r in counts) // heavy
    full = [r.cell for r in counts if r.c > limit and r.c > heavy]
    many = []
    if full:
        found = rows.filter(cell.isin(full)).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > limit)
        many = [(r.key, r.c) for r in found.collect()]  # fewer than ``heavy``
    hot = F.broadcast(keyed.sparkSession.createDataFrame(many, "key long, sets long"))
    rest = rows.join(hot, "key", "left_anti") if many else rows
    # one sort serves both: equal rows of several tasks follow one another, and a key's rows are together
    before = F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))
    rest = rest.repartition("key").withColumn("before", before).filter("before IS NULL OR before <> fp").drop("before")
    rest = rest.withColumn("sets", F.count("*").over(Window.partitionBy("key"))).filter("sets > 1")
    if not many:
        return rest
    # copies of one set in many tasks may make a key of one set look hot: it is tied to itself, which does nothing
    return rest.unionByName(rows.join(hot, "key").groupBy("key", "fp", "enough", "have").agg(F.max("sets").alias("sets")))


def groups_of(docs: DataFrame, n: int, rule: Rule, scratch: Scratch, block_sets: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text, tie) the rows (doc_id, tie, fp, n) and, per fp of a set that isn't empty,
    (fp, group, component_id)."""

    kind = StructType([docs.schema["doc_id"], *StructType.fromDDL("tie long, fp long, n long, keys array<long>, enough array<int>, have array<int>")])
    keyed = scratch.keep(docs.select("doc_id", "tie", "text").mapInArrow(partial(signatures, n=n, rule=rule), kind), "keyed")
    signed = scratch.keep(keyed.select("doc_id", "tie", "fp", "n"), "signed")
    filled = signed.filter("n > 0")
    # of each set only as many of its rarest keys as are enough; keys of its own come first
    own = Window.partitionBy("fp", "enough", "have")
    shared = shared_keys(keyed).withColumns({"rank": F.row_number().over(own.orderBy("sets", "key")), "common": F.count("*").over(own)})
    rare = scratch.keep(shared.filter("rank + have - common <= enough").select("key", "fp"), "rare")
    # what shares a rare key is tied to the least of those that do
    hubs = rare.groupBy("key").agg(F.min("fp").alias("a"))
    ties = scratch.keep(rare.join(hubs, "key").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct(), "ties")
    scratch.drop(keyed)
    clusters = components(ties, scratch).withColumnsRenamed({"node": "fp", "root": "cluster"})
    sets = filled.groupBy("fp").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min_by("tie", F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("tie"))
    members = scratch.keep(sets.join(clusters, "fp"), "members")
    links = cluster_links(members, docs, n, rule, scratch, block_sets, block_shingles)
    # components of the links, named by their least document
    groups = components(links, scratch).withColumnsRenamed({"node": "fp", "root": "group"})
    named = sets.join(groups, "fp", "left").select("fp", "doc_id", F.coalesce("group", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return signed, scratch.keep(named.join(least, "group").select("fp", "group", "component_id"), "named")


def jaccard_groups(df: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text", block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of ``df``.

    A document's set is its distinct n-word shingles (words lower-cased in A-Z); with fewer
    words, all as one shingle. Two documents link when b * intersection >= a * union for the
    threshold (a, b); component_id is the least doc_id that links reach. Null and wordless
    texts have empty sets and link with nothing; long texts give whole sets. Rows with a null
    doc_id take part in links, but lend no id: without any other id in reach their component is
    null. Repeated ids give a row each. An empty table gives an empty result; other columns are
    not read, whatever their names.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    signed, named = groups_of(docs, n, Rule(*threshold), Scratch(df.sparkSession), block_sets, block_shingles)
    got = signed.select("doc_id", "fp", "n").join(named, "fp", "left")
    return got.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each group that links make, one row stays, the
    one with the least doc_id (null last; of those with that id the one with the least text hash).
    Rows without words stay all. Ids may be null or repeated, and rows may be equal in both.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    signed, named = groups_of(docs, n, Rule(*threshold), scratch, BLOCK_SETS, BLOCK_SHINGLES)
    rows = signed.filter("n > 0").join(named.select("fp", "group"), "fp").groupBy("group", "doc_id", "tie").agg(F.count("*").alias("rows"))
    rows = scratch.keep(rows, "grouped")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("s"))
    rows = rows.join(first, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("tie") == F.col("s.tie")))
    rows = scratch.keep(rows.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "rows", "stays"), "stays")
    gone, again = rows.filter("NOT stays").select("__id", "__tie"), rows.filter("stays AND rows > 1").limit(1).count()
    gone = broadcast_if_small(gone, gone.count(), CHOSEN)
    kept = df.join(gone, F.col(f"`{doc_id}`").eqNullSafe(gone["__id"]) & (F.xxhash64(text) == gone["__tie"]), "left_anti")
    if not again:
        return kept
    # equal rows: one of each id and text that has words stays
    several = rows.filter("stays AND rows > 1").select("__id", "__tie")
    several = scratch.keep(several, "several")
    few = broadcast_if_small(several, several.count(), CHOSEN)
    on = F.col(f"`{doc_id}`").eqNullSafe(few["__id"]) & (F.xxhash64(text) == few["__tie"])
    return kept.join(few, on, "left_anti").unionByName(kept.join(few, on, "left_semi").dropDuplicates([doc_id, text]))


def op5(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), n=3, threshold=(90, 100))


def oracle_sql(n: int = 3, a: int = 90, b: int = 100) -> str:
    """DuckDB: exact pairs through shared shingles, then the least id reachable."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN []::VARCHAR[] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) END AS s FROM w),
reps AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sh WHERE len(s) > 0 GROUP BY list_sort(s)),
sets AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM reps),
pair AS (SELECT x.rep AS p, y.rep AS q, any_value(x.n) AS xn, any_value(y.n) AS yn, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.rep < y.rep AND {a} * x.n <= {b} * y.n AND {a} * y.n <= {b} * x.n GROUP BY ALL),
link AS (SELECT p, q FROM pair WHERE {b} * c >= {a} * (xn + yn - c)),
edge AS (SELECT p, q FROM link UNION ALL SELECT q, p FROM link),
walk AS (SELECT rep AS node, rep AS seen FROM reps UNION SELECT walk.node, edge.q FROM walk JOIN edge ON walk.seen = edge.p),
root AS (SELECT node, min(seen) AS root FROM walk GROUP BY node)
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(root.root, sh.doc_id) AS component_id
FROM sh LEFT JOIN reps ON len(sh.s) > 0 AND reps.s = list_sort(sh.s) LEFT JOIN root ON root.node = reps.rep
"""
