"""Operators of the training-data subpackage against brute force on small tables."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from perusal.llm import crf, decontaminate, html_text, jaccard_join, mixture, quality_rules, secret_scan, token_counts, token_output, toxicity
from perusal.llm.graph import components
from perusal.llm.common import Scratch
from perusal.llm.permute import permuted

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
needs_tokens = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizer files")


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def odd_docs(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a long text, an extra column."""
    long = " ".join(words(random.Random(5), 30_000))
    rows = [(1, None, None, None, None), (None, "a b c d", "en", "s", 7), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 3), (4, "x y z", "de", "s", 5), (4, "x y z", "de", "s", 5), (4, "other words here", "de", "t", 16), (5, long, "en", "s", len(long)), (6, "!!! 123", "fr", "t", 7)]
    return spark.createDataFrame(rows, DOC).withColumn("kept", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("n_words", F.lit(None).cast("int"))


def empty(spark):
    return spark.createDataFrame([], DOC)


# quality rules


def base_counts(t):
    w = (t or "").encode().split()
    w = [x.decode() for x in w]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in win if win.count(x) > 1}
    covered = {i + k for i, x in enumerate(win) if x in twice for k in range(3)}
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a a a a", "x\nx\n \nx", "é # é\x0b*|"] + ["\n".join(" ".join(words(rng, rng.randrange(0, 40), p)) for _ in range(4)) for p in (2, 5, 30)] + [" ".join(words(rng, 300, 6)), " ".join(f"q{i % 90}" for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.with_counts(df).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}


def test_quality_sketch(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b")).withColumn("top", quality_rules.bucket_top(F.col("b")))
    for r in df.collect():
        assert r.v <= r.top <= r.v + max(0, r.v // 32)


def test_quality_rules_handle_anything(spark):
    got = quality_rules.quality_rules(odd_docs(spark)).collect()
    assert len(got) == 9 and not any(r.kept for r in got if r.n_words < 50) and quality_rules.quality_rules(empty(spark)).count() == 0
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 80)) + ("" if i else " ###" * 40), "en", "s", 1) for i in range(60)]
    got = {r.doc_id: (r.kept, r.failed_rules) for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert got[0][0] is False and "symbol_rate" in got[0][1] and all(v[0] for k, v in got.items() if k)


def brute_quality(rows, least):
    """kept of (text, lang, source) rows, with a sketch of six leading bits."""
    rates = []
    for t, *_ in rows:
        n, chars, symbols, dup, repeated = base_counts(t)
        lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r"))
        upper, letters = sum("A" <= c <= "Z" for c in t or ""), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in t or "")
        rates.append((n < 50 or 100 * repeated > 50 * n, [(k, max(u, 1)) for k, u in ((symbols, chars), (dup, lines), (repeated, n), (upper, letters), (chars, n))]))

    def top(v):
        step = 2 ** max(v.bit_length() - 6, 0)
        return v // step * step + step - 1

    def kept(i):
        bad, own = rates[i]
        levels = [[j for j, r in enumerate(rows) if not rates[j][0] and r[3 - w : 3] == rows[i][3 - w : 3]] for w in (2,)] + [[j for j, r in enumerate(rows) if not rates[j][0] and r[1] == rows[i][1]], [j for j in range(len(rows)) if not rates[j][0]]]
        group = next((g for g in levels[:2] if len(g) >= least), levels[2])
        for x in range(5):
            vs = sorted(1000 * rates[j][1][x][0] // rates[j][1][x][1] for j in group)
            q10, q25, q75, q90 = (top(vs[-(-len(vs) * q // 100) - 1]) for q in (10, 25, 75, 90))
            hi, lo, (k, u) = q90 + 15 * (q90 - q75) // 2, max(q10 - 15 * (q25 - q10) // 2, 0), own[x]
            for over, f in ((k - u * hi / 1000, hi), (u * lo / 1000 - k, lo)):
                if over > 0 and over > 3 * (u * f / 1000 + 1) ** 0.5 + 1e-9:
                    return False
        return not bad

    return [kept(i) for i in range(len(rows))]


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(31)
    rows = []
    for i in range(160):
        w = words(rng, rng.randrange(40, 160), 4000)
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, None)])
        for _ in range(rng.choice([0, 0, 0, 0, 1, 30])):
            w[rng.randrange(len(w))] = rng.choice(["#", "|*|", "LOUD", "averyverylongword" * 3, "w1 w2 w3"])
        w += ["x y"] * (60 * (i % 29 == 0))
        rows.append(("\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), lang, source))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(5)
    for least in (20, 1000):
        want = brute_quality(rows, least)
        got = {r.doc_id: (r.kept, r.base_failed or bool(r.failed_rules)) for r in quality_rules.quality_rules(df, min_docs=least).collect()}
        assert [got[i][0] for i in range(160)] == want and all(k != out for k, out in got.values()) and 100 < sum(want) < 155


# token counts


@needs_tokens
def test_token_counts(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(3)
    bits = ["'s", "'re", "'ll", "'", "r", "e", " ", "  ", "\n", "a", "B", "é", "1", "²", "!", "<|endoftext|>", "　", "中", "😀", "\x1c", "\x85", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 3000, " " * 500 + "x", "ab" * 2000, "", None]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, P.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024), repr(t)
    assert token_counts.token_counts(empty(spark), P.path("byte_bpe_50k.json")).count() == 0 and token_counts.token_counts(odd_docs(spark), P.path("byte_bpe_50k.json")).count() == 9


@needs_tokens
def test_transducer_survives_its_memory_bounds():
    import public_tokenizers as P

    from perusal.llm.transducer import Compiled

    big, small = Compiled(P.path("byte_bpe_50k.json")), Compiled(P.path("byte_bpe_50k.json"), most_pieces=5)
    small.merger.most = 10
    texts = [" ".join(words(random.Random(i), 30)) for i in range(20)]
    assert big.counts(texts) == [small.counts([t])[0] for t in texts]


# decontamination


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_against_full_alignment():
    rng = random.Random(4)
    items = {i: " ".join(words(rng, 40)) for i in range(4)}
    index = decontaminate.Passages(list(items.items()))
    for _ in range(40):
        t = list(items[rng.randrange(4)])
        for _ in range(rng.randrange(25)):
            k, what = rng.randrange(len(t)), rng.random()
            t[k : k + (what < 0.7)] = [] if what < 0.3 else [rng.choice("abc")]
        doc = decontaminate.normalise(" ".join(words(rng, 20)) + " " + "".join(t) + " " + " ".join(words(rng, 20)))
        want = {index.of[i] for i, p in enumerate(index.text) if distance(p, doc) <= index.edits[i]}
        assert {m[0] for m in index.find(["", doc, "x"])[1]} == want


def test_decontamination_handles_anything(spark):
    rng = random.Random(6)
    passage = " ".join(words(rng, 30))
    bench = spark.createDataFrame([(7, passage), (8, None), (9, "short"), (None, passage)], "item_id long, text string")
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(10, "Before. " + passage.upper() + " after", "en", "s", 1, "k", 1, 1)], DOC + ", kept string, score int, n_words int"))
    left = decontaminate.decontaminated(docs, bench)
    assert left.count() == 9 and left.columns == docs.columns
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == 10 and decontaminate.matches(empty(spark), bench).count() == 0
    chunked = decontaminate.matches(docs, bench, limit=10).filter("doc_id = 10").first().matches
    assert [m.item_id for m in chunked] == [7]


def test_decontamination_beside_empty_texts():
    rng = random.Random(21)
    item = decontaminate.normalise(" ".join(words(rng, 14)))
    index = decontaminate.Passages([(1, item)])
    for _ in range(300):
        t = list(item[:64])
        for _ in range(rng.randrange(5)):
            t[rng.randrange(64)] = rng.choice("xyz")
        texts = [""] * rng.randrange(14) + ["".join(t)] + [rng.choice(["", "a"])] * rng.randrange(9)
        got = index.find(texts)
        assert [bool(x) for x in got] == [any(distance(p, t) <= e for p, e in zip(index.text, index.edits)) for t in texts]


def test_decontamination_of_repetitive_text(monkeypatch):
    again, other = decontaminate.normalise("a " * 2000), "abcabcabd" * 40
    index = decontaminate.Passages([(i, again) for i in range(5)] + [(7, other), (8, "z" * 200)])
    got = index.find(["q" * 1_000_000, "a " * 20_000, "abcabcabc" * 4000, "z" * 100_000, "z" * 59, other[3:70], ""], True)
    assert [sorted(m[0] for m in x) for x in got] == [[], [0, 1, 2, 3, 4], [], [8], [], [7], []]
    assert all(m[1:] == (247, 0, 0, 65) for m in got[1])
    # small steps and parts find what large ones do
    rng = random.Random(22)
    texts = ["".join(rng.choice(["a ", "a ", "b", other[:80], again[:70], "z" * 66]) for _ in range(rng.randrange(60))) for _ in range(25)]
    whole = [index.find([t], True)[0] for t in texts]
    monkeypatch.setattr(decontaminate, "HITS", 500)
    monkeypatch.setattr(decontaminate, "STRIDE", 400)
    assert index.find(texts, True) == whole


def test_decontamination_in_chunks_against_full_alignment(spark):
    rng = random.Random(23)
    items = [(i, " ".join(words(rng, 25))) for i in range(6)]
    docs = []
    for i in range(30):
        w = items[i % 6][1]
        t = list(w[rng.randrange(20) :]) if i % 3 else list(" ".join(words(rng, 30)))
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t))] = rng.choice("abc")
        docs.append((i, "".join(t)))
    bench, df = spark.createDataFrame(items, "item_id long, text string").coalesce(1), spark.createDataFrame(docs, "doc_id long, text string")
    index = decontaminate.Passages(items)
    want = {(d, index.of[k]) for d, t in docs for k, p in enumerate(index.text) if distance(p, decontaminate.normalise(t)) <= index.edits[k]}
    for limit in (10, 300, 10**6):
        rows = decontaminate.matches(df, bench, limit=limit).collect()
        assert len(rows) == 30 and {(r.doc_id, m.item_id) for r in rows for m in r.matches} >= want
        sure = {(r.doc_id, m.item_id) for r in rows for m in r.matches if m.n_passages > 1}
        assert sure <= want
    monkey = decontaminate.CHUNK
    try:
        decontaminate.CHUNK = 10
        left = decontaminate.decontaminated(df, bench)
    finally:
        decontaminate.CHUNK = monkey
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if not r.matches} and left.columns == df.columns


def test_decontamination_of_any_start_and_short_items(spark):
    rng = random.Random(7)
    item = "".join(rng.choice("abcdefghij ") for _ in range(300))
    item = decontaminate.normalise(item)
    index = decontaminate.Passages([(1, item), (2, "What is 2+2?"), (3, "cat"), (4, "什么是水"), (5, "cat")])
    noise = " ".join(words(rng, 60))
    for s in range(0, len(item) - 64):
        quote = item[s : s + 64].strip()
        if len(quote) == 64:
            assert [m[0] for m in index.find([noise, f"{noise} {quote}zz {noise}"], True)[1]] == [1], s
            worn = quote[:20] + quote[21:40] + "#" + quote[41:]
            assert [m[0] for m in index.find([noise, f"{noise} {worn}zz {noise}"], True)[1]] == [1], s
    assert index.find([noise + item[3:55] + noise, ""], True) == [[], []]
    got = index.find(["so, (what is 2+2?) a cat", "concat cats what is 2+2?x", "请问什么是水呢", "cat"])
    assert [[m[0] for m in x] for x in got] == [[2, 3, 5], [2], [4], [3, 5]] and got[0][0] == (2, 1, 0, 5, 17)
    bench = spark.createDataFrame([(None, item), (5, "Who is he?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, noise + " " + item), (2, "he asked: who is he?"), (3, noise), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()) == [3, 4]


# Jaccard join


def brute_groups(texts, n, a, b):
    lower = lambda t: (t or "").encode().translate(bytes(range(256)).lower()).split()
    sets = {}
    for i, t in texts.items():
        w = lower(t)
        sets[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and b * len(sets[i] & sets[j]) >= a * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def near_texts(seed, n=70):
    rng, out = random.Random(seed), []
    common = words(rng, 30)
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.7:
            w = rng.choice(out)[:]
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            w = w[: len(w) - rng.randrange(3)] or ["z"]
        else:
            w = words(rng, rng.choice([1, 2, 3, 4, 7, 15, 60, 200])) + (common if kind > 0.85 else [])
        out.append(w)
    return dict(enumerate(" ".join(w) for w in out)) | {1000: None, 1001: "", 1002: "\n"}


@pytest.mark.parametrize(("n", "a", "sizes"), [(3, 90, (4096, 10**6)), (5, 80, (4096, 10**6)), (5, 80, (5, 10**6)), (2, 60, (3, 500))])
def test_jaccard_groups(spark, n, a, sizes):
    texts = near_texts(n * a)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, n, (a, 100), block_sets=sizes[0], block_shingles=sizes[1]).collect()}
    assert got == brute_groups(texts, n, a, 100)


def test_jaccard_handles_anything(spark):
    df = odd_docs(spark)
    assert jaccard_join.jaccard_groups(df).count() == 9 and jaccard_join.jaccard_groups(empty(spark)).count() == 0
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in kept.collect()) == [(-1, "a b c"), (1, ""), (2, ""), (3, " \n\t "), (4, "other"), (4, "x y z"), (5, df.filter("doc_id = 5").first().text[:5]), (6, "!!! 1")]


def test_one_of_each_with_null_and_repeated_ids(spark):
    rng = random.Random(51)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    rows = [(None, a), (None, a), (None, a + " x"), (7, b), (7, b + " y"), (7, b), (3, c), (None, c), (9, c + " z"), (None, None), (None, ""), (7, "only one")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect()), key=repr)
    alike = lambda t, u: (t or "").startswith(u)
    assert len(got) == 6 and sum(alike(t, a) for _, t in got) == 1 and (3, c) in got and (None, None) in got and (None, "") in got and (7, "only one") in got
    assert [i for i, t in got if alike(t, b)] == [7]


def test_hot_keys_give_the_same_groups(spark, monkeypatch):
    texts = near_texts(77) | {2000 + i: f"{'same words again and again here ' * 3}{i}" for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(jaccard_join.shared_keys, "__defaults__", (60,))
    monkeypatch.setattr(jaccard_join, "CHOSEN", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()}
    assert got == brute_groups(texts, 5, 80, 100)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in edges:
        up[max(root(x), root(y))] = min(root(x), root(y))
    df = spark.createDataFrame(edges, "a long, b long").filter("a <> b").repartition(5)
    got = {r.node: r.root for r in components(df, Scratch(spark)).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# mixture


def test_permutation(spark):
    for n in (1, 2, 3, 64, 65, 1000):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(got) == list(range(n))


def water(sizes, weights):
    total, capped, out = 1.5 * sum(sizes), set(), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(2 * sizes[i] for i in capped)
        out = {i: (2 * sizes[i] if i in capped else left * weights[i] / sum(weights[j] for j in free)) for i in range(len(sizes))}
        over = [i for i in free if out[i] > 2 * sizes[i] + 1e-9]
        if not over:
            return out
        capped.update(over)


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.choice([0, 5, 40, 700]))), "en", rng.choice(["b", "a", "a", "a", None, "c"]), 0) for i in range(150)]
    rows += [(i, *rows[3][1:]) for i in (3, 3)]
    df = spark.createDataFrame(rows, DOC)
    docs, pieces = mixture.mix(df, block=16, per_shard=64)
    got = mixture.taken_words(docs, pieces).withColumn("again", F.lit(1)).collect()
    twice = mixture.taken_words(*mixture.mix(df.repartition(7), block=16, per_shard=64)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(map(tuple, twice)) and len(got) == len(rows)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[3] == s) for s in names]
    want = dict(zip(names, water(sizes, [3, 1, 2, 3]).values()))
    per = {s: sum(r.taken for r in docs_of(spark, docs, pieces, s)) for s in names}
    for s in names:
        assert abs(per[s] - want[s]) <= 1
    assert all(r.taken <= 2 * r.size for r in got)
    mixed = mixture.mixed_texts(df, block=16, per_shard=64)
    assert mixed.columns == df.columns and sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)


def docs_of(spark, docs, pieces, source):
    return mixture.taken_words(docs.filter(F.col("source").eqNullSafe(source)), pieces).collect()


def test_draws_are_multinomial_given_their_sums():
    quota = np.array([500, 0, 1301, 7])
    whole = list(mixture.draws(quota, 50, 0, 37, 3))
    assert [x[0] for x in whole] == list(range(37)) and sum(x[2] for x in whole).tolist() == quota.tolist()
    assert all(c.sum() == min(50, 1808 - 50 * j) for j, _, c in whole) and all((b == sum(x[2] for x in whole[:j])).all() for j, b, _ in whole[1:])
    some = list(mixture.draws(quota, 50, 11, 19, 3))
    assert [(j, b.tolist(), c.tolist()) for j, b, c in some] == [(j, b.tolist(), c.tolist()) for j, b, c in whole[11:19]]
    # a shard's counts spread as a draw's do
    first = np.array([next(iter(mixture.draws(quota, 50, 0, 1, s)))[2] for s in range(400)])
    assert abs(first.mean(0) - 50 * quota / 1808).max() < 1 and 2 < first[:, 0].std() < 5
    big = np.array([10**12, 3 * 10**11, 5, 0])
    for part in (1, 10**6, 10**12):
        got = mixture.split(big, part, [1, 2, 3])
        assert got.sum() == part and (got >= 0).all() and (got <= big).all() and abs(got[0] / part - 10 / 13) < max(0.01, 1 / part)


def test_mix_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixture, "COPIES", 7)
    rows = [(1, "one two three four five", "en", "a", 23)] * 60 + [(2, "six seven", "en", "a", 9), (3, "x " * 400, "en", "b", 800)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    got = mixture.taken_words(*mixture.mix(df, block=4, per_shard=8, bucket_rows=9)).collect()
    assert len(got) == 62 and sum(r.doc_id == 1 for r in got) == 60 and all(r.taken <= 2 * r.size for r in got)
    for ids in ((1, 2), (3,)):
        assert abs(sum(r.taken for r in got if r.doc_id in ids) - next(r.target for r in got if r.doc_id in ids)) <= 1
    mixed = mixture.mixed_texts(df, block=4, per_shard=8).collect()
    assert sum(len(r.text.split()) for r in mixed if r.doc_id != 3) == sum(r.taken for r in got if r.doc_id != 3)


def test_mix_handles_anything(spark):
    df = odd_docs(spark)
    got = mixture.taken_words(*mixture.mix(df)).collect()
    assert len(got) == 9 and mixture.mixed_texts(df).columns == df.columns and mixture.taken_words(*mixture.mix(empty(spark))).count() == 0


# token output


@needs_tokens
def test_token_output_round_trip(spark, tmp_path, monkeypatch):
    import public_tokenizers as P

    rng = random.Random(10)
    rows = [(i, " ".join(words(rng, rng.randrange(60)))) for i in range(200)] + [(None, "no id"), (7, None), (8, ""), (9, "again"), (9, "again"), (11, "a <|no special token|> and <|endoftext|>")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    for source in (df, df.orderBy(F.desc("doc_id"))):
        out = f"{tmp_path}/out-{hashlib.md5(str(source).encode()).hexdigest()}-{source is df}"
        m = token_output.materialise(source, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50256, f"file://{out}", length=32, shard_slots=50)
        index = sorted(m.index.collect(), key=lambda r: r.sequence)
        assert sorted(r.slot for r in index) == list(range(m.total)) and [r.slot for r in index] != list(range(m.total))
        stream = []
        for r in index:
            shard, at = m.place(r.slot)
            assert (shard, at) == (r.shard, r.byte_offset)
            (name,) = [f for f in os.listdir(f"{out}/shard={shard}") if f.startswith("part-")]
            data = open(f"{out}/shard={shard}/{name}", "rb").read()
            assert len(data) % m.stride == 0
            stream += np.frombuffer(data[at : at + 64], "<u2")[: r.n_tokens].tolist()
        enc = token_output.encoding(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
        texts, part = [], []
        for t in stream:
            if t == 50256:
                texts.append(enc.decode(part))
                part = []
            else:
                part.append(t)
        assert sorted(texts) == sorted(t for _, t in rows if t) and not part
        assert {i for r in index for i in r.doc_ids} >= {r[0] for r in rows if r[1] and r[0] is not None}
    # ids of another type, and more shards than tasks that write them
    monkeypatch.setattr(token_output, "MOST_TASKS", 3)
    named = df.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text", F.lit(1).alias("part"), F.lit(2).alias("n"))
    m = token_output.materialise(named, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 70_000, f"file://{tmp_path}/wide", length=16, shard_slots=10)
    rows_ = m.index.collect()
    assert m.stride == 65 and {i for r in rows_ for i in r.doc_ids} == {f"d{r[0]}" for r in rows if r[1] and r[0] is not None} | {None}
    wide = []
    for r in sorted(rows_, key=lambda r: r.sequence):
        (name,) = [f for f in os.listdir(f"{tmp_path}/wide/shard={r.shard}") if f.startswith("part-")]
        data = open(f"{tmp_path}/wide/shard={r.shard}/{name}", "rb").read()
        wide += np.frombuffer(data[r.byte_offset : r.byte_offset + 64], "<u4")[: r.n_tokens].tolist()
    cut = lambda ids, end: sorted(x.strip() for x in " ".join(map(str, ids)).split(f" {end}"))
    assert cut(wide, 70_000) == cut(stream, 50256) and len({r.shard for r in rows_}) > 50
    assert not token_output.plain_scan(df.filter(F.rand() < 0.5)) and not token_output.plain_scan(df.orderBy("doc_id")) and token_output.plain_scan(df.filter("doc_id > 3"))
    nothing = token_output.materialise(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50256, f"file://{tmp_path}/none")
    assert nothing.total == 0 and nothing.index.count() == 0


# language


def lang_rows(rng, n=240):
    ends = {"en": ["tion", "ing", "the"], "de": ["ung", "keit", "sch"], "fr": ["eaux", "ment", "ère"]}
    return [(" ".join("".join(rng.choice("abdeklmor") for _ in range(3)) + rng.choice(e) for _ in range(rng.randrange(3, 20))), y) for y, e in ends.items() for _ in range(n // 3)]


def logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def test_crf_marginals_and_accuracy(spark):
    rng = random.Random(11)
    model = crf.fit(lang_rows(rng))
    for n in (1, 2, 31, 33, 70):
        chain = crf.words_of(" ".join(t for t, _ in lang_rows(rng, 30)))[:n]
        s = model.known.of(chain)
        a, b = [s[0]], [np.zeros(3)]
        for k in range(1, len(s)):
            a.append(s[k] + logsumexp(a[-1][:, None] + model.move, 0))
        for k in range(len(s) - 2, -1, -1):
            b.insert(0, logsumexp(model.move + (s[k + 1] + b[0])[None], 1))
        p = np.exp(np.array(a) + np.array(b) - logsumexp(a[-1], 0))
        score, live = np.zeros((2, 80, 3)), np.zeros((2, 80), bool)
        score[0, :n], live[0, :n], live[1, 0] = s, True, True
        got, pairs = crf.posteriors(score, live, model.move)
        assert np.allclose(got[0, :n], p, atol=1e-9) and np.isclose(pairs.sum(), n - 1)
        assert np.allclose(model.marginals([[], chain, []])[1], p, atol=1e-9)
    test = lang_rows(random.Random(12))
    got = model.predict([t for t, _ in test])
    assert np.mean([g[0] == y for g, (_, y) in zip(got, test)]) > 0.95
    mixed = model.predict(["abdtion kortion lortion merting " + "abdung korkeit lorsch merung dorkeit"])[0][2]
    assert mixed[:3] == ["en"] * 3 and mixed[-3:] == ["de"] * 3
    out = {r.doc_id: (r.lang_pred, r.score) for r in crf.identify(odd_docs(spark), model).collect()}
    assert out[1][0] == out[2][0] == out[3][0] == out[6][0] == "und" and all(0 <= s <= 1 for _, s in out.values())
    assert crf.identify(odd_docs(spark), crf.fit([])).filter("lang_pred = 'und'").count() == 9 and crf.identify(empty(spark), model).count() == 0


def test_crf_sample_has_every_label(spark):
    rows = [(i, f"word{i} again", "en") for i in range(2000)] + [(None, "same text", "en")] * 50 + [(5000 + i, f"wort{i}", "de") for i in range(30)] + [(6000, "unique", "xx"), (6001, None, "yy"), (6002, "unlabelled", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = crf.sample(df, "text", "lang", "doc_id", most=100)
    of = {y: [t for t, z in got if z == y] for y in ("en", "de", "xx")}
    assert sum(map(len, of.values())) == len(got) and of["xx"] == ["unique"] and len(of["de"]) == 30 and len(of["en"]) == len(set(of["en"])) == crf.LEAST_EACH
    assert got == crf.sample(df.repartition(3), "text", "lang", "doc_id", most=100) and len(crf.sample(df, "text", "lang", "doc_id", most=1500)) == 1500
    assert crf.sample(empty(spark), "text", "lang", "doc_id") == []


def test_held_out(spark):
    got = spark.range(50).select("id", crf.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


# html


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One<p>Two <b>x</b>y", "One\n\nTwo xy"), ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol>", "- a\n- b\n  - c\n\n3. x\n4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>z<td>12</table>", "Name       Qty\napple pie  3\nz          12"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<pre>\n a\n   b</pre>", "\n a\n   b"),
        ("<head><title>t</title></head><body>x<script>var a='</p>'</script><style>p{}</style><div hidden>n</div><p style='display:none'>n</p>y", "xy"), ("<!-- c -->a &amp;lt; &copy;<!doctype x>b", "a &lt; ©b"),
        ("<div>a</div><div>b</div><blockquote>q<br>r</blockquote>", "a\nb\n\n> q\n> r"), ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"), ("<img alt='pic'> <q>s</q>", 'pic "s"'), ("", ""), (None, ""), ("<", "<"), ("a < b <c", "a < b"), ("<p><b>x<br><p>y</p></b>", "x\n\ny"),
    ],
)
def test_html(html, want):
    assert html_text.html_to_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<head><title>t</title>Hello <b>x</b>", "Hello x"), ("<head><title>t</title><b>x</b> y", "x y"), ("<head> <meta charset=x><style>p{}</style> <img alt=pic>z", "picz"), ("<head><noscript><img alt=n></noscript><title>t</title></head>x", "x"),
        ("a <select><option>b<option selected>c</select> d", "a c d"), ("<select><option>b<option>c</select>", "b"), ("<select multiple><option>b<option label=l>c</select>", "b\nl"),
        ("<textarea>\none &amp; <b></textarea>", "one & <b>"), ("<textarea>x\n  y</textarea>z", "x\n  y\nz"), ("<input type=submit value=Send> <input type=hidden value=n><input placeholder=Name><input type=checkbox value=on>", "Send Name"),
        ("a <math><mfrac><mi>x</mi> <mn>2</mn></mfrac><mo>=</mo><msup><mi>y</mi><mn>3</mn></msup><annotation>tex</annotation></math>", "a x/2=y^3"), ("<svg><title>t</title><defs><text>n</text></defs><path d=a /><text>one</text><text>two</text></svg> b", "one two b"), ("<div><svg><defs></div>rest", "rest"), ("<svg><title/><text>a</text></svg>", "a"),
    ],
)
def test_html_fields_drawings_and_open_heads(html, want):
    assert html_text.html_to_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><tr><td>x<td rowspan=3>y<tr><td>z<tr><td>w<td>v</table>", "x  y\nz\nw     v"), ("<table><tr><td colspan=900>a<td>b<tr><td>c<td colspan=899><td>d</table>", "a    b\nc    d"),
        ("a<span style='visibility:hidden'>b<i style='visibility: visible'>c</i>d</span>e", "ace"), ("<div style='visibility:hidden'><p>n<ul><li style='visibility:visible'>x<li>y</ul></div>z", "- x\n\nz"), ("<div style='display:none'><b style='visibility:visible'>n</b></div>z", "z"),
        ("<details>n<summary>s</summary>n</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
        ("<style>.a,#b{display:none} p.c{visibility:hidden} i{color:red}@media print{.d{display:none}}</style><p class='x a'>n<p id=b>n<p class=c>n<div class=c>y</div><p class=d>z<p class=a style='display:block'>w", "y\n\nz\n\nw"),
        ("<style>b{display:none}b{display:inline}</style><b>x</b>", "x"), ("<style media=print>b{display:none}</style><b>x</b>", "x"), ("<style>{}}{ b {display:none", ""), ("<ul>" + "<li>a<ul>" * 60 + "<li>z", None),
    ],
)
def test_html_visibility_and_spans(html, want):
    got = html_text.html_to_text(html)
    assert got == want if want is not None else got.endswith("- z") and max(map(len, got.split("\n"))) < 100


def page(rng, depth, lists):
    """A random page part: HTML, and its lines by definition, None for a margin."""
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7)))
    kind = rng.choice(["p", "div", "ul", "ol", "quote", "table"] if depth else ["p", "div"])
    if kind in ("p", "div"):
        text = " ".join(word() for _ in range(rng.randrange(1, 5)))
        html = f"<{kind}>{text.replace(' ', rng.choice([' ', '  ', chr(10)]))}</{kind}>"
        return html, [None, text, None] if kind == "p" else [text]
    if kind == "quote":
        html, lines = parts(rng, depth - 1, lists)
        return f"<blockquote>{html}</blockquote>", [None, *[("> " + x).rstrip() for x in lines], None]
    if kind in ("ul", "ol"):
        html, out = f"<{kind}>", []
        for i in range(rng.randrange(1, 4)):
            inner, lines = parts(rng, depth - 1, lists + 1)
            html += f"<li>{inner}" + rng.choice(["", "</li>"])
            mark = f"{i + 1}. " if kind == "ol" else "- "
            out += [((mark if not k else " " * len(mark)) + x).rstrip() if x else "" for k, x in enumerate(lines)]
        return html + f"</{kind}>", out if lists else [None, *out, None]
    grid = [[parts(rng, depth - 1, lists) if rng.random() < 0.3 else ((w := word()), [w]) for _ in range(rng.randrange(2, 4))] for _ in range(rng.randrange(1, 4))]
    columns = [[r[c][1] for r in grid if c < len(r)] for c in range(max(map(len, grid)))]
    wide = [max(len(x) for cell in column for x in cell) for column in columns]
    out = []
    for r in grid:
        for k in range(max(len(lines) for _, lines in r)):
            out.append("  ".join((lines[k] if k < len(lines) else "").ljust(wide[c]) for c, (_, lines) in enumerate(r)).rstrip())
    html = "".join("<tr>" + "".join(f"<td>{h}" for h, _ in r) for r in grid)
    return f"<table>{html}</table>", [None, *out, None]


def parts(rng, depth, lists):
    html, out, due = "", [], False
    for _ in range(rng.randrange(1, 4)):
        h, lines = page(rng, depth, lists)
        html += h
        for x in lines:
            if x is None:
                due = bool(out)
            else:
                out += [""] * due + [x]
                due = False
    return html, out


def test_html_against_brute_force():
    for seed in range(600):
        rng = random.Random(seed)
        html, lines = parts(rng, 3, 0)
        assert html_text.html_to_text(html) == "\n".join(lines), html


def test_html_of_deep_nesting_is_linear():
    for tag in ("<ul><li>x", "<blockquote>x", "<table><tr><td>x<td>y", "<dl><dd>x", "<b>x<p>"):
        began = time.time()
        got = html_text.html_to_text(tag * 4000)
        assert time.time() - began < 3 and got.count("x") == 4000 and len(got) < 4000 * 200


def test_html_never_fails(spark):
    rng = random.Random(13)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<ul>", "<li>", "</ul>", "<pre>", "</pre>", "<b>", "</b>", "x", " ", "\n", "&amp;", "<a href='", "'>", "<!--", "-->", "<script>", "</script>", "</", "<dd>", "<blockquote>", "<br/>", "<caption>", "<tbody>"]
    for _ in range(1500):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        html_text.html_to_text(s)
    df = spark.createDataFrame([(1, "<p>a"), (2, None), (3, "<p>a"), (4, "<div>" * 5000 + "deep")], "page_id long, html string").withColumn("text", F.lit(3))
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {1: "a", 2: "", 3: "a", 4: "deep"}


# toxicity


def test_toxicity(spark):
    rng = random.Random(14)
    pool = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    bad = ["grumblefoo", "zorkish", "plonkwit", "fumbrella"]

    def text(y):
        w = [rng.choice(pool) for _ in range(rng.randrange(40, 200))]
        for _ in range(4 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    model = toxicity.fit([(text(i % 2), i % 2) for i in range(600)])
    test = [(text(i % 2), i % 2) for i in range(200)]
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in test]) > 0.95
    got = toxicity.score_texts(odd_docs(spark), model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.fit([]).score("x") < 0.5 and toxicity.fit([("a", 1)]).score("x") > 0.5 and toxicity.score_texts(empty(spark), model).count() == 0


def test_toxicity_of_rare_inflections(spark):
    rng = random.Random(15)
    pool = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(600)]

    def text(y, lang):
        w = [rng.choice(pool) for _ in range(rng.randrange(40, 200))]
        for _ in range(5 * y):  # in "yy" no toxic word comes twice, only its stem does
            w.insert(rng.randrange(len(w)), "plonkwit" if lang == "xx" else "grumbl" + "".join(rng.choice("aeioulnrst") for _ in range(5)))
        return " ".join(w)

    def rows(n):
        return [(text(i % 5 == 0, lang), int(i % 5 == 0), lang) for i in range(n) for lang in (["xx"] * 9 + ["yy"])]

    model = toxicity.fit(rows(120))
    for lang in ("xx", "yy"):
        assert np.mean([(model.score(text(y, lang)) >= 0.5) == y for y in [True, False] * 50]) > 0.95
    # three of thirty is little evidence for a word alone, but twenty such words pass jointly
    plain = [" ".join(rng.sample(pool, 30)) for _ in range(400)]
    few = [f"{' '.join(rng.sample(pool, 30))} {' '.join('zq' + chr(97 + k) + 'xj' for k in range(20) if (k + i) % 10 < 1)}" for i in range(30)]
    assert {f" zq{chr(97 + k)}xj " for k in range(20)} <= set(toxicity.marked_units(few, plain))


# secrets


HEX, B64, ALNUM = "3f786850e387550fdab836ed7e6dc881de23001b", "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ2T9vLo8sHd", "a8Kd93LfQ0zPx7VbN2mT5rYw1EuJ6cHs4GiO"
#: Text, the candidate in it, whether it is a secret.
FINDINGS = [
    (f'token = "{HEX}"', HEX, True), (f"token={HEX}", HEX, True), (f"export API_KEY={HEX}", HEX, True), (f"AWS_SECRET_ACCESS_KEY={B64}", B64, True), (f"ghp_{ALNUM}", f"ghp_{ALNUM}", True), ("https://user:q7Zk2mX9pL4vB8nR1tYw@host.com/x", "q7Zk2mX9pL4vB8nR1tYw", True),
    ("password: hunter2!x9", "hunter2!x9", True), ('pwd="99887766554433"', "99887766554433", True), (f"Authorization: Bearer {ALNUM}", ALNUM, True), (f'commit = "{HEX}"', HEX, False), (f"commit={HEX}", HEX, False), (f"export COMMIT={HEX}", HEX, False), (f"see commit {HEX} there", HEX, False),
    ("ask jo.smith@mail1.example.com", "mail1.example.com", False), ("from https://www.example.com/path/to/page2 on", "//www.example.com/path/to/page2", False), ("uuid=123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-426614174000", False), ("apiKey: process.env.API_KEY_2", "process.env.API_KEY_2", False), ('password = "your_password_here"', "your_password_here", False),
]


def test_secret_scan(spark):
    labelled = secret_scan.example_findings(spark, 6000)
    docs = spark.createDataFrame([*[(i, t) for i, (t, _, _) in enumerate(FINDINGS)], (100, None), (101, ""), (4, FINDINGS[4][0]), (102, "plain " * 5000 + FINDINGS[0][0])], "doc_id long, text string").withColumn("score", F.lit("mine"))
    rows = secret_scan.scan(docs, labelled).collect()
    found = {(r.doc_id, r.token): r.is_secret for r in rows}
    assert found == {(i, token): want for i, (_, token, want) in enumerate(FINDINGS)} | {(102, HEX): True} and len(rows) == len(found) + 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id][r.start : r.start + len(r.token)] == r.token and texts[r.doc_id][: r.start].endswith(r.before) and texts[r.doc_id][r.start + len(r.token) :].startswith(r.after) for r in rows)
    assert all(r.score == 0 for r in secret_scan.scan(docs, labelled.limit(0)).collect()) and secret_scan.scan(empty(spark), labelled).count() == 0
    assert secret_scan.scan(odd_docs(spark), labelled).count() == 0
    fresh = secret_scan.with_features(secret_scan.example_findings(spark, 2000, seed=4)).withColumn("p", secret_scan.probability(secret_scan.standard(spark)))
    right = fresh.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.95


def test_forest_against_brute_force(spark):
    """Every split of the forest is the best of its node's tried features, and scores are walks by hand."""
    rng, names = random.Random(41), secret_scan.FEATURES
    rows = [tuple(rng.randrange(9) for _ in names) for _ in range(300)]
    rows = [(*r, int(r[0] + r[1] > 8 or r[2] == 3)) for r in rows]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in (*names, "label")))
    grown = secret_scan.forest(df, trees=3, depth=3)
    assert len(grown) == 3 and all(1 in t and max(t) < 16 for t in grown)

    def score(r):
        total = 0.0
        for t in grown:
            n = 1
            while isinstance(t[n], tuple):
                f, edge = t[n]
                n = 2 * n + (r[names.index(f)] > edge)
            total += t[n]
        return total / 3

    got = df.withColumn("p", secret_scan.probability(grown, 3)).collect()
    assert all(abs(r.p - score(r)) < 1e-12 for r in got)
    assert np.mean([(r.p >= 0.5) == r.label for r in got]) > 0.85


# pipeline


@needs_tokens
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = spark.createDataFrame(p.quality(spark, docs, DATA).collect(), docs.schema)
    one = p.near_duplicates(spark, kept, DATA)
    groups = brute_groups({r.doc_id: r.text for r in kept.collect()}, 5, 80, 100)
    ids = {r.doc_id for r in one.collect()}
    assert ids == {i for i, (n, c) in groups.items() if c == i} and one.columns == docs.columns
    assert p.run(spark, DATA).count() > 0


def small_corpus(rng):
    """Documents with junk, near copies, benchmark passages, nulls, repeats and an extra column."""
    rows, item = [], " ".join(words(rng, 30))
    for i in range(60):
        w = words(rng, rng.randrange(55, 130), 4000)
        if i % 10 == 3:
            w = w[:20] + ["#|#|#"] * 30 + w[20:]
        if i % 10 == 4:
            w = w[:9] + item.split() + w[9:]
        rows.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), "en", rng.choice(["a", "b", None])))
    for i in range(20):
        w = rows[i][1].split(" ")
        rows.append((100 + i, " ".join(w[:-1] + ["changed"]), "en", "a"))
    rows += [rows[5], rows[5], (None, rows[6][1], "en", "b"), (None, " ".join(words(rng, 80, 4000)), None, None), (200, None, "en", "a"), (201, "", "en", "a"), (202, "short", "de", None)]
    return [(*r, len(r[1]) if r[1] else 0, "mine") for r in rows], item


@needs_tokens
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rows, item = small_corpus(random.Random(61))
    schema = DOC + ", kept string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda rs: sorted(map(tuple, rs), key=repr)
    # quality
    good = [r for r, k in zip(rows, brute_quality([r[1:4] for r in rows], quality_rules.MIN_DOCS)) if k]
    kept = p.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and plain(kept.collect()) == plain(good) and 40 < len(good) < len(rows) - 5
    # near duplicates: the least of each group, null last
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0))
    groups = brute_groups(dict(enumerate(good[i][1] for i in order)), 5, 80, 100)
    one = [good[order[i]] for i, (_, c) in groups.items() if c == i]
    kept = p.near_duplicates(spark, spark.createDataFrame(good, schema), str(tmp_path))
    assert kept.columns == docs.columns and plain(kept.collect()) == plain(one) and len(one) < len(good) - 10
    # benchmark
    index = decontaminate.Passages([(1, item)])
    clean = [r for r in one if not any(distance(t, decontaminate.normalise(r[1])) <= e for t, e in zip(index.text, index.edits))]
    kept = p.clean_of_benchmark(spark, spark.createDataFrame(one, schema), str(tmp_path))
    assert kept.columns == docs.columns and plain(kept.collect()) == plain(clean) and len(clean) < len(one)
    # mix: words of each source by water filling, each a run of its document
    mixed = p.mixed(spark, spark.createDataFrame(clean, schema), str(tmp_path))
    got = mixed.collect()
    names = sorted({r[3] for r in clean if r[3]}) + [None]
    want = water([sum(len(r[1].split()) for r in clean if r[3] == s) for s in names], [3, 1, 2])
    for i, s in enumerate(names):
        assert abs(sum(len(r.text.split()) for r in got if r.source == s) - want[i]) <= 1
    # a row's words are pieces of its document, each of them a run of words
    by_id = {}
    for r in clean:
        by_id.setdefault(r[0], []).append(r[1].split())
    assert mixed.columns == docs.columns and all(r.n_chars == len(r.text) and any(set(r.text.split()) <= set(w) for w in by_id[r.doc_id]) for r in got)
    # tokens: as many as the library gives
    from tokenizers import Tokenizer
    import public_tokenizers as P

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = sum(len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in got if r.text)
    index = p.token_ids(spark, spark.createDataFrame(got, mixed.schema), str(tmp_path)).collect()
    assert sum(r.n_tokens for r in index) == count and {i for r in index for i in r.doc_ids} == {r.doc_id for r in got}
    assert p.run(spark, str(tmp_path)).count() == len(index)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
