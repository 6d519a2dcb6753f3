"""Language identification of words by a linear-chain conditional random field.

Every word of a text gets a label from its affixes, inner character n-grams and a lexicon,
and from its neighbours through learned transition weights, so runs of words in one language
are told apart within a code-switched text. Forward-backward gives each word the probability
of each label given the whole text; a text's language is the label with the greatest mean.

Training fits weights by stochastic gradient ascent of the conditional likelihood on whole texts,
cut into chains of PIECE words, of a bounded number of labelled rows (MOST_TEXTS, a documented
limit of the fit, not of prediction). Prediction runs over whole texts: words are scored once and remembered (a
bounded memory), and the chains of all texts of a batch advance in step, cut into blocks whose
transfer matrices are composed by a scan, so a very long text takes no longer chain of steps.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, without

#: Labelled texts that are fitted at most; words of a chain, and chains of a gradient step.
MOST_TEXTS, PIECE, STEP = 4000, 64, 32
#: Texts that a label is given even where there are so many labels that MOST_TEXTS would give it fewer.
LEAST_EACH = 200
BITS, EPOCHS, RATE, LEXICON = 16, 1, 0.3, 2000
KNOWN_WORDS, BLOCK = 300_000, 32


#: Stripped first, as one call; any other sign that is no letter goes one by one.
_SIGNS = ".,;:!?\"'()[]{}|*$%&#<>-_/\\0123456789"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words with a letter, stripped of what is no letter at either end."""
    out = []
    for w in (text or "").lower().split():
        if not w.isalpha():
            w = w.strip(_SIGNS)
            a, b = 0, len(w)
            while a < b and not w[a].isalpha():
                a += 1
            while a < b and not w[b - 1].isalpha():
                b -= 1
            w = w[a:b]
        if w:
            out.append(w)
    return out


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed features: prefixes, suffixes, n-grams, and the word itself if the lexicon has it."""
    w = word if len(word) <= 40 else word[:20] + word[-20:]
    names = ["b", "p" + w[:1], "p" + w[:2], "p" + w[:3], "s" + w[-2:], "s" + w[-3:], "s" + w[-4:], *[w[i : i + 3] for i in range(len(w) - 2)]]
    if word in lexicon:
        names.append("w" + word)
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in names]


class Scores(dict):
    """Row numbers of the scores of the words met so far."""

    def __init__(self, lexicon: frozenset[str], emit: np.ndarray):
        super().__init__()
        self.lexicon, self.emit = lexicon, emit
        self.rows = np.empty((4096, emit.shape[1]))

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[n] = self.emit[features(word, self.lexicon)].sum(0)
        self[word] = n
        return n

    def of(self, words: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out = self.rows[got]
        if len(self) > KNOWN_WORDS:
            self.clear()
        return out


class Model:
    """Weights of a fitted field; ``labels`` in code point order."""

    def __init__(self, labels: list[str], lexicon: frozenset[str], emit: np.ndarray, move: np.ndarray):
        self.labels, self.lexicon, self.emit, self.move = labels, lexicon, emit, move
        self.known = Scores(lexicon, emit)

    def marginals(self, chains: list[list[str]]) -> list[np.ndarray]:
        """Probability of each label at each word of each chain.

        Chains are laid end to end in blocks of BLOCK words; unused places are neutral. Pass 1
        multiplies each block's transfer matrices, all blocks at once; a scan over each chain's
        blocks gives the forward (and backward) vector at block edges; pass 2 fills the blocks.
        """
        n, size = [len(c) for c in chains], len(self.labels)
        count = [-(-k // BLOCK) for k in n]
        rows = sum(count)
        if not rows:
            return [np.zeros((0, size)) for _ in chains]
        score = np.zeros((rows * BLOCK, size))
        live = np.zeros(rows * BLOCK, bool)
        first = np.concatenate([[0], np.cumsum(count)])
        flat = self.known.of([w for c in chains for w in c])
        at = np.concatenate([np.arange(k) + f * BLOCK for k, f in zip(n, first)])
        score[at], live[at] = flat, True
        score, live = score.reshape(rows, BLOCK, size), live.reshape(rows, BLOCK)
        step = np.exp(self.move)
        push = np.exp(score - score.max(2, keepdims=True))
        opening = np.zeros((rows, BLOCK), bool)
        opening[first[:-1][np.array(n) > 0], 0] = True
        eye = np.eye(size)
        # transfer of one word: T[i, j] = weight from label i before it to label j at it; the first word has no move
        def transfer(k):
            t = np.where(opening[:, k, None, None], 1.0, step[None]) * push[:, k, None, :]
            return np.where(live[:, k, None, None], t, eye[None])

        whole = np.broadcast_to(eye, (rows, size, size)).copy()
        for k in range(BLOCK):
            whole = whole @ transfer(k)
            whole /= whole.max(axis=(1, 2), keepdims=True)
        head, tail = np.empty((rows, size)), np.empty((rows, size))
        longest = max(count)
        begin, blocks = first[:-1], np.array(count)
        ahead = np.tile(np.full(size, 1.0 / size), (len(chains), 1))
        for k in range(longest):  # forward over blocks, all chains at once
            on = np.flatnonzero(blocks > k)
            r = begin[on] + k
            head[r] = ahead[on]
            v = (ahead[on][:, None, :] @ whole[r])[:, 0]
            ahead[on] = v / v.sum(1, keepdims=True)
        back = np.ones((len(chains), size))
        for k in range(longest):
            on = np.flatnonzero(blocks > k)
            r = begin[on] + blocks[on] - 1 - k
            tail[r] = back[on]
            v = (whole[r] @ back[on][:, :, None])[:, :, 0]
            back[on] = v / v.max(1, keepdims=True)
        fwd = np.empty((BLOCK, rows, size))
        v = head
        for k in range(BLOCK):
            v = (v[:, None, :] @ transfer(k))[:, 0]
            v = fwd[k] = v / v.sum(1, keepdims=True)
        v = tail
        out = np.empty((rows, BLOCK, size))
        for k in range(BLOCK - 1, -1, -1):
            p = fwd[k] * v
            out[:, k] = p / p.sum(1, keepdims=True)
            v = (transfer(k) @ v[:, :, None])[:, :, 0]
            v = v / v.max(1, keepdims=True)
        out = out.reshape(rows * BLOCK, size)[at]
        return np.split(out, np.cumsum(n)[:-1])

    def predict(self, texts: list[str | None], words: bool = True) -> list[tuple[str, float, list[str]]]:
        """(language, mean probability, label of each word if asked); ``und`` for texts without letters."""
        chains = [words_of(t) for t in texts]
        out = []
        for m in self.marginals(chains):
            if not len(m):
                out.append(("und", 0.0, []))
                continue
            mean = m.mean(0)
            best = int(mean.argmax())
            out.append((self.labels[best], float(min(1.0, mean[best])), [self.labels[i] for i in m.argmax(1).tolist()] if words else []))
        return out


class Features:
    """Features of all words of the fit, a word after another."""

    def __init__(self, words: list[str], lexicon: frozenset[str]):
        self.number = {w: i for i, w in enumerate(words)}
        lists = [features(w, lexicon) for w in words]
        self.flat = np.array([f for x in lists for f in x], np.int64)
        self.count = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.count) - self.count

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of some words end to end, where each word's begin, and how many it has."""
        n = self.count[words]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[words] - ends + n, n) + np.arange(ends[-1])], ends - n, n


def posteriors(score: np.ndarray, live: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (chain, word, label) and expected transitions of chains that are filled up
    with words that are not live."""
    push = np.exp(score - score.max(2, keepdims=True))
    step = np.exp(move)
    many, long, size = score.shape
    fwd, bwd = np.empty_like(push), np.ones_like(push)
    fwd[:, 0] = push[:, 0] / push[:, 0].sum(1, keepdims=True)
    for k in range(1, long):
        v = (fwd[:, k - 1] @ step) * push[:, k]
        fwd[:, k] = np.where(live[:, k, None], v / v.sum(1, keepdims=True), fwd[:, k - 1])
    for k in range(long - 2, -1, -1):
        v = (push[:, k + 1] * bwd[:, k + 1]) @ step.T
        bwd[:, k] = np.where(live[:, k + 1, None], v / v.max(1, keepdims=True), 1.0)
    out = fwd * bwd
    out /= out.sum(2, keepdims=True)
    pairs = fwd[:, :-1, :, None] * step * (push * bwd)[:, 1:, None, :]
    pairs *= (live[:, 1:] / pairs.sum((2, 3)))[:, :, None, None]
    return out, pairs.sum((0, 1))


def fit(rows: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model | None:
    """Fit on (text, label) rows by gradient steps (a rate per weight, falling with the gradients that
    it has had) on STEP chains at a time.

    Labels of a text's words are all its own; to learn transitions between languages, the second
    half of every third chain is another text's, which makes code-switched examples."""
    labels = sorted({y for _, y in rows})
    if not labels:
        return None
    number, size = {y: i for i, y in enumerate(labels)}, len(labels)
    texts = [(words_of(t), number[y]) for t, y in rows]
    counts = Counter(w for c, _ in texts for w in c)
    lexicon = frozenset(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])
    known = Features(list(counts), lexicon)
    chains = [(np.array([known.number[w] for w in c[i : i + PIECE]], np.int64), y) for c, y in texts for i in range(0, len(c), PIECE)]
    emit, move = np.zeros((1 << BITS, size)), np.zeros((size, size))
    had, moved = np.full((1 << BITS, size), 1e-2), np.full((size, size), 1e-2)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            words, truth, live = np.zeros((len(some), PIECE), np.int64), np.zeros((len(some), PIECE), np.int64), np.zeros((len(some), PIECE), bool)
            for r, i in enumerate(some):
                (w, y), half = chains[i], PIECE
                words[r, : len(w)], truth[r], live[r, : len(w)] = w, y, True
                if r % 3 == 0 and len(w) > 1:
                    half = len(w) // 2
                    (w, y) = chains[some[r - 1]]
                    w = w[: PIECE - half]
                    words[r, half : half + len(w)], truth[r, half:] = w, y
                    live[r, half:] = False
                    live[r, half : half + len(w)] = True
            flat, first, n = known.of(words[live])
            score = np.zeros((*words.shape, size))
            score[live] = np.add.reduceat(emit[flat], first, axis=0)
            p, pairs = posteriors(score, live, move)
            grad = -p[live]
            grad[np.arange(len(grad)), truth[live]] += 1
            # one sum per weight, then a step
            used, slot = np.unique(flat, return_inverse=True)
            spread = np.repeat(grad, n, axis=0)
            g = np.stack([np.bincount(slot, spread[:, k], len(used)) for k in range(size)], axis=1)
            had[used] += g * g
            emit[used] += rate * g / np.sqrt(had[used])
            seen, both = np.zeros((size, size)), live[:, 1:]
            np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
            moved += (seen - pairs) ** 2
            move += rate * (seen - pairs) / np.sqrt(moved)
    return Model(labels, lexicon, emit, move)


def sample(df: DataFrame, text: str, label: str, key: str, most: int = MOST_TEXTS) -> list[tuple[str, str]]:
    """Labelled texts for the fit, drawn label by label, so that every label is learned at any size.

    A label's texts are ranked by their hash, copies counted once, and the labels take turns until
    there are ``most``; beyond that a label is still given its first LEAST_EACH. Hashes are ranked
    before a text is fetched, whole."""
    rows = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"), F.xxhash64(F.col(key), F.lit(11)).alias("d"), F.xxhash64(F.col(text), F.lit(11)).alias("h"))
    ranked = rows.groupBy("y", "h").agg(F.min("d").alias("d"))
    # ranked within 64 parts of a label first, so that a common label is not one task's
    for part in (F.pmod("h", F.lit(64)), F.lit(0)):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("y", part).orderBy("h"))).filter(F.col("r") <= max(most, LEAST_EACH))
    turns = sorted(map(tuple, ranked.select("r", "h", "y", "d").collect()))
    chosen = [x[1:] for i, x in enumerate(turns) if i < most or x[0] <= LEAST_EACH]
    if not chosen:
        return []
    chosen = df.sparkSession.createDataFrame(chosen, "h long, y string, d long")
    found = rows.join(F.broadcast(chosen), ["h", "y", "d"]).groupBy("h", "y").agg(F.first("t").alias("t")).collect()
    return [(r.t, r.y) for r in sorted(found, key=lambda r: (r.h, r.y))]


def identify(df: DataFrame, model: Model | None, text: str = "text", words: bool = True) -> DataFrame:
    """All rows of ``df`` with lang_pred, score and, if asked, word_langs (a label per word with
    letters). Null texts and texts without a letter are ``und`` with score 0, and so is all
    text if no label was learned. Long texts are read whole, repeated ones labelled alike; of labels
    with equal means the first in code point order counts; an empty table gives an empty result.
    Input columns of these names are replaced."""
    df = without(df, "lang_pred", "score", "word_langs")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, word_langs array<string>" if words else "lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts, got = list(b), []
            for at in range(0, len(texts), 512):
                got += m.predict(texts[at : at + 512], words) if m else [("und", 0.0, [])] * len(texts[at : at + 512])
            yield pd.DataFrame([g if words else g[:2] for g in got], columns=["lang_pred", "score", "word_langs"][: 3 if words else 2])

    return df.withColumn("__p", predict(F.col(text))).select(*[F.col(f"`{c}`") for c in df.columns], "__p.*")


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sample(docs.filter(~held_out()), "text", "lang", "doc_id"))
    got = identify(docs.select("doc_id", "text"), model, words=False)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
