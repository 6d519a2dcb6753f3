"""Toxicity by compression distance, beside a test of the words that only toxic text has.

Two zstandard dictionaries begin with the same ordinary windows, each language in turn, and end
with what the library's trainer makes of toxic and of ordinary samples. A window of a text is
compressed with either; the toxic dictionary saves bytes where the window has what toxic text has
and ordinary text has not, and all else costs about the same. Windows overlap and cover whole
texts. Features are how these savings are spread over a text's windows and how many of its words
have a marked unit (a word, stem or ending that tells the labels apart); a logistic calibration,
fitted on labelled texts that the dictionaries have not seen, turns them into a probability, so
0.5 is the threshold.

Savings alone don't decide here: a match costs about three bytes, as much as a short word that is
coded letter by letter, and dictionaries trained on whole toxic texts mostly hold what all text has
(the README has figures). So the toxic samples are the words of toxic texts that have a marked
unit, and the units count for themselves. A unit is marked by a binomial test between the labels,
over all texts and within each language.

The fit reads a bounded number of whole texts (MOST_TEXTS a label), a limit of the fit, not of
prediction.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, without
from .crf import held_out

#: Labelled texts of each label that are fitted at most.
MOST_TEXTS = 3000
WINDOW, STEP, LEVEL, LEAST_MATCH = 96, 76, 4, 4
#: Bytes of a dictionary's common beginning and of its trained end; the trainer's segment and gram sizes;
#: windows of an ordinary text, from its whole length, that the trainer is given.
BACKGROUND, TRAINED, SEGMENT, GRAM, SHOWN = 4096, 2048, 24, 6, 12
KNOWN_WORDS = 200_000
#: Least and greatest letters of a stem or an ending, and the share of passing units that may be false.
LEAST_UNIT, MOST_UNIT, FALSE, RATIO = 4, 10, 0.01, 4
_WORDS = re.compile(r"[^\W\d_]+")


def normalise(text: str | None) -> str:
    """Lower case, letters only, one space between words."""
    return " ".join(_WORDS.findall((text or "").lower()))


def windows(text: str) -> list[bytes]:
    """Overlapping windows of WINDOW bytes, STEP apart, over the whole normalised text."""
    raw = f" {text} ".encode()
    return [raw[i : i + WINDOW] for i in range(0, max(len(raw) - (WINDOW - STEP), 1), STEP)]


class Model:
    """Both dictionaries, the marked units, and the calibration."""

    def __init__(self, toxic: bytes, plain: bytes, marked: frozenset[str] = frozenset(), weights: tuple[float, ...] = (0.0,) * 7):
        self.toxic, self.plain, self.marked, self.weights, self.ready, self.known = toxic, plain, marked, weights, None, {}

    def __getstate__(self):
        return self.toxic, self.plain, self.marked, self.weights

    def __setstate__(self, state):
        self.toxic, self.plain, self.marked, self.weights = state
        self.ready, self.known = None, {}

    def compressors(self):
        if self.ready is None:
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=LEAST_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            self.ready = []
            for raw in (self.toxic, self.plain):
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(compression_params=how)
                self.ready.append(zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress)
        return self.ready

    def has_mark(self, word: str) -> bool:
        """Whether a word has a marked unit; answers are kept in a memory of bounded size."""
        if (got := self.known.get(word)) is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            got = self.known[word] = not self.marked.isdisjoint(units_of(word))
        return got

    def features(self, text: str | None) -> tuple[float, ...]:
        """Greatest saving of a window, the share of windows that save, the mean saving, how many save
        much; how many words have a marked unit, and their share."""
        toxic, plain = self.compressors()
        text = normalise(text)
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)])
        counts = Counter(text.split())
        hits = sum(n for w, n in counts.items() if self.has_mark(w)) if self.marked else 0
        return float(np.clip(saved.max(), -20, 40)), float((saved >= 4).mean()), float(saved.mean()), float(np.log1p((saved >= 8).sum())), float(np.log1p(hits)), 10.0 * hits / max(counts.total(), 1)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, (1.0, *self.features(text))), -30, 30))))


def units_of(word: str) -> list[str]:
    """The word, its stems and its endings; a space marks the word's edge."""
    sizes = range(LEAST_UNIT, min(len(word), MOST_UNIT + 1))
    return [f" {word} ", *[f" {word[:k]}" for k in sizes], *[f"{word[-k:]} " for k in sizes]]


def units(text: str) -> set[str]:
    """Units of a normalised text."""
    return {u for w in set(text.split()) for u in units_of(w)}


def tail(a: int, n: int, share: float) -> float:
    """Probability that ``a`` or more of ``n`` texts are toxic where each is with chance ``share``."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(a, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def marked_units(toxic: list[str], plain: list[str]) -> dict[str, float]:
    """Units that toxic texts have more often than ordinary ones, with a log ratio of shares.

    A unit's chance is the binomial tail given how many texts have it. The units that pass are
    chosen together (Benjamini-Hochberg, FALSE of them false), so there is no least count: a rare
    word passes with its stem, or where many rare units are as one-sided as it is."""
    if not toxic or not plain:
        return {}
    a = Counter(u for t in toxic for u in units(t))
    a = {u: n for u, n in a.items() if n > 1}
    b = Counter(u for t in plain for u in units(t) if u in a)
    share, chance = len(toxic) / (len(toxic) + len(plain)), {}
    for u, n in a.items():
        if (n, b[u]) not in chance:
            chance[n, b[u]] = tail(n, n + b[u], share) if n > share * (n + b[u]) else 1.0
    at = Counter((n, b[u]) for u, n in a.items())
    limit, rank = 0.0, 0
    for cell in sorted(at, key=lambda c: chance[c]):
        rank += at[cell]
        if chance[cell] <= FALSE * rank / len(a):
            limit = chance[cell]
    out = {}
    for u, n in a.items():
        p, q = n / len(toxic), b[u] / len(plain)
        if chance[n, b[u]] <= limit and p > RATIO * q:
            out[u] = float(np.log((p + 1e-4) / (q + 1e-4)))
    # a part of a longer unit that is as telling adds nothing
    longer = {}
    for u in out:
        for k in range(LEAST_UNIT, len(u)):
            for i in range(len(u) - k + 1):
                if (v := u[i : i + k]) in out:
                    longer[v] = max(longer.get(v, 0), a[u])
    return {u: v for u, v in out.items() if longer.get(u, 0) < 0.9 * a[u]}


def spread(xs: list, n: int) -> list:
    """At most n of a list, evenly from its whole length."""
    return [xs[i * len(xs) // n] for i in range(n)] if len(xs) > n else xs


def trained(samples: list[bytes], size: int = TRAINED) -> bytes:
    """Content of a dictionary that the library's trainer makes of samples. Too few samples for
    the trainer are a dictionary as they are."""
    try:
        # the trainer puts tables before the content, whose end is what it found most frequent
        return zstandard.train_dictionary(size + 1024, samples, k=SEGMENT, d=GRAM).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def in_turn(lists: list[list]) -> list:
    """One of each list after another, until all are used up."""
    return [x for row in zip_longest(*lists) for x in row if x is not None]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps for a logistic fit with both labels weighted by their shares."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def fit(rows: list[tuple]) -> Model:
    """Fit on (text, label) or (text, label, language) rows: two of three for the dictionaries, the
    third for calibration. Units are counted over all texts and within each language."""
    texts = [(normalise(r[0]), int(r[1]), r[2] if len(r) > 2 else None) for r in rows]
    learn = [r for i, r in enumerate(texts) if i % 3]
    judge = [rows[i] for i in range(0, len(rows), 3)]
    toxic, plain = [t for t, y, _ in learn if y], [t for t, y, _ in learn if not y]
    if not toxic or not plain:
        # too few of one label to learn from: every text gets the label that there is
        return Model(b"", b"", weights=(30.0 if any(y for _, y, _ in texts) and not plain else -30.0, *(0.0,) * 6))
    marked = marked_units(toxic, plain)
    for g in sorted({g for _, _, g in learn if g is not None}):
        own = marked_units(*([t for t, y, z in learn if z == g and y == side] for side in (1, 0)))
        marked = {u: max(own.get(u, 0), marked.get(u, 0)) for u in own | marked}
    # ordinary windows of every language in turn, so that a language's common syllables save nothing
    tongues = [[t for t, y, z in learn if z == g and not y] for g in sorted({g for *_, g in learn}, key=str)]
    usual = [w for t in in_turn(tongues) for w in spread(windows(t), SHOWN)]
    base = b" ".join(usual[::SHOWN])[:BACKGROUND]
    telling = [" ".join(["", *[w for w in t.split() if not marked.keys().isdisjoint(units_of(w))], ""]).encode() for t in toxic]
    model = Model(base + trained([x for x in telling if len(x) > 1]), base + trained(usual), frozenset(marked))
    got = np.array([model.features(x) for x, *_ in judge])
    model.weights = logistic(got, np.array([float(r[1]) for r in judge]))
    return model


def sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, language: str, most: int = MOST_TEXTS) -> list[tuple[str, int, str | None]]:
    """At most ``most`` texts of each label with their languages, first in an order of hashed keys.
    Keys are ranked before a text is fetched, so no text is shuffled; texts are whole. A repeated
    key brings its texts, up to ``most`` in all; null labels are for the caller to leave out."""
    h, g = F.xxhash64(F.col(key), F.lit(23)), F.xxhash64(F.col(text))
    known = docs.select(key).join(labels.select(key, label), key)
    out = []
    for y in (0, 1):
        chosen = known.filter(F.col(label) == y).select(key).distinct().orderBy(h, key).limit(most)
        rows = docs.join(F.broadcast(chosen), key).select(F.col(text).alias("t"), F.col(language).cast("string").alias("z"), h.alias("h"), g.alias("g"))
        out += [(r.h, r.g, r.t, y, r.z) for r in rows.orderBy("h", "g").limit(most).collect()]
    return [(t, y, z) for _, _, t, y, z in sorted(out, key=lambda r: (r[0], r[1] or 0, r[3]))]


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows of ``df`` with score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts
    are scored as empty, long ones by all their windows, repeated ones alike; an empty table gives an
    empty result; input columns of these names are replaced."""
    df = without(df, "score", "predicted")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for b in batches:
            yield pd.Series([m.score(t) for t in b], dtype="float64")

    return df.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # a row that is held out is never read for the fit
    rows = sample(docs.filter(~held_out()), labels.filter("toxic is not null"), "text", "toxic", "doc_id", "lang")
    got = score_texts(docs.select("doc_id", "text"), fit(rows))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")
