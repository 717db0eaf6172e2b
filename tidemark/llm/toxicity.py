"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities, so that a long text is judged like a short one: hits per word against a
general lexicon and against a lexicon learnt from labelled texts, hits within a few words of a second-person
pronoun, hits in capitals, shares of capitals, digits and punctuation, and the rate of obfuscated words. Fitting
uses a bounded sample of labelled rows; scoring reads every document whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, pieces, written

#: Labelled rows that a model is fitted on, at most. They are chosen by the hash of their ids.
MAX_LABELLED = 20_000
#: Toxic texts that a word of the learnt lexicon is in, at least, and their share of all.
LEAST_TOXIC, SHARE_TOXIC = 3, 0.005
#: Calibrated probability from which a document is toxic.
THRESHOLD = 0.5
#: Distance in words to a second-person pronoun that counts as near.
NEAR = 5

LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin loser losers trash garbage scum scumbag vermin "
    "filth filthy pathetic worthless disgusting clown clowns ugly retard retarded bastard bastards asshole assholes bitch bitches shit "
    "shitty bullshit crap fuck fucking fucked fucker motherfucker prick cunt slut whore pig pigs dickhead jackass freak "
    "degenerate parasite subhuman brainless halfwit dimwit dunce nitwit twat wanker tosser despise repulsive "
    "vile coward psycho lunatic hideous useless braindead barbarian sewage maggot cockroach "
    "imbécile crétin connard connasse salaud salope merde pute ordure débile abruti pourri minable dégoûtant bouffon raclure "
    "arschloch scheiße scheisse dummkopf trottel depp schwachkopf abschaum hurensohn wichser miststück widerlich erbärmlich wertlos "
    "idiota imbécil estúpido estúpida tonto tonta basura escoria mierda puta puto cabrón pendejo gilipollas asqueroso asquerosa patético inútil payaso".split()
)
SECOND = frozenset("you your yours yourself yourselves u ur youre you're tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer eure sie ihnen usted ustedes tú ti tus vosotros vuestro".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_SWAPPED = re.compile(r"[^\W\d_][0-9@$!|*#]+(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][.\-_* ]){3,}[^\W\d_](?![^\W\d_])")
FEATURES = ("lexicon", "learnt", "learnt_weight", "near_second", "second", "shouted", "capitals", "digits", "punctuation", "exclaimed", "odd_words", "odd_hits", "log_words", "any_hit")


def _table(*of: int) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*of]] = True
    return t


_PUNCT = _table(*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))
_LETTER = _table(*range(65, 91), *range(97, 123), *range(128, 256))
_SWAP, _GAP = _table(*b"0123456789@$!|*#"), _table(*b".-_* ")
#: Punctuation to blanks.
_CLEAN = bytes(32 if _PUNCT[i] else i for i in range(256))
_LEXICON, _SECOND = frozenset(w.encode() for w in LEXICON), frozenset(w.encode() for w in SECOND)


def words_of(text: str) -> list[bytes]:
    """The words of a text, in lower case: what white space and ASCII punctuation separate."""
    return text.lower().encode().translate(_CLEAN).split()


def _odd(text: str, raw: np.ndarray) -> tuple[int, int]:
    """Obfuscated words, and those of them that are in the lexicon once undone. The masks only spare the search in
    texts that can't have any."""
    letter, odd, hits = _LETTER[raw], 0, 0
    swap = _SWAP[raw]
    if (letter[:-1] & swap[1:]).any() and (swap[:-1] & letter[1:]).any():
        for w in {x for x in text.lower().split() if _SWAPPED.search(x)}:
            odd += 1
            hits += w.translate(_LEET).strip(".,;:?\"'()") in LEXICON or re.sub(r"[\W\d_]", "", w) in LEXICON
    pair = letter[:-1] & _GAP[raw][1:]
    if (pair[:-4] & pair[2:-2] & pair[4:]).any():
        for m in _SPACED.finditer(text):
            odd += 1
            hits += re.sub(r"[\W_]", "", m[0]).lower() in LEXICON
    return odd, hits


def features(text: str | None, learnt: dict[bytes, float]) -> list[float]:
    """The features of one text, whatever its length; null is as the empty text: all 0."""
    if not text:
        return [0.0] * len(FEATURES)
    words, raw = words_of(text), np.frombuffer(text.encode(), np.uint8)
    n, general, weight, known, near, shouted = len(words) or 1, 0, 0.0, 0, 0, 0
    there = set(words)
    if not (_LEXICON.isdisjoint(there) and there.isdisjoint(learnt)):
        for i, w in enumerate(words):
            g, k = w in _LEXICON, w in learnt
            if g or k:
                general += g
                known += k
                weight += learnt.get(w, 0.0)
                near += not _SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1])
        if general:
            shouted = sum(len(w) > 2 and w.isupper() and w.lower() in _LEXICON for w in text.encode().translate(_CLEAN).split())
    second = 0 if _SECOND.isdisjoint(there) else sum(map(_SECOND.__contains__, words))
    count = np.bincount(raw, minlength=256)
    odd, odd_hits = _odd(text, raw)
    chars = len(raw)
    return [
        100 * general / n, 100 * known / n, 100 * weight / n, 100 * near / n, 100 * second / n, 100 * shouted / n,
        100 * float(count[65:91].sum()) / chars, 100 * float(count[48:58].sum()) / chars, 100 * float(count[_PUNCT].sum()) / chars, 100 * float(count[33]) / chars,
        100 * odd / n, 100 * odd_hits / n, float(np.log1p(len(words))), float(general + known + odd_hits),
    ]


# --- the model -------------------------------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees of one depth for the logistic loss, over features cut into quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        m, inner = self.bins, 2**self.depth - 1
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.split_on, self.split_at = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        f = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
            for d in range(self.depth):
                width, lo = 2**d, 2**d - 1
                gs, hs = (np.stack([np.bincount(node * m + b[:, j], v, width * m).reshape(width, m) for j in range(k)], 1).cumsum(2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = -1
                best = gain.reshape(width, -1).argmax(1)
                on, at = best // m, best % m
                for i in range(width):
                    if gain[i, on[i], at[i]] > 1e-9 and at[i] < len(self.cuts[on[i]]):
                        self.split_on[t, lo + i], self.split_at[t, lo + i] = on[i], self.cuts[on[i]][at[i]]
                node = node * 2 + (x[np.arange(n), self.split_on[t, lo + node]] > self.split_at[t, lo + node])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.leaf[t] = self.rate * gs / (hs + 1)
            f += self.leaf[t][node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for on, at, leaf in zip(self.split_on, self.split_at, self.leaf):
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                i = 2**d - 1 + node
                node = node * 2 + (x[rows, on[i]] > at[i])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points between which probabilities are interpolated."""
    values, which = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # sum of y, count, first and last score
    for s, v, n in zip(values, np.bincount(which, y), np.bincount(which)):  # equal scores are one point
        blocks.append([float(v), float(n), s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    at = np.array([e for b in blocks for e in (b[2], b[3])])
    return at, np.repeat([b[0] / b[1] for b in blocks], 2)


class Model:
    """learnt: word -> log odds. trees and curve are None where the labels don't suffice; then a text with a hit
    in the general lexicon is toxic."""

    def __init__(self, learnt: dict[bytes, float], trees: Boosted | None, curve: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.learnt, self.trees, self.curve = learnt, trees, curve

    def probability(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.learnt) for t in texts]).reshape(len(texts), len(FEATURES))
        if self.trees is None:
            return np.where(x[:, -1] > 0, 0.9, 0.05)
        p = np.interp(self.trees.raw(x), *self.curve)
        return np.where(x[:, FEATURES.index("log_words")] > 0, p, self.curve[1][0])  # without words nothing is toxic


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    labels = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    labels = labels.orderBy(F.xxhash64("id"), "id").limit(most)  # the bound
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    rows = docs.join(F.broadcast(labels), "id").select(F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(5)).alias("fold"), F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), "text")
    return written(rows, "labelled")


def _lexicon(rows: DataFrame) -> dict[bytes, float]:
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in pieces(batches, 1):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(set(words_of(t)))
        for w in seen[1]:  # a word that no toxic text of this part has only adds to the other count, below
            yield w, seen[1][w], seen[0].get(w, 0)
        for w, c in seen[0].items():
            if w not in seen[1]:
                yield w, 0, c

    def arrow(batches):
        got = list(count(batches))
        yield pa.RecordBatch.from_arrays([pa.array([g[0].decode() for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["w", "a", "b"])

    words = rows.select("y", "text").mapInArrow(arrow, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    least = max(LEAST_TOXIC, SHARE_TOXIC * n[1])  # fewer may be copies of one text
    kept = words.where((F.length("w") > 2) & (F.col("a") >= least)).withColumn("odds", odds).where("odds > 2.2")  # all of them: their number is bounded by that of the labelled rows
    return {r["w"].encode(): float(r["odds"]) for r in kept.collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on at most max_labelled labelled rows, in three parts that share no row: one for the learnt lexicon,
    one for the trees, one for the calibration. Labels that are null or whose document is missing don't count; of
    several labels for an id the highest does. With no row of either class in a part the general lexicon decides
    alone."""
    rows = _sample(docs, labels, id_col, text_col, label_col, max_labelled)
    learnt = _lexicon(rows.where("fold < 2").dropDuplicates(["y", "text"]))

    def dense(batches):
        for b in pieces(batches, 2):
            x = [features(t, learnt) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), b.column(1).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["fold", "y", "x"])

    got = rows.where("fold >= 2").select("fold", "y", "text").mapInArrow(dense, "fold int, y int, x array<double>").toArrow()
    fold, y = (got.column(c).to_numpy() for c in ("fold", "y"))
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y, fold])  # the same model whatever order the rows arrive in
    x, y, fold = x[order], y[order].astype(float), fold[order]
    a, b = fold < 4, fold == 4
    if any(len(np.unique(y[s])) < 2 for s in (a, b)):
        return Model(learnt, None, None)
    trees = Boosted().fit(x[a], y[a])
    return Model(learnt, trees, isotonic(trees.raw(x[b]), y[b]))


def probability(model: Model):
    """A column function: text -> calibrated probability. Texts without words, null and empty ones too, have the
    lowest probability that the calibration gives."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            out.append(model.probability(texts.slice(at, 256).to_pylist()))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, probability, toxic) for every row of docs, repeated rows and null ids included; a null text isn't
    toxic. An empty table gives an empty one. Other columns of docs don't matter, whatever their names; an id column called as one of the results is renamed."""
    x = docs.select(F.col(f"`{id_col}`").alias("_1"), F.round(probability(model)(F.col(f"`{text_col}`")), 6).alias("_2"))
    return x.select(F.col("_1").alias(fresh(["probability", "toxic"], id_col)), F.col("_2").alias("probability"), (F.col("_2") >= threshold).alias("toxic"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic; null texts stay."""
    text = F.col(f"`{text_col}`")
    return docs.where(text.isNull() | (probability(model)(F.coalesce(text, F.lit(""))) < threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model fitted on their labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
