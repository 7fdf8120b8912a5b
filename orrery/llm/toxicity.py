"""Operator 9: toxicity by a classifier regularised with counterfactuals.

A logistic model over the words of a text (present or not). Beside the usual
loss it penalises the squared change of the logit between a labelled text and
its counterfactuals, in which identity terms are swapped for others of their
kind. So a group's name alone can't carry a score, and neutral mentions
aren't reported because toxic texts mention the group more often.

Training takes labelled rows outside the held-out fold, at most about
`most_rows` of them (the documented bound of the sample; a hash of doc_id
picks the share; of an id's several texts one counts). Words are runs of letters and digits, lower-cased; the first
three to five letters of a word count as words too. A word
enters the model if `least_texts` training texts have it, the `most_words`
with the largest chi-square first; identity terms always do.

Cases: null and empty texts get the score of a text without known words; ids
with several labels are toxic if one label says so; null labels don't train;
with labels of one kind only, or none, the score is the smoothed rate of
toxic labels; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_part, only, staged

MOST_ROWS, MOST_WORDS, LEAST_TEXTS = 12_000, 2_000, 3
#: Weights of the squared weights and of the counterfactual penalty.
RIDGE, FAIRNESS, STEPS = 0.5, 200.0, 300
#: Least chi-square of a word (one degree of freedom); weight of toxic texts in the loss (power of the odds).
SURE, BALANCE = 15.0, 0.7
#: Counterfactuals of each identity term of a text.
SWAPS = 2
# Identity terms by kind; a swap stays within its kind and language.
IDENTITIES = {
    "gender": ("women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "nonbinary"),
    "faith": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "christians", "muslims", "jews", "hindus"),
    "origin": ("american", "african", "asian", "european", "mexican", "arab", "chinese", "indian", "immigrants", "refugees"),
    "colour": ("black", "white", "brown", "latino", "latina"),
    "love": ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "age": ("young", "old", "elderly", "teenage"),
    "gender_de": ("frauen", "männer", "frau", "mann", "mädchen", "jungen"),
    "faith_de": ("christen", "muslime", "juden", "hindus", "christlich", "muslimisch", "jüdisch"),
    "origin_de": ("amerikaner", "afrikaner", "asiaten", "europäer", "flüchtlinge", "ausländer"),
    "love_de": ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    "gender_fr": ("femmes", "hommes", "femme", "homme", "filles", "garçons"),
    "faith_fr": ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    "origin_fr": ("américains", "africains", "asiatiques", "européens", "réfugiés", "immigrés"),
    "gender_es": ("mujeres", "hombres", "mujer", "hombre", "chicas", "chicos"),
    "faith_es": ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
    "origin_es": ("americanos", "africanos", "asiáticos", "europeos", "refugiados", "inmigrantes"),
}
_KIND = {w: kind for kind, ws in IDENTITIES.items() for w in ws}
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct words of a whole text, and the first three, four and five letters of longer ones (with a mark), but of identity terms."""
    if not text:
        return set()
    ws = set(WORD.findall(text.lower()))
    return ws.union(*({w[:k] + "-" for w in ws if len(w) > k and w not in _KIND} for k in (3, 4, 5)))


def _swaps(present: set[str]) -> list[tuple[str, str]]:
    """(term, its replacement): each identity term of a text for the next ones of its kind that the text lacks, SWAPS at most."""
    out = []
    for w in sorted(present & _KIND.keys()):
        ring = IDENTITIES[_KIND[w]]
        at = ring.index(w)
        others = (ring[(at + step) % len(ring)] for step in range(1, len(ring)))
        out += [(w, x) for x in others if x not in present][:SWAPS]
    return out


class Classifier:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def score(self, text: str | None) -> float:
        weights = self.weights
        z = self.bias + sum(weights[w] for w in sorted(words_of(text) & weights.keys()))
        return float(1.0 / (1.0 + np.exp(-z))) if z > -700 else 0.0


def chosen_words(counts: DataFrame, n: int, positive: int, most_words: int = MOST_WORDS, least_texts: int = LEAST_TEXTS) -> list[str]:
    """(word, texts, toxic) -> the words of the model: the largest chi-squares, and all identity terms."""
    expected = F.col("texts") * F.lit(positive / n)
    sure = (F.col("toxic") - expected) ** 2 / (expected * F.lit(1 - positive / n))
    top = counts.where(F.col("texts") >= least_texts).withColumn("sure", sure).where(F.col("sure") >= SURE)
    found = [r["word"] for r in top.orderBy(F.desc("sure"), "word").limit(most_words).select("word").collect()]
    return found + [w for w in _KIND if w not in set(found)]


def fit(features: list[list[int]], swaps: list[list[int]], labels: np.ndarray, words: list[str], ridge: float = RIDGE, fairness: float = FAIRNESS) -> Classifier:
    """Places of each text's words, pairs of swapped places and 0/1 labels -> the classifier (Adam over whole batches, in a fixed order)."""
    n, positive = len(features), float(labels.sum())
    rate = (positive + 1) / (n + 2)
    if positive in (0, n):
        return Classifier(float(np.log(rate / (1 - rate))), {})
    word = np.array([j for f in features for j in f], dtype=int)
    text = np.repeat(np.arange(n), [len(f) for f in features])
    pairs = np.array([x for s in swaps for x in s], dtype=int).reshape(-1, 2)
    a, b = pairs[:, 0], pairs[:, 1]
    heavy = np.where(labels > 0, ((n - positive) / positive) ** BALANCE, 1.0)
    w, bias = np.zeros(len(words)), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(text, weights=w[word], minlength=n)
        gap = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels) * heavy
        g = np.bincount(word, weights=gap[text], minlength=len(w)) + ridge * w
        change = 2.0 * fairness * (w[a] - w[b])
        np.add.at(g, a, change)
        np.add.at(g, b, -change)
        gb = gap.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        pace = 0.1 / (1 + step / 100)
        w = w - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= pace * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Classifier(float(bias), {x: float(w[j]) for j, x in enumerate(words) if abs(w[j]) > 1e-6})


def _counted(batches):
    """(doc_id, toxic, text) -> (word, texts, toxic) of a task; flushed when many words are held."""
    held: dict[str, list[int]] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["word", "texts", "toxic"])

    for batch in batches:
        for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for w in words_of(text):
                at = held.setdefault(w, [0, 0])
                at[0] += 1
                at[1] += toxic
            if len(held) > 500_000:
                yield rows()
                held.clear()
    yield rows()


def train(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, most_rows: int = MOST_ROWS) -> Classifier:
    """From the labelled documents outside the held-out fold; the sample of ids is bounded, so it is broadcast."""
    marked = only(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_part("doc_id", folds) != fold))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marked.count()
    share = 1.0 if n <= most_rows else most_rows / n
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).withColumnRenamed("doc_id", "l_id")
    rows = only(docs, "doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    # One row for each id, so that a repeated id can't pass the bound: the text with the smallest hash.
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    texts = staged(one.select("doc_id", "toxic", F.col("t.text").alias("text")), "labelled")
    size = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    if not size["n"]:
        return Classifier(0.0, {})
    words = list(_KIND)
    if 0 < size["k"] < size["n"]:
        counts = texts.mapInArrow(_counted, "word string, texts long, toxic long").groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
        words = chosen_words(counts, size["n"], size["k"])
    place = {w: j for j, w in enumerate(words)}

    def places(batches):
        for batch in batches:
            sets = [words_of(t) for t in batch.column(2).to_pylist()]
            found = [sorted(place[w] for w in s & place.keys()) for s in sets]
            swaps = [[place[x] for pair in _swaps(s) for x in pair] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "swaps"])

    rows = sorted(map(tuple, texts.mapInArrow(places, "doc_id long, toxic int, words array<int>, swaps array<int>").collect()))
    return fit([r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows], dtype=float), words)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [given.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_part("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
