"""Operator 1: language ID by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1 (bits of a
hash of its code point, so every letter of any script has its own). A trigram's vector is the product of its
letters' vectors, the first permuted twice and the second once (binding); a
document is the sum of its trigrams' vectors (bundling); a language is the sum
of its training documents' unit vectors. The language whose prototype has the
largest cosine with the document wins; ties go to the smaller name.

Letters are what Unicode calls alphabetic, lower-cased; runs of anything else
are one space. Bundling is linear, so a batch of documents is a matrix of
trigram counts times the matrix of the trigrams' vectors.

Training takes every labelled row of the training fold: a task sums its own
rows, so only a vector for each language and task is shuffled.

Cases: null text, empty text or one without a letter is `und` with score 0; so
is everything if no row can train; the score is the winning cosine cut to 0
to 1; repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_part, only, released, staged

DIMS = 1024
#: Characters of a text handled at once; texts of a batch multiplied at once; trigram vectors made at once.
SLICE, ROWS, VECTORS = 1 << 20, 256, 4096
#: Prototypes are summed as whole numbers, so that the order of sums doesn't matter.
SCALE = 1_000_000
UNKNOWN = "und"
#: A document must reach this share of the low quantile of learned scores for its language and length.
SHARE, QUANTILE = 0.3, 0.01
#: Two standard deviations of the cosine of unrelated vectors: texts of any length must reach it.
NOISE = 2 / DIMS**0.5
#: Quantiles of scores are counted in steps of one in STEPS, so that their counts are few whatever the number of documents.
STEPS = 10_000
_BITS = 21
_ONE = (1 << _BITS) - 1
_fixed: dict[str, np.ndarray] = {}


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A vector of +1 and -1 for each code point (0 is the space): the bits of hashes of code point and place, so no table is needed."""
    words = DIMS // 64
    h = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int8) * np.int8(2) - np.int8(1)


def _letters() -> np.ndarray:
    """Each code point itself if it is a letter, else 0."""
    if "letters" not in _fixed:
        points = np.zeros(0x110000, dtype=np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                points[c] = c
        _fixed["letters"] = points
    return _fixed["letters"]


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three code points of 21 bits) and counts of the letter trigrams of a whole text, slice by slice."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letters, parts, carry = _letters(), [], np.zeros(1, dtype=np.int64)
    for at in range(0, len(text), SLICE):
        piece = text[at : at + SLICE].lower()
        s = letters[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        if at + SLICE >= len(text):
            s = np.append(s, 0)
        s = np.concatenate([carry, s])
        s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]  # one space for each run
        if len(s) > 2:
            codes = (s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:]
            parts.append(np.unique(codes, return_counts=True))
        carry = s[-2:]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: their letters' vectors, permuted by place, multiplied."""
    out = None
    for place in (2, 1, 0):
        points, at = np.unique((codes >> place * _BITS) & _ONE, return_inverse=True)
        own = np.roll(letter_vectors(points), place, axis=1)[at]
        out = own if out is None else out * own
    return out


def bundles(texts: list[str | None]) -> np.ndarray:
    """One unit vector for each text; zeros without a trigram that has a letter."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    found = [trigram_counts(t) for t in texts]
    if sum(len(c) for c, _ in found):
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        rows = np.repeat(np.arange(len(texts)), [len(c) for c, _ in found])
        counts = np.concatenate([n for _, n in found]).astype(np.float32)
        for lo in range(0, len(codes), VECTORS):
            grams = gram_vectors(codes[lo : lo + VECTORS])
            here = (at >= lo) & (at < lo + VECTORS)
            m = np.zeros((len(texts), len(grams)), dtype=np.float32)
            m[rows[here], at[here] - lo] = counts[here]
            out += m @ grams.astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sums(batches):
    """(lang, text) -> for each language the sum of its unit vectors, as whole numbers."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo in range(0, len(texts), ROWS):
            vectors = np.rint(bundles(texts[lo : lo + ROWS]) * SCALE).astype(np.int64)
            names = np.array(langs[lo : lo + ROWS], dtype=object)
            for lang in set(names):
                total[lang] = total.get(lang, 0) + vectors[names == lang].sum(axis=0)
    for lang, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "v"])


def trains(fold: int = 2, folds: int = 4):
    """Whether a row is labelled and outside the held-out fold."""
    return F.col("lang").isNotNull() & (F.coalesce(crc_part("doc_id", folds), F.lit(-1)) != fold)


def train(docs: DataFrame, fold: int = 2, folds: int = 4) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit prototypes, from all labelled rows outside the held-out fold."""
    picked = only(docs, "doc_id", "text", "lang").where(trains(fold, folds)).select("lang", "text")
    sums = picked.mapInArrow(_sums, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    names = sorted({r["lang"] for r in sums})
    table = np.zeros((len(names), DIMS))
    for r in sums:
        table[names.index(r["lang"]), r["dim"]] = r["v"]
    norm = np.linalg.norm(table, axis=1)
    kept = norm > 0
    return [n for n, k in zip(names, kept, strict=True) if k], (table[kept] / norm[kept, None]).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """All columns of docs with lang_pred and score; only the text is looked at."""
    model = docs.sparkSession.sparkContext.broadcast((names, prototypes))
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        names, prototypes = model.value
        for batch in batches:
            found, scores = [], []
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.column(at).slice(lo, ROWS).to_pylist()
                known = [has_letter(t) for t in part]
                if names:
                    cosines = bundles(part) @ prototypes.T
                    best = cosines.argmax(axis=1)
                    found += [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    scores += [min(1.0, max(0.0, float(c[b]))) if k else 0.0 for c, b, k in zip(cosines, best, known, strict=True)]
                else:
                    found += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
        released()

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score for every row."""
    names, prototypes = train(docs)
    return predict(only(docs, "doc_id", "text"), names, prototypes).select(
        "doc_id", F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def least_scores(found: DataFrame, share: float = SHARE, quantile: float = QUANTILE) -> list[float]:
    """For texts of 2 ** k letters and more (k is the place in the list): what a document's score must reach.

    found has all documents with lang_pred and score. The threshold is a share of the low quantile of the scores that training documents of
    about that length have with their own language, the least of all languages;
    cosines with a prototype grow with the length of a text, so longer texts
    must reach more. Lengths of under 20 training documents take the shorter one's, the shortest `NOISE`.
    """
    scored = found.where(trains() & (F.col("lang") == F.col("lang_pred")))
    steps = scored.groupBy("lang", _band(F.col("text")).alias("band"), F.floor(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "band")
    ranked = steps.withColumns({"upto": F.sum("n").over(group.orderBy("step")), "all": F.sum("n").over(group)})
    rows = ranked.where((F.col("all") >= 20) & (F.col("upto") >= F.col("all") * quantile)).groupBy("lang", "band").agg(F.min("step").alias("step")).collect()
    lows: dict[int, float] = {}
    for r in rows:
        lows[r["band"]] = min(r["step"] / STEPS, lows.get(r["band"], 1.0))
    out = [NOISE]
    for k in range(40):
        out.append(max(out[-1], share * lows.get(k, 0.0)))
    return out[1:]


def _band(text):
    return F.least(F.lit(39), F.floor(F.log2(F.greatest(F.length(text), F.lit(1))))).cast("int")


def in_known_language(docs: DataFrame) -> DataFrame:
    """Rows of documents without those rejected: no letter at all, or hardly like any language for their length.

    A missing lang becomes the language found; other columns stay as they are.
    Prototypes and thresholds are those of all training documents; scores are written once, for the thresholds and for the choice.
    """
    names, prototypes = train(docs)
    found = staged(predict(docs, names, prototypes), "languages")
    least = F.element_at(F.array(*[F.lit(x) for x in least_scores(found)]), _band(F.col("text")) + 1)
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
