"""Operator 4: quality rules with n-gram perplexity bands for each language.

Base rules count words, symbols, repeated lines and repeated five-word
windows. Documents that pass them are scored by a modified Kneser-Ney model
of sequences of four code points of their language (column lang; a missing one
is a language of its own). Every code point is its own symbol, in any script.

Partitions count their distinct sequences, Spark adds the counts of all
documents and computes, order by order, continuation counts, discounts,
context weights and interpolated log probabilities with DataFrame joins and
aggregates: nothing of the model passes through one task, and it grows with
the corpus. Scoring holds sequences in arrays sorted by 64-bit hash. The
CORE most frequent ones (by powers of two of their counts) go to all workers;
what a document has beyond them is joined with the rest of the model in Spark.
Both ways look up the same table, so the place of the cut changes no result.

A document is kept if its perplexity lies between its language's lower and
upper band: the median of log perplexity less BELOW and plus ABOVE median
absolute deviations, widened for short texts. The lower band rejects texts
that are far more predictable than the language (one phrase over and over), the
upper one what is hardly text of it.

Counts, model and bands cover all documents of the table.

Cases: null and empty texts have no words and fail the base rules; a language
in which no document passes them has no band and keeps nothing; repeated rows
are judged alike; equal lines count from the second on; very long texts are
counted slice by slice; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, released, staged, values

# The base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5
#: Deviations that a text may lie above and below its language's median; widening for short texts (characters).
ABOVE, BELOW, SHORT = 7.0, 5.0, 400.0
#: Code points in a sequence; characters that are taken at once; characters that a task holds before it counts them.
ORDER, SLICE, BLOCK = 4, 1 << 20, 4_000_000
#: Sequences that go to every worker: 16 bytes each, 64 MB at most.
CORE = 1 << 22
#: Languages whose bands and discounts are broadcast; more are joined.
MOST_LANGS = 100_000
_NONE = ""
_BITS = 21
_ONE = (1 << _BITS) - 1
_TWO = (1 << 2 * _BITS) - 1


def symbols(text: str):
    """Code points plus one of a text, slice by slice, each after the three before it (0 stands before the text)."""
    carry = np.zeros(ORDER - 1, dtype=np.int64)
    for at in range(0, len(text), SLICE):
        s = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
        s = np.concatenate([carry, s])
        yield s
        carry = s[-(ORDER - 1) :]


def halves(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences that end at each symbol from the fourth on: first and last two symbols as numbers."""
    two = (s[:-1] << _BITS) | s[1:]
    return two[:-2], two[2:]


def hashed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    ws = data.split()
    n = len(ws)
    chars = sum(len(x.decode("utf-8", "surrogatepass")) for x in ws) if len(data) != len(text) else sum(map(len, ws))
    symbols = sum(data.count(s) for s in SYMBOLS.encode())
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line and line.split(None, 1):
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= WINDOW and len(set(ws)) < n:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), dtype=np.int64, count=n)
        win = a[: n - WINDOW + 1]
        for i in range(1, WINDOW):  # number the windows exactly, one word more each time
            _, win = np.unique(win[: n - WINDOW + 1] * len(ids) + a[i : n - WINDOW + 1 + i], return_inverse=True)
        twice = np.bincount(win)[win] > 1
        if twice.any():
            edge = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, dup, repeated


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > REPEAT_SHARE * n_words


_COUNTED = pa.schema([("lang", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sequences of a block as halves, with their counts. Symbols get numbers of 15 bits, so that a sequence is one number to sort."""
    known = np.unique(np.concatenate([np.unique(p) for p in parts]))
    if len(known) > 1 << 15:  # split a block of more symbols than that
        if len(parts) == 1:
            k = len(parts[0]) // 2
            parts = [parts[0][: k + ORDER - 1], parts[0][k:]]
        cut = len(parts) // 2
        some = [_distinct(parts[:cut]), _distinct(parts[cut:])]
        return tuple(np.concatenate(c) for c in zip(*some, strict=True))
    codes = []
    for p in parts:
        s = np.searchsorted(known, p)
        codes.append((s[:-3] << 45) | (s[1:-2] << 30) | (s[2:-1] << 15) | s[3:])
    codes = np.sort(np.concatenate(codes))
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    n, codes = np.diff(np.append(first, len(codes))), codes[first]
    part = lambda shift: known[(codes >> shift) & 0x7FFF]
    return (part(45) << _BITS) | part(30), (part(15) << _BITS) | part(0), n


def _count(batches):
    """(lang, text) -> (lang, x, y, n): the sequences of a block of texts."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def counted():
        for lang, parts in held.items():
            x, y, n = _distinct(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], schema=_COUNTED)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
            for s in symbols(text or ""):
                held.setdefault(lang, []).append(s)
                size += len(s)
                if size >= BLOCK:
                    yield from counted()
                    held, size = {}, 0
    yield from counted()
    held.clear()
    released()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, x, y, n): how often each sequence of four symbols stands in all texts of a language."""
    rows = docs.select(F.coalesce("lang", F.lit(_NONE)).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(_count, "lang string, x long, y long, n long").groupBy("lang", "x", "y").agg(F.sum("n").alias("n"))


def _small(table: DataFrame) -> DataFrame:
    """One row a language: broadcast if there are at most MOST_LANGS."""
    table = staged(table, "langs")
    return F.broadcast(table) if table.limit(MOST_LANGS + 1).count() <= MOST_LANGS else table


def model(docs: DataFrame) -> DataFrame:
    """(lang, x, y, n, log_p): natural log probability of a sequence's last symbol after the others, by modified Kneser-Ney.

    Orders below four count the distinct symbols in front of a sequence. All
    orders keep their sequences as one number (x beside it at order four).
    """
    top = staged(counts(docs), "sequences").withColumn("key", (F.col("x").bitwiseAND(_ONE) * F.lit(1 << 2 * _BITS)).bitwiseOR(F.col("y")))
    top = top.withColumn("context", (F.col("x") * F.lit(1 << _BITS)).bitwiseOR(F.shiftright("y", _BITS)))
    levels = [top]
    for k in (3, 2, 1):  # key: the sequence itself; tail: without its first symbol; context: without its last
        source = levels[-1].select("lang", F.col("key" if k == 3 else "tail").alias("key"))
        grams = staged(source.groupBy("lang", "key").agg(F.count("*").alias("n")), f"order{k}")
        levels.append(grams.withColumns({"context": F.shiftright("key", _BITS), "tail": F.col("key").bitwiseAND((1 << (k - 1) * _BITS) - 1)}))
    lower = _small(levels[-1].groupBy("lang").agg((1.0 / F.count("*")).alias("below")))
    for k, grams in zip((1, 2, 3, 4), reversed(levels), strict=True):
        t = [F.count_if(F.col("n") == i).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        seen = grams.groupBy("lang").agg(*t)
        y = F.when((F.col("t1") > 0) & (F.col("t2") > 0), F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)
        d = [F.when((F.col(f"t{i}") > 0) & (F.col(f"t{i + 1}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")))).otherwise(0.5 * min(i, 1.5)).alias(f"d{i}") for i in (1, 2, 3)]
        rows = grams.join(_small(seen.select("lang", *d)), "lang")
        rows = rows.withColumn("took", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).drop("d1", "d2", "d3")
        weights = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("took") / F.sum("n")).alias("gamma"))
        rows = rows.join(weights, ["lang", "context"])
        if k == 1:
            rows = rows.join(lower, "lang")
        else:
            tail = "key" if k == 4 else "tail"
            rows = rows.join(lower.select("lang", F.col("key").alias("__key"), F.col("p").alias("below")), (rows["lang"] == lower["lang"]) & (rows[tail] == F.col("__key"))).drop(lower["lang"])
        p = (F.col("n") - F.col("took")) / F.col("total") + F.col("gamma") * F.col("below")
        lower = staged(rows.select("lang", *(["x", "y", "n"] if k == 4 else ["key"]), p.alias("p")), f"probable{k}")
    return lower.select("lang", "x", "y", "n", F.log("p").alias("log_p"))


class Core:
    """The log probabilities of a language's frequent sequences, in arrays sorted by hash with the start of each leading-bits bucket."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray):
        at = np.argsort(hashes)
        self.bits = max(int(len(at)).bit_length(), 1)
        self.keys = np.append(hashes[at], np.uint64((1 << 64) - 1))
        self.logs = np.append(logs[at], 0.0)
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.searchsorted(self.keys[:-1], edges).astype(np.uint32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is there, its log probability or 0)."""
        at = self.start[wanted >> np.uint64(64 - self.bits)]
        there = self.keys[at]
        open_ = np.flatnonzero(there < wanted)
        while len(open_):
            at[open_] += 1
            there[open_] = now = self.keys[at[open_]]
            open_ = open_[now < wanted[open_]]
        hit = (there == wanted) & (at < len(self.keys) - 1)
        return hit, np.where(hit, self.logs[at], 0.0)


def _core(table: DataFrame) -> tuple[dict[str, Core], DataFrame | None]:
    """The frequent part of the model for all workers, at most CORE rows, and the rest (None if nothing is left)."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = sorted(((r["level"], r["rows"]) for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, taken = 64, 0
    for at, rows in sizes:
        if taken + rows > CORE:
            break
        least, taken = at, taken + rows
    got = table.where(level >= least).select("lang", "x", "y", "log_p").toArrow()
    langs = pa.chunked_array(got.column("lang")).combine_chunks().dictionary_encode()
    langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
    codes, logs, at = hashed(got.column("x").to_numpy(), got.column("y").to_numpy()), got.column("log_p").to_numpy(), langs.indices.to_numpy()
    cores = {lang: Core(codes[at == i], logs[at == i]) for i, lang in enumerate(langs.dictionary.to_pylist())}
    return cores, table.where(level < least) if taken < sum(r for _, r in sizes) else None


_NOTHING = (np.empty(0, np.int64),) * 3


def _sum(core: Core | None, text: str) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sum of log probabilities of the sequences that the core holds; halves and counts of the others."""
    total, others = 0.0, []
    for s in symbols(text):
        x, y = halves(s)
        if core is None:
            others.append(s)
            continue
        hit, logs = core.find(hashed(x, y))
        total += float(logs.sum())
        if not hit.all():
            for i in np.flatnonzero(~hit):
                others.append(s[i : i + ORDER])
    return total, _distinct(others) if others else _NOTHING


_MISSED = "array<struct<x: bigint, y: bigint, n: bigint>>"


def measure(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, lang, base counts, base_failed, chars and log perplexity (null without a text)."""
    spark = docs.sparkSession
    cores, rest = _core(table)
    given = spark.sparkContext.broadcast(cores)
    missed_type = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        cores = given.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                base = [base_counts(t) for t in texts]
                sums = [_sum(cores.get(x or _NONE), t) if t else (None, _NOTHING) for x, t in zip(langs, texts, strict=True)]
                cols = [batch.column(0), pa.array([x or _NONE for x in langs], pa.string()), *(pa.array(c, pa.int64()) for c in zip(*base, strict=True))]
                missed = [[dict(zip("xyn", r, strict=True)) for r in zip(*(c.tolist() for c in m), strict=True)] or None for _, m in sums]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([base_failed(b[0], b[4]) for b in base]), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([v for v, _ in sums], pa.float64()), pa.array(missed, missed_type)],
                    names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars", "total", "missed"],
                )
        released()

    schema = f"doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars long, total double, missed {_MISSED}"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, schema)
    if rest is not None:
        out = staged(out.withColumn("row", F.monotonically_increasing_id()), "scored")
        each = out.select("row", "lang", F.explode("missed").alias("m")).select("row", "lang", "m.*")
        rare = each.join(rest.select("lang", "x", "y", "log_p"), ["lang", "x", "y"]).groupBy("row").agg(F.sum(F.col("n") * F.col("log_p")).alias("more"))
        out = out.join(rare, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).drop("row", "more")
    return out.withColumn("log_ppl", -F.col("total") / F.col("chars")).drop("missed", "total")


def judged(docs: DataFrame, above: float = ABOVE, below: float = BELOW) -> DataFrame:
    """(doc_id, lang, text, ...) -> doc_id, the base counts, base_failed, kept, perplexity and the bands."""
    docs = only(docs, "doc_id", "lang", "text")
    scored = staged(measure(docs, model(docs)), "perplexity")
    # Rounded to thousandths, so the exact percentiles hold a bounded number of values.
    fair = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).select("lang", F.round("log_ppl", 3).alias("v"))
    middle = fair.groupBy("lang").agg(F.percentile("v", F.lit(0.5)).alias("middle"))
    spread = fair.join(_small(middle), "lang").groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile(F.abs(F.col("v") - F.col("middle")), F.lit(0.5)).alias("spread"))
    wide = F.greatest(F.col("spread"), F.lit(0.005)) * F.sqrt(1 + F.lit(SHORT) / F.greatest("chars", F.lit(1)))
    at = scored.join(_small(spread), "lang", "left")
    low, high = F.col("middle") - below * wide, F.col("middle") + above * wide
    fits = F.coalesce((F.col("log_ppl") >= low) & (F.col("log_ppl") <= high), F.lit(False))
    return at.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & fits).alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp(low).alias("lower_band"), F.exp(high).alias("upper_band"),
    )


def op4_quality_perplexity(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
