"""Operator 7: secret scans with password guess costs.

Three fixed patterns find assignments, access keys and long hexadecimal runs.
Besides, values in a credential context (more key words in the manner of
JSON, YAML, environment files, headers and XML; the password of a URL) are
measured: a dynamic programme cuts the whole value into words, dates, repeats,
keyboard walks and brute-force spans such that the product of their guesses is
smallest. A value that takes `10 ** least_cost` guesses or more is one more
span, of kind `cost`; column `costs` tells the guesses of every such value and of
the values of the patterns' assignments. Spans of the patterns stay whatever their cost; a value
that touches one of them is not reported again, nor are two spans of kind
`cost` that overlap (the first one stays).

Guesses of a piece: a common password or word its rank (times two if not in lower
case, times four if digits stand for letters); a run of letters that can be
spoken the size of a large dictionary; a date the days of `YEARS` years; a
repeat its unit's brute force times the times; a keyboard walk the keys and
directions to start with, times four for each turn; anything else the size of
its character classes to the power of its length. Pieces multiply, with a
factor of two for each. All costs add up along the value, so the programme
takes time in proportion to its length, whatever that is.

Words are ranked by their counts in all documents (`ranked_words`: at most the
`WORDS_KEPT` most frequent runs of ASCII letters, behind the fixed list).

Cases: null and empty texts have no spans; repeated rows get equal results;
spans are sorted by start, kind, end; extra columns are kept by `scan` and
ignored by the query; an empty table has no words and no spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, only, released, staged, values

KINDS = ("assign", "access", "hex", "cost")
# The base patterns and least lengths.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Key words of a credential context. Every one holds a word of _HINTS: texts without these need no search.
_KEYS = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth(?:orization)?|(?:private|access|signing|encryption)[_-]?key"
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")
#: key: value, key=value, key => value, "key": "value", <key>value<; a scheme word of a header is skipped.
CONTEXT = re.compile(rf"""(?:(?i:{_KEYS})["']?\x20*(?:=>|:=|[:=])\x20*|<(?i:{_KEYS})>)(?:(?i:bearer|basic|digest|apikey)\x20+)?(?:"([^"\s]{{6,}})"|'([^'\s]{{6,}})'|([!#-&(-;=?-~][!#-&(-+\--:=?-~]{{5,}}))""", re.ASCII)
#: The password of a URL, with or without a user name.
URL = re.compile(r"://[^\s:/@]*:([!-.0-?A-~]{6,}?)@", re.ASCII)
#: What may close a sentence or a bracket behind an unquoted value.
_CLOSING = "\"'.,;:!?)]}>&*%#$"
LEAST_COST, YEARS, WORDS_KEPT = 12.0, 119, 50_000

# Common passwords and words in them, most common first.
WORDS = (
    "password pass 123456 123456789 12345678 qwerty abc123 admin letmein welcome login master hello monkey dragon "
    "secret iloveyou princess sunshine shadow football baseball superman batman trustno1 access root user test guest "
    "changeme default love money summer winter spring autumn monday friday january december july august michael jordan "
    "thomas daniel andrew jessica ashley charlie george buster killer hunter soccer hockey tiger ginger pepper cheese "
    "computer internet server database oracle mysql system manager service support office company public private key "
    "token the and for you not with your this that from have will one two three blue red green black white gold silver "
    "star moon sun cat dog fish bird home work life time year day night good bad new old big little king queen"
).split()
#: Lengths of the words that are learned.
SHORTEST_WORD, LONGEST_WORD = 3, 20
# Rows of the keyboard.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))
_LEET = str.maketrans("4@8301!|5$7+", "aabeoiilsstt")
#: Lower-case runs that can be spoken count as one of the words of a large dictionary.
_SPOKEN = re.compile(r"(?:[b-df-hj-np-tv-xz]{0,3}[aeiouy]{1,3}){1,6}[b-df-hj-np-tv-xz]{0,3}")
DICTIONARY = 200_000
_RUN = re.compile(r"[a-z]{4,}")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
#: log10 of guesses: a piece more, the start of a walk, a turn of it.
PIECE, WALK, TURN = math.log10(2), math.log10(len(_PLACE) * 4 * 16), math.log10(4)
LONGEST_UNIT = 8
#: Sizes of the classes digit, lower case, upper case, other; of every set of them as bits.
_SIZES = (10, 26, 26, 33)
_LOGS = [math.log10(max(sum(s for k, s in enumerate(_SIZES) if m >> k & 1), 2)) for m in range(16)]
_LETTERS = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

Ranks = dict[str, int]


def ranks_of(words: list[str]) -> Ranks:
    """Rank of each word: the fixed list first, then the given words in order."""
    out: Ranks = {}
    for w in [*WORDS, *words]:
        out.setdefault(w, len(out) + 1)
    return out


_FIXED = ranks_of([])


def ranked_words(docs: DataFrame, most: int = WORDS_KEPT) -> list[str]:
    """The most frequent words of all texts, by count, then alphabetically.

    Counts are taken in levels, eight for each doubling; the words of as many
    levels as hold `most` words at most reach the driver, and nothing else.
    """

    def run(batches):
        counted: Counter[bytes] = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counted], pa.string()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in values(batch.column(0)):
                counted.update(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split())
                if len(counted) > 300_000:
                    yield told()
                    counted.clear()
        if counted:
            yield told()
        counted.clear()
        released()

    rows = docs.where("text is not null").select("text").mapInArrow(run, "word string, n long").where(F.length("word").between(SHORTEST_WORD, LONGEST_WORD))
    words = staged(rows.groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "words")
    least, taken = None, 0
    for r in sorted(words.groupBy("level").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        if taken + r["words"] > most:
            break
        least, taken = r["level"], taken + r["words"]
    top = words.where(F.col("level") >= least).select("word", "n").collect() if taken else []
    discard(words)
    return [r["word"] for r in sorted(top, key=lambda r: (-r["n"], r["word"]))]


def _kind(c: str) -> int:
    return 1 if c.isdigit() else 2 if "a" <= c <= "z" else 4 if "A" <= c <= "Z" else 8


def brute(text: str) -> float:
    """log10 of the guesses of a brute-force span."""
    kinds = 0
    for c in text:
        kinds |= _kind(c)
    return len(text) * _LOGS[kinds]


def pieces(value: str, ranks: Ranks):
    """(start, end, log10 of guesses) of words, dates and repeats. A repeat starts where its run does: within one unit of it."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    leet = low.translate(_LEET)
    for m in _RUN.finditer(low):
        if _SPOKEN.fullmatch(m.group()):
            yield m.start(), m.end(), math.log10(DICTIONARY)
    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                yield i, j, math.log10(rank if value[i:j] == low[i:j] else 2 * rank)
            elif leet[i:j] != low[i:j] and (rank := ranks.get(leet[i:j])):
                yield i, j, math.log10(4 * rank)
        m = _DATE.match(value, i)
        if m:
            yield i, m.end(), math.log10(YEARS * (365 * 4 if m.end() - i > 4 else 1))
    for u in range(1, min(LONGEST_UNIT, n // 2) + 1):
        at = 0
        while at + u < n:  # a run: value[k] == value[k + u] for k from at
            end = at
            while end + u < n and value[end] == value[end + u]:
                end += 1
            for i in range(at, min(at + u, end)):
                unit = brute(value[i : i + u])
                for k in range(2, (end + u - i) // u + 1):
                    if k * u >= 3:
                        yield i, i + k * u, unit + math.log10(k)
            at = end + 1


def step(a: str, b: str) -> int | None:
    """Direction from one key to a neighbour on its row or to the one above or below."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if p is None or q is None:
        return None
    way = (q[0] - p[0], q[1] - p[1])
    return _STEPS.index(way) if way in _STEPS else None


def guess_cost(value: str, ranks: Ranks = _FIXED) -> float:
    """log10 of the guesses of the cheapest cut of the whole value.

    best[j] is the cheapest cut of the first j characters. Brute-force spans
    and walks of any length are carried along as open spans: spans[m] is the
    cheapest with a brute-force span open over the classes m, walks[d] with a
    walk of three keys or more that last went in direction d.
    """
    n = len(value)
    if not n:
        return 0.0
    inf = math.inf
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in pieces(value, ranks):
        ends[j].append((i, cost))
    low = value.lower() if len(value.lower()) == n else value
    ways = [None, *(step(low[k - 1], low[k]) for k in range(1, n))]
    best = [0.0] + [inf] * n
    spans, walks = [inf] * 16, [inf] * 4
    for j in range(1, n + 1):
        kind, before = _kind(value[j - 1]), best[j - 1]
        spans = [min(before + PIECE, spans[m]) + _LOGS[m] if m & kind else inf for m in range(16)]
        way = ways[j - 1]
        if way is None:
            walks = [inf] * 4
        else:
            going = min(walks[way], min(walks) + TURN)
            if j >= 3 and ways[j - 2] is not None:
                going = min(going, best[j - 3] + PIECE + WALK + (TURN if ways[j - 2] != way else 0.0))
            walks = [going if d == way else inf for d in range(4)]
        best[j] = min(min(spans), min(walks), min((best[i] + cost + PIECE for i, cost in ends[j]), default=inf))
    return best[n]


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, sorted."""
    if not text:
        return []
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN] if any(h in low for h in _HINTS) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str | None, base: list[tuple[int, int, int]], ranks: Ranks = _FIXED, least_cost: float = LEAST_COST) -> list[tuple[int, int, int]]:
    """The base spans and the costly values of credential contexts that touch none of them."""
    if not text:
        return base
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            value = m.group(k) if k < 3 else m.group(k).rstrip(_CLOSING)
            found.append((m.start(k), m.start(k) + len(value)))
    if "://" in text:
        found += [m.span(1) for m in URL.finditer(text)]
    extra, upto = [], 0
    for start, end in sorted(set(found)):
        if end - start < 6 or start < upto or any(s < end and start < e for s, _, e in base):
            continue
        if guess_cost(text[start:end], ranks) >= least_cost:
            extra.append((start, 3, end))
            upto = end
    return sorted([*base, *extra])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def costs(text: str, spans: list[tuple[int, int, int]], ranks: Ranks) -> str:
    """kind:start:log10 of guesses of each span in a credential context, the base's assignments among them."""
    out = []
    for s, k, e in spans:
        if KINDS[k] in ("assign", "cost"):
            value = ASSIGN.match(text, s, e).group(1) if KINDS[k] == "assign" else text[s:e]
            out.append(f"{KINDS[k]}:{s}:{guess_cost(value, ranks):.2f}")
    return ",".join(out)


_ADDED = {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType(), "costs": T.StringType()}


def _given(docs: DataFrame, words: list[str] | None):
    """The ranks for all workers: learned from the documents unless words are given."""
    return docs.sparkSession.sparkContext.broadcast(ranks_of(ranked_words(docs) if words is None else words))


def scan(docs: DataFrame, least_cost: float = LEAST_COST, words: list[str] | None = None) -> DataFrame:
    """All columns of docs with n_assign, n_access, n_hex, base_sha256, spans and costs (of the values in credential contexts)."""
    at, given = docs.columns.index("text"), _given(docs, words)

    def run(batches):
        ranks = given.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                base, every, guesses = [], [], []
                for t in batch.column(at).to_pylist():
                    base.append(base_spans(t))
                    spans = all_spans(t, base[-1], ranks, least_cost)
                    every.append(listed(spans))
                    guesses.append(costs(t, spans, ranks) if spans else "")
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(3)]
                prints = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *counts, prints, pa.array(every, pa.string()), pa.array(guesses, pa.string())], names=[*batch.schema.names, *_ADDED])
        released()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in _ADDED.items())]))


def redacted(docs: DataFrame, mark: str = "[SECRET]", least_cost: float = LEAST_COST, words: list[str] | None = None) -> DataFrame:
    """Rows of documents with every span (overlapping ones together) replaced by the mark; n_chars is the new length where text changed."""
    columns, given = docs.columns, _given(docs, words)
    at = columns.index("text")
    sized = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        ranks = given.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts, cols = batch.column(at).to_pylist(), list(batch.columns)
                sizes = cols[sized].to_pylist() if sized is not None else None
                for i, t in enumerate(texts):
                    spans = all_spans(t, base_spans(t), ranks, least_cost)
                    if not spans:
                        continue
                    out, upto = [], 0
                    for s, _, e in spans:
                        if s >= upto:
                            out += [t[upto:s], mark]
                        upto = max(upto, e)
                    texts[i] = "".join([*out, t[upto:]])
                    if sizes:
                        sizes[i] = len(texts[i])
                cols[at] = pa.array(texts, batch.schema.field(at).type)
                if sizes is not None:
                    cols[sized] = pa.array(sizes, batch.schema.field(sized).type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
        released()

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return scan(docs).drop("text")
