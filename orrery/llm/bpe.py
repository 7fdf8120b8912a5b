"""Operator 2: byte-level BPE encoding and decoding with recursive SQL in each partition.

The public pattern cuts a text into pieces; each distinct piece is encoded
once. DuckDB, embedded in the Python worker, holds the merge table (every pair
of ids whose bytes join to an id, with that id as rank). A recursive query
unnests the open pieces into token-position rows, joins neighbours with the
merge table, takes each piece's leftmost pair of minimum rank and contracts
it, until no piece has a pair. Decoding joins token-position rows with the
vocabulary and aggregates their bytes in position order.

A piece of over `LONG` bytes is encoded in parts of `LONG`, which are then
joined two by two, level by level. A sequence of tokens is the encoding of its
bytes exactly if every two neighbours are the encoding of theirs: up to the
first contraction across a boundary both sides have contracted as they do
alone. So a seam is checked on its two tokens; where they don't hold, the
tokens around it are encoded again together, twice as many each time, until
the seams at both ends hold. All seams of a level go into one query. Time and
memory stay in proportion to the length.

Memory is bounded: texts are cut where the pattern must cut anyway, so a long
text is handled slice by slice; pieces wait for the query in groups of
`GROUP`; the pieces known to a worker are forgotten beyond `KNOWN` and when its
task ends.

Cases: null text is the empty text (no ids; digests of the empty string);
blank texts have ids of white space; strings that look like special tokens are
ordinary text; repeated rows are encoded alike; null ids decode to nothing; an
empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import only, released, tokenizer_path

GROUP, KNOWN, SLICE = 100_000, 400_000, 1 << 20
#: Bytes of a piece, or of a part of one, that the query contracts as a whole; bytes of a query.
LONG, QUERY_BYTES = 48, 2_000_000
#: Characters of texts taken together; tokens decoded together.
TOGETHER = 3_000_000

#: Of each open word the least (rank, place) of its pairs is contracted; a word without a pair, or of one token, is done and told once.
ENCODE = """
WITH RECURSIVE step(w, toks, open) AS (
  SELECT w, toks, len(toks) > 1 FROM fresh
  UNION ALL
  SELECT s.w,
         CASE WHEN m.best IS NULL THEN s.toks
              ELSE list_concat(list_append(s.toks[:(m.best & 4294967295) - 1], (m.best >> 32)::INT), s.toks[(m.best & 4294967295) + 2:]) END,
         m.best IS NOT NULL AND len(s.toks) > 2
  FROM step s LEFT JOIN (
    SELECT p.w, min((g.rank::BIGINT << 32) + p.spot) AS best
    FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS spot FROM step WHERE open) p
    JOIN merges g ON g.l = p.l AND g.r = p.r
    GROUP BY p.w) m ON m.w = s.w
  WHERE s.open)
SELECT w, toks AS ids FROM step WHERE NOT open ORDER BY w
"""

#: One thread adds up the rows in the order of the subquery, so that a text's tokens are sorted once and not text by text.
DECODE = """
SELECT d, string_agg(hex, '') AS hex
FROM (SELECT d, hex FROM (SELECT d, unnest(ids) AS id, unnest(range(len(ids))) AS spot FROM encoded) JOIN vocabulary USING (id) ORDER BY d, spot)
GROUP BY d
"""

DIGEST = f"""
SELECT e.d, sha256(array_to_string(e.ids, ' ')) AS ids_sha256, sha256(unhex(coalesce(t.hex, ''))) AS decoded_sha256
FROM encoded e LEFT JOIN ({DECODE}) t ON t.d = e.d ORDER BY e.d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cut(text: str, size: int = SLICE):
    """Slices of the text that end where a match of the pattern ends: before a single space between other characters."""
    lo = 0
    while len(text) - lo > size:
        hi = lo + size
        while hi < len(text) - 1 and not (text[hi] == " " and not text[hi - 1].isspace() and not text[hi + 1].isspace()):
            hi += 1
        if hi >= len(text) - 1:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


class _Places(dict):
    """Piece -> its number; new pieces get the next one and wait to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.waiting.append(piece)
        return n


def tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, pa.Table, pa.Table, dict[bytes, int], dict[int, bytes]]:
    """Ids of the single bytes, the merge table (every pair whose bytes join to an id), the vocabulary as a table, as ids of bytes and as bytes of ids."""
    byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
    merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    l, r, rank = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
    return byte, pa.table({"l": l, "r": r, "rank": rank}), pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}), ranks, {r: t for t, r in ranks.items()}


class Codec:
    """Encoder and decoder of one task; closing it gives DuckDB's memory back."""

    def __init__(self, given: tuple[np.ndarray, pa.Table, pa.Table, dict[bytes, int], dict[int, bytes]], pattern: str):
        import duckdb

        self.pieces = regex.compile(pattern).findall
        self.byte, self.id_of, self.bytes_of = given[0], given[3], given[4]
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for name, table in (("merges", given[1]), ("vocabulary", given[2])):
            self.sql.register("given", table)
            self.sql.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.sql.unregister("given")
        self.forget()

    def close(self):
        self.sql.close()
        self.forget()
        released()

    def forget(self):
        self.place = _Places()
        self.ids, self.starts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        self.joined = None

    def _contracted(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one behind the other, and where each word's begin and the last one's end."""
        ids, sizes, lo = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], 0
        lengths = np.cumsum([0, *map(len, data)])
        while lo < len(data):
            hi = max(int(np.searchsorted(lengths, lengths[lo] + QUERY_BYTES, side="right")) - 1, lo + 1)
            flat = self.byte[np.frombuffer(b"".join(data[lo:hi]), dtype=np.uint8)]
            toks = pa.ListArray.from_arrays(pa.array((lengths[lo : hi + 1] - lengths[lo]).astype(np.int32)), pa.array(flat))
            self.sql.register("fresh", pa.table({"w": pa.array(np.arange(hi - lo, dtype=np.int32)), "toks": toks}))
            done = self.sql.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
            self.sql.unregister("fresh")
            if isinstance(done, pa.ChunkedArray):
                done = done.chunk(0)
            ids.append(done.flatten().to_numpy().astype(np.int32))
            sizes.append(np.diff(done.offsets.to_numpy()).astype(np.int64))
            lo = hi
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _words(self, data: list[bytes]) -> list[list[int]]:
        """Ids of each word; equal words are contracted once."""
        place = {w: i for i, w in enumerate(dict.fromkeys(data))}
        ids, starts = self._contracted(list(place))
        return [ids[starts[k] : starts[k + 1]].tolist() for k in map(place.__getitem__, data)]

    def _join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The encoding of the bytes of both sides of each pair, from the encodings of the sides."""
        out: list[list[int]] = [[] for _ in pairs]
        text = lambda ids: b"".join(map(self.bytes_of.__getitem__, ids))
        asked = range(len(pairs))
        around = 1
        while asked:
            sides = [(pairs[p][0][-around:], pairs[p][1][:around]) for p in asked]
            middles = self._words([text(a) + text(b) for a, b in sides])
            edges, seams = [], []
            for p, middle in zip(asked, middles, strict=True):
                a, b = pairs[p]
                out[p] = a[:-around] + middle + b[around:]
                seams.append([t for t in ((*a[-around - 1 : -around], middle[0]), (middle[-1], *b[around : around + 1])) if len(t) == 2])
                edges += seams[-1]
            holds = {t for t, ids in zip(edges, self._words([text(t) for t in edges]), strict=True) if tuple(ids) == t}
            asked = [p for p, ts in zip(asked, seams, strict=True) if not holds.issuperset(ts)]
            around *= 2
        return out

    def _long(self, data: list[bytes]) -> list[list[int]]:
        """Ids of long pieces."""
        parts = [[d[i : i + LONG] for i in range(0, len(d), LONG)] for d in data]
        ids = iter(self._words([x for p in parts for x in p]))
        segments = [[next(ids) for _ in p] for p in parts]
        while any(len(x) > 1 for x in segments):
            done = iter(self._join([(x[i], x[i + 1]) for x in segments for i in range(0, len(x) - 1, 2)]))
            segments = [[next(done) for _ in range(0, len(x) - 1, 2)] + x[len(x) - len(x) % 2 :] for x in segments]
        return [x[0] for x in segments]

    def contract(self):
        """Encode the waiting pieces."""
        if not self.place.waiting:
            return
        data = [p.encode("utf-8", "surrogatepass") for p in self.place.waiting]
        # As the library does, a piece that is in the vocabulary is that id, whatever contraction would make of it.
        done = {i: [self.id_of[d]] for i, d in enumerate(data) if d in self.id_of}
        long = [i for i, d in enumerate(data) if len(d) > LONG and i not in done]
        if long:
            done.update(zip(long, self._long([data[i] for i in long]), strict=True))
        ids, starts = self._contracted([b"" if i in done else d for i, d in enumerate(data)])
        sizes = np.diff(starts)
        sizes[list(done)] = [len(x) for x in done.values()]
        given = np.zeros(len(data), dtype=bool)
        given[list(done)] = True
        here = np.repeat(given, sizes)
        whole = np.empty(len(here), dtype=np.int32)
        whole[~here] = ids
        whole[here] = [t for i in sorted(done) for t in done[i]]
        ids, starts = whole, np.cumsum(np.concatenate([[0], sizes]))
        self.ids.append(ids)
        self.starts.append(self.starts[-1][-1] + starts[1:])
        self.place.waiting, self.joined = [], None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.place) > KNOWN:
            self.forget()
        places = []
        for text in texts:
            spots: list[np.ndarray] = []
            for part in cut(text or ""):
                found = self.pieces(part)
                spots.append(np.fromiter(map(self.place.__getitem__, found), dtype=np.int64, count=len(found)))
                if len(self.place.waiting) >= GROUP:
                    self.contract()
            places.append(spots[0] if len(spots) == 1 else np.concatenate(spots))
        self.contract()
        if self.joined is None:
            self.joined = np.concatenate(self.ids), np.concatenate(self.starts)
            self.ids, self.starts = [self.joined[0]], [self.joined[1]]
        ids, starts = self.joined
        out = []
        for spots in places:
            size = starts[spots + 1] - starts[spots]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(ids[np.arange(total) + np.repeat(starts[spots] - (ends - size), size)] if total else np.empty(0, np.int32))
        return out

    def _ask(self, query: str, encoded: list[np.ndarray]) -> pa.Table:
        ends = np.cumsum([0, *map(len, encoded)]).astype(np.int32)
        flat = np.concatenate(encoded) if encoded else np.empty(0, np.int32)
        given = pa.table({"d": pa.array(np.arange(len(encoded), dtype=np.int32)), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})
        self.sql.register("encoded", given)
        try:
            return self.sql.sql(query).to_arrow_table()
        finally:
            self.sql.unregister("encoded")

    def digests(self, encoded: list[np.ndarray]) -> tuple[list[str], list[str]]:
        """sha256 of the ids and of the bytes that they decode to."""
        got = self._ask(DIGEST, encoded)
        return got.column("ids_sha256").to_pylist(), got.column("decoded_sha256").to_pylist()

    def decode(self, encoded: list[np.ndarray]) -> list[bytes]:
        got = self._ask(DECODE, encoded)
        out = [b""] * len(encoded)
        for d, h in zip(got.column("d").to_pylist(), got.column("hex").to_pylist(), strict=True):
            out[d] = bytes.fromhex(h)
        return out


_held: dict[tuple, tuple] = {}


def _codec(given) -> Codec:
    """A codec for a task; its tables are made once for a worker (another vocabulary replaces them)."""
    ranks, pattern = given.value
    key = (id(given), len(ranks))
    if key not in _held:
        _held.clear()
        _held[key] = tables(ranks)
    return Codec(_held[key], pattern)


def _shared(docs: DataFrame, path: str | None, pattern: str | None):
    import public_tokenizers

    ranks = read_ranks(path or tokenizer_path("byte_bpe_50k.tiktoken"))
    return docs.sparkSession.sparkContext.broadcast((ranks, pattern or public_tokenizers.PATTERN))


def _portions(texts: pa.Array):
    """Row ranges of bounded size (in bytes, so with fewer characters)."""
    lo, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= TOGETHER:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """All columns of docs but the text, with ids and, if asked, n_tokens and the digests of ids and decoded bytes."""
    given = _shared(docs, path, pattern)
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if i != at]
    fields = [docs.schema.fields[i] for i in kept]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + _DIGESTS * with_digests

    def run(batches):
        codec = _codec(given)
        for batch in batches:
            for lo, hi in _portions(batch.column(at)):
                ids = codec.encode(batch.column(at).slice(lo, hi - lo).to_pylist())
                cols = [batch.column(i).slice(lo, hi - lo) for i in kept]
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                if with_digests:
                    cols += [pa.array(list(map(len, ids)), pa.int64()), *(pa.array(x, pa.string()) for x in codec.digests(ids))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        codec.close()

    return docs.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns of rows but the ids, with the decoded bytes as `decoded`."""
    given = _shared(rows, path, None)
    at = rows.columns.index(ids)
    kept = [i for i in range(len(rows.columns)) if i != at]
    fields = [*(rows.schema.fields[i] for i in kept), T.StructField("decoded", T.BinaryType())]

    def run(batches):
        codec = _codec(given)
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int32) for x in batch.column(at).to_pylist()]
            lo = 0
            while lo < len(lists):
                hi, size = lo + 1, len(lists[lo])
                while hi < len(lists) and size + len(lists[hi]) <= TOGETHER // 4:
                    size += len(lists[hi])
                    hi += 1
                cols = [batch.column(i).slice(lo, hi - lo) for i in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(codec.decode(lists[lo:hi]), pa.binary())], names=[f.name for f in fields])
                lo = hi
        codec.close()

    return rows.mapInArrow(run, T.StructType(fields))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, encoded and decoded."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return encode(docs, with_ids=False, with_digests=True)
