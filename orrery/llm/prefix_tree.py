"""Operator 8: n-gram Jaccard join with prefix trees.

A document is the set of its distinct five-word shingles, as 64-bit hashes
in one global order: by the level of a frequency sketch (a counter for each of
2 ** 24 ranges of the hashes, filled by all documents; its level tells how far
it stands out), then by hash. So shingles that many documents share come last
wherever their hash lies. The sketch only sets the order: any order gives the
same links. Two sets with a Jaccard similarity of 0.8 or more share a shingle
among the first n - ceil(0.8 n) + 1 of both, so candidates meet at such
shingles. Equal sets are one class before anything is joined.

Shingles with over SMALL members first test their members against a centre
(the member that has the shingle earliest in its order: an original has fewer
rare shingles in front than its edited copies), so a family of near copies
costs a few tests a member: members in one component need no test among
themselves. What is left is dealt by shared shingle. A task holds one shingle's
members (of a large group two blocks of it) as a prefix tree of the shared
shingles before this one; branches that have a shingle in common are left out,
as they meet at that shingle, and so are members whose lengths, places or
signatures (1,024 parities) can't reach the overlap. Pairs of a group are never
rows of a join. Shingles of up to SMALL members are joined directly: at most
SMALL - 1 rows for a row.

The pairs left are verified in chunks: the ordered sets of a chunk form a
prefix tree, which is traversed with the centre's set. Overlaps of common
beginnings are counted once, and subtrees are pruned where overlap so far plus
the shorter remainder can't reach the required overlap. No link between
different components is missed; links inside a component that is already known
are not listed.

Cases: null or blank texts have an empty set, link with nothing and are their
own component; texts of one to four words are one shingle; equal rows and
repeated ids fall into one class; null doc_id is a row whose component is the
smallest id of its class, null only if there is none; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.components import connected_components

from .common import WORD, discard, only, reclaim, released, staged, values
from .shingles import fingerprint, shingle_set

#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
#: Shingles that a task holds before it counts them.
BLOCK = 2_000_000
#: Counters of the frequency sketch, in slices of 2 ** SLICE_BITS: one byte each is broadcast, whatever the input.
SKETCH_BITS, SLICE_BITS = 24, 18
#: Members tested with a centre in one tree; members of a shingle above which it gets centres, and how many in turn.
CHUNK, SMALL, MOST_STARS = 64, 8, 4
#: Members of a shingle that one task holds at once (larger groups are dealt as pairs of blocks), and the shared
#: shingles of a member that go with it to tell at which of them a pair meets first.
HELD, PATH = 1024, 64
#: Bits of the maps of wanted documents (2 MB) and shared shingles (16 MB), whatever the input. They only spare
#: the shuffle rows that can't match; the joins behind them are exact.
WANTED_BITS, SHARED_BITS = 1 << 24, 1 << 27


def prefix_length(n):
    return n - -(-NUM * n // DEN) + 1


def ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A sorted set in global order: by level, then by hash."""
    level = levels[tokens >> np.uint64(64 - SKETCH_BITS)]
    return tokens[np.argsort(level, kind="stable")] if level.any() else tokens


class Chunk:
    """Ordered sets as a prefix tree: sequences in lexicographic order, with the lengths of the beginnings they share."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.members = sorted(members, key=lambda m: m[1].astype(">u8").tobytes())
        self.shared = [0] * len(self.members)
        for i in range(1, len(self.members)):
            a, b = self.members[i - 1][1], self.members[i][1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[i] = int(differ[0]) if len(differ) else m

    def linked(self, probe: np.ndarray, step: int = 128) -> list[int]:
        """Ids of the members whose Jaccard similarity with the probe reaches NUM / DEN.

        done[d] is the overlap of the first d tokens on the present path, kept
        for depths that the next member shares. A path is left at the first
        depth where the overlap can't be reached any more; members that share
        that depth and are no longer are left with it.
        """
        found, hits = [], np.sort(probe)
        done, depth, dead, dead_size = np.zeros(1, dtype=np.int64), 0, -1, 0
        for (key, seq), same in zip(self.members, self.shared, strict=True):
            n = len(seq)
            if 0 <= dead <= same and n <= dead_size:
                continue
            need = -(-NUM * (n + len(probe)) // (NUM + DEN))
            depth = min(same, depth)
            done = done[: depth + 1]
            dead = -1
            while depth < n:
                part = seq[depth : depth + step]
                at = np.searchsorted(hits, part)
                is_in = hits[np.minimum(at, len(hits) - 1)] == part
                done = np.concatenate([done, done[-1] + np.cumsum(is_in)])
                depth += len(part)
                if done[-1] + min(n - depth, len(probe) - done[-1]) < need:
                    dead, dead_size = depth, n
                    break
            if dead < 0 and done[n] >= need:
                found.append(key)
        return found


#: Words of a set's short signature: 256 bits, each the parity of its shingles with one leading byte; bits of the long one.
SIGNS, WIDE_BITS = ("s0", "s1", "s2", "s3"), 10
_DESCRIBED = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64()), ("bits", pa.binary()), *((c, pa.int64()) for c in SIGNS), ("wide", pa.binary())])


def signature(tokens: np.ndarray, bits: int = 8) -> np.ndarray:
    """Bytes of parities. Two sets overlap in (n + n' - differing bits) / 2 shingles at most."""
    parity = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(parity.astype(np.uint8))


def _describe(batches):
    """kind 0: id, set size, set id and signatures of each document; kind 1: for each slice of the sketch, what the task counted.

    A slice is one byte a counter, or where it has few shingles their places.
    """
    seen: set[int] = set()
    held, count = [], 0
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)

    def rows(kind, a, n, b, bits, signs=None, wide=None):
        signs = np.zeros((len(a), 4), dtype=np.int64) if signs is None else signs
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(bits, pa.binary()), *(pa.array(signs[:, i]) for i in range(4)), pa.array(wide or [None] * len(a), pa.binary())], schema=_DESCRIBED)

    def add():
        spots = np.sort((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
        first = np.flatnonzero(np.concatenate([[True], spots[1:] != spots[:-1]]))
        at = spots[first]
        counts[at] = np.minimum(counts[at] + np.diff(np.append(first, len(spots))), 255)

    for batch in batches:
        ids, sizes, prints, signs, wide = batch.column(0).to_pylist(), [], [], [], []
        for text in values(batch.column(1)):
            tokens = shingle_set(text)
            fp = fingerprint(tokens)
            sizes.append(len(tokens))
            prints.append(fp)
            signs.append(signature(tokens).view(np.int64))
            wide.append(signature(tokens, WIDE_BITS).tobytes())
            if len(tokens) and fp not in seen:
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(fp)
                held.append(tokens)
                count += len(tokens)
                if count >= BLOCK:
                    add()
                    held, count = [], 0
        yield rows(0, ids, sizes, prints, [None] * len(ids), np.array(signs, dtype=np.int64).reshape(-1, 4), wide)
    if held:
        add()
    held.clear()
    for k in range(1 << SKETCH_BITS - SLICE_BITS):
        part = counts[k << SLICE_BITS : (k + 1) << SLICE_BITS]
        some = np.flatnonzero(part)
        places = np.repeat(some.astype(np.uint32), part[some])
        if len(places) * 4 >= 1 << SLICE_BITS:
            yield rows(1, [k], [1], [0], [part.astype(np.uint8).tobytes()])
        elif len(places):
            yield rows(1, [k], [4], [0], [places.tobytes()])
    del counts
    seen.clear()
    released()


def _leveled(mean: float):
    """Rows of slices, sorted by slice -> the level of each counter: 0, or 1 and more by how far it stands out."""

    def run(batches):
        at, total = None, None

        def done():
            excess = (total - mean) / (4.0 * max(mean, 0.5) ** 0.5)
            level = np.where(excess > 1, 1 + 4 * np.log2(np.maximum(excess, 1)), 0)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(level, 255).astype(np.uint8).tobytes()], pa.binary())], names=["slice", "levels"])

        for batch in batches:
            for k, width, bits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at, total = k, np.zeros(1 << SLICE_BITS)
                total += np.frombuffer(bits, np.uint8) if width == 1 else np.bincount(np.frombuffer(bits, np.uint32), minlength=1 << SLICE_BITS)
        if at is not None:
            yield done()

    return run


def _postings(levels_of):
    def run(batches):
        levels, seen = levels_of.value, set()
        for batch in batches:
            tokens, places, sizes, prints = [], [], [], []
            for text in values(batch.column(0)):
                found = shingle_set(text)
                if not len(found) or (fp := fingerprint(found)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(fp)
                p = prefix_length(len(found))
                tokens.append(ordered(found, levels)[:p])
                places.append(np.arange(p, dtype=np.int32))
                sizes.append(np.full(p, len(found), dtype=np.int32))
                prints.append(np.full(p, fp, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(prints))], names=["token", "pos", "n", "fp"])
        seen.clear()
        released()

    return run


def _spot(column: str, size: int):
    return F.pmod(F.xxhash64(column), F.lit(size)) + 1


def _bitmap(rows: DataFrame, column: str, size: int):
    """A broadcast map with the bit of every value set: size / 8 bytes, put together by Spark in pieces of 4 KB."""
    h = rows.select(_spot(column, size).alias("h"))
    pieces = h.groupBy(F.expr("bitmap_bucket_number(h)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in pieces.collect():
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def _there(bits_of):
    """Whether the bit at a place of the map is set, as a function of columns. Only the places go through Python."""

    @F.pandas_udf("boolean")
    def there(at: pd.Series) -> pd.Series:
        bits, at = bits_of.value, at.to_numpy(dtype=np.int64)
        return pd.Series(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    return there


def _maybe_in(rows: DataFrame, column: str, bits_of, size: int) -> DataFrame:
    """Rows whose value may be in the map."""
    return rows.where(_there(bits_of)(_spot(column, size) - 1))


def _tested(levels_of):
    """Rows (centre, part, is_member, fp, text), sorted by the first three -> links."""

    def run(batches):
        levels, at, probe, members, out = levels_of.value, None, None, [], []

        def close():
            if probe is not None and members:
                out.extend((at[0], key) for key in Chunk(members).linked(probe))

        for batch in batches:
            for centre, part, is_member, fp, text in zip(*(values(batch.column(i)) for i in range(5)), strict=True):
                if (centre, part) != at:
                    close()
                    at, probe, members = (centre, part), None, []
                tokens = shingle_set(text)
                if fingerprint(tokens) != fp:  # another row with the same doc_id
                    continue
                if not is_member:
                    probe = ordered(tokens, levels)
                elif not members or members[-1][0] != fp:
                    members.append((fp, ordered(tokens, levels)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        released()

    return run


def _fits(a: str, b: str):
    """Length, position and signature filters for two sets that share a shingle at pos."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return _may_link(a, b) & (F.least(n - F.col(f"{a}pos"), m - F.col(f"{b}pos")) >= _need(n, m))


def _need(n, m):
    return F.ceil(F.lit(NUM) * (n + m) / F.lit(NUM + DEN))


def _may_link(a: str, b: str):
    """Length and signature filters; they hold for a pair, whichever shingle it meets at."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SIGNS[1:]), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    return (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & ((n + m - apart) / 2 >= _need(n, m))


def _marked(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of shingles with their component so far."""
    return shared.join(comps, F.col("fp") == F.col("id"), "left").withColumn("comp", F.coalesce("comp", "fp")).drop("id")


def _open(shared: DataFrame, comps: DataFrame, centred: bool = True) -> DataFrame:
    """Members of shingles that fall into several components, with their component, the first member and the centre c.

    The first centre is the member that has the shingle earliest. Once that
    one's component holds some members, the earliest of the others is next.
    """
    marked = _marked(shared, comps)
    item = F.struct("pos", "n", "fp", "comp", *SIGNS)
    several = marked.groupBy("token").agg(F.min(item).alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    # One row for each shingle, written: if they are few, Spark knows it before it would deal members by shingle.
    opened = staged(marked.join(staged(several.select("token", "first"), "firsts"), "token"), "open")
    if not centred:
        return opened
    other = F.col("comp") != F.col("first.comp")
    ahead = opened.groupBy("token").agg(F.count_if(~other).alias("grown"), F.min(F.when(other, item)).alias("second"))
    return opened.join(staged(ahead, "ahead"), "token").withColumn("c", F.when(F.col("grown") > 1, F.col("second")).otherwise(F.col("first"))).drop("grown", "second")


def _near_end(n, pos, m, at):
    """Most shingles that two sets share if they share those at pos and at: some before both, some behind both."""
    return F.least(pos, at) + F.least(n - pos, m - at)


def _few_pairs(light: DataFrame) -> DataFrame:
    """(centre, fp): pairs of different components at shingles of up to SMALL members."""
    x, y, n, m = F.col("x.fp"), F.col("y.fp"), F.col("x.n"), F.col("y.n")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & (x < y)
    fits = (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (_near_end(n, F.col("x.pos"), m, F.col("y.pos")) >= _need(n, m))
    return light.alias("x").join(light.alias("y"), met & fits).select(x.alias("centre"), y.alias("fp")).distinct()


class PathTree:
    """Members of one shingle as a prefix tree of the shared shingles that each has before it.

    The nodes are the distinct beginnings; a member sits on the node of its
    whole path. Two members meet first at this shingle if no shingle is on both
    paths. That is settled for pairs of nodes, once for all members on them.
    """

    def __init__(self, paths: list[np.ndarray]):
        place = {(): 0}
        self.node = np.zeros(len(paths), dtype=np.int64)
        for i, path in enumerate(paths):
            self.node[i] = place.setdefault(tuple(path.tolist()), len(place))
        self.paths = [np.array(p, dtype=np.int64) for p in place]

    def apart(self, step: int = 2048) -> np.ndarray:
        """For pairs of nodes: whether their paths have no shingle in common."""
        sizes = [len(p) for p in self.paths]
        out = np.ones((len(sizes), len(sizes)), dtype=bool)
        if not sum(sizes):
            return out
        tokens, at, often = np.unique(np.concatenate(self.paths), return_inverse=True, return_counts=True)
        whose = np.repeat(np.arange(len(sizes)), sizes)
        # A shingle on one path alone parts no two nodes, but the members of that node share it.
        out[np.diag_indices(len(sizes))] = np.array(sizes) == 0
        wanted = np.flatnonzero(often > 1)
        column = np.full(len(tokens), -1)
        column[wanted] = np.arange(len(wanted))
        col = column[at]
        for lo in range(0, len(wanted), step):
            here = (col >= lo) & (col < lo + step)
            table = np.zeros((len(sizes), min(step, len(wanted) - lo)), dtype=np.float32)
            table[whose[here], col[here] - lo] = 1
            out &= table @ table.T == 0
        return out


def _met(batches):
    """Members (token, i, j, fp, n, pos, comp, wide, path, block), sorted by the first three -> pairs that meet first here and may link.

    Of two different blocks i < j only pairs across them are taken.
    """
    at, held = None, []

    def close():
        if len(held) < 2:
            return None
        fp, n, pos, comp = (np.array([r[k] for r in held], dtype=np.int64) for k in range(4))
        wide = np.frombuffer(b"".join(r[4] for r in held), dtype=np.uint64).reshape(len(held), -1)
        tree = PathTree([np.array(r[5], dtype=np.int64) for r in held])
        apart, block, out = tree.apart(), np.array([r[6] for r in held]), []
        for k in range(len(held) - 1):
            o = np.arange(k + 1, len(held))
            o = o[apart[tree.node[k], tree.node[o]] & (comp[o] != comp[k]) & (fp[o] != fp[k])]
            if at[1] != at[2]:
                o = o[block[o] != block[k]]
            need = -(-NUM * (n[o] + n[k]) // (NUM + DEN))
            most = np.minimum(np.minimum(n[o], n[k]), np.minimum(pos[o], pos[k]) + np.minimum(n[o] - pos[o], n[k] - pos[k]))
            o, need = o[most >= need], need[most >= need]
            if len(o):
                parity = np.bitwise_count(wide[o] ^ wide[k]).sum(axis=1, dtype=np.int64)
                o = o[(n[o] + n[k] - parity) // 2 >= need]
                out.append(np.stack([np.minimum(fp[o], fp[k]), np.maximum(fp[o], fp[k])]))
        if not out:
            return None
        pairs = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["centre", "fp"])

    for batch in batches:
        for key, *row in zip(zip(*(values(batch.column(i)) for i in range(3)), strict=True), *(values(batch.column(i)) for i in range(3, 10)), strict=True):
            if key != at:
                if (done := close()) is not None:
                    yield done
                at, held = key, []
            held.append(row)
    if (done := close()) is not None:
        yield done
    released()


def _many_pairs(opened: DataFrame, about: DataFrame) -> DataFrame:
    """(centre, fp): pairs of different components at shingles of more members, from a tree for each group or two blocks of it."""
    rows = opened.select("token", "fp", "n", "pos", "comp")
    path = rows.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "token"))), 1, PATH).alias("path"))
    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / HELD).cast("int").alias("blocks"))
    full = rows.join(path, "fp").join(about.select("fp", "wide"), "fp").join(blocks, "token")
    before = F.transform(F.filter("path", lambda p: p["pos"] < F.col("pos")), lambda p: p["token"])
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = full.select("token", "fp", "n", "pos", "comp", "wide", before.alias("path"), mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "comp", "wide", "path", "block")
    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_met, "centre long, fp long").distinct()


def _signed(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """The pairs that their long signatures allow."""
    side = lambda p: about.select(F.col("fp").alias(f"{p}fp"), F.col("n").alias(f"{p}n"), F.col("wide").alias(f"{p}wide"))
    both = pairs.join(side("x_"), F.col("centre") == F.col("x_fp")).join(side("y_"), F.col("fp") == F.col("y_fp"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(len(n), -1) for i in (3, 5))
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                keep = (n + m - apart) // 2 >= -(-NUM * (n + m) // (NUM + DEN))
                yield batch.filter(pa.array(keep)).select([0, 1])

    return both.select("centre", "fp", "x_n", "x_wide", "y_n", "y_wide").mapInArrow(run, "centre long, fp long")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, again: DataFrame, levels_of) -> DataFrame:
    """Distinct (centre, fp) pairs -> those that link. again: ids on several rows."""
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / CHUNK).cast("int")
    members = pairs.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.lit(1).alias("is_member"), "fp")
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("is_member"), F.col("centre").alias("fp"))
    asked = staged(members.unionByName(centres).join(reps, "fp"), "asked")
    named = asked.where("doc_id is not null")
    texts = _maybe_in(docs.select("doc_id", "text"), "doc_id", _bitmap(named, "doc_id", WANTED_BITS), WANTED_BITS).withColumnRenamed("doc_id", "t_id")
    rows = named.join(texts, F.col("doc_id") == F.col("t_id")).select("centre", "part", "is_member", "fp", "text")
    if asked.where("doc_id is null").limit(1).count():
        odd = docs.select("doc_id", "text").where("doc_id is null").unionByName(docs.select("doc_id", "text").join(again, F.col("doc_id") == F.col("again"), "left_semi"))
        odd = _printed(odd).groupBy("__fp").agg(F.min("text").alias("text"))
        rows = rows.unionByName(asked.where("doc_id is null").join(odd, F.col("fp") == F.col("__fp")).select("centre", "part", "is_member", "fp", "text"))
    dealt = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "is_member", "fp")
    found = staged(dealt.mapInArrow(_tested(levels_of), "a long, b long"), "tested")
    discard(asked)
    del rows, dealt, texts
    reclaim(docs.sparkSession)
    return found


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, fp) of every document; (fp, comp, least) of every distinct set with words: comp is its component, least its smallest doc_id."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    described = staged(docs.mapInArrow(_describe, "kind int, a long, n long, b long, bits binary, s0 long, s1 long, s2 long, s3 long, wide binary"), "sets", ["kind"])
    members = described.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("b").alias("fp"), *SIGNS, "wide")
    # Copies in one block count once, so the mean is an upper bound; it only sets the order.
    mean = (members.agg(F.sum("n_shingles")).first()[0] or 0) / (2 << SKETCH_BITS)
    slices = described.where("kind = 1").select(F.col("a").cast("int").alias("slice"), F.col("n").cast("int").alias("width"), "bits")
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for r in slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_leveled(mean), "slice int, levels binary").collect():
        levels[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(bytes(r["levels"]), np.uint8)
    levels_of = spark.sparkContext.broadcast(levels)
    discard(described, "kind=1")
    reclaim(spark)

    postings = staged(docs.select("text").mapInArrow(_postings(levels_of), "token long, pos int, n int, fp long"), "postings")
    several = postings.groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").cast("int").alias("m")).where("lo <> hi").select("token", "m")
    several = staged(several, "several")
    shared = staged(_maybe_in(postings, "token", _bitmap(several, "token", SHARED_BITS), SHARED_BITS).join(several, "token").dropDuplicates(["token", "fp"]), "shared")
    discard(postings)
    reclaim(spark)
    # A set's text is found by an id that stands on one row; sets without such an id are found by their own rows' sets.
    again = staged(members.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again")), "again")
    once = members.where("n_shingles > 0").join(again, F.col("doc_id") == F.col("again"), "left").withColumn("own", F.when(F.col("again").isNull(), F.col("doc_id")))
    about = once.groupBy("fp").agg(F.min("own").alias("doc_id"), F.min("n_shingles").alias("n"), *[F.min(c).alias(c) for c in (*SIGNS, "wide")])
    about = staged(about.join(shared.select("fp").distinct(), "fp"), "reps")
    reps = about.select("fp", "doc_id")

    links, comps = None, spark.createDataFrame([], "id long, comp long")
    light = shared.where(F.col("m") <= SMALL).drop("m")
    crowded = staged(shared.where(F.col("m") > SMALL).drop("m").join(about.select("fp", *SIGNS), "fp"), "crowded")
    for _ in range(MOST_STARS):
        opened = _open(crowded, comps)
        pairs = staged(opened.where((F.col("comp") != F.col("c.comp")) & _fits("", "c.")).select(F.col("c.fp").alias("centre"), "fp").distinct(), "stars")
        asked = pairs.count()
        if not asked:
            break
        found = _verified(pairs, reps, docs, again, levels_of)
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links)
        if found.count() * 5 < asked:  # what is left is not one family
            break
    few = staged(_signed(_few_pairs(_marked(light, comps)), about), "few")
    many = staged(_many_pairs(_open(crowded, comps, centred=False), about), "many")
    pairs = staged(few.unionByName(many).distinct(), "pairs")
    if pairs.limit(1).count():
        found = _verified(pairs, reps, docs, again, levels_of)
        comps = connected_components(found if links is None else links.unionByName(found))
    levels_of.unpersist()
    sets = members.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).join(comps, F.col("fp") == F.col("id"), "left")
    return members.select("doc_id", "n_shingles", "fp"), staged(sets.select("fp", F.coalesce("comp", "fp").alias("comp"), "least"), "classes")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id."""
    rows, sets = _classes(docs)
    heads = staged(sets.groupBy("comp").agg(F.min("least").alias("component_id")), "components")
    named = staged(_spread(sets.select("fp", "comp"), heads, "comp").select("fp", "component_id"), "named")
    full = _spread(rows.where("n_shingles > 0"), named, "fp").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _spread(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows joined with the table's one row for their key. Keys of over a thousandth of the rows are broadcast: they are under 1,000."""
    total = rows.count()
    hot = F.broadcast(staged(rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") * 1000 > total).select(key), "hot"))
    there = rows.join(F.broadcast(table.join(hot, key)), key)
    return there.unionByName(rows.join(hot, key, "left_anti").join(table, key))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of documents, exactly one of each component: the one with the smallest doc_id; null ids come last.

    Where that id is null or stands on several rows, the row's own set decides,
    then the hash of the row, so the choice is the same in every run. Documents
    without words are components of their own and all stay.
    """
    spark = docs.sparkSession
    rows, sets = _classes(docs)
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    heads = sets.groupBy("comp").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("head")).select(F.col("head.least").alias("h_id"), F.col("head.fp").alias("h_fp"))
    several = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again"))
    heads = staged(heads.join(several, F.col("h_id") == F.col("again"), "left"), "heads")
    reclaim(spark)
    ids = rows.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    gone = staged(ids.join(heads.where("h_id is not null and again is null"), F.col("gone") == F.col("h_id"), "left_anti"), "gone")
    # The map of ids that go tells most rows that stay; only the others' texts are dealt by id.
    some = docs.where(worded & F.col("doc_id").isNotNull())
    maybe = _there(_bitmap(gone, "gone", SHARED_BITS))(_spot("doc_id", SHARED_BITS) - 1)
    kept = some.where(~maybe).unionByName(some.where(maybe).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")).unionByName(docs.where(~worded))
    odd = heads.where("h_id is null or again is not null")
    if not odd.limit(1).count():
        return kept
    asked = docs.where(worded & F.col("doc_id").isNull()).unionByName(docs.where(worded).join(odd.where("again is not null").select("again").distinct(), F.col("doc_id") == F.col("again"), "left_semi"))
    found = _printed(asked).join(odd.select(F.col("h_id"), F.col("h_fp")), (F.col("__fp") == F.col("h_fp")) & F.col("doc_id").eqNullSafe(F.col("h_id")))
    first = found.groupBy("h_fp").agg(F.min(F.struct(F.xxhash64(*docs.columns).alias("h"), *docs.columns)).alias("row")).select("row.*").drop("h")
    return kept.unionByName(first)


def _printed(docs: DataFrame) -> DataFrame:
    """Rows with __fp, the id of their set."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint(shingle_set(t)) for t in values(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, "__fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
g AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS t FROM g),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT rep AS id, rep AS reach FROM g WHERE n > 0 UNION SELECT c.id, l.b FROM c JOIN l ON c.reach = l.a),
m AS (SELECT id, min(reach) AS comp FROM c GROUP BY id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.comp END AS component_id
FROM s JOIN g ON list_sort(s.sh) = g.sh LEFT JOIN m ON m.id = g.rep
"""


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, joined with itself."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
