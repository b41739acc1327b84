"""Exact Jaccard self-join of word n-gram sets by universe partition.

A text's set is that of its distinct n-word shingles. Texts with one set are one class, and only classes are compared. The
classes are banded by size; in the scheme of a band the universe of shingles is hashed into segments. Two sets that are
similar differ in at most D shingles, so by the pigeonhole principle they agree in some segment, or differ there by one
shingle at most: the keys of a set are its subset in each segment and, in the segments to which the allocation gives one
deletion, the subset less any one shingle. How many segments delete is chosen by cost from the counted sizes of the bands.
Shingles that many texts hold (passages, licences) stay out of it: similar sets differ by no more in their rare shingles.
Empty segments say little and have no keys; a scheme has as many segments to spare as a set usually has of these. A set with
more of them shows all its keys, and partitions of all its shingles besides: into few segments, each deleting,
with some to spare for those of one shingle at most. Sets with more of those than that go on to the next of these partitions, by
another hash, until one has fewer; so no pair is lost and unlike sets share no key.

Keys travel packed, a blob for each batch and part. A key of more than GROUP sets is compared by pairs of blocks in tasks of
their own. Sets that share a key are candidates, unless their sizes or their parity sketches rule them out; candidates are verified exactly on the whole sets, each shipped once to each component.

Cases: a null text, or one without words, has an empty set and links with nothing; fewer words than n make one shingle; a
row with a null id shows its size and has no links (n_similar 0, component null); rows that repeat an id are documents each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, materialize, mix, pieces, raw_bytes, small, small_batches, trim, windows, word_bounds
from .components import connected_components

U = np.uint64
_PRIME = U(0x9E3779B97F4A7C15)
_SEG, _VAL, _CLS = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)
_FULL = (1 << 64) - 1
PART_BYTES = 24 << 20  # of packed keys that a task compares at once
FLUSH = 1_500_000  # keys packed at once
HOT_SHARE = 100_000  # classes with more than this part of all rows are hot; there are at most so many
LEVELS = 12  # partitions of all shingles; a set needs each with a chance of a few in a hundred
GROUP = 20_000  # sets of one key that a task compares at once
FEW = 1_000_000  # rows of two or three longs that may be broadcast once counted
COMPONENT_BYTES = 48 << 20  # of sets that a verifying task holds
COMMON_SHARE = 2_000  # a shingle in more than this part of all texts is common; 2,000 times a text's shingles at most are
SHARING = 1 / (20 * COMMON_SHARE)  # for the allocation's cost: share of texts that hold a shingle that isn't common


def doc_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and its distinct shingles' hashes, ascending."""
    data, offsets = raw_bytes(column)
    none = np.zeros(0, np.uint64)
    for first, end, raw, at in pieces(data, offsets):
        starts, ends, of = word_bounds(raw, at)
        h = hash_words(raw, starts, ends)
        all_windows = windows(h, width)
        for i in range(end - first):
            a, b = of[i], of[i + 1]
            if b - a >= width:
                yield first + i, np.unique(all_windows[a : b - width + 1])
            elif b > a:
                yield first + i, windows(h[a:b], int(b - a)) ^ U(b - a)
            else:
                yield first + i, none


def class_of(shingles: np.ndarray) -> int:
    """A set's class: equal for equal sets."""
    total = int(mix(shingles ^ _CLS).sum(dtype=np.uint64)) + len(shingles) * int(_SEG)
    return int(mix(np.array([total & _FULL], np.uint64)).view(np.int64)[0])


def sketch_of(shingles: np.ndarray) -> int:
    """64 parities; two sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((mix(shingles ^ _SEG) >> U(58)).astype(np.int64), minlength=64) & 1
    return int(np.packbits(odd.astype(np.uint8)).view(np.uint64)[0].view(np.int64))


# ---- Bands and allocation ----------------------------------------------------------------------------------------------


def bands(largest: int, num: int, den: int) -> list[int]:
    """First size of each band; similar sets lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * den // num + 1)
    return out


def difference(first: int, num: int, den: int) -> int:
    """Most shingles by which similar sets differ if the smaller lies in the band that begins at ``first``."""
    r = first * den // num
    s = r * den // num
    return (r + s) * (den - num) // (den + num)


def weak(m: int, n: int, most: int) -> tuple[float, float]:
    """Mean and deviation of how many of m segments have ``most`` or fewer of n shingles."""
    p = sum(math.comb(n, i) * (1 / m) ** i * (1 - 1 / m) ** (n - i) for i in range(min(n, most) + 1)) if m > 1 else float(n <= most)
    return m * p, math.sqrt(m * p * (1 - p)) if p < 1 else 0.0


def allocate(first: int, docs: int, num: int, den: int) -> tuple[int, int, int]:
    """Of the scheme for a band of ``docs`` sets: segments, how many of them (the first ones) delete, and the weak weight
    that a set may leave out. Of a grid of these the cheapest by keys a set and by the chance candidates to be expected."""
    d, n = difference(first, num, den), first * 1.1
    best: tuple[float, tuple[int, int, int]] | None = None
    for spare in sorted({0, *(math.ceil(d * x) for x in (0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0))}):
        for share in (0.0, 0.15, 0.3, 0.5, 0.75, 1.0):
            need = d + 1 + spare
            b = (need + 1) // 2 if share == 1 else round(share * need / 2)
            a = max(0, need - 2 * b)
            m = a + b
            # A segment that deletes weighs 2, and may be weak in either set.
            allowed = spare if b == 0 else spare // 2
            (mean, dev), (mean2, dev2) = weak(m, round(n), 0), weak(m, round(n), 1)
            mean, dev = mean * a / m + 2 * mean2 * b / m, math.hypot(dev * a / m, 2 * dev2 * b / m)
            over = 0.5 * math.erfc((allowed + 0.5 - mean) / (max(dev, 0.3) * math.sqrt(2)))
            size = n / m
            # Keys a set; twice as many if it has to show all; candidates by one shingle that is just not common.
            keys = (a + b * (1 + size) - (1 - over) * mean) * (1 + over)
            alone = a * size * math.exp(-size) + b * 2 * size * size * math.exp(-size)
            cost = keys + docs * (SHARING * alone + over**2 * m * math.exp(-2 * size))
            if best is None or cost < best[0]:
                best = cost, (m, b, allowed)
    assert best is not None
    return best[1]


@functools.lru_cache(maxsize=4096)
def fallback(first: int, most: int) -> tuple[int, int]:
    """Of the partitions of all shingles of sets from ``first`` that differ in at most ``most``: segments, all deleting, and
    how many of these may have one shingle at most. One more than these agree, so a set with no more has a key to show."""
    best = (1.0, most // 2 + 1, 0)
    for room in range(0, 2 + most // 8):
        m = most // 2 + 1 + room
        mean, dev = weak(m, first, 1)
        over = 0.5 * math.erfc((room + 0.5 - mean) / (max(dev, 0.3) * math.sqrt(2)))
        best = min(best, (over, m, room))
        if over < 0.03:
            break
    return best[1:]


def keys_of(shingles: np.ndarray, common: np.ndarray, scheme: int, first: int, most: int, m: int, b: int, spare: int) -> np.ndarray:
    """The keys of a set in a scheme for sets from ``first`` shingles that differ in at most ``most``. Sets that are similar differ by no more
    in their rare shingles alone, so these are partitioned; a set with too few for its segments adds, for others like it,
    partitions of all its shingles."""
    values, spots = mix(shingles ^ _VAL), mix(shingles + _SEG) >> U(32)
    rare = ~common
    keys, every = _segment_keys(values[rare], spots[rare], 2 * scheme, m, b, spare)
    if not every:
        return keys
    out, (fewest, room) = [keys], fallback(first, most)
    for level in range(LEVELS):
        spots = mix(shingles * _PRIME + U(level * int(_SEG) & _FULL)) >> U(32)
        keys, bare = _deleting_keys(values, spots, (2 * scheme + 1) * LEVELS + level, fewest)
        out.append(keys)
        if bare <= room:
            break
    else:  # the last of them shows the keys of what is empty, too
        out.append(mix(np.arange(fewest, dtype=np.uint64) * _SEG + U((2 * scheme + 1) * LEVELS * int(_CLS) & _FULL)))
    return np.concatenate(out)


def _runs(values: np.ndarray, spots: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values by segment, the segments that have any, their sums and counts."""
    seg = ((spots * U(m)) >> U(32)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, values = seg[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return values, seg[first], np.add.reduceat(values, first), np.diff(np.append(first, len(seg)))


def _segment_keys(values: np.ndarray, spots: np.ndarray, salt: int, m: int, b: int, spare: int) -> tuple[np.ndarray, bool]:
    """Keys of the segments that aren't weak: with a shingle, or two where one is deleted. If more weight than ``spare`` is
    in weak ones, which is told, all that have a shingle show their keys."""
    salt = U(salt * int(_CLS) & _FULL)
    if not len(values):
        return np.zeros(0, np.uint64), True
    values, which, sums, counts = _runs(values, spots, m)
    strong = counts > (which < b)
    every = m + b - int(np.where(which[strong] < b, 2, 1).sum()) > spare
    shown = np.ones(len(which), bool) if every else strong
    out = [sums[shown] ^ (which[shown].astype(np.uint64) * _SEG + salt)]
    if b:
        run = np.repeat(np.arange(len(which)), counts)
        deleting = (which[run] < b) & shown[run] & (counts[run] > 1)
        r = run[deleting]
        out.append((sums[r] - values[deleting]) ^ (which[r].astype(np.uint64) * _SEG + salt))
    return mix(np.concatenate(out)), every


def _deleting_keys(values: np.ndarray, spots: np.ndarray, salt: int, m: int) -> tuple[np.ndarray, int]:
    """Keys of a partition into ``m`` segments that all delete, and how many of these have one shingle at most."""
    salt = U(salt * int(_CLS) & _FULL)
    values, which, sums, counts = _runs(values, spots, m)
    run = np.repeat(np.arange(len(which)), counts)
    deleting = counts[run] > 1
    r = run[deleting]
    keys = [sums ^ (which.astype(np.uint64) * _SEG + salt), (sums[r] - values[deleting]) ^ (which[r].astype(np.uint64) * _SEG + salt)]
    return mix(np.concatenate(keys)), m - int((counts > 1).sum())


# ---- The join ----------------------------------------------------------------------------------------------------------


def _describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, cls of each row; and, with ``common`` set, shingles (cls) that a run of texts holds often, and
    in how many of its classes (n_shingles)."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= max(2, len(held) / (2 * COMMON_SHARE))
        h, n = h[keep].view(np.int64), n[keep]
        return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(n), pa.array(h), pa.array(np.ones(len(h), bool))], names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held, size, seen = [], 0, set()
            for i, s in doc_sets(batch.column(1), width):
                n[i] = len(s)
                if len(s):
                    cls[i] = class_of(s)
                    if cls[i] not in seen:
                        seen.add(cls[i])
                        held.append(s)
                        size += len(s)
                if size > FLUSH * 2:
                    yield often(held)
                    held, size = [], 0
            if held:
                yield often(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cls, mask=n == 0), pa.array(np.zeros(len(n), bool))], names)
        trim()

    names = ["doc_id", "n_shingles", "cls", "common"]
    return docs.mapInArrow(f, "doc_id long, n_shingles long, cls long, common boolean")


def _pack(keys: list[np.ndarray], owners: list[np.ndarray], table: list[tuple[int, int, int]], parts: int) -> pa.RecordBatch:
    """One row a part: six bytes of each key, the owner's place in the row's table, and the table."""
    k, o = np.concatenate(keys), np.concatenate(owners)
    part = (((k >> U(32)) * U(parts)) >> U(32)).astype(np.uint32 if parts > 65_536 else np.uint16)
    order = np.argsort(part, kind="stable")
    k, o, part = k[order], o[order], part[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    cls, n, sketch = (np.array(c, t) for c, t in zip(zip(*table), (np.int64, np.int32, np.int64)))
    low = np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :6])
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(k))):
        used, place = np.unique(o[a:b], return_inverse=True)
        rows.append((int(part[a]), low[a:b].tobytes(), place.astype(np.uint16).tobytes(), cls[used].tobytes(), n[used].tobytes(), sketch[used].tobytes()))
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "keys", "place", "cls", "n", "sketch"])


def _signatures(docs: DataFrame, width: int, starts: list[int], schemes: dict[int, tuple[int, int, int]], parts: int, num: int, den: int, hot, common) -> DataFrame:
    edges = np.array(starts)
    most = {k: difference(starts[k], num, den) for k in schemes}

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_cls, hot_rep = hot.value
        often = common.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(often >> U(44)).astype(np.int64)] = True
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        table: list[tuple[int, int, int]] = []
        held, seen = 0, set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, s in doc_sets(batch.column(1), width):
                if not len(s):
                    continue
                cls = class_of(s)
                at = np.searchsorted(hot_cls, cls)
                if cls in seen or (at < len(hot_cls) and hot_cls[at] == cls and hot_rep[at] != ids[i]):
                    continue  # another copy stands for it
                seen.add(cls)
                band = int(np.searchsorted(edges, len(s), "right")) - 1
                is_common = maybe[(s >> U(44)).astype(np.int64)]
                if is_common.any():
                    q = s[is_common]
                    at = np.searchsorted(often, q)
                    at[at == len(often)] = 0
                    is_common[is_common] = often[at] == q
                for scheme in (band, band - 1):
                    if scheme in schemes:
                        k = keys_of(s, is_common, scheme, starts[scheme], most[scheme], *schemes[scheme])
                        keys.append(k)
                        owners.append(np.full(len(k), len(table), np.int32))
                        held += len(k)
                table.append((cls, len(s), sketch_of(s)))
                if held > FLUSH or len(table) > 60_000:
                    yield _pack(keys, owners, table, parts)
                    keys, owners, table, held = [], [], [], 0
                    seen.clear()
        if keys:
            yield _pack(keys, owners, table, parts)
        trim()

    return docs.mapInArrow(f, "part int, keys binary, place binary, cls binary, n binary, sketch binary")


def _compare(k: np.ndarray, c: np.ndarray, n: np.ndarray, s: np.ndarray, num: int, den: int, apart: np.ndarray | None = None) -> np.ndarray:
    """Pairs of classes with one key, each once, that neither size nor sketch rules out; only of different ``apart``, if that
    is given. Rows are sorted by key and size."""
    found: list[np.ndarray] = []
    held, live, d = 0, np.arange(len(k)), 1
    while len(live):
        live = live[live + d < len(k)]
        live = live[(k[live] == k[live + d]) & (n[live] * den >= n[live + d] * num)]
        if not len(live):
            break
        j = live + d
        bits = np.bitwise_count((s[live] ^ s[j]).view(np.uint64)).astype(np.int64)
        good = (bits * (num + den) <= (n[live] + n[j]) * (den - num)) & (c[live] != c[j])
        if apart is not None:
            good &= apart[live] != apart[j]
        a, b = c[live[good]], c[j[good]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        held += len(a)
        if held > 2_000_000:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = 0
        d += 1
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _candidates(blobs: DataFrame, parts: int, num: int, den: int, group: int | None = None) -> DataFrame:
    """Pairs of classes that share a key and that neither size nor sketch rules out; each part's pairs once."""
    group = GROUP if group is None else group

    def part(table: pa.Table) -> pa.Table:
        ks, cs, ns, ss = [], [], [], []
        for keys, place, cls, n, sketch in zip(*(table.column(c).to_pylist() for c in ("keys", "place", "cls", "n", "sketch"))):
            wide = np.zeros((len(keys) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
            at = np.frombuffer(place, np.uint16)
            ks.append(wide.view(np.uint64).ravel())
            cs.append(np.frombuffer(cls, np.int64)[at])
            ns.append(np.frombuffer(n, np.int32)[at])
            ss.append(np.frombuffer(sketch, np.int64)[at])
        number = table.column("part")[0].as_py()
        k = np.concatenate(ks)
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        shared = np.zeros(len(k), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        k, c, n, s = (np.concatenate(x)[shared] for x in (ks, cs, ns, ss))
        order = np.lexsort((c, n, k))
        k, c, n, s = k[order], c[order], n[order].astype(np.int64), s[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c, n, s = k[new], c[new], n[new], s[new]
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))) if len(k) else np.zeros(0, np.int64)
        many = np.repeat(sizes, sizes)
        big = many > group
        pairs = _compare(k[~big], c[~big], n[~big], s[~big], num, den)
        # A large group goes on as rows: its class as both ends, part and key as its name.
        name = (k[big] ^ mix(np.array([number], np.uint64))).view(np.int64)
        none = np.zeros(len(pairs), np.int64)
        out = {"a": np.concatenate([pairs[:, 0], c[big]]), "b": np.concatenate([pairs[:, 1], c[big]])}
        out |= {x: np.concatenate([none, y]) for x, y in (("key", name), ("n", n[big]), ("sketch", s[big]), ("size", many[big]))}
        del k, c, n, s
        trim()
        return pa.table(out)

    found = blobs.repartitionById(parts, "part").groupBy("part").applyInArrow(part, "a long, b long, key long, n long, sketch long, size long")
    found = materialize(found, "compared")
    pairs = found.where("size = 0").select("a", "b")
    large = found.where("size > 0")
    if not large.isEmpty():
        pairs = pairs.unionByName(_by_blocks(large, group, num, den))
    return pairs.distinct()


def _by_blocks(large: DataFrame, group: int, num: int, den: int) -> DataFrame:
    """The pairs of large groups (key, a, n, sketch, size): a task for each two blocks of a group."""
    blocks = F.ceil(F.col("size") / F.lit(group / 2)).cast("int")
    rows = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "a", "n", "sketch", "block", other).select("key", "a", "n", "sketch", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def pair(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        c, n, s, block = (table.column(v).to_numpy() for v in ("a", "n", "sketch", "block"))
        order = np.lexsort((c, n))
        pairs = _compare(np.zeros(len(c), np.uint64), c[order], n[order], s[order], num, den, None if x == y else block[order])
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("key", "x", "y").applyInArrow(pair, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The candidate pairs (a, b) whose sets are similar."""
    spark = pairs.sparkSession
    parts = materialize(connected_components(pairs), "candidate-components")
    needed = materialize(parts.join(classes.select(F.col("cls").alias("id"), "rep", "n"), "id"), "needed")
    n, longest = needed.count(), None
    if n == 0:
        return pairs.limit(0)
    # A component whose sets outgrow a task is cut into blocks; its pairs meet in the task of their two blocks.
    sizes = needed.groupBy("component").agg((F.sum("n") * 8).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0]
    tasks = max(1, math.ceil(total / COMPONENT_BYTES), min(64, n // 200))
    sized = materialize(needed.join(sizes, "component").select("id", "rep", (F.pmod(F.xxhash64("component"), F.lit(tasks))).alias("task"), F.pmod(F.xxhash64("id"), F.ceil(F.col("bytes") / F.lit(COMPONENT_BYTES / 4))).cast("int").alias("block")), "blocks")
    one, two = (sized.select(F.col("id").alias(c), F.col("block").alias(f"b{c}"), F.col("task").alias(f"t{c}")) for c in ("a", "b"))
    placed = pairs.join(small(one, n, FEW), "a").join(small(two, n, FEW), "b").select("a", "b", F.concat_ws(":", "ta", F.least("ba", "bb"), F.greatest("ba", "bb")).alias("task"))
    placed = materialize(placed, "placed")
    wanted = materialize(placed.select("task", F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = batch.column(2).to_pylist(), []
            for i, s in doc_sets(batch.column(1), width):
                if len(s) and class_of(s) == own[i]:
                    out.append((own[i], s.tobytes()))
                if len(out) >= 256 or i == batch.num_rows - 1:
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["id", "members"])
                    out = []

    reps = sized.select(F.col("rep").alias("doc_id"), "id")
    fetched = docs.join(small(reps, n, FEW), "doc_id").select("doc_id", "text", "id").mapInArrow(sets, "id long, members binary")
    shipped = fetched.join(small(wanted, wanted.count(), FEW), "id")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        members = {i: np.frombuffer(m, np.uint64) for i, m in zip(right.column("id").to_pylist(), right.column("members").to_pylist())}
        a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
        good = []
        for x, y in zip(a, b):
            s, t = members[x], members[y]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            both = int((t[at] == s).sum())
            good.append(den * both >= num * (len(s) + len(t) - both))
        return left.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    shipped = shipped.select(F.col("task").alias("at"), "id", "members")
    return placed.groupBy("task").cogroup(shipped.groupBy("at")).applyInArrow(verify, "a long, b long")


def join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id of every row of ``docs`` (doc_id, text); two texts are similar if
    den * |intersection| >= num * |union|."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    small_batches(spark)
    described = materialize(_describe(docs, width), "described")
    rows = described.where("not common").drop("common")
    members = rows.where("cls is not null and doc_id is not null")
    classes = materialize(members.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")), "classes")
    # Counts by power of two and by band; a handful of rows.
    largest, total, distinct, shingles = classes.agg(F.max("n"), F.sum("copies"), F.count("*"), F.sum("n")).first()
    if not distinct:
        return rows.select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"))
    starts = bands(largest, num, den)
    band = F.lit(0)
    for s in starts[1:]:
        band = band + (F.col("n") >= s).cast("int")
    in_band = dict(classes.groupBy(band.alias("band")).count().collect())
    schemes = {}
    for k, first in enumerate(starts):
        if difference(first, num, den) >= 1 and (k in in_band or k + 1 in in_band):
            schemes[k] = allocate(first, in_band.get(k, 0) + in_band.get(k + 1, 0), num, den)
    hot = classes.where(F.col("copies") > max(1, total // HOT_SHARE)).select("cls", "rep", "copies")
    hot_table = hot.orderBy("cls").toArrow()  # at most HOT_SHARE rows
    sent = spark.sparkContext.broadcast((hot_table.column("cls").to_numpy(), hot_table.column("rep").to_numpy()))
    # Shingles in more than 1 / COMMON_SHARE of the texts: at most COMMON_SHARE times the mean set's size.
    often = described.where("common").groupBy("cls").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= max(20, distinct // (2 * COMMON_SHARE)))
    common = spark.sparkContext.broadcast(np.sort(often.select("cls").toArrow().column("cls").to_numpy().view(np.uint64)))
    cores = spark.sparkContext.defaultParallelism
    parts = max(min(cores, math.ceil(shingles * 5 / (1 << 20))), math.ceil(shingles * 5 / PART_BYTES))
    pairs = materialize(_candidates(_signatures(docs.where("doc_id is not null"), width, starts, schemes, parts, num, den, sent, common), parts, num, den), "candidates")
    links = materialize(_verified(pairs, docs, classes, width, num, den), "links")
    found = materialize(connected_components(links), "components")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("cls").alias("b"), "copies"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("others"))
    least = found.join(classes.select(F.col("cls").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    info = classes.join(linked, "cls", "left").join(found.join(least, "component").select(F.col("id").alias("cls"), "component_id"), "cls", "left")
    info = materialize(info.select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component_id", "rep").alias("component_id"), "copies"), "info")
    # Rows of hot classes meet their class by broadcast, the others by a shuffle without hot keys.
    is_hot = F.col("copies") > max(1, total // HOT_SHARE)
    hot_info = F.broadcast(info.where(is_hot).select(F.col("cls").alias("h"), F.struct("n_similar", "component_id").alias("hot")))
    marked = rows.join(hot_info, (F.col("cls") == F.col("h")) & F.col("doc_id").isNotNull(), "left")
    done = marked.where("h is not null").select("doc_id", "n_shingles", "hot.n_similar", "hot.component_id")
    rest = marked.where("h is null").withColumn("c", F.when(F.col("doc_id").isNotNull(), F.col("cls")))
    rest = rest.join(info.where(~is_hot).select(F.col("cls").alias("c"), "n_similar", "component_id"), "c", "left")
    rest = rest.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return done.unionByName(rest)


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents),
reach AS (
  WITH RECURSIVE t(id, c) AS (SELECT id, c FROM r UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.id)
  SELECT id, min(c) AS c FROM t GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_similar, reach.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.id = d.doc_id
"""


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    """Documents of which at least 80 of 100 five-word shingles are shared."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
