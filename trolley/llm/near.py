"""What the operators on near copies share: MinHash signatures, banded candidates, verification, union-find.

Vertices are numbered rows. Rows of equal content are one vertex. Band keys and
content keys meet in one shuffle by key; rows of a key that is frequent in a
batch of the map side go there as a chunk of their own, with one of them
standing for the rest among the others, so no task gathers a hot key. Links
between different contents are confirmed on full sets:

1. with the first row of a band, first one pair for each vertex, then those
   that the links so far leave in different parts;
2. in candidate groups that still have several parts, signatures of all pairs
   across parts are compared batch by batch; the pairs that may reach the
   similarity, as far as they join anything, cut the group into smaller ones.
   A group of more than ``GROUP`` open rows is taken apart by its bands first,
   so that only rows that share one are compared;
3. in these smaller groups every pair across parts that passes the signatures
   is compared on full sets.

Blocks of pairs are of bounded size, and tasks emit joining links only.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.shared import relaxed, settle, slices

#: Vertices of one side of a block of pairs, on average: of full sets, and of signatures alone.
BLOCK, SIGNATURE_BLOCK = 256, 2048
#: Open rows of a candidate group beyond which only rows of one band are compared.
GROUP = 4096
#: Hashes of a signature that prunes pairs, 8 bits of each.
PRUNING = 256
#: Edges of a written file in union-find, about.
FILE_ROWS = 200_000
#: Rows of one key in a batch that go as a chunk of their own.
HOT = 32
#: Rows up to which a looked-up side is broadcast (two longs each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def minhash(values: np.ndarray, starts: np.ndarray, hashes: int, seed: int = 7) -> np.ndarray:
    """Signatures (len(starts), hashes) of the non-empty runs of 32-bit ``values`` that begin at ``starts``.

    The values are hashes themselves, so products with odd numbers order them anew each time.
    """
    odd = np.random.default_rng(seed).integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((hashes, len(starts)), np.uint32)
    product = np.empty_like(values)
    for k in range(hashes):
        np.multiply(values, odd[k], out=product)
        np.minimum.reduceat(product, starts, out=out[k])
    return out.T


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` hashes of each signature."""
    parts = signatures.reshape(len(signatures), signatures.shape[1] // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _MIX[1], parts.shape[:2])
    for k in range(rows):
        key = (key ^ parts[:, :, k]) * _MIX[0]
        key = key ^ (key >> np.uint64(31))
    return key.view(np.int64)


@functools.cache
def fewest_matches(compared: int, threshold: float, miss: float) -> int:
    """The fewest equal hashes among ``compared`` at which a pair may still reach ``threshold``.

    With a uniform prior the posterior chance of a similarity of ``threshold``
    or more after m matches is that of at most m successes in compared + 1
    trials; pairs under ``miss`` are pruned.
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= miss:
            return m
    return compared + 1


def small_join(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join; ``small`` (settled, a few numbers a row) is broadcast only if it is counted under the bound."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


#: What meets, packed: a row of the shuffle holds what a batch of the map side has for one bucket of keys. Of kind BANDED,
#: x has the steps between sorted band keys from ``base`` on, y their rows; of kind KEYED, x and y the halves of content
#: keys, z their rows. MEMBER, EDGE and COPY are results already, as a in x and b in y, of any bucket.
MEET = "bucket int, kind int, base long, x binary, y binary, z binary"
MEMBER, EDGE, COPY, BANDED, KEYED = range(5)
#: Buckets of keys at least, and rows of bands in a bucket beyond which there are more.
BUCKETS, BUCKET_ROWS = 1024, 1 << 19
#: Results that go together.
READY = 256


def buckets(rows: int) -> int:
    """How many buckets, a power of two, so many rows of bands go to."""
    return max(BUCKETS, 1 << max(0, (rows - 1) // BUCKET_ROWS).bit_length())


def _planes(values: np.ndarray) -> np.ndarray:
    """64-bit numbers as rows of their first bytes, second bytes and so on: bytes that differ little compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)


def _numbers(packed: list[bytes], kind: type = np.int64) -> np.ndarray:
    """The numbers of several ``_planes``."""
    parts = [np.frombuffer(x, np.uint8).reshape(8, -1).T for x in packed]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.zeros(0, kind)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal numbers."""
    if not len(bucket):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    return start, np.append(start[1:], len(bucket))


def meeting(
    keys: np.ndarray, rows: np.ndarray, first: np.ndarray, band_rows: np.ndarray, band_keys: np.ndarray, buckets: int = BUCKETS
) -> pa.RecordBatch:
    """What a batch of the map side sends to ``met`` (MEET).

    keys: content keys (n, 2) of ``rows``, with ``first`` the row of the same key that the task has seen
    before (-1: none); band_rows, band_keys (m, bands): rows with bands and their keys. Every row of a key
    goes by the key; of ``HOT`` rows of a band or more the first goes by the band, and they meet here.
    """
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    out: dict[str, list] = {c: [] for c in ("bucket", "kind", "base", "x", "y", "z")}

    def send(bucket: int, kind: int, base: int, x: bytes, y: bytes, z: bytes = b"") -> None:
        for c, v in zip(out.values(), (bucket, kind, base, x, y, z)):
            c.append(v)

    def ready(kind: int, a: np.ndarray, b: np.ndarray) -> None:
        # Results go anywhere, a few at a time, so that tasks get as many.
        x, y = _planes(a), _planes(b)
        for k in range(0, len(a), READY):
            send((int(b[k]) * 0x9E3779B97F4A7C15 >> 40) % buckets, kind, 0, x[:, k : k + READY].tobytes(), y[:, k : k + READY].tobytes())

    even, owner = (band_keys.ravel() & ~1).view(np.uint64), np.repeat(band_rows, band_keys.shape[1])
    order = np.argsort(even, kind="stable")
    even, owner = even[order], owner[order]
    start, end = _by_bucket(even)
    hot = end - start >= HOT
    if hot.any():
        inside = np.repeat(hot, end - start)
        own, heads = owner[inside], np.repeat(owner[start[hot]], (end - start)[hot])
        ready(MEMBER, even[inside].view(np.int64), own)
        ready(EDGE, heads[own != heads], own[own != heads])
        inside[start] = False
        even, owner = even[~inside], owner[~inside]
    start, end = _by_bucket(even >> bits)
    steps = np.diff(even, prepend=np.uint64(0))
    steps[start] = 0
    x, y = _planes(steps), _planes(owner)
    for a, b in zip(start.tolist(), end.tolist()):
        send(int(even[a] >> bits), BANDED, int(even[a : a + 1].view(np.int64)[0]), x[:, a:b].tobytes(), y[:, a:b].tobytes())

    copies, fresh = np.flatnonzero(first >= 0), np.flatnonzero(first < 0)
    ready(COPY, rows[copies], first[copies])
    bucket = np.ascontiguousarray(keys[fresh, 0]).view(np.uint64) >> bits
    order = np.argsort(bucket, kind="stable")
    bucket, fresh = bucket[order], fresh[order]
    x, y, z = _planes(keys[fresh, 0]), _planes(keys[fresh, 1]), _planes(rows[fresh])
    for a, b in zip(*(c.tolist() for c in _by_bucket(bucket))):
        send(int(bucket[a]), KEYED, 0, x[:, a:b].tobytes(), y[:, a:b].tobytes(), z[:, a:b].tobytes())
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds)], list(out))


def _of_several(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, ``same`` as the one before: the places of those that aren't alone, and where a run starts among these."""
    among = same.copy()
    among[:-1] |= same[1:]
    places = np.flatnonzero(among)
    return places, np.flatnonzero(~same[places])


def _first_of(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every row the smallest row of its run."""
    return np.repeat(np.minimum.reduceat(rows, start), np.diff(np.append(start, len(rows))))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of MEET sorted by bucket, as (kind, a, b).

    member: (band, row) of a band with several rows; edge: a band's first row and another; copy: a key's first row and another, as (row, first).
    """

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def met_in(banded: list[tuple], keyed: list[tuple]) -> Iterator[pa.RecordBatch]:
        if banded:
            steps, row = _numbers([x for _, x, _ in banded], np.uint64), _numbers([y for _, _, y in banded])
            start = np.cumsum([0, *(len(x) // 8 for _, x, _ in banded)])[:-1]
            # A step is back to this part's base from the last part's end.
            sums = np.cumsum(steps)
            bases = np.array([base for base, _, _ in banded], np.int64).view(np.uint64)
            sizes = np.diff(np.append(start, len(steps)))
            band = sums + np.repeat(bases - sums[start], sizes)
            order = np.argsort(band)
            band = band[order]
            places, runs = _of_several(np.concatenate([[False], band[1:] == band[:-1]]))
            if len(places):
                row = row[order[places]]
                yield batch_of(MEMBER, band[places].view(np.int64), row)
                first = _first_of(row, runs)
                yield batch_of(EDGE, first[row != first], row[row != first])
        if keyed:
            k1, k2, row = (_numbers([x[k] for x in keyed]) for k in range(3))
            order = np.lexsort((k2, k1))
            k1, k2 = k1[order], k2[order]
            places, runs = _of_several(np.concatenate([[False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])]))
            if len(places):
                row = row[order[places]]
                first = _first_of(row, runs)
                yield batch_of(COPY, row[row != first], first[row != first])

    at: int | None = None
    banded: list[tuple] = []
    keyed: list[tuple] = []
    for batch in batches:
        for bucket, kind, base, x, y, z in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                yield from met_in(banded, keyed)
                at, banded, keyed = bucket, [], []
            if kind == BANDED:
                banded.append((base, x, y))
            elif kind == KEYED:
                keyed.append((x, y, z))
            else:
                yield batch_of(kind, _numbers([x]), _numbers([y]))
    yield from met_in(banded, keyed)


def met(rows: DataFrame) -> DataFrame:
    """(kind, a, b) of ``_met`` for rows of ``meeting`` (MEET)."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return settle(dealt.mapInArrow(relaxed(_met), "kind int, a long, b long"), "met")


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): each vertex of ``edges`` (a, b) but the roots, with the smallest vertex it reaches.

    Alternates large-star and small-star steps until nothing changes; every
    step's edges are a written table, and nothing but two numbers is collected.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = settle(e, "edges")
    before = mark(e)
    while before[0]:
        # Steps are written in files of some size, not one for each shuffle partition.
        parts = 1 + before[0] // FILE_ROWS
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = settle(least.coalesce(parts), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x != y")
        large = settle(large.distinct().coalesce(parts), "large")
        near = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(near, "x").where("y != m").select(F.col("y").alias("a"), F.col("m").alias("b"))
        e = settle(small.union(near.select("x", "m")).distinct().coalesce(parts), "edges")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("v"), F.col("b").alias("comp"))


def _with_roots(found: DataFrame) -> DataFrame:
    return found.union(found.select("comp", "comp").distinct())


#: From items to their sets, each a sorted array of distinct numbers.
ToSets = Callable[[list], list[np.ndarray]]


def as_sets(values: list) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in values]


def _items(column: pa.Array) -> list:
    """Strings, or arrays of numbers without a copy."""
    return [x.values for x in column] if pa.types.is_list(column.type) else column.to_pylist()


def _confirmed(num: int, den: int, to_sets: ToSets):
    """Pairs (a, b, x, y) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            a = batch.column("a").to_numpy()
            # Pairs of one a follow each other.
            new = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
            left = to_sets(_items(batch.column("x").filter(pa.array(new))))
            good = []
            for k, q in zip((np.cumsum(new) - 1).tolist(), to_sets(_items(batch.column("y")))):
                both = np.concatenate([left[k], q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(den * common >= num * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _across(num: int, den: int, batch: int, miss: float, to_sets: ToSets):
    """Function of one block of pairs: links (a, b) that join parts.

    Takes arrays by row: lid, part, side (-1 left, 1 right, 0 both), and
    functions that give a row's item and signature (or None).
    """

    def run(lid: np.ndarray, part: np.ndarray, side: np.ndarray, item, signature) -> list[tuple[int, int]]:
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        apart = part[i] != part[j]
        if len(left) == len(lid) == len(right):
            apart &= i < j
        i, j = i[apart], j[apart]
        if signature and len(i):
            sig = np.stack([np.frombuffer(signature(k), np.uint8) for k in range(len(lid))])
            # Hashes keep 8 bits; unequal ones agree by chance in one of 256.
            chance = num / den + (1 - num / den) / 256
            equal = np.zeros(len(i), np.int64)
            for at in range(0, sig.shape[1], batch):
                to = min(at + batch, sig.shape[1])
                # A slice of pairs at a time, for bounded memory.
                for k in range(0, len(i), 1 << 15):
                    equal[k : k + (1 << 15)] += (sig[i[k : k + (1 << 15)], at:to] == sig[j[k : k + (1 << 15)], at:to]).sum(1)
                alive = equal >= fewest_matches(to, chance, miss)
                i, j, equal = i[alive], j[alive], equal[alive]
        if not len(i):
            return []
        needed = sorted({*i.tolist(), *j.tolist()})
        sets = dict(zip(needed, to_sets([item(k) for k in needed])))
        n = np.zeros(len(lid), np.int64)
        n[list(sets)] = [len(s) for s in sets.values()]
        alike = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
        i, j = i[alike], j[alike]
        root = {p: p for p in part.tolist()}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        out: list[tuple[int, int]] = []
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for js, first in zip(np.split(j, cuts), i[np.concatenate([[0], cuts])] if len(i) else []):
            js = js[[top(int(part[k])) != top(int(part[first])) for k in js]]
            if not len(js):
                continue
            own = sets[first]
            cat = np.concatenate([sets[k] for k in js])
            place = np.minimum(np.searchsorted(own, cat), len(own) - 1)
            common = np.add.reduceat((own[place] == cat).astype(np.int64), np.cumsum(n[js]) - n[js])
            for k in js[den * common >= num * (n[first] + n[js] - common)]:
                a, b = top(int(part[first])), top(int(part[k]))
                if a != b:
                    root[a] = b
                    out.append((int(lid[first]), int(lid[k])))
        return out

    return run


def _possible(chance: float, batch: int, miss: float):
    """Function of one block of pairs: pairs (a, b) across parts whose signatures allow the similarity, as far as they join parts."""

    def run(lid: np.ndarray, part: np.ndarray, side: np.ndarray, item, signature) -> list[tuple[int, int]]:
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        sig = np.stack([np.frombuffer(signature(k), np.uint8) for k in range(len(lid))])
        _, root = np.unique(part, return_inverse=True)
        same_side = len(left) == len(lid) == len(right)
        theirs = np.ascontiguousarray(sig[right])
        out: list[tuple[int, int]] = []
        for place, i in enumerate(left):
            others = np.arange(place + 1 if same_side else 0, len(right))
            others = others[root[right[others]] != root[i]]
            equal = np.zeros(len(others), np.int64)
            for at in range(0, sig.shape[1], batch):
                if not len(others):
                    break
                to = min(at + batch, sig.shape[1])
                equal += (theirs[others, at:to] == sig[i, at:to]).sum(1)
                alive = equal >= fewest_matches(to, chance, miss)
                others, equal = others[alive], equal[alive]
            for j in right[others]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((int(lid[i]), int(lid[j])))
        return out

    return run


_KEY = ["cand", "kind", "x", "y"]


def _blocks(across):
    """``across`` over rows sorted by block (``_KEY``): a block is a run of rows, maybe over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            lid, part, side = (rows.column(c).to_numpy() for c in ("lid", "part", "side"))
            items, sigs = (rows.column(c) if c in rows.column_names else None for c in ("items", "sig"))
            is_list = items is not None and pa.types.is_list(items.type)
            out: list[tuple[int, int]] = []
            for a, b in zip(starts, [*starts[1:], len(lid)]):
                item = lambda k, a=a: items[int(a + k)].values if is_list else items[int(a + k)].as_py()
                signature = (lambda k, a=a: sigs[int(a + k)].as_py()) if sigs is not None else None
                out += across(lid[a:b], part[a:b], side[a:b], item, signature)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            keys = [held.column(c).to_numpy() for c in _KEY]
            new = np.zeros(max(0, len(held) - 1), bool)
            for key in keys:
                new |= key[1:] != key[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            if len(starts) > 1:  # the last block may go on
                yield links(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1]).combine_chunks()
        if held is not None and len(held):
            yield links(held, np.array([0]))

    return run


def _signed(to_sets: ToSets):
    """Pruning signatures of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                own = to_sets(_items(batch.column("items").slice(first, 64)))
                values = [(x.view(np.uint64) >> np.uint64(32)).astype(np.uint32) for x in own]
                starts = np.cumsum([0, *map(len, values)])[:-1]
                low = (minhash(np.concatenate(values), starts, PRUNING, seed=8) & 0xFF).astype(np.uint8)
                sig = pa.array([x.tobytes() for x in low], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("lid").slice(first, 64), sig], ["lid", "sig"])

    return run


def _open_groups(parts: DataFrame) -> DataFrame:
    """(lid, cand, part, main, n, most) of ``parts`` (lid, cand, part) in groups of several parts; main: the largest part.

    Pairs in the main part need no look.
    """
    sizes = parts.groupBy("cand", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("cand").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"))
    sizes = sizes.where(F.col("n") > F.col("most.n"))
    sizes = sizes.select("cand", F.col("most.part").alias("main"), "n", F.col("most.n").alias("most"))
    return small_join(parts, settle(sizes, "sizes"), ["cand"])


def _keyed(open_: DataFrame, size: int) -> DataFrame:
    """Rows of ``_open_groups`` once for each block of pairs (``_KEY``) that needs them, with their ``side``."""
    is_main = F.col("part") == F.col("main")
    counted = open_.withColumn("mains", F.ceil(F.col("most") / size).cast("int"))
    counted = counted.withColumn("others", F.ceil((F.col("n") - F.col("most")) / size).cast("int"))
    block = F.pmod(F.xxhash64("lid"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    others, mains = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("others", "mains"))

    def key(a, b, kind, side):
        return F.struct(a.alias("x"), b.alias("y"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))

    zero, here = F.lit(0), F.col("block")
    with_main = F.transform(mains, lambda j: key(here, j, 1, F.lit(-1)))
    with_others = F.transform(
        others, lambda j: key(F.least(here, j), F.greatest(here, j), 0, F.when(here == j, zero).when(here < j, -1).otherwise(1))
    )
    from_main = F.transform(others, lambda i: key(i, here, 1, F.lit(1)))
    keyed = counted.withColumn("block", block).select(
        "lid", "cand", "part", F.explode(F.when(is_main, from_main).otherwise(F.concat(with_main, with_others))).alias("k")
    )
    return keyed.select("lid", "cand", "part", "k.*")


def _linked(keyed: DataFrame, across) -> DataFrame:
    """Links (a, b) that ``across`` finds in each block."""
    # Most blocks are a few rows, so they go through the task as sorted runs, not as a call each.
    ordered = keyed.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return ordered.mapInArrow(relaxed(_blocks(across)), "a long, b long")


def _in_parts(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """(lid, cand, part) of ``candidates`` (lid, cand): part, the smallest row that ``links`` (a, b) join it to."""
    parts = _with_roots(components(links)).select(F.col("v").alias("lid"), F.col("comp").alias("part"))
    return settle(candidates.join(parts, "lid", "left").select("lid", "cand", F.coalesce("part", "lid").alias("part")), "parts")


def _part_of(parts: DataFrame, c: str) -> DataFrame:
    return parts.select(F.col("lid").alias(c), F.col("part").alias(f"part_{c}"))


def groups(
    met_rows: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    num: int,
    den: int,
    batch: int = 32,
    miss: float = 1e-6,
    to_sets: ToSets = as_sets,
) -> DataFrame:
    """(lid, comp): rows linked with others, directly or over others, with the smallest row so reached; roots too.

    met_rows: of ``met``. fetch: from (lid) to (lid, items); to_sets makes items sorted arrays of distinct numbers.
    Links: equal keys, or den * |intersection| >= num * |union| of the sets.
    """
    pair = (F.col("a").alias("lid"), F.col("b").alias("first"))
    # A task's first row of a key may be another task's copy.
    copies = met_rows.where(F.col("kind") == COPY).select(*pair)
    once = copies.select(F.col("lid").alias("first"), F.col("first").alias("root"))
    copies = copies.join(once, "first", "left").select("lid", F.coalesce("root", "first").alias("first"))
    copies = settle(copies, "copies")

    def whole(rows: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            own = copies.select(F.col("lid").alias(c), F.col("first").alias("f"))
            rows = rows.join(own, c, "left").withColumn(c, F.coalesce("f", c)).drop("f")
        return rows

    def apart(edges: DataFrame) -> DataFrame:
        return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()

    # Most pairs share many bands.
    edges = met_rows.where(F.col("kind") == EDGE).select("a", "b").distinct()
    near = settle(apart(whole(edges, "a", "b")), "near")
    candidates = settle(_with_roots(components(near)).select(F.col("v").alias("lid"), F.col("comp").alias("cand")), "cand")
    sets = settle(fetch(candidates.select("lid")), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.join(sets.select(F.col("lid").alias("b"), F.col("items").alias("y")), "b")
        pairs = pairs.join(sets.select(F.col("lid").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")
        return settle(pairs.mapInArrow(relaxed(_confirmed(num, den, to_sets)), "a long, b long"), name)

    one = settle(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "one")
    links = confirmed(one, "confirmed")
    parts = _in_parts(candidates, links)
    rest = near.join(one, ["a", "b"], "left_anti").join(_part_of(parts, "a"), "a").join(_part_of(parts, "b"), "b")
    rest = rest.where("part_a != part_b")
    more = confirmed(rest.select("a", "b"), "confirmed")
    links = settle(links.union(more), "links")
    parts = _in_parts(candidates, links)

    # Signatures cut candidate groups into those of pairs that may reach the similarity.
    open_ = settle(_open_groups(parts), "open")
    signs = settle(open_.select("lid").join(sets, "lid").mapInArrow(relaxed(_signed(to_sets)), "lid long, sig binary"), "signs")
    large = F.col("n") > GROUP
    member = met_rows.where(F.col("kind") == MEMBER).select(F.col("a").alias("band"), F.col("b").alias("lid"))
    wide = open_.where(large).select("lid", "part", "main")
    keyed = _keyed(open_.where(~large), SIGNATURE_BLOCK)
    if not wide.isEmpty():
        # Only bands with a row outside the main part hold several parts.
        own = copies.join(wide, copies["first"] == wide["lid"]).select(copies["lid"].alias("row"), wide["lid"], "part", "main")
        own = settle(wide.select(F.col("lid").alias("row"), "lid", "part", "main").union(own), "wide")
        member = member.withColumnRenamed("lid", "row")
        mixed = member.join(own.where("part != main").select("row"), "row").select("band").distinct()
        by_band = member.join(settle(mixed, "mixed"), "band").join(own, "row")
        by_band = by_band.select("lid", F.col("band").alias("cand"), "part").distinct()
        keyed = keyed.unionByName(_keyed(_open_groups(by_band), SIGNATURE_BLOCK))
    chance = num / den + (1 - num / den) / 256
    maybe = settle(_linked(keyed.join(signs, "lid"), _possible(chance, batch, miss)), "maybe")
    # A vertex here is a part.
    ends = maybe.join(_part_of(parts, "a"), "a").join(_part_of(parts, "b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    joined = _with_roots(components(ends)).select(F.col("v").alias("part"), F.col("comp").alias("cand"))
    finer = settle(parts.drop("cand").join(joined, "part").select("lid", "cand", "part"), "finer")
    found = _keyed(_open_groups(finer), BLOCK).join(signs, "lid").join(sets, "lid")
    found = _linked(found, _across(num, den, batch, miss, to_sets))
    links = settle(links.union(found), "links")

    final = _with_roots(components(links)).select(F.col("v").alias("lid"), "comp")
    roots = copies.select("first").distinct().select(F.col("first").alias("lid"))
    known = roots.join(final, "lid", "full").select("lid", F.coalesce("comp", "lid").alias("comp"))
    known = settle(known, "groups")
    copied = copies.join(known.select(F.col("lid").alias("first"), "comp"), "first").select("lid", "comp")
    return known.union(copied)
