"""Helpers shared by the operators: flat text buffers, word spans, rolling hashes, checkpoints and components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import time
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; one longer document is a slab of its own.
SLAB = 2 << 20
NULL_ID = np.iinfo(np.int64).max  # documents without an id sort last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # of glibc
        libc.malloc_trim(0)


def trimmed(run):
    """The function `run` of Arrow batches, with the memory it has freed given back to the system at its end: a Python worker lives on, idle, beside
    the executor's heap while later stages need theirs."""

    def all_of(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_of


def byte_mask(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, set for the byte values inside the closed ranges."""
    mask = np.zeros(256, bool)
    for lo, hi in ranges:
        mask[lo : hi + 1] = True
    return mask


#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
PLAIN_WORD = ~byte_mask((0x20, 0x20), (0x09, 0x0D))
#: Words of letters, digits and everything beyond ASCII.
ALNUM_WORD = byte_mask((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: The same without digits.
LETTER_WORD = byte_mask((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slabs(offs: np.ndarray, size: int = SLAB):
    """(first, last) row ranges whose texts come to about `size` bytes."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (one more entry at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = mask[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 over any span of a sequence, from prefix sums; the base is odd and so has an inverse."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15 | 1, seed: int = 7):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.bytes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(n, b, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: uint64 symbols.  Entry i is the hash of the first i symbols."""
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all spans of k symbols."""
        n = len(prefix) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((prefix[k:] - prefix[: n - k + 1]) * self.down[: n - k + 1] + np.uint64(k))


#: Words longer than this are hashed by a digest: polynomials modulo 2**64 have known collisions from some 1000 symbols on.
LONG_WORD = 256


def word_hashes(rolling: Rolling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = rolling.spans(rolling.prefix(rolling.bytes[data]), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=rolling.base.to_bytes(8)).digest())
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - shift, lengths)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.  Where that is unset, one of this machine's in local mode (tests), and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Seconds between collections of the driver's garbage, which is what makes Spark delete the files of shuffles that no plan needs.
RELEASE = 10


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffles and broadcasts of plans that are done.  It does so when the driver's heap is collected, else much later than
    the executors' disks are full of them.  The plan that has just ended is let go between the first collection and the second."""
    if time.monotonic() - release.__dict__.get("last", 0.0) >= RELEASE:
        gc.collect()
        give_back()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
        release.last = time.monotonic()


def stored(df: DataFrame) -> DataFrame:
    """Written as a table in the shared folder and read again, which cuts the lineage and computes it once."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of `stored` that no later plan reads."""
    for df in tables:
        if df is not None and (path := getattr(df, "_stored_at", None)):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Edges that one process takes, 16 bytes each; more of them are joined by shuffling.
FEW = 1 << 18


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), and the smallest node of each one's component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        # Every root beside a smaller one goes below it, so that half of those that have edges stay at most.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return ids, ids[root]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: (id, component), component being the smallest id.

    Up to FEW edges are joined by the driver, as a dozen plans for each step cost more than the step.  Beyond that it
    alternates the large-star and small-star steps until the edges stay the same, which they do after a number of rounds
    of the order of the squared logarithm of the nodes.  Each step is an aggregate with partial sums and an equi-join,
    which adaptive execution can split where a hub is hot; no group is collected, and nothing but a count and a checksum
    comes to the driver.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    if e.count() <= FEW:
        few = e.toArrow()
        found = united(few["u"].to_numpy(), few["v"].to_numpy())
        out = stored(e.sparkSession.createDataFrame(pa.table(dict(zip(("id", "component"), found, strict=True))), "id bigint, component bigint"))
        discard(e)
        return out
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.where("u <> v").distinct())
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    own = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = stored(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own))
    discard(e)
    return out


def _joined(group: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components `group` after the links (a, b) of `found` join some."""
    if group is None:
        return components(found)
    own = [group.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab"]
    between = found.join(own[0], "a", "left").join(own[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    upper = components(between)
    lifted = group.join(upper.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    out = stored(lifted.unionByName(upper.join(group, "id", "left_anti")))
    discard(group, upper)
    return out


def _apart(met: DataFrame, group: DataFrame) -> DataFrame:
    """(key, u, p, n, c, free, df) of the buckets whose nodes lie in more than one component yet."""
    of = met.join(group.withColumnRenamed("id", "u"), "u", "left").select("key", "u", "p", "n", F.coalesce("component", "u").alias("c"), "free", "df")
    mixed = of.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    return of.join(mixed, "key")


#: A pair that meets in several buckets is made in the first; each row has so many of its node's buckets before its own to tell by.
EARLIER = 16
#: Classes of nodes by the logarithm of their numbers of shingles, which in one class differ by a factor of up to exp(1 / LIKE).
LIKE = 20
#: Buckets of so few nodes have their pairs made at once, at most half as many a row.
SMALL = 16


def buckets(spread: DataFrame, *first: str) -> DataFrame:
    """(key, u, n, m) from nodes and their keys (key, u): one bucket of each set of n > 1 nodes, for all m keys under which those nodes meet.

    Copies that differ little share most of their bands, so that several keys hold the same nodes and would make the same
    pairs.  Sets are told apart by their number and two 64-bit sums of hashes.  The least key stays, by the columns
    `first`, which are a key's, and then by itself.
    """
    each = spread.groupBy("key", *first).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "u")).alias("s2")).where("n > 1")
    one = each.groupBy("n", "s1", "s2").agg(F.min(F.struct(*first, "key")).alias("least"), F.count(F.lit(1)).alias("m"))
    return spread.join(one.select("least.key", "n", "m"), "key").select("key", "u", "n", "m")


def met_keys(spread: DataFrame) -> DataFrame:
    """The rows (key, u) whose key several rows have.  Where most keys are one node's alone, `buckets` then moves a few rows' hashes only."""
    return spread.join(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")


def _pairs(of: DataFrame, fits: str = "true", share: float = 0.0) -> DataFrame:
    """(a, b) of one bucket (key, u, c, free, df) and of different components c, in the first bucket by (df, key) that both are in, and in
    later ones only if none of the EARLIER buckets of both before those is the same.  fits: a condition on x.free and y.free, which implies that both
    numbers left, n - at, are at least `share` of n of both together, or that a free is null.

    Nodes whose bucket before this one is the same met there.  They are one group of the bucket, and only nodes of different groups are
    joined, as families of lines that have most of their shingles in common would else be paired anew in each of their buckets.  A node
    in its first bucket is a group by itself.  Groups, and then a node and a group, are joined only where the least n of one and the most
    room of the other, what a node's n - at leaves of the other's share, don't rule `fits` out already, nor does a bucket that all their nodes are known to
    have been in; nodes of the smaller group are joined first.
    """
    order = Window.partitionBy("u").orderBy("df", "key")
    earlier = F.collect_list("key").over(order.rowsBetween(-EARLIER, -1))
    of = of.withColumns({"earlier": earlier, "last": F.lag("key").over(order)})
    of = stored(of.select("key", F.col("last").isNull().alias("new"), F.coalesce("last", "u").alias("last"), F.expr(f"cast(coalesce({LIKE} * ln(free.n), -1) as int)").alias("like"), F.struct("u", "c", "free", "earlier").alias("x")))
    bounds = {"lo": "min(x.c)", "hi": "max(x.c)", "size": "count(1)", "any": "bool_or(x.free is null)", "low": "min(x.free.n)", "room": f"max(x.free.n - x.free.at - {share}D * x.free.n)"}
    bounds["all"] = "if(count(1) = 1, first(x.earlier), array(last))"  # buckets that all nodes have been in
    group = of.groupBy("key", "new", "last", "like").agg(*[F.expr(e).alias(k) for k, e in bounds.items()])
    two = [group.select("key", *[F.col(k).alias(f"{k}_{g}") for k in ("new", "last", "like", *bounds)]) for g in "xy"]
    # Each two groups once, unless both lie in one component.
    may = f"(any_x or any_y or (room_x >= {share}D * low_y and room_y >= {share}D * low_x))"
    once = "struct(size_x, new_x, last_x, like_x) < struct(size_y, new_y, last_y, like_y) and not (lo_x = hi_x and lo_y = hi_y and lo_x = lo_y)"
    meet = two[0].join(two[1], "key").where(f"{once} and {may} and not arrays_overlap(all_x, all_y)").select("key", "new_x", "last_x", "like_x", *[f"{k}_y" for k in ("new", "last", "like", "lo", "hi", "any", "low", "room", "all")])
    x, y = (of.select("key", *[F.col(k).alias(f"{k}_{g}") for k in ("new", "last", "like")], F.col("x").alias(g)) for g in "xy")
    may = f"(x.free is null or any_y or (x.free.n - x.free.at - {share}D * x.free.n >= {share}D * low_y and room_y >= {share}D * x.free.n))"
    some = meet.join(x, ["key", "new_x", "last_x", "like_x"]).where(f"not (x.c = lo_y and x.c = hi_y) and {may} and not arrays_overlap(x.earlier, all_y)").select("key", "new_y", "last_y", "like_y", "x")
    both = some.join(y, ["key", "new_y", "last_y", "like_y"]).where(f"x.c <> y.c and {fits} and not arrays_overlap(x.earlier, y.earlier)")
    out = both.selectExpr("if(x.c < y.c, x.u, y.u) as a", "if(x.c < y.c, y.u, x.u) as b")
    out._stored_at = of._stored_at
    return out


def linked(met: DataFrame, verify, tokens, threshold: float) -> DataFrame:
    """Components of the nodes that are linked, (id, component), from the buckets (key, u) in which they met, or those of `buckets`.

    verify: distinct pairs (a, b) -> (a, b, ok), the links among them.  tokens: nodes (u) -> (u, h, w), each node's
    distinct shingles, as hashes, and their weights.

    1. Each bucket has a lead, paired with its other nodes, so that pairs grow with the rows of the buckets.  The lead has
       the most neighbours over all buckets: of a text and its altered copies that is the text, which links more of them
       than they do each other.  Buckets of at most SMALL nodes then get their other pairs between components.
    2. Nodes of larger buckets that hold several components still are put into buckets of their own rare shingles.
       Shingles are ordered by how many of these nodes have them; whatever a node can be linked with has one of its first
       ones, those up to a share of 1 - threshold of its number or weight.  This prefix is exact, and no link within a
       bucket of step 1 is lost.  A shingle of one node alone makes no bucket, so that nodes which differ in what is
       theirs alone don't meet again, however many share the rest.
    3. These buckets get leads as those of step 1 do, in two rounds, the second lead being the like of the nodes outside
       the component of the first; and then all pairs between components.  A pair is made only where
       the numbers of shingles, and of those that come before the bucket's, leave enough that both can have: that holds
       in the bucket of the first shingle that both have, if they are linked by numbers.
    All pairs between components are made in the first bucket, in the order of shingles, of those that both are in: not
    again in a bucket before which both have had another, as far as its rows tell.
    """
    group, tried = None, []

    def asked(pairs: DataFrame) -> None:
        nonlocal group
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, [t.select("a", "b") for t in tried]), ["a", "b"], "left_anti")
        done = stored(verify(pairs))
        tried.append(done)
        found = done.where("ok")
        if group is None or found.limit(1).count():
            group = _joined(group, found)

    # Of x and y: whether both can have t / (1 + t) of the sum of their numbers of shingles.
    least = threshold / (1 + threshold) * (1 - 1e-9)
    fits = f"(x.free.n is null or y.free.n is null or least(x.free.n - x.free.at, y.free.n - y.free.at) >= {least}D * (x.free.n + y.free.n))"
    node = F.struct("p", "u", "c", "free")

    def led(of: DataFrame, rounds: int) -> DataFrame | None:
        """Rounds of leads over the buckets (key, u, p, n, free); what lies apart after them, stored, or None."""
        met, before = of, None
        for r in range(rounds + 1):
            if group is not None:
                of = stored(_apart(met.where(f"n > {r + 1}"), group))
                discard(before)
                before = of
                if not of.limit(1).count():
                    return None
                if r == rounds:
                    return of
            else:
                of = of.withColumn("c", F.col("u"))
            lead = of.groupBy("key").agg(F.max(node).alias("y"))
            if r:
                lead = of.join(lead, "key").where("c <> y.c").groupBy("key").agg(F.max(node).alias("y"))
            pairs = of.select("key", node.alias("x")).join(lead, "key").where(f"x.c <> y.c and {fits}")
            asked(pairs.select(F.col("x.u").alias("a"), F.col("y.u").alias("b")))

    def paired(of: DataFrame) -> None:
        asked(pairs := _pairs(of, fits, least))
        discard(pairs)

    met = met if "m" in met.columns else buckets(met)
    met = stored(met.join(met.groupBy("u").agg(F.sum(F.col("n") * F.col("m")).alias("p")), "u").select("key", "u", "p", "n", F.expr("cast(null as struct<n: bigint, at: bigint>)").alias("free"), F.lit(0).cast("bigint").alias("df")))
    left = led(met, 1)
    discard(met)
    if left is None:
        return group
    paired(left.where(f"n <= {SMALL}"))
    large = stored(_apart(left.where(f"n > {SMALL}"), group))
    discard(left)
    left = large
    if not left.limit(1).count():
        return group
    each = stored(tokens(left.select("u").distinct()))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    share = (1 - threshold) * (1 + 1e-9)
    # What is a node's alone comes first and makes no bucket; the rest is ordered by how rare it is.
    own = each.join(common, "h", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    node_own = Window.partitionBy("u")
    order = node_own.orderBy("df", "h")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"at": F.row_number().over(order) - 1, "at_w": F.coalesce(F.sum("w").over(before), F.lit(0))})
    own = own.withColumns({"of": F.count(F.lit(1)).over(node_own), "all": F.sum("w").over(node_own), "most": F.max("w").over(node_own)})
    near = own.where(f"df > 1 and (at <= {share}D * of or at_w <= {share}D * all)")
    near = stored(near.select(F.col("h").alias("key"), "u", "df", F.col("of").alias("p"), F.when(F.col("most") == 1, F.expr("struct(of as n, cast(at as bigint) as at)")).alias("free")))
    discard(left, each)
    # The first of the buckets that hold the same nodes is the one that holds a pair's first shingle in common.
    held = stored(near.join(buckets(near, "df").select("key", "u", "n"), ["key", "u"]).select("key", "u", "p", "n", "free", "df"))
    discard(near)
    near = held
    left = led(near, 2)
    if left is not None:
        paired(left)
    discard(left, near, *tried)
    return group
