"""Documents that share most of their word shingles, by adaptive multi-match prefixes.

Shingles are put in one order for all documents: rare ones first, counted over the whole
table. Two sets that overlap enough share a shingle among the first ``n - need + 1`` of
each, and ``m`` shingles among the first ``n - need + m``. Where the common shingles of a
document's prefix promise many candidates, the prefix is lengthened and as many more
shared shingles are asked for; a pair has to share as many as the less demanding of the two
asks. Of the pairs left those that parities of hashed shingles do not show to be far apart are
verified on the whole sets.

Equal sets are one node from the start. Shingles with a long posting list are worked on in
blocks of nodes, where a pair is looked at only under the first shingle that both prefixes
have, and of the links found only a spanning forest leaves the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.shingles import set_digest, shingle_set
from pairloom.llm.steps import written
from pairloom.session import parallelism

# Shingles in this many nodes are common: their count is known to every task.
COMMON = 16
# Bits of a shingle's hash that are counted, below those of its bucket. Buckets grow with the input.
KEY_BITS = 26
# No more common shingles than this are kept (12 MB); the bound of "common" rises to fit.
COMMON_KEPT = 1 << 20
# Posting lists that may grow longer than this are worked on in blocks.
LONG_LIST = 128
LONGEST_MATCH = 8
# Cost of verifying a candidate, in units of reading a posting.
VERIFY_COST = 8
# Shingles counted at once in one task, and held by one side of a block.
FLUSH = 1_000_000
# Pairs put together at once in one task.
PAIRS_AT_ONCE = 200_000
# Least bits of a set's parities.
PARITY_BITS = 1024
BLOCK_NODES, BLOCK_SHINGLES = 1024, 2_000_000
# A list of nodes up to this length is small enough to be sent to every task.
SENT_NODES = 200_000

_UINT, _LOW = pa.binary(), (1 << 32) - 1


def _pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 32-bit keys as their distances: low bytes, then high bytes, which compress."""
    steps = np.diff(keys, prepend=np.uint32(0))
    if len(steps) and steps.max() >= 1 << 16:
        return b"\4" + keys.tobytes()
    return b"\2" + (steps & 0xFF).astype(np.uint8).tobytes() + (steps >> 8).astype(np.uint8).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    if packed[0] == 4:
        return np.frombuffer(packed, np.uint32, offset=1)
    low, high = np.frombuffer(packed, np.uint8, offset=1).reshape(2, -1).astype(np.uint32)
    return np.cumsum(low | high << 8, dtype=np.uint32)


def _count_batches(width: int, bits: int):
    """Distinct shingles of a stretch of rows with their counts, by bucket of the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) >> np.uint64(64 - KEY_BITS - bits), return_counts=True)
            buckets = (keys >> np.uint64(KEY_BITS)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            low, counts = (keys & np.uint64((1 << KEY_BITS) - 1)).astype(np.uint32), counts.astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(buckets[starts], pa.int32()),
                    pa.array([_pack(low[a:b]) for a, b in zip(starts, ends)], _UINT),
                    pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], _UINT),
                ],
                names=["bucket", "keys", "counts"],
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width)
                digest = set_digest(shingles)
                if len(shingles) == 0 or digest in seen:
                    continue
                seen.add(digest)
                held.append(shingles)
                size += len(shingles)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return count


def _common_of_bucket(least: int):
    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack(k) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()])
        distinct, places = np.unique(keys, return_inverse=True)
        total = np.bincount(places, weights=counts).astype(np.int64)
        common = total >= least
        bucket = table.column("bucket")[0].as_py()
        high = np.uint64(bucket) << np.uint64(KEY_BITS)
        return pa.table(
            {"key": pa.array((distinct[common].astype(np.uint64) | high).astype(np.int64)), "nodes": pa.array(total[common])}
        )

    return merge


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys of the common shingles, their counts, and the bits of a key's bucket.

    A key is the leading ``KEY_BITS + bits`` bits of the hash; all shingles of all texts are
    counted, those of equal sets in one stretch of rows once. Shingles that share a key are counted
    together, which only moves their place in the order.
    """
    bits = max(4, (parallelism(texts.sparkSession) - 1).bit_length())
    counted = texts.mapInArrow(_count_batches(width, bits), "bucket int, keys binary, counts binary")
    common = written(
        counted.groupBy("bucket").applyInArrow(_common_of_bucket(COMMON), "key bigint, nodes bigint"), "common"
    )
    # The smallest power of two above which no more than COMMON_KEPT are left.
    classes = common.groupBy(F.floor(F.log2("nodes")).alias("c")).count().orderBy(F.desc("c")).collect()
    least, kept = COMMON, 0
    for row in classes:
        kept += row["count"]
        if kept > COMMON_KEPT:
            least = 1 << (int(row["c"]) + 1)
            break
    table = common.filter(F.col("nodes") >= least).toArrow()
    keys, counts = table.column("key").to_numpy().astype(np.uint64), table.column("nodes").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order], bits


def _needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any partner at this similarity."""
    return -(-percent * n // 100)


def _matches(counts: np.ndarray, prefix: int) -> int:
    """Shared shingles to ask for: the number with the least estimated cost.

    ``counts`` are the other nodes behind each shingle in order. A longer prefix reads more
    postings, but of the nodes behind them at most one in ``m`` can match ``m`` times.
    """
    best, least = 1, None
    for m in range(1, min(LONGEST_MATCH, len(counts) - prefix + 1) + 1):
        postings = float(counts[: prefix + m - 1].sum())
        cost = postings + VERIFY_COST * postings / m
        if least is None or cost < least:
            best, least = m, cost
    return best


def _signatures(width: int, percent: int, common: Broadcast, bits: int):
    """Node, size, adaptive prefix and parities of each row; the last two only where the node is new to the task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = common.value
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[str, list] = {"k": [], "node": [], "n": [], "asked": [], "short": [], "long": [], "parity": []}
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width)
                n = len(shingles)
                node = set_digest(shingles) if n else None
                asked, short, long, parity = None, None, None, None
                if n and node not in seen:
                    seen.add(node)
                    others = np.zeros(n, np.int64)
                    if len(keys):
                        own = shingles >> np.uint64(64 - KEY_BITS - bits)
                        places = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        found = keys[places] == own
                        others[found] = counts[places[found]] - 1
                    order = np.argsort(others, kind="stable")
                    others = others[order]
                    prefix = n - _needed(n, percent) + 1
                    asked = _matches(others, prefix)
                    length = prefix + asked - 1
                    # Shingles keep their sign bit as they pass through Spark's longs.
                    ordered = shingles[order[:length]].view(np.int64)
                    listed = others[:length] >= LONG_LIST
                    short, long = ordered[~listed], ordered[listed]
                    parity = _parity(shingles)
                out["k"].append(_key(node) if n else None)
                out["node"].append(node)
                out["n"].append(n)
                out["asked"].append(asked)
                out["short"].append(short)
                out["long"].append(long)
                out["parity"].append(parity)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(out["k"], pa.int64()),
                    pa.array(out["node"], pa.binary()),
                    pa.array(out["n"], pa.int64()),
                    pa.array(out["asked"], pa.int32()),
                    pa.array(out["short"], pa.list_(pa.int64())),
                    pa.array(out["long"], pa.list_(pa.int64())),
                    pa.array(out["parity"], pa.binary()),
                ],
                names=["id", "k", "node", "n", "asked", "short", "long", "parity"],
            )

    return sign


def _key(node: bytes) -> int:
    """A short stand-in for a node while candidates are sought; nodes that share one are told apart when verified."""
    return int.from_bytes(node[:8], "little", signed=True)


def _pairs(percent: int):
    """Pairs of the nodes behind one shingle whose sizes allow the similarity, and what follows it in each."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            k, p, q = (f.to_numpy() for f in members.flatten().flatten())
            lists = np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy()))
            order = np.lexsort((q, p, k, p >> 32, lists))
            k, p, q, lists = k[order], p[order], q[order], lists[order]
            n, at, asked, long = p >> 32, p & _LOW, q >> 32, q & _LOW
            # In a list the partners of a node follow it, up to the largest size that can be near.
            place = lists << 32 | n
            ends = np.searchsorted(place, lists << 32 | np.minimum(n * 100 // percent, _LOW), side="right")
            partners = ends - np.arange(len(k)) - 1
            done = np.r_[0, np.cumsum(partners)]
            start = 0
            while start < len(k):
                stop = max(int(np.searchsorted(done, done[start] + PAIRS_AT_ONCE, side="right")) - 1, start + 1)
                i = np.repeat(np.arange(start, stop), partners[start:stop])
                j = np.arange(len(i)) - (done[i] - done[start]) + i + 1
                swap = k[i] >= k[j]
                x, y = np.where(swap, j, i), np.where(swap, i, j)
                # Shingles of long lists are not met here, but may be shared too.
                least = np.minimum(asked[i], asked[j]) - np.minimum(long[i], long[j])
                columns = [k[x], k[y], least, n[x] - at[x], n[y] - at[y], n[x] + n[y]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                names = ["a", "b", "asked", "a_left", "b_left", "sizes"]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds)], names=names)
                start = stop

    return pair


def _parity(shingles: np.ndarray) -> bytes:
    """One bit a shingle, or more, flipped by each shingle whose hash ends in the bit's number.

    Bits in which two sets differ are no more than the shingles that one of them has alone.
    """
    bits = max(PARITY_BITS, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(left: bytes, right: bytes) -> int:
    """A bound from below of the shingles that one of two sets has alone; the longer bits are folded."""
    if len(left) < len(right):
        left, right = right, left
    while len(left) > len(right):
        half = len(left) // 2
        left = (int.from_bytes(left[:half]) ^ int.from_bytes(left[half:])).to_bytes(half)
    return (int.from_bytes(left) ^ int.from_bytes(right)).bit_count()


def _near(percent: int):
    """Pairs whose sets may be near enough, by their parities."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.add(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
            apart = [_apart(x, y) for x, y in zip(batch.column("a_parity").to_pylist(), batch.column("b_parity").to_pylist())]
            kept = (100 + percent) * np.array(apart, np.int64) <= (100 - percent) * sizes
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return near


def _linked(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * overlap >= percent * union; ``sizes`` is the sum of both sets' sizes."""
    return (100 + percent) * overlap >= percent * sizes


def _verify(width: int, percent: int):
    """Links among the texts of each candidate pair, which are two but for nodes that share a key."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in batch.column("texts").to_pylist():
                sets = {set_digest(s): s for s in (shingle_set(t, width) for t in set(texts))}
                for (a, left), (b, right) in combinations(sorted(sets.items()), 2):
                    overlap = len(np.intersect1d(left, right, assume_unique=True))
                    if _linked(overlap, len(left) + len(right), percent):
                        found.append((a, b))
            columns = list(zip(*found)) if found else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    return verify


def _incidence(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the overlaps of all rows with all columns, as products of 0/1 tiles."""
    result = np.zeros((len(rows), len(columns)), np.float32)
    left, right = np.concatenate(rows), np.concatenate(columns)
    shared = np.intersect1d(left, right)
    owners = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), v) for s, v in ((rows, left), (columns, right))]
    tiles = []
    for owner, values in owners:
        place = np.searchsorted(shared, values)
        place[place == len(shared)] = 0
        known = shared[place] == values if len(shared) else np.zeros(len(values), bool)
        tiles.append((owner[known], place[known]))
    step = 4096
    for at in range(0, len(shared), step):
        sides = []
        for (owner, place), size in zip(tiles, (len(rows), len(columns))):
            inside = (place >= at) & (place < at + step)
            dense = np.zeros((size, min(step, len(shared) - at)), np.float32)
            dense[owner[inside], place[inside] - at] = 1
            sides.append(dense)
        result += sides[0] @ sides[1].T
    return result


def _block(width: int, percent: int):
    """Links of one block: nodes of chunk i against nodes of chunk j, under one shingle."""

    def links(table: pa.Table) -> pa.Table:
        # The text of a node may have been read by several tasks.
        columns = ["side", "node", "root", "asked", "prefix", "text"]
        rows = list({(r["side"], r["node"]): r for r in table.select(columns).to_pylist()}.values())
        token = table.column("token")[0].as_py()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        rows.sort(key=lambda r: r["node"])
        first = [r for r in rows if r["side"] == 0]
        second = first if same else [r for r in rows if r["side"] == 1]
        found: list[tuple[bytes, bytes]] = []
        if first and second:
            heads = [[np.frombuffer(r["prefix"], np.int64) for r in side] for side in (first, second)]
            # Shingles in front of this one in the common order, of either prefix.
            before = [[h[: int(np.flatnonzero(h == token)[0])] for h in side] for side in heads]
            asked = np.minimum.outer(*[np.array([r["asked"] for r in side]) for side in (first, second)])
            roots = {r["root"]: i for i, r in enumerate(rows)}
            apart = np.not_equal.outer(*[np.array([roots[r["root"]] for r in side]) for side in (first, second)])
            candidates = apart & (_incidence(*before) == 0) & (_incidence(*heads) >= asked)
            if same:
                candidates = np.triu(candidates, 1)
            if candidates.any():
                sets = [[shingle_set(r["text"], width) for r in side] for side in (first, second)]
                sizes = np.add.outer(*[np.array([len(s) for s in side]) for side in sets])
                found = _forest(candidates & _linked(_incidence(*sets), sizes, percent), first, second)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return links


def _forest(linked: np.ndarray, first: list[dict], second: list[dict]) -> list[tuple[bytes, bytes]]:
    """As many of the links as connect what all of them connect."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    kept = []
    for i, j in np.argwhere(linked):
        a, b = first[i]["node"], second[j]["node"]
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return kept


def _with_nodes(width: int):
    """(``k``, ``node``, ``text``), each node once a task."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, nodes, texts = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width)
                node = set_digest(shingles)
                if len(shingles) and node not in seen:
                    seen.add(node)
                    keys.append(_key(node))
                    nodes.append(node)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(nodes, pa.binary()), pa.array(texts, pa.string())], names=["k", "node", "text"]
            )

    return fetch


def _texts_of(keys: DataFrame, members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(``k``, ``node``, ``text``) of the nodes with these keys, read again from one document of each.

    Documents with one id and several texts bring more nodes than were asked for.
    """
    chosen = members.join(keys, "k", "left_semi").groupBy("node").agg(F.min("id").alias("wanted_id"))
    ids = written(chosen.select("wanted_id").distinct(), "wanted")
    if ids.count() <= SENT_NODES:
        ids = F.broadcast(ids)
    read = texts.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    return written(read.select("text").mapInArrow(_with_nodes(width), "k bigint, node binary, text string"), "texts")


def jaccard_roots(df: DataFrame, doc_id: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (``id``, ``k``, ``node``, ``n``) of all rows, and (``node``, ``root``) of all nodes that have links.

    Nodes that are connected by pairs at the similarity have one root; in blocks of long
    lists, pairs that other links connect already may be left out.
    """
    spark: SparkSession = df.sparkSession
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    keys, counts, bits = common_shingles(texts.select("text"), width)
    # At most COMMON_KEPT keys and counts: 16 MB.
    common = spark.sparkContext.broadcast((keys, counts))
    ddl = "id bigint, k bigint, node binary, n bigint, asked int, short array<bigint>, long array<bigint>, parity binary"
    signed = written(texts.mapInArrow(_signatures(width, percent, common, bits), ddl), "signed")
    members = signed.select("id", "k", "node", "n")
    # A node that several tasks met comes several times, and equal.
    nodes = signed.filter(F.col("asked").isNotNull())

    def both(high: str | Column, low: str | Column) -> Column:
        high, low = (F.col(c) if isinstance(c, str) else c for c in (high, low))
        return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))

    postings = nodes.select("k", "n", both("asked", F.size("long")).alias("q"), F.posexplode("short").alias("at", "token"))
    lists = (
        postings.select("token", F.struct("k", both("n", "at").alias("p"), "q").alias("m"))
        .groupBy("token")
        .agg(F.collect_set("m").alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
    )
    met = (
        lists.mapInArrow(_pairs(percent), "a bigint, b bigint, asked int, a_left int, b_left int, sizes int")
        .groupBy("a", "b")
        .agg(
            F.count("*").alias("shared"),
            F.min("asked").alias("asked"),
            F.min("a_left").alias("a_left"),
            F.min("b_left").alias("b_left"),
            F.min("sizes").alias("sizes"),
        )
    )
    # Shingles in front of the last one shared, but for those shared, are in one set only: both have one order.
    most = F.col("shared") + F.least("a_left", "b_left") - 1
    possible = most * (100 + percent) >= F.col("sizes") * percent
    met = written(met.filter((F.col("shared") >= F.col("asked")) & possible).select("a", "b"), "met")
    # Most pairs met are far apart, which their parities show: the texts of the others alone are read and sent.
    sizes = nodes.select("k", "n", "parity").distinct()
    for side in ("a", "b"):
        met = met.join(sizes.select(F.col("k").alias(side), F.col("n").alias(f"{side}_n"), F.col("parity").alias(f"{side}_parity")), side)
    pairs = written(met.mapInArrow(_near(percent), "a bigint, b bigint"), "pairs")

    listed = nodes.filter(F.size("long") > 0).dropDuplicates(["node"]).withColumn("prefix", F.concat("short", "long"))
    listed = listed.select("k", "node", "n", "asked", "prefix", F.posexplode("long").alias("rank", "token"))
    listed = written(listed.mapInArrow(_packed_prefix, _POSTING_DDL), "listed")

    ends = pairs.select(F.explode(F.array("a", "b")).alias("k"))
    read = _texts_of(ends.unionByName(listed.select("k")).distinct(), members, texts, width)

    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("k"))
    candidates = sides.join(read.select("k", "text"), "k").groupBy("a", "b").agg(F.collect_list("text").alias("texts"))
    links = written(candidates.select("texts").mapInArrow(_verify(width, percent), "a binary, b binary"), "links")

    # First every node under the first of its long lists, which joins most of what belongs together; then the
    # lists whose nodes are not all in one component yet.
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    for postings in (listed.filter(F.col("rank") == 0), listed):
        rooted = postings.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = _in_blocks(rooted, read, width, percent)
        # What was found hangs on roots already: where blocks add nothing, that is all.
        if more is not None:
            hung = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
            found = components(hung.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    return members, found


def _in_blocks(postings: DataFrame, read: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links between nodes of different roots under each shingle, found block by block; None if there are none."""
    sizes = postings.groupBy("token").agg(
        F.count("*").alias("nodes"), F.sum("n").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    chunks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    busy = written(sizes.filter(F.col("low") != F.col("high")).select("token", chunks.alias("chunks")), "lists")
    if busy.isEmpty():
        return None
    # Every chunk meets every chunk of its list once: side 0 of blocks to the right, side 1 of those to the left.
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    right = F.transform(F.sequence(F.col("c"), F.col("chunks") - 1), lambda j: F.struct(F.lit(0).alias("side"), F.col("c").alias("i"), j.alias("j")))
    left = F.transform(F.sequence(F.lit(0), F.col("c")), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), F.col("c").alias("j")))
    places = F.concat(right, F.filter(left, lambda b: b["i"] != b["j"]))
    placed = postings.join(busy, "token").withColumn("c", chunk)
    placed = placed.select("token", "node", "root", "asked", "prefix", F.explode(places).alias("b"))
    blocks = placed.join(read.select("node", "text"), "node").select(
        "token", "b.side", "b.i", "b.j", "node", "root", "asked", "prefix", "text"
    )
    links = written(blocks.groupBy("token", "i", "j").applyInArrow(_block(width, percent), "a binary, b binary"), "links")
    return None if links.isEmpty() else links


_POSTING_DDL = "k bigint, node binary, n bigint, asked int, prefix binary, rank int, token bigint"


def _packed_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([np.array(p, np.int64).tobytes() for p in batch.column("prefix").to_pylist()], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("prefix"), "prefix", packed)


def jaccard_groups(df: DataFrame, doc_id: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``doc_id`` (under its own name), ``n_shingles``, ``component_id``.

    Two documents link when the share of common shingles (runs of ``width`` words split at
    ASCII white space, A-Z lowered) in all of their shingles is ``percent`` or more;
    ``component_id`` is the smallest id reachable over links. A text with fewer words is one
    shingle; without words, or null, it has none, links with nothing, and is its own
    component. Equal sets always link. Null ids take part; a component of null ids alone has
    a null ``component_id``. Rows that repeat an id stay rows of their own. An empty table gives
    an empty result. Other columns are not used.
    """
    members, roots = jaccard_roots(df, doc_id, text, width, percent)
    own = written(members.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least")), "least")
    joined = own.join(roots, "node").select("node", "root", "least")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
    grouped = joined.select("node", "root").join(smallest, "root").select("node", "component")
    # A node without links is a component of its own.
    labels = written(
        own.join(grouped, "node", "left").select(
            F.col("node").alias("of"), F.coalesce("component", "least").alias("component")
        ),
        "labels",
    )
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return members.join(labels, F.col("node") == F.col("of"), "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id")
    )
