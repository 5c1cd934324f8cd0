"""N-gram Jaccard join with signature trees.

Two documents link when their sets of word shingles overlap by at least ``percent`` of their union.

1. Every text becomes a set of hashed shingles. Equal sets form one class, of which the smallest
   doc_id goes on.
2. Each class is put into blocks that any linked partner shares. For two linked sets, the smaller of
   size n, at most d = n * (100 - percent) / percent hashes are in one set only. So when the hashes
   are dealt into more than d segments, linked sets have segments in common; a block is one segment
   with all its hashes. Sizes come in levels, each with its own number of segments, and a set also
   goes to the level below if a smaller partner may be there. Of small sets, up to TINY_SIZE with d up to
   TINY_LOSS, single segments would say too little: their blocks are all choices of d segments to leave out.
3. In a first pass each document of a block is compared with one pivot, which joins groups of near
   copies at once; blocks that still hold several components do so once more with another pivot.
4. In a second pass the blocks that still hold several components are the roots of signature trees.
   At the bottom stand leaves: documents of one component that share their smallest hashes. Leaves
   of like size hang together under inner nodes, these under further ones, at most FAN to a node.
   Every node carries the OR-combined bitmap of its hashes, its range of sizes and of components.
   Two trees are walked from the top, level by level: a pair of nodes, of leaves, of documents is
   dropped as soon as bitmaps and sizes leave too small a maximum overlap, and a pair of leaves with
   several roots in common is walked under the first one only.
   A block of more than FAN leaves (a passage that many documents share) is no root. Its documents
   go under their rarest hashes instead: a set of size n that has at least percent of n in common
   with a partner shares one of its n * (100 - percent) / 100 + 1 rarest hashes, and of the
   partner's. A common passage is not among the rarest, so documents that share no more do not meet. As
   documents of one component need not meet, hashes of one component only count as its rarest.
5. Pairs that remain are decided on their whole sets. Documents of one component need no further
   comparing, so a group of copies costs its size and not its square.

Small sets lose no pair: the choice that leaves out the segments with a difference is among those both
sides write. Of a larger set's segments at most MAX_SEGMENTS are written, and empty ones never. A linked
pair has each in common with a probability over a third, whatever the texts, since hashes are dealt
at random; ``miss`` gives the chance that it shares none, below 1e-11 for every size from 80 percent on, of
the order of two texts having one fingerprint.
"""

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import ascii_lower, let, words
from newsloom.llm.components import components
from newsloom.scratch import settle

MAX_SEGMENTS = 64
SPARE_SEGMENTS = 8
TINY_SIZE, TINY_LOSS = 51, 12
TINY_KEPT = 2
LEVEL_RATIO = 1.5
PIVOT_ORDERS = 4
BITMAP_LONGS = 16
LEAF_HASHES = 24
FAN = 32
CLASS_RATIO = 1.1

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: Column, size: int) -> Column:
    """The set of hashed shingles, sorted: of ``size`` words, or all words where there are fewer;
    empty for a text without words."""
    def hashed(ws: Column) -> Column:
        slid = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (size - 1), F.lit(0))),
                           lambda _, i: F.xxhash64(F.slice(ws, i + 1, size)))
        whole = F.when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(
            F.array().cast("array<bigint>"))
        return F.when(F.size(ws) >= size, slid).otherwise(whole)

    return F.sort_array(F.array_distinct(let(words(ascii_lower(text)), hashed)))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def loss(size: int, percent: int) -> int:
    """How many hashes two linked sets can have in one of them only, the smaller being of this size."""
    return size * (100 - percent) // percent


def tiny(percent: int) -> int:
    """The largest size up to TINY_SIZE with a loss of at most TINY_LOSS."""
    return min(TINY_SIZE, ((TINY_LOSS + 1) * percent - 1) // (100 - percent))


def levels(percent: int) -> list[tuple[int, int]]:
    """(smallest size, number of segments) of each level, up to sets of some billion hashes."""
    out, low = [], tiny(percent) + 1
    while low < 2**32:
        high = int(np.ceil(low * LEVEL_RATIO))
        out.append((low, loss(high - 1, percent) + 1 + SPARE_SEGMENTS))
        low = high
    return out


def miss(size: int, percent: int) -> float:
    """The chance that two linked sets, the smaller of this size, share no block: all they have in
    common then lies in segments in which they also differ, or that are not written."""
    if size <= tiny(percent):
        return 0.0
    n = next(n for low, n in reversed(levels(percent)) if low <= size)
    differ, common = loss(size, percent), size - loss(size, percent)
    if n > MAX_SEGMENTS:
        shared = (1 - 1 / n) ** differ * (1 - (1 - 1 / n) ** common)
        return (1 - shared) ** MAX_SEGMENTS
    # hit[k]: the chance that the differing hashes lie in just k segments.
    k, hit = np.arange(n + 1), np.zeros(n + 1)
    hit[0] = 1.0
    for _ in range(differ):
        hit = hit * k / n + np.concatenate(([0.0], (hit * (n - k) / n)[:-1]))
    return float((hit * (k / n) ** common).sum())


@cache
def _kept(lost: int) -> np.ndarray:
    return np.array(list(combinations(range(lost + TINY_KEPT), TINY_KEPT)))


def _choices(values: np.ndarray, lost: int) -> np.ndarray:
    """Keys of a small set: its hashes in all but ``lost`` segments, for every choice of these."""
    n = lost + TINY_KEPT
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, (_mix(values, 10 + lost) % np.uint64(n)).astype(np.int64), _mix(values, 2))
    placed = _mix(sums ^ _mix(np.arange(n, dtype=np.uint64), 20 + lost), 7)
    return _mix(placed[_kept(lost)].sum(axis=1), 8)


def block_keys(values: np.ndarray, sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The block keys of each set; ``values`` holds all sets' hashes one after another."""
    known = levels(percent)
    lows = np.array([low for low, _ in known])
    level = np.searchsorted(lows, sizes, side="right") - 1
    partner = (sizes * percent + 99) // 100
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows, keys = [], []

    def write(at: int, chosen: np.ndarray) -> None:
        n = known[at][1]
        mine = chosen[owner]
        segment = _mix(values[mine], 1) % np.uint64(n)
        kept = segment < MAX_SEGMENTS
        slot = owner[mine][kept] * MAX_SEGMENTS + segment[kept].astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
        if not len(first):
            return
        sums = np.add.reduceat(_mix(values[mine][kept][order], 2), first)
        slot = slot[first]
        place = (np.uint64(at) << np.uint64(8)) + (slot % MAX_SEGMENTS).astype(np.uint64)
        rows.append(slot // MAX_SEGMENTS)
        keys.append(_mix(sums ^ _mix(place, 3), 4))

    for at in np.unique(level[level >= 0]):
        write(at, level == at)
        below = (level == at) & (partner < lows[at])
        if at > 0 and below.any():
            write(at - 1, below)
    starts = np.cumsum(sizes) - sizes
    for i in np.flatnonzero((sizes > 0) & (partner <= tiny(percent))):
        n = min(int(sizes[i]), tiny(percent))
        for lost in range(max(1, loss(int(partner[i]), percent)), loss(n, percent) + 1):
            found = _choices(values[starts[i]:starts[i] + sizes[i]], lost)
            rows.append(np.full(len(found), i))
            keys.append(found)
    if not rows:
        return [np.zeros(0, np.int64)] * len(sizes)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    cut = np.searchsorted(rows[order], np.arange(1, len(sizes)))
    return np.split(keys[order].view(np.int64), cut)


def bitmaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of BITMAP_LONGS signed longs for each set."""
    bits = np.zeros((len(sizes), BITMAP_LONGS * 64), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bits[owner, (_mix(values, 6) % np.uint64(BITMAP_LONGS * 64)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def _signer(percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column("doc_id"), batch.column("hashes")
            sizes = np.diff(sets.offsets.to_numpy())
            values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            keys = block_keys(values, sizes, percent)
            bits = bitmaps(values, sizes)
            low = [int(_mix(values[at:at + min(n, LEAF_HASHES)], 9).sum().view(np.int64))
                   for at, n in zip(np.cumsum(sizes) - sizes, sizes)]
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("n"), batch.column("f1"), batch.column("f2"),
                 *(pa.array(bits[:, j]) for j in range(BITMAP_LONGS)), pa.array(low, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n", "f1", "f2", *BITS, "leaf", "keys"])

    return sign


BITS = [f"b{j}" for j in range(BITMAP_LONGS)]
SIGNED = ("doc_id long, n int, f1 long, f2 long, "
          + ", ".join(f"{b} long" for b in BITS) + ", leaf long, keys array<long>")


def _set_bits(columns: list[Column]) -> Column:
    return sum((F.bit_count(c) for c in columns[1:]), F.bit_count(columns[0]))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two nodes (or documents) may hold a linked pair. A node has the OR of its sets'
    bitmaps, its smallest size, largest size and largest number of hashes that share a bit. Of a
    set's hashes at most those shared bits, and one for each bit both sides have, are in common."""
    c = lambda name: (F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    common = _set_bits([x.bitwiseAND(y) for x, y in map(c, BITS)])
    sizes = percent * sum(c("fewest")[1:], c("fewest")[0])
    # Overlap over union is at least percent when (100 + percent) * overlap >= percent * both sizes.
    # The bitmaps stand in the condition once: it runs for every pair of nodes under a root.
    return ((100 + percent) * F.least(*c("most")) >= sizes) & (
        (100 + percent) * (common + F.least(*c("spare"))) >= sizes)


NODE = (*BITS, "fewest", "most", "spare", "lo", "hi")


def _nodes(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *(F.bit_or(x).alias(x) for x in BITS), F.min("fewest").alias("fewest"),
        F.max("most").alias("most"), F.max("spare").alias("spare"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _apart(a: str, b: str) -> Column:
    """Whether two nodes hold more than one and the same component."""
    return F.least(f"{a}.lo", f"{b}.lo") < F.greatest(f"{a}.hi", f"{b}.hi")


def _node_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, ca, cb): pairs of the nodes (key, c and what a node carries) under one root that may hold
    a linked pair, ca <= cb. Nodes are joined under pairs of their parents, up to levels of FAN."""
    nodes = settle(nodes)
    wanted = (F.col("a.c") <= F.col("b.c")) & _apart("a", "b") & _may_link("a", "b", percent)
    found = ["a.key", F.col("a.c").alias("ca"), F.col("b.c").alias("cb")]
    if nodes.groupBy("key").count().where(F.col("count") > FAN).isEmpty():
        return nodes.alias("a").join(nodes.alias("b"), (F.col("a.key") == F.col("b.key")) & wanted).select(*found)
    nodes = nodes.withColumn("up", F.expr(f"c div {FAN}"))
    above = settle(_node_pairs(_nodes(nodes.drop("c"), "key", "up").withColumnRenamed("up", "c"), percent))
    return above.alias("p").join(
        nodes.alias("a"), F.expr("a.key = p.key AND a.up = p.ca")).join(
        nodes.alias("b"), F.expr("b.key = p.key AND b.up = p.cb") & wanted).select(*found)


def _leaf_pairs(under: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaves (la, fa, lb, fb, node: the second one's) of two components that may hold a linked
    pair, each once. ``under`` has a row for each root and leaf: key, label, leaf and what a node carries."""
    under = settle(under.withColumn("class", F.floor(F.log(F.col("fewest").cast("double")) / float(np.log(CLASS_RATIO)))))
    # Where a root has many leaves they hang in order of size class, FAN to a node or a few more.
    classes = under.groupBy("key", "class").agg(F.count("*").alias("m"))
    of_root = Window.partitionBy("key")
    before = of_root.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of a root in this window: one for each class of sizes.
    places = settle(classes.withColumn("all", F.sum("m").over(of_root)).where(F.col("all") > FAN).withColumn(
        "parts", F.ceil(F.col("m") / FAN)).withColumn(
        "first", F.coalesce(F.sum("parts").over(before), F.lit(0))).select("key", "class", "first", "parts"))
    placed = settle(under.join(places, ["key", "class"], "left").withColumn(
        "c", F.coalesce(F.col("first") + F.pmod("leaf", "parts"), F.lit(0))).drop("class", "first", "parts"))
    wide = placed.join(places.select("key").distinct(), "key", "left_semi")
    steps = settle(_node_pairs(_nodes(wide, "key", "c"), percent).union(
        placed.join(places.select("key").distinct(), "key", "left_anti").select(
            "key", F.lit(0).cast("long"), F.lit(0).cast("long")).distinct()))
    # A pair of leaves meets under the first of the roots it has in common.
    roots = settle(under.groupBy("label", "leaf").agg(F.sort_array(F.collect_set("key")).alias("roots")))
    placed = settle(placed.join(roots, ["label", "leaf"]))
    same = F.array_min(F.array_intersect("a.roots", "b.roots")) == F.col("a.key")
    turn = (F.col("a.c") < F.col("b.c")) | (F.col("a.label") < F.col("b.label"))
    return steps.alias("p").join(placed.alias("a"), F.expr("a.key = p.key AND a.c = p.ca")).join(
        placed.alias("b"), F.expr("b.key = p.key AND b.c = p.cb AND a.label <> b.label") & turn
        & _may_link("a", "b", percent) & same).select(
        F.col("a.label").alias("la"), F.col("a.leaf").alias("fa"), F.col("b.label").alias("lb"),
        F.col("b.leaf").alias("fb"), F.struct(*(F.col(f"b.{x}") for x in NODE)).alias("node"))


def _by_rarest(ids: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, id): the documents of ``ids`` (id, label) by their rarest hashes among each other, as many as any
    linked partner must share one of. Hashes that one component has alone go before all others: they count as
    rarest, but nothing of another component is found by them, so they are left out."""
    sets = docs.join(ids, docs.doc_id == ids.id).select(
        F.col("doc_id").alias("id"), "label", shingles(F.col("text"), size).alias("hashes"))
    # A doc_id with several texts has several sets. The outer form keeps Spark from making a filter of the
    # explode, which would compute the shingles of all documents at the scan; a NULL meets nothing below.
    held = settle(sets.select("id", "label", F.xxhash64("hashes").alias("of"), F.size("hashes").alias("n"),
                              F.explode_outer("hashes").alias("hash")))
    between = settle(held.groupBy("hash").agg(
        F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(
        "lo < hi").select("hash", "m"))
    listed = held.join(between, "hash").groupBy("id", "of", "n").agg(
        F.sort_array(F.collect_set(F.struct("m", "hash"))).alias("rarest"))
    alone = "(n - size(rarest))"
    first = F.expr(f"slice(rarest, 1, greatest(0, cast(n * {100 - percent} div 100 as int) + 1 - {alone}))")
    return listed.select("id", F.explode(first).alias("r")).select(
        F.xxhash64("r.hash", F.lit("rarest")).alias("key"), "id").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are close enough."""
    pairs = settle(pairs)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = settle(docs.join(settle(wanted), "doc_id", "left_semi").select(
        F.col("doc_id").alias("id"), shingles(F.col("text"), size).alias("hashes")))
    one, two = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return settle(pairs.join(one, "a").join(two, "b").where(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))


def _decided(pairs: DataFrame, shape: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (id, pivot) that link, as (a, b)."""
    stars = settle(pairs.select(
        F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    seen = stars.alias("s").join(shape.alias("a"), F.col("a.id") == F.col("s.a")).join(
        shape.alias("b"), F.col("b.id") == F.col("s.b")).where(_may_link("a", "b", percent)).select(
        "s.a", "s.b")
    return _linked(seen, docs, size, percent)


def _open_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id and label of the blocks that hold more than one component."""
    placed = settle(blocks.select("key", "id").join(labels, "id", "left").withColumn(
        "label", F.coalesce("label", "id")))
    several = settle(placed.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
    return settle(placed.join(several, "key"))


def similar(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) per row of ``docs``
    (doc_id, text; other columns are ignored).

    A NULL text, or one without words, has the empty set and links with nothing, not even with
    another such text. Rows with the same doc_id are one node: each of them gets its own
    n_shingles, and the component of them all. No rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    sets = docs.select("doc_id", shingles(F.col("text"), size).alias("hashes")).select(
        "doc_id", "hashes", F.size("hashes").alias("n"), F.xxhash64("hashes").alias("f1"),
        F.xxhash64(F.lit(7), "hashes").alias("f2"))
    signed = settle(sets.mapInArrow(_signer(percent), SIGNED))
    members = signed.select("doc_id", "n", "f1", "f2")
    classes = settle(members.where("n > 0").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("rep")))

    heads = settle(signed.join(
        classes.select(F.col("rep").alias("doc_id"), "n", "f1", "f2"), ["doc_id", "n", "f1", "f2"],
        "left_semi").drop("f1", "f2"))
    shape = heads.select(
        F.col("doc_id").alias("id"), *BITS, F.col("n").alias("fewest"), F.col("n").alias("most"),
        (F.col("n") - _set_bits([F.col(x) for x in BITS])).alias("spare"), "leaf")
    entries = heads.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    # One of a few orders for each block: the blocks of one group have several pivots between them, and
    # a document of a group meets no more than that many, whatever the number of blocks they share.
    order = F.pmod("key", F.lit(PIVOT_ORDERS))
    roots = settle(entries.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("id", order), "id"))["id"].alias("pivot"), F.count("*").alias("m"),
    ).where("m > 1").drop("m"))
    blocks = settle(entries.join(roots, "key"))

    # First pass: each document of a block against the block's pivot. Then the blocks that still hold
    # several components against a pivot of their own, and there only documents of other components.
    links = _decided(blocks.where("id <> pivot").select("id", "pivot"), shape, docs, size, percent)
    labels = components(links)
    left = _open_blocks(blocks, labels)
    own = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key"), "id", "label")).alias("p")).select(
        "key", F.col("p.id").alias("pivot"), F.col("p.label").alias("of"))
    others = left.join(own, "key").where("label <> of").select("id", "pivot")
    links = settle(links.union(_decided(others, shape, docs, size, percent)))
    labels = components(links)

    # Second pass: trees with several components.
    left = _open_blocks(blocks, labels)
    wide = settle(left.join(shape.select("id", "leaf"), "id").groupBy("key").agg(
        F.approx_count_distinct(F.struct("label", "leaf")).alias("m")).where(F.col("m") > FAN).select("key"))
    rare = _by_rarest(settle(left.join(wide, "key", "left_semi").select("id", "label").distinct()), docs, size, percent)
    roots = left.join(wide, "key", "left_anti").select("key", "id").union(rare)
    inner = settle(_open_blocks(roots, labels).join(shape.select("id", "leaf"), "id"))
    hosts = settle(inner.select("id", "label").distinct().join(shape, "id").withColumns(
        {"lo": F.col("label"), "hi": F.col("label")}))
    leaves = settle(_nodes(hosts, "label", "leaf"))
    under = inner.select("key", "label", "leaf").distinct().join(leaves, ["label", "leaf"])
    pairs = settle(_leaf_pairs(under, percent))
    inside = lambda side, x, y: (
        (F.col(f"{side}.label") == F.col(f"p.{x}")) & (F.col(f"{side}.leaf") == F.col(f"p.{y}")))
    apart = pairs.alias("p").join(
        hosts.alias("a"), inside("a", "la", "fa") & _may_link("a", "p.node", percent)).join(
        hosts.alias("b"), inside("b", "lb", "fb") & _may_link("a", "b", percent)).select(
        F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    more = _linked(apart, docs, size, percent)
    # A doc_id with several texts is one node: it links the classes of them all.
    several = settle(members.groupBy("doc_id").agg(
        *(f(c).alias(f"{f.__name__}_{c}") for c in ("n", "f1", "f2") for f in (F.min, F.max))).where(
        "doc_id IS NOT NULL AND (min_n < max_n OR min_f1 < max_f1 OR min_f2 < max_f2)").select("doc_id"))
    own = members.join(several, "doc_id", "left_semi").join(classes, ["n", "f1", "f2"]).where(
        "doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.union(more).union(own))

    known = classes.join(labels, F.col("rep") == F.col("id"), "left").select(
        "n", "f1", "f2", F.coalesce("label", "rep").alias("component_id"))
    found = members.join(settle(known), ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
    # The node's component also for its rows without words.
    nodes = found.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min("component_id").alias("of_node"))
    return found.join(nodes, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("of_node", "component_id").alias("component_id"))
