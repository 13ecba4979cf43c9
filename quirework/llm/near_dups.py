"""Near-duplicate documents by MinHash, banding, exact confirmation and connected components.

Plan: each text becomes the set of hashes of its 5-word shingles and 160 universal
hash minima, of which 40 bands of 4 rows make bucket ids. Equal sets collapse into one class first.
In each bucket every class is compared with one centre only, the class that shares most
buckets; components of the confirmed links then settle most buckets. Classes of the buckets that still
hold several components form clusters. Within a cluster the members of its largest component need no comparison with each other,
so only the others are compared, among themselves and with that component, in blocks of bounded size, where the sizes of all
intersections are matrix products and only a spanning forest of the links leaves the task. A cluster of more than a block is first
parted by its rarest shingles: two sets at the threshold share one of the quarter of their shingles that are
rarest in the cluster, so documents that only have a frequent template in common are never compared. No link that joins
components is lost by any of this, and no pairs are written out.
A pair at the threshold shares no bucket with probability (1 - 0.75**4)**40 = 2.5e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from ..functions.scratch import Scratch
from .textops import begin, chunks, mix64, release, shingles_of, words_of

SHINGLE_WORDS = 5
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
#: Members and shingles in a block, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Ids of documents to be compared are broadcast up to this many (16 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000

_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_A = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def _minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (_A[:, None] * x[None, i : i + 1024] + _B[:, None]).min(axis=1), out=least)
    return least


def _band_ids(minima: np.ndarray) -> np.ndarray:
    m = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), m.shape[:2])
    for r in range(ROWS):
        h = mix64(h ^ m[:, :, r])
    return h.view(np.int64)


def _sketch(batches):
    """Set size, 128-bit set hash, bucket ids and low bytes of the minima of each text."""
    begin("near-dups")
    for batch in batches:
        ids, seqs, texts = batch.column(0), batch.column(1), batch.column(2)
        for i, j, data, offsets in chunks(texts):
            words = words_of(data, offsets, lower=True)
            hashes, at = shingles_of(words, SHINGLE_WORDS)
            n = j - i
            size, key1, key2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            minima = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
            for k in range(n):
                own = np.unique(hashes[at[k] : at[k + 1]])
                if len(own):
                    size[k], key1[k], key2[k] = len(own), own.sum(), mix64(own + np.uint64(77)).sum()
                    minima[k] = _minima(own)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, n),
                    seqs.slice(i, n),
                    pa.array(size),
                    pa.array(key1.view(np.int64)),
                    pa.array(key2.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(_band_ids(minima).ravel()), BANDS).cast(pa.list_(pa.int64())),
                    pa.array([m.tobytes() for m in minima.astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "seq", "n_shingles", "key1", "key2", "bands", "sig"],
            )
    release()


_SKETCH = "doc_id long, seq long, n_shingles long, key1 long, key2 long, bands array<long>, sig binary"


def _sets(batches):
    """The distinct shingle hashes of each text, sorted, as bytes."""
    begin("near-dups")
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column(1)):
            hashes, at = shingles_of(words_of(data, offsets, lower=True), SHINGLE_WORDS)
            sets = [np.unique(hashes[at[k] : at[k + 1]]).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["node", "shingles"])
    release()


def _read(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def signature_floor(threshold: float) -> int:
    """Agreeing minima below which a pair at the threshold comes up once in about 10**9."""
    return int(HASHES * (threshold - 6 * (threshold * (1 - threshold) / HASHES) ** 0.5))


def _agreeing(floor: int):
    @F.pandas_udf(T.BooleanType())
    def agree(a, b):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, HASHES)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, HASHES)
        return pd.Series((x == y).sum(axis=1) >= floor)

    return agree


def _confirm(percent: int):
    """Keeps pairs whose full shingle sets reach the threshold."""

    def run(batches):
        begin("near-dups")
        for batch in batches:
            keep = []
            for a, b in zip(_read(batch.column(2)), _read(batch.column(3))):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


def _tokens(batches):
    """Each shingle of each set in a row."""
    begin("near-dups")
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            sets = _read(batch.column(2).slice(i, 64))
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]) + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(sets).view(np.int64))], ["cluster", "node", "shingle"])
    release()


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for k, own in enumerate(sets):
        at = np.searchsorted(columns, own)
        inside = at < len(columns)
        at, own = at[inside], own[inside]
        out[k, at[columns[at] == own]] = 1
    return out


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by products of incidence matrices a few thousand columns at a time."""
    shared = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    if x is y:
        values, times = np.unique(np.concatenate(x), return_counts=True)
        shared = values[times > 1]
    total = np.zeros((len(x), len(y)), np.float32)
    for i in range(0, len(shared), 4096):
        part = shared[i : i + 4096]
        left = _incidence(x, part)
        total += left @ (left if x is y else _incidence(y, part)).T
    return total


def _block_links(percent: int):
    """Links between components within a pair of blocks, as a spanning forest of the components that they join."""

    def run(table):
        begin("near-dups")
        table = table.combine_chunks()
        side, nodes, comps = (table.column(c).to_numpy() for c in ("side", "node", "comp"))
        sets = _read(table.column("shingles").combine_chunks())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        u, v = [], []
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        if len(left) and len(np.unique(comps)) > 1:
            x = [sets[k] for k in left]
            y = x if right is left else [sets[k] for k in right]
            both = overlaps(x, y)
            total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
            for a, b in zip(*np.nonzero((100 * both >= percent * total) & (comps[left][:, None] != comps[right][None, :]))):
                a, b = left[a], right[b]
                p, q = root(int(comps[a])), root(int(comps[b]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    u.append(int(nodes[a]))
                    v.append(int(nodes[b]))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _parted(cluster: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Clusters of more than a block (cluster, node, comp, n_shingles) cut into parts that no link at the threshold leaves.

    Shingles are ordered by how many of the cluster's sets hold them. A set's first size - ceil(percent / 100 * size) + 1 ones make its prefix; two sets at the
    threshold have a shingle in both prefixes. So sets that are joined by shared prefix shingles stay together; shingles of one set only need no row.
    """
    large = scratch.save(cluster.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("cluster"))
    if large.isEmpty():
        return cluster
    own = cluster.join(large, "cluster", "left_semi")
    tokens = scratch.save(own.join(sets, "node").select("cluster", "node", "shingles").mapInArrow(_tokens, "cluster long, node long, shingle long"))
    # Saved, not a bare aggregate: a join of a shingle that a whole cluster holds can be split then.
    often = scratch.save(tokens.groupBy("cluster", "shingle").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = tokens.join(often, ["cluster", "shingle"])
    # Bounded by a set's own shingles.
    held = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    size = F.col("n_shingles")
    alone = size - F.size("held")
    prefix = F.greatest(size - F.ceil(size * percent / 100) + 1 - alone, F.lit(0)).cast("int")
    first = scratch.save(own.join(held, "node").select("cluster", "node", F.explode(F.slice("held", F.lit(1), prefix)).alias("h")).select("cluster", "node", "h.shingle"))
    hubs = scratch.save(first.groupBy("cluster", "shingle").agg(F.min("node").alias("hub")))
    parts = components(first.join(hubs, ["cluster", "shingle"]).select(F.col("node").alias("u"), F.col("hub").alias("v")), scratch)
    parts = own.join(parts.select(F.col("id").alias("node"), "component_id"), "node").select(F.col("component_id").alias("cluster"), "node", "comp", "n_shingles")
    out = scratch.save(cluster.join(large, "cluster", "left_anti").select("cluster", "node", "comp", "n_shingles").union(parts))
    scratch.drop(tokens, often, first, hubs)
    return out


def _blocks(cluster: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of clusters (cluster, node, comp, n_shingles) dealt into pairs of blocks: cluster, p, q, side, node, comp.

    The members outside the largest component are compared with each other (p <= q) and with those in it (q under 0).
    """
    sizes = cluster.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t"))
    of = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"))
    sizes = sizes.join(of, "cluster").groupBy("cluster", "main").agg(*[F.sum(F.when((F.col("comp") == F.col("main")) == inside, F.col(c))).alias(f"{c}{int(inside)}") for c in "nt" for inside in (False, True)])
    number = lambda k: F.greatest(F.ceil(F.col(f"n{k}") / BLOCK), F.ceil(F.col(f"t{k}") / BLOCK_SHINGLES)).cast("int")
    sizes = scratch.save(sizes.filter("n0 > 0").select("cluster", "main", number(0).alias("outer"), number(1).alias("inner")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = cluster.join(sizes, "cluster").withColumn("h", F.xxhash64("node"))
    other, main = own.filter("comp <> main").withColumn("k", F.pmod("h", "outer").cast("int")), own.filter("comp = main").withColumn("k", F.pmod("h", "inner").cast("int"))
    among = other.select("*", each("outer").alias("j")).select("cluster", F.least("k", "j").alias("p"), F.greatest("k", "j").alias("q"), (F.col("k") > F.col("j")).cast("int").alias("side"), "node", "comp")
    across = other.select("*", each("inner").alias("j")).select("cluster", F.col("k").alias("p"), (-1 - F.col("j")).alias("q"), F.lit(0).alias("side"), "node", "comp")
    within = main.select("*", each("outer").alias("j")).select("cluster", F.col("j").alias("p"), (-1 - F.col("k")).alias("q"), F.lit(1).alias("side"), "node", "comp")
    return among.union(across).union(within)


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and seq (xxhash64 of the text).

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a document's set is its
    distinct 5-word shingles, or its whole word sequence if that is shorter. Two documents are linked
    if 100 * intersection >= percent * union. Nulls, empty texts and texts of white space have an empty
    set, link with nothing, and are kept. A row is a document: rows that share an id but differ in text are linked each by its own text, repeated rows have repeated results.
    component_id is the smallest id of a row reachable. A row without an id takes part in nothing: component_id is null and kept is true.
    A text of any length is read whole, in time that grows with its length. Extra columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dups")
    floor = signature_floor(percent / 100)
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("seq"), text.alias("text"))
    sketch = scratch.save(own.mapInArrow(_sketch, _SKETCH))
    filled = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class's node is the smallest id of its rows; where texts that differ share that id, a hash.
    classes = scratch.save(filled.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "seq", "n_shingles", "bands", "sig")).alias("m")).select("key1", "key2", F.col("m.doc_id").alias("rep"), "m.seq", "m.n_shingles", "m.bands", "m.sig"))
    twice = scratch.save(classes.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep", F.lit(True).alias("twice")))
    unique = twice.isEmpty()
    if unique:
        classes = classes.withColumn("node", F.col("rep"))
    else:
        classes = scratch.save(classes.join(twice, "rep", "left").withColumn("node", F.when(F.col("twice"), F.xxhash64("rep", "seq")).otherwise(F.col("rep"))).drop("twice"))

    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = scratch.save(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = scratch.save(buckets.join(shared, "bucket"))
    sigs = scratch.save(classes.select("node", "sig").join(members.select("node").distinct(), "node", "left_semi"))
    weight = members.groupBy("node").agg(F.sum("n").alias("w"))
    centres = scratch.save(members.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("centre")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node, shingles of the classes in ``nodes``, each from the text that stands for it."""
        ids = scratch.save(classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id"), "seq", "node"))
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = own.join(few, ["doc_id", "seq"]).dropDuplicates(["node"]).select("node", "text")
        out = scratch.save(texts.mapInArrow(_sets, "node long, shingles binary"))
        scratch.drop(ids)
        return out

    def confirmed(pairs: DataFrame) -> DataFrame:
        agree = _agreeing(floor)
        near = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("sig_u")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sig_v")), "v")
        near = scratch.save(near.filter(agree("sig_u", "sig_v")).select("u", "v"))
        sets = sets_of(near.select(F.col("u").alias("node")).union(near.select("v")).distinct())
        full = near.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v")), "v")
        links = scratch.save(full.select("u", "v", "set_u", "set_v").mapInArrow(_confirm(percent), "u long, v long"))
        scratch.drop(sets, near)
        return links

    pairs = members.join(centres, "bucket").select(F.least("centre", "node").alias("u"), F.greatest("centre", "node").alias("v")).filter("u <> v").distinct()
    links = confirmed(scratch.save(pairs))
    found = components(links, scratch)

    rest = members.join(centres, "bucket").filter("node <> centre").select("bucket", "node")
    rest = scratch.save(rest.join(found.select(F.col("id").alias("node"), F.col("component_id").alias("comp")), "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")))
    mixed = scratch.save(rest.groupBy("bucket").agg(F.min("node").alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket", "hub"))
    if not mixed.isEmpty():
        # Classes that meet in unsettled buckets form a cluster; its members are compared across components.
        meet = components(rest.join(mixed, "bucket").select(F.col("node").alias("u"), F.col("hub").alias("v")), scratch)
        known = found.select(F.col("id").alias("k"), F.col("component_id").alias("comp"))
        cluster = meet.join(known, F.col("id") == F.col("k"), "left").select(F.col("id").alias("node"), F.col("component_id").alias("cluster"), F.coalesce("comp", "id").alias("comp"))
        cluster = scratch.save(cluster.join(classes.select("node", "n_shingles"), "node"))
        sets = sets_of(cluster.select("node"))
        placed = _blocks(_parted(cluster, sets, percent, scratch), scratch)
        grouped = placed.join(sets, "node").select("cluster", "p", "q", "side", "node", "comp", "shingles").groupBy("cluster", "p", "q")
        links = links.union(scratch.save(grouped.applyInArrow(_block_links(percent), "u long, v long")))
        scratch.drop(sets)
        found = components(links, scratch)
    scratch.drop(rest, mixed, sigs, members, centres, shared)

    # The smallest id of each component.
    label = classes.select("key1", "key2", "node", "rep").join(found.select(F.col("id").alias("node"), F.col("component_id").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    if not unique:
        label = label.join(label.groupBy("c").agg(F.min("rep").alias("least")), "c").withColumn("c", F.col("least"))
    named = scratch.save(label.select("key1", "key2", F.col("c").alias("component_id")))
    without = F.expr("n_shingles = 0 OR doc_id IS NULL")
    rows = sketch.select("doc_id", "seq", "n_shingles", "key1", "key2")
    out = rows.filter(~without).join(named, ["key1", "key2"]).select("doc_id", "n_shingles", "component_id", "seq")
    out = out.union(rows.filter(without).select("doc_id", "n_shingles", F.col("doc_id"), "seq"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "seq")
