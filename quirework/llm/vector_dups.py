"""Near-duplicate vectors by product quantisation.

A bounded sample gives coarse centroids and, for the residuals, a codebook for each of 16 subspaces. Every vector goes to the inverted list of its
nearest centroid, with a code of 16 bytes and the length of its quantisation error. A vector probes each list that can hold one near enough: members of a list lie
on their centroid's side of the plane half way to the vector's own centroid, so those are the lists whose plane is within reach. A reach of the distance that
the cosine allows would lose nothing, but takes in nearly all lists where vectors have no clusters; so the reach is measured: the least at which RECALL of the pairs
at the threshold are found, pairs planted around vectors that the centroids weren't fitted to and pairs in the sample, whatever the number of lists. Lists of many rows are cut again in the same way, by centroids fitted to a sample of their own
rows and a reach of their own, so cells stay small as the table grows. Distances to a cell's codes are sums of table entries (asymmetric), a candidate is what can be near enough given its
error, so the codes lose nothing, and the exact cosine in double precision decides. A pair counts once, in the list of the one whose list has the higher number.

Equal vectors are one class with a count. Cells and the queries that probe them are cut into blocks, so a task holds a bounded
number of rows; only link counts and a spanning forest leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from ..functions.scratch import Scratch
from .textops import begin, release

#: Vectors that the index is fitted to at most.
SAMPLE = 20_000
SUBSPACES, CODES = 16, 64
LIST_ROWS, MAX_LISTS = 128, 2048
#: Rows from which a list is cut into cells, and rows of it that the cells are fitted to, about.
SPLIT_ROWS, SPLIT_SAMPLE = 4096, 8192
MEMBER_BLOCK, QUERY_BLOCK = 1024, 4096
#: Rows of a list whose cells are found at once.
CELL_BLOCK = 16_384
#: Counts by cell are broadcast up to so many cells, and joined by a shuffle beyond.
BROADCAST_CELLS = 500_000
#: Rounding of a distance, at most.
SLACK = 1e-7
#: Part of the pairs at the threshold that the reach is to find, vectors it is measured on, and rows under which nothing is left to measurement.
RECALL, HELD_OUT, EXACT_ROWS = 0.99, 2000, 1000


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]
    #: Of planes, at which a list is probed.
    reach: float

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the lengths of what they miss."""
        residual = x - self.centroids[lists]
        codes, left = np.zeros((len(x), len(self.cuts)), np.uint8), np.zeros(len(x))
        for k, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            d = _squares(residual[:, a:b], book)
            codes[:, k] = d.argmin(axis=1)
            left += np.maximum(d.min(axis=1), 0)
        return codes, np.sqrt(left)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded members of list ``at``, by table lookup."""
        residual = queries - self.centroids[at]
        out = np.zeros((len(queries), len(codes)))
        for k, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            out += _squares(residual[:, a:b], book)[:, codes[:, k]]
        return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 1024], centres).argmin(axis=1) for i in range(0, len(x), 1024)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means. Repeated points leave some centres where they began."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        number = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
    return centres


def _planes(x: np.ndarray, centres: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each vector, and distance to the plane half way from that to each centre."""
    d = _squares(x, centres)
    own = d.argmin(axis=1)
    d -= d[np.arange(len(d)), own][:, None]
    d /= 2 * apart[own]
    return own, d


def _apart(centres: np.ndarray) -> np.ndarray:
    """Distances between centres; centres that coincide have planes at no distance."""
    out = np.sqrt(_squares(centres, centres))
    out[out < SLACK] = np.inf
    return out


def within_reach(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre of each vector, and (vector, centre) of each centre whose plane is within ``reach``, the nearest among them.

    A centre's members are no farther from it than from the vector's own centre, so they lie beyond the plane half way between the two.
    """
    apart = _apart(centres)
    near, rows, found = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
    for i in range(0, len(x), 1024):
        own, planes = _planes(x[i : i + 1024], centres, apart)
        near.append(own)
        a, b = np.nonzero(planes <= reach + SLACK)
        rows.append(a + i)
        found.append(b)
    return np.concatenate(near), np.concatenate(rows), np.concatenate(found)


def measured_reach(held: np.ndarray, sample: np.ndarray, centres: np.ndarray, cosine: float, rng: np.random.Generator) -> float:
    """Reach at which RECALL of the pairs at the threshold are found by the one of the two that probes: of those planted around ``held``, and of those it has in ``sample``."""
    limit = float(np.sqrt(2 - 2 * cosine))
    if len(held) + len(sample) < EXACT_ROWS:
        return limit
    side = rng.normal(size=held.shape)
    side -= (side * held).sum(axis=1)[:, None] * held
    length = np.sqrt((side * side).sum(axis=1))[:, None]
    planted = cosine * held + np.sqrt(1 - cosine * cosine) * side / np.maximum(length, 1e-300)
    left, right = [], []
    for i in range(0, len(held), 256):
        c = held[i : i + 256] @ sample.T
        a, b = np.nonzero((c >= cosine) & (c < 1 - 1e-9))
        _, first = np.unique(a, return_index=True)
        left.append(a[first] + i)
        right.append(b[first])
    left, right = np.concatenate(left), np.concatenate(right)
    apart, most = _apart(centres), 0.0
    for x, y in ((held, planted), (held[left], sample[right])):
        if len(x) < 50:
            continue
        need = []
        for i in range(0, len(x), 512):
            (h, p), (k, q) = _planes(x[i : i + 512], centres, apart), _planes(y[i : i + 512], centres, apart)
            at = np.arange(len(h))
            need.append(np.where(h < k, p[at, k], q[at, h]))
        most = max(most, float(np.quantile(np.concatenate(need), RECALL)))
    return min(limit, most)


def fit(sample: np.ndarray, rows: int, cosine: float = 0.9, seed: int = 0) -> Index:
    """Centroids, codebooks and reach from a sample of unit vectors in random order, for an index of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    held, own = np.split(sample, [min(HELD_OUT, len(sample) // 5)])
    lists = max(1, min(MAX_LISTS, rows // LIST_ROWS, len(own) // 4))
    centroids = _means(own, lists, rng)
    edges = np.unique(np.linspace(0, own.shape[1], SUBSPACES + 1).astype(int))
    cuts = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]
    residual = own - centroids[_nearest(own, centroids)]
    books = [_means(residual[:, a:b], min(CODES, len(own)), rng) for a, b in cuts]
    return Index(centroids, books, cuts, measured_reach(held, own, centroids, cosine, rng))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in double precision, of length 1."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    # Scaled by the largest component first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _enter(index: Index, dim: int):
    """List, lists to probe (from the own one on), code and its error of each vector."""

    def run(batches):
        begin("vectors")
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column(2), dim)
            own, rows, probes = within_reach(x, index.centroids, index.reach)
            ahead = probes >= own[rows]
            codes, error = index.encode(x, own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(own.astype(np.int32)), _lists(rows[ahead], probes[ahead], len(x)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                ["vec_id", "copies", "vec", "list", "probes", "code", "error"],
            )
        release()

    return run


def _fit_cells(dim: int, cosine: float, seed: int = 0):
    """Centroids of a list's cells and their reach, from a sample of its rows."""

    def run(table):
        begin("vectors")
        x, rows = unit_rows(table.column("vec").combine_chunks(), dim), table.column("rows")[0].as_py()
        rng = np.random.default_rng(seed)
        held, x = np.split(x[rng.permutation(len(x))], [min(HELD_OUT, len(x) // 5)])
        centres = _means(x, max(1, min(MAX_LISTS, rows // LIST_ROWS, len(x) // 4)), rng)
        reach = measured_reach(held, x, centres, cosine, rng)
        return pa.table([pa.array([table.column("list")[0].as_py()], pa.int32()), pa.array([centres.tobytes()], pa.binary()), pa.array([reach])], ["list", "centres", "reach"])

    return run


def _find_cells(dim: int):
    """Cells of members (their own) and queries (those within reach; in the list that is theirs, from the own one on)."""

    def run(table, centres):
        begin("vectors")
        table = table.combine_chunks()
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int8()), pa.array([], pa.int32()), pa.array([], pa.bool_())], ["vec_id", "list", "query", "cell", "own"])
        at = np.frombuffer(centres.column("centres")[0].as_py()).reshape(-1, dim)
        x = unit_rows(table.column("vec").combine_chunks(), dim)
        query, same = table.column("query").to_numpy(), table.column("list").to_numpy() == table.column("home").to_numpy()
        own, rows, cells = within_reach(x, at, centres.column("reach")[0].as_py())
        keep = np.where(query[rows] == 0, cells == own[rows], ~same[rows] | (cells >= own[rows]))
        rows, cells = rows[keep], cells[keep]
        take = lambda name: table.column(name).take(pa.array(rows))
        return pa.table([take("vec_id"), take("list"), take("query"), pa.array(cells.astype(np.int32)), pa.array(same[rows] & (cells == own[rows]))], ["vec_id", "list", "query", "cell", "own"])

    return run


def _forest(q: np.ndarray, m: np.ndarray, nq: int, nm: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest linked member reachable, for each query and member that has a link (else -1), by label passing."""
    big = nm
    label = np.arange(nm)
    by_m = np.argsort(m, kind="stable")
    q_at, m_at = np.flatnonzero(np.diff(q, prepend=-1)), np.flatnonzero(np.diff(m[by_m], prepend=-1))
    q_ids, m_ids = q[q_at], m[by_m][m_at]
    of_q = np.full(nq, big)
    while True:
        of_q[q_ids] = np.minimum.reduceat(label[m], q_at)
        new = label.copy()
        new[m_ids] = np.minimum(label[m_ids], np.minimum.reduceat(of_q[q[by_m]], m_at))
        if (new == label).all():
            break
        label = new
    linked = np.full(nm, -1)
    linked[m_ids] = label[m_ids]
    return np.where(of_q < big, of_q, -1), linked


def _search(index: Index, dim: int, cosine: float):
    reach = np.sqrt(2 - 2 * cosine)

    def run(table):
        begin("vectors")
        table = table.combine_chunks()
        query = table.column("query").to_numpy()
        qs, ms = table.filter(pa.array(query == 1)), table.filter(pa.array(query == 0))
        none = pa.table([pa.array([], pa.int8()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["kind", "u", "v"])
        if not qs.num_rows or not ms.num_rows:
            return none
        at = ms.column("list")[0].as_py()
        x, y = unit_rows(ms.column("vec").combine_chunks(), dim), unit_rows(qs.column("vec").combine_chunks(), dim)
        codes = np.frombuffer(b"".join(ms.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        limit = (reach + ms.column("error").to_numpy() + 1e-9) ** 2
        mid, qid = ms.column("vec_id").to_numpy(), qs.column("vec_id").to_numpy()
        found_q, found_m = [], []
        for i in range(0, len(y), 256):
            part = y[i : i + 256]
            a, b = np.nonzero((index.distances(part, at, codes) <= limit) & (qid[i : i + 256, None] != mid[None, :]))
            for j in range(0, len(a), 1 << 16):
                s, t = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                hit = np.einsum("ij,ij->i", part[s], x[t]) >= cosine
                found_q.append(s[hit] + i)
                found_m.append(t[hit])
        q = np.concatenate(found_q) if found_q else np.zeros(0, int)
        m = np.concatenate(found_m) if found_m else np.zeros(0, int)
        if not len(q):
            return none
        q_copies, m_copies = qs.column("copies").to_numpy(), ms.column("copies").to_numpy()
        n_q = np.bincount(q, m_copies[m], len(qid)).astype(np.int64)
        # In its own cell a query meets each member the other way round, too; elsewhere only here.
        elsewhere = ~qs.column("own").to_numpy(zero_copy_only=False)[q]
        n_m = np.bincount(m[elsewhere], q_copies[q[elsewhere]], len(mid)).astype(np.int64)
        of_q, of_m = _forest(q, m, len(qid), len(mid))
        kind, u, v = [], [], []
        for k, ids, values in ((0, qid, n_q), (0, mid, n_m)):
            some = values > 0
            kind.append(np.full(some.sum(), k)), u.append(ids[some]), v.append(values[some])
        for ids, root in ((qid, of_q), (mid, of_m)):
            some = root >= 0
            kind.append(np.full(some.sum(), 1)), u.append(ids[some]), v.append(mid[root[some]])
        return pa.table([pa.array(np.concatenate(kind).astype(np.int8)), pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["kind", "u", "v"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors linked directly), component_id, kept.

    Pairs found with a cosine of at least ``cosine`` are linked, none below it; of those at the threshold the index finds RECALL of a level, of nearer ones more. A vector that is null, empty, zero or has a null or non-finite component links
    with nothing; it is its own component and kept. Vectors of different lengths don't link; each length has an index of its own, one after the other. Rows with the same
    id and vector count as linked copies; a row without an id links with nothing: its component_id is null and kept is true. Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    valid = sound & F.col("vec_id").isNotNull()
    out = own.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for (dim,) in own.filter(valid).select(F.size("vec").alias("n")).distinct().orderBy("n").collect():  # one row a length
        out = out.union(_near_of_length(own.filter(valid & (F.size("vec") == dim)), dim, cosine, scratch))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _cells(entered: DataFrame, rows: DataFrame, dim: int, cosine: float, scratch: Scratch) -> DataFrame:
    """``rows`` (list, vec_id, copies, vec, home, query, code, error) with the cell they belong to or probe, and ``own``: whether that is a query's own cell."""
    plain = rows.select("*", F.lit(0).alias("cell"), (F.col("list") == F.col("home")).alias("own"))
    large = scratch.save(entered.groupBy("list").agg(F.count("*").alias("rows")).filter(F.col("rows") > SPLIT_ROWS))
    if large.isEmpty():
        return plain
    # One row a list, MAX_LISTS at most.
    few = F.broadcast(large)
    part = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(5)), 11) / F.lit(float(1 << 53))
    sample = entered.join(few, "list").filter(part < SPLIT_SAMPLE / F.col("rows")).select("list", "vec", "rows")
    centres = scratch.save(sample.groupBy("list").applyInArrow(_fit_cells(dim, cosine), "list int, centres binary, reach double"))
    counted = scratch.save(rows.join(few, "list", "left_semi").groupBy("list").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("blocks")))
    dealt = rows.join(F.broadcast(counted), "list").withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(6)), "blocks").cast("int")).select("list", "b", "vec_id", "vec", "home", "query")
    copies = centres.join(F.broadcast(counted), "list").select("list", "centres", "reach", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    found = dealt.groupBy("list", "b").cogroup(copies.groupBy("list", "b")).applyInArrow(_find_cells(dim), "vec_id long, list int, query byte, cell int, own boolean")
    split = rows.join(scratch.save(found), ["list", "vec_id", "query"]).select(*rows.columns, "cell", "own")
    return plain.join(few, "list", "left_anti").union(split)


def _near_of_length(own: DataFrame, dim: int, cosine: float, scratch: Scratch) -> DataFrame:
    """vec_id, n_links, component_id of sound vectors of one length."""
    classes = scratch.save(own.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    picked = classes.select("vec", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    index = fit(unit_rows(picked, dim), classes.count(), cosine)
    del picked
    entered = scratch.save(classes.select("vec_id", "copies", "vec").mapInArrow(_enter(index, dim), "vec_id long, copies long, vec array<double>, list int, probes array<int>, code binary, error double"))

    members = entered.select("list", "vec_id", "copies", "vec", F.col("list").alias("home"), F.lit(0).cast("byte").alias("query"), "code", "error")
    queries = entered.select(F.explode("probes").alias("list"), "vec_id", "copies", "vec", F.col("list").alias("home"), F.lit(1).cast("byte").alias("query"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    placed = _cells(entered, members.union(queries), dim, cosine, scratch)
    size = scratch.save(placed.groupBy("list", "cell").agg(F.count_if(F.col("query") == 0).alias("m"), F.count_if(F.col("query") == 1).alias("q")).select("list", "cell", F.ceil(F.col("m") / MEMBER_BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb")).filter("mb > 0 AND qb > 0"))
    if size.count() <= BROADCAST_CELLS:
        size = F.broadcast(size)
    asks, h = F.col("query") == 1, F.xxhash64("vec_id")
    there = placed.join(size, ["list", "cell"]).withColumn("k", F.when(asks, F.pmod(h, F.col("qb"))).otherwise(F.pmod(h, F.col("mb"))).cast("int"))
    there = there.select("*", F.explode(F.sequence(F.lit(0), F.when(asks, F.col("mb")).otherwise(F.col("qb")) - 1)).alias("j"))
    there = there.withColumn("p", F.when(asks, F.col("j")).otherwise(F.col("k"))).withColumn("q", F.when(asks, F.col("k")).otherwise(F.col("j")))
    grouped = there.select("list", "cell", "p", "q", "query", "own", "vec_id", "copies", "vec", "code", "error").groupBy("list", "cell", "p", "q")
    found = scratch.save(grouped.applyInArrow(_search(index, dim, cosine), "kind byte, u long, v long"))
    scratch.drop(entered)

    counts = found.filter("kind = 0").groupBy(F.col("u").alias("vec_id")).agg(F.sum("v").alias("n"))
    joined = components(found.filter("kind = 1").select("u", "v"), scratch).select(F.col("id").alias("vec_id"), "component_id")
    named = classes.join(counts, "vec_id", "left").join(joined, "vec_id", "left").select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    named = scratch.save(named)
    return own.join(named, "vec").select("vec_id", "n_links", "component_id")
