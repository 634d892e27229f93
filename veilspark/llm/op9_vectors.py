"""Near-duplicate vectors by NN-descent, with exact counts inside what it connects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop

THRESHOLD = 0.98
#: Neighbours that a vector compares new ones with, at first; it lists twice as many.
NEIGHBOURS = 10
#: Hyperplane tables of the first graph, and vectors that share a cell of one at most.
TABLES, CELL = 10, 256
#: Rounds of neighbours-of-neighbours, and times that lists and tables are enlarged where the audit falls short.
ROUNDS, ENLARGED = 4, 3
#: Vectors whose links are found by comparing with all others, to audit recall: 1 MB for 64 dimensions.
AUDITED, WANTED = 2048, 0.995
#: Vectors of a block in exact comparisons, and in those of doubtful vectors with all.
BLOCK, WIDE = 1024, 2048
#: Neighbours whose vectors a local join multiplies at once: 10 MB for 64 dimensions.
AT_ONCE = 20_000


def _matrix(column) -> np.ndarray:
    """Rows of equal length from a list column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a / np.sqrt((a * a).sum(1))[:, None]
    b = b / np.sqrt((b * b).sum(1))[:, None]
    return a @ b.T


def pair_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """All cosines; products are rounded differently than pairwise sums, so those near the threshold are summed again."""
    s = cosines(a, b)
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
    s[i, j] = pair_cosines(a[i], b[j])
    return s


def forest(known: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(a, b)``: of every vector of ``known`` with a link, ``(u, v)`` by place there, the least one that it hangs together with."""
    root = np.arange(len(known))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(known)))
    return known[root[moved]], known[moved]


def _binary(x: np.ndarray) -> pa.Array:
    """Rows as their bytes, which travel between the JVM and Python as they are."""
    at = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def _rows(column) -> np.ndarray:
    """Rows of equal length from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _listed(u: np.ndarray, v: np.ndarray, s: np.ndarray, most: int) -> pa.Table:
    """``(u, v, s)``, a row for each ``u`` with the lists of its ``most`` nearest and their cosines, the nearest first."""
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s = u[once], v[once], s[once]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(u)))
    near = np.arange(len(u)) - np.repeat(first, size) < most
    at = np.append(0, np.cumsum(np.minimum(size, most))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c[near])) for c in (v, s)]
    return pa.table({"u": u[first], "v": lists[0], "s": lists[1]})


def _flat(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(u, v, s)`` of each place of the lists."""
    v, s = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("v"), t.column("s")))
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(t.column("u").to_numpy(), size), v.flatten().to_numpy(), s.flatten().to_numpy()


LISTS = "u long, v array<long>, s array<double>"


def representatives(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, grp, x, m)``: one row for all vectors that are equal and have the same label, ``m`` their number.

    ``grp`` is of label and dimension.  Vectors without a label, null, zero or with a component that is null or not finite have none.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    v = v.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    # -0.0 and 0.0 are one value
    v = v.withColumn("x", F.transform("x", lambda c: c + 0.0)).withColumn("grp", F.concat_ws(":", F.size("x").cast("string"), "label"))
    return v.groupBy("grp", "x").agg(F.min("id").alias("id"), F.count("*").alias("m")).select("id", "grp", "x", "m")


def _cells(tables: int, seed: int):
    """``(id, grp, x, t, cell)`` of every vector for each table: the signs of so many random projections that cells of even data stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(3).to_numpy() * 1_000_000 + np.array([len(x) for x in b.column(2)], np.int64)
            for kind in np.unique(kinds).tolist():
                part = b.take(pa.array(np.flatnonzero(kinds == kind)))
                x, bits = _matrix(part.column(2)), kind // 1_000_000
                packed = _binary(x)
                for t in range(tables):
                    planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], 40))[:, :bits]
                    code = ((x @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    n = len(part)
                    yield pa.record_batch([part.column(0), part.column(1), packed, pa.array([t] * n, pa.int32()), pa.array(code, pa.int64())], ["id", "grp", "x", "t", "cell"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(v, x)`` with the vectors as bytes."""
    for b in batches:
        dims = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            part = b.take(pa.array(np.flatnonzero(dims == d)))
            yield pa.record_batch([part.column(0), _binary(_matrix(part.column(1)))], ["v", "x"])


def _within(k: int, threshold: float):
    """A cell's nearest neighbours, and as ties (``s`` null) a spanning forest of its links, which a crowd has more of than rows.

    Each vector lists its own: who is not among the ``k`` nearest of its cell is not among them in all.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), _rows(t.column("x"))
        s = similar(x, x, threshold)
        np.fill_diagonal(s, -2)
        n = min(k, len(ids) - 1)
        if n < 1:
            return _listed(ids[:0], ids[:0], np.empty(0), k)
        j = np.argpartition(-s, n - 1, axis=1)[:, :n]
        at = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n)
        lists = [pa.ListArray.from_arrays(at, pa.array(c.ravel())) for c in (ids[j], np.take_along_axis(s, j, 1))]
        near = pa.table({"u": ids, "v": lists[0], "s": lists[1]})
        a, b = forest(ids, *np.nonzero(s >= threshold))
        one = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1), pa.int32()), pa.array(b))
        return pa.concat_tables([near, pa.table({"u": a, "v": one, "s": pa.nulls(len(a), pa.list_(pa.float64()))})])

    return run


def _local_join(k: int, threshold: float):
    """Pairs of one vector's neighbours that are closer than what either of them lists so far."""

    def run(t: pa.Table) -> pa.Table:
        every_u, every_v, every_worst = (t.column(c).to_numpy() for c in ("u", "v", "worst"))
        column = t.column("x").combine_chunks()
        bytes_of = np.array(pc.binary_length(column))
        order = np.lexsort((every_v, every_u, bytes_of))
        first = np.flatnonzero(np.append(True, np.diff(every_u[order]) != 0)) if len(order) else order
        size = np.diff(np.append(first, len(order)))
        out = [[every_v[:0]], [every_v[:0]], [np.empty(0)]]
        # all with as many neighbours of one dimension at once
        kinds = np.stack((bytes_of[order[first]], size), 1) if len(first) else np.empty((0, 2), int)
        for kind in np.unique(kinds, axis=0):
            m, starts = int(kind[1]), first[(kinds == kind).all(1)]
            i, j = np.triu_indices(m, 1)
            for some in np.array_split(starts, -(-len(starts) * m // AT_ONCE)):
                at = order[some[:, None] + np.arange(m)]
                v, worst = every_v[at], every_worst[at]
                x = _rows(column.take(pa.array(at.ravel()))).reshape(len(at), m, -1)
                unit = x / np.sqrt((x * x).sum(-1))[..., None]
                s = (unit @ unit.swapaxes(1, 2))[:, i, j]
                g, p = np.nonzero(np.abs(s - threshold) < 1e-9)
                s[g, p] = pair_cosines(x[g, i[p]], x[g, j[p]])
                ok = (s > np.minimum(worst[:, i], worst[:, j])) & (v[:, i] != v[:, j])
                for o, c in zip(out, (v[:, i][ok], v[:, j][ok], s[ok])):
                    o.append(c)
        a, b, s = map(np.concatenate, out)
        return _listed(np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s)), 2 * k)

    return run


def _both_ways(k: int):
    """Lists, and of each batch those of the vectors that are listed there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, s = _flat(b)
            yield from pa.concat_tables([_listed(u, v, s, k), _listed(v, u, s, k)]).to_batches()

    return run


def _kept(lists: DataFrame, k: int, spread: int) -> DataFrame:
    """Each vector's ``2k`` nearest of all its lists."""
    by_vector = lists.withColumn("p", F.pmod(F.xxhash64("u"), F.lit(spread))).groupBy("p")
    return by_vector.applyInArrow(lambda t: _listed(*_flat(t), 2 * k), LISTS)


def neighbour_graph(reps: DataFrame, k: int, tables: int, seed: int, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, links that the descent found or what spans them, and ``(id)``, the doubtful vectors: of split cells, or with lists full of links."""
    sizes = reps.groupBy("grp").agg(F.count("*").alias("n"))
    bits = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / 48)))).cast("long")
    cells = reps.select("id", "grp", "x").join(sizes.select("grp", bits.alias("bits")), "grp").select("id", "grp", "x", "bits")
    cells = cells.mapInArrow(_cells(tables, seed), "id long, grp string, x binary, t int, cell long")
    crowd = cells.groupBy("grp", "t", "cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    # a crowded cell is split at random: its vectors are close to each other whichever they meet
    crowd = crowd.filter("parts > 1")
    dealt = cells.join(crowd, ["grp", "t", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("id", "t"), F.coalesce("parts", F.lit(1))))
    edges = cut(dealt.groupBy("grp", "t", "cell", "part").applyInArrow(_within(2 * k, threshold), LISTS))
    ties = cut(edges.filter("s is null").select("u", F.col("v")[0].alias("v")).distinct())
    n = reps.count()
    spread = max(1, n * k // 20_000)
    graph = cut(_kept(edges.filter("s is not null"), k, spread))
    drop(edges)
    vectors = cut(reps.select(F.col("id").alias("v"), "x").mapInArrow(_packed, "v long, x binary"))
    for _ in range(rounds):
        worst = graph.select(F.col("u").alias("v"), F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).alias("worst"))
        known = vectors.join(worst, "v", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
        # lists go both ways; the ones that meet at a vector are its 2k closest, as many as a join's square allows
        near = _kept(graph.mapInArrow(_both_ways(2 * k), LISTS), k, spread)
        rows = near.select("u", F.explode("v").alias("v")).join(known, "v")
        new = rows.withColumn("p", F.pmod(F.xxhash64("u"), F.lit(spread))).groupBy("p").applyInArrow(_local_join(k, threshold), LISTS)
        after = cut(_kept(graph.union(new), k, spread))
        others = F.size(F.array_except("v", F.coalesce("w", F.array().cast("array<long>"))))
        changed = after.join(graph.select("u", F.col("v").alias("w")), "u", "left").agg(F.sum(others)).first()[0] or 0
        drop(graph)
        graph = after
        if changed <= n * k // 1000:
            break
    near = graph.select("u", F.explode(F.arrays_zip("v", "s")).alias("x")).select("u", "x.v", "x.s")
    links = near.filter(F.col("s") >= threshold)
    split = cells.select("grp", "t", "cell", "id").join(crowd, ["grp", "t", "cell"]).select("id")
    full = links.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("c")).filter(F.col("c") >= 2 * k).select("id")
    doubtful = cut(split.union(full).distinct())
    found = cut(links.filter("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")).union(ties.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    drop(graph, ties, vectors)
    return found, doubtful


def _audit(queries: dict[str, tuple[np.ndarray, np.ndarray]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.array(b.column(1).to_pylist(), object)
            for g in set(group.tolist()) & queries.keys():
                at = np.flatnonzero(group == g)
                ids, x = b.column(0).to_numpy()[at], _matrix(b.column(2).take(pa.array(at)))
                i, j = np.nonzero(similar(x, queries[g][1], threshold) >= threshold)
                u, v = ids[i], queries[g][0][j]
                yield pa.record_batch([pa.array(u[u != v]), pa.array(v[u != v])], ["a", "b"])

    return run


def _spanned(threshold: float):
    """``(a, b)``: of every vector of a tile with a link, the least one of the tile that it hangs together with."""

    def run(t: pa.Table) -> pa.Table:
        side, ids = (t.column(c).to_numpy() for c in ("side", "id"))
        x = _matrix(t.column("x"))
        known, node = np.unique(ids, return_inverse=True)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(similar(x[a], x[b], threshold) >= threshold)
        of, to = forest(known, node[a[i]], node[b[j]])
        return pa.table({"a": of, "b": to})

    return run


def exact_edges(reps: DataFrame, doubtful: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)`` that hang together as all links of the ``doubtful`` do: they are compared with every vector of their group, in blocks.

    A tile gives a spanning forest of its links, so a crowded group costs comparisons but no rows by its square.
    """
    some = reps.select("id", "grp", "x").join(doubtful, "id", "left_semi")
    sizes = reps.groupBy("grp").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("nb"))
    sizes = cut(sizes.join(some.groupBy("grp").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("ns")), "grp"))
    blk = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = some.join(sizes, "grp").select("grp", "id", "x", F.lit(0).alias("side"), blk("ns").alias("i"), every("nb").alias("j"))
    right = reps.join(sizes, "grp").select("grp", "id", "x", F.lit(1).alias("side"), every("ns").alias("i"), blk("nb").alias("j"))
    return left.union(right).groupBy("grp", "i", "j").applyInArrow(_spanned(threshold), "a long, b long")


def _counts(threshold: float):
    """``(id, links)``: weighted links of a tile's two blocks."""

    def run(t: pa.Table) -> pa.Table:
        side, ids, m = (t.column(c).to_numpy() for c in ("side", "id", "m"))
        x = _matrix(t.column("x"))
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        hit = (similar(x[a], x[b], threshold) >= threshold) & (ids[a][:, None] != ids[b][None, :])
        if (side == 2).any():
            return pa.table({"id": ids[a], "links": (hit @ m[b]).astype(np.int64)})
        return pa.table({"id": np.concatenate((ids[a], ids[b])), "links": np.concatenate((hit @ m[b], m[a] @ hit)).astype(np.int64)})

    return run


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``(id, links)`` from ``(id, component, x, m)``: exact, by blocks of each component."""
    sized = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    rows = members.join(sized, "component").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    side = lambda k: F.when(k == F.col("blk"), 2).when(F.col("blk") < k, 0).otherwise(1)
    cell = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(k, "blk").alias("i"), F.greatest(k, "blk").alias("j"), side(k).alias("side")))
    tiles = rows.select("id", "x", "m", "component", F.inline(cell))
    # small components share a task
    return tiles.groupBy("component", "i", "j").applyInArrow(_counts(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    The descent finds which vectors hang together; vectors that it may have served badly (of split cells, or with lists full of links) are compared with all of their group.  Links are then counted exactly inside each component, in blocks, so crowded
    neighbourhoods are whole however long the lists were.  A bounded set of vectors is compared with all others: links that it
    shows are added, and where some are missing for too many vectors, a component's counted once, lists and tables are enlarged
    and the descent is run again.  Groups in which vectors are still short after the last run are compared whole.

    Rows that link with nothing (no label, null, zero, null or non-finite components): 0 links, own component.  Equal vectors of a label
    link with each other.  Null ids: 0 links, null component.  Ids are expected to be unique; rows with one id count as one vector each.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    reps = cut(representatives(vectors, id_col, vector_col, label_col).select(F.col("id").cast("long").alias("id"), "grp", "x", "m"))
    chosen = reps.orderBy(F.xxhash64("id")).limit(AUDITED).select("id", "grp", "x").collect()
    queries = {g: (np.array([r["id"] for r in chosen if r["grp"] == g], np.int64), np.array([r["x"] for r in chosen if r["grp"] == g])) for g in {r["grp"] for r in chosen}}
    true = cut(reps.select("id", "grp", "x").mapInArrow(_audit(queries, threshold), "a long, b long"))
    edges, k, tables, compared = None, NEIGHBOURS, TABLES, None
    for attempt in range(ENLARGED):
        found, doubtful = neighbour_graph(reps, k, tables, attempt, threshold)
        if compared is not None:
            doubtful = cut(doubtful.join(compared, "id", "left_anti"))
        found = cut(found.union(exact_edges(reps, doubtful, threshold)))
        edges = found if edges is None else edges.union(found)
        compared = doubtful if compared is None else compared.union(doubtful)
        side = components(edges).select("node", "component")
        # of the vectors audited that have links, those without one of them; a component counts once, whatever its size
        ends = true.join(side.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(side.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        whole = cut(ends.groupBy("b").agg(F.min(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")).alias("ok"), F.first("cb").alias("c")))
        recall = whole.groupBy(F.coalesce("c", "b").alias("c")).agg(F.min("ok").alias("ok")).agg(F.avg("ok")).first()[0]
        if recall is None or recall >= WANTED:
            break
        k, tables = 2 * k, 2 * tables
    else:
        short = reps.join(whole.filter("ok = 0").select(F.col("b").alias("id")), "id", "left_semi").select("grp").distinct()
        rest = reps.join(short, "grp", "left_semi").select("id").join(compared, "id", "left_anti")
        edges = edges.union(cut(exact_edges(reps, cut(rest), threshold)))
    label = components(edges.union(true))
    members = cut(reps.join(label, reps["id"] == label["node"]).select("id", "component", "x", "m"))
    links = link_counts(members, threshold)
    of_rep = reps.select("id", "grp", "x", "m").join(links.withColumnRenamed("id", "id2"), F.col("id") == F.col("id2"), "left")
    of_rep = of_rep.join(label, F.col("id") == F.col("node"), "left")
    of_rep = of_rep.select("grp", "x", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    v = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda c: c + 0.0).alias("vx"), F.col(label_col).cast("string").alias("label"))
    v = v.withColumn("vg", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.concat_ws(":", F.size("vx").cast("string"), "label")))
    out = v.join(of_rep, (F.col("vg") == F.col("grp")) & (F.col("vx") == F.col("x")), "left")
    component = F.coalesce(F.col("c"), F.col("vec_id").cast("long"))
    return out.select(F.col("vec_id").cast(kind).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
