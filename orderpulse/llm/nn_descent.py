"""Embedding near-duplicates by NN-descent.

A graph of ``k`` nearest neighbours starts from random-projection leaves and is
refined through neighbours of neighbours: around every vector, its neighbours
(those that name it included) are compared with each other, and each keeps its
best. The edges at or above the threshold give families (connected components).

Where lists are saturated (all ``k`` neighbours are near-duplicates) a list
cannot name them all, so lists are enlarged to whole families: the members of a
family are compared exactly, in pairs of blocks, which return counts, not pairs.
A link that both lists leave out may lead to another family. So the vectors with
saturated lists are searched again, each for its best outside its own family;
families that meet become one, until such a search finds no link.

The recall is audited: sampled vectors are compared with all rows, and for each
that has links the share of them inside its family is measured. Vectors with at
most ``k`` links and those with more are averaged separately, and the sample
grows until it holds enough of the first. Below the target, more leaves and
another refinement follow; if that does not help, all vectors are compared.
Links that a comparison finds between families join them. Equal vectors are one
node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import stage
from orderpulse.llm.components import components

LEAF = 64  # vectors of an average leaf
BLOCK = 512  # vectors of a block in a leaf or family
CHUNK = 2048  # vectors compared with all rows in one pass of the audit
_EDGE = "src long, dst long, sim double"


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.astype(np.float64).reshape(-1, dim)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _vectors(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dim -> (row numbers, unit vectors) of a column of lists without nulls."""
    sizes = np.diff(col.offsets.to_numpy())
    flat, at = col.flatten().to_numpy(), col.offsets.to_numpy() - col.offsets[0].as_py()
    out = {}
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        out[int(dim)] = rows, _unit(flat[(at[rows][:, None] + np.arange(dim)).ravel()], int(dim))
    return out


def vector_nodes(vectors: DataFrame) -> DataFrame:
    """(node, rep, copies, v): distinct usable vectors, the least id and number of rows of each."""
    e = F.col("embedding")
    usable = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(usable).select(
        "vec_id", F.transform(e, lambda x: x.cast("double") + 0.0).alias("v")).where(
        F.exists("v", lambda x: x != 0))
    # scaled by the largest component, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.select("vec_id", F.transform("v", lambda x: x / top).alias("v"))
    return rows.groupBy(F.xxhash64("v").alias("node"), "v").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def _leaves(nodes: DataFrame, bits: int, trees: range, k: int) -> DataFrame:
    """Edges between the nearest vectors of equal sides of ``bits`` random planes, per tree.

    Vectors of one ``family`` are not compared (the vector itself, where each is its own).
    """

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (rows, v) in _vectors(b.column(1)).items():
                for tree in trees:
                    plane = np.random.default_rng([dim, tree]).standard_normal((dim, bits))
                    side = (v @ plane > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(v), np.int64)
                    part = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), dim * 100_000 + tree, np.int64)), pa.array(side.astype(np.int64)),
                         part.column(0), part.column(1), part.column(2)], ["tree", "side", "node", "v", "family"])

    placed = nodes.select("node", "v", "family").mapInArrow(
        sides, "tree long, side long, node long, v array<double>, family long")
    tally = placed.groupBy("tree", "side").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = placed.join(tally, ["tree", "side"]).withColumn(
        "block", F.pmod(F.xxhash64("node", "tree"), F.col("blocks")))
    # the join's layout by (tree, side) would keep all blocks of a hot side in one task
    placed = placed.repartition("tree", "side", "block")

    def nearest(f: pd.DataFrame) -> pd.DataFrame:
        v = _unit(np.concatenate(f["v"].to_numpy()), len(f["v"].iloc[0]))
        return _best(f["node"].to_numpy(), f["family"].to_numpy(), v @ v.T, k)

    return placed.groupBy("tree", "side", "block").applyInPandas(nearest, _EDGE)


def _best(name: np.ndarray, family: np.ndarray, sim: np.ndarray, k: int) -> pd.DataFrame:
    """Each row's ``k`` best columns, those of its own family left out, as edges."""
    sim[family[:, None] == family[None, :]] = -2
    take = min(k, len(name) - 1)
    if take < 1:
        return pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64), "sim": np.zeros(0)})
    top = np.argpartition(-sim, take - 1, axis=1)[:, :take]
    best = pd.DataFrame({"src": np.repeat(name, take), "dst": name[top.ravel()],
                         "sim": np.take_along_axis(sim, top, 1).ravel()})
    return best[best["sim"] > -2]


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """(src, near): the ``k`` best (sim, dst) of each vector."""
    return _top(edges, ["src"], k)


def _top(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    return edges.groupBy(*keys).agg(
        F.slice(F.sort_array(F.collect_set(F.struct("sim", "dst")), asc=False), 1, k).alias("near"))


def _refine(nodes: DataFrame, lists: DataFrame, k: int, inner: DataFrame | None = None) -> DataFrame:
    """Edges found by comparing the neighbours of every vector with each other, those of
    ``inner`` lists included, except vectors of one family."""
    forth = _flat(lists)
    # a vector may be named by very many: the best of each of 64 parts first
    back = forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim",
                        F.pmod(F.xxhash64("src"), F.lit(64)).alias("part"))
    back = _flat(_lists(_flat(_top(back, ["src", "part"], k)), k))
    around = forth.union(back)
    if inner is not None:
        around = around.union(_flat(inner))
    around = around.select("src", "dst").distinct()
    worst = lists.select(F.col("src").alias("node"), F.when(F.size("near") < k, -2.0).otherwise(
        F.element_at("near", -1)["sim"]).alias("worst"))
    known = nodes.select("node", "family", "v").join(worst, "node", "left").fillna(-2.0, ["worst"])
    local = around.join(known, around["dst"] == known["node"]).groupBy("src").agg(
        F.collect_list(F.struct("node", "worst", "v", "family")).alias("n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for row in b.column(0):
                n = row.values
                name, worst = n.field("node").to_numpy(), n.field("worst").to_numpy()
                v = n.field("v")
                v = _unit(v.flatten().to_numpy(), len(v[0]))
                sim = v @ v.T
                family = n.field("family").to_numpy()
                sim[family[:, None] == family[None, :]] = -3
                i, j = np.nonzero(sim > worst[:, None])
                src.append(name[i])
                dst.append(name[j])
                sims.append(sim[i, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (src, dst, sims)], ["src", "dst", "sim"])

    return local.select("n").mapInArrow(compare, _EDGE)


def _against_all(held: DataFrame, queries: list[tuple], threshold: float) -> DataFrame:
    """(a, b, true, inside): links of each query a, all and inside its family (b null), and
    families a and b that a link joins."""
    shipped = held.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for q in shipped.value:
            by_dim.setdefault(len(q[2]), []).append(q)
        unit = {d: (np.array([x[0] for x in q]), np.array([x[1] for x in q]),
                    _unit(np.array([x[2] for x in q]).ravel(), d)) for d, q in by_dim.items()}
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                b = whole.slice(lo, CHUNK)
                for dim, (rows, v) in _vectors(b.column(2)).items():
                    if dim not in unit:
                        continue
                    q_name, q_family, q = unit[dim]
                    name, family = (b.column(i).to_numpy()[rows] for i in (0, 1))
                    r, c = np.nonzero(v @ q.T >= threshold)
                    other = name[r] != q_name[c]
                    r, c = r[other], c[other]
                    same = family[r] == q_family[c]
                    true, inside = (np.bincount(x, minlength=len(q)) for x in (c, c[same]))
                    at = np.flatnonzero(true)
                    pairs = np.unique(np.stack([q_family[c[~same]], family[r[~same]]], 1), axis=0)
                    zero = np.zeros(len(pairs), np.int64)
                    tally = np.arange(len(at) + len(pairs)) < len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([q_name[at], pairs[:, 0]])),
                         pa.array(np.concatenate([q_name[at], pairs[:, 1]]), mask=tally),
                         pa.array(np.concatenate([true[at], zero])), pa.array(np.concatenate([inside[at], zero]))],
                        ["a", "b", "true", "inside"])

    return stage(held.mapInArrow(count, "a long, b long, true long, inside long"), "audit")


def _audit(nodes: DataFrame, families: DataFrame, threshold: float, k: int, sample: int, linked: float,
           total: int) -> tuple[float, DataFrame, bool]:
    """(recall, families, whole): the recall before the links found here joined families,
    and whether all vectors were compared, so that no link is missing.

    The sample starts with about ``sample`` vectors and grows until ``linked`` of
    them have 1 to ``k`` links, or to the whole table.
    """
    held = stage(nodes.join(families, "node", "left").select(
        "node", F.coalesce("family", "node").alias("family"), "v"), "audited")
    unit = F.xxhash64("node", F.lit(3)) / F.lit(2.0**64) + 0.5
    lo, width, shares, met = 0.0, sample / max(1, total), {True: [], False: []}, None
    while lo < 1 and len(shares[True]) < linked:
        hi = lo + min(width, CHUNK / max(1, total))
        hi = hi if hi < 1 else 1.0
        part = (unit >= lo) & ((unit < hi) | F.lit(hi == 1))
        queries = [(r["node"], r["family"], r["v"]) for r in held.where(part).collect()]
        lo, width = hi, 4 * width
        if not queries:
            continue
        got = _against_all(held, queries, threshold)
        for r in got.where("b is null").groupBy("a").agg(F.sum("true"), F.sum("inside")).collect():
            shares[r[1] <= k].append(r[2] / r[1])
        pairs = got.where("b is not null").select("a", "b")
        met = pairs if met is None else met.union(pairs)
    recall = min((float(np.mean(x)) for x in shares.values() if x), default=1.0)
    if met is not None and recall < 1:
        families = _joined(families, met.distinct())
    return recall, families, lo >= 1


def _family_links(nodes: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): rows linked with each vector inside its family, its own row's copies left out."""
    tally = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (families.join(tally, "family")
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", "family", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
             .join(nodes.select("node", "copies", "v"), "node"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        v, n = _unit(np.concatenate(f["v"].to_numpy()), len(f["v"].iloc[0])), f["copies"].to_numpy()
        name, left = f["node"].to_numpy(), (f["own"] == f["i"]).to_numpy()
        if f["i"].iloc[0] == f["j"].iloc[0]:
            near = v @ v.T >= threshold
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": name, "linked": near @ n})
        near = v[left] @ v[~left].T >= threshold
        return pd.DataFrame({"node": np.concatenate([name[left], name[~left]]),
                             "linked": np.concatenate([near @ n[~left], n[left] @ near])})

    return dealt.groupBy("family", "i", "j").applyInPandas(compare, "node long, linked long").groupBy("node").agg(
        F.sum("linked").alias("linked"))


def _bits(total: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, total) / LEAF))))


def _near(lists: DataFrame, threshold: float) -> DataFrame:
    return _flat(lists).where(F.col("sim") >= threshold).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def _joined(families: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, family) when the families at both ends of each link (a, b) become one."""
    if families is not None:
        links = links.union(families.select("node", "family"))
    return stage(components(links).withColumnRenamed("root", "family"), "families")


def _outside(nodes: DataFrame, lists: DataFrame, families: DataFrame, threshold: float, k: int, trees: int,
             rounds: int, first_tree: int) -> DataFrame:
    """Families joined by links that saturated lists leave out.

    A link is left out only when it is in neither list, so both ends are
    saturated. Each search keeps every such vector's ``k`` best of other
    families; it ends when none of them is a link or one family is left.
    """
    full = lists.where((F.size("near") >= k) & (F.element_at("near", -1)["sim"] >= threshold))
    full = stage(full.select(F.col("src").alias("node")), "saturated")
    inner = lists.join(full, lists["src"] == full["node"], "left_semi")
    while True:
        held = stage(nodes.select("node", "v").join(full, "node").join(families, "node"), "outside-vectors")
        count, several = held.agg(F.count(F.lit(1)), F.min("family") != F.max("family")).first()
        if not several:
            return families
        found = stage(_lists(_leaves(held, _bits(count), range(first_tree, first_tree + trees), k), k), "outside-lists")
        for _ in range(rounds):
            found = stage(_lists(_refine(held, found, k, inner).unionByName(_flat(found)), k), "outside-lists")
        links = _near(found, threshold)
        if links.isEmpty():
            return families
        families, first_tree = _joined(families, links), first_tree + trees


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 12, trees: int = 6, rounds: int = 2,
                    target: float = 0.99, sample: int = 200, attempts: int = 4, linked: int = 100) -> DataFrame:
    """vec_id, n_links, component_id and kept per row of ``vectors`` (vec_id, embedding).

    Vectors of one length are compared by cosine in double precision. Vectors
    that are null, empty, zero or hold null or non-finite values link with
    nothing. Equal rows count as links of each other. The component is the least
    id reached by links, null where all ids are null. An empty table gives an
    empty table; extra columns are ignored. Up to ``attempts`` graphs of ``trees``
    trees are built until the audited recall reaches ``target``; if none does, every
    vector is compared with all rows. The audit wants ``linked`` vectors with 1 to
    ``k`` links: a table that holds fewer is compared wholly, too.
    """
    nodes = stage(vector_nodes(vectors), "vectors")
    total = nodes.count()
    alone = nodes.withColumn("family", F.col("node"))
    lists, families = None, None
    for attempt in range(attempts):
        fresh = _leaves(alone, _bits(total), range(attempt * trees, (attempt + 1) * trees), k)
        if lists is not None:
            fresh = fresh.unionByName(_flat(lists))
        lists = stage(_lists(fresh, k), "lists")
        for _ in range(rounds):
            lists = stage(_lists(_refine(alone, lists, k).unionByName(_flat(lists)), k), "lists")
        families = _joined(families, _near(lists, threshold))
        families = _outside(nodes, lists, families, threshold, k, trees, rounds, trees * attempts)
        recall, families, whole = _audit(nodes, families, threshold, k, sample, linked, total)
        if recall >= target or whole:
            break
    else:
        families = _audit(nodes, families, threshold, k, CHUNK, float("inf"), total)[1]
    links = _family_links(nodes, families, threshold)
    least = families.join(nodes, "node").groupBy("family").agg(F.min("rep").alias("component"))
    named = stage(nodes.join(families.join(least, "family"), "node", "left").join(links, "node", "left").select(
        "v", "rep", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component")), "named")
    return _rows(vectors, named)


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("src", F.explode("near").alias("e")).select("src", "e.dst", "e.sim")


def _rows(vectors: DataFrame, named: DataFrame) -> DataFrame:
    e = F.col("embedding")
    top = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))
    scaled = F.transform(e, lambda x: (x.cast("double") + 0.0) / top)
    out = vectors.select("vec_id", F.when(top > 0, scaled).alias("w"))
    out = out.join(named, F.col("w") == F.col("v"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
