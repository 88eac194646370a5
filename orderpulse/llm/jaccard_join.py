"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct word shingles ("tokens"). Two sets of Jaccard
similarity ``num/den`` or more share so many tokens that, in any one global order
of the tokens, the first ``n - ceil(t n) + m`` tokens of both (their prefixes)
share at least ``m``. The order here puts rare tokens first.

Signatures of a prefix:

* a rare token (at most ``FREQUENT`` sets) alone;
* frequent tokens only in combinations of two. They fall into ``g`` classes by
  hash and prefixes are extended to ``m = g + 1``: either a shared token is rare,
  or two shared frequent ones are in one class. ``g`` follows the size of the set,
  in steps; a set signs for its own step and the next, so that similar sets of
  neighbouring steps meet.

Document frequencies are counted for a fixed part of the tokens, chosen by hash
(2.5 times the share a prefix needs); those come first in the order, by
frequency, the rest follow by hash. Any global order gives the same result.

Verification is exact. Sets that meet under a signature of few sets are compared
pair by pair. Sets that meet under a signature of more (families of copies) are
first compared with two of its sets, which joins most of a family in proportion to
its size. Only where components still meet under such a signature, the sets are
split into blocks, and pairs of blocks are compared in one task by the incidence of
their tokens, without those of two blocks of the same component; a task returns a
spanning forest of its links, never the pairs. Equal sets are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import Words, held, mix, ship, slices, small_side, stage, text_buffer
from orderpulse.llm.components import components

FREQUENT = 64  # sets: a token or signature of more is frequent
BLOCK = 512  # sets of a block in a family
BLOCK_SHINGLES = 250_000  # and their shingles: a task holds two blocks at a time
_CLASS_TOKENS = 12  # frequent tokens of a prefix that one class should hold
_NODE = np.uint64(0x9E6C63D0876A9A35)


class Sets:
    """Distinct shingles of each text of a slice, flattened: ``hash``, ``row``, ``at`` (row offsets)."""

    def __init__(self, col: pa.Array, words: int):
        w = Words(*text_buffer(col), lower=True)
        rows = len(w.n_words)
        owner = np.repeat(np.arange(rows), w.n_words)
        gram, valid = w.grams(words)
        gram, owner = gram[valid], owner[valid]
        short = np.flatnonzero((w.n_words > 0) & (w.n_words < words))
        if len(short):  # the whole sequence as one shingle
            whole = [_sequence(w.hash[w.row0[i]:w.row0[i + 1]]) for i in short]
            gram = np.concatenate([gram, np.array(whole, np.uint64)])
            owner = np.concatenate([owner, short])
        order = np.lexsort((gram, owner))
        gram, owner = gram[order], owner[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        self.hash, self.row = gram[new], owner[new]
        self.at = np.searchsorted(self.row, np.arange(rows + 1))
        self.n = np.diff(self.at)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(mix(self.hash ^ _NODE), out=sums[1:])
        self.node = mix(sums[self.at[1:]] - sums[self.at[:-1]] + mix(self.n.astype(np.uint64)))

    def per_set(self, mask: np.ndarray) -> np.ndarray:
        """Marked shingles of each text."""
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[self.at])


def _sequence(words: np.ndarray) -> int:
    h = len(words)
    for x in words.tolist():
        h = (h * 0x5851F42D4C957F2D + x) & (2**64 - 1)
    return int(mix(np.array([h], np.uint64))[0])


class Rule:
    """The similarity bound num/den and what it means for prefixes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.least = -(-num // (den - num))  # sets smaller than this only link with equal sets
        self.share = min(1.0, 2.5 * (den - num) / den)
        self.sampled = np.uint64(min(2**64 - 1, int(self.share * 2**64)))

    def step(self, n: np.ndarray) -> np.ndarray:
        """Size steps: similar sets are in equal or neighbouring steps."""
        return np.floor(np.log(np.maximum(n, 1)) / math.log(self.den / self.num) + 1e-9).astype(np.int64)

    def classes(self, step: np.ndarray) -> np.ndarray:
        """Classes of frequent tokens for sets of a size step."""
        top = (self.den / self.num) ** (step + 1.0)
        return np.maximum(1, np.ceil(top * (1 - self.num / self.den) / _CLASS_TOKENS)).astype(np.int64)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        need = n + self.num * -n // self.den + 1 + self.classes(self.step(n) + 1)
        return np.minimum(n, need)


def nodes(docs: DataFrame, words: int, rule: Rule) -> DataFrame:
    """(doc_id, hash, node, n, counted) per row.

    ``node`` names the set, null when it is empty; ``counted`` of its ``n`` tokens
    take part in the counting of frequencies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        for b in slices(batches):
            s = Sets(b.column(1), words)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s.node.view(np.int64), mask=s.n == 0),
                 pa.array(s.n.astype(np.int64)), pa.array(s.per_set(s.hash < rule.sampled))],
                ["doc_id", "hash", "node", "n", "counted"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(
        run, "doc_id long, hash long, node long, n long, counted long")


def tokens(docs: DataFrame, words: int, rule: Rule) -> DataFrame:
    """(token, node): the tokens that may stand in a prefix; equal sets of a task sign once.

    The lowest bit of ``token`` is 1 when it stands in the order by hash, after
    the counted ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        seen: set[int] = set()
        for b in slices(batches):
            s = Sets(b.column(1), words)
            counted = s.hash < rule.sampled
            # tokens are in hash order within a set, counted ones first
            rank = np.arange(len(s.hash)) - s.at[:-1][s.row]
            use = counted | (rank < rule.prefix(s.n)[s.row])
            fresh = s.n >= rule.least
            for i in np.flatnonzero(fresh):
                x = int(s.node[i])
                fresh[i] = x not in seen
                if len(seen) < 200_000:
                    seen.add(x)
            use &= fresh[s.row]
            token = (s.hash[use] & ~np.uint64(1)) | (~counted[use]).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(s.node[s.row[use]].view(np.int64))], ["token", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "token long, node long")


def _signatures(rule: Rule):
    """Signatures from the shared tokens of each set; the others are alone in their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, counted = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                seen = b.column(3)[i].values.to_numpy().view(np.uint64)
                df = b.column(4)[i].values.to_numpy()
                late = (seen & np.uint64(1)).astype(bool)
                order = np.lexsort((seen, np.where(late, 0, df), late))
                seen, df, late = seen[order], df[order], late[order]
                # counted tokens that no other set has come first in the order
                alone = counted - int((~late).sum())
                size = np.array([n])
                take = late | (alone + np.arange(len(seen)) < rule.prefix(size)[0])
                seen, df = seen[take], df[take]
                out, often = [seen[df <= FREQUENT]], seen[df > FREQUENT]
                step = int(rule.step(size)[0])
                for st in (step, step + 1):
                    cls = mix(often) % rule.classes(np.array([st])).astype(np.uint64)
                    for c in np.unique(cls):
                        m = np.sort(often[cls == c])
                        a, z = np.triu_indices(len(m), 1)
                        out.append(mix(m[a] + mix(m[z] + np.uint64(st))))
                sig = np.concatenate(out).view(np.int64)
                if len(sig):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig), pa.array(np.full(len(sig), b.column(0)[i].as_py(), np.int64)),
                         pa.array(np.full(len(sig), n, np.int64))], ["sig", "node", "n"])

    return run


def _forest(sets: list[np.ndarray], size: np.ndarray, name: np.ndarray, left: np.ndarray,
            rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets marked ``left`` and the others,
    or among all of them when none or all are marked."""
    flat = np.concatenate(sets)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = count[token] > 1
    token, owner = (np.cumsum(count > 1) - 1)[token[shared]], owner[shared]
    rows, cols = (np.flatnonzero(left), np.flatnonzero(~left))
    if not len(rows) or not len(cols):
        rows = cols = np.arange(len(sets))
    common = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    width = 2048
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, z = np.searchsorted(token, [lo, lo + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[a:z], token[a:z] - lo] = 1
        common += grid[rows] @ grid[cols].T
    common = common.astype(np.int64)
    link = rule.den * common >= rule.num * (size[rows][:, None] + size[cols][None, :] - common)
    edges: list[tuple[int, int]] = []
    if rows is cols:
        todo = np.ones(len(sets), bool)
        for root in range(len(sets)):
            front = [root] if todo[root] else []
            todo[root] = False
            while front:
                u = front.pop()
                new = np.flatnonzero(link[u] & todo)
                todo[new] = False
                edges += [(int(name[u]), int(name[v])) for v in new]
                front += new.tolist()
        return edges
    todo_r, todo_c = np.ones(len(rows), bool), np.ones(len(cols), bool)
    for root in range(len(rows)):
        front = [(True, root)] if todo_r[root] else []
        todo_r[root] = False
        while front:
            is_row, u = front.pop()
            new = np.flatnonzero(link[u] & todo_c) if is_row else np.flatnonzero(link[:, u] & todo_r)
            (todo_c if is_row else todo_r)[new] = False
            me = name[(rows if is_row else cols)[u]]
            edges += [(int(me), int(name[(cols if is_row else rows)[v]])) for v in new]
            front += [(not is_row, int(v)) for v in new]
    return edges


def candidates(docs: DataFrame, sets: DataFrame, words: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b) from signatures of few sets, (sig, node) from those of more."""
    found = tokens(docs, words, rule)
    df = stage(found.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token-df")
    shared = found.join(df, "token").groupBy("node").agg(
        F.collect_set(F.struct("token", "df")).alias("seen"))
    signed = sets.join(shared, "node").select("node", "n", "counted", "seen.token", "seen.df")
    sig = stage(signed.mapInArrow(_signatures(rule), "sig long, node long, n long"), "signatures")
    size = stage(sig.groupBy("sig").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "signature-sizes")
    big = stage(sig.join(size.where(F.col("met") > FREQUENT).select("sig"), "sig").select("sig", "node"), "big")
    few = stage(sig.join(size.where(F.col("met") <= FREQUENT).select("sig"), "sig"), "few")
    other = few.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"))
    small, large = F.least("n", "nb"), F.greatest("n", "nb")
    pairs = few.withColumnRenamed("node", "a").join(other, "sig").where(
        (F.col("a") < F.col("b")) & (rule.den * small >= rule.num * large)).select("a", "b").distinct()
    return pairs, big


def _shingles(wanted: DataFrame, words: int) -> DataFrame:
    """(node, set) of rows (text, node) whose text has the set named ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        for b in slices(batches):
            s = Sets(b.column(0), words)
            sets = pa.ListArray.from_arrays(pa.array(s.at.astype(np.int32)), pa.array(s.hash.view(np.int64)))
            out = pa.RecordBatch.from_arrays([b.column(1), sets], ["node", "set"])
            yield out.filter(pa.array(s.node.view(np.int64) == b.column(1).to_numpy()))

    return wanted.select("text", "node").mapInArrow(run, "node long, set array<long>")


def _full(docs: DataFrame, sets: DataFrame, nodes_: DataFrame, words: int) -> DataFrame:
    """(node, set) of the nodes named."""
    wanted = stage(nodes_.join(sets, "node").select("node", "rep"), "wanted")
    key = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    return stage(_shingles(docs.join(small_side(wanted), key == F.col("rep")), words), "sets")


def _verified(pairs: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    a = full.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    b = full.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(a, "a").join(b, "b").withColumn("common", common).where(
        rule.den * F.col("common") >= rule.num * (F.size("sa") + F.size("sb") - F.col("common")))
        .select("a", "b"))


def _rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """``rows`` with the component of a column's node, itself where it has none."""
    named = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    return rows.join(named, node, "left").withColumn(root, F.coalesce(root, node))


def linked_sets(docs: DataFrame, sets: DataFrame, words: int, rule: Rule) -> DataFrame:
    """(node, root) for every linked node: the components of all links."""
    pairs, big = candidates(docs, sets, words, rule)
    # under a signature of many sets each is compared with two of them first: a family of copies
    # is joined in proportion to its size
    hubs = big.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    stars = big.join(hubs, "sig").select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    stars = stage(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "stars")
    members = stage(big.select("node").distinct(), "members")
    full = _full(docs, sets, members, words)
    first = stage(_verified(stars, full, rule), "star-links")
    # pairs that both hang on one set are joined already
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                             F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    hung = stage(first.select(ends.alias("e")).select("e.*").groupBy("node").agg(
        F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "hung")
    pairs = _rooted(_rooted(pairs, hung, "a", "ra"), hung, "b", "rb").where("ra <> rb").select("a", "b")
    pairs = stage(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    more = _full(docs, sets, ends.join(members, "node", "left_anti"), words)
    near = stage(first.union(_verified(pairs, full.union(more), rule)), "near")

    # signatures under which two components still meet
    roots = stage(components(near), "roots")
    rooted = stage(_rooted(big, roots, "node", "root"), "rooted")
    apart = stage(rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                            F.min("node").alias("hub")).where("low <> high"), "open")
    if not apart.count():
        return roots
    left = rooted.join(apart.select("sig", "hub"), "sig")
    family = stage(components(left.select(F.col("hub").alias("a"), F.col("node").alias("b"))), "families")
    sized = stage(_rooted(family.withColumnRenamed("root", "family"), roots, "node", "root").join(
        sets.select("node", "n"), "node"), "family-sets")
    most = sized.groupBy("family", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("family").agg(
        F.max_by("root", F.struct("size", "root")).alias("most"))
    sized = sized.join(most, "family").withColumn("same", F.col("root") == F.col("most"))
    # the sets of a family's largest component are compared with the others only, never with each other
    count = lambda same: F.greatest(
        F.ceil(F.count_if(same) / BLOCK), F.ceil(F.sum(F.when(same, F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    blocks = sized.groupBy("family").agg(count(~F.col("same")).alias("others"), count(F.col("same")).alias("sames"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("same"), F.col("sames")).otherwise(F.col("others"))).cast("int")
    range_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda same, i, j: F.struct(F.lit(same).alias("across"), i.alias("i"), j.alias("j"))
    me = F.col("own")
    cells = F.when(F.col("same"), F.transform(range_("others"), lambda x: cell(True, x, me))).otherwise(F.concat(
        F.transform(range_("others"), lambda x: cell(False, F.least(me, x), F.greatest(me, x))),
        F.transform(range_("sames"), lambda x: cell(True, me, x))))
    dealt = (sized.join(blocks, "family").where("others > 0").withColumn("own", own)
             .select("node", "family", "same", "own", F.explode(cells).alias("cell"))
             .select("node", "family", "same", "own", "cell.*").join(full, "node"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        held("sets")
        f = f.drop_duplicates("node")
        across = bool(f["across"].iloc[0])
        one_side = (~f["same"] if across else f["own"] == f["i"]).to_numpy()
        edges = []
        if not across or 0 < one_side.sum() < len(f):
            sets_ = [np.asarray(x) for x in f["set"]]
            edges = _forest(sets_, np.array([len(x) for x in sets_]), f["node"].to_numpy(), one_side, rule)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    within = dealt.groupBy("family", "across", "i", "j").applyInPandas(compare, "a long, b long")
    return components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(within))


def join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z only) and cut into words; the set holds the
    distinct ``words``-word shingles, the whole sequence when there are fewer
    words. Rows whose sets have a Jaccard similarity of num/den or more are
    linked; the component is the least id reached by links. Rows without a word
    link with nothing and are their own component. Rows with a null id take part
    and never name a component (null when there is no other id). Repeated rows
    are one node; an empty table gives an empty table; extra columns are ignored.
    Sets and shingles are told apart by 64-bit hashes.
    """
    linked = _linked(docs, words, num, den)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _linked(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, hash, n, root, component_id) per row: hash of the text, size of the set, a
    name of the component (null without a word) and its least id."""
    ship(docs.sparkSession)
    rule = Rule(num, den)
    docs = docs.select("doc_id", "text")
    rows = stage(nodes(docs, words, rule), "rows")
    none = 2**63 - 1
    sets = stage(rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.coalesce(F.col("doc_id"), F.lit(none))).alias("rep"), F.max("n").alias("n"),
        F.max("counted").alias("counted")), "node-sets")
    linked = stage(linked_sets(docs, sets, words, rule), "linked")
    least = sets.join(linked, "node").groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("node", "root", "least")
    named = stage(sets.join(linked, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep").alias("least")), "named")
    return rows.join(named, "node", "left").select(
        "doc_id", "hash", "n", "node", "root",
        F.when(F.col("least") < none, F.col("least")).alias("component_id"))


def dedup(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of each component of ``join``, the one with the least id, all columns unchanged.

    Rows are told apart by id and text: of rows that share both one stays, whatever
    their other columns; another text under the id of a removed one is judged by its
    own component. Of the least id's texts in a component one stays. Rows without a
    word or without an id stay unless they repeat (null and empty texts differ).
    Whole texts are compared however long; an empty table gives an empty table, and
    further columns may have any name.
    """
    names = docs.columns
    cols = [f"c{i}" for i in range(len(names))]
    doc, text = (cols[names.index(c)] for c in ("doc_id", "text"))
    rows = stage(_linked(docs, words, num, den).where("doc_id is not null and node is not null").select(
        "doc_id", "hash", "root", (F.col("doc_id") == F.col("component_id")).alias("least")).distinct(), "linked-rows")
    first = rows.where("least").groupBy("root").agg(F.min("hash").alias("first"))
    losers = rows.join(first, "root", "left").where("not least or hash <> first").select("doc_id", "hash")
    losers = stage(losers, "losers")
    body = docs.toDF(*cols).withColumn("h", F.xxhash64(text)).withColumn("no_text", F.col(text).isNull())
    left = body.join(losers, (F.col("doc_id") == F.col(doc)) & (F.col("hash") == F.col("h")), "left_anti")
    return left.dropDuplicates([doc, "h", "no_text"]).select(*cols).toDF(*names)
