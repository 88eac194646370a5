"""Source divergence audit with count-level bitmaps.

Terms of a language are numbered, frequent ones first, in blocks of 64. A group
(language and source) stores one bitset of term ids per block and count. The AND
of two groups' bitsets and its popcount give the number of terms that have both
counts; times the difference f of the two probabilities, which depends only on
the counts, it is that cell's share of the pair's divergence. The terms that a
group lacks are the complement of its bitsets. Neighbouring ids have similar
counts, so that a block of rare terms has few levels.

Everything before the bitmaps is counted once per slice of texts and then summed
by (language, source, term), so a hot source or language is spread by its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import ship, slices, stage, text_buffer
from orderpulse.llm.terms import Cut, encode

SPAN = 512  # terms of one task of a pair of tiles: 8 blocks of 64
TILE = 64  # sources of a tile, about

_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=1 << 20):  # fewer partial counts
            cut = Cut(*text_buffer(b.column(0)), _LETTERS)
            if not len(cut.words):
                continue
            code, words = encode(cut.words)
            langs, sources = (b.column(i).dictionary_encode() for i in (1, 2))
            n_words, n_sources = len(words), len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
            key, n = np.unique(group[cut.row] * n_words + code, return_counts=True)
            per_doc = np.unique(cut.row * n_words + code)
            _, docs_ = np.unique(group[per_doc // n_words] * n_words + per_doc % n_words, return_counts=True)
            g = key // n_words
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(g // n_sources)), sources.dictionary.take(pa.array(g % n_sources)),
                 words.take(pa.array(key % n_words)).cast(pa.string()), pa.array(n), pa.array(docs_)],
                ["lang", "source", "term", "n", "docs"])

    part = docs.select("text", "lang", "source").mapInArrow(
        run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(kept: DataFrame, parts: int) -> DataFrame:
    """``kept`` (lang, term, total, ...) with ``span`` and ``pos``: per language, spans of
    up to SPAN terms of similar frequency. Spans start anew at a language and at a
    partition of the range partitioning."""
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, lang, done = TaskContext.get().partitionId() << 32, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column(names.index("lang")).dictionary_encode()
            codes = values.indices.to_numpy()
            begin = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))
            span, pos = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int32)
            for lo, hi in zip(begin[:-1], begin[1:]):
                here = values.dictionary[codes[lo]].as_py()
                if here != lang:
                    base, lang, done = base + -(-done // SPAN), here, 0
                at = done + np.arange(hi - lo)
                span[lo:hi], pos[lo:hi] = base + at // SPAN, at % SPAN
                done += hi - lo
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(span), pa.array(pos)], [*names, "span", "pos"])

    order = [F.col("lang"), F.desc("total"), F.col("term")]
    dealt = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
                            + ", span long, pos int")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(18,0)")
    below = (total + 5 * terms).cast("decimal(20,0)")
    return F.call_function("div", top, below) + 1


def _joint(f: pd.DataFrame) -> pd.DataFrame:
    """Sums over the joint cells of each pair of sources, one of either tile, in one span.

    Rows with block -1 state the sources: ``p`` at count 0, ``bits`` the terms of the span.
    """
    same = f["i"].iloc[0] == f["j"].iloc[0]
    heads = f[f["block"] < 0].sort_values("source")
    names, p0 = heads["source"].to_numpy(), heads["p"].to_numpy()
    first = (heads["own"] == heads["i"]).to_numpy()
    size = int(heads["bits"].iloc[0])
    rows = f[f["block"] >= 0]
    who = np.searchsorted(names, rows["source"].to_numpy())
    order = np.lexsort((who, rows["block"].to_numpy()))
    who, block = who[order], rows["block"].to_numpy()[order]
    p, bits = rows["p"].to_numpy()[order], rows["bits"].to_numpy()[order].view(np.uint64)
    total = np.zeros((len(names), len(names)), np.int64)
    for k in range(-(-size // 64)):
        lo, hi = np.searchsorted(block, [k, k + 1])
        wide = min(64, size - 64 * k)
        rest = np.full(len(names), (1 << wide) - 1, np.uint64)
        np.bitwise_xor.at(rest, who[lo:hi], bits[lo:hi])  # the levels are disjoint: what is left has count 0
        w = np.concatenate([who[lo:hi], np.arange(len(names))])
        o = np.argsort(w, kind="stable")
        w, q, x = w[o], np.concatenate([p[lo:hi], p0])[o], np.concatenate([bits[lo:hi], rest])[o]
        at = np.searchsorted(w, np.arange(len(names) + 1))
        for a in np.flatnonzero(first):
            mine = slice(at[a], at[a + 1])
            theirs = slice(at[a + 1] if same else 0, None)
            if at[a + 1] == len(w) and same:
                continue
            cells = np.bitwise_count(x[mine, None] & x[None, theirs]).astype(np.int64)
            value = (cells * np.abs(q[mine, None] - q[None, theirs])).sum(axis=0)
            start = at[a + 1:-1] - at[a + 1] if same else at[:-1]
            total[a, a + 1 if same else 0:] += np.add.reduceat(value, start)
    a, b = np.nonzero(np.triu(np.ones_like(total, bool), 1) if same else first[:, None] & ~first[None, :])
    return pd.DataFrame({"lang": f["lang"].iloc[0], "a": names[a], "b": names[b], "value": total[a, b]})


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank for every group of ``docs`` (text, lang, source).

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a
    language keeps those in at least ``min_docs`` of its documents. Part ``pair``
    ranks the other sources of the language by the summed difference of the term
    probabilities, part ``term`` the ``top`` terms that the group uses more than
    its language does. Ranks go by value, the largest first, then by the item's
    UTF-8 bytes.

    Null text, lang and source count as ''. Empty texts, and groups without a term,
    have their pairs and no term. Repeated rows count each; very long texts count
    whole. An empty table gives an empty table; further columns are ignored.
    """
    ship(docs.sparkSession)
    empty = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(c), empty).alias(c) for c in ("text", "lang", "source")])
    counts = stage(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_docs).drop("docs")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = stage(numbered(kept, parts), "term-ids")
    langs = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    used = counts.drop("docs").join(ids, ["lang", "term"])
    group_n = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = stage(
        docs.select("lang", "source").distinct().join(group_n, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["group_n", "lang_n", "terms"])
        .join(docs.groupBy("lang").agg(F.count_distinct("source").alias("n_sources")), "lang"), "groups")
    tiles = F.ceil(F.col("n_sources") / TILE).cast("int")
    groups = groups.withColumn("tiles", tiles).withColumn(
        "own", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).drop("n_sources")
    used = stage(used.join(groups, ["lang", "source"]).withColumns({
        "p": probability(F.col("n"), F.col("group_n"), F.col("terms")),
        "q": probability(F.col("total"), F.col("lang_n"), F.col("terms"))}), "term-groups")

    levels = used.groupBy("lang", "source", "span", F.floor(F.col("pos") / 64).cast("int").alias("block"), "p").agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"),
        F.first("own").alias("own"), F.first("tiles").alias("tiles"))
    spans = ids.groupBy("lang", "span").agg(F.count(F.lit(1)).alias("bits"))
    heads = groups.join(spans, "lang").select(
        "lang", "source", "span", F.lit(-1).alias("block"),
        probability(F.lit(0), F.col("group_n"), F.col("terms")).alias("p"), "bits", "own", "tiles")
    dealt = levels.unionByName(heads).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "lang", "source", "span", "block", "p", "bits", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cells = dealt.groupBy("lang", "span", "i", "j").applyInPandas(_joint, "lang string, a string, b string, value long")
    sums = cells.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select(
        "lang", "x.source", "x.item", "value")
    bare = groups.where("terms = 0").select("lang", "source")  # languages that keep no term
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select(
        "lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = pairs.union(none).withColumn("rank", F.row_number().over(order))
    term_part = used.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pair_part.withColumn("part", F.lit("pair")).select(*out).union(
        term_part.withColumn("part", F.lit("term")).select(*out))
