"""Ranked lexical search: branch and bound over tries of the documents' term vectors.

The first pass reads every whole text once and writes, per document, its number of terms and the
vector of those terms that any item asks for. From these come the corpus counts. The second pass
reads the vectors in shards: a shard's vectors, their terms ordered by falling document frequency,
share the paths of a trie (an FP-tree); documents of one vector and one length share its end. A
node's subtree is a range of the sorted vectors; it knows the largest tf of every term and the
smallest m inside, which bound every score below it. Each item walks the trie depth first and leaves
out the subtrees whose bound is below its tenth best score so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.llm.lexicon import BLOCK_BYTES, Lexicon, Words, item_blocks, stretches
from stationflow.llm.text import documents
from stationflow.session import settle

#: Ranks of an item's list.
BEST = 10
#: Bytes of text read at a time, and terms and documents of a shard of vectors.
PART_BYTES = 8 << 20
SHARD_TERMS = 1 << 20
SHARD_DOCUMENTS = 1 << 13
#: Vectors whose scores are computed together, and numbers a shard's tf maxima may take.
LEAF_VECTORS = 32
MAXIMA = 1 << 23


# --- vectors -----------------------------------------------------------------


def restricted_vectors(rows: DataFrame, lexicon) -> DataFrame:
    """``id, n`` (terms of the whole text), ``terms, tfs``: those of the lexicon and how often."""
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lexicon.value
        for whole in batches:
            for low, high in stretches(whole.column("text"), PART_BYTES):
                batch = whole.slice(low, high - low)
                words = Words(batch.column("text"))
                counts = np.diff(words.starts)
                codes = held.look_up(words).astype(np.int64)
                text = np.repeat(np.arange(len(counts)), counts)[codes > 0]
                base = len(held) + 1
                found, tfs = np.unique(text * base + codes[codes > 0], return_counts=True)
                ends = np.cumsum(np.bincount(found // base, minlength=len(counts)))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.record_batch(
                    [
                        batch.column("id"),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(found % base, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                    ],
                    names=["id", "n", "terms", "tfs"],
                )

    return rows.mapInArrow(read, f"id {kind}, n bigint, terms array<int>, tfs array<int>")


# --- items -------------------------------------------------------------------


class Queries:
    """A block of items as sets of terms, and the weights of the corpus."""

    def __init__(self, lexicon: Lexicon, df: dict[int, int], n_documents: int, n_terms: int):
        ends = lexicon.starts
        self.terms = [
            np.unique(lexicon.codes[a:b]).astype(np.int64) for a, b in zip(ends[:-1], ends[1:])
        ]
        self.n_documents, self.n_terms = n_documents, n_terms
        self.weight = np.zeros(len(lexicon) + 1, np.int64)
        for code in range(1, len(lexicon) + 1):
            ratio = (2 * n_documents + 2) / (2 * df.get(code, 0) + 1)
            self.weight[code] = math.floor(1000 * math.log(ratio))
        # falling document frequency, for the order of a vector's terms
        order = sorted(range(1, len(lexicon) + 1), key=lambda c: (-df.get(c, 0), c))
        self.rank = np.zeros(len(lexicon) + 1, np.int64)
        self.rank[order] = np.arange(1, len(lexicon) + 1)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms."""
        return 10 + 90 * n * self.n_documents // max(self.n_terms, 1)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds: grows with tf, falls with m."""
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 8 * m, 1)


# --- the trie ----------------------------------------------------------------


class Trie:
    """A shard's distinct vectors in the order of their paths, and the subtrees above them.

    ``first, last`` are a node's range of vectors, ``inner`` its children (none: a leaf, whose
    vectors are scored together). ``most[t, node]`` is the largest tf of term t below the node,
    ``least`` the smallest m.
    """

    def __init__(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms, tfs, queries: Queries):
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        by_path = np.lexsort((queries.rank[terms], text))
        path = queries.rank[terms[by_path]].astype(">u4").tobytes()
        often = tfs[by_path].astype(">u4").tobytes()
        names = [
            (path[4 * (b - s) : 4 * b], often[4 * (b - s) : 4 * b], k)
            for b, s, k in zip(ends.tolist(), sizes.tolist(), n.tolist())
        ]
        # documents of one vector and length end at one place; the least ids of them can be ranked
        same: dict[tuple, list[int]] = {}
        for i, name in enumerate(names):
            if name[0]:
                same.setdefault(name, []).append(i)
        ordered = sorted(same)
        self.ids = [sorted((ids[i] for i in same[name]), key=id_order)[:BEST] for name in ordered]
        self.paths = [np.frombuffer(name[0], ">u4") for name in ordered]
        self.m = queries.lengths(np.array([name[2] for name in ordered], np.int64))
        self.ends = np.cumsum([len(p) for p in self.paths], dtype=np.int64)
        code = np.argsort(queries.rank)  # rank -> code; code 0 has rank 0
        self.terms = code[np.concatenate(self.paths).astype(np.int64)] if ordered else np.zeros(0, np.int64)
        self.tfs = (
            np.frombuffer(b"".join(name[1] for name in ordered), ">u4").astype(np.int64)
        )
        units = max(1, MAXIMA // max(len(queries.weight), 1))
        self.leaf = max(LEAF_VECTORS, 4 * len(ordered) // units)
        self.first: list[int] = []
        self.last: list[int] = []
        self.inner: list[list[int]] = []
        self.root = self._grow(0, len(ordered)) if ordered else None
        if ordered:
            self._bound(len(queries.weight))

    def _node(self, low: int, high: int) -> int:
        self.first.append(low), self.last.append(high), self.inner.append([])
        return len(self.first) - 1

    def _grow(self, low: int, high: int) -> int:
        """The node over a range of vectors and, below it, one for each way its path goes on.

        Neighbouring ways with few vectors are one leaf.
        """
        top = self._node(low, high)
        open_ = [(top, low, high, 0)]
        while open_:
            node, low, high, depth = open_.pop()
            if high - low <= self.leaf:
                continue
            one, other = self.paths[low][depth:], self.paths[high - 1][depth:]
            short = min(len(one), len(other))
            differ = np.flatnonzero(one[:short] != other[:short])
            depth += int(differ[0]) if len(differ) else short  # the path all of them share
            ways = np.array(
                [p[depth] if len(p) > depth else 0 for p in self.paths[low:high]], np.int64
            )
            cuts = [low, *(low + 1 + np.flatnonzero(ways[1:] != ways[:-1])).tolist(), high]
            begin = low
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > self.leaf and (a > low or b < high):
                    if begin < a:
                        self._leaves(node, begin, a)
                    child = self._node(a, b)
                    self.inner[node].append(child)
                    open_.append((child, a, b, depth))
                    begin = b
            if begin < high:
                self._leaves(node, begin, high)
        return top

    def _leaves(self, node: int, low: int, high: int) -> None:
        for at in range(low, high, self.leaf):
            self.inner[node].append(self._node(at, min(at + self.leaf, high)))

    def _bound(self, n_codes: int) -> None:
        self.most = np.zeros((n_codes, len(self.first)), np.int32)
        self.least = np.zeros(len(self.first), np.int64)
        # children follow their parents
        for node in range(len(self.first) - 1, -1, -1):
            low, high = self.first[node], self.last[node]
            self.least[node] = self.m[low:high].min()
            if self.inner[node]:
                self.most[:, node] = self.most[:, self.inner[node]].max(axis=1)
            else:
                a = int(self.ends[low] - len(self.paths[low]))
                b = int(self.ends[high - 1])
                np.maximum.at(self.most[:, node], self.terms[a:b], self.tfs[a:b].astype(np.int32))

    def search(self, wanted: np.ndarray, queries: Queries, best: list) -> list:
        """The best of a list of ``(-score, id)`` and of this shard for a set of terms."""
        if self.root is None or not len(wanted):
            return best
        weight = queries.weight[wanted]
        bound = (weight[:, None] * saturated(self.most[wanted].astype(np.int64), self.least)).sum(axis=0)
        table = np.zeros(len(queries.weight), np.int64)
        table[wanted] = weight
        limits = bound.tolist()
        open_ = [self.root]
        while open_:
            node = open_.pop()
            needed = -best[-1][0] if len(best) == BEST else 1
            if limits[node] < needed:
                continue
            if self.inner[node]:
                # the child of the highest bound is next
                open_ += sorted(self.inner[node], key=limits.__getitem__)
            else:
                best = self._score(node, table, needed, best)
        return best

    def _score(self, node: int, table: np.ndarray, needed: int, best: list) -> list:
        low, high = self.first[node], self.last[node]
        a, b = int(self.ends[low] - len(self.paths[low])), int(self.ends[high - 1])
        weight = table[self.terms[a:b]]
        hit = np.flatnonzero(weight)
        own = np.searchsorted(self.ends[low:high], hit + a, "right")
        added = weight[hit] * saturated(self.tfs[a:b][hit], self.m[low:high][own])
        scores = np.zeros(high - low, np.int64)
        np.add.at(scores, own, added)
        for i in np.flatnonzero(scores >= needed).tolist():
            best = best + [(-int(scores[i]), key) for key in self.ids[low + i]]
        return sorted(best, key=lambda x: (x[0], id_order(x[1])))[:BEST]


def id_order(key):
    """Ids ascending, a null id after all others."""
    return (key is None, 0 if key is None else key)


# --- search ------------------------------------------------------------------


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Vectors of the batches, gathered to shards of bounded documents and terms."""
    held, n_terms, n_docs = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        ends = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            before = int(ends[low] - sizes[low])
            high = int(np.searchsorted(ends, before + SHARD_TERMS - n_terms, "right"))
            high = min(max(high, low + (not held)), low + SHARD_DOCUMENTS - n_docs)
            if high > low:
                held.append(batch.slice(low, high - low))
                n_terms, n_docs = n_terms + int(ends[high - 1]) - before, n_docs + high - low
                low = high
            if low < batch.num_rows:
                yield held
                held, n_terms, n_docs = [], 0, 0
    if held:
        yield held


def _trie(held: list[pa.RecordBatch], queries: Queries) -> Trie:
    table = pa.Table.from_batches(held).combine_chunks()
    lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
    terms, tfs = (x.flatten().to_numpy().astype(np.int64) for x in lists)
    sizes = np.diff(lists[0].offsets.to_numpy()).astype(np.int64)
    return Trie(table.column("id").to_pylist(), table.column("n").to_numpy(), sizes, terms, tfs, queries)


def _best_of_tasks(vectors: DataFrame, queries, kind: str) -> DataFrame:
    """``item, score, id``: of every task its best documents for each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best: list[list] = [[] for _ in asked.terms]
        id_type = None
        for held in _shards(batches):
            id_type = held[0].schema.field("id").type
            trie = _trie(held, asked)
            for i, terms in enumerate(asked.terms):
                best[i] = trie.search(terms, asked, best[i])
        rows = [(i, -score, key) for i, found in enumerate(best) for score, key in found]
        if rows:
            items, scores, keys = zip(*rows)
            yield pa.record_batch(
                [pa.array(items, pa.int64()), pa.array(scores, pa.int64()), pa.array(keys, id_type)],
                names=["item", "score", "id"],
            )

    return vectors.mapInArrow(search, f"item bigint, score bigint, id {kind}")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ten documents of the highest score above 0.

    Equal scores go by ascending id, null ids last; repeated rows of a document are ranked each. A
    null or empty text has no terms and is not counted as a document. Repeated items count once; an
    item without terms, or whose terms no document holds, has no rows, as have all items without
    documents. Other columns are not read. Documents are read once per block of items; a task reports
    ten rows per item at most.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    name = items.schema[item_id].dataType.simpleString()
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        lexicon = Lexicon(pa.array([text for _, text in block], pa.large_string()))
        vectors = settle(restricted_vectors(rows, context.broadcast(lexicon)))
        totals = vectors.agg(
            F.count_if(F.col("n") > 0).alias("documents"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("terms"),
        ).head()
        counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
        # one row per term of the block
        df = {row["term"]: row["count"] for row in counted.collect()}
        queries = Queries(lexicon, df, totals["documents"], totals["terms"])
        found = _best_of_tasks(vectors, context.broadcast(queries), kind)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
        names = spark.createDataFrame(
            [(i, key) for i, (key, _) in enumerate(block)], f"item bigint, item_id {name}"
        )
        own = ranked.join(names, "item").select(
            "item_id", "rank", F.col("id").alias(id_column), "score"
        )
        out = own if out is None else out.unionByName(own)
    return out


def ranked_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


RANKED_SEARCH_SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), s AS (
    SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0
), b AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), t AS (
    SELECT row, term, count(*) AS tf
    FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM b)
    GROUP BY row, term
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s
), m AS (
    SELECT row, doc_id, 10 + CAST((90 * len(terms) * n_docs) // n_terms AS BIGINT) AS m FROM d, s
), r AS (
    SELECT item_id, row, doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM b JOIN w USING (term) JOIN t USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM r WHERE score > 0)
WHERE rank <= 10
"""
