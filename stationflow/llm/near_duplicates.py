"""Near duplicates by an LSH forest over MinHash signatures.

Every text is a set of word shingles. Texts with equal sets are one class; its signature holds
512 minima. Each tree of the forest sorts the classes by its own sequence of minima: classes that
agree on the first three are a region, and inside a region the order goes on with further values,
so classes with the longest common prefix are neighbours. A region that is too large is cut where
the prefix becomes longer, deeper only where needed. In the pieces signatures are compared.

Links are found in three passes. The first confirms each class's best neighbours in its piece on
the full sets and joins what is linked. The others compare, in the regions that still hold several
components, every pair from different components, whatever the region's size and wherever it was
cut: the classes outside a region's largest component visit all its blocks. The second confirms a
visitor's likeliest partner of each component in a block, the third every pair that is then still
between components and that the signatures do not rule out. A family of thousands of near copies
is thus linked by few confirmed pairs, and no region is too large to be compared as a whole.

Pairs never leave their block: the signatures tell which classes have a likely partner there, only
these classes' full sets travel, and the block returns the links that join its components, fewer
than it holds classes. A family whose members all resemble each other a little too little costs
comparisons that grow with its square, but no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.llm.components import components
from stationflow.llm.lexicon import stretches
from stationflow.llm.shingles import mix, shingle_sets
from stationflow.llm.text import documents, spare_name, tables_of
from stationflow.session import settle

#: Per cent of the union that two sets must share, and what the query asks for.
LEAST_PERCENT = 80
QUERY_PERCENT = 85
SEED = 11
#: Minima of a signature (each kept as one byte), trees, and minima that make a region.
MINIMA = 512
TREES = 14
PREFIX = 3
#: Values that order a region.
DEPTH = 16
#: Classes of one piece of a region; larger ones are cut at a longer common prefix. Also the
#: classes of a block, on average, when whole regions are compared.
PIECE = 512
#: Bytes of text whose shingles are held together; a longer text is alone.
PART_BYTES = 2 << 20
#: Bytes of the full sets of a block's classes, on average.
BLOCK_BYTES = 32 << 20
#: Classes of one region held at once in the first pass; a longer one goes on with the last piece.
HELD = 32 * PIECE
#: Estimates so many standard errors below the limit rule a pair out.
ERRORS = 4
#: Bits of the filter that spares reading texts without partners; its size never grows.
FILTER_BITS = 24


def least_estimate(percent: int) -> float:
    """The share of equal minima below which a pair is not compared in full."""
    share = percent / 100
    return share - ERRORS * (share * (1 - share) / MINIMA) ** 0.5


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 63, MINIMA).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 1 << 63, MINIMA).astype(np.uint64)


def _minima(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 256):
        part = shingles[start : start + 256, None] * factors + shifts
        np.minimum(least, part.min(axis=0), out=least)
    return least


def class_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    one = mix(shingles)
    two = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    n = np.uint64(len(shingles))
    parts = np.array([one.sum(dtype=np.uint64) + n, two.sum(dtype=np.uint64)], np.uint64)
    return parts.astype(">u8").tobytes()


def sketches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per row ``id, n_shingles, class``, and the class's ``signature`` and ``regions``."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _functions()
        tables_of("near duplicates")
        for whole in batches:
            for low, high in stretches(whole.column("text"), PART_BYTES):
                batch = whole.slice(low, high - low)
                sets = shingle_sets(batch.column("text"))
                names, signatures, regions = [], [], []
                for shingles in sets:
                    if not len(shingles):
                        names.append(None), signatures.append(None), regions.append(None)
                        continue
                    least = _minima(shingles, factors, shifts)
                    names.append(class_of(shingles))
                    signatures.append((mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
                    prefix = least[: TREES * PREFIX].reshape(TREES, PREFIX)
                    key = mix(prefix[:, 0])
                    for place in range(1, PREFIX):
                        key = mix(key ^ prefix[:, place])
                    regions.append(key.view(np.int64).tolist())
                yield pa.record_batch(
                    [
                        batch.column("id"), pa.array(map(len, sets), pa.int64()),
                        pa.array(names, pa.binary()), pa.array(signatures, pa.binary()),
                        pa.array(regions, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "class", "signature", "regions"],
                )

    return rows.mapInArrow(
        sketch,
        f"id {kind}, n_shingles bigint, class binary, signature binary, regions array<bigint>",
    )


def _pieces(deep: np.ndarray, low: int, high: int, depth: int = 0) -> list[tuple[int, int]]:
    """Cut rows ``low`` to ``high`` of a region, in its order, into pieces of bounded size."""
    if high - low <= PIECE:
        return [(low, high)] if high - low > 1 else []
    if depth == deep.shape[1]:
        # equal on every value: neighbours in pieces that overlap by half
        step = PIECE // 2
        return [(at, min(at + PIECE, high)) for at in range(low, high - step, step)]
    values = deep[low:high, depth]
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [low, *(low + cuts).tolist(), high]
    return [p for a, b in zip(edges, edges[1:]) for p in _pieces(deep, a, b, depth + 1)]


def _agreement(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs of two sets of signatures."""
    same = np.empty((len(some), len(others)), np.float32)
    block = max(1, (1 << 22) // (max(len(others), 1) * MINIMA))
    for start in range(0, len(some), block):
        part = some[start : start + block, None, :] == others[None, :, :]
        same[start : start + block] = part.sum(axis=2, dtype=np.int32)
    return (same / MINIMA - 1 / 256) / (1 - 1 / 256)


def _candidates(
    signatures: np.ndarray, deep: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Each row's two best partners in its piece of one region, if they are worth confirming."""
    left, right = [], []
    least = least_estimate(percent)
    for low, high in _pieces(deep, 0, len(signatures)):
        likely = _agreement(signatures[low:high], signatures[low:high])
        np.fill_diagonal(likely, -1)
        for _ in range(2):
            best = likely.argmax(axis=1)
            rows = np.flatnonzero(likely[np.arange(high - low), best] >= least)
            left.append(low + rows)
            right.append(low + best[rows])
            likely[rows, best[rows]] = -1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _pair_batch(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())],
        names=["u", "v"],
    )


def candidate_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``u, v`` of neighbouring classes from ``tree, region, class, signature``.

    The orders of all trees are one range sort, so a region of any size is spread over tasks. What
    a piece or a task boundary cuts is left to ``pairs_between``.
    """
    deep = F.expr(f"substring(signature, tree * {DEPTH} + 1, {DEPTH})")
    ordered = (
        rows.withColumn("deep", deep)
        .select("tree", "region", "deep", "class", "signature")
        .repartitionByRange("tree", "region", "deep")
        .sortWithinPartitions("tree", "region", "deep", "class")
    )

    def of_regions(part: pa.Table, starts: list[int]) -> pa.RecordBatch:
        signatures = _matrix(part.column("signature"), MINIMA)
        deep = _matrix(part.column("deep"), DEPTH)
        names = part.column("class").to_pylist()
        found = set()
        for low, high in zip(starts, [*starts[1:], part.num_rows]):
            if high - low > 1:
                a, b = _candidates(signatures[low:high], deep[low:high], percent)
                for i, j in zip(a.tolist(), b.tolist()):
                    one, two = names[low + i], names[low + j]
                    if one != two:
                        found.add((one, two) if one < two else (two, one))
        return _pair_batch(found)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            tree, region = (table.column(c).to_numpy() for c in ("tree", "region"))
            edges = np.flatnonzero((tree[1:] != tree[:-1]) | (region[1:] != region[:-1])) + 1
            starts = [0, *edges.tolist()]
            if len(starts) > 1:
                yield of_regions(table.slice(0, starts[-1]), starts[:-1])
            rest = table.slice(starts[-1])
            if rest.num_rows >= HELD:
                yield of_regions(rest, [0])
                rest = rest.slice(rest.num_rows - PIECE)
        if rest is not None and rest.num_rows > 1:
            yield of_regions(rest, [0])

    return ordered.mapInArrow(pairs, "u binary, v binary").distinct()


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Stretches of a block's visitors, each with the classes that live there.

    Rows come by ``tree, region, block``, those that live there first; while the block stays the
    same, so does the batch of them.
    """
    block, living, home = None, [], None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("tree", "region", "block")]
        visits = batch.column("visits").to_numpy(zero_copy_only=False)
        changed = visits[1:] != visits[:-1]
        for key in keys:
            changed |= key[1:] != key[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()] if batch.num_rows else []
        for low, high in zip(starts, [*starts[1:], batch.num_rows]):
            here = tuple(int(key[low]) for key in keys)
            if here != block:
                block, living, home = here, [], None
            part = batch.slice(low, high - low)
            if not visits[low]:
                living.append(part)
            elif living:
                if home is None:
                    home = pa.concat_batches(living)
                yield home, part


def _between(
    home: pa.RecordBatch, part: pa.RecordBatch, least: float, every: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs of visitors and classes that live in the block, the likeliest first.

    A pair that shares the region of several trees is left to the first of them, and one of two
    classes that both visit to the block of the greater.
    """
    of_both = pa.chunked_array(
        [home.column("component"), part.column("component")]
    ).combine_chunks().dictionary_encode().indices.to_numpy()
    likely = _agreement(
        _matrix(part.column("signature"), MINIMA), _matrix(home.column("signature"), MINIMA)
    )
    names = [np.frombuffer(b"".join(x.column("class").to_pylist()), "S16") for x in (part, home)]
    moves = home.column("moves").to_numpy(zero_copy_only=False)
    tree = part.column("tree")[0].as_py()
    one, two = (
        x.column("regions").flatten().to_numpy().reshape(x.num_rows, -1) for x in (part, home)
    )
    a, b = np.nonzero(likely >= least)
    kept = of_both[home.num_rows :][a] != of_both[: home.num_rows][b]
    a, b = a[kept], b[kept]
    kept = ~moves[b] | (names[0][a] < names[1][b])
    for earlier in range(tree):
        kept &= one[a, earlier] != two[b, earlier]
    a, b = a[kept], b[kept]
    order = np.argsort(-likely[a, b], kind="stable")
    a, b = a[order], b[order]
    if not every and len(a):
        # the first of a visitor and component is the likeliest
        pairs = a * (len(of_both) + 1) + of_both[: home.num_rows][b]
        first = np.sort(np.unique(pairs, return_index=True)[1])
        a, b = a[first], b[first]
    return a, b


def _root(parents: dict[bytes, bytes], component: bytes) -> bytes:
    while (above := parents.get(component)) is not None:
        component = above
    return component


def links_between(
    labels: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, every: bool
) -> DataFrame:
    """Distinct links ``u, v`` that join the different components of a region, of any size.

    ``labels`` are ``tree, region, class, component, n_shingles``, ``signatures`` are ``class,
    signature, regions``, ``sets`` are ``class, shingles``. A region is dealt into blocks by a hash
    of the class; a class outside its largest component visits every block and is compared with
    all that live there. Blocks of a region are spread over tasks; a task holds one block and reads
    its visitors as they come. Likely pairs are confirmed on the full sets in their block, the
    likeliest first; a pair whose components a link of the block has joined needs no confirmation.
    """
    by_component = labels.groupBy("tree", "region", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("size")
    )
    regions = settle(
        by_component.groupBy("tree", "region").agg(
            F.sum("n").alias("n"), F.sum("size").alias("size"),
            F.max(F.struct("n", "component")).alias("most"),
        )
        .where("n > most.n")
        .select(
            "tree", "region", F.col("most.component").alias("main"),
            F.ceil(F.greatest(F.col("n") / PIECE, F.col("size") * 8 / BLOCK_BYTES))
            .cast("int").alias("blocks"),
        )
    )
    rows = settle(
        labels.drop("n_shingles").join(regions, ["tree", "region"]).join(signatures, "class")
        .withColumn("moves", F.col("component") != F.col("main"))
    )
    wanted = [
        "tree", "region", "block", "visits", "class", "component", "moves", "signature", "regions"
    ]
    hosts = rows.withColumns({
        "block": F.pmod(F.xxhash64("class"), F.col("blocks").cast("bigint")).cast("int"),
        "visits": F.lit(False),
    })
    visitors = rows.where("moves").withColumns({
        "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "visits": F.lit(True),
    })
    blocks = ["tree", "region", "block"]
    dealt = (
        hosts.select(*wanted).unionByName(visitors.select(*wanted))
        .repartition(*blocks).sortWithinPartitions(*blocks, "visits")
    )
    least = least_estimate(percent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of a block that have a likely partner there."""
        home, met = None, None
        for here, part in _visits(batches):
            if here is not home:
                if home is not None:
                    yield home.filter(pa.array(met))
                home, met = here, np.zeros(here.num_rows, bool)
            a, b = _between(here, part, least, every)
            met[b] = True
            yield part.take(pa.array(np.unique(a)))
        if home is not None:
            yield home.filter(pa.array(met))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, parents = None, {}
        for here, part in _visits(batches):
            if here is not home:
                home, parents = here, {}
                held = here.column("shingles")
                names, of_home = here.column("class"), here.column("component").to_pylist()
            a, b = _between(here, part, least, every)
            coming, of_part = part.column("shingles"), part.column("component").to_pylist()
            links = set()
            for i, j in zip(a.tolist(), b.tolist()):
                one, two = _root(parents, of_part[i]), _root(parents, of_home[j])
                if one == two:
                    continue
                if similar(
                    np.frombuffer(coming[i].as_buffer(), "<u8"),
                    np.frombuffer(held[j].as_buffer(), "<u8"), percent,
                ):
                    parents[one] = two
                    links.add((part.column("class")[i].as_py(), names[j].as_py()))
            yield _pair_batch(links)

    likely = dealt.mapInArrow(meet, dealt.schema)
    together = (
        likely.join(sets, "class").repartition(*blocks).sortWithinPartitions(*blocks, "visits")
    )
    return together.mapInArrow(confirm, "u binary, v binary").distinct()


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, np.uint8).reshape(-1, width)


def _full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``class, shingles`` of the classes in ``wanted`` (class, id), from their texts.

    A fixed number of filter bits, set by the wanted ids, goes to the tasks; texts whose bit is
    not set are not cut again. Superfluous texts cost time only.
    """
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = (
        wanted.select(place.alias("place"))
        .groupBy(F.shiftright("place", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 31 as int)))").alias("bits"))
        .collect()
    )
    words = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for row in bits:
        words[row["word"]] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.select(place.alias("place"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            places = whole.column("place").to_numpy()
            hit = (shared.value[places >> 5] >> (places & 31).astype(np.uint32)) & 1
            kept = whole.take(pa.array(np.flatnonzero(hit)))
            for start in range(0, kept.num_rows, 2000):
                found = [s for s in shingle_sets(kept.column("text").slice(start, 2000)) if len(s)]
                yield pa.record_batch(
                    [pa.array([class_of(s) for s in found], pa.binary()),
                     pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())],
                    names=["class", "shingles"],
                )

    found = rows.mapInArrow(sets, "class binary, shingles binary")
    return found.groupBy("class").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("u"), F.col("shingles").alias("of_u"))
    right = sets.select(F.col("class").alias("v"), F.col("shingles").alias("of_v"))
    both = pairs.join(left, "u").join(right, "v")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = []
            for one, two in zip(batch.column("of_u"), batch.column("of_v")):
                a = np.frombuffer(one.as_buffer(), "<u8")
                b = np.frombuffer(two.as_buffer(), "<u8")
                verdict.append(similar(a, b, percent))
            yield batch.select(["u", "v"]).filter(pa.array(verdict, pa.bool_()))

    return both.select("u", "v", "of_u", "of_v").mapInArrow(confirm, "u binary, v binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    together = np.concatenate([a, b])
    together.sort(kind="stable")
    shared = int((together[1:] == together[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the smallest id that confirmed links reach, the row's own included. A text
    without words, and a null one, has no shingles and is linked with nothing. Rows with equal
    texts are always together; rows that repeat an id are judged by their own text. Null ids are
    left aside by the minimum; where a component has no other id, its id is null and it is kept.
    Other columns are not read.
    """
    rows = settle(sketches(docs, id_column, text_column))
    classes = settle(
        rows.where("class is not null").groupBy("class").agg(
            F.min("id").alias("id"),
            F.first("signature").alias("signature"),
            F.first("regions").alias("regions"),
            F.first("n_shingles").alias("n_shingles"),
        )
    )
    trees = classes.select("class", "n_shingles", F.posexplode("regions").alias("tree", "region"))
    together = F.count("*").over(Window.partitionBy("tree", "region"))
    shared = settle(trees.withColumn("n", together).where("n > 1").drop("n"))
    partners = settle(
        classes.select("class", "id", "signature", "regions").join(
            shared.select("class").distinct(), "class", "left_semi"
        )
    )
    forest = settle(shared.join(partners.select("class", "signature"), "class"))
    sets = settle(_full_sets(docs, partners, id_column, text_column))

    tried = settle(candidate_pairs(forest, percent))
    found = settle(components(settle(confirmed(tried, sets, percent))))
    for every in (False, True):
        component = F.coalesce("component", "class").alias("component")
        labels = settle(
            shared.join(found.withColumnRenamed("node", "class"), "class", "left")
            .select("tree", "region", "class", component, "n_shingles")
        )
        known = partners.select("class", "signature", "regions")
        more = settle(links_between(labels, known, sets, percent, every))
        joined = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = settle(components(joined.unionByName(more)))

    least = settle(
        found.join(classes.select(F.col("class").alias("node"), "id"), "node")
        .groupBy("component")
        .agg(F.min("id").alias("component_id"))
    )
    of_class = settle(
        classes.select("class", F.col("id").alias("own")).join(
            found.join(least, "component").select(F.col("node").alias("class"), "component_id"),
            "class", "left",
        ).select("class", F.coalesce("component_id", "own").alias("component_id"))
    )
    return rows.select("id", "n_shingles", "class").join(of_class, "class", "left").select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id"),
    ).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def near_duplicate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=QUERY_PERCENT)


def keep_one_of_each(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """The documents of ``docs`` without those that a near duplicate with a smaller id stands for.

    Rows that repeat a kept id all stay; documents with a null id stay. Other columns stay as they
    are, whatever their names.
    """
    name = spare_name(docs, "_gone")
    gone = near_duplicates(docs, id_column, text_column, percent).where("not kept").select(
        F.col(id_column).alias(name)
    )
    return docs.join(gone.distinct(), F.col(id_column) == F.col(name), "left_anti")


NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
           CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                                                    lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
                ELSE [] END) AS s
  FROM words WHERE w IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.seen)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(reach.seen) AS component_id,
       d.doc_id = min(reach.seen) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach ON reach.node = d.doc_id
GROUP BY d.doc_id
"""
