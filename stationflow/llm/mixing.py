"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's part of the whole, at most ``most`` copies of
what it has. Inside a source, documents share the target by their preference: an expected number
of copies, again at most ``most``. The whole part of that number is certain. For its fraction, the
inclusion probability, documents are ranked by random odds divided by inclusion odds, and taken in
that order until the source's remaining words are reached: a sample of fixed size in words with
unequal probabilities.

Everything is DataFrame expressions. The cut in a source's order is found from two counts of 1024
bins each and the rows of one bin of the second, so a source with most rows is never sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.llm.text import WORD_PATTERN, documents
from stationflow.session import settle

#: Weights of the sources in code-point order, null last, over and over.
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a share of all words.
SHARE = 1.5
#: Copies of a document at most.
MOST = 2
#: Bits of one level of the search for the cut.
BITS = 10


def size_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def preference_of(size: Column) -> Column:
    """Preference of a document: 8, and 1 more for each doubling of its words. Few values."""
    return (F.lit(8) + F.length(F.conv(size.cast("string"), 10, 2))).cast("bigint")


def chance_of(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the key alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (number + F.lit(0.5)) / F.lit(float(1 << 52))


def _fill(parts: DataFrame, by: list[str], total: str, cap: str, weight: str) -> DataFrame:
    """Share ``total`` by ``weight``, nobody above ``cap``, the excess shared again: ``got``.

    In the order of cap over weight those at their cap come first; the level of the others is
    what is left of the total over their weights.
    """
    ratio = F.col(cap) / F.col(weight)
    order = Window.partitionBy(*by).orderBy(ratio, weight, "part")
    capped_before = F.coalesce(
        F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    weights_from = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col(total) - capped_before) / weights_from
    marked = parts.withColumn("_level", level).withColumn(
        "_level", F.when(F.col("_level") < ratio, F.col("_level"))
    )
    level = F.max("_level").over(Window.partitionBy(*by))
    return marked.withColumn("_level", level).withColumn(
        "got",
        F.when(F.col("_level").isNull(), F.col(cap).cast("double")).otherwise(
            F.least(F.col(cap).cast("double"), F.col("_level") * F.col(weight))
        ),
    ).drop("_level")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """One row per source: ``source, source_size, target``. The list of sources is one window."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1)
    parts = sources.select(
        "source", "source_size", weight.cast("bigint").alias("weight"),
        (F.col("source_size") * most).alias("cap"), place.alias("part"),
        F.lit(0).alias("all"),
    ).withColumn("total", F.sum("source_size").over(Window.partitionBy("all")) * F.lit(share))
    return _fill(parts, ["all"], "total", "cap", "weight").select(
        "source", "source_size", F.col("got").alias("target")
    )


def class_copies(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """Expected copies of each source's documents by preference: ``certain`` and ``fraction``."""
    classes = sizes.where("size > 0").groupBy("source", "preference").agg(F.sum("size").alias("n"))
    parts = (
        classes.alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(
            "c.source", "c.preference", "c.n", "t.source_size", "t.target",
            (F.col("c.n") * most).alias("cap"),
            (F.col("c.n") * F.col("c.preference")).alias("weight"),
            F.col("c.preference").alias("part"),
        )
    )
    filled = _fill(parts, ["source"], "target", "cap", "weight")
    copies = F.col("got") / F.col("n")
    return filled.select(
        "source", "preference", "source_size", "target",
        F.floor(copies).alias("certain"),
        (copies - F.floor(copies)).alias("fraction"),
        (F.col("n") * F.floor(copies)).alias("certain_words"),
    )


def _place(chance: Column, fraction: Column) -> Column:
    """Random odds over inclusion odds, q, as q / (1 + q); null where nothing is left to chance."""
    ours, other = chance * (1 - fraction), fraction * (1 - chance)
    return F.when(fraction > 0, ours / (ours + other))


def _ranked(sizes: DataFrame, copies: DataFrame) -> DataFrame:
    rows = sizes.alias("d").join(
        copies.alias("c"),
        F.col("d.source").eqNullSafe(F.col("c.source"))
        & (F.col("d.preference") == F.col("c.preference")),
        "left",
    )
    ranked = rows.select(
        "d.*", "c.certain", _place(F.col("d.chance"), F.col("c.fraction")).alias("place")
    )
    return ranked.withColumn("bin", F.floor(F.col("place") * (1 << (2 * BITS))))


def _cut(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """In each source's ``bin`` order, the first bin that reaches the wanted words."""
    order = Window.partitionBy("source").orderBy("bin")
    running = counts.alias("b").join(
        wanted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source"))
    ).select("b.source", "b.bin", "b.n", "w.rest", "w.before")
    running = running.withColumn("through", F.col("before") + F.sum("n").over(order))
    return (
        running.where(F.col("through") >= F.col("rest"))
        .groupBy("source")
        .agg(F.min_by(F.struct("bin", "n", "through", "rest"), "bin").alias("x"))
        .select(
            "source", F.col("x.bin").alias("bin"), F.col("x.rest").alias("rest"),
            (F.col("x.through") - F.col("x.n")).alias("before"),
        )
    )


def source_cuts(sizes: DataFrame, copies: DataFrame) -> DataFrame:
    """One row per source: the bin of the last document taken, and the last place inside it."""
    ranked = _ranked(sizes, copies).where("bin is not null and size > 0")
    wanted = copies.groupBy("source").agg(
        (F.max("target") - F.sum("certain_words")).alias("rest"), F.lit(0).alias("before")
    )
    coarse = F.shiftright("bin", BITS)
    first = _cut(
        ranked.groupBy("source", coarse.alias("bin")).agg(F.sum("size").alias("n")), wanted
    )
    inside = (
        ranked.alias("r").join(
            first.alias("f"),
            F.col("r.source").eqNullSafe(F.col("f.source"))
            & (F.shiftright("r.bin", BITS) == F.col("f.bin")),
            "left_semi",
        )
    )
    second = _cut(inside.groupBy("source", "bin").agg(F.sum("size").alias("n")), first)
    last = inside.alias("r").join(
        second.alias("s"),
        F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bin") == F.col("s.bin")),
    ).select("r.source", "r.bin", "r.place", "r.size", "s.rest", "s.before")
    places = last.groupBy("source", "bin", "place", "rest", "before").agg(
        F.sum("size").alias("n")
    )
    order = Window.partitionBy("source").orderBy("place")
    through = F.col("before") + F.sum("n").over(order)
    taken = places.withColumn("through", through).withColumn(
        "_in", 2 * F.col("through") - F.col("n") <= 2 * F.col("rest")
    )
    return taken.groupBy("source").agg(
        F.max("bin").alias("cut_bin"),
        F.max(F.when(F.col("_in"), F.col("place"))).alias("cut_place"),
    )


def with_copies(sizes: DataFrame, targets: DataFrame, copies: DataFrame, cuts: DataFrame):
    """``sizes`` with ``source_size``, ``target`` and ``copies``."""
    ranked = _ranked(sizes, copies).alias("r")
    joined = ranked.join(
        targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))
    ).join(cuts.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")), "left")
    by_chance = F.col("r.bin").isNotNull() & (
        F.col("k.cut_bin").isNull()
        | (F.col("r.bin") < F.col("k.cut_bin"))
        | ((F.col("r.bin") == F.col("k.cut_bin")) & (F.col("r.place") <= F.col("k.cut_place")))
    )
    copies_ = F.coalesce(F.col("r.certain"), F.lit(0)) + F.coalesce(
        by_chance, F.lit(False)
    ).cast("bigint")
    kept = [F.col(f"r.{c}") for c in sizes.columns if c not in ("preference", "chance")]
    return joined.select(*kept, "t.source_size", "t.target", copies_.alias("copies"))


def _planned(
    docs: DataFrame, kept: list[Column], weights: tuple[int, ...], share: float, most: int,
    seed: str, id_column: str, source_column: str, text_column: str,
) -> DataFrame:
    def sized(more: list[Column]) -> DataFrame:
        return docs.select(
            *more,
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            size_of(F.col(text_column)).alias("size"),
        ).withColumns({
            "preference": preference_of(F.col("size")), "chance": chance_of(F.col("id"), seed)
        })

    sizes = settle(sized([]))
    targets = settle(source_targets(sizes, weights, share, most))
    copies = settle(class_copies(sizes, targets, most))
    cuts = settle(source_cuts(sizes, copies))
    return with_copies(sized(kept) if kept else sizes, targets, copies, cuts)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = "mix",
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """``id, source, size, source_size, target, copies`` of every row of ``docs``.

    The chances come from the keys, so reruns agree; rows with equal keys share their fate, a null
    key counts as empty text, a null source is a source. Documents without words are taken no
    time. A source ends within half a document of its target. No rows give no rows. Only ``id``,
    ``source`` and word counts are kept, once, in the shared folder; texts are never shuffled.
    """
    return _planned(
        docs, [], weights, share, most, seed, id_column, source_column, text_column
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = "mix",
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with their own columns, each as often as the mix takes it."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    taken = _planned(
        docs, [row], weights, share, most, seed, id_column, source_column, text_column
    ).where("copies > 0")
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return taken.select("row", F.explode(times).alias("copy")).select("row.*")


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
          + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS chance
  FROM documents),
sizes AS (
  SELECT *, CAST(8 + length(bin(size)) AS BIGINT) AS preference FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS part
  FROM sizes GROUP BY source),
weighted AS (
  SELECT *, CASE (part - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         2 * source_size AS cap,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, part
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap / weight, weight, part
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted),
targets AS (
  SELECT source, source_size,
         CASE WHEN max(CASE WHEN level < cap / weight THEN level END) OVER () IS NULL THEN cap::DOUBLE
              ELSE least(cap::DOUBLE,
                         max(CASE WHEN level < cap / weight THEN level END) OVER () * weight) END
           AS target
  FROM levels),
classes AS (
  SELECT source, preference, CAST(sum(size) AS BIGINT) AS n FROM sizes WHERE size > 0
  GROUP BY source, preference),
class_levels AS (
  SELECT c.*, t.target, 2 * n AS cap, n * preference AS weight,
         (t.target - coalesce(sum(2 * n) OVER (PARTITION BY c.source
             ORDER BY (2 * n) / (n * preference), n * preference, preference
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(n * preference) OVER (PARTITION BY c.source
             ORDER BY (2 * n) / (n * preference), n * preference, preference
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
class_tops AS (
  SELECT *, max(CASE WHEN level < cap / weight THEN level END) OVER (PARTITION BY source) AS top
  FROM class_levels),
copies AS (
  SELECT source, preference, target, n,
         (CASE WHEN top IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, top * weight) END) / n
           AS expected
  FROM class_tops),
rests AS (
  SELECT source, max(target) - CAST(sum(n * CAST(floor(expected) AS BIGINT)) AS BIGINT) AS rest
  FROM copies GROUP BY source),
ranked AS (
  SELECT s.*, CAST(floor(expected) AS BIGINT) AS certain, expected - floor(expected) AS fraction
  FROM sizes s LEFT JOIN copies c
    ON s.source IS NOT DISTINCT FROM c.source AND s.preference = c.preference),
placed AS (
  SELECT *, CASE WHEN fraction > 0 THEN
      (chance * (1 - fraction)) / (chance * (1 - fraction) + fraction * (1 - chance)) END AS place
  FROM ranked),
running AS (
  SELECT p.*, r.rest,
         sum(CASE WHEN place IS NOT NULL THEN size ELSE 0 END)
           OVER (PARTITION BY p.source ORDER BY place NULLS LAST) AS through,
         sum(size) OVER (PARTITION BY p.source, place) AS together
  FROM placed p LEFT JOIN rests r ON p.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, t.source_size, t.target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (certain + CASE WHEN place IS NOT NULL
            AND 2 * through - together <= 2 * rest THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM running JOIN targets t ON running.source IS NOT DISTINCT FROM t.source
"""
