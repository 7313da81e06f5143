"""Document fingerprints: SimHash, and all fingerprints within a Hamming radius.

The terms of a text are its pairs of neighbouring words (and its last word). Each term's hash
votes, with the term's weight, for or against each of 60 bits; the majority makes the
fingerprint, 15 hexadecimal digits. Texts that share most of their terms differ in few bits.

Votes for two bits share one sum (30 bits each), so an ordinary grouped sum counts them all in
generated code. Searching cuts a fingerprint into blocks: within a radius, some choice of blocks
is equal, so one permuted table per choice, keyed by its blocks, finds every partner. Everything
here is DataFrame expressions.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.llm.text import GAP_PATTERN, documents
from stationflow.session import settle

BITS = 60
LANE = 30
DIGITS = BITS // 4
RADIUS = 3
BLOCKS = 6
#: Documents that a bucket of the key order holds on average, and buckets at most.
BUCKET_ROWS = 128
MOST_BUCKETS = 1 << 16
#: Search queries are the rows whose id is divisible by this.
QUERY_STEP = 50
_LOWEST = -(1 << 63)


def _terms(text: Column) -> Column:
    words = F.array_remove(F.split(text, GAP_PATTERN), "")
    return F.arrays_zip(words.alias("word"), F.slice(words, 2, F.size(words)).alias("next"))


def term_weight(term: Column) -> Column:
    """1 to 3: longer terms are rarer and say more."""
    return F.least(F.lit(3), F.lit(1) + F.floor(F.length(term) / 6)).cast("bigint")


def add_fingerprints(rows: DataFrame, by: list[str], text_column: str) -> DataFrame:
    """``by`` and ``fingerprint``, one row per distinct ``by``, which must name a single text.

    Rows that are already distributed by some of ``by`` are not shuffled. A text without words,
    and a null one, has the fingerprint of zeros only.
    """
    exploded = rows.select(*by, F.inline_outer(_terms(F.col(text_column))).alias("word", "next"))
    term = exploded.withColumn("term", F.concat_ws(" ", "word", "next"))
    voted = term.select(
        *by,
        F.when(
            F.col("word").isNotNull(), F.conv(F.substring(F.md5("term"), 1, DIGITS), 16, 10)
        ).cast("bigint").alias("hash"),
        term_weight(F.col("term")).alias("weight"),
    )
    pair = F.lit(1 + (1 << LANE))
    votes = voted.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("hash").isNotNull(), F.col("weight"))), F.lit(0))
        .alias("all_votes"),
        *(
            F.coalesce(
                F.sum(F.shiftright("hash", bit).bitwiseAND(pair) * F.col("weight")), F.lit(0)
            ).alias(f"votes_{bit}")
            for bit in range(LANE)
        ),
    )
    bits = []
    for bit in range(LANE):
        both = F.col(f"votes_{bit}")
        low, high = both.bitwiseAND(F.lit((1 << LANE) - 1)), F.shiftright(both, LANE)
        for place, ones in ((bit, low), (bit + LANE, high)):
            bits.append(F.when(2 * ones > F.col("all_votes"), F.lit(1 << place)).otherwise(F.lit(0)))
    value = bits[0]
    for bit in bits[1:]:
        value = value + bit
    return votes.select(*by, as_digits(value.cast("bigint")).alias("fingerprint"))


def as_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), DIGITS, "0")


def as_number(fingerprint: Column) -> Column:
    return F.conv(fingerprint, 16, 10).cast("bigint")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return F.lit(1.0) - F.bit_count(as_number(a).bitwiseXOR(as_number(b))) / F.lit(float(BITS))


def _bounds(docs: DataFrame, id_column: str) -> list[int]:
    """First keys of buckets of about equal size; only keys are read, only bounds come back."""
    keys = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(_LOWEST)).alias("key"))
    buckets = max(1, min(MOST_BUCKETS, keys.count() // BUCKET_ROWS))
    shares = F.lit([i / buckets for i in range(buckets)])
    found = keys.agg(
        F.percentile_approx("key", shares, max(10_000, 20 * buckets)).alias("bounds"),
        F.min("key").alias("first"),
    ).head()
    return sorted({found["first"], *(found["bounds"] or ())} - {None})


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The last bound that is not above the key, found in two steps of about equal length."""
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    group = F.size(F.filter(coarse, lambda bound: bound <= key))
    inside = F.size(F.filter(F.element_at(fine, group), lambda bound: bound <= key))
    return ((group - 1) * step + inside - 1).cast("int")


def with_next(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``bucket, place, ghost, id, text, next_text``, distributed by bucket: one shuffle of texts.

    The order is by id (null first), then text. Each bucket of the order also gets the first rows
    of the following one as ghosts, which are nobody's document but show the last one its next.
    """
    bounds = _bounds(docs, id_column)
    if not bounds:
        bounds = [_LOWEST]
    key = F.coalesce(F.col("id").cast("bigint"), F.lit(_LOWEST))
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).withColumn("key", key)
    own = _bucket(F.col("key"), bounds)
    opens = F.array_contains(
        F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), F.col("key")
    )
    before = F.when(F.col("own") > 0, F.col("own") - 1).otherwise(F.lit(len(bounds) - 1))
    places = F.when(
        opens,
        F.array(
            F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")),
            F.struct(before.cast("int").alias("bucket"), F.lit(True).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost"))))
    dealt = rows.withColumn("own", own).select("id", "text", "key", F.inline(places))
    order = Window.partitionBy("bucket").orderBy("ghost", "key", "text")
    return dealt.select(
        "bucket", "ghost", "id", "text",
        F.row_number().over(order).alias("place"),
        F.lead("text").over(order).alias("next_text"),
    )


def fingerprint_edits(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    The edited text's second half (rounded down) comes from the start of the next document's
    text, by ascending id; the last document's next is the first. Null text counts as empty, null
    ids come first, rows of equal ids are ordered by text, repeated rows stay.
    """
    rows = with_next(docs, id_column, text_column)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half),
    )
    bodies = rows.select(
        "bucket", "ghost", "place", "id",
        F.inline(
            F.array(
                F.struct(
                    F.lit(False).alias("edited"), F.col("text").alias("body"),
                ),
                F.struct(
                    F.lit(True).alias("edited"),
                    F.when(~F.col("ghost"), edited).alias("body"),
                ),
            )
        ),
    ).withColumns({
        "n_chars": F.length("body"), "sha256": F.when(F.col("edited"), F.sha2("body", 256)),
    })
    by = ["bucket", "ghost", "place", "id", "edited", "n_chars", "sha256"]
    found = add_fingerprints(bodies, by, "body")
    place = ["bucket", "ghost", "place", "id"]
    of_document = found.groupBy(*place).agg(
        F.max(F.when(~F.col("edited"), F.col("n_chars"))).cast("bigint").alias("n_chars"),
        F.max(F.when(F.col("edited"), F.col("sha256"))).alias("edited_sha256"),
        F.max(F.when(~F.col("edited"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("edited"), F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    order = Window.partitionBy("bucket").orderBy("ghost", "place")
    following = of_document.withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return following.where(~F.col("ghost")).select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256", "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _tables(rows: DataFrame, radius: int, blocks: int) -> DataFrame:
    """One row per permuted table: its number and the blocks that make its key."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    tables = [sum(c) for c in combinations(masks, blocks - radius)]
    keys = F.array(*(F.col("number").bitwiseAND(F.lit(mask)) for mask in tables))
    return rows.select("*", F.posexplode(keys).alias("table", "key"))


def near_fingerprints(
    queries: DataFrame, known: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """Pairs ``fingerprint, near, distance`` of distinct fingerprints within ``radius`` bits.

    Both sides need a column ``fingerprint``; equal fingerprints are one row, so copies are never
    paired, and a fingerprint is its own partner at distance 0 if it is known. A pair is reported
    by the first table in which its keys agree, so no pass removes repeats.
    """
    left = queries.select("fingerprint").distinct().withColumn("number", as_number(F.col("fingerprint")))
    right = known.select(F.col("fingerprint").alias("near")).distinct().withColumn(
        "number", as_number(F.col("near"))
    )
    a, b = _tables(left, radius, blocks).alias("a"), _tables(right, radius, blocks).alias("b")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    differ = F.col("a.number").bitwiseXOR(F.col("b.number"))
    first = F.lit(None).cast("int")
    chosen = list(combinations(masks, blocks - radius))
    for number in range(len(chosen) - 1, -1, -1):
        first = F.when(differ.bitwiseAND(F.lit(sum(chosen[number]))) == 0, F.lit(number)).otherwise(first)
    return (
        a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")))
        .where((F.bit_count(differ) <= radius) & (F.col("a.table") == first))
        .select("a.fingerprint", "b.near", F.bit_count(differ).alias("distance"))
    )


def documents_within(fingerprints: DataFrame, id_column: str, radius: int = RADIUS) -> DataFrame:
    """``fingerprints`` with ``n_within``: for the rows whose id is divisible by 50, the number of
    other rows within the radius; null for the others."""
    asked = F.coalesce(F.col(id_column) % QUERY_STEP == 0, F.lit(False))
    sizes = fingerprints.groupBy(F.col("fingerprint").alias("near")).agg(F.count("*").alias("n"))
    pairs = near_fingerprints(fingerprints.where(asked), sizes.select(F.col("near").alias("fingerprint")), radius)
    counts = pairs.join(sizes, "near").groupBy("fingerprint").agg(F.sum("n").alias("_n"))
    return (
        fingerprints.withColumn("_asked", F.when(asked, F.col("fingerprint")))
        .join(counts.withColumnRenamed("fingerprint", "_asked"), "_asked", "left")
        .withColumn("n_within", F.when(asked, F.col("_n") - 1))
        .drop("_asked", "_n")
    )


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_within(settle(fingerprint_edits(documents(spark, sf_dir))), "doc_id")


FINGERPRINT_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (
  SELECT doc_id, text,
         coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text),
                  first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id NULLS FIRST, text),
                  first_value(doc_id) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_id
  FROM docs),
bodies AS (
  SELECT doc_id, next_id, length(text) AS n_chars, text AS body, FALSE AS edited FROM ordered
  UNION ALL
  SELECT doc_id, next_id, length(text),
         substr(text, 1, length(text) - length(text) // 2)
           || substr(next_text, 1, length(text) // 2), TRUE FROM ordered),
words AS (
  SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w FROM bodies),
placed AS (
  SELECT doc_id, edited, w, unnest(range(1, len(w) + 1)) AS i FROM words),
terms AS (
  SELECT doc_id, edited,
         CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] ELSE w[i] END AS term FROM placed),
hashed AS (
  SELECT doc_id, edited, least(3, 1 + length(term) // 6) AS weight,
         CAST('0x' || substr(md5(term), 1, {DIGITS}) AS BIGINT) AS h FROM terms),
votes AS (
  SELECT doc_id, edited,
         {" + ".join(
             f"CASE WHEN 2 * sum(weight * ((h >> {b}) & 1)) > sum(weight) THEN {1 << b}::BIGINT ELSE 0 END"
             for b in range(BITS))} AS number
  FROM hashed GROUP BY doc_id, edited),
printed AS (
  SELECT b.doc_id, b.next_id, b.n_chars, b.body, b.edited,
         CAST(coalesce(number, 0) AS BIGINT) AS number
  FROM bodies b LEFT JOIN votes v ON b.doc_id = v.doc_id AND b.edited = v.edited),
own AS (SELECT * FROM printed WHERE NOT edited),
changed AS (SELECT * FROM printed WHERE edited)
SELECT o.doc_id, o.n_chars, sha256(c.body) AS edited_sha256,
       lpad(lower(hex(o.number)), {DIGITS}, '0') AS fingerprint,
       lpad(lower(hex(c.number)), {DIGITS}, '0') AS edited_fingerprint,
       1.0::DOUBLE - bit_count(xor(o.number, c.number)) / {BITS}::DOUBLE AS near_edited,
       1.0::DOUBLE - bit_count(xor(o.number, n.number)) / {BITS}::DOUBLE AS near_next,
       CASE WHEN o.doc_id % {QUERY_STEP} = 0 THEN
         (SELECT count(*) - 1 FROM own x WHERE bit_count(xor(x.number, o.number)) <= {RADIUS})
       END AS n_within
FROM own o JOIN changed c ON o.doc_id = c.doc_id JOIN own n ON n.doc_id = o.next_id
"""
