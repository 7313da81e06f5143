"""Words, splits and small helpers that the text operators share."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that ends a word, as both engines' patterns write it.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"

WORDS = re.compile(WORD_PATTERN)
LOWER_AZ = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str | None) -> list[str]:
    """The words of a text; ``str.split`` is used where it splits at the same places."""
    if not text:
        return []
    if _OTHER_SPACE.search(text):
        return WORDS.findall(text)
    return text.split()


def lower_az(text: str) -> str:
    """A-Z in lower case, every other letter as it is."""
    return text.lower() if text.isascii() else text.translate(LOWER_AZ)


def held_out(key, folds: int, fold: int) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds == fold


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether the key's crc32 falls into the fold; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def lower_az_column(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of a batch that a Python worker gets at once, for operators whose work needs room per text.
BATCH_ROWS = 1000

_TABLES: dict = {}
_OWNER: list[str] = []


def tables_of(owner: str) -> dict:
    """The worker's tables of one operator. Workers outlive a stage: the next operator that asks for
    its own drops those of the one before, and gives unused memory back.
    """
    if _OWNER != [owner]:
        import pyarrow as pa

        _TABLES.clear()
        _OWNER[:] = [owner]
        pa.default_memory_pool().release_unused()
    return _TABLES


def small_batches(spark) -> None:
    """Bound what crosses to a Python worker at once; texts make rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def spare_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, *names: str) -> dict[str, str]:
    """Other names for those columns of ``df`` that an operator is about to add itself."""
    wanted = {n.lower() for n in names}
    return {c: spare_name(df, f"_{c}") for c in df.columns if c.lower() in wanted}


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
