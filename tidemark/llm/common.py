"""What the training-data operators share: tables, the shared folder, words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: Bytes that end a word under ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on the same six.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to a-z, and every ASCII byte that is neither a letter nor a digit to a blank.
#: Bytes over 0x7F (of non-ASCII characters) stay: they belong to words.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
#: The same set of word characters for Java's and RE2's engines.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


__all__ = ["ALNUM", "BLANK_WORD", "LARGE_ROWS", "LOWER", "discard", "hot_join", "lean_shuffles", "lower_az", "materialise", "set_aside", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For tables whose rows are megabytes each. Parquet's writer looks at what it holds every 100 rows, and Spark's reader
#: decodes up to a whole row group at once; so both look at each row and stop at 16 MB.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialise(df: DataFrame, base: str, name: str, codec: str = "snappy", more: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs no recomputation beyond the table, and later steps
    see its true size. ``more`` has further options of the writer.
    """
    path = f"{base}/{name}"
    df.write.mode("overwrite").options(compression=codec, **(more or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names (in any case) under names that nobody uses, and what they are called now.

    For operators that need ``names`` themselves while a document's own columns stay.
    """
    used, moved = {c.lower() for c in (*docs.columns, *names)}, {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"_aside_{len(moved)}"
            while new in used:
                new += "_"
            used.add(new)
            moved[c] = new
    return docs.withColumnsRenamed(moved), moved


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def lean_shuffles(spark: SparkSession, together: bool = False) -> Iterator[None]:
    """While tables are written one after the other: shuffle files go when a table is written.

    ``together``: rows that lie together by one key aren't dealt anew to meet
    on it and another one. For keys that none of the rows favour; a join that
    could lean on a frequent key needs all of its keys.
    """
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    settings |= {"spark.sql.requireAllClusterKeysForCoPartition": "false"} if together else {}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def hot_join(rows: DataFrame, by_key: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``by_key`` (one row for each key); the keys of ``hot`` are broadcast, the others meet in a shuffle.

    ``hot`` holds the keys with more than 1 / n of all rows, so it has at most
    n keys, and no task of the shuffle gets more than 1 / n of the rows by one
    key.
    """
    hot = F.broadcast(hot)
    rest = rows.join(hot, keys, "left_anti").join(by_key, keys)
    return rows.join(F.broadcast(by_key.join(hot, keys, "left_semi")), keys).unionByName(rest)


def lower_az(c):
    """Lower-case A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, UPPER_AZ, LOWER_AZ)
