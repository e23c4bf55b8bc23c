"""Line dedup that returns keep bitmaps (operator 8): DataFrame functions only.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  A key of at least ``MIN_CHARS`` code points that several documents hold
keeps its lines in the document with the smallest id only.  Keys are hashed twice to 64
bits; the hashes are range-partitioned with document and position as further columns,
so a line that a third of the documents share is spread over many ranges.  Each range is
read in order (windows with running frames): the first row of a hash names the document
that keeps it, the others lose their line.  A hash that goes on from one range to the next
gets its document from the last row of the earliest range that holds it: one row a range,
which is all that ranges tell each other.

``keep_bitmaps`` returns words of 32 bits by document, bit i of word w for line
32 * w + i, from word 0 up to the last word that drops a line, each in a long; compressed,
it returns only the words that drop lines, each with the number of words before it that
keep all.  Documents that lose nothing have no row.  ``apply_bitmaps`` puts either form on
the texts.

Defined results: a null or empty text is one empty line; rows that repeat an id are
parts of one document, each with a bitmap by its text; a null id comes after all
others; ties can't occur beyond that; other columns pass through ``apply_bitmaps``, unless
they have the names of its own three; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import materialize

MIN_CHARS = 10
#: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
#: Lines of one word of a bitmap, and the word that keeps all of them.
WORD = 32
FULL = (1 << WORD) - 1
#: Lines of a range, about, where the session's shuffle partitions would hold more.
PER_RANGE = 2_000_000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower_ascii(text: Column) -> Column:
    """A key under which two texts agree exactly if they do after lower-casing A-Z.

    Texts of ASCII characters are lower-cased; of others the bytes are read as Latin-1,
    whose lower case also maps the lead bytes C0-DE to E0-FE.  That keeps UTF-8 texts
    apart: those lead bytes differ in how many bytes follow, and no byte that follows
    one is changed.
    """
    latin = F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(latin)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, pos, h1, h2 of every line with a key that is long enough."""
    lines = docs.select("doc_id", text_key(F.col(text)).alias("text_key"), F.posexplode_outer(split_lines(F.col(text))).alias("pos", "line"))
    keys = lines.withColumn("key", F.btrim("line", F.lit(SPACES))).where(F.length("key") >= MIN_CHARS).withColumn("key", lower_ascii(F.col("key")))
    return keys.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def lost_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, pos of every line that goes."""
    hashes = materialize(line_hashes(docs, text), "line-hashes")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last(), F.col("pos")]
    ranges = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hashes.count() // PER_RANGE))
    ranged = hashes.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    in_range = Window.partitionBy("part").orderBy(*order)
    of_hash = Window.partitionBy("part", "h1", "h2").orderBy(*order[2:])
    running = (Window.unboundedPreceding, Window.currentRow)
    marked = ranged.repartitionById(ranges, F.col("part")).select(
        "*",
        F.first("doc_id").over(of_hash.rowsBetween(*running)).alias("keeper"),
        (F.first(F.struct("h1", "h2")).over(in_range.rowsBetween(*running)) == F.struct("h1", "h2")).alias("entered"),
        F.lead("h1").over(in_range).isNull().alias("ends"),
    )
    # rows that lose their line in the range or may do so by an earlier one, and the last row of each range
    open_ = materialize(marked.where(~F.col("doc_id").eqNullSafe(F.col("keeper")) | F.col("entered") | F.col("ends")), "line-ranges")
    carried = open_.where("ends").groupBy("h1", "h2").agg(F.min(F.struct("part", "keeper")).alias("from"))  # at most one row a range
    rows = open_.join(F.broadcast(carried), ["h1", "h2"], "left")
    keeper = F.when(F.col("from").isNull(), F.col("keeper")).otherwise(F.col("from.keeper"))
    return rows.where(~F.col("doc_id").eqNullSafe(keeper)).select("doc_id", "text_key", "pos")


def keep_bitmaps(docs: DataFrame, text: str = "text", compressed: bool = False) -> DataFrame:
    """doc_id, text_key, n_dropped, keep_bitmap of the documents that lose lines.

    keep_bitmap is array<long>, or array<struct<skip: int, bits: long>> if ``compressed``.
    """
    lost = lost_lines(docs, text)
    bit = F.pow(F.lit(2), F.col("pos") % WORD).cast("long")
    words = lost.groupBy("doc_id", "text_key", (F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    by_doc = words.groupBy("doc_id", "text_key").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    before = lambda i: F.when(i > 0, F.get(F.col("words"), i - 1)["word"]).otherwise(F.lit(-1))
    runs = F.transform("words", lambda e, i: F.struct((e["word"] - before(i) - 1).alias("skip"), (F.lit(FULL) - e["bits"]).alias("bits")))
    return by_doc.select("doc_id", "text_key", "n_dropped", (runs if compressed else plain(runs)).alias("keep_bitmap"))


def plain(runs: Column) -> Column:
    """The words of a compressed bitmap, one by one."""
    return F.flatten(F.transform(runs, lambda e: F.concat(F.array_repeat(F.lit(FULL), e["skip"]), F.array(e["bits"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", kept: str = "kept_text") -> DataFrame:
    """``docs`` with ``kept`` (the lines that stay, joined by newlines), n_lines and n_dropped."""
    compressed = isinstance(bitmaps.schema["keep_bitmap"].dataType.elementType, StructType)
    id_, key, dropped, bitmap, own = (f"_{uuid.uuid4().hex}" for _ in range(5))  # no column of the documents
    words = plain(F.col("keep_bitmap")) if compressed else F.col("keep_bitmap")
    named = bitmaps.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("n_dropped").alias(dropped), words.alias(bitmap))
    rows = docs.withColumn(own, text_key(F.col(text)))
    rows = rows.join(named, F.col(own).eqNullSafe(F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    lines = split_lines(F.col(text))
    bit = lambda i: F.get(F.col(bitmap), (i / WORD).cast("int")).bitwiseAND(F.pow(F.lit(2), i % WORD).cast("long"))
    stay = F.array_join(F.filter(lines, lambda _, i: F.coalesce(bit(i) != 0, F.lit(True))), "\n")
    out = rows.withColumns(
        {kept: F.when(F.col(bitmap).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(stay), "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.col(dropped), F.lit(0)).cast("long")}
    )
    return out.drop(own, id_, key, dropped, bitmap)
