"""The encoding of a whole archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.encodings import decode_text, effective_encoding, lenient_charsets, locale_charset, sniff, utf8_class
from ..functions.paths import is_content, is_html, is_text, natural_key
from .content import matched

SAMPLE = 65536


def book_encodings(entries: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive_id, encoding, source) of archives(archive_id, lcid, locale_property).

    The sample is the second HTML document in natural order, or the only one; without any,
    the first text over 256 bytes. Where it doesn't tell, the locale does: the property's
    low 16 bits before the header's; else UTF-8."""
    # names and sizes choose the entry; one sample an archive is read after that
    names = entries.select("archive_id", "path", "entry_seq", F.octet_length("content").alias("size"))
    order = Window.partitionBy("archive_id").orderBy(natural_key(F.col("path")), "path")
    html = names.where(is_content(F.col("path")) & is_html(F.col("path"))).withColumn("place", F.row_number().over(order)).where("place <= 2")
    own = F.struct("entry_seq", "path")
    html = html.groupBy("archive_id").agg(F.max_by(own, "place").alias("html"))
    text = names.where(is_text(F.col("path")) & (F.col("size") > 256)).groupBy("archive_id").agg(F.min(own).alias("text"))
    chosen = matched(html, text, ["archive_id"], "full").select("archive_id", F.coalesce("html", "text").alias("c")).select("archive_id", "c.*")
    samples = entries.select("archive_id", "entry_seq", "path", F.substring("content", 1, SAMPLE).alias("sample"))
    samples = matched(samples, chosen, ["archive_id", "entry_seq", "path"]).select("archive_id", "sample")
    low = F.conv(F.concat(F.hex(F.substring("locale_property", 2, 1)), F.hex(F.substring("locale_property", 1, 1))), 16, 10).cast("int")
    lcid = F.when(F.octet_length("locale_property") >= 4, low).otherwise(F.col("lcid").bitwiseAND(0xFFFF))
    joined = matched(archives, samples, ["archive_id"], "left")
    seen = joined.select("archive_id", sniff(F.col("sample")).alias("s"), locale_charset(lcid).alias("by_locale"))
    return seen.select(
        "archive_id",
        F.coalesce("s.encoding", "by_locale", F.lit("utf-8")).alias("encoding"),
        F.when(F.col("s").isNotNull(), F.col("s.source")).when(F.col("by_locale").isNotNull(), "lcid").otherwise("default").alias("source"),
    )


def redecoded(entries: DataFrame, encodings: DataFrame, overrides: DataFrame) -> DataFrame:
    """(archive_id, entry_seq, path, encoding, text) of the entries of archives whose encoding is overridden.

    entries(archive_id, entry_seq, path, content), encodings(archive_id, encoding) and
    overrides(archive_id, override); an empty override goes back to what is found for each
    document. Contents files, indexes and documents are entries alike, so sitemap_nodes() and
    all after it are made anew from these texts; other archives aren't read."""
    chosen = matched(overrides.where(F.col("override").isNotNull()), encodings.select("archive_id", "encoding"), ["archive_id"], "left")
    rows = matched(entries, chosen, ["archive_id"])
    with lenient_charsets(entries.sparkSession):
        own = rows.withColumn("encoding", effective_encoding(F.col("content"), F.col("override"), F.col("encoding")))
        texts = own.select("archive_id", "entry_seq", "path", "encoding", decode_text(F.col("content"), F.col("encoding")).alias("text"))
        texts.schema  # analysed while the settings hold
    return texts


def _examined(entries: DataFrame) -> DataFrame:
    """(archive_id, encoding, source, class, chars, marks) of each document: what sniff() finds, the UTF-8 shape, and
    the signs and replacement characters of the decoded text."""
    with lenient_charsets(entries.sparkSession):
        found = entries.select("archive_id", "content", sniff(F.col("content")).alias("s"), utf8_class(F.col("content")).alias("class"))
        texts = found.select("archive_id", "s.encoding", "s.source", "class", decode_text(F.col("content"), F.col("s.encoding")).alias("text"))
        texts.schema  # analysed while the settings hold
    left = F.char_length(F.replace("text", F.lit("\ufffd"), F.lit("")))
    return texts.select("archive_id", "encoding", "source", "class", F.char_length("text").alias("chars"), (F.char_length("text") - left).alias("marks"))


def encoding_report(entries: DataFrame, by: tuple[str, ...] = ("encoding", "source", "class")) -> DataFrame:
    """(archive_id, *by, documents, replaced) of entries(archive_id, content), and a last total with a null archive_id.

    encoding and source are what sniff() finds, null where nothing tells; class is the UTF-8 shape.
    The total has a value where all documents share it. replaced is the share of replacement
    characters in the decoded texts, null where these are empty."""
    rows = _examined(entries)
    n = F.count(F.lit(1))
    shared = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == n), F.min(c))
    sums = (n.alias("documents"), F.sum("marks").alias("marks"), F.sum("chars").alias("chars"))
    groups = rows.groupBy("archive_id", *by).agg(*sums)
    share = F.try_divide("marks", "chars").alias("replaced")
    total = rows.agg(*sums, *[shared(c).alias(c) for c in by]).where("documents > 0")
    return groups.select("archive_id", *by, "documents", share).unionByName(total.select(F.lit(None).cast("string").alias("archive_id"), *by, "documents", share))


CUBED = ("archive_id", "encoding", "source", "class")


def encoding_cube(entries: DataFrame) -> DataFrame:
    """(archive_id, encoding, source, class, level, documents, replaced) for each set of these four columns.

    level is Spark's grouping_id: a bit a column, the archive's the highest, 1 where the
    column is summed over, so that a null of the data is told from one of a total. Documents
    are counted once by all four columns; the sets are sums of these counts."""
    cells = _examined(entries).groupBy(*CUBED).agg(F.count(F.lit(1)).alias("n"), F.sum("marks").alias("marks"), F.sum("chars").alias("chars"))
    sums = cells.cube(*CUBED).agg(F.grouping_id().cast("long").alias("level"), F.sum("n").alias("documents"), F.try_divide(F.sum("marks"), F.sum("chars")).alias("replaced"))
    return sums.select(*CUBED, "level", "documents", "replaced")
