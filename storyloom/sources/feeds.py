"""Feed lists and feed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.feed_xml import recovered_batch
from storyloom.functions.html import unwrap_feed_xml
from storyloom.functions.text import trim_ws
from storyloom.functions.time import parse_feed_time
from storyloom.session import bound_batches

# An accepted answer of a challenge solver.
SOLVER_SCHEMA = "status string, message string, solution struct<status: int, response: string>"
SOLVER_OK, SOLVER_HTTP_OK = "ok", 200
# Fixed value: how the log message of an unreadable document begins.
PARSE_FAILED = "Failed to parse feed: "

_LINK = "struct<_href: string, _rel: string, _VALUE: string>"
RSS_ITEM = "struct<title: string, link: string, pubDate: string, `dc:date`: string, description: string>"
ATOM_ENTRY = f"struct<title: string, link: array<{_LINK}>, published: string, updated: string, summary: string>"


def parse_feed_list(lines: DataFrame) -> DataFrame:
    """Feed urls of a line list (column ``value``): trimmed, without blanks and ``#`` comments."""
    url = trim_ws(F.col("value"))
    return lines.select(url.alias("feed_url")).filter((F.col("feed_url") != "") & ~F.startswith("feed_url", F.lit("#")))


def read_feed_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_feed_list(spark.read.text(path))


def solver_response(envelope: Column) -> Column:
    """The document inside a solver's JSON answer, or NULL when it did not succeed."""
    answer = F.from_json(envelope, SOLVER_SCHEMA)
    ok = (answer["status"] == SOLVER_OK) & (answer["solution"]["status"] == SOLVER_HTTP_OK)
    return F.when(ok, answer["solution"]["response"])


#: What may stand before the root element, and the root: prefix and name.
_PROLOG = r"(?s)^(?:\s|\ufeff|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>)*"
_ROOT = _PROLOG + r"<(?:([\w.-]+):)?([\w.-]+)"


def feed_kind(xml: Column) -> Column:
    """``rss``, ``rdf`` or ``atom`` by the root element alone, NULL for anything else."""
    name = F.lower(F.regexp_extract(xml, _ROOT, 2))
    return F.when(name == "rss", "rss").when(name == "rdf", "rdf").when(name == "feed", "atom")


def _unprefixed(xml: Column) -> Column:
    """Elements of a prefixed Atom document without their prefix."""
    prefix = F.regexp_extract(xml, _ROOT, 1)
    pattern = F.concat(F.lit("<(/?)"), prefix, F.lit(":"))
    return F.when(prefix == "", xml).otherwise(F.regexp_replace(xml, pattern, F.lit("<$1")))


#: Where a strict parser puts a document that it can't read.
_DEFECT = "_corrupt_record"
_RSS = f"channel struct<item: array<{RSS_ITEM}>>, {_DEFECT} string"
_RDF = f"item array<{RSS_ITEM}>, {_DEFECT} string"  # RSS 1.0: items stand beside the channel
_ATOM = f"entry array<{ATOM_ENTRY}>, {_DEFECT} string"


def _rss_fields(item: Column) -> Column:
    return F.struct(
        item["title"].alias("title"),
        item["link"].alias("link"),
        F.coalesce(item["pubDate"], item["dc:date"]).alias("published"),
        item["description"].alias("description"),
    )


def _atom_fields(entry: Column) -> Column:
    alternate = F.filter(entry["link"], lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    return F.struct(
        entry["title"].alias("title"),
        F.try_element_at(alternate, F.lit(1))["_href"].alias("link"),
        F.coalesce(entry["published"], entry["updated"]).alias("published"),
        entry["summary"].alias("description"),
    )


def parsed_documents(documents: DataFrame) -> DataFrame:
    """(feed_url, xml) to (feed_url, kind, items, defect), one row a document.

    Well-formed documents are read by Spark's parser. Of others, ampersands and named references of HTML are
    mended; items that end before a worse defect are kept and the defect is told. ``kind`` is NULL for documents
    that are no feed, which have no items.
    """
    xml, kind = F.col("xml"), F.col("kind")
    known = documents.select("feed_url", "xml", feed_kind(F.col("xml")).alias("kind"))
    strict = known.select(
        "feed_url",
        "xml",
        "kind",
        F.when(kind == "rss", F.from_xml(xml, _RSS)).alias("_rss"),
        F.when(kind == "rdf", F.from_xml(xml, _RDF)).alias("_rdf"),
        F.when(kind == "atom", F.from_xml(_unprefixed(xml), _ATOM)).alias("_atom"),
    )
    broken = F.coalesce(*[F.col(f"{c}.{_DEFECT}") for c in ("_rss", "_rdf", "_atom")]).isNotNull()
    # Python sees the text of broken documents only.
    bound_batches(documents.sparkSession)
    mended = strict.withColumn("_mended", recovered_batch(F.when(broken, xml)))
    items = (
        F.when(broken, F.col("_mended.items"))
        .when(kind == "rss", F.transform("_rss.channel.item", _rss_fields))
        .when(kind == "rdf", F.transform("_rdf.item", _rss_fields))
        .when(kind == "atom", F.transform("_atom.entry", _atom_fields))
    )
    return mended.select("feed_url", "kind", items.alias("items"), F.col("_mended.defect").alias("defect"))


def document_outcomes(parsed: DataFrame) -> DataFrame:
    """(feed_url, status, message, articles_found, detail) of ``parsed_documents``.

    A document that could not be read to its end is an error, also if items before the defect were found.
    """
    readable = F.col("kind").isNotNull() & F.col("defect").isNull()
    detail = F.concat(F.lit(PARSE_FAILED), F.coalesce("defect", F.lit("not a feed")))
    return parsed.select(
        "feed_url",
        F.when(readable, "success").otherwise("error").alias("status"),
        F.when(readable, "").otherwise("parse_failed").alias("message"),
        F.coalesce(F.size("items"), F.lit(0)).alias("articles_found"),
        F.when(readable, "").otherwise(detail).alias("detail"),
    )


def parse_outcomes(documents: DataFrame) -> DataFrame:
    """``document_outcomes`` of (feed_url, xml)."""
    return document_outcomes(parsed_documents(documents))


def feed_rows(parsed: DataFrame) -> DataFrame:
    """One row per item of ``parsed_documents``, in document order."""

    def fields(item: Column) -> Column:
        return F.struct(
            trim_ws(item["link"]).alias("link"),
            item["title"].alias("title"),
            parse_feed_time(item["published"]).alias("published"),
            item["description"].alias("description"),
        )

    # Dates are read inside the lists: as part of the stage that lists the items, their code is too long to compile.
    read = parsed.select("feed_url", F.posexplode(F.transform("items", fields)).alias("item_no", "item"))
    return read.select("feed_url", F.col("item_no").cast("long").alias("item_no"), "item.*")


def parse_feeds(documents: DataFrame) -> DataFrame:
    """(feed_url, xml) to one row per item, RSS 2.0, RSS 1.0 and Atom alike, in document order.

    Documents of other kinds have no items; ``parse_outcomes`` tells which they are, and which have defects.
    """
    return feed_rows(parsed_documents(documents))


def read_rss_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files, split by the reader, so one huge file is read by many tasks."""
    schema = "title string, link string, pubDate string, description string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select(
        F.col("_metadata.file_path").alias("feed_url"),
        trim_ws(F.col("link")).alias("link"),
        "title",
        parse_feed_time(F.col("pubDate")).alias("published"),
        "description",
    )


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed documents of any kind (XML, browser shell): (feed_url = file path, xml)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("feed_url"), unwrap_feed_xml(F.col("value")).alias("xml"))


def stream_feed_files(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """Items of feed documents as they land in ``path``."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    documents = files.select(
        F.col("_metadata.file_path").alias("feed_url"), unwrap_feed_xml(F.col("value")).alias("xml")
    )
    return parse_feeds(documents)
