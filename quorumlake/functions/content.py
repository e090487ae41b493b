"""Documents of text and image parts: struct<text, image>, of which one is null. An image is named by
its file or digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<text:string,image:string>"


def normalized_parts(parts: Column) -> Column:
    """Empty texts dropped, adjacent texts joined; the order of parts stays."""
    text = lambda p: p["image"].isNull()
    clean = F.filter(parts, lambda p: p["image"].isNotNull() | (F.coalesce(p["text"], F.lit("")) != ""))

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.concat(last["text"], p["text"]).alias("text"), F.lit(None).cast("string").alias("image"))))
        return F.when((F.size(done) > 0) & text(p) & text(F.get(done, F.size(done) - 1)), joined).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(clean, F.array().cast(f"array<{PART}>"), add)


def is_document(parts: Column) -> Column:
    """Whether an image is left; without one, parts are their text."""
    return F.exists(parts, lambda p: p["image"].isNotNull())


def content_text(parts: Column, marker: str = "\n") -> Column:
    """The text, with ``marker`` in place of each image."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["image"].isNull(), F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(marker))), "")


def content_preview(parts: Column) -> Column:
    """The text for people to read, with the name of each image in its place."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["image"].isNull(), F.coalesce(p["text"], F.lit(""))).otherwise(
        F.concat(F.lit("[image: "), F.regexp_extract(p["image"], r"([^/]*)$", 1), F.lit("]")))), "")


def images_of(parts: Column) -> Column:
    """The images in order, each as often as it occurs."""
    return F.transform(F.filter(parts, lambda p: p["image"].isNotNull()), lambda p: p["image"])


def content_key(parts: Column) -> Column:
    """A digest that equal content has alike, however its parts were cut."""
    return F.sha2(F.to_json(normalized_parts(parts)).cast("binary"), 256)


def content_identities(docs: DataFrame, files: DataFrame, by: list[str], parts_col: str = "parts") -> DataFrame:
    """``docs`` (``by``, which names a row, and its parts) with ``identity``: SHA-256 over the parts in order, in which an
    image stands as the digest of its bytes. ``files`` has path and digest, as ``datasets.images`` gives them.

    Equal content is equal however its text was cut and wherever its images lie, and another image is
    another content. An image without a file is an error. Only documents with images meet the files.
    """
    own = docs.withColumn("_parts", normalized_parts(F.col(parts_col)))
    wanted = own.select(*by, F.explode(F.array_distinct(images_of(F.col("_parts")))).alias("path"))
    known = wanted.join(files.select("path", "digest").dropDuplicates(["path"]), "path", "left")
    found = F.when(F.col("digest").isNotNull(), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("no file of the image "), F.col("path"))))
    per = known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("path", found.alias("digest")))).alias("_digests"))
    joined = own.join(per, by, "left")

    def told(p: Column) -> Column:
        return F.when(p["image"].isNull(), F.concat(F.lit("t"), F.octet_length(p["text"]).cast("string"), F.lit(":"), p["text"])).otherwise(F.concat(F.lit("i"), F.try_element_at(F.col("_digests"), p["image"])))

    return joined.withColumn("identity", F.sha2(F.array_join(F.transform("_parts", told), ""), 256)).drop("_parts", "_digests")


def without_prefix(text: Column, prefix: Column) -> Column:
    """What follows ``prefix`` in ``text``; null if it does not start with it."""
    return F.when(text.startswith(prefix), F.substring(text, F.char_length(prefix) + 1, F.char_length(text)))
