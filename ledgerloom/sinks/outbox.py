"""Request bodies for stores and blogs, one JSON text per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions import text
from ledgerloom.schemas import moment

# The store's name limit and the note added to products that come with a file.
NAME_CHARS = 64
FILE_NOTE = "\n\n📎 **File included:** "
FILE_NOTE_END = "\n*Download link sent automatically after purchase.*"


def listing_batch(requests: DataFrame) -> DataFrame:
    """Listings to publish, from product_id, title, description, price_cents and file_path."""
    file = F.concat(F.lit(FILE_NOTE), text.base_name(F.col("file_path")), F.lit(FILE_NOTE_END))
    note = F.when(text.not_empty(F.col("file_path")).isNotNull(), file).otherwise(F.lit(""))
    rows = requests.select(
        "product_id",
        text.cut(F.col("title"), NAME_CHARS).alias("name"),
        F.concat("description", note).alias("description"),
        "price_cents",
        (F.col("price_cents") == 0).alias("is_free"),
    )
    body = F.to_json(F.struct("name", "description", F.col("price_cents").alias("price"), "is_free"))
    return rows.withColumn("body", body)


def post_batch(articles: DataFrame, as_of: str) -> DataFrame:
    """Blog posts to create, from id, title, html, status, tags and meta_description.

    Fields that a post does not have are left out of its body.
    """
    tags = F.when(F.size("tags") > 0, F.transform("tags", lambda t: F.struct(t.alias("name"))))
    meta = text.not_empty(F.col("meta_description"))
    published = F.when(F.col("status") == "published", F.date_format(moment(as_of), "yyyy-MM-dd'T'HH:mm:ssxxx"))
    optional = [text.not_empty(F.col(c)).alias(c) for c in ("feature_image", "canonical_url") if c in articles.columns]
    post = F.struct(
        "title", "html", "status", tags.alias("tags"), meta.alias("meta_description"),
        meta.alias("og_description"), *optional, published.alias("published_at"),
    )
    return articles.select("id", F.to_json(F.struct(F.array(post).alias("posts"))).alias("body"))
