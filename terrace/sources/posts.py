"""Landed social payloads to raw reactions.

Every reader takes (fixture_id, payload_order, payload) with the JSON text as
landed and returns ``fixture_id, created_utc, message, source, author,
ingest_seq``. Malformed payloads parse to NULL and give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import schemas
from terrace.functions.text import parse_utc, strip, strip_tags
from terrace.operators.cleaning import keep_first, union_sources


def _sequence() -> Column:
    """Place of an item: its payload, then its position in it. A struct, so no size makes two places alike."""
    return F.struct(F.col("payload_order").cast("bigint").alias("payload_order"), F.col("_pos").alias("position"))


def _items(landed: DataFrame, schema: str, path: str | None) -> DataFrame:
    parsed = F.from_json("payload", schema)
    items = parsed
    for name in path.split(".") if path else []:
        items = items[name]
    return landed.select(
        "fixture_id", "payload_order", F.posexplode(items).alias("_pos", "_item")
    ).withColumn("ingest_seq", _sequence())


def conform(rows: DataFrame) -> DataFrame:
    """The raw reaction schema: blank author, UTC time, trimmed non-empty message."""
    created = F.col("created_utc")
    stamp = created if dict(rows.dtypes)["created_utc"].startswith("timestamp") else parse_utc(created)
    return rows.select(
        "fixture_id", stamp.alias("created_utc"),
        strip(F.coalesce(F.col("message"), F.lit(""))).alias("message"), "source",
        F.coalesce("author", F.lit("")).alias("author"), "ingest_seq",
    ).filter(F.col("created_utc").isNotNull() & (F.col("message") != ""))


def post_pages(landed: DataFrame) -> DataFrame:
    """Pages of posts; the first of each uri counts."""
    rows = _items(landed, schemas.POST_PAGE, "posts").select(
        "fixture_id", "ingest_seq", F.coalesce("_item.uri", F.lit("")).alias("_id"),
        F.col("_item.record.createdAt").alias("created_utc"), F.col("_item.record.text").alias("message"),
        F.lit("bluesky").alias("source"), F.col("_item.author.handle").alias("author"),
    )
    return conform(keep_first(rows, ["fixture_id", "_id"]))


def tag_timelines(landed: DataFrame) -> DataFrame:
    """Hashtag timelines; tags become a space, the first of each id counts."""
    rows = _items(landed, schemas.TAG_TIMELINE, None).select(
        "fixture_id", "ingest_seq", F.coalesce("_item.id", F.lit("")).alias("_id"),
        F.col("_item.created_at").alias("created_utc"), strip_tags(F.col("_item.content")).alias("message"),
        F.lit("mastodon").alias("source"), F.col("_item.account.acct").alias("author"),
    )
    return conform(keep_first(rows, ["fixture_id", "_id"]))


def match_threads(searches: DataFrame) -> DataFrame:
    """First thread per fixture whose title says it is a match thread."""
    found = _items(searches, schemas.THREAD_SEARCH, "data.children").select(
        "fixture_id", "ingest_seq", F.col("_item.data.id").alias("thread_id"), F.col("_item.data.title").alias("title")
    )
    titled = found.filter(F.contains(F.lower("title"), F.lit("match thread")))
    return keep_first(titled, ["fixture_id"]).select("fixture_id", "thread_id")


def thread_comments(comments: DataFrame, threads: DataFrame) -> DataFrame:
    """Comments of the chosen threads; ``comments`` also carries thread_id."""
    parsed = F.from_json("payload", schemas.THREAD_COMMENTS)
    rows = (
        comments.join(threads, ["fixture_id", "thread_id"])
        .select("fixture_id", "payload_order", F.posexplode(F.get(parsed, F.lit(1))["data"]["children"]).alias("_pos", "_item"))
        .withColumn("ingest_seq", _sequence())
        .filter(F.col("_item.kind") == "t1")
    )
    micros = F.coalesce("_item.data.created_utc", F.lit(0.0)) * 1_000_000
    return conform(rows.select(
        "fixture_id", "ingest_seq", F.timestamp_micros(micros.cast("bigint")).alias("created_utc"),
        F.col("_item.data.body").alias("message"), F.lit("reddit").alias("source"),
        F.col("_item.data.author").alias("author"),
    ))


def live_chat(landed: DataFrame) -> DataFrame:
    """Stream chat messages."""
    return conform(_items(landed, schemas.LIVE_CHAT, "items").select(
        "fixture_id", "ingest_seq", F.col("_item.snippet.publishedAt").alias("created_utc"),
        F.col("_item.snippet.displayMessage").alias("message"), F.lit("youtube").alias("source"),
        F.col("_item.authorDetails.displayName").alias("author"),
    ))


def answer_text(answer: Column) -> Column:
    """Text of a search answer: the short field, else the message parts by line."""
    messages = F.filter(answer["output"], lambda o: o["type"] == "message")
    parts = F.filter(
        F.flatten(F.transform(messages, lambda o: F.transform(o["content"], lambda p: p["text"]))),
        lambda t: F.coalesce(t, F.lit("")) != "",
    )
    return F.coalesce(answer["output_text"], F.array_join(parts, "\n"))


def search_answers(landed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Posts listed as a JSON array inside an answer's text.

    Anything that is not an array gives no rows; a post without a time takes
    the ingest time.
    """
    text = answer_text(F.from_json("payload", schemas.SEARCH_ANSWER))
    listed = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    posts = F.from_json(listed, schemas.SEARCH_POSTS)
    now = F.date_format(F.current_timestamp() if as_of is None else as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = landed.select("fixture_id", "payload_order", F.posexplode(posts).alias("_pos", "_item")).filter(
        F.col("_item").isNotNull()
    )

    def filled(*names: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"_item.{n}") != "", F.col(f"_item.{n}")) for n in names])

    return conform(rows.select(
        "fixture_id", _sequence().alias("ingest_seq"), F.coalesce(filled("created_at"), now).alias("created_utc"),
        F.col("_item.text").alias("message"), F.lit("x").alias("source"), filled("handle", "author").alias("author"),
    ))


def gather(parts: list[DataFrame]) -> DataFrame:
    """All sources under one ingestion order."""
    merged = union_sources(parts)
    return merged.withColumn("ingest_seq", F.struct("source_rank", F.col("ingest_seq").alias("place"))).drop("source_rank")
