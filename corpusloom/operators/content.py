"""Readables as content: what a person sees, what a tagger takes in, and the rows that imports leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, count_words, document_text, reading_seconds, strip_html
from ..functions.urls import display_host, elapsed_ms, iso_day

PLACEHOLDER = "<p>No text is available here.</p>"


def content_view(items: DataFrame) -> DataFrame:
    """type, id, title, link, day, body of (type, id, title, url, published, body_html): one shape for all types."""
    link = F.when(F.col("type") != "newsletter", F.col("url"))
    return items.select("type", "id", F.coalesce(blank_to_null(F.col("title")), F.col("url")).alias("title"), link.alias("link"), iso_day(F.col("published")).alias("day"), F.coalesce(blank_to_null(F.col("body_html")), F.lit(PLACEHOLDER)).alias("body"))


def content_for(articles: DataFrame, papers: DataFrame, issues: DataFrame) -> DataFrame:
    """readable_type, readable_id, title, abstract, text: what a tagger reads, without markup."""
    body = lambda df: strip_html(F.col("body_html")) if "body_html" in df.columns else F.lit(None).cast("string")
    one = lambda df, kind, title, abstract: df.select(F.lit(kind).alias("readable_type"), F.col("id").cast("string").alias("readable_id"), F.col(title).alias("title"), abstract.alias("abstract"), body(df).alias("body"))
    none = F.lit(None).cast("string")
    rows = one(articles, "article", "title", none).unionByName(one(papers, "paper", "title", F.col("abstract") if "abstract" in papers.columns else none)).unionByName(one(issues, "newsletter", "subject", none))
    return rows.select("readable_type", "readable_id", "title", "abstract", document_text(F.col("title"), F.col("abstract"), F.col("body")).alias("text"))


def finalise_articles(extracted: DataFrame, version: int) -> DataFrame:
    """The columns of an article from an extracted page; the title falls back to the url."""
    return extracted.select(
        F.coalesce(F.col("title.value"), F.col("url")).alias("title"),
        F.col("canonical_url.value").alias("canonical_url"),
        F.col("language.value").alias("language"),
        F.col("published.value").alias("published"),
        "text", "word_count", reading_seconds(F.col("word_count")).alias("reading_seconds"), "body_confidence", F.lit(version).alias("extraction_version"),
    )


def extraction_event(extracted: DataFrame, started: Column, ended: Column, at: Column) -> DataFrame:
    """The log's row of a finished extraction."""
    return extracted.select(
        "url", display_host(F.col("url")).alias("domain"), F.lit("done").alias("outcome"), F.lit(None).cast("string").alias("error_class"), "word_count", "body_confidence",
        F.col("title.source").alias("title_source"), "author_source", F.col("site.source").alias("affiliation_source"), F.col("published.source").alias("published_source"),
        F.size("authors").alias("author_count"), elapsed_ms(started, ended).alias("extract_ms"), at.alias("created_at"),
    )


def failure_event(failed: DataFrame, error: Column, at: Column) -> DataFrame:
    return failed.select("url", display_host(F.col("url")).alias("domain"), F.lit("failed").alias("outcome"), error.alias("error_class"), at.alias("created_at"))


def owned_by(df: DataFrame, user_id) -> DataFrame:
    return df.where(F.col("user_id") == F.lit(user_id))


def not_archived(df: DataFrame) -> DataFrame:
    return df.where(F.col("state") != "archived")


def text_figures(df: DataFrame, text: str) -> DataFrame:
    n = count_words(F.col(text))
    return df.withColumns({"word_count": n, "reading_seconds": reading_seconds(n)})
