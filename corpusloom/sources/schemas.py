"""The logical tables: DDL, unique keys, and which keys take nulls as equal."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Table:
    ddl: str
    keys: tuple[tuple[str, ...], ...]
    nulls_equal: bool = False


# Names, types and keys of the data model.
TABLES = {
    "authors": Table("id string, name string, slug string, sort_name string, bio string, url string, orcid string, openalex_id string", (("id",), ("slug",), ("orcid",), ("openalex_id",))),
    "affiliations": Table("id string, name string, slug string, type string, url string, ror string, openalex_id string", (("id",), ("slug",), ("ror",), ("openalex_id",))),
    "author_affiliations": Table("author_id string, affiliation_id string, starts_on date, is_primary boolean", (("author_id", "affiliation_id", "starts_on"),), True),
    "newsletter_sources": Table("affiliation_id string, sender string", (("affiliation_id",),)),
    "newsletter_source_aliases": Table("alias string, affiliation_id string", (("alias",),)),
    "articles": Table("id string, title string, affiliation_id string, canonical_url string, fetched_on date, body_html string, word_count int, body_confidence double, extraction_version int", (("id",), ("canonical_url", "fetched_on"))),
    "papers": Table("id string, title string, affiliation_id string, doi string, arxiv_id string, abstract string, body_html string, published date", (("id",), ("doi",), ("arxiv_id",))),
    "newsletter_issues": Table("id string, subject string, affiliation_id string, message_id string, body_html string, extraction_version int, is_forwarded boolean", (("id",), ("message_id",))),
    "authorships": Table("readable_type string, readable_id string, author_id string, ordinal int", ()),
    "users": Table("id string, email string, hanko_id string", (("id",), ("email",), ("hanko_id",))),
    "email_inboxes": Table("alias string, user_id string, created_at timestamp", (("alias",),)),
    "queue_items": Table("id string, user_id string, readable_type string, readable_id string, state string, added_at timestamp, started_at timestamp, finished_at timestamp", (("id",), ("user_id", "readable_type", "readable_id"))),
    "jobs": Table("id string, queue_name string, payload string, state string, attempts int, run_at timestamp, locked_until timestamp, error_class string, created_at timestamp", (("id",),)),
    "extraction_events": Table("url string, domain string, outcome string, error_class string, extractor string, word_count int, body_confidence double, entity_confidence double, fetch_ms int, extract_ms int, title_source string, author_source string, affiliation_source string, published_source string, created_at timestamp", ()),
    "tags": Table("id string, slug string, label string, embedding array<double>", (("id",), ("slug",))),
    "readable_tags": Table("tag_id string, readable_type string, readable_id string, confidence double", (("tag_id", "readable_type", "readable_id"),)),
    "queue_item_tags": Table("queue_item_id string, tag_id string, op string", (("queue_item_id", "tag_id"),)),
    "readable_embeddings": Table("readable_type string, readable_id string, embedding array<double>", (("readable_type", "readable_id"),)),
    "tagging_events": Table("readable_type string, readable_id string, outcome string, error_class string, model string, tag_count int, duration_ms int, created_at timestamp", ()),
    "eval_labels": Table("id string, feature string, readable_type string, readable_id string, subject_url string, label string, labeled_by string", (("id",), ("feature", "readable_type", "readable_id", "subject_url")), True),
    "eval_runs": Table("id string, feature string, status string, tp long, fp long, fn long, n long", (("id",),)),
    "eval_run_results": Table("run_id string, readable_type string, readable_id string, proposed array<string>", (("run_id", "readable_type", "readable_id"),)),
}
ENUMS = {
    "affiliation_type": ("journal", "preprint", "conference", "newsletter", "magazine", "newspaper", "blog", "publisher", "institution", "other"),
    "readable_type": ("article", "paper", "newsletter"),
    "queue_state": ("unread", "reading", "read", "archived"),
    "job_state": ("pending", "running", "done", "failed"),
    "tag_op": ("add", "suppress"),
    "outcome": ("done", "failed", "skipped"),
}
