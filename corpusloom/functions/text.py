"""Names, bylines, labels, counts: pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be these for right results.
LEADING_ARTICLES = ["the", "a", "an"]
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "da", "di", "du", "dos", "das", "la", "le", "el", "al", "bin", "ibn", "ben", "st", "st."]
NAME_SUFFIXES = ["jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "phd", "md", "esq"]
TITLE_STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "how", "why", "what", "is", "are", "your", "you", "this", "that", "from", "by", "at", "as"]
MAILING_WORDS = r"(?i)newsletter|news|daily|weekly|digest|updates?|team|editors?"
VENUE_TYPES = {"journal": "journal", "repository": "preprint", "conference": "conference", "book series": "journal", "ebook platform": "other", "metadata": "other", "other": "other"}
WORDS_PER_MINUTE = 238
MAX_NAME, MAX_LABEL, MAX_TAGS, MAX_AUTHORS = 200, 60, 12, 50
BYLINE_START, BYLINE_BREAK = r"(?i)^\s*by\s+", r"\s*(?:,|;|&|\band\b)\s*"
FORWARD = r"(?i)^(?:\s*(?:fwd?|tr|wg)\s*:\s*){1,5}"


def blank_to_null(s: Column) -> Column:
    return F.nullif(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit(""))


def slugify(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sort_name(name: Column) -> Column:
    """``Last, First`` for a name of two capitalised parts that are no article, particle or suffix; else null."""
    parts = F.split(F.regexp_replace(name, r"^\s+|\s+$", ""), r"\s+")
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    capital = lambda c: c.rlike(r"^\p{Lu}")
    plain = ~F.lower(first).isin(LEADING_ARTICLES + PARTICLES + NAME_SUFFIXES) & ~F.lower(last).isin(NAME_SUFFIXES)
    return F.when((F.size(parts) == 2) & plain & capital(first) & capital(last), F.concat(last, F.lit(", "), first))


def split_byline(s: Column, distinct: bool = False) -> Column:
    """The names of a byline; null gives none. Mail bylines drop repeats."""
    body = F.regexp_replace(F.coalesce(s, F.lit("")), BYLINE_START, "")
    names = F.filter(F.transform(F.split(body, BYLINE_BREAK), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_distinct(names) if distinct else names


def person_like(s: Column) -> Column:
    n = count_words(s)
    return F.coalesce((n >= 2) & (n <= 4) & ~s.rlike(MAILING_WORDS), F.lit(False))


def strip_html(s: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.regexp_replace(s, r"(?s)<[^>]+>", " "), r"\s+", " "))


def count_words(s: Column) -> Column:
    return F.coalesce(F.regexp_count(s, F.lit(r"\S+")), F.lit(0))


def reading_seconds(words: Column) -> Column:
    return F.ceil(words * 60 / F.lit(float(WORDS_PER_MINUTE))).cast("long")


def clamp_name(s: Column) -> Column:
    return F.left(blank_to_null(s), F.lit(MAX_NAME))


def clamp_label(s: Column) -> Column:
    return F.left(F.lower(blank_to_null(s)), F.lit(MAX_LABEL))


def clamp_confidence(x: Column) -> Column:
    """A number in [0, 1]; 1 where there is none."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))), F.lit(1.0))


def document_text(title: Column, abstract: Column, body: Column, limit: int = 2000) -> Column:
    return F.left(F.concat_ws("\n\n", title, abstract, body), F.lit(limit))


def title_tags(title: Column) -> Column:
    """The first two different telling words of a title."""
    words = F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(TITLE_STOPWORDS))), 1, 2)


def is_forward_subject(s: Column) -> Column:
    return F.coalesce(s.rlike(r"(?i)^\s*(?:fwd?|tr|wg)\s*:"), F.lit(False))


def strip_forward(s: Column) -> Column:
    return blank_to_null(F.regexp_replace(s, FORWARD, ""))


def mail_domain(email: Column) -> Column:
    return blank_to_null(F.get(F.split(email, "@"), F.lit(1)))


def domain_alias(email: Column) -> Column:
    return F.concat(F.lit("@"), mail_domain(email))


def site_name(email: Column) -> Column:
    """The label before the last of a mail domain, capitalised."""
    labels = F.split(mail_domain(email), r"\.")
    label = F.when(F.size(labels) >= 2, F.get(labels, F.size(labels) - 2)).otherwise(F.get(labels, F.lit(0)))
    return F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substr(label, F.lit(2))))


def heading(s: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.lower(s), r"\s+", " "))


def plain_to_html(s: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    paragraphs = F.transform(F.split(blank_to_null(escaped), r"(?:\r?\n){2,}"), lambda p: F.concat(F.lit("<p>"), F.regexp_replace(p, r"\r?\n", "<br>"), F.lit("</p>")))
    return F.array_join(paragraphs, "")


def csv_set(s: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def venue_type(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in VENUE_TYPES.items() for x in kv])[kind], F.lit("other"))
