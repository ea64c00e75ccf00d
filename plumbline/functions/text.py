"""Text analysis as Column functions: tokens, sizes, hashes, splits, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword ranking skips; fixed values.
STOPWORDS = (
    "a an and are as at be been but by can did do does for from had has have he "
    "her his how i if in into is it its of on or our that the their them then "
    "there these they this to was were what when where which who why will with "
    "you your"
).split()
#: Words that corpus checks skip; fixed values.
CHECK_STOPWORDS = (
    "a about after again an and are as at be before book books but by can do for from get getting "
    "good he help how i if in is it like make me my no not of on one or out read she so some "
    "something that the their them then there they this to too up was what when where which who "
    "why will with without would you your"
).split()
#: Words that headings made from titles skip; fixed values.
HEADING_STOPWORDS = "the of and a an in on to for how why what at by first".split()
#: Suffixes in the order in which they are tried; fixed values.
SUFFIXES = ("ing", "ers", "er", "ies", "es", "s")
#: Tokens a word counts for, as a fraction; fixed value.
TOKENS_PER_WORD = 1.3
#: Export artefacts that are no subject headings; a fixed pattern.
JUNK_SUBJECT = (
    r"(?i)^([\d.]+$|[A-Z]{1,3}\d+(\s|\.|$).*|.*\b(nyt|new york times):.*"
    r"|(accessible_book|protected_daisy|in_library|internet_archive|overdrive)"
    r"|lending_library|popular_print_disabled_books|large_type_books)$"
)
#: Phrases that settle how an event is booked; fixed values.
MUST_BOOK = ("booking required", "places are limited", "must be reserved", "tickets free but must be reserved")
DROP_IN = ("drop in", "no booking", "turn up", "no appointment", "without an appointment", "sign up any time")


def literals(words) -> Column:
    return F.array(*map(F.lit, words))


def lowered(text: Column) -> Column:
    """Lower case letter by letter, as in the SQL: no letter becomes two, none depends on its place in a word."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def trimmed(text: Column) -> Column:
    """White space off both ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lowered runs of ASCII letters and digits without stopwords; order and repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: ~t.isin(STOPWORDS))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.size(whitespace_words(F.coalesce(text, F.lit("")))) * F.lit(TOKENS_PER_WORD)).cast("long")


def content_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def runs(terms: Column, n: int | Column) -> Column:
    """Distinct runs of n neighbouring terms, joined by spaces."""
    n = F.lit(n) if isinstance(n, int) else n
    count = F.size(terms) - n + 1
    return F.when((n > 0) & (count > 0), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(terms, i, F.greatest(n, F.lit(1))), " ")))).otherwise(F.array().cast("array<string>"))


def distinct_ignoring_case(values: Column) -> Column:
    """The first of each spelling, in order."""
    return F.filter(values, lambda v, i: F.array_position(F.transform(values, F.lower), F.lower(v)) == i + 1)


def clean_subjects(raw: Column, most: int = 8) -> Column:
    flat = F.transform(raw, lambda s: trimmed(F.regexp_replace(s, r"\s+", " ")))
    real = F.filter(flat, lambda s: (s != "") & (F.length(s) <= 60) & ~s.rlike(JUNK_SUBJECT))
    return F.slice(distinct_ignoring_case(real), 1, most)


def stem(word: Column) -> Column:
    found = word
    for suffix in reversed(SUFFIXES):
        fits = (F.length(word) > len(suffix) + 3) & word.endswith(suffix)
        found = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(found)
    return found


def check_terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1)), lambda w: ~w.isin(CHECK_STOPWORDS) & (F.length(w) > 2))


def snippet(text: Column, width: int = 96) -> Column:
    """Flat text, cut at a word so that it fits the width with the mark `` ...``."""
    flat = trimmed(F.regexp_replace(text, r"\s+", " "))
    room = width - len(" ...")
    head = F.regexp_extract(F.concat(flat, F.lit(" ")), f"^(.{{1,{room}}})(?= )", 1)
    return F.when(F.length(flat) <= width, flat).when(head == "", F.lit("...")).otherwise(F.concat(head, F.lit(" ...")))


def digest_byte(text: Column, at: int) -> Column:
    """Byte ``at`` of the text's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 2 * at + 1, 2), 16, 10).cast("int")


def pick(seed: Column, options) -> Column:
    """The option that the first digest byte of the seed names."""
    return F.element_at(literals(options), digest_byte(seed, 0) % len(options) + 1)


def booking(description: Column, seed: Column) -> Column:
    low = F.lower(description)
    says = lambda phrases: F.exists(literals(phrases), lambda p: F.contains(low, p))
    return F.when(says(MUST_BOOK), "Book a place").when(says(DROP_IN), "Just turn up").when(digest_byte(seed, 3) % 3 == 0, "Book a place").otherwise("Just turn up")


def title_terms(title: Column) -> Column:
    return F.filter(F.regexp_extract_all(title, F.lit("([A-Za-z][A-Za-z'-]+)"), F.lit(1)), lambda w: ~F.lower(w).isin(HEADING_STOPWORDS) & (F.length(w) > 3))


def headings(title: Column, tags: Column, by_tag: Column) -> Column:
    """Headings of the tags, then one of the first two title terms; else the general one."""
    known = F.array_distinct(F.filter(F.transform(tags, lambda t: F.try_element_at(by_tag, F.lower(t))), lambda h: h.isNotNull()))
    terms = title_terms(title)
    own = F.when(F.size(terms) > 0, F.array(F.array_join(F.slice(terms, 1, 2), " -- "))).otherwise(F.array().cast("array<string>"))
    found = F.concat(known, own)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General works")))


def record_text(author: Column, year: Column, publisher: Column, subjects: Column) -> Column:
    """A catalogue record as labelled lines."""
    full = lambda c: F.nullif(c, F.lit(""))
    published = F.concat_ws(", ", full(publisher), full(year))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Author: "), F.coalesce(full(author), F.lit("[unknown]"))),
        F.concat(F.lit("Published: "), F.coalesce(full(published), F.lit("[no date]"))),
        F.when(F.size(subjects) > 0, F.concat(F.lit("Subjects: "), F.array_join(subjects, "; "))),
    )


def event_text(audience: Column, description: Column, when: Column, branch: Column, booked: Column, cost: Column) -> Column:
    """An event listing as labelled lines."""
    line = lambda label, value: F.concat(F.lit(label), value)
    return F.concat_ws("\n", line("For: ", audience), line("When: ", when), line("Where: ", branch), F.concat(F.lit("Booking: "), booked, F.lit("   Cost: "), cost), line("About: ", description))


def decade(year: Column) -> Column:
    head = F.substring(year, 1, 3)
    return F.when(head.rlike(r"^\d+$"), F.concat(head, F.lit("0s")))


def enrichment_text(title: Column, questions: Column, synopsis: Column, topics: Column, entities: Column, period: Column, as_given: bool = False) -> Column:
    """What an enriched record embeds: its parts with a blank line between, blank parts left out.

    ``as_given``: title and synopsis stand as they are, blanks at their ends and empty ones included.
    """
    full = lambda c: F.nullif(trimmed(c), F.lit(""))
    own = (lambda c: F.coalesce(c, F.lit(""))) if as_given else full
    listed = lambda label, values, mark: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, mark)))
    return F.concat_ws(
        "\n\n",
        own(title),
        F.when(F.size(questions) > 0, F.array_join(questions, " ")),
        own(synopsis),
        listed("Topics: ", topics, ", "),
        listed("Related: ", entities, ", "),
        F.when(full(period).isNotNull(), F.concat(F.lit("Period: "), period)),
    )


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct values; null if neither has any."""
    return F.size(F.array_intersect(left, right)) / F.nullif(F.size(F.array_union(left, right)), F.lit(0))


def display_date(date: Column, pattern: str = "EEEE d MMMM yyyy") -> Column:
    """A date as it is shown, such as Tuesday 3 March 2026."""
    return F.date_format(date, pattern)


def url_id(text: Column) -> Column:
    """An id made of a title or URL part: lowered and quoted, with underscores for blanks."""
    return F.replace(F.url_encode(F.lower(F.regexp_replace(trimmed(text), r"\s+", "_"))), F.lit("+"), F.lit("%20"))


def html_escaped(text: Column) -> Column:
    """Text with the characters escaped that mean something in HTML."""
    found = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        found = F.replace(found, F.lit(sign), F.lit(name))
    return found
