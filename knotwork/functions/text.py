"""Text expressions on columns; all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that queries ignore.
STOPWORDS = "a an and are as at be by for from has have in into is it its of on or that the their this to was were will with".split()
# Words that mark a statement as negative, an issue, a solution, a dependency.
NEGATIVE = "not no never none nobody nothing nowhere neither false incorrect wrong deprecated removed unsupported discontinued retired invalid".split()
ISSUE = "block blocks blocked blocking error fail failure problem issue".split()
SOLUTION = "fix fixes fixed solve solves solving resolve resolved".split()
DEPENDENCY = "depend depends depending dependency".split()
# Provenance words of high and low trust; high is tested first, as substrings.
HIGH_TRUST = "official verified system user doc docs documentation".split()
LOW_TRUST = "guess hearsay unsure unverified unknown".split()


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def tokens(text: Column, least: int = 2, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct lower-case alphanumeric words in order, without short words and stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{Nd}\s]+", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= least))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, stopwords))) if stopwords else F.array_distinct(words)


def words(text: Column) -> Column:
    """ASCII words for marker tests."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_']+"), lambda w: w != "")


def negative(text: Column) -> Column:
    return F.arrays_overlap(words(text), F.array(*map(F.lit, NEGATIVE)))


def mentions_any(text: Column, markers: list[str]) -> Column:
    """Substring test, so that every inflection counts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return out


def overlap(query_tokens: Column, content_tokens: Column) -> Column:
    """Share of the query's tokens that the content holds; 0 if either has none."""
    hit = F.size(F.array_intersect(query_tokens, content_tokens)) / F.greatest(F.size(query_tokens), F.lit(1))
    return F.when((F.size(query_tokens) == 0) | (F.size(content_tokens) == 0), F.lit(0.0)).otherwise(hit)


def alias_list(aliases: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(aliases, F.lit("")), r"[,|;]"), lambda a: F.trim(a)), lambda a: a != "")


def truncated(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def squish(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snake_case(name: Column) -> Column:
    plain = F.regexp_replace(name, "::", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))


def camelize(name: Column) -> Column:
    """``user_profile`` as ``UserProfile``, ``api/user`` as ``Api::User``."""
    first = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))

    def put(p: Column) -> Column:
        run = F.regexp_extract(p, "^[_/]([A-Za-z0-9]*)", 1)
        capital = F.concat(first(F.lower(run)), F.substr(p, F.length(run) + 2))
        return F.when(F.startswith(p, F.lit("_")), capital).when(F.startswith(p, F.lit("/")), F.concat(F.lit("::"), capital)).when(F.rlike(p, F.lit("^[a-z]")), first(p)).otherwise(p)

    return F.array_join(F.transform(F.split(name, "(?=[_/])"), put), "")


def compose_entity_text(entity_type: Column, name: Column, aliases: Column, description: Column) -> Column:
    """What is embedded of an entity: "type: name. Aliases: a. description", without blank parts."""
    head = F.concat_ws(": ", F.when(~blank(entity_type), entity_type), name)
    return F.concat_ws(". ", head, F.when(~blank(aliases), F.concat(F.lit("Aliases: "), aliases)), F.when(~blank(description), description))


def compose_observation_text(content: Column, source: Column, tags: Column) -> Column:
    return F.concat_ws("\n", content, F.when(~blank(source), F.concat(F.lit("Source: "), source)), F.when(~blank(tags), F.concat(F.lit("Tags: "), tags)))


def phrase_pattern(phrase: Column) -> Column:
    """Case-insensitive pattern that finds a phrase at word bounds, whatever but word characters stands between its words."""
    plain = F.regexp_replace(F.trim(phrase), r"([^A-Za-z0-9_\s])", r"\\$1")
    return F.concat(F.lit(r"(?i)(?:^|\W)"), F.regexp_replace(plain, r"\s+", r"\\W+"), F.lit(r"(?:$|\W)"))
