"""String functions as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content when a claim is compared with its sources.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "of", "to", "in", "on", "for",
    "and", "or", "by", "at", "as", "this", "that", "it", "its", "be", "with",
)

#: Blanks in the sense of Unicode, and the four separators that Java leaves out.
_BLANK = r"[\s\x1c-\x1f]"
BLANK = "(?U)" + _BLANK


def strip(c: Column) -> Column:
    """Without blanks at either end."""
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|(?<!{_BLANK}){_BLANK}+\z", "")


def clean_text(c: Column) -> Column:
    """NUL removed, runs of spaces and tabs made one space, of three or more newlines two; stripped."""
    c = F.regexp_replace(c, r"\x00", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def html_to_text(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags dropped, block ends as newlines, common entities resolved."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|li|tr|article)>|<br[ /]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return clean_text(c)


def words(c: Column) -> Column:
    """The text cut at runs of blanks."""
    return F.filter(F.split(c, BLANK + "+"), lambda w: w != "")


def chunk_texts(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of ``size`` words, each ``overlap`` words into the one before; ends with the first that reaches the end."""
    step = size - overlap
    return F.transform(F.array(words(c)), lambda w: _windows(w, size, step))[0]


def _windows(w: Column, size: int, step: int) -> Column:
    n = F.size(w)
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(float(step)))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.array_join(F.slice(w, j * step + 1, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(parts)


def paper_of(chunk_id: Column) -> Column:
    return F.split_part(chunk_id, F.lit("#"), F.lit(1))


def abstract_of(chunk_id: Column) -> Column:
    return F.concat(paper_of(chunk_id), F.lit("#abstract"))


def normalize_entity(c: Column) -> Column:
    """Lower-case, stripped, letters, digits, underscores, blanks and hyphens only, runs of blanks as one space."""
    c = F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s\x1c-\x1f-]", "")
    return F.regexp_replace(c, BLANK + "+", " ")


def entity_id(name: Column) -> Column:
    """Content-addressed identifier of a name; names without content share that of 'unknown'."""
    plain = F.coalesce(F.nullif(normalize_entity(name), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("e_"), F.substring(F.sha1(plain), 1, 12))


def first_sentence(c: Column) -> Column:
    """What precedes the first '. ', and a full stop; null counts as empty text without an answer."""
    return F.coalesce(F.concat(F.substring_index(c, ". ", 1), F.lit(".")), F.lit(""))


def short_title(c: Column, most: int = 60) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def strip_code_fence(c: Column) -> Column:
    """Texts that begin with a fence lose every line that does."""
    kept = F.filter(F.split(c, "\r\n|\r|\n"), lambda line: ~F.startswith(strip(line), F.lit("```")))
    return F.when(F.startswith(c, F.lit("```")), F.array_join(kept, "\n")).otherwise(c)


def unfenced(reply: Column) -> Column:
    """A model's reply without blanks at either end and without its code fence."""
    return strip(strip_code_fence(strip(reply)))


#: What Spark would let pass in JSON, and strict readers don't.
STRICT_JSON = {"allowSingleQuotes": "false"}


def json_value(reply: Column, schema: str) -> Column:
    """The first JSON value of a model's reply; null where it isn't of the schema's kind, or isn't strict JSON.

    A code fence is removed and what follows the value ignored.  Of a field that occurs
    twice the last counts, except inside a variant, where it makes the value unreadable.
    """
    return F.from_json(unfenced(reply), schema, STRICT_JSON)


def json_objects(text: Column) -> Column:
    """The objects of a JSON list, as JSON texts; other items are null, and so is what isn't a list."""
    written = F.from_json(text, "array<string>", STRICT_JSON)
    kinds = F.transform(F.from_json(text, "array<variant>", STRICT_JSON), F.schema_of_variant)
    # no variant can be read where a field is repeated: then only what looks like an object is known
    told = F.zip_with(written, kinds, lambda item, kind: F.when(F.startswith(kind, F.lit("OBJECT")), item))
    return F.coalesce(told, F.transform(written, lambda item: F.when(F.startswith(item, F.lit("{")), item)))


def alnum_tokens(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def content_tokens(c: Column) -> Column:
    return F.array_except(alnum_tokens(c), F.array(*map(F.lit, STOPWORDS)))


def judge_tokens(c: Column) -> Column:
    """Distinct words after everything but ASCII letters, digits and blanks became a space."""
    return F.array_distinct(words(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s\x1c-\x1f]", " ")))


def coverage(part: Column, whole: Column, if_empty: float) -> Column:
    """Share of the distinct elements of ``part`` that ``whole`` has."""
    n = F.size(part)
    return F.when(n == 0, F.lit(if_empty)).otherwise(F.size(F.array_intersect(part, whole)) / n.cast("double"))


def lexical_overlap(claim: Column, sources: Column) -> Column:
    """Share of the claim's content words found in any of ``sources`` (an array of texts); 1.0 without content words."""
    return coverage(content_tokens(claim), alnum_tokens(F.array_join(sources, " ")), 1.0)


def citations_markdown(citations: Column) -> Column:
    """A numbered list of claims with their chunk ids."""
    lines = F.transform(citations, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["claim"], F.lit("\n   `"), F.array_join(c["chunk_ids"], ", "), F.lit("`")))
    return F.array_join(lines, "\n")


def sources_block(candidates: Column, most: int = 500) -> Column:
    """Numbered excerpts (title and text of each element) with blank lines between."""
    return F.array_join(
        F.transform(candidates, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit('] (from "'), c["title"], F.lit('") '), F.substring(c["text"], 1, most))),
        "\n\n",
    )
