"""Text cleaning, classification and extraction as column expressions.

All of it stays in the JVM; every function takes a Column and returns one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import fixed


def contains_any(text: Column, words: list[str]) -> Column:
    """Does the text hold any of the words, as substrings?"""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text holds."""
    return sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def scrub(text: Column) -> Column:
    """Credentials replaced, pattern by pattern."""
    for _, pattern, replacement in fixed.CREDENTIALS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def scrub_report(text: Column) -> tuple[Column, Column]:
    """(number of redactions, names of the patterns that fired), counted on the text as
    each pattern meets it."""
    total, names = F.lit(0), []
    for name, pattern, replacement in fixed.CREDENTIALS:
        n = F.regexp_count(text, F.lit(pattern))
        total = total + n
        names.append(F.when(n > 0, F.lit(name)))
        text = F.regexp_replace(text, pattern, replacement)
    return total, F.array_compact(F.array(*names))


def has_credentials(text: Column) -> Column:
    found = F.lit(False)
    for _, pattern, _ in fixed.CREDENTIALS:
        found = found | text.rlike(pattern)
    return found


def is_noise(text: Column) -> Column:
    """Empty or tiny texts, short acknowledgements, dumps with few letters, output lines.
    Null counts as noise."""
    letters = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}]", ""))

    def judged(s: Column) -> Column:
        polite = F.lit(False)
        for p in fixed.ACKNOWLEDGEMENTS:
            polite = polite | s.rlike(p)
        output = let(F.split(s, "\n"), lambda lines: (F.size(lines) > 5) & (F.size(F.filter(lines, lambda x: x.rlike(fixed.OUTPUT_LINE))) / F.size(lines) > 0.6))
        return F.when(F.length(s) < 8, True).when((F.length(s) < 100) & polite, True).when((F.length(s) > 200) & (letters(s) / F.length(s) < 0.3), True).when(output, True).otherwise(False)

    return F.when(text.isNull(), True).otherwise(let(F.regexp_replace(text, r"^\s+|\s+$", ""), judged))


def classify(text: Column) -> tuple[Column, Column]:
    """(type, confidence): the type with most keywords, earlier types winning ties."""
    def best(lower: Column) -> Column:
        return F.array_max(F.array(*[F.struct(hits(lower, words).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(fixed.TYPE_KEYWORDS.items())]))

    found = let(let(F.lower(text), best), lambda b: F.struct(F.when(b["score"] > 0, b["name"]).otherwise("raw_exchange").alias("kind"), F.when(b["score"] >= 2, 0.85).when(b["score"] == 1, 0.7).otherwise(0.5).alias("confidence")))
    return found["kind"], found["confidence"]


def rule_type(text: Column) -> Column:
    """The first rule that matches, else a raw exchange."""
    lower, out = F.lower(text), None
    for name, words in fixed.RULES.items():
        out = (F.when if out is None else out.when)(contains_any(lower, words), F.lit(name))
    return out.otherwise("raw_exchange")


def topics(text: Column, most: int = 10, words: list[str] = fixed.TOPICS) -> Column:
    """Topic keywords in the text, alphabetically, the first ``most``."""
    found = let(F.lower(text), lambda lower: F.filter(F.array(*[F.lit(w) for w in sorted(words)]), lambda w: F.contains(lower, w)))
    return F.slice(found, 1, most)


def tech_topics(text: Column, most: int = 10) -> Column:
    """The same with the longer list of the heuristic extraction."""
    return topics(text, most, fixed.TECH_TOPICS)


def distinct_ignoring_case(items: Column) -> Column:
    """First spellings, in order."""
    def first(pair: Column) -> Column:
        return F.filter(pair["items"], lambda x, i: F.array_position(pair["lower"], pair["lower"][i]) == i + 1)

    with_lower = lambda x: F.struct(x.alias("items"), F.transform(x, lambda e: F.lower(e)).alias("lower"))
    return let(items, lambda x: let(with_lower(x), first))


WORD = r"\p{L}\p{N}_"


def unicode_words(pattern: str) -> str:
    """A pattern whose word characters, word ends, digits and spaces are those of all scripts,
    where Java's own are ASCII.  A word end before a class of characters that may begin with
    none of a word holds on either side, others on their inner side."""
    either = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
    if pattern.startswith(r"\b"):
        pattern = (either if pattern.startswith(r"\b[\w") else f"(?<![{WORD}])") + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = f"{pattern[:-2]}(?![{WORD}])"
    return pattern.replace(r"\w", WORD).replace(r"[^\s", r"[^\s\p{Z}\x85\x1C-\x1F").replace(r"\s+", r"[\s\p{Z}\x85\x1C-\x1F]+").replace(r"\d", r"\p{Nd}")


def entities(text: Column, most: int = 15) -> Column:
    """Hosts, paths, names, packages and versions, first spellings, the first ``most``."""
    found = [F.regexp_extract_all(text, F.lit(unicode_words(p)), F.lit(g)) for p, g in fixed.ENTITIES]
    found[0] = F.filter(found[0], lambda x: F.contains(x, F.lit(".")))
    return F.slice(distinct_ignoring_case(F.flatten(F.array(*found))), 1, most)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard likeness of the word sets; 0 if one is empty."""
    def likeness(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return let(F.struct(word_set(a).alias("x"), word_set(b).alias("y")), likeness)


def sentences(text: Column) -> Column:
    return F.split(text, r"[.!?]+\s+")


def facts(text: Column, most: int = 5) -> Column:
    """Sentences of 20 to 300 characters that hold a fact word."""
    trimmed = F.transform(sentences(text), lambda s: F.trim(s))
    kept = F.filter(trimmed, lambda s: F.length(s).between(20, 300) & contains_any(F.lower(s), fixed.FACT_WORDS))
    return F.slice(kept, 1, most)


def fact_value(facts_: Column) -> Column:
    return F.least(F.lit(0.3) + F.lit(0.15) * F.size(facts_), F.lit(1.0))


def predicate(text: Column) -> Column:
    """Lower case, other characters to single underscores."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "related_to").otherwise(out)


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def slug(text: Column, most: int = 80) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")


def token_estimate(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int")))


def triple_id(subject: Column, predicate_: Column, object_: Column, valid_from: Column) -> Column:
    text = F.concat_ws("|", subject, predicate_, object_, F.coalesce(valid_from.cast("string"), F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 32)


def implied_types(query: Column) -> Column:
    lower = F.lower(query)
    found = []
    for name, patterns in fixed.INTENTS.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | lower.rlike(p)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def since_days(query: Column) -> Column:
    """Days back that the first time phrase means; null without one."""
    lower, out = F.lower(query), None
    for phrase, days in fixed.TIME_PHRASES.items():
        out = (F.when if out is None else out.when)(lower.rlike(rf"\b{phrase}\b"), F.lit(days))
    return out


def clean_query(query: Column) -> Column:
    out = F.lower(query)
    for phrase in sorted(fixed.DROPPED_PHRASES, key=len, reverse=True):
        out = F.regexp_replace(out, rf"\b{phrase}\b", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(out == "", query).otherwise(out)


def strip_tags(text: Column) -> Column:
    """Captured text without its noise tags, and with at most one empty line in a row."""
    for tag in fixed.NOISE_TAGS:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts or styles, tags to spaces, six entities decoded."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    html = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def html_title(html: Column) -> Column:
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    return title


def strip_fence(text: Column) -> Column:
    """Model output without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def preview(text: Column, size: int = 160, least: int | None = None) -> Column:
    """The first ``size`` characters on one line, cut at the last space past ``least``
    (half the size if not given), with three dots where cut."""
    flat = F.trim(F.translate(text, "\n", " "))
    head = F.substring(flat, 1, size)
    space = F.lit(size + 1) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space - 1 > (size // 2 if least is None else least)), F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(cut, F.lit("...")))


def preview_collapsed(text: Column, size: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…")))


def printable(text: Column) -> Column:
    """Mostly printable, not blank."""
    kept = F.length(F.regexp_replace(text, r"(?U)[^\p{Print}\n\r\t]", ""))
    return (F.trim(text) != "") & (kept / F.length(text) >= 0.85)


def register_functions(spark) -> None:
    """Publish the main functions for SQL, as SQL functions over built-in expressions."""
    lists = {
        "word_set(t STRING) RETURNS ARRAY<STRING>": "array_distinct(filter(split(lower(t), '\\\\s+'), w -> w <> ''))",
        "word_overlap(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0D ELSE size(array_intersect(array_distinct(filter(split(lower(a), '\\\\s+'), w -> w <> '')), array_distinct(filter(split(lower(b), '\\\\s+'), w -> w <> '')))) / size(array_union(array_distinct(filter(split(lower(a), '\\\\s+'), w -> w <> '')), array_distinct(filter(split(lower(b), '\\\\s+'), w -> w <> '')))) END",
        "cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)))",
        "token_estimate(t STRING) RETURNS INT": "CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, (length(t) + 3) DIV 4) END",
    }
    for signature, body in lists.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
