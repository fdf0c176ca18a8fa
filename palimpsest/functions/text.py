"""Text as Column expressions: similarity, names, predicates, tokens, percent signs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import lexicon as L


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def words(text: Column) -> Column:
    """Tokens between blanks, tabs, line and page ends (not \\v, which Java's \\s has besides), none of them empty; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\t\n\f\r ]+"), lambda w: w != "")


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether a text holds one of the phrases anywhere, even inside a word."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def first_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """The first phrase of the list, not of the text, that the text holds."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def has_token(text: Column, tokens: Iterable[str]) -> Column:
    """Whether a whole token is one of the given."""
    return F.arrays_overlap(words(text), literal_array(tokens))


def any_pattern(text: Column, patterns: Iterable[str]) -> Column:
    """One case-insensitive alternation instead of a pass for each pattern."""
    return F.rlike(text, F.lit("(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"))


def bigrams(text: Column) -> Column:
    """The set of two-letter pieces; a shorter text is its own piece."""
    return F.when(F.length(text) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2))))).otherwise(F.array(text))


def dice(a: Column, b: Column) -> Column:
    """Overlap of letter pairs: 1 for equal names, 0 if one is empty; case and outer blanks don't count."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    x, y = bigrams(a), bigrams(b)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def without_possessive(name: Column) -> Column:
    name = F.trim(name)
    return F.when(name.endswith("'s") | name.endswith("’s"), F.trim(F.substr(name, F.lit(1), F.length(name) - 2))).otherwise(name)


def bare_name(name: Column) -> Column:
    """A name without possessive and without a remark in parentheses at its end."""
    return F.trim(F.regexp_replace(without_possessive(name), r"\s*\([^)]*\)\s*$", ""))


def capitalised(name: Column) -> Column:
    return F.initcap(F.array_join(words(without_possessive(name)), " "))


_NUMBERS = r"^[\d\s.,:/-]+$"
_AGO = r"(?i)^\d+\s+(?:days?|weeks?|months?|years?|hours?|minutes?)\s+ago$"


def is_junk_name(name: Column) -> Column:
    """Names that must not become entities."""
    bare = bare_name(name)
    parts = words(bare)
    return F.lower(bare).isin(*L.JUNK_NAMES) | (F.length(bare) < 2) | F.rlike(bare, F.lit(_NUMBERS)) | F.rlike(bare, F.lit(_AGO)) | ((F.size(parts) >= 2) & F.lower(F.get(parts, F.lit(0))).isin(*L.JUNK_STARTERS))


def is_valid_name(name: Column) -> Column:
    """The stricter test for names that extraction finds."""
    bare = bare_name(name)
    parts = words(bare)
    low = F.lower(bare)
    first, second = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1)))
    several = F.size(parts) >= 2
    article = reduce(lambda a, b: a | b, [low.startswith(p) for p in ("the ", "a ", "an ", "my ", "our ", "your ")])
    bad = (
        (F.length(bare) < 2)
        | low.isin(*L.invalid_names())
        | F.rlike(bare, F.lit(_NUMBERS))
        | F.contains(bare, F.lit("'s "))
        | F.contains(bare, F.lit("’s "))
        | (F.size(parts) > 3)
        | article
        | (several & first.isin(*L.SENTENCE_STARTERS))
        | (several & F.coalesce(second.isin(*L.FRAGMENT_VERBS), F.lit(False)))
    )
    return ~bad


def fuzzy_predicate(word: Column) -> Column:
    """The predicate at an edit distance of one at most, the nearest, then the alphabetically first."""
    names = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(L.RELATION_ALIASES.get(p, p)).alias("to")) for p in sorted({*L.VALID_PREDICATES, *L.RELATION_ALIASES})])
    near = F.filter(names, lambda n: (F.abs(F.length(n["p"]) - F.length(word)) <= 1) & (F.levenshtein(word, n["p"]) <= 1))
    best = F.array_min(F.transform(near, lambda n: F.struct(F.levenshtein(word, n["p"]).alias("d"), n["p"].alias("p"), n["to"].alias("to"))))
    return F.when(F.length(word) >= 4, best["to"])


def predicate(word: Column) -> Column:
    """Canonical spelling of a predicate: aliases, then one typing error, else as it is."""
    plain = F.replace(F.replace(F.lower(F.trim(word)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    known = F.coalesce(F.element_at(literal_map(L.RELATION_ALIASES), plain), plain)
    return F.when(known.isin(*L.VALID_PREDICATES), known).otherwise(F.coalesce(fuzzy_predicate(plain), known))


def chained_predicate(first: Column, second: Column) -> Column:
    """What a relation's relation is: a spouse's parents and siblings, a child's spouse, a parent's spouse."""
    spouse = first.isin("wife", "husband", "partner") & second.isin("father", "mother", "brother", "sister")
    child = first.isin("son", "daughter") & second.isin("wife", "husband")
    parent = first.isin("father", "mother") & second.isin("wife", "husband")
    return F.when(spouse, F.concat(second, F.lit("_in_law"))).when(child, F.concat(first, F.lit("_in_law"))).when(parent, first).otherwise(predicate(second))


def type_of_predicate(name: Column) -> Column:
    return F.when(name.isin(*L.COMPANY_PREDICATES), "company").when(name.isin(*L.PLACE_PREDICATES), "place").when(name.isin(*L.ANIMAL_PREDICATES), "animal").when(name.isin(*L.CONCEPT_PREDICATES), "concept").otherwise("person")


def tokens_estimate(text: Column) -> Column:
    """Tokens that a text will cost: four for three words, one at least."""
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * 4 / 3).cast("int"))


def percent_sign(hundredths: Column) -> Column:
    """A number of hundredths as a whole one with its sign, halves to the even one."""
    return F.concat(F.bround(hundredths, 0).cast("long").cast("string"), F.lit("%"))


def percent(x: Column) -> Column:
    return percent_sign(x * 100)


_EDGES = r"^[.,!?;:'\"()\[\]{}]+|[.,!?;:'\"()\[\]{}]+$"


def significant_words(text: Column) -> Column:
    """Lower-cased tokens of three letters or more, stripped of marks, that are no stop words."""
    long = F.filter(words(F.lower(text)), lambda w: F.length(w) > 2)
    bare = F.transform(long, lambda w: F.regexp_replace(w, _EDGES, ""))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(*L.STOPWORDS))


def proper_nouns(text: Column, marks: str = ".,!?'\"") -> Column:
    """Capitalised tokens of three letters or more, stripped of marks at their very ends."""
    bare = F.transform(words(text), lambda w: F.regexp_replace(w, rf"^[{marks}]+|[{marks}]+\z", ""))
    return F.filter(bare, lambda w: (F.length(w) > 2) & F.rlike(w, F.lit(r"^[A-Z]")))


def is_covered(text: Column, summary: Column) -> Column:
    """Whether a summary names half of a text's proper nouns or more."""
    names = proper_nouns(text)
    found = F.filter(names, lambda w: F.contains(F.lower(summary), F.lower(w)))
    return (F.size(names) > 0) & (F.size(found) * 2 >= F.size(names)) & (F.coalesce(summary, F.lit("")) != "")


def is_boilerplate(text: Column) -> Column:
    return text.startswith("User said:") | text.startswith("User asked:")


def spans(text: Column) -> Column:
    """Runs of capitalised words, and what stands in double quotes."""
    return F.concat(F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"), F.lit(1)), F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)))


def question_tokens(text: Column) -> Column:
    """Tokens of a question: words, with possessives of their own, and question marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"('s|\w+|\?)"), F.lit(1))
