"""Entities of code and product texts."""

from pyspark.sql import Column, functions as F

from pairsmith.functions import text
from pairsmith.functions.keyed import keyed_hash, let
from pairsmith.functions.languages import LANGUAGES

PROPER_NOUN = r"^\p{Lu}\p{L}*$"
# Share of the identifier occurrences that are drawn.
SAMPLED_SHARE = 0.5
SAMPLED_SHARE_JAVASCRIPT = 0.1


def identifiers(code: Column, language: Column) -> Column:
    """Names in order, with repeats, outside comments, strings and numbers, without reserved words; another language is an error."""
    known = F.coalesce(F.when(language.isin(*LANGUAGES), language), F.raise_error(F.concat(F.lit("no rules for language "), F.coalesce(language, F.lit("NULL")))))
    found = F.lit(None).cast("array<string>")
    for name, rules in LANGUAGES.items():
        source = F.regexp_replace(code, rules.skipped, " ")
        names = F.regexp_extract_all(source, F.lit(rules.name), F.lit(0))
        reserved = F.array(*[F.lit(w) for w in rules.reserved])
        found = F.when(known == name, F.filter(names, lambda t: ~F.array_contains(reserved, t))).otherwise(found)
    return found


def _drawn(names: Column, key: Column, seed: int) -> Column:
    """The occurrences in keyed random order."""
    marked = F.transform(names, lambda n, i: F.struct(keyed_hash(seed, key, i).alias("h"), i.alias("i"), n.alias("n")))
    return F.transform(F.array_sort(marked), lambda d: d["n"])


def _all_of(names: Column, values: Column) -> Column:
    return let(values, lambda known: F.filter(names, lambda n: F.array_contains(known, n)))


def sample_identifiers(names: Column, key: Column, share: Column, seed: int) -> Column:
    """All occurrences of the values hit by max(share × (n−1), 1) draws of an occurrence."""
    n_draws = F.greatest(F.floor(share * (F.size(names) - 1)).cast("int"), F.lit(1))
    return _all_of(names, F.array_distinct(F.slice(_drawn(names, key, seed), 1, n_draws)))


def select_half(names: Column, key: Column, seed: int) -> Column:
    """All occurrences of values drawn until they make up half of the list."""
    start = F.struct(F.lit(0).alias("n"), F.floor(F.size(names) / 2).cast("int").alias("left"))

    def step(state, count):
        more = F.struct((state["n"] + 1).alias("n"), (state["left"] - count).alias("left"))
        return F.when(state["left"] > 0, more).otherwise(state)

    def first_half(drawn: Column) -> Column:
        counts = F.transform(drawn, lambda v: F.size(F.filter(names, lambda n: n == v)))
        return F.slice(drawn, F.lit(1), F.aggregate(counts, start, step, lambda state: state["n"]))

    return _all_of(names, let(F.array_distinct(_drawn(names, key, seed)), first_half))


def chosen_identifiers(names: Column, language: Column, key: Column, seed: int) -> Column:
    """The names to mask: all for Python, about half for PHP, a sample for the others."""
    share = F.when(language == "javascript", SAMPLED_SHARE_JAVASCRIPT).otherwise(SAMPLED_SHARE)
    return (
        F.when(language == "python", names)
        .when(language == "php", select_half(names, key, seed))
        .otherwise(sample_identifiers(names, key, share, seed))
    )


def proper_nouns(tokens: Column) -> Column:
    """Capitalised words, in order."""
    return F.filter(tokens, lambda t: t.rlike(PROPER_NOUN))


def title_entities(title: Column) -> Column:
    return F.array_distinct(F.transform(proper_nouns(text.word_tokens(title)), F.lower))


def description_entities(tokens: Column, title_set: Column) -> Column:
    """Capitalised words and words of the title's entities, in order, with repeats."""
    return F.filter(tokens, lambda t: t.rlike(PROPER_NOUN) | F.array_contains(title_set, F.lower(t)))
