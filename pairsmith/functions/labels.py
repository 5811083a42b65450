"""Judgement letters as numbers."""

from pyspark.sql import Column, functions as F

# Training gains and relevance levels per judgement letter, and
# the weight that the graded measure gives to each level.
GAIN = {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}
RELEVANCE = {"E": 4, "S": 2, "C": 3, "I": 1}
LEVEL_WEIGHT = {1: 0.0, 2: 0.01, 3: 0.1, 4: 1.0}


def looked_up(key: Column, table: dict) -> Column:
    """Value from a small table; a key that is not in it is an error."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    unknown = F.raise_error(F.concat(F.lit("no value for label "), F.coalesce(key.cast("string"), F.lit("NULL"))))
    return F.coalesce(found, unknown)


def gain(label: Column) -> Column:
    return looked_up(label, GAIN)


def relevance(label: Column) -> Column:
    return looked_up(label, RELEVANCE)


def is_relevant(gain_column: Column) -> Column:
    return (gain_column.cast("int") == 1).cast("int")
