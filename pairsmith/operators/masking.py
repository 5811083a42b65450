"""Entity masking with sentinels, and the label that recovers the entities."""

from pyspark.sql import Column, functions as F

# Fixed value: 100 sentinels, of which the last can only close a label.
SENTINELS = 100


def sentinel(number) -> Column:
    return F.concat(F.lit("<extra_id_"), number.cast("string"), F.lit(">"))


def mapped_entities(entities: Column) -> Column:
    """Distinct entities by first appearance, as many as there are sentinels for."""
    return F.slice(F.array_distinct(entities), 1, SENTINELS - 1)


def sentinel_map(entities: Column) -> Column:
    """entity → sentinel."""
    mapped = mapped_entities(entities)
    return F.map_from_arrays(mapped, F.transform(mapped, lambda _, i: sentinel(i)))


def mask(tokens: Column, mapping: Column, may_be_entity=None) -> Column:
    """Tokens with every mapped entity replaced; ``may_be_entity`` spares the lookup for other tokens."""

    def replaced(t):
        found = F.coalesce(F.try_element_at(mapping, t), t)
        return found if may_be_entity is None else F.when(may_be_entity(t), found).otherwise(t)

    return F.array_join(F.transform(tokens, replaced), " ")


def recovery_label(entities: Column) -> Column:
    """``s0 e0 s1 e1 … sn``: each sentinel with its entity, and a closing sentinel."""
    mapped = mapped_entities(entities)
    listed = F.flatten(F.transform(mapped, lambda e, i: F.array(sentinel(i), e)))
    return F.array_join(F.concat(listed, F.array(sentinel(F.size(mapped)))), " ")
