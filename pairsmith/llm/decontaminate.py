"""Benchmark decontamination by Wu-Manber search for all item windows at once.

Texts become lower-case words between single blanks, so a window of words is a
byte string that starts and ends with a blank. A shift table over blocks of
bytes says how far the search may skip; a block that ends some pattern leads to
a bucket, and direct comparison confirms.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pairsmith.llm import shared

WINDOW = 10
#: Bytes of item text whose patterns one pass holds; more items take more passes over the same rows.
PASS_BYTES = 2 << 20
#: Patterns from this length on are searched apart, so that short items do not shorten their skips.
LONG = 32
BLOCK = 8

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits and of anything beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


class Patterns:
    """Wu-Manber tables of patterns with at least ``BLOCK`` or their own length in bytes."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        self.least = min(map(len, patterns))
        self.block = min(BLOCK, self.least)
        self.far = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[bytes]]] = {}
        for pattern in patterns:
            head = pattern[: self.least]
            for end in range(self.block, self.least + 1):
                block = head[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.least - end)
            self.buckets.setdefault(head[-self.block :], {}).setdefault(head, []).append(pattern)

    def search(self, text: bytes):
        """(start, pattern) of all occurrences, overlapping ones too."""
        at, block, far, least, shift = self.least, self.block, self.far, self.least, self.shift
        while at <= len(text):
            skip = shift.get(text[at - block : at], far)
            if skip:
                at += skip
                continue
            start = at - least
            for pattern in self.buckets[text[at - block : at]].get(text[start:at], ()):
                if text.startswith(pattern, start):
                    yield start, pattern
            at += 1


class Matcher:
    """All windows of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.owners: dict[bytes, set[str]] = {}
        for item, text in items:
            own = words(text)
            for start in range(max(1, len(own) - window + 1) if own else 0):
                self.owners.setdefault(b" " + b" ".join(own[start : start + window]) + b" ", set()).add(item)
        parts = ({p: o for p, o in self.owners.items() if (len(p) >= LONG) is side} for side in (True, False))
        self.tables = [Patterns(p) for p in parts if p]

    def hits(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [from, to) that occurrences cover, and the items."""
        text = b" " + b" ".join(own) + b" " if own else b""
        found = [x for table in self.tables for x in table.search(text)]
        if not found:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        starts = np.searchsorted(blanks, [x for x, _ in found]).tolist()
        items = set().union(*(self.owners[p] for _, p in found))
        return [(s, s + p.count(b" ") - 1) for s, (_, p) in zip(starts, found)], items


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as disjoint ones in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans, hit_items and contaminated, which replace columns of these names.

    hit_spans are word ranges [from, to) in ``docs`` words; hit_items the ids,
    as strings in order, of items with an occurring window. A null or wordless
    text has no words; a null or wordless item, or one with a null id, has no
    window. Repeated items count once, repeated documents each. The benchmark
    is searched in passes of bounded size, all in one scan of the documents.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // PASS_BYTES))
    out = docs
    fields = [("n_words", "long"), ("n_hit", "long"), ("hit_spans", "array<int>"), ("hit_items", "array<string>")]
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()  # about PASS_BYTES
        known = spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in part])

        def make(known=known, again=k > 0):
            matcher = Matcher(known.value, window)

            def work(batch):
                n_words, n_hit, all_spans, all_items = [], [], [], []
                before = ([batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__earlier_spans", "__earlier_items")]) if again else None
                for i, text in enumerate(shared.texts(batch, text_column)):
                    own = words(text)
                    spans, found = matcher.hits(own)
                    if again:
                        flat = before[0][i]
                        spans, found = spans + list(zip(flat[::2], flat[1::2])), found | set(before[1][i])
                    spans = covered(spans)
                    n_words.append(len(own))
                    n_hit.append(sum(b - a for a, b in spans))
                    all_spans.append([x for span in spans for x in span])
                    all_items.append(sorted(found, key=str.encode))
                return [n_words, n_hit, all_spans, all_items]

            return work

        if k:
            out = out.withColumnsRenamed({"hit_spans": "__earlier_spans", "hit_items": "__earlier_items"})
        out = shared.appended(out, fields, make)
        if k:
            out = out.drop("__earlier_spans", "__earlier_items")
    return out.withColumn("contaminated", F.col("n_hit") > 0)
