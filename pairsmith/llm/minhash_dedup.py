"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has ``CHUNKS`` times ``CHUNK`` symbols of 16 bits, the
lowest bits of its min-hashes. Two signatures that differ in at most
2 * CHUNKS - 1 places have, by the pigeonhole principle, a chunk with at most
one error; so each chunk is indexed once for every place that may be wrong, and
all pairs under that distance share a bucket. Pairs found make families; inside
a family every pair is confirmed on the full shingle sets.

A pair of similarity s differs in a place with probability 1 - s: with 48
places, one of 0.8 is beyond 23 errors with probability 4e-6, of 0.85 1e-8.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairsmith.llm import shared

WORDS = 5
SIMILARITY = 80
CHUNKS, CHUNK = 12, 4
PLACES = CHUNKS * CHUNK
MOST_ERRORS = 2 * CHUNKS - 1
#: Rows of a bucket, and of a family, that one task compares with as many others; larger ones are split into such tiles.
BUCKET_TILE, FAMILY_TILE = 2_048, 256
#: Groups of up to so many rows are compared together.
SMALL = 32
#: Shingles of a family that are counted at a time.
COLUMNS = 8_192

_random = np.random.Generator(np.random.Philox(key=48))
_TIMES = _random.integers(0, 1 << 64, PLACES, np.uint64) | np.uint64(1)
_PLUS = _random.integers(0, 1 << 64, PLACES, np.uint64)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Fingerprints of the distinct ``size``-word shingles, in order; a shorter text is one shingle, none without words."""
    own = shared.words(text)
    if not own:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    size = min(size, len(own))
    out = hashes[: len(hashes) - size + 1]
    for place in range(1, size):
        out = shared.joined_hash(out, hashes[place : place + len(out)])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The low 16 bits of the min-hashes of a set."""
    least = np.full(PLACES, ~np.uint64(0))
    for start in range(0, len(found), 2_048):
        part = found[start : start + 2_048]
        least = np.minimum(least, (_TIMES[:, None] * part + _PLUS[:, None]).min(axis=1))
    return (shared.mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each chunk and each place of it that is left out."""
    chunks = signatures.reshape(len(signatures), CHUNKS, CHUNK).astype(np.int64)
    out = np.empty((len(signatures), CHUNKS, CHUNK), np.int64)
    for left_out in range(CHUNK):
        rest = np.delete(chunks, left_out, axis=2)
        value = rest[:, :, 0] << 32 | rest[:, :, 1] << 16 | rest[:, :, 2]
        out[:, :, left_out] = (np.arange(CHUNKS) * CHUNK + left_out) << 48 | value
    return out.reshape(len(signatures), PLACES)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x, size) for x in shared.texts(batch, "text")]
        names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        signatures = [signature(s).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())], names=["id", "n_shingles", "name", "signature"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = index_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, PLACES))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), PLACES))], names=["key", "rep"])


def _tiled(rows: DataFrame, group: str, size: str, tile: int, sent: list[str]) -> DataFrame:
    """(group, tile, other, guest, …): every pair of rows of a group meets in one place; ``size`` counts the group's rows."""
    tiles = F.ceil(F.col(size) / F.lit(float(tile))).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), tiles).cast("int")
    placed = rows.withColumns({"own": own, "tiles": tiles})
    meetings = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("tile"), F.greatest(k, F.col("own")).alias("other"), (k < F.col("own")).alias("guest")))
    key = [group, "tile", "other"]
    return placed.select("*", F.inline(meetings)).select(*key, "guest", *sent).repartition(*key).sortWithinPartitions(*key)


def _groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the offsets of their groups."""
    for table in shared.sorted_groups(batches, [group, "tile", "other"]):
        table = table.combine_chunks()
        ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in (group, "tile", "other")])
        yield table, np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [table.num_rows]])


def _edges(reps: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of pairs of rows, as stars."""
    used, number = np.unique(np.concatenate([reps[one], reps[two]]), return_inverse=True)
    forest = shared.Forest(len(used))
    forest.union(number[: len(one)], number[len(one) :])
    root = used[forest.roots()]
    far = root != used
    return pa.RecordBatch.from_arrays([pa.array(used[far]), pa.array(root[far])], names=["a", "b"])


def _owned(differ: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which pairs belong to the index slot that they met in: the first that admits them, so that each is looked at once."""
    errors = differ.reshape(-1, CHUNKS, CHUNK).sum(axis=2)
    chunk, left_out = slot // CHUNK, slot % CHUNK
    own = errors[np.arange(len(errors)), chunk]
    return ((errors <= 1).argmax(axis=1) == chunk) & ((own == 1) | (left_out == 0)) & (errors.sum(axis=1) <= MOST_ERRORS)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the pairs of each bucket with at most ``MOST_ERRORS`` errors, one for each tile."""
    for table, cuts in _groups(batches, "key"):
        sizes = np.diff(cuts)
        reps, slots = table.column("rep").to_numpy(), table.column("key").to_numpy() >> 48
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, PLACES)
        guests = np.array(table.column("guest").to_pylist())
        tiles, others = table.column("tile").to_numpy(), table.column("other").to_numpy()
        whole = tiles[cuts[:-1]] == others[cuts[:-1]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(2, SMALL + 1):
            starts = cuts[:-1][(sizes == n) & whole]
            if len(starts):
                i, k = np.triu_indices(n, 1)
                one, two = (starts[:, None] + i).ravel(), (starts[:, None] + k).ravel()
                for at in range(0, len(one), 100_000):
                    a, b = one[at : at + 100_000], two[at : at + 100_000]
                    near = _owned(signatures[a] != signatures[b], slots[a])
                    found.append((a[near], b[near]))
        if found and sum(len(a) for a, _ in found):
            yield _edges(reps, *map(np.concatenate, zip(*found)))
        for g in np.flatnonzero((sizes > SMALL) | ((sizes > 1) & ~whole)):
            at = np.arange(cuts[g], cuts[g + 1])
            left, right = (at, at) if whole[g] else (at[~guests[at]], at[guests[at]])
            forest = shared.Forest(len(at))
            rows = max(1, 2_000_000 // (max(1, len(right)) * PLACES))
            for first in range(0, len(left) if len(right) else 0, rows):
                block = left[first : first + rows]
                differ = signatures[block][:, None, :] != signatures[right][None, :, :]
                i, k = np.nonzero(differ.sum(axis=2, dtype=np.uint8) <= MOST_ERRORS)
                near = _owned(differ[i, k], np.broadcast_to(slots[cuts[g]], len(i)))
                forest.union(block[i[near]] - cuts[g], right[k[near]] - cuts[g])
            far = np.flatnonzero(forest.roots() != np.arange(len(at)))
            if len(far):
                yield _edges(reps[at], far, forest.up[far])


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, similarity: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the linked pairs of each family."""
    for table, cuts in _groups(batches, "family"):
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = table.slice(start, end - start)
            guests = np.array(part.column("guest").to_pylist())
            whole = part.column("tile")[0].as_py() == part.column("other")[0].as_py()
            if end - start < 2 or not whole and guests.all() | ~guests.any():
                continue
            reps = part.column("rep").to_numpy()
            sets = [shingles(x, size) for x in part.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(s) for s in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
            common = np.bincount(column)[column] > 1
            owner, column = owner[common], column[common]
            column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
            both = np.zeros((len(sets), len(sets)), np.int64)
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                at = slice(*np.searchsorted(column, [low, low + COLUMNS]))
                table_part = np.zeros((len(sets), COLUMNS), np.float32)
                table_part[owner[at], column[at] - low] = 1
                both += (table_part @ table_part.T).astype(np.int64)
            linked = 100 * both >= similarity * (n[:, None] + n[None, :] - both)
            i, k = np.nonzero(np.triu(linked, 1))
            if not whole:
                i, k = i[guests[i] != guests[k]], k[guests[i] != guests[k]]
            if len(i):
                yield _edges(reps, i, k)


def link(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of documents whose sets have 100 * common >= similarity * united.

    Ids are whole numbers and unique but for repeated rows, which are copies of
    each other. A text that is null or has no words has an empty set and links
    with nothing; a row with a null id links with nothing either and has a null
    component_id and is kept. Documents with equal sets are one class, in the
    name of the smallest id; only classes are compared, in tiles of bounded size,
    and no task sends more than a spanning forest of what it finds.
    """
    shared.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = shared.written(rows.mapInArrow(lambda b: _signed(b, size), "id long, n_shingles long, name binary, signature binary"), "signatures")
    classes = shared.written(signed.where("name is not null and id is not null").groupBy("name").agg(F.min("id").alias("rep"), F.first("signature").alias("signature")), "classes")

    keys = classes.select("rep", "signature").mapInArrow(_indexed, "key long, rep long")
    crowded = keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    crowded = crowded.join(classes.select("rep", "signature"), "rep")
    near = _tiled(crowded, "key", "n", BUCKET_TILE, ["rep", "signature"]).mapInArrow(_near, "a long, b long")
    families = shared.components(near).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    families = shared.written(families, "families")
    families = families.join(families.groupBy("family").agg(F.count("*").alias("n")), "family")
    # A merge join at any size, so that a small run shows what a large one does.
    members = rows.join(families.hint("merge"), F.col("id") == F.col("rep")).select("family", "n", "rep", "text")
    links = _tiled(members, "family", "n", FAMILY_TILE, ["rep", "text"]).mapInArrow(lambda b: _confirmed(b, size, similarity), "a long, b long")
    groups = shared.components(links).withColumnRenamed("node", "rep")

    found = classes.select(F.col("name").alias("class"), "rep").join(groups, "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    joined = signed.join(found, (F.col("name") == F.col("class")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group; of repeated rows with one id, one. Rows with a null id stay."""
    decided = shared.written(link(docs, id_column, text_column, size, similarity), "kept").where("kept").groupBy(F.col(id_column).alias("kept_id")).agg(F.count("*").alias("n_rows"))
    # A merge join at any size here too: the list of kept ids grows with the documents.
    joined = docs.join(decided.hint("merge"), docs[id_column].eqNullSafe(F.col("kept_id")))
    if decided.where("n_rows > 1 and kept_id is not null").isEmpty():
        return joined.select(*(docs[c] for c in docs.columns))
    single = F.row_number().over(Window.partitionBy(docs[id_column], F.when(docs[id_column].isNull(), F.monotonically_increasing_id())).orderBy(docs[text_column]))
    return joined.select(*(docs[c] for c in docs.columns), single.alias("__row")).where("__row = 1").drop("__row")
