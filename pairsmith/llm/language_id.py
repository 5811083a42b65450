"""Language identification by hyperdimensional profiles.

Every letter has a pseudo-random vector of +1 and -1. An n-gram is bound from
its letters, each permuted (rotated) by its place; a text bundles (adds) its
n-grams, a language prototype bundles its training texts, and a text gets the
language whose prototype has the largest cosine.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairsmith.llm import shared

DIMENSIONS = 1024
ORDER = 3
#: Expected number of training texts of each language; languages with fewer use all.
SAMPLE = 5_000
#: More languages than this are an error, as all prototypes are held by each task.
MAX_LANGUAGES = 1_000
#: Bound n-grams that a task keeps; others are bound anew each time.
KEPT_GRAMS = 16_384
#: Texts, and distinct n-grams of them, that are bundled at a time.
TEXTS, COLUMNS = 64, 4_096
UNKNOWN = "und"


class Space:
    """Letter and n-gram vectors; the same in every process."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER):
        self.dimensions, self.order = dimensions, order
        self.letters: dict[int, np.ndarray] = {}
        self.places: dict[int, int] = {}
        self.grams = np.empty((KEPT_GRAMS, dimensions), np.float32)
        self.alphabet = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, self.dimensions)
            if len(self.letters) > 65_536:
                self.letters.clear()
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def bound(self, gram: int) -> np.ndarray:
        """The product of the letters, the earlier ones rotated further."""
        out = np.ones(self.dimensions, np.float32)
        for place in range(self.order):
            out *= np.roll(self.letter(gram >> 21 * place & 0x1FFFFF), place)
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams over letters, with runs of anything else as one blank, and their counts."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        low = codes < 1 << 16
        letter = np.where(low, self.alphabet[np.where(low, codes, 0).astype(np.int64)], False)
        for at in np.flatnonzero(~low):
            letter[at] = chr(int(codes[at])).isalpha()
        if not letter.any():
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        keys = np.zeros(max(0, len(codes) - self.order + 1), np.uint64)
        for place in range(self.order):
            keys = keys << np.uint64(21) | codes[place : place + len(keys)]
        return np.unique(keys, return_counts=True)

    def rows(self, grams: list[int]) -> np.ndarray:
        """Their vectors, kept ones by place and others bound anew."""
        out = np.empty((len(grams), self.dimensions), np.float32)
        at, place = [], []
        for i, gram in enumerate(grams):
            known = self.places.get(gram)
            if known is None and len(self.places) < KEPT_GRAMS:
                known = self.places[gram] = len(self.places)
                self.grams[known] = self.bound(gram)
            if known is None:
                out[i] = self.bound(gram)
            else:
                at.append(i)
                place.append(known)
        out[at] = self.grams[place]
        return out

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """The vectors of texts, zero without a letter: counts of n-grams times their vectors, for all texts together."""
        total = np.zeros((len(texts), self.dimensions))
        found = [self.counts(t) if t else (np.empty(0, np.uint64), np.empty(0, np.int64)) for t in texts]
        grams, column = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        if not len(grams):
            return total
        row, count = np.repeat(np.arange(len(texts)), [len(k) for k, _ in found]), np.concatenate([c for _, c in found])
        for start in range(0, len(grams), COLUMNS):
            here = (column >= start) & (column < start + COLUMNS)
            counts = np.zeros((len(texts), min(COLUMNS, len(grams) - start)), np.float32)
            counts[row[here], column[here] - start] = count[here]
            total += counts @ self.rows(grams[start : start + COLUMNS].tolist())
        return total


def fit(docs: DataFrame, id_column: str, text_column: str, lang_column: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages in order, unit prototypes) from labelled rows.

    About ``sample`` rows of each language are taken by a hash of the id, all
    where a language has fewer; null labels and texts teach nothing. No
    labelled row gives no languages.
    """
    shared.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return [], np.empty((0, DIMENSIONS))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))[F.col("lang")]
    rows = rows.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30)) < share * (1 << 30))

    def bundles(batches):
        space, sums = Space(), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            grouped: dict[str, list[str]] = {}
            for lang, text in zip(langs, batch.column(0).to_pylist()):
                grouped.setdefault(lang, []).append(text)
            for lang, parts in grouped.items():
                sums[lang] = sums.get(lang, 0) + space.bundles(["\n".join(parts)])[0]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    parts = rows.select("text", "lang").mapInArrow(bundles, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("value"))
    languages = sorted(sizes, key=lambda x: x.encode())
    out = np.zeros((len(languages), DIMENSIONS))
    place = {lang: i for i, lang in enumerate(languages)}
    for row in sums.collect():  # languages x dimensions
        out[place[row["lang"]], row["pos"]] = row["value"]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    kept = length[:, 0] > 0
    return [x for x, k in zip(languages, kept) if k], out[kept] / length[kept]


def predictor(languages: list[str], prototypes: np.ndarray) -> Callable[[], Callable[[list], tuple[list[str], list[float]]]]:
    """A factory of functions from texts to (languages, scores)."""

    def make():
        space = Space()

        def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
            names, scores = [], []
            for start in range(0, len(texts), TEXTS):
                vectors = space.bundles(texts[start : start + TEXTS])
                length = np.linalg.norm(vectors, axis=1)
                known = (length > 0) & bool(languages)
                cosines = vectors @ prototypes.T / np.where(length > 0, length, 1)[:, None] if languages else np.zeros((len(vectors), 1))
                best = cosines.argmax(axis=1)
                names += [languages[i] if k else UNKNOWN for i, k in zip(best, known)]
                scores += np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0).tolist()
            return names, scores

        return predict

    return make


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (cosine, 0 to 1), which replace columns of these names.

    A null text, one without a letter, or a model without languages gives
    ``und`` and 0. Whole texts count; equal cosines give the first language in
    byte order; repeated rows get equal answers; an empty table stays empty.
    """
    shared.small_batches(docs.sparkSession)
    make = predictor(*model)

    def work():
        predict = make()

        def each(batch):
            return list(predict(batch.column(batch.schema.get_field_index(text_column)).to_pylist()))

        return each

    return shared.appended(docs, [("lang_pred", "string"), ("score", "double")], work)
