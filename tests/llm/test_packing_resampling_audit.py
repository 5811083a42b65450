"""Operators 11 to 13 against brute force, and their edge cases."""

import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from pairsmith.llm import filter_audit, packing, queries, resampling

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, source string, rank string, score string, piece string"
ROWS = [(None, "null id", None), (1, None, "a"), (2, "", "a"), (3, "word " * 60_000, "b"), (4, "word " * 60_000, "b"), (5, "ab", "b"), (5, "ab", "b"), (6, "\x0b \t", None), (None, "null id", "c")]


@pytest.fixture
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and columns with clashing names."""
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in ROWS], DOC)


@pytest.fixture
def folder(spark):
    return lambda: f"{spark.conf.get('spark.sql.warehouse.dir')}/table-{random.random()}"


@functools.cache
def tokenizer():
    loaded = Tokenizer.from_file(PATH)
    loaded.encode_special_tokens = True
    return loaded


def tokens(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_of_parts_are_the_parts_of_the_ids():
    rng = random.Random(1)
    texts = ["", " ", "\n", "a  b", " a", "a\n\nb c\n d", "it's  \n x's 'll", "a \n", "x" * 300 + " y", "<|endoftext|> a", "日本 語　x y", "1 2 \x1c z", "a\r\nb", "\0a b\0 c", "a.\nb, c."]
    texts += ["".join(rng.choice("ab 1'.\n\t ésl,") for _ in range(40)) for _ in range(3_000)]
    encoder = packing.Encoder(PATH)
    for _ in range(2):  # learnt, then remembered
        for text, ids in zip(texts, encoder.ids(texts)):
            assert [*np.frombuffer(ids, "<u4").tolist(), 0] == tokens(text), text


def fewest(lengths, capacity):
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(r for r in rooms if r >= lengths[i]):
            put(i + 1, sorted([*(r for r in rooms if r != room), *[room] * (rooms.count(room) - 1), room - lengths[i]]))
        put(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_completion_finds_the_fewest_sequences():
    rng, better = random.Random(3), 0
    for k in range(300):
        capacity = rng.choice([10, 20, 37])
        lengths = [rng.randint(1, capacity) if k % 2 else rng.randint(capacity // 5, capacity // 2 + 2) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        packing_, bound = packing.complete(counts, nodes=100_000)
        found, held = sum(n for _, n in packing_), Counter()
        for filling, times in packing_:
            assert sum(filling) <= capacity
            held.update({length: times * k for length, k in Counter(filling).items()})
        assert held == Counter(lengths) and bound <= found == fewest(lengths, capacity)
        better += found < sum(n for _, n in packing.best_fit(counts))
    assert better > 0


def test_many_short_pieces_and_one_length():
    for counts in ({1: 10_000_000, 2047: 3}, {700: 999}, {2048: 5}, {}):
        column = np.zeros(2049, np.int64)
        column[list(counts)] = list(counts.values())
        found, bound = packing.complete(column)
        assert sum(n for _, n in found) >= bound and sum(len(f) * n for f, n in found) == sum(counts.values())
    assert sum(n for _, n in packing.complete(np.bincount([700] * 999, minlength=2049))[0]) == 500


def test_fillings_are_not_dominated():
    counts = [0] * 21
    for length in (3, 5, 7, 8):
        counts[length] = 2
    found = packing.fillings(13, counts, [3, 5, 7, 8], 13)
    assert (8, 5) in found and (7, 5) not in found and (5, 5, 3) in found and all(sum(f) <= 13 for f in found)


def test_packed_sequences_hold_the_texts(spark, odd):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").where("doc_id between 10 and 70")
    frame = documents.union(odd.select("doc_id", "text", "source"))
    packed = packing.pack(frame, PATH, capacity=512)
    rows = packed.collect()
    wanted = sorted((str(r["doc_id"]), tuple(tokens(r["text"]))) for r in frame.collect())
    whole = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 512 and r["ids_crc32"] == zlib.crc32(r["ids"])
    long = [r for r in rows if r["doc_id"] == 3]
    assert sorted(r["start"] for r in long) == [s for s, _ in packing.cuts(60_002, 512)] and all(r["length"] == 512 for r in long if r["piece"])
    for sequence, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        whole[sequence] = at
    assert max(whole.values()) <= 512
    single = sorted((str(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows if r["start"] == 0 and r["length"] < 512)
    assert set(single) >= {w for w in wanted if len(w[1]) < 512}
    counts = np.bincount([r["length"] for r in rows], minlength=513)
    assert packing.least_sequences(counts) <= len(whole) <= packing.least_sequences(counts) + 1
    joined = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert {s: r["n_tokens"] for s, r in joined.items()} == whole and all(len(r["ids"]) == 4 * r["n_tokens"] for r in joined.values())


def test_the_registered_packing(spark):
    found = queries.op11(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, rows in by_doc.items():
        ids = tokens(texts[doc_id])
        for r in sorted(rows, key=lambda r: r["piece"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]
        assert [(r["start"], r["length"]) for r in sorted(rows, key=lambda r: r["piece"])] == packing.cuts(len(ids))
    assert len({r["sequence_id"] for r in found}) <= packing.least_sequences(np.bincount([r["length"] for r in found], minlength=2049)) + 1


# Resampling


def test_the_table_tells_equal_hashes_apart(monkeypatch):
    monkeypatch.setattr(resampling.xxhash, "xxh64_digest", lambda g: bytes(7) + bytes([len(g) % 2]))
    table, said = resampling.Table(room=8), []
    for k in range(6):
        grams = [b"%d" % (i % (7 + 11 * k)) for i in range(60)]
        slots = table.intern(grams)
        said += grams
        assert [table.grams[s] for s in slots] == grams
    assert {g: c for g, c, u in zip(table.grams, table.count, table.used) if u} == Counter(said) and table.n == len(set(said))


def slow_features(text):
    low = (text or "").encode().translate(resampling.LOWERED).split()
    return low + [a + b" " + b for a, b in zip(low, low[1:])]


def test_long_texts_come_in_parts_without_losing_runs(monkeypatch):
    monkeypatch.setattr(resampling, "RUN_BYTES", 50)
    rng = random.Random(2)
    texts = ["-".join(rng.choice(["Ab", "c", "é1", "longer"]) for _ in range(n)).encode() for n in (0, 1, 2, 200, 3, 1)] + [None, b"!!", b"x" * 500]
    found = [Counter() for _ in texts]
    for grams, rows, sizes in resampling.runs(texts):
        ends = np.cumsum(sizes)
        assert ends[-1] == len(grams)
        for row, end, size in zip(rows, ends, sizes):
            found[row].update(grams[end - size : end])
    assert found == [Counter(slow_features(t.decode() if t else t)) for t in texts]


def test_resampling_equals_brute_force(spark, odd):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("alpha Beta gamma delta".split()) for _ in range(rng.choice([0, 5, 19, 20, 40])))) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(40)] + [r[:2] for r in ROWS]
    target = [(i, "alpha beta alpha") for i in range(9)] + [(9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("score", "rank", "source", "__step")})
    found = resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string"), percent=30)
    assert sorted(found.columns) == sorted([*docs.columns, "n_features", "weight"])
    s, t = Counter(), Counter()
    for side, texts in ((s, rows), (t, target)):
        for _, text in texts:
            side.update(zlib.crc32(g) % 10_000 for g in slow_features(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    wanted = []
    for id_, text in rows:
        grams = slow_features(text)
        weight = sum(gain(zlib.crc32(g) % 10_000) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        wanted.append((id_, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long_enough = sorted((w for w in wanted if w[1] >= 39), key=lambda w: (-w[3], w[0] is None, w[0]))
    drawn = {w: i + 1 for i, w in enumerate(long_enough[: 30 * len(long_enough) // 100])}
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found.collect()]
    assert Counter(got) == Counter(wanted)
    assert {(r["doc_id"], r["n_features"], r["weight"], r["score"]): r["rank"] for r in found.where("rank is not null").collect()} == drawn and len(drawn) > 20


def test_odd_and_empty_tables_resampled(spark, odd):
    empty = odd.limit(0)
    assert resampling.resample(odd, empty).count() == len(ROWS) and resampling.resample(empty, odd).count() == 0
    assert resampling.resample(odd, odd, percent=100).where("rank is not null").count() == 2


# Audit


def slow_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    least = {}
    for id_, text, _ in rows:
        if id_ is not None:
            least[text or ""] = min(least.get(text or "", id_), id_)
    failed = []
    for id_, text, part in rows:
        t = text or ""
        w = t.encode().split()
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), id_ is not None and least[t] < id_]
        failed.append((part or "", {f for f, x in zip("ABCDE", fails) if x}, id_ in good, id_ in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        own, shapley = [f[1:] for f in failed if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[0]]
                left = [f for f in left if x not in f[0]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in f[0] for f in own) - len(gone), sum(f[0] == {x} for f in own), sum(f[1] for f in gone), sum(f[2] for f in gone)]
        for (p, order, k), values in out.items():
            if p == part:
                values.append(shapley[order[k - 1]])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("files", [1, 9])
def test_the_audit_equals_brute_force_in_any_order_of_arrival(spark, folder, files):
    rng = random.Random(files)
    vocab = [f"w{i}" for i in range(90)] + ["ABC", "X&Y"]
    texts = [" ".join(rng.choice(vocab[: rng.choice([20, 60, 92])]) for _ in range(rng.choice([5, 49, 50, 60]))) for _ in range(25)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(300)] + ROWS
    rows += [(500, texts[0], "a"), (500, texts[0], "b"), (500, "only here", "a"), (500, "only here", "b"), (501, "only here", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    rng.shuffle(rows)
    path = folder()
    for k in range(files):  # a file each, so that smaller ids arrive later
        spark.createDataFrame(rows[k::files], "doc_id long, text string, source string").withColumn("mask", F.lit("mine")).coalesce(1).write.mode("append").parquet(path)
    found = filter_audit.audit(spark, path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), batches=9)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in found.collect()} == slow_audit(rows, labels)


def test_changes_take_back_what_a_smaller_id_makes_wrong():
    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

    import pandas as pd

    state, key = State(), (3,)
    frame = lambda *rows: [pd.DataFrame([(b"text", *r) for r in rows] + [(b"other", 1, "c", 0, False, False, 1)], columns=["digest", "id", "part", "mask", "good", "toxic", "n"])]
    call = lambda frames: sorted(r for r in map(tuple, pd.concat(filter_audit._retracted(key, iter(frames), state)).to_numpy().tolist()) if r[0] != "c")
    assert call(frame((9, "a", 1, False, True, 2))) == [("a", 1, False, True, 2)]
    assert call(frame((12, "b", 1, False, False, 1))) == [("b", 17, False, False, 1)]
    assert call(frame((4, "b", 1, True, False, 1))) == [("a", 1, False, True, -2), ("a", 17, False, True, 2), ("b", 1, True, False, 1)]


def test_an_empty_table_has_no_parts(spark, folder, odd):
    path = folder()
    odd.limit(0).write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, path, labels).count() == 0
