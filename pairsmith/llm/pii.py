"""Surrogates for personal data.

Detected entities get keyed replacements of their own kind and format: letters
for letters of the same case and script, digits for digits, card numbers with
a valid check digit, addresses with valid parts, names of the person's gender.
Equal entities get equal surrogates everywhere, whatever their case or their
separators; a name whose documents do not tell the gender takes that of other
documents. A distributed check over the distinct entities of the corpus draws
anew where two entities would share a surrogate or one would equal another real
entity; later draws leave formats that have few values, so that no number of
entities exhausts them.
"""

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pairsmith.llm import shared

#: Draws for one entity before the job gives up.
MOST_DRAWS = 200
#: Draws after which a surrogate may leave a format of few values, such as a small range of addresses.
WIDER = 4

# Titles by gender, and given and family names by script.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа"), "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин"), "n": ("Dr", "Prof", "Dra")}
GIVEN = {
    ("LATIN", "f"): ("Alice", "Anna", "Clara", "Diana", "Elena", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Laura", "Lena", "Lucia", "Maria", "Marta", "Nina", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Silvia", "Sofia", "Vera"),
    ("LATIN", "m"): ("Adam", "Albert", "Anton", "Bruno", "Daniel", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Julian", "Karl", "Leo", "Lucas", "Martin", "Max", "Nico", "Oscar", "Pablo", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    ("CYRILLIC", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София", "Татьяна"),
    ("CYRILLIC", "m"): ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Николай", "Олег", "Павел", "Сергей"),
}
_ONSETS, _CODAS = ("B", "Br", "C", "D", "F", "G", "H", "K", "L", "M", "N", "P", "R", "S", "T", "V", "W"), ("ander", "arin", "elman", "enberg", "eston", "iller", "indt", "olano", "onte", "urner")

_LISTED = {name.lower(): g for (_, g), names in GIVEN.items() for name in names}
_TITLE_GENDER = {t: g for g, all_ in TITLES.items() for t in all_}
_NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
#: By gate: (a test that is cheap and that every text with such an entity passes, the patterns).
_GATES = [
    (lambda t: "@" in t, [r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"]),
    (lambda t: "AKIA" in t or "ASIA" in t, [r"(?P<awskey>(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9]))"]),
    (lambda t: _SECRET_WORD.search(t) is not None, [r"(?P<secret>\b(?i:token|password|passwd|pwd|secret|api[_-]?key)\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9_\-+/.]{8,}))"]),
    (
        lambda t: _DIGIT.search(t) is not None,
        [
            r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
            r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))",
            r"(?P<card>(?<![\w-])[2-6]\d{3}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?![\w-]))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<phone>(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w|-\d)|(?<![\w+(])\+\d{8,15}(?!\w))",
        ],
    ),
    (lambda t: any(x in t for x in _TITLE_GENDER), [r"(?P<person>(?<!\w)(?P<title>" + "|".join(sorted(_TITLE_GENDER, key=len, reverse=True)) + r")\.?[ \t]+(?P<name>" + _NAME + r"(?:[ \t]+" + _NAME + r"){0,2}))"]),
]
_SECRET_WORD = re.compile(r"(?i)[=:]\s*[\"']?[A-Za-z0-9_\-+/.]{8}")
_DIGIT = re.compile(r"\d")
_KINDS = ("email", "awskey", "secret", "iban", "ip", "card", "ssn", "phone", "person")


@functools.lru_cache(maxsize=None)
def _pattern(gates: tuple[int, ...]) -> re.Pattern:
    return re.compile("|".join(p for g in gates for p in _GATES[g][1]))


def _letters(text: str) -> str:
    """The script of the first letter, such as LATIN."""
    for c in text:
        if c.isalpha():
            return unicodedata.name(c, "OTHER").split(" ", 1)[0]
    return "OTHER"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) in order and apart. The entity is what two spellings share; a name is one entity a word."""
    out: list[tuple[int, int, str, str]] = []
    gates = tuple(g for g, (passes, _) in enumerate(_GATES) if passes(text))
    if not gates:
        return out
    people: list[tuple[int, int, str, str]] = []  # start, end, family or the title's gender, word
    numbers: dict[str, str] = {}
    for m in _pattern(gates).finditer(text):
        kind, span = next(k for k, x in m.groupdict().items() if x is not None and k in _KINDS), m.span()
        if kind == "email":
            out.append((*span, kind, m.group().lower()))
        elif kind == "secret":
            value = m.group("value")
            if any(c.isdigit() for c in value):
                out.append((*m.span("value"), kind, value))
        elif kind == "person":
            own = [w for w in re.finditer(_NAME, m.group("name"))]
            held = own[: next((i for i, w in enumerate(own) if w.group()[0].islower()), len(own))]
            for i, w in enumerate(held):
                part = "family" if i == len(held) - 1 else _TITLE_GENDER[m.group("title")]
                people.append((m.start("name") + w.start(), m.start("name") + w.end(), part, w.group().lower()))
        elif kind == "card" and not luhn(re.sub(r"\D", "", m.group())):
            continue  # any other number
        elif kind in ("card", "phone", "ssn", "iban"):
            entity = re.sub(r"[^0-9A-Z+]", "", m.group())
            out.append((*span, kind, entity))
            if kind != "iban":
                numbers.setdefault(entity.lstrip("+"), entity)
                numbers[entity] = kind
        else:
            out.append((*span, kind, m.group()))
    # The gender of a given name is that of any of its titles, or of the lists; a neutral title says nothing.
    gender: dict[str, str] = {}
    for _, _, part, word in people:
        if part in "fm":
            gender.setdefault(word, part)
    kind_of: dict[str, str] = {}
    for start, end, part, word in people:
        kind = part if part == "family" else f"given-{part if part in 'fm' else gender.get(word) or _LISTED.get(word, 'n')}"
        out.append((start, end, kind, word))
        kind_of.setdefault(word, kind)
    taken = sorted((a, b) for a, b, _, _ in out)

    def free(start: int, end: int) -> bool:
        i = bisect.bisect_left(taken, (start, start))
        return (i == len(taken) or taken[i][0] >= end) and (i == 0 or taken[i - 1][1] <= start)

    if kind_of:  # mentions without the title, in any case
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(kind_of, key=len, reverse=True))) + r")(?!\w)", text, re.IGNORECASE):
            word = m.group().lower()
            if word in kind_of and not m.group().islower() and free(*m.span()):
                out.append((*m.span(), kind_of[word], word))
    if numbers:  # the same numbers without their separators
        bare = sorted((n for n in numbers if n.isdecimal()), key=len, reverse=True)
        for m in re.finditer(r"(?<![\w+.-])(?:" + "|".join(bare) + r")(?!\w)", text) if bare else ():
            entity = m.group() if numbers[m.group()] in _KINDS else numbers[m.group()]
            if free(*m.span()):
                out.append((*m.span(), numbers[entity], entity))
    return sorted(out)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


class Draws:
    """Numbers from a keyed hash of an entity and the number of the draw."""

    def __init__(self, key: bytes, kind: str, entity: str, draw: int):
        self.seed, self.block, self.bits = f"{kind}\0{draw}\0{entity}".encode(), 0, 0
        self.key, self.value = hashlib.blake2b(key, digest_size=32).digest(), 0

    def below(self, n: int) -> int:
        if self.bits < 48:
            digest = hashlib.blake2b(self.seed, key=self.key, salt=self.block.to_bytes(8, "little")).digest()
            self.value, self.bits, self.block = int.from_bytes(digest, "little"), 512, self.block + 1
        self.bits -= 32
        self.value, out = self.value >> 32, self.value & 0xFFFFFFFF
        return out * n >> 32

    def shaped(self, text: str) -> str:
        """A digit for each digit and, for a cased letter, one of the same case and script; the rest stays."""
        hexadecimal = len(text) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
        out = []
        for c in text:
            if c.isdecimal():
                zero = ord(c) - unicodedata.decimal(c)
                out.append(chr(zero + self.below(10)))
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                base = ord("a") if c.islower() else ord("A")
                out.append(chr(base + self.below(6 if hexadecimal else 26)))
            elif c.isalpha():
                out.append(self.near(c))
            else:
                out.append(c)
        return "".join(out)

    def near(self, c: str) -> str:
        """A letter of the same script, case and kind among the 64 code points around."""
        word = unicodedata.name(c, "OTHER").split(" ", 1)[0]
        base = ord(c) & ~63
        like = [x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == unicodedata.category(c) and unicodedata.name(x, "").startswith(word) and unicodedata.is_normalized("NFC", x)]
        return like[self.below(len(like))] if like else c


def surrogate(key: bytes, kind: str, entity: str, draw: int = 0) -> str:
    """The replacement of an entity, in the entity's own spelling without separators."""
    d = Draws(key, kind, entity, draw)
    if kind == "email":
        local, _, domain = entity.partition("@")
        *labels, top = domain.split(".")
        host = Draws(key, "domain", domain, 0)
        return f"{d.shaped(local + 'x' * (draw // WIDER))}@{'.'.join(host.shaped(x) for x in labels)}.{top}"
    if kind == "awskey":
        return entity[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in entity[4:])
    if kind == "ip":
        private = re.match(r"(10\.|192\.168\.|127\.)", entity)
        head = (private.group(), "10.")[draw >= WIDER] if private and draw < 4 * WIDER else ""
        n = 4 - head.count(".")
        first = "" if head else str((*range(11, 127), *range(128, 172), *range(173, 192), *range(193, 224))[d.below(116 + 44 + 19 + 31)]) + "."
        return head + first + ".".join(str(d.below(256)) for _ in range(n - bool(first)))
    if kind == "card":
        body = entity[0] + "".join(str(d.below(10)) for _ in entity[2:])
        valid = [str(x) for x in range(10) if luhn(body + str(x))]  # one
        return body + valid[0]
    if kind == "phone":
        country = re.match(r"\+(?:1|7|[2-9]\d)", entity)
        head = country.group() if country and len(entity) > len(country.group()) + 5 else ""
        rest = entity[len(head) :]
        return head + "".join(c if not c.isdecimal() else str(2 + d.below(8)) if i == 0 and c not in "01" else str(d.below(10)) for i, c in enumerate(rest))
    if kind == "iban":
        return entity[:2] + d.shaped(entity[2:])
    if kind.startswith("given") or kind == "family":
        script, gender = _letters(entity), kind[-1] if kind[-1] in "fm" else "fm"[d.below(2)]
        parts = []
        for _ in range(1 + (draw + 1) // 2):  # later draws are longer, so that no number of names exhausts them
            if kind == "family" and script == "LATIN":
                parts.append(_ONSETS[d.below(len(_ONSETS))] + _CODAS[d.below(len(_CODAS))])
            elif kind != "family" and script in ("LATIN", "CYRILLIC"):
                parts.append(GIVEN[script, gender][d.below(len(GIVEN[script, gender]))])
            else:
                parts.append(d.shaped(entity).title())
        return "-".join(parts)
    return d.shaped(entity)


def _rendered(found: str, entity: str, new: str, kind: str) -> str:
    """The surrogate with the separators, or the case of a name, that the text has."""
    if kind == "family" or kind.startswith("given"):
        return new.upper() if found.isupper() and len(found) > 1 else new
    if kind not in ("card", "phone", "ssn", "iban"):
        return new
    rest = iter(new)
    return "".join(next(rest) if c.isdecimal() or "A" <= c <= "Z" or c == "+" else c for c in found)


def replaced(text: str, key: bytes, draws: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, list[str]]:
    """The text with surrogates and the kinds of its entities in order; ``draws`` has the entities that are drawn as another kind, or not by the first draw."""
    out, at, kinds = [], 0, []
    for start, end, kind, entity in find(text):
        if start < at:
            continue
        drawn_as, draw = draws.get((kind, entity), (kind, 0))
        out += [text[at:start], _rendered(text[start:end], entity, surrogate(key, drawn_as, entity, draw), kind)]
        at = end
        kinds.append(kind)
    return "".join(out) + text[at:], kinds


def _entities(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_hash, kind, entity), each once for a row; the hash keeps rows with null or repeated ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, kind, entity) for i, text in enumerate(batch.column(2).to_pylist()) if text for kind, entity in sorted({x[2:] for x in find(text)})]
            if rows:
                at, kinds, entities = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:2]), pa.array(kinds), pa.array(entities)], names=["id", "text_hash", "kind", "entity"])

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, kind string, entity string")


def _checked(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, drawn_as, draw) of the entities that are drawn as another kind, or whose first surrogate does not stand.

    A given name without a gender is drawn like the same name with one, if any
    document tells it. Surrogates are compared within a kind, given names of all
    genders together. One that equals a real entity, or that another entity has
    with an earlier draw or an earlier name, is drawn anew until none is left.
    """
    told = entities.where(F.col("kind").isin("given-f", "given-m")).groupBy("entity").agg(F.min("kind").alias("drawn_as"))
    same = entities.where("kind = 'given-n'").join(told, "entity").select("kind", "entity", "drawn_as")
    same = shared.written(same, "told-genders")
    entities = shared.written(entities.join(same, ["kind", "entity"], "left_anti"), "drawn-entities")

    def drawn(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [surrogate(key, *row) for row in zip(*(c.to_pylist() for c in batch.columns))]
                found = [x.lower() if kind == "family" or kind.startswith("given") else x for x, kind in zip(found, batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["kind", "entity", "draw", "surrogate"])

        return rows.mapInArrow(run, "kind string, entity string, draw int, surrogate string")

    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("group")
    real = entities.select(group, F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
    state = shared.written(drawn(entities.withColumn("draw", F.lit(0))), "surrogates")
    for _ in range(MOST_DRAWS):
        order = F.row_number().over(Window.partitionBy("group", "surrogate").orderBy("draw", "entity", "kind"))
        judged = state.withColumn("group", group).withColumn("order", order).join(real, ["group", "surrogate"], "left")
        lost = shared.written(judged.where("order > 1 or real").select("kind", "entity", (F.col("draw") + 1).cast("int").alias("draw")), "redrawn")
        if lost.isEmpty():
            drawn_anew = state.where("draw > 0").select("kind", "entity", F.col("kind").alias("drawn_as"), "draw")
            by_target = drawn_anew.select(F.col("kind").alias("drawn_as"), "entity", "draw")
            aliases = same.join(by_target, ["drawn_as", "entity"], "left").select("kind", "entity", "drawn_as", F.coalesce("draw", F.lit(0)).alias("draw"))
            return drawn_anew.union(aliases)
        state = shared.written(state.join(lost, ["kind", "entity"], "left_anti").unionByName(drawn(lost)), "surrogates")
    raise ValueError(f"no distinct surrogates after {MOST_DRAWS} draws; too many entities for their format")


def pseudonymize(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and with n_entities and entity_kinds, which replace columns of these names.

    Null and empty texts stay; a text without entities stays as it is. Ids may
    be null or repeated: a row's key is its id with a hash of its text. The only thing joined to the texts is the list of
    redrawn entities by document, which Spark broadcasts if it is small and
    shuffles otherwise.
    """
    shared.small_batches(docs.sparkSession)
    found = shared.written(_entities(docs, id_column, text_column), "entities")
    redrawn = _checked(found.select("kind", "entity").distinct(), key)
    by_row = found.join(redrawn, ["kind", "entity"]).groupBy(F.col("id").alias("redrawn_id"), F.col("text_hash").alias("redrawn_hash")).agg(F.collect_set(F.struct("kind", "entity", "drawn_as", "draw")).alias("redrawn_draws"))
    by_row = shared.written(by_row, "redrawn-by-document")
    base = docs.drop("n_entities", "entity_kinds", "redrawn_draws", "redrawn_id", "redrawn_hash")
    same_row = base[id_column].eqNullSafe(F.col("redrawn_id")) & (F.xxhash64(base[text_column]) == F.col("redrawn_hash"))
    joined = base.join(by_row, same_row, "left").select(*(base[c] for c in base.columns), "redrawn_draws")

    def work():
        def each(batch):
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            draws = batch.column(batch.schema.get_field_index("redrawn_draws")).to_pylist()
            new, kinds = [], []
            for text, known in zip(texts, draws):
                text, own = replaced(text, key, {(d["kind"], d["entity"]): (d["drawn_as"], d["draw"]) for d in known or ()}) if text else (text, [])
                new.append(text)
                kinds.append(own)
            return [new, [len(k) for k in kinds], kinds]

        return each

    # appended() replaces the text by name; the old text has another name meanwhile.
    old = "__text_before"
    while old in base.columns:
        old += "_"
    named = joined.withColumnRenamed(text_column, old)

    def made():
        each = work()
        return lambda batch: each(batch.rename_columns([text_column if n == old else n for n in batch.schema.names]))

    out = shared.appended(named, [(text_column, "string"), ("n_entities", "long"), ("entity_kinds", "array<string>")], made)
    return out.select(*base.columns, "n_entities", "entity_kinds")
