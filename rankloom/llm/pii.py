"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same wherever an entity recurs.

An entity is a kind and a canonical form: an address in lower case, an address's domain, a number's digits, one word of
a name.  Its surrogate comes from a keyed hash of both.  Addresses of one domain keep one domain.  Names are found
after forms of address, as a common first name with a capitalised word after it, and wherever a name so found recurs in
the same text as a whole word of the same letter case.  All distinct entities are held against each other and against the originals;
of those whose surrogates clash all but the smallest draw again, until none do.  Texts are then rewritten where
they are read, with the few redrawn entities at hand.  The key decides everything, so runs and shards agree.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import cut, scope, ship
from .rows import append

#: Redrawn entities that tasks get as one table; beyond, each text's own are joined to it.
BROADCAST_ENTITIES = 200_000
ATTEMPTS = 64

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds found by pattern, the better first where two start at the same place.
PATTERNS = (
    ("email", re.compile(r"[^\W_](?:[\w.%+-]{0,62}[\w%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w])(?!\.[0-9])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{4,5})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|\([0-9]{2,4}\)[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?!\w)|(?<![\w.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")),
)
#: Forms of address before a name, by gender; "" tells none.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Profesor", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doctora", "Profesora", "Госпожа"),
    "": ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Доктор", "Профессор"),
}
#: Common first names that show a name without a form of address, by gender; none that is also a usual word.
FIRST_NAMES = {
    "m": (
        "Alexander Andrew Anthony Benjamin Charles Christopher Daniel David Edward George Henry James Jeffrey John Jonathan Joseph Kenneth Kevin Matthew Michael "
        "Nicholas Patrick Paul Peter Richard Robert Ronald Samuel Stephen Steven Thomas Timothy William "
        "Andreas Christoph Dieter Friedrich Günter Hans Heinrich Helmut Jürgen Klaus Matthias Stefan Uwe Wolfgang "
        "Alain Antoine Baptiste Bernard Étienne François Guillaume Jacques Jean Julien Laurent Mathieu Nicolas Olivier Philippe Pierre Thierry "
        "Alejandro Antonio Carlos Diego Enrique Fernando Francisco Javier Joaquín José Juan Luis Manuel Miguel Pedro Rafael Ricardo Roberto Sergio"
    ).split(),
    "f": (
        "Amanda Amy Barbara Catherine Christine Deborah Elizabeth Emily Jennifer Jessica Karen Katherine Laura Linda Lisa Margaret Mary Melissa Michelle Nancy Patricia "
        "Rachel Rebecca Sarah Sharon Stephanie Susan "
        "Anke Brigitte Christa Gisela Heike Ingrid Katharina Monika Petra Renate Sabine Ursula "
        "Amélie Camille Cécile Céline Chloé Claire Hélène Isabelle Juliette Nathalie Sophie Valérie Véronique "
        "Carmen Concepción Cristina Dolores Francisca Isabel Josefa Lucía Mercedes Pilar Raquel Teresa"
    ).split(),
}
#: First names of surrogates, by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl Dario Emil Felix Georg Hugo Ivan Jonas Karim Leon Marco Niels Oscar Pablo".split(),
    ("f", "latin"): "Alma Berta Clara Dora Elena Frida Greta Hanna Irma Julia Karla Lena Maria Nora Olga Paula".split(),
    ("", "latin"): "Alexis Chris Dominique Eden Jamie Jules Kim Luca Morgan Noa Quinn Robin Sascha Toni Yael".split(),
    ("", "cyrillic"): "Саша Женя Валя Слава Шура Мика".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия".split(),
}
#: Syllables of surrogate surnames, by script.
SYLLABLES = {
    "latin": "bar bel bor dal den dor fal fen gar gel hal hol kan ker kol lan lem lor mar mel mon nal nor pel por ral ren rol san sel tor val ven vor wal zel".split(),
    "cyrillic": "бар бел вол гор дав зар кал кор лан мар мел мор нал нов пет пол рам сав сел тар тор фад хар".split(),
}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TITLE = rf"(?:{'|'.join(sorted(_TITLE_GENDER, key=len, reverse=True))})"
_WORD = rf"(?!{_TITLE}(?!\w))([^\W\d_]+(?:-[^\W\d_]+)?)"
_NAME = re.compile(rf"(?<!\w)({_TITLE}(?:\.?[  ]{_TITLE}(?!\w))*)\.?[  ]{_WORD}(?:[  ]{_WORD})?")

_FIRST_GENDER = {n: g for g, ns in FIRST_NAMES.items() for n in ns}
_KNOWN = re.compile(rf"({'|'.join(sorted(_FIRST_GENDER, key=len, reverse=True))})[  ]{_WORD}")
#: No text without a match of this holds an entity; the first class spares the alternatives at most places.
GATE = f"[0-9@]|(?=[{''.join(sorted({n[0] for n in (*_TITLE_GENDER, *_FIRST_GENDER)}))}])(?:{'|'.join((*_TITLE_GENDER, *_FIRST_GENDER))})"

_SINGLE, _PAIR = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)"), re.compile(r"(?<!\w)(?=([^\W\d_]+-[^\W\d_]+)(?!\w))")


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def luhn(digits: str) -> bool:
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


class _Draw:
    """Numbers below given bounds from a keyed hash."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self._state = (key, f"{kind}\0{canonical}\0{attempt}".encode("utf-8", "surrogatepass"))
        self._pool, self._n = 0, 0
        self._size = 1

    def __call__(self, bound: int) -> int:
        if self._size < bound << 32:
            self._n += 1
            self._pool = int.from_bytes(hmac.new(self._state[0], self._state[1] + self._n.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self._size = 1 << 256
        self._pool, x = divmod(self._pool, bound)
        self._size //= bound
        return x


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate, of the same kind and shape; later attempts differ."""
    draw = _Draw(key, kind, canonical, attempt)
    if kind == "domain":
        name = canonical.rsplit(".", 1)[0]
        return "".join(chr(97 + draw(26)) for _ in range(min(24, max(7, len(name))) + attempt // 8)) + ".example.org"
    if kind == "email":  # the domain's own surrogate follows later
        local, domain = canonical.split("@")
        shape = "".join(str(draw(10)) if c.isdigit() else c if c in "._%+-" else chr(97 + draw(26)) for c in local)
        room = sum(c.isalnum() for c in shape)
        shape += "".join(chr(97 + draw(26)) for _ in range(max(0, 8 - room) + attempt // 8))
        return f"{shape}@{domain}"
    if kind == "ip":
        return ".".join(str(draw(254) + 1) for _ in range(4))
    if kind == "iban":
        return canonical[:2] + "".join(str(draw(10)) if c.isdigit() else chr(65 + draw(26)) for c in canonical[2:])
    if kind in ("card", "ssn"):
        lead = "9" if kind == "ssn" else canonical[0]
        out = lead + "".join(str(draw(10)) for _ in canonical[1:])
        if kind == "card" and luhn(canonical):  # stays valid
            out = next(out[:-1] + str(x) for x in range(10) if luhn(out[:-1] + str(x)))
        return out
    if kind == "phone":
        head = canonical[:2] if canonical[0] == "+" else ""
        rest = len(canonical) - len(head)
        return head + str(draw(8) + 2) + "".join(str(draw(10)) for _ in range(rest - 1))
    what, gender, script = kind.split(":")
    if what == "given":
        names = GIVEN[gender, script]
        first = names[draw(len(names))]
        return first.lower() if not attempt else f"{first.lower()}-{_surname(draw, script, 1 + attempt // 8)}"
    return _surname(draw, script, 3 + attempt // 8) + ("ова" if (gender, script) == ("f", "cyrillic") else "")


def _surname(draw: _Draw, script: str, n: int) -> str:
    parts = SYLLABLES[script]
    return "".join(parts[draw(len(parts))] for _ in range(n))


def canonical(kind: str, text: str) -> str:
    if kind in ("email", "given", "surname") or ":" in kind:
        return text.lower()
    if kind == "ip":
        return text
    return ("+" if kind == "phone" and text[0] == "+" else "") + "".join(c for c in text if c.isalnum())


def render(kind: str, text: str, made: str) -> str:
    """``made`` in the format of the original: its separators, its letter case."""
    if kind == "email":
        return made.upper() if text.isupper() else made
    if ":" in kind:
        return made.upper() if text.isupper() and len(text) > 1 else "-".join(p.capitalize() for p in made.split("-")) if text[:1].isupper() else made
    if kind in ("ip",):
        return made
    rest = iter(made.lstrip("+"))
    out = [next(rest, "") if c.isalnum() else c for c in text]
    return "".join(out) + "".join(rest)


def made_for(key: bytes, kind: str, canon: str, attempts: dict[tuple[str, str], int]) -> str:
    """The surrogate of an entity, given the entities that were drawn again and how often."""
    made = surrogate(key, kind, canon, attempts.get((kind, canon), 0))
    if kind == "email":
        domain = canon.split("@")[1]
        made = f"{made.split('@')[0]}@{surrogate(key, 'domain', domain, attempts.get(('domain', domain), 0))}"
    return made


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, none overlapping another, by start."""
    found = []
    if any(c in text for c in "0123456789"):
        for rank, (kind, pattern) in enumerate(PATTERNS):
            if kind != "email" or "@" in text:
                found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text)]
    elif "@" in text:
        found += [(m.start(), 0, m.end(), "email") for m in PATTERNS[0][1].finditer(text)]
    names, genders = [], {}
    for m in _KNOWN.finditer(text):
        if m[2][0].isupper() and len(m[2]) > 1 and (not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            sex = _FIRST_GENDER[m[1]]
            names += [(m.start(1), m.end(1), "given", sex, "latin"), (m.start(2), m.end(2), "surname", "", script_of(m[2]))]
            genders.setdefault(("given", m[1]), sex)
    if names or any(t in text for t in _TITLE_GENDER):
        for m in _NAME.finditer(text):
            gender = next((g for t in re.split(r"\W+", m[1]) if (g := _TITLE_GENDER[t])), "")
            words = [i for i in (2, 3) if m[i] and m[i][0].isupper() and (i == 2 or m[2][0].isupper())]
            for i in words:
                what, script = "given" if i == 2 and len(words) == 2 else "surname", script_of(m[i])
                sex = "" if (what, script) == ("surname", "latin") else gender  # one family, one name
                names.append((m.start(i), m.end(i), what, sex, script))
                if sex:
                    genders.setdefault((what, m[i]), sex)
        kinds: dict[str, str] = {}
        for a, e, what, sex, script in names:  # a title without gender takes that of another mention
            kind = f"{what}:{sex or genders.get((what, text[a:e]), '')}:{script}"
            found.append((a, len(PATTERNS), e, kind))
            if e - a > 1:  # no initials
                kinds.setdefault(text[a:e], kind)
        if kinds:
            if any("-" in w for w in kinds):
                found += [(m.start(1), len(PATTERNS) + 1, m.end(1), kinds[m[1]]) for m in _PAIR.finditer(text) if m[1] in kinds]
            found += [(m.start(), len(PATTERNS) + 2, m.end(), kinds[m[0]]) for m in _SINGLE.finditer(text) if m[0] in kinds]
    out, last = [], 0
    for start, _, end, kind in sorted(found):
        if start >= last:
            out.append((start, end, kind))
            last = end
    return out


def _entities(docs: DataFrame) -> DataFrame:
    """(h, kind, canon), stored to outlast the scope: each text's distinct entities; h tells texts apart."""

    def run(batches):
        for b in batches:
            rows = [(h, kind, canonical(kind, t[a:e])) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for a, e, kind in find(t)]
            rows += [(h, "domain", canon.split("@")[1]) for h, kind, canon in rows if kind == "email"]
            rows = sorted(set(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], ["h", "kind", "canon"])

    return cut(docs, lasting=True, batch=250, by=run, schema="h long, kind string, canon string")


def _drawn(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """(kind, canon, made), stored."""

    def run(batches):
        for b in batches:
            made = [surrogate(key, k, c, attempt) for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], ["kind", "canon", "made"])

    return cut(entities.select("kind", "canon"), by=run, schema="kind string, canon string, made string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, made, attempt) for distinct (kind, canon): within a class no two get the same surrogate, none another's original.

    Each round compares all drawn surrogates by joins and aggregates; those that clash draw again.  Raises if any still
    clash after ATTEMPTS rounds, as when a format has fewer forms than there are entities of it.
    """
    settled, pending = None, cut(entities.select("kind", "canon").distinct())
    originals = pending.select("kind", F.col("canon").alias("made"))
    for attempt in range(ATTEMPTS):
        drawn = _drawn(pending, key, attempt)
        free = drawn.join(originals, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        won = free.groupBy("kind", "made").agg(F.min("canon").alias("canon")).withColumn("attempt", F.lit(attempt)).select("kind", "canon", "made", "attempt")
        settled = cut(won if settled is None else settled.unionByName(won))
        pending = cut(pending.join(settled.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return settled
    raise ValueError(f"after {ATTEMPTS} draws some surrogates still clash")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with the text rewritten, n_pii and pii: array<struct(kind, start, end, made)>, places in the original text.

    Equal entities get equal surrogates in all rows, distinct ones distinct surrogates, addresses of one domain one
    domain.  A null text stays null, one without entities as it is; all other columns pass through but for n_pii and pii.  Hot entities cost nothing:
    they are made distinct by partial aggregates.
    """
    spark = docs.sparkSession
    ship(spark)
    whole = F.xxhash64(F.col(text_col))
    texts = docs.where(F.col(text_col).rlike(GATE))
    with scope(spark):
        found = _entities(texts.select(whole.alias("h"), F.col(text_col).alias("t")))
        redrawn = cut(assign(found, key).where("attempt > 0"), lasting=True)
    at = docs.columns.index(text_col)
    n = redrawn.count()
    if n <= BROADCAST_ENTITIES:
        shared = spark.sparkContext.broadcast({(r.kind, r.canon): r.attempt for r in redrawn.collect()})
        held, extra = docs, None
    else:
        own = found.join(redrawn, ["kind", "canon"]).select("h", "kind", "canon", "attempt").distinct().groupBy("h").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("__redrawn"))
        held = docs.withColumn("__h", whole).join(own.withColumnRenamed("h", "__h"), "__h", "left").select(*docs.columns, "__redrawn")
        shared, extra = spark.sparkContext.broadcast({}), len(docs.columns)

    def rewrite(b: pa.RecordBatch, known: dict) -> list:
        texts, counts, spans = [], [], []
        mine = b.column(extra).to_pylist() if extra is not None else None
        for i, t in enumerate(b.column(at)):
            t = t.as_py()
            found = find(t) if t else []
            attempts = known if mine is None else {(r["kind"], r["canon"]): r["attempt"] for r in mine[i] or ()}
            parts, last, own = [], 0, []
            for a, e, kind in found:
                canon = canonical(kind, t[a:e])
                made = render(kind, t[a:e], made_for(key, kind, canon, attempts))
                parts += [t[last:a], made]
                own.append({"kind": kind, "start": a, "end": e, "made": made})
                last = e
            texts.append("".join([*parts, t[last:]]) if found else t)
            counts.append(len(own))
            spans.append(own)
        return [texts, counts, spans]

    columns = [c for c in docs.columns if c.lower() not in ("n_pii", "pii")]
    done = append(held, "__text string, n_pii long, pii array<struct<kind:string,start:long,end:long,made:string>>", rewrite, lambda: shared.value)
    return done.select(*[F.col("__text").alias(c) if c == text_col else F.col(c) for c in columns], "n_pii", "pii")


#: The demonstration key of the registered queries; real runs bring their own secret.
DEMO_KEY = b"rankloom demonstration key"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pseudonymise(docs, DEMO_KEY)
    kinds = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("pii", lambda x: F.split(x["kind"], ":")[0]))))
    return found.select("doc_id", "text", "n_pii", kinds.alias("kinds"))


QUERIES = {"op9_pii_surrogates": op9_pii_surrogates}
