"""Secrets in texts: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Everything on the main path is DataFrame functions.  A pattern's places come from the text's pieces between its
matches: a match starts after all pieces and matches before it, in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed patterns (kind, regular expression, group to measure, least length); kinds in the order of results.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs, so the length can stand in the pattern
)
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/="
#: Runs that the models judge.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Nats by which a run must look more random than ordinary; also the log of the prior odds against a secret.
MARGIN = 12.0

PLACE = "struct<start:bigint,kind:int,end:bigint,name:string,match:string>"
#: Values that a fold gathers in one array.
BLOCK = 128

#: Words of ordinary identifiers and prose, for the built-in labelled sample.
WORDS = (
    "get set user name list index count value string number total price order item part customer supplier nation region event page "
    "document label token model train data table column schema query filter join group window stream source sink file path config option "
    "default parse format encode decode compress buffer cache memory thread worker process task stage shuffle partition broadcast driver "
    "the of and to in that for with this from are was here there where which other these have been into only over under between after "
    "house water people world information government university international development organization communication responsibility "
    "nicht einheit schaft keiten ungen verein gesell entwicklung möglich lich pour dans avec entre notre chaque quelque maison ville "
    "para como donde siempre nunca ciudad mundo tiempo gente usr local lib bin include home var tmp www http com org net html index"
).split()


def labelled_sample(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(text, random): n random strings in four alphabets and n ordinary identifiers, paths and words, made by rule."""
    key = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(key))
    drawn = F.element_at(F.array(key, packed, F.translate(packed, "+/=", "-_"), F.upper(key)), (F.col("id") % 4 + 1).cast("int"))
    noise = spark.range(n).select(drawn.alias("text"), F.lit(True).alias("random"))
    words = F.split(F.lit(" ".join(WORDS)), " ")

    def pick(i: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(WORDS))) + 1).cast("int"))

    parts = [pick(i) for i in range(5)]
    styles = F.array(F.concat_ws("_", *parts), F.concat(parts[0], *map(F.initcap, parts[1:])), F.upper(F.concat_ws("_", *parts)), F.concat_ws("-", *parts), F.concat_ws("/", *parts), F.concat(*parts), F.concat(F.concat_ws("_", *parts[:3]), (F.col("id") % 100).cast("string")))
    plain = spark.range(n).select(F.element_at(styles, (F.col("id") % 7 + 1).cast("int")).alias("text"), F.lit(False).alias("random"))
    return noise.unionByName(plain)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """From (text, random) the table of log-likelihood ratios of every symbol after another, row by row.

    Symbol 0 is any character outside SYMBOLS.  Counting is a grouped aggregate; the driver gets one row for each pair
    of symbols and label.  Nulls are left out; without samples every ratio is 0.
    """
    k = len(SYMBOLS) + 1
    pairs = samples.where("text is not null and random is not null and length(text) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substr(text, i, 2))")).alias("p"))
    counts = pairs.groupBy("random", F.instr(F.lit(SYMBOLS), F.substring("p", 1, 1)).alias("i"), F.instr(F.lit(SYMBOLS), F.substring("p", 2, 1)).alias("j")).count().collect()
    n = {True: [[smoothing] * k for _ in range(k)], False: [[smoothing] * k for _ in range(k)]}
    for r in counts:
        n[r.random][r.i][r.j] += r["count"]
    return [log(n[True][i][j] / sum(n[True][i])) - log(n[False][i][j] / sum(n[False][i])) for i in range(k) for j in range(k)]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _before(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """array<bigint>: for each of ``values`` what the associative ``op`` makes of all before it, ``zero`` for the first.

    A fold copies its state at every step, so it goes by blocks of BLOCK: first their totals, then each from its start.
    Blocks are taken out element by element, since slice copies the whole array.
    """
    nought = F.lit(zero).cast("long")

    def running(x: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(x, first, lambda acc, v: F.struct(op(acc["s"], v).cast("long").alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")))["out"]

    def walk(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.transform(F.sequence(i * BLOCK, F.least(i * BLOCK + BLOCK, F.size(x)) - 1), lambda j: F.get(x, j)))
        starts = lambda p: running(F.transform(p, lambda part: F.aggregate(part, nought, lambda s, v: op(s, v).cast("long"))), nought)
        return F.when(F.size(x) > 0, _let(parts, lambda p: F.flatten(F.zip_with(p, starts(p), running)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(F.transform(values, lambda v: v.cast("long")), walk)


def _places(text: Column, pattern: str, kind: int, name: str, group: int, least: int) -> Column:
    """Array of PLACE: the matches whose group has the least length."""
    p = F.lit(pattern)
    found = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"), F.split(text, pattern, -1).alias("gap"))

    def place(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["match"])).alias("end"), F.lit(name).alias("name"), F.when(F.length(x["part"]) >= least, x["match"]).alias("match"))

    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))
    walked = _let(found, lambda f: F.zip_with(f, _before(F.transform(f, length), 0, lambda a, b: a + b), place))
    return F.when(F.regexp_like(text, p), F.filter(walked, lambda x: x["match"].isNotNull())).otherwise(F.expr(f"cast(array() as array<{PLACE}>)"))


def _ratio(token: Column, table: list[float]) -> Column:
    """The sum of the ratios of every symbol after another; the token is taken apart once."""
    k = len(SYMBOLS) + 1
    cells = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")  # folded to one literal
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    pairs = _let(codes, lambda x: F.zip_with(x, F.slice(x, 2, F.size(x)), lambda i, j: F.when(j.isNull(), 0.0).otherwise(F.element_at(cells, i * k + j + 1))))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _apart(places: Column) -> Column:
    """Of places sorted by start, then kind, those of patterns and the runs that overlap none of these."""
    run = lambda x: x["kind"] == len(BASE)

    def kept(p: Column) -> Column:
        furthest = _before(F.transform(p, lambda x: F.when(run(x), -1).otherwise(x["end"])), -1, F.greatest)
        nearest = F.reverse(_before(F.reverse(F.transform(p, lambda x: F.when(run(x), 1 << 40).otherwise(x["start"]))), 1 << 40, F.least))
        free = F.zip_with(F.zip_with(p, furthest, lambda x, end: F.when(~run(x) | (end <= x["start"]), x)), nearest, lambda x, start: F.when(~run(x) | (start >= x["end"]), x))
        return F.filter(free, lambda x: x.isNotNull())

    return _let(places, kept)


def secret_scan(docs: DataFrame, table: list[float], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, places), one row per row: array<struct(start, kind, end, name, match)> sorted by start, then kind.

    Places are code points with exclusive ends.  A run judged random is added with the name ``markov`` unless it
    overlaps a match of a pattern.  A null or empty text has no places; ids may be null or repeated; other columns are
    ignored.  Texts are scanned whole, with no shuffle, in time that grows with their length, however long a run or
    many the matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", F.concat(*(_places(F.col("text"), p, i, name, g, least) for i, (name, p, g, least) in enumerate(BASE))).alias("base"), _places(F.col("text"), CANDIDATE, len(BASE), "markov", 0, 2).alias("runs"))
    random = F.filter("runs", lambda r: _ratio(r["match"], table) > margin)
    places = _let(random, lambda r: F.when(F.size(r) == 0, F.array_sort("base")).when(F.size("base") == 0, r).otherwise(_apart(F.array_sort(F.concat("base", r)))))
    return d.select("doc_id", places.alias("places"))


def _digest(places: Column) -> Column:
    return F.concat_ws(",", F.transform(places, lambda s: F.concat_ws(":", s["name"], s.start.cast("string"), s.end.cast("string"))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = train(labelled_sample(spark))
    found = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), table)
    base = F.filter("places", lambda s: s.kind < len(BASE))
    kinds = F.transform("places", lambda s: s.kind)
    count = [F.size(F.filter(kinds, lambda k: k.eqNullSafe(F.lit(i)))).cast("long").alias(f"n_{name}") for i, (name, *_) in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("places")).alias("spans"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
