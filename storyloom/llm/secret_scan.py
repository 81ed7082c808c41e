"""Secrets in texts: known patterns, and tokens that pass a battery of randomness tests."""

from __future__ import annotations

from math import log10, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import texts, written

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
# The patterns of the base scan. Java folds case of ASCII letters only.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so shorter ones need not be found to be dropped
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Candidates of the randomness tests: maximal runs, with the padding of base 64.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, narrowest first: pattern and alphabet. A token is of the first one that matches it.
ENCODINGS = (
    ("[0-9]+", _DIGIT),
    ("[0-9a-f]+", _DIGIT + _LOWER[:6]),
    ("[0-9A-F]+", _DIGIT + _UPPER[:6]),
    ("[a-z]+", _LOWER),
    ("[A-Z]+", _UPPER),
    ("[A-Z2-7]+", _UPPER + _DIGIT[2:8]),
    ("[0-9a-z]+", _DIGIT + _LOWER),
    ("[0-9A-Z]+", _DIGIT + _UPPER),
    ("[A-Za-z]+", _UPPER + _LOWER),
    ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGIT + "+/"),
    ("[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGIT + "-_"),
    (".*", _UPPER + _LOWER + _DIGIT + "+/-_"),
)
#: Chance that two letters of ordinary text are equal; narrow alphabets take twice what is least.
TEXT_COINCIDENCE = 0.066
#: A token that is random is called otherwise this often; and this share of what is reported may be ordinary.
ALPHA, FALSE_DISCOVERIES = 0.001, 0.01
#: Steps a decade in which chances are counted.
STEPS, DECADES = 20, 40


def _upper_tail(z: Column) -> Column:
    """Chance of a normal deviate above z, in relative terms good to a few per cent from 0 on."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / sqrt(2 * pi)
    t = 1 / (1 + a * 0.2316419)
    near = density * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.when(a > 5, density / a * (1 - 1 / (a * a))).otherwise(near)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _pairs(text: Column, pattern: str, value_group: int | None = None) -> Column:
    """For every match, in order: characters since the last one, the match, and the length of what counts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if value_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("token"), counted.alias("counted"))
    # There is one piece more than there are matches.
    return F.transform(
        F.filter(zipped, lambda x: x["token"].isNotNull()),
        lambda x: F.struct(x["gap"].alias("gap"), x["token"].alias("token"), F.length(x["counted"]).alias("n")),
    )


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, at, kind, start, stop, token, n) of every match in ``docs`` (doc_id, text, at).

    The text is read once and left behind; a running sum over the matches of a text gives places.
    """
    lower = F.lower("text")
    has_name = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    gated = [
        ("assign", F.when(has_name, _pairs(F.col("text"), ASSIGN, 2))),
        ("access", F.when(F.contains("text", F.lit("AKIA")), _pairs(F.col("text"), ACCESS))),
        ("hex", F.when(F.col("text").rlike(HEX), _pairs(F.col("text"), HEX))),
        ("random", F.when(F.col("text").rlike(TOKEN), _pairs(F.col("text"), TOKEN))),
    ]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), found.alias("found")) for k, found in gated])
    each = docs.select("doc_id", "at", F.explode(kinds).alias("of")).filter(F.col("of.found").isNotNull())
    rows = each.select("doc_id", "at", F.col("of.kind").alias("kind"), F.posexplode("of.found").alias("place", "m"))
    # Equal rows of the input have equal matches.
    rows = rows.select("doc_id", "at", "kind", "place", "m.gap", "m.token", "m.n").dropDuplicates(
        ["doc_id", "at", "kind", "place"]
    )
    here = Window.partitionBy("doc_id", "at", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("token")).over(here)
    return rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("token"))


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token, ...) plus p_random and p_text.

    p_random: the chance that a random token of the inferred encoding looks as odd as this one, from
    chi-squared for a uniform alphabet, the number of runs in the lower and upper half of the alphabet, and
    the correlation of neighbours; the least of the three, times three. p_text: the chance that ordinary
    text of this length has so few equal characters. A longer token tells both more surely.
    """
    encoding = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        encoding = F.when(F.col("body").rlike(f"^{ENCODINGS[i][0]}$"), i).otherwise(encoding)
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    halves = F.array(*[F.lit("0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for _, a in ENCODINGS])
    rows = (
        tokens.withColumn("body", F.rtrim("token", F.lit("=")))
        .withColumn("encoding", encoding)
        .withColumn("alphabet", F.element_at(alphabets, F.col("encoding") + 1))
        .withColumn("half", F.element_at(halves, F.col("encoding") + 1))
        .withColumn("m", F.length("alphabet").cast("double"))
        .withColumn("l", F.length("body").cast("double"))
    )
    count = lambda c: (F.length("body") - F.length(F.replace("body", c, F.lit("")))).cast("double")
    rows = rows.withColumn("counts", F.transform(F.split("alphabet", ""), count))
    places = F.transform(F.split("body", ""), lambda c: F.instr("alphabet", c).cast("double"))
    rows = (
        rows.withColumn("squares", F.aggregate("counts", F.lit(0.0), lambda a, x: a + x * x))
        .withColumn("places", places)
        .withColumn("bits", F.expr("translate(body, alphabet, half)"))
    )
    m, n = F.col("m"), F.col("l")
    chi = F.col("squares") * m / n - n
    rows = rows.withColumn("z_chi", (chi - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n))
    ones = F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("double")
    runs = (F.regexp_count("bits", F.lit("0+")) + F.regexp_count("bits", F.lit("1+"))).cast("double")
    rows = rows.withColumn("ones", ones).withColumn("expected", 2 * ones * (n - ones) / n + 1)
    spread = F.sqrt(F.greatest((F.col("expected") - 1) * (F.col("expected") - 2) / (n - 1), F.lit(0.25)))
    rows = rows.withColumn("z_runs", (runs - F.col("expected")) / spread)
    mean = F.aggregate("places", F.lit(0.0), lambda a, x: a + x) / n
    rows = rows.withColumn("mean", mean)
    off = F.transform("places", lambda x: x - F.col("mean"))
    rows = rows.withColumn("off", off)
    neighbours = F.zip_with(
        F.slice("off", 1, F.size("off") - 1), F.slice("off", 2, F.size("off") - 1), lambda a, b: a * b
    )
    variance = F.aggregate("off", F.lit(0.0), lambda a, x: a + x * x)
    serial = F.aggregate(neighbours, F.lit(0.0), lambda a, x: a + x) / F.greatest(variance, F.lit(1e-9))
    rows = rows.withColumn("z_serial", (serial + 1 / n) * F.sqrt(n))
    two_sided = [2 * _upper_tail(F.abs(c)) for c in (F.col("z_runs"), F.col("z_serial"))]
    least = F.least(_upper_tail(F.col("z_chi")), *two_sided)
    coincidence = (F.col("squares") - n) / (n * (n - 1))
    usual = F.greatest(F.lit(TEXT_COINCIDENCE), 2 / m)
    z_text = (usual - coincidence) / F.sqrt(2 * usual * (1 - usual) / (n * (n - 1)) + usual * usual / (4 * n))
    return rows.withColumn("p_random", F.least(F.lit(1.0), 3 * least)).withColumn("p_text", _upper_tail(z_text))


def discoveries(tested: DataFrame) -> DataFrame:
    """Rows of ``tested`` (l, p_random, p_text) that are random and, by their length class, not text.

    Benjamini and Hochberg's rule in each class of lengths (by doubling), on counts of chances in fixed
    steps: at most ``STEPS`` x ``DECADES`` rows a class, whatever the number of tokens. Classes keep the many
    short tokens, which tell little, from spending what the long ones are allowed.
    """
    step = F.least(F.floor(-F.log10("p_text") * STEPS), F.lit(STEPS * DECADES)).cast("int")
    rows = tested.withColumn("length_class", F.floor(F.log2("l")).cast("int"))
    rows = rows.withColumn("step", F.when(F.col("p_text") <= 0, STEPS * DECADES).otherwise(step))
    counted = rows.groupBy("length_class", "step").agg(F.count(F.lit(1)).alias("here"))
    at_least = Window.partitionBy("length_class").orderBy(F.col("step").desc_nulls_last())
    reached = at_least.rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("found", F.sum("here").over(reached)).withColumn(
        "tested", F.sum("here").over(Window.partitionBy("length_class"))
    )
    # All of a step count with its largest chance.
    holds = F.log10(F.col("tested") / F.col("found")) - F.col("step") / STEPS <= log10(FALSE_DISCOVERIES)
    limits = counted.filter(holds).groupBy("length_class").agg(F.min("step").alias("limit"))
    return rows.join(limits, "length_class").filter(
        (F.col("step") >= F.col("limit")) & (F.col("p_random") >= ALPHA)
    )


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (long), base_spans, spans (strings), found, for every row of ``docs``.

    ``base_spans`` and ``spans`` list kind:start:end by start, then kind as in ``KINDS``, comma-joined, in code
    points with the end left out; ``spans`` has the random tokens besides. ``found`` is an array of the same
    with the text of each. Matches of a kind are the leftmost ones that do not overlap, and those too short
    are dropped afterwards. DataFrame functions only.

    Nulls: a null text is an empty one, without spans; a null id stays null. Repeated rows get the same
    spans each. Long texts are scanned whole; places in them are sums over their matches, not over the text.
    An empty table gives no rows. Other columns are not read.
    """
    rows = texts(docs, id_col, text_col).withColumn("at", F.xxhash64("text", F.length("text")))
    long_enough = (
        ((F.col("kind") == "assign") & (F.col("n") >= LEAST_ASSIGNED))
        | ((F.col("kind") == "access") & (F.col("n") >= LEAST_ACCESS))
        | ((F.col("kind") == "hex") & (F.col("n") >= LEAST_HEX))
    )
    found = written(matches(rows), "secret-matches")  # few, and read twice
    columns = ["doc_id", "at", "kind", "start", "stop", "token"]
    base = found.filter(long_enough).select(columns)
    # Stored, or else the plan would work out the tests again wherever their results are compared.
    tested = battery(found.filter(F.col("kind") == "random")).select(*columns, "l", "p_random", "p_text")
    random = discoveries(written(tested, "secret-tokens")).select(columns)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.concat_ws(":", "kind", "start", "stop")
    both = base.unionByName(random).withColumn("span", F.struct("start", order.alias("order"), span.alias("span"), "kind", "stop", "token"))
    number = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    by_doc = (
        both.groupBy("doc_id", "at")
        .agg(*[number(k) for k in KINDS[:3]], F.sort_array(F.collect_list("span")).alias("found"))
        .select(F.col("doc_id").alias("_id"), F.col("at").alias("_at"), *[f"n_{k}" for k in KINDS[:3]], "found")
    )
    joined = rows.select("doc_id", "at").join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at")), "left")
    listed = lambda xs: F.coalesce(F.array_join(F.transform(xs, lambda x: x["span"]), ","), F.lit(""))
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        listed(F.filter("found", lambda x: x["kind"] != "random")).alias("base_spans"),
        listed(F.col("found")).alias("spans"),
        "found",
    )
