"""Secret scan, in SQL functions only: known forms first, then a battery of randomness tests.

Three known forms are found by pattern. Other runs of key-like characters are tested: by the alphabet of
the encoding that a run seems to have, are its characters as even as chance has it (chi-squared, as
the number of equal pairs), do they change sides of the alphabet as often (runs test), and is there no
correlation from one to the next? A run that passes is reported only if plain language would so
rarely be that even, given its length, that false discoveries stay rare among all runs of the table
(Benjamini-Hochberg over a histogram of p-values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written

# The known forms, as kind, pattern, group whose length counts, and its least length.
KNOWN = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: What a text must hold for a known form to be in it; only such texts are searched closely.
_HINTS = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    r"AKIA[A-Z0-9]{14}",
    r"[0-9a-f]{16}",
)
#: Runs that are tested: characters of the usual encodings, at least this many.
CANDIDATE = r"[A-Za-z0-9+/_=-]+"
CANDIDATE_LENGTH = 20
# Encodings by alphabet, narrowest first.
_ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: How often two letters of plain language are equal.
LANGUAGE_MATCH = 0.065
#: How often the kind of sign (capital, small letter, digit) changes in names made of words.
LANGUAGE_TURNS = 0.1
_OPEN, _CLOSE, _PLAIN = "\x01", "\x02", "\x03"
_STEPS = 400


def _normal(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation that keeps the tails' order."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z)))


def matches(texts: DataFrame, pattern: str) -> DataFrame:
    """``key, start, end, match``: the leftmost matches of a pattern that do not overlap.

    Places count code points. Matches are bracketed by signs that the text has been freed of, the
    text is cut there, and the lengths of the pieces are summed up to places.
    """
    pieces = F.split(F.regexp_replace("text", pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)
    rows = texts.select("key", F.posexplode(pieces).alias("n", "piece")).select(
        "key", "n", F.when(F.col("n") > 0, F.substring_index("piece", _CLOSE, 1)).alias("match"),
        (F.char_length("piece") - F.when(F.col("n") > 0, 1).otherwise(0)).alias("size"),
    )
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.sum("size").over(before)).where("match is not null")
    return placed.select("key", "start", (F.col("start") + F.char_length("match")).alias("end"), "match")


def _prepared(docs: DataFrame) -> DataFrame:
    """``key, text`` of the different texts that may hold a secret."""
    signs = f"[{_OPEN}{_CLOSE}]"
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.when(text.rlike(signs), F.regexp_replace(text, signs, _PLAIN)).otherwise(text)
    hint = text.rlike(f"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH}}}")
    for one in _HINTS:
        hint = hint | text.rlike(one)
    return docs.where(hint).select("key", clean.alias("text"))


def known_spans(texts: DataFrame) -> DataFrame:
    """``key, rank, kind, start, end`` of the known forms in ``texts`` (``key, text``)."""
    out = None
    for rank, ((kind, pattern, group, least), hint) in enumerate(zip(KNOWN, _HINTS, strict=True)):
        found = matches(texts.where(F.col("text").rlike(hint)), pattern)
        counted = F.regexp_extract("match", pattern, group) if group else F.col("match")
        found = found.where(F.char_length(counted) >= least).select("key", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "start", "end")
        out = found if out is None else out.unionByName(found)
    return out


def battery(runs: DataFrame) -> DataFrame:
    """``runs`` (with ``match``) and the test results: ``encoding, p_even, p_runs, p_serial, p_language``.

    The first three are the chances of a more uneven, more or less often changing, more correlated
    string among random ones of that encoding and length; the last is the chance that plain language
    of that length is so even and goes so often between capitals, small letters and digits (Fisher's
    combination of the two).
    """
    bare = F.regexp_replace(F.translate("match", "-_", "+/"), "=+$", "")
    runs = runs.withColumn("bare", bare)
    encoding, symbols = F.lit(_ENCODINGS[-1][0]), F.lit(_ENCODINGS[-1][1])
    for name, alphabet in reversed(_ENCODINGS[:-1]):
        fits = F.col("bare").rlike(f"^[{alphabet}]*$")
        if name == "hex":
            fits = fits | F.col("bare").rlike("^[0-9A-F]*$")
        encoding, symbols = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(alphabet)).otherwise(symbols)
    runs = runs.withColumn("encoding", encoding).withColumn("symbols", symbols)
    folded = F.when(F.col("encoding") == "hex", F.lower("bare")).otherwise(F.col("bare"))
    signs = F.filter(F.split(folded, ""), lambda c: c != "")
    runs = runs.withColumn("codes", F.transform(signs, lambda c: F.instr(F.col("symbols"), c).cast("double") - 1))
    runs = runs.withColumn("n", F.size("codes").cast("double")).withColumn("k", F.char_length("symbols").cast("double"))
    # equal pairs: the sum of c (c - 1) / 2 over the symbols, by runs of the sorted codes
    ordered = F.array_sort("codes")
    nothing = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("same"), F.lit(0.0).alias("pairs"))
    pairs = F.aggregate(
        ordered,
        nothing,
        lambda a, c: F.struct(
            c.alias("last"),
            F.when(c == a["last"], a["same"] + 1).otherwise(F.lit(0.0)).alias("same"),
            (a["pairs"] + F.when(c == a["last"], a["same"] + 1).otherwise(F.lit(0.0))).alias("pairs"),
        ),
        lambda a: a["pairs"],
    )
    # one pass in order: sides of the middle, changes of side, sums for the correlation
    start = F.struct(*[F.lit(x).alias(c) for c, x in (("last", -1.0), ("high", 0.0), ("changes", 0.0), ("s", 0.0), ("ss", 0.0), ("sx", 0.0))])
    side = lambda c: (c >= F.col("k") / 2).cast("double")
    totals = F.aggregate(
        "codes",
        start,
        lambda a, c: F.struct(
            c.alias("last"),
            (a["high"] + side(c)).alias("high"),
            (a["changes"] + F.when((a["last"] >= 0) & (side(a["last"]) != side(c)), 1.0).otherwise(0.0)).alias("changes"),
            (a["s"] + c).alias("s"),
            (a["ss"] + c * c).alias("ss"),
            (a["sx"] + F.when(a["last"] >= 0, a["last"] * c).otherwise(0.0)).alias("sx"),
        ),
    )
    runs = runs.withColumn("pairs", pairs).withColumn("t", totals)
    n, k, every = F.col("n"), F.col("k"), F.col("n") * (F.col("n") - 1) / 2
    even = (F.col("pairs") - every / k) / F.sqrt(F.greatest(every / k * (1 - 1 / k), F.lit(1e-9)))
    high, low = F.col("t.high"), F.col("n") - F.col("t.high")
    mean = 2 * high * low / F.greatest(n, F.lit(1.0)) + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
    change = F.when((high > 0) & (low > 0), (F.col("t.changes") + 1 - mean) / spread).otherwise(F.lit(-12.0))
    m = F.col("t.s") / F.greatest(n, F.lit(1.0))
    variance = F.col("t.ss") - n * m * m
    follow = F.when(variance > 1e-9, (F.col("t.sx") - n * m * m) / F.greatest(variance, F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(12.0))
    plain = (F.col("pairs") - every * LANGUAGE_MATCH) / F.sqrt(F.greatest(every * LANGUAGE_MATCH * (1 - LANGUAGE_MATCH) * _clumping(n), F.lit(1e-9)))
    turns = F.regexp_count("bare", F.lit("[A-Z]+|[a-z]+|[0-9]+|[+/]+")) - 1
    turn = (turns - n * LANGUAGE_TURNS) / F.sqrt(F.greatest(n * LANGUAGE_TURNS * (1 - LANGUAGE_TURNS), F.lit(1e-9)))
    both = F.greatest(_normal(plain) * (1 - _normal(turn)), F.lit(1e-40))
    return runs.select(
        *[c for c in runs.columns if c not in ("bare", "symbols", "codes", "n", "k", "pairs", "t")],
        (1 - _normal(even)).alias("p_even"),
        (2 * (1 - _normal(F.abs(change)))).alias("p_runs"),
        (2 * (1 - _normal(F.abs(follow)))).alias("p_serial"),
        (both * (1 - F.log(both))).alias("p_language"),
    )


def _clumping(n: Column) -> Column:
    """Letters of language are uneven, so its equal pairs come together and vary more, the more so in longer runs."""
    return 1 + n * F.lit(0.05)


def _limit(tested: DataFrame, rate: float) -> float:
    """The largest p-value that keeps false discoveries under ``rate`` among all tested runs.

    P-values are counted by steps of their logarithm, so ``_STEPS + 1`` rows are looked at, however many runs
    there are; a step counts with its largest value.
    """
    step = F.least(F.lit(_STEPS), F.floor(-F.log10(F.greatest("p_language", F.lit(1e-40))) * 10)).cast("int")
    counts = {r["step"]: r["n"] for r in tested.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    total, below, limit = sum(counts.values()), 0, 0.0
    for at in range(_STEPS, -1, -1):
        below += counts.get(at, 0)
        largest = 10 ** (-at / 10)
        if below and largest <= rate * below / total:
            limit = largest
    return limit


def random_spans(texts: DataFrame, rate: float = 0.01, reject: float = 0.001) -> DataFrame:
    """``key, rank, kind, start, end``: runs that look random and unlike language; kind ``random``.

    The three randomness tests share ``reject`` as their chance to turn a random run down.
    """
    runs = matches(texts.where(F.col("text").rlike(f"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH}}}")), CANDIDATE)
    tested = written(battery(runs.where(F.char_length("match") >= CANDIDATE_LENGTH)), "battery")
    limit = _limit(tested, rate)
    passed = F.least("p_even", "p_runs", "p_serial") * 3 >= reject
    kept = tested.where(passed & (F.col("p_language") <= limit) & (F.col("encoding") != "decimal"))
    return kept.select("key", F.lit(len(KNOWN)).alias("rank"), F.lit("random").alias("kind"), "start", "end")


def _found(docs: DataFrame, rate: float) -> DataFrame:
    """Every row of ``docs`` with ``__found``."""
    docs = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    different = docs.select(F.col("__key").alias("key"), "text")
    texts = written(_prepared(different).dropDuplicates(["key"]), "suspects")
    spans = written(known_spans(texts), "known").unionByName(random_spans(texts, rate))
    entry = F.struct(F.col("start"), F.col("rank"), F.col("kind"), F.col("end"))
    every = spans.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("every"))
    known = F.filter("every", lambda s: s["kind"] != "random")
    free = F.filter("every", lambda s: (s["kind"] != "random") | ~F.exists("known", lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])))
    found = written(every.withColumn("known", known).select(F.col("key").alias("__key"), free.alias("__found")), "found")
    nothing = F.array().cast(found.schema["__found"].dataType)
    return docs.join(found, "__key", "left").withColumn("__found", F.coalesce("__found", nothing)).drop("__key")


def secret_spans(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Every row of ``docs`` with ``found``: its secrets as an array of ``(start, rank, kind, end)`` in order.

    ``docs`` has ``doc_id`` and ``text``. Known forms are always reported; a random-looking run is when it does not
    overlap one. Places are code points, ends exclusive. A null text is empty. Repeated rows are kept
    and count once in the false-discovery control. A column called ``found`` is replaced.
    """
    return _found(docs.drop("found"), rate).withColumnRenamed("__found", "found")


def scan_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``; see ``secret_spans``."""
    scanned = secret_spans(docs.select("doc_id", "text"), rate)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in KNOWN]
    return scanned.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[secret]", rate: float = 0.01) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans become one. A null text stays."""
    scanned = _found(docs, rate)
    nothing = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("end"))
    rebuilt = F.aggregate(
        "__found",
        nothing,
        lambda a, s: F.struct(
            F.when(s["start"] < a["end"], a["text"])
            .otherwise(F.concat(a["text"], F.substring("text", a["end"].cast("int") + 1, (s["start"] - a["end"]).cast("int")), F.lit(mask)))
            .alias("text"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: F.concat(a["text"], F.substring("text", a["end"].cast("int") + 1, F.lit((1 << 31) - 1))),
    )
    text = F.when(F.size("__found") > 0, rebuilt).otherwise(F.col("text"))
    return scanned.withColumn("text", text).select(*docs.columns)
