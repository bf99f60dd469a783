"""URL filter: rules first, then words of the host name and path scored by naive Bayes.

Host names run words together. A unigram Viterbi search cuts them at the most likely places; the
counts come from the pieces that other host names of the table set apart, and a short list of common
words. A multinomial naive Bayes model over the words of host and path is fitted on all rows, with
labels from a list of telling words, and judges every url that no rule fits. Runs of any length are
cut, and all words and tokens count: they are joined in Spark, not held by the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: A listed word counts at least as often as this in the unigram model, and in the class that it tells.
LISTED_COUNT = 1000
LISTED_EXAMPLES = 20
#: Tokens of the background that are added to either class.
SMOOTHING = 100

# Rules as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# Words that tell an unwanted host.
TELLING = tuple(
    "ads adserver adult bets betting casino cialis clickbait crack escort gambling hentai jackpot keygen lottery malware nude "
    "payday phishing pharma pills poker porn proxy roulette sex slots spam torrent viagra warez webcam xxx".split()
)

# Other words that host names are often made of.
COMMON = tuple(
    "about account app art auto bank best big bike blog blue book books business buy camp car cars cheap city click cloud club code "
    "coffee data day deal deals design digital direct doctor dog eco edu farm fashion film find fit food forum free game games "
    "garden global gold green group guide hair health help home host hotel house info job jobs kids lab land learn life light "
    "link list live loan loans local love mail map market media mobile money music my net new news now online open page park party "
    "photo pizza play plus power press pro radio red school search shop site smart soft solar space sport sports star store "
    "studio style sun super tech team the time top tour toys track trade travel tube video view web wiki win wine wood work world "
    "yoga your zone".split()
)

_PIECE = re.compile(r"[^\W\d_]+|\d+")


def host_of(url: str = "url") -> F.Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str = "url") -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: tuple[tuple[str, str, str], ...] = RULES) -> F.Column:
    """The longest rule that fits ``host`` and ``path``, as ``struct<rule, verdict>``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(f"{host}{path}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Segmenter:
    """Cuts a run of letters into the words that make it most likely.

    ``counts`` are words with their counts. ``total`` is the sum of all counts, where ``counts`` holds
    only some, and ``longest`` the most letters of a word. A listed word counts as often as the mean
    listed word must for all of them to make up half of the total, so that the size of the table does
    not decide whether listed words are found.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int = 0):
        self.counts = counts
        every = sum(counts.values()) if total is None else total
        self.listed = max(LISTED_COUNT, every / len(_LISTED))
        self.total = math.log(every + self.listed * len(_LISTED))
        self.longest = max(longest, *map(len, _LISTED), *map(len, counts)) if counts else max(longest, *map(len, _LISTED))

    def _cost(self, word: str, counts: dict[str, int]) -> float:
        count = counts.get(word, 0) + (self.listed if word in _LISTED else 0)
        # an unknown word is less likely the longer it is
        return self.total - math.log(count) if count else self.total + 2.3 * len(word)

    def cut(self, run: str, counts: dict[str, int] | None = None) -> tuple[str, ...]:
        """The words of a run; ``counts`` stands for the counts of all words that are in it."""
        counts = self.counts if counts is None else counts
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            low = max(0, end - self.longest)
            whole = (self.total + 2.3 * end, 0) if low else (math.inf, 0)
            best.append(min([whole, *((best[k][0] + self._cost(run[k:end], counts), k) for k in range(low, end))]))
        words, at = [], len(run)
        while at:
            words.append(run[best[at][1] : at])
            at = best[at][1]
        return tuple(reversed(words))


_TOLD = frozenset(TELLING)
_LISTED = frozenset((*TELLING, *COMMON))


def _made_of_listed(run: str) -> bool:
    """Whether a run that is not listed itself is listed words set together."""
    reached = {0}
    for end in range(1, len(run) + 1):
        if any(run[k:end] in _LISTED for k in range(max(0, end - _LONGEST), end) if k in reached):
            reached.add(end)
    return run not in _LISTED and len(run) in reached


_LONGEST = max(map(len, _LISTED))


def vocabulary_of(urls: DataFrame) -> DataFrame:
    """``word, n``: delimited pieces of host names, with the number of other names that have each.

    A name is a label with all that follows it in the host: ``a.shop.com`` and ``b.shop.com`` have
    ``shop`` in one name, ``shop.com``. No run is a word by its own name alone, however many hosts are
    below that, nor is one that listed words make up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not _made_of_listed(w) for w in batch.column("word").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    labels = urls.select("host").distinct().select(F.split(F.lower("host"), r"\.").alias("labels")).select("labels", F.posexplode("labels").alias("at", "label"))
    names = labels.select("label", F.array_join(F.slice("labels", F.col("at") + 1, F.size("labels")), ".").alias("name")).distinct()
    pieces = names.select("name", F.explode(F.array_distinct(F.split("label", r"[^\p{L}]+"))).alias("word")).where("word <> ''").distinct()
    return pieces.groupBy("word").agg((F.count("*") - 1).alias("n")).where("n > 0").mapInArrow(run, "word string, n bigint")


def _pieces(pairs: DataFrame) -> DataFrame:
    """``pair, n, at, side, piece``: runs of letters in host and path; a number is one piece whatever its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, texts in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                found = [(side, "#" if p.isdigit() else p) for side, text in zip("hp", texts, strict=True) for p in _PIECE.findall(text.lower())]
                rows += [(row, at, side, piece) for at, (side, piece) in enumerate(found)]
            take = pa.array([r for r, *_ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pair").take(take), batch.column("n").take(take), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()),
                ],
                ["pair", "n", "at", "side", "piece"],
            )

    return pairs.mapInArrow(run, "pair bigint, n bigint, at int, side string, piece string")


def cut_runs(runs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``piece, words``: each run cut with the whole vocabulary, whose words in the run are found by a join."""
    size = vocabulary.agg(F.sum("n").alias("total"), F.max(F.char_length("word")).alias("longest")).first()
    segmenter = Segmenter({}, size["total"] or 0, size["longest"] or 0)
    most = size["longest"] or 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in zip(batch.column("run").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                inside = list({run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + most) + 1)})
                for low in range(0, len(inside), 10_000):
                    some = inside[low : low + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(some), pa.int64()), pa.array(some, pa.string())], ["run", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("piece").to_pylist()
            known = [{w["word"]: w["n"] for w in words or ()} for words in batch.column("known").to_pylist()]
            words = [["#"] if run == "#" else segmenter.cut(run, counts) for run, counts in zip(runs, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(words, pa.list_(pa.string()))], ["piece", "words"])

    inside = runs.mapInArrow(parts, "run bigint, word string").join(broadcast_if_small(vocabulary), "word")
    known = inside.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return runs.join(known, "run", "left").select("piece", "known").mapInArrow(cut, "piece string, words array<string>")


def token_odds(tokens: DataFrame, rows: tuple[int, int]) -> tuple[DataFrame, float]:
    """``side, word, odds`` of all tokens (``side, word, block, allow``), and the log odds of any row."""
    listed = (F.col("side") == "h") & F.col("word").isin(*TELLING)
    sums = tokens.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n"), F.count_if(listed).alias("listed")).first()
    block, allow = sums["block"] or 0, sums["allow"] or 0
    whole = block + allow + sums["n"] + len(_TOLD) - sums["listed"]
    told = F.when(listed, LISTED_EXAMPLES).otherwise(0)
    # smoothed towards the token's share of all rows, so that everyday words tell nothing
    share = SMOOTHING * (F.col("block") + F.col("allow") + 1) / whole
    odds = F.log((F.col("block") + told + share) / (block + told + SMOOTHING)) - F.log((F.col("allow") + share) / (allow + SMOOTHING))
    return tokens.select("side", "word", odds.alias("odds")), math.log((rows[0] + 1) / (rows[1] + 1))


def scored_pairs(urls: DataFrame) -> DataFrame:
    """``host, path, score`` of the different hosts with paths: the log odds of ``block`` over all their words.

    A url without words is allowed. Counts are over all rows, and no token is left out.
    """
    counted = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    pairs = written(counted.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    pieces = written(_pieces(pairs), "pieces")
    runs = written(pieces.select("piece").distinct().withColumn("run", F.monotonically_increasing_id()), "runs")
    cuts = written(cut_runs(runs, written(vocabulary_of(pairs), "vocabulary")), "cuts")
    telling = cuts.where(F.arrays_overlap("words", F.array(*map(F.lit, TELLING)))).select("piece")
    told = pieces.where("side = 'h'").join(broadcast_if_small(telling), "piece").select("pair").distinct().withColumn("told", F.lit(True))
    by_pair = pairs.select("pair", "n").join(told, "pair", "left")
    block = F.coalesce(F.sum(F.when(F.col("told"), F.col("n"))), F.lit(0)).alias("block")
    allow = F.coalesce(F.sum(F.when(F.col("told").isNull(), F.col("n"))), F.lit(0)).alias("allow")
    rows = by_pair.agg(block, allow).first()
    kinds = written(pieces.join(told, "pair", "left").groupBy("side", "piece").agg(block, allow), "kinds")
    words = kinds.join(broadcast_if_small(cuts), "piece").select("side", "piece", "block", "allow", F.posexplode("words").alias("at", "word"))
    tokens = written(words.groupBy("side", "word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "tokens")
    odds, prior = token_odds(tokens, (rows["block"], rows["allow"]))
    # sums in the order of the words, so that they are the same in every run
    worth = words.join(broadcast_if_small(odds), ["side", "word"]).groupBy("side", "piece").agg(_summed("at", "odds").alias("worth"))
    worth = written(worth, "worth")
    of_pair = pieces.join(broadcast_if_small(worth), ["side", "piece"]).groupBy("pair").agg((F.lit(prior) + _summed("at", "worth")).alias("score"))
    return pairs.join(of_pair, "pair", "left").select("host", "path", F.coalesce("score", F.lit(-math.inf)).alias("score"))


def _summed(at: str, value: str) -> F.Column:
    return F.aggregate(F.sort_array(F.collect_list(F.struct(at, value))), F.lit(0.0), lambda x, y: x + y[value])


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages`` (``page_id, url``).

    The longest fitting rule decides; without one, the model blocks where its log odds are over 0. A
    null url, or one without ``://``, has empty host and path, fits no rule and is allowed. Repeated
    rows are kept and count in the fit as often as they occur. Other columns are not read.
    """
    urls = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    scored = urls.join(scored_pairs(urls), ["host", "path"])
    told = scored.withColumn("told", rule_for(rules))
    method = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return told.select(
        "page_id", "host", "path", F.col("told.rule").alias("rule"), F.coalesce("told.verdict", method).alias("verdict"), "score"
    )
