"""Benchmark decontamination by winnowing, in SQL functions only.

Every window of ``window`` words keeps the smallest hash of its ``k``-word grams; neighbours that keep the
same gram count once. Two equal windows keep the same hash, so a document that shares a window with a
benchmark item shares a fingerprint: joining fingerprints, which are rows of a few numbers without any
words, finds every candidate. The texts of documents with candidates are then read again, hits are
extended to the windows around them and compared word by word. Items shorter than a window are
looked up whole, by their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

#: Signs that part words: all ASCII but digits and lower-case letters.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_in(text: str) -> Column:
    """The words of a text, A-Z folded; none for a null."""
    known = F.coalesce(F.col(text), F.lit(""))
    folded = F.when(known.rlike(r"[^\x00-\x7F]"), F.translate(known, _UPPER, _LOWER)).otherwise(F.lower(known))
    return F.array_remove(F.split(folded, APART), "")


def _with_grams(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``g``, the hash of the ``k`` words from each word on; those at the end have fewer."""
    return rows.withColumn("g", F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + m) for m in range(1, k)])))


def _fingerprint(at: Column, window: int, k: int) -> Column:
    """The smallest gram hash of the window that begins at word ``at``."""
    grams = [F.get("g", at + j) for j in range(window - k + 1)]
    return F.least(*grams) if len(grams) > 1 else grams[0]


def _selects(at: Column, window: int, k: int) -> Column:
    """Whether the window at ``at`` keeps another gram than the window before it does.

    It keeps the same one if that one is in both windows: the gram that left is larger than the
    smallest shared one, the gram that came is not smaller.
    """
    if window - k < 1:
        return F.lit(True)
    shared = [F.get("g", at + j) for j in range(window - k)]
    least = F.least(*shared) if len(shared) > 1 else shared[0]
    return (at == 0) | (F.get("g", at - 1) <= least) | (F.get("g", at + window - k) < least)


def _whole(at: Column, length: int) -> Column:
    """A hash of ``length`` words from word ``at``, apart from the fingerprints of other lengths."""
    return F.xxhash64(F.lit(length), *[F.get("words", at + m) for m in range(length)])


def _run(at: Column, length: Column | int) -> Column:
    """The words themselves, joined by a sign that no word holds."""
    return F.array_join(F.slice("words", at + 1, F.lit(length) if isinstance(length, int) else length), " ")


def benchmark_windows(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``item_id, length, mark, run``: every window of every item, with its fingerprint."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_in("text").alias("words"))
    items = _with_grams(items, k).withColumn("n", F.size("words")).where("n > 0")
    at = F.col("at")
    long = items.where(F.col("n") >= window).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - window)))
    out = long.select("item_id", F.lit(window).alias("length"), _fingerprint(at, window, k).alias("mark"), _run(at, window).alias("run"))
    short = items.where(F.col("n") < window).withColumn("at", F.lit(0))
    mark = F.coalesce(*[F.when(F.col("n") == n, _whole(at, n)) for n in range(1, window)])
    return out.unionByName(short.select("item_id", F.col("n").alias("length"), mark.alias("mark"), _run(at, F.col("n")).alias("run")))


def _candidates(docs: DataFrame, marks: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """``doc_id, key, n_words, at, length``: places whose fingerprint a benchmark window has.

    Besides, one row per document with length -1 carries its number of words. Only numbers and the id
    go through the join; that row's mark is the document's key, so a shuffle spreads these rows.
    """
    words = _with_grams(docs.withColumn("words", words_in("text")).drop("text"), k).withColumn("n_words", F.size("words"))
    at = F.col("at")
    each = words.withColumn("at", F.explode(F.sequence(F.lit(-1), F.col("n_words") - F.lit(min([window, *lengths])))))
    kept = (at >= 0) & (at + window <= F.col("n_words")) & _selects(at, window, k)
    mark = F.when(at == -1, F.col("key")).when(kept, _fingerprint(at, window, k))
    length = F.when(at == -1, F.lit(-1)).otherwise(F.lit(window))
    if lengths:
        probes = [F.struct(mark.alias("mark"), length.alias("length"))]
        probes += [F.struct(F.when((at >= 0) & (at + n <= F.col("n_words")), _whole(at, n)).alias("mark"), F.lit(n).alias("length")) for n in lengths]
        marked = each.withColumn("probe", F.explode(F.array(*probes))).select("doc_id", "key", "n_words", "at", "probe.mark", "probe.length")
    else:
        marked = each.select("doc_id", "key", "n_words", "at", mark.alias("mark"), length.alias("length"))
    found = marked.where("mark is not null").join(marks.withColumn("found", F.lit(True)), ["mark", "length"], "left")
    return found.where("found or length = -1").drop("mark", "found")


def _windows_at(docs: DataFrame, places: DataFrame, window: int, k: int) -> DataFrame:
    """``key, at, length, run``: the words of the windows that may hold the fingerprints at ``places``."""
    spots = places.groupBy("key").agg(F.collect_set(F.struct("at", "length")).alias("spots"))  # places of one document
    read = docs.join(broadcast_if_small(written(spots, "spots")), "key").select("key", words_in("text").alias("words"), "spots")
    last = F.when(F.col("spot.length") == window, F.least(F.col("spot.at") + (window - k), F.size("words") - window)).otherwise(F.col("spot.at"))
    each = read.select("key", "words", F.explode("spots").alias("spot"))
    each = each.select("key", "words", F.explode(F.sequence("spot.at", last)).alias("at"), F.col("spot.length").alias("length"))
    return each.select("key", "at", "length", _run(F.col("at"), F.col("length")).alias("run"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``. A word is hit when it lies in a run
    of ``window`` words that an item has too, or in a run equal to a whole shorter item. Null, empty and
    wordless texts have no words and are clean; such items have no windows. A null ``item_id`` taints but
    is not listed; rows that repeat an ``item_id`` are one item with the windows of all. Repeated rows of
    ``docs`` are kept, each with its own result. Other columns are not read.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    windows = written(benchmark_windows(benchmark, window, k), "windows")
    lengths = sorted(r["length"] for r in windows.where(F.col("length") < window).select("length").distinct().collect())  # window - 1 at most
    marks = broadcast_if_small(windows.select("mark", "length").distinct())
    seen = written(_candidates(rows, marks, lengths, window, k), "windows")
    every = seen.where("length = -1").select("doc_id", "key", "n_words")
    runs = windows.groupBy("run", "length").agg(F.collect_set("item_id").alias("items"))
    around = _windows_at(rows.select("key", "text"), seen.where("length > 0").select("key", "at", "length"), window, k)
    hits = around.join(broadcast_if_small(runs), ["run", "length"])
    hits = written(hits.select("key", "at", "length", "items"), "hits")
    spans = hits.select("key", "at", "length").distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "length"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(s["at"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["at"] + s["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    items = hits.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    result = every.join(spans.select("key", covered.alias("n_hit")), "key", "left").join(items, "key", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return result.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
