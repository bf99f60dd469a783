"""Views over the given tables that have the shapes the operators work on."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.fixed import FENCE, SQL_FENCE
from shiftlens.functions.text import token_count
from shiftlens.operators.chunking import chunk_union
from shiftlens.operators.embedding import embed_hashed
from shiftlens.operators.relationships import Relationship, TableInfo
from shiftlens.plans.scratch import fresh_path, named_path
from shiftlens.plans.sizing import spread_small_scan
from shiftlens.sources.snapshots import current_path, publish, read_snapshot
from shiftlens.sources.store import STORE_SCHEMA, refresh_store
from shiftlens.sources.tables import load_table

# The identity that the registered queries act for.
USER, PLANT = "U3", "P3"
STORE_TIME = dt.datetime(2025, 6, 1)
LOG_START = dt.datetime(2025, 5, 1)

# Tables that are turned into chunks, with the key that orders their rows.
CHUNKED = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"]}

# Names are declared in different letter cases on purpose: look-ups ignore case.
METADATA = {
    "shift_fact": TableInfo(
        "Shift-level performance data",
        ("PUID", "ShiftStartTime", "ShiftEndTime"),
        (Relationship("MACHINE_ACCESS", (("PUID", "PUID"),)),),
    ),
    "machine_access": TableInfo(
        "User-level machine and plant access",
        ("PUID", "user_code", "Plantcode", "groupcode"),
        (Relationship("shift_fact", (("PUID", "PUID"),)),),
    ),
    "CUSTOMER": TableInfo(
        "Customers",
        ("c_custkey",),
        (
            Relationship("nation", (("c_nationkey", "n_nationkey"),)),
            Relationship("supplier", (("c_nationkey", "s_nationkey"),)),
        ),
    ),
    "supplier": TableInfo(
        "Suppliers", ("s_suppkey",), (Relationship("lineitem", (("s_suppkey", "l_suppkey"),)),)
    ),
    "part": TableInfo("Parts", ("p_partkey",), (Relationship("lineitem", (("p_partkey", "l_partkey"),)),)),
}


def shift_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Shifts of machines, from lineitem."""
    start = F.col("l_shipdate")
    return load_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("PUID"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ID"),
        F.col("l_linenumber").alias("SHIFT_ID"),
        start.alias("ShiftStartTime"),
        (start + F.expr("interval 8 hours")).alias("ShiftEndTime"),
        (1 - F.col("l_discount")).alias("availability"),
        (F.col("l_quantity") / 50).alias("performance"),
        (1 - F.col("l_tax")).alias("quality"),
        F.col("l_quantity").alias("total_count"),
    )


def machine_access(spark: SparkSession, folder: str) -> DataFrame:
    """Who may see which machine, from supplier and nation."""
    supplier = load_table(spark, folder, "supplier")
    nation = load_table(spark, folder, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("PUID"),
        F.concat(F.lit("U"), F.col("s_suppkey") % 10).alias("user_code"),
        F.concat(F.lit("P"), F.col("s_suppkey") % 4).alias("Plantcode"),
        F.concat(F.lit("G"), F.col("n_regionkey")).alias("groupcode"),
    )


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with their answers: user turns directly followed by an assistant turn.

    Joined on (conv_id, turn), which is unique, so a very long conversation is no hot key.
    """
    talk = load_table(spark, folder, "conversations")
    asked = talk.where(F.col("role") == "user")
    answered = talk.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text")
    )
    key = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    minutes = F.col("conv_id") * 37 + F.col("turn")
    created = F.lit(LOG_START).cast("timestamp_ntz") + F.make_dt_interval(
        F.floor(minutes / 1440).cast("int"), F.lit(0), (minutes % 1440).cast("int")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat(F.lit("q-"), key).alias("query_id"),
        F.concat(F.lit("r-"), key).alias("response_id"),
        F.col("text").alias("query_text"),
        "response_text",
        F.concat(F.lit("U"), F.col("conv_id") % 10).alias("user_code"),
        F.concat(F.lit("P"), F.col("conv_id") % 4).alias("plant_code"),
        created.alias("created_at"),
        "conv_id",
    )


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each answer and question, the input of the token log."""
    return query_log(spark, folder).select(
        "created_at",
        token_count(F.col("response_text")).alias("nlp_tokens"),
        token_count(F.col("query_text")).alias("table_tokens"),
        F.lit(0).alias("viz_tokens"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Responses with a closed fence, an open fence or none, their result rows and the store's state."""
    log = query_log(spark, folder)
    sql = F.concat(F.lit("SELECT count(*) FROM shift_fact WHERE SHIFT_ID = "), F.col("conv_id") % 7)
    kind = F.col("conv_id") % 3
    closed = F.concat("response_text", F.lit(f"\n{SQL_FENCE}\n\t"), sql, F.lit(f" \n{FENCE}\nDone."))
    opened = F.concat("response_text", F.lit(f" {SQL_FENCE} "), sql, F.lit("\n"))
    return log.select(
        "query_id",
        F.when(kind == 0, closed).when(kind == 1, opened).otherwise(F.col("response_text")).alias("response"),
        (F.col("conv_id") % 2).alias("n_rows"),
        (F.col("conv_id") % 11 != 0).alias("store_ready"),
        "response_text",
    )


def vector_store(spark: SparkSession, folder: str) -> DataFrame:
    """The given vectors as a store; their label stands for the table."""
    label = F.col("label").cast("string")
    return load_table(spark, folder, "embeddings").select(
        F.concat_ws("_", label, F.col("vec_id")).alias("record_id"),
        label.alias("table_name"),
        F.col("vec_id").alias("chunk_id"),
        "embedding",
    )


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every given vector as a query."""
    return load_table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark texts as queries."""
    texts = load_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embed_hashed(texts, "text").select("query_id", "embedding")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, over all cores."""
    return spread_small_scan(load_table(spark, folder, "documents"), "doc_id")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each whole document as a chunk of its source."""
    return load_table(spark, folder, "documents").select(
        F.col("source").alias("table_name"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text")
    )


def document_store(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with their vectors."""
    return embed_hashed(spread_small_scan(document_chunks(spark, folder), "chunk_id"))


def chunked_tables(spark: SparkSession, folder: str) -> dict:
    """The chunked tables with their row order."""
    return {name: (load_table(spark, folder, name), keys) for name, keys in CHUNKED.items()}


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the chunked tables."""
    return chunk_union(chunked_tables(spark, folder))


def build_store(spark: SparkSession, folder: str) -> str:
    """Chunk, embed and store the chunked tables; returns the store's path."""
    path = fresh_path(spark, "store")
    refresh_store(chunks(spark, folder), path, embed_hashed, STORE_TIME)
    return path


def chunk_store(spark: SparkSession, folder: str) -> DataFrame:
    """The stored chunks of the chunked tables.

    Built where this application's scratch folder has no store for these very files yet, and marked when it
    is whole; after :func:`drop_scratch`, or for changed files, it is built again.
    """
    files = sorted(f for name in CHUNKED for f in load_table(spark, folder, name).inputFiles())
    facts = []
    for file in files:
        where = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        facts.append((file, status.getLen(), status.getModificationTime()))
    root = named_path(spark, f"chunk-store-{hashlib.sha256(repr(facts).encode()).hexdigest()[:24]}")
    if current_path(spark, root) is None:
        publish(spark, root, lambda path: refresh_store(chunks(spark, folder), path, embed_hashed, STORE_TIME))
    return read_snapshot(spark, root, STORE_SCHEMA)
