"""Row-level access, hidden columns, and SQL over governed views only."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.fixed import CONFIDENTIAL
from shiftlens.functions.text import stripped
from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

_log = logging.getLogger(__name__)
_VIEWS = "shiftlens.governed.views"
#: Leaves of a plan that read no data: constants, numbers, the result of a WITH clause (which is looked at itself).
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "EmptyRelation"}

#: What a governed query may call: aggregates, windows, numbers, text, times, conditions, arrays, maps and JSON. Nothing that
#: reaches the host, the session or a file.
ALLOWED_FUNCTIONS = frozenset(
    """
    any any_value approx_count_distinct approx_percentile array_agg avg bit_and bit_or bit_xor bool_and bool_or collect_list collect_set corr
    count count_if covar_pop covar_samp every first first_value kurtosis last last_value max max_by mean median min min_by mode percentile
    percentile_approx regr_count regr_intercept regr_r2 regr_slope skewness some std stddev stddev_pop stddev_samp sum try_avg try_sum
    var_pop var_samp variance grouping grouping_id
    cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
    abs acos asin atan atan2 bround cbrt ceil ceiling cos cot degrees div e exp floor greatest least ln log log10 log2 mod negative
    pi pmod positive pow power radians round sign signum sin sqrt tan try_add try_divide try_mod try_multiply try_subtract width_bucket
    ascii base64 btrim char char_length character_length chr concat concat_ws contains crc32 decode encode endswith find_in_set
    format_number format_string hash hex initcap instr lcase left length levenshtein locate lower lpad ltrim md5 mask octet_length overlay
    position printf regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rpad rtrim
    sha sha1 sha2 soundex space split split_part startswith substr substring substring_index to_char to_number translate trim ucase
    unbase64 unhex upper xxhash64
    add_months date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc dateadd datediff day dayname dayofmonth
    dayofweek dayofyear extract from_unixtime hour last_day make_date make_dt_interval make_interval make_timestamp make_ym_interval minute
    current_date current_timestamp now month monthname months_between next_day quarter second timestamp timestamp_micros timestamp_millis timestamp_seconds to_date
    to_timestamp to_unix_timestamp trunc try_to_timestamp unix_date unix_timestamp weekday weekofyear window year
    case coalesce if ifnull isnan isnotnull isnull nullif nullifzero nvl nvl2 when zeroifnull
    bigint binary boolean cast decimal double float int smallint string tinyint try_cast
    aggregate array array_append array_compact array_contains array_distinct array_except array_insert array_intersect array_join array_max
    array_min array_position array_prepend array_remove array_repeat array_size array_sort array_union arrays_overlap arrays_zip
    cardinality element_at exists explode explode_outer filter flatten forall from_json get get_json_object inline inline_outer
    json_array_length json_object_keys map map_concat map_contains_key map_entries map_filter map_from_arrays map_from_entries map_keys
    map_values map_zip_with named_struct posexplode posexplode_outer range reduce schema_of_json sequence shuffle size slice sort_array stack
    struct to_json transform transform_keys transform_values try_element_at zip_with
    and or not in like rlike ilike between
    """.split()
)


def identity_given(user: str | None, plant: str | None) -> Column:
    """False when the user or plant code is missing or blank.

    A constant, so Catalyst turns a denied read into an empty relation and scans nothing.
    """
    def given(code: str | None) -> Column:
        return F.coalesce(stripped(F.lit(code).cast("string")) != "", F.lit(False))

    return given(user) & given(plant)


def access_guard(df: DataFrame, user: str | None, plant: str | None) -> DataFrame:
    """All of ``df`` for an identified caller, nothing otherwise."""
    return df.where(identity_given(user, plant))


def machines_of(access: DataFrame, user: str | None, plant: str | None) -> DataFrame:
    """Machines linked to one user and plant."""
    mine = (F.col("user_code") == F.lit(user)) & (F.col("Plantcode") == F.lit(plant))
    return access.where(mine & identity_given(user, plant)).select("PUID").distinct()


def accessible_rows(fact: DataFrame, access: DataFrame, user: str | None, plant: str | None) -> DataFrame:
    """Fact rows of the machines linked to the user and plant.

    A semi join: several access rows for one machine do not repeat fact rows. The machines of one
    user are counted before they are broadcast; a longer list is joined by shuffle.
    """
    return access_guard(fact, user, plant).join(
        broadcast_if_small(machines_of(access, user, plant)), "PUID", "left_semi"
    )


def mask_columns(df: DataFrame, hidden: tuple[str, ...] = CONFIDENTIAL) -> DataFrame:
    """Drop the confidential columns, whatever their letter case."""
    names = {h.lower() for h in hidden}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def governed(fact: DataFrame, access: DataFrame, user: str | None, plant: str | None) -> DataFrame:
    """What a caller may see of a fact table: their machines' rows without the hidden columns."""
    return mask_columns(accessible_rows(fact, access, user, plant))


def locked_session(
    spark: SparkSession, views: Callable[[SparkSession], Mapping[str, DataFrame]]
) -> SparkSession:
    """A session that knows only the given views and refuses to read files by path.

    Temporary views of ``spark`` are not visible in it. The catalog is shared; :func:`run_sql` looks at a query's
    plan before it runs and refuses saved tables and functions that are not listed (``plan_faults``).
    """
    locked = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        locked.conf.set(name, spark.conf.get(name))
    given = views(locked)
    for name, df in given.items():
        df.createOrReplaceTempView(name)
    locked.conf.set("spark.sql.runSQLOnFiles", "false")
    locked.conf.set(_VIEWS, json.dumps(sorted(name.lower() for name in given)))
    return locked


def run_sql(locked: SparkSession, text: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """Run a caller's query with named parameters; a text that is not one query is refused.

    The text becomes a sub-select, so statements such as SET or CREATE do not parse. Its plan is looked at
    before anything runs: :class:`QueryRefused` says what is not allowed.
    """
    whole = f"SELECT * FROM (\n{text}\n) AS q"
    faults = call_faults(locked, whole)
    if not faults:
        answer = locked.sql(whole, args=dict(args or {}))
        faults = plan_faults(answer)
    if faults:
        raise QueryRefused("; ".join(faults))
    return answer


class QueryRefused(PySparkException):
    """A query that reads or calls what it may not."""

    def __init__(self, reason: str):
        super().__init__(message=f"query refused: {reason}")


def _each(found: object) -> Iterator[object]:
    """The items of a sequence of the session's."""
    for i in range(found.size()):
        yield found.apply(i)


def _nodes(plan: object) -> Iterator[tuple[str, object]]:
    """A plan's nodes and expressions, those of nested queries too, by kind; what a view hides is not entered."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        yield kind, node
        if kind == "View":
            continue
        waiting += _each(node.children())
        for inner in _each(node.innerChildren()):
            if "QueryPlan" in _ancestry(inner):
                waiting.append(inner)
        if "QueryPlan" in _ancestry(node):
            waiting += _each(node.expressions())
        elif "PlanExpression" in _ancestry(node):
            waiting.append(node.plan())


def _ancestry(node: object) -> set[str]:
    """The names of a node's class and of those above it, which tell plans from expressions and nested queries."""
    kind, names = node.getClass(), set()
    while kind is not None:
        names.add(kind.getSimpleName())
        kind = kind.getSuperclass()
    return names


def call_faults(locked: SparkSession, text: str) -> list[str]:
    """The functions that a text calls and that are not in :data:`ALLOWED_FUNCTIONS`, from its parsed form."""
    try:
        parsed = locked._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception:  # not a query at all: the session says so when it is asked to run it
        return []
    called = set()
    for kind, node in _nodes(parsed):
        if kind == "UnresolvedFunction":
            called.add(".".join(str(x) for x in _each(node.nameParts())).lower())
        elif kind == "UnresolvedTableValuedFunction":
            called.add(".".join(str(x) for x in _each(node.name())).lower())
    return [f"function {name}" for name in sorted(called - ALLOWED_FUNCTIONS)]


def plan_faults(answer: DataFrame) -> list[str]:
    """What an analysed query reads beside the governed views of its session, constants and number ranges."""
    views = set(json.loads(answer.sparkSession.conf.get(_VIEWS)))
    faults = []
    for kind, node in _nodes(answer._jdf.queryExecution().analyzed()):
        if kind == "View":
            name = node.desc().identifier().table().lower()
            if not node.isTempView() or name not in views:
                faults.append(f"view {name}")
        elif "QueryPlan" in _ancestry(node) and node.children().isEmpty() and kind not in _OWN_LEAVES:
            faults.append(f"relation {node.nodeName()}")
    return sorted(set(faults))


def run_sql_or_none(locked: SparkSession, text: str, args: Mapping[str, object] | None = None) -> DataFrame | None:
    """:func:`run_sql`, with no table in place of an error.

    The result is worked out and saved here, so a query that only fails while it runs, such as on a
    division by zero, gives no table either.
    """
    try:
        return written(run_sql(locked, text, args), "answer")
    except PySparkException as error:
        _log.warning("query refused: %s", error.getCondition())
        return None
