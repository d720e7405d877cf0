"""Queries of the record engine over the driver's tables, and the SQL that each must equal.

Nested inputs are built by ordinary joins and grouped lists; what is under test is the flattening.
Lists are ordered by all their members, as the line items' keys repeat.
"""

from __future__ import annotations

import datetime as dt
import decimal as _decimal
from collections.abc import Callable
from dataclasses import dataclass
from typing import Annotated, Generic, Optional, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from ..attrs import as_binary, as_str, as_string, decimal, skip, time_unit
from ..sources.tables import table
from ..functions.columns import interval_micros, timestamp_micros
from ..types import F32, I32, I64, U8, U16, U64, Arc, Box, ChronoDuration, DateTimeTz, NonZero, Rc, StdDuration, Unit
from .record import plan_of, record

T = TypeVar("T")


@record
@dataclass
class Customer:
    c_custkey: I64
    c_name: str
    c_nationkey: I32
    c_mktsegment: str


@record
@dataclass
class Item:
    l_linenumber: I32
    l_partkey: I64
    l_quantity: float
    l_extendedprice: float


@record
@dataclass
class Order:
    o_orderkey: I64
    o_orderstatus: str
    customer: Optional[Customer]


@record
@dataclass
class OrderWithItems:
    o_orderkey: I64
    items: Optional[list[Item]]


@record
@dataclass
class OrderWithMaybeItems:
    o_orderkey: I64
    items: Optional[list[Optional[Item]]]


@record
@dataclass
class OrderLines:
    o_orderkey: I64
    items: Optional[list[Item]]


@record
@dataclass
class CustomerWithOrders:
    c_custkey: I64
    orders: Optional[list[OrderLines]]


@record
@dataclass
class PartPair:
    p_partkey: I64
    pair: tuple[str, I32]
    maybe: Optional[tuple[str, str]]


@record
@dataclass
class OrderPairs:
    o_orderkey: I64
    pairs: Optional[list[tuple[I32, float]]]


@record
@dataclass
class Turns:
    conv_id: I64
    turns: list[tuple[list[str], I64]]


@record
@dataclass
class SupplierBrief:
    s_suppkey: I64
    s_name: str
    s_nationkey: I32
    s_acctbal: Annotated[float, skip]


@record
@dataclass
class Price:
    l_orderkey: I64
    l_linenumber: I32
    l_partkey: I64
    l_suppkey: I64
    price: Annotated[_decimal.Decimal, decimal(precision=18, scale=1)]


@record
@dataclass
class EventMs:
    event_id: I64
    ts: dt.datetime


@record
@dataclass
class EventUs:
    event_id: I64
    ts: Annotated[dt.datetime, time_unit("us")]


@record
@dataclass
class OrderDate:
    o_orderkey: I64
    o_orderdate: dt.date


@record
@dataclass
class LabelText:
    doc_id: Annotated[I64, as_string]
    quality: Annotated[I32, as_string]
    toxic: Annotated[bool, as_string]


@record
@dataclass
class NationName:
    n_nationkey: I32
    n_name: Annotated[str, as_str]


@record
@dataclass
class TextBytes:
    doc_id: I64
    text: Annotated[bytes, as_binary]


@record
@dataclass
class Embedding:
    vec_id: I64
    embedding: list[F32]


@record
@dataclass
class Nation:
    n_nationkey: I32
    n_name: str


@record
@dataclass
class Tagged(Generic[T]):
    r_regionkey: I32
    payload: T


@dataclass
class NationLabel:
    n_nationkey: int
    n_name: str


@record
@dataclass
class StringNation:
    n_nationkey: I32
    nation: Annotated[NationLabel, as_string]


@record
@dataclass
class EventZoned:
    event_id: I64
    ts: DateTimeTz
    ts_us: Annotated[DateTimeTz, time_unit("us")]
    ts_ns: Annotated[DateTimeTz, time_unit("ns")]


@record
@dataclass
class EventSpan:
    event_id: I64
    since: ChronoDuration
    since_std: StdDuration


@record
@dataclass
class EventSpanMs:
    event_id: I64
    since: Annotated[ChronoDuration, time_unit("ms")]
    until: Annotated[ChronoDuration, time_unit("us")]


@record
@dataclass
class EventTime:
    event_id: I64
    at: dt.time
    maybe: Optional[dt.time]


@record
@dataclass
class EventText:
    event_id: I64
    ts: Annotated[dt.datetime, as_string]
    zoned: Annotated[DateTimeTz, as_string]
    day: Annotated[dt.date, as_string]
    since: Annotated[ChronoDuration, as_string]


@record
@dataclass
class PartNumbers:
    p_partkey: U64
    p_size: NonZero[U8]
    sizes: list[Optional[U16]]


@record
@dataclass
class LabelBits:
    doc_id: I64
    good: bool
    maybe_toxic: Optional[bool]
    bits: list[bool]


@record
@dataclass
class Pointed:
    s_suppkey: Box[I64]
    s_name: Optional[Rc[str]]
    nation: Arc[Nation]
    numbers: Box[list[Box[I32]]]


@record
@dataclass
class OrderMaybePairs:
    o_orderkey: I64
    pairs: list[Optional[tuple[I32, float]]]


def _customer() -> Column:
    return F.struct("c_custkey", "c_name", "c_nationkey", "c_mktsegment").alias("customer")


_ITEM = ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
_ITEM_SQL = ", ".join(_ITEM)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(*_ITEM))).alias("items"))


def _orders_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(_items(spark, sf_dir), "o_orderkey", "left")


def orders_flat_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return plan_of(Order).flatten(joined.select("o_orderkey", "o_orderstatus", _customer()))


def orders_items_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(OrderWithItems).flatten(_orders_items(spark, sf_dir))


def orders_items_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of orders_items_lists side by side again, a row for each element."""
    flat = orders_items_lists(spark, sf_dir)
    zipped = F.arrays_zip(*(F.col(f"`items.{c}`").alias(c) for c in _ITEM))
    return flat.select("o_orderkey", F.posexplode(zipped).alias("nth", "x")).select("o_orderkey", "nth", *(F.col("x").getField(c).alias(c) for c in _ITEM))


def customer_orders_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders_items(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "items"))).alias("orders"))
    return plan_of(CustomerWithOrders).flatten(table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left"))


def optional_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return plan_of(Order).flatten(joined.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "F", _customer()).alias("customer")))


def vec_option_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(*_ITEM, "l_discount"))).alias("all"))
    items = F.transform("all", lambda x: F.when(x.l_discount <= 0.05, F.struct(*(x.getField(c).alias(c) for c in _ITEM))))
    return plan_of(OrderWithMaybeItems).flatten(held.select("o_orderkey", items.alias("items")))


def option_vec_empty_vs_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _orders_items(spark, sf_dir)
    empty = F.when(F.col("items").isNotNull() & (F.col("o_orderstatus") == "F"), F.slice("items", 1, 0)).otherwise(F.col("items"))
    return plan_of(OrderWithItems).flatten(nested.select("o_orderkey", empty.alias("items")))


def tuple_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct(F.col("p_brand").alias("field_0"), F.col("p_size").alias("field_1")).alias("pair")
    maybe = F.when(F.col("p_size") > 20, F.struct(F.col("p_name").alias("field_0"), F.col("p_type").alias("field_1"))).alias("maybe")
    return plan_of(PartPair).flatten(table(spark, sf_dir, "part").select("p_partkey", pair, maybe))


def vec_tuple_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct(F.col("l_linenumber").alias("field_0"), F.col("l_quantity").alias("field_1"))
    return plan_of(OrderPairs).flatten(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(pair)).alias("pairs")))


def tuple_vec_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    turns = F.transform("all", lambda x: F.struct(F.array(x.role, x.text).alias("field_0"), x.turn.alias("field_1")))
    return plan_of(Turns).flatten(held.select("conv_id", turns.alias("turns")))


def skip_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(SupplierBrief).flatten(table(spark, sf_dir, "supplier"))


def decimal_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return plan_of(Price).flatten(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price")))


def time_unit_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(EventMs).flatten(table(spark, sf_dir, "events").select("event_id", "ts"))


def time_unit_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(EventUs).flatten(table(spark, sf_dir, "events").select("event_id", "ts"))


def date_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(OrderDate).flatten(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))


def as_string_bool_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(LabelText).flatten(table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic")))


def as_str_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(NationName).flatten(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def as_binary_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = plan_of(TextBytes).flatten(table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("text")))
    return flat.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


def list_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(Embedding).flatten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def generic_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return plan_of(Tagged[Nation]).flatten(joined.select("r_regionkey", F.struct("n_nationkey", "n_name").alias("payload")))


def unit_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(Tagged[Unit]).flatten(table(spark, sf_dir, "region").select("r_regionkey", F.lit(None).alias("payload")))


def empty_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(Customer).empty_df(spark)


def stringify_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), F.col("n_name"))
    return plan_of(StringNation).flatten(table(spark, sf_dir, "nation").select("n_nationkey", shown.alias("nation")))


def ingest_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made on the driver, from a table of 25 rows, through ``to_df``."""
    rows = [Nation(r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    return plan_of(Nation).to_df(spark, rows)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _zoned() -> Column:
    """The events' times as those of a zone two and a half hours east: instants, whatever the session's zone."""
    return F.concat(F.col("ts").cast("string"), F.lit("+02:30")).cast("timestamp")


def _since() -> Column:
    return F.col("ts") - F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00.000001'")


def timestamp_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_of(EventZoned).flatten(_events(spark, sf_dir).select("event_id", *(_zoned().alias(c) for c in ("ts", "ts_us", "ts_ns"))))


def duration_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = _since()
    return plan_of(EventSpan).flatten(_events(spark, sf_dir).select("event_id", since.alias("since"), F.abs(since).alias("since_std")))


def duration_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in the two units that they carry, read back as microseconds."""
    flat = plan_of(EventSpanMs).flatten(_events(spark, sf_dir).select("event_id", _since().alias("since"), (-_since()).alias("until")))
    return flat.select("event_id", *(interval_micros(F.col(c)).alias(c) for c in ("since", "until")))


def time_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds of the day as whole numbers, as Spark's own times are off by default."""
    at = F.pmod(timestamp_micros(F.col("ts"), types.TimestampNTZType()), F.lit(86_400_000_000)) * 1_000
    return plan_of(EventTime).flatten(_events(spark, sf_dir).select("event_id", at.alias("at"), F.when(F.col("event_id") % 3 > 0, at).alias("maybe")))


def as_string_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return plan_of(EventText).flatten(_events(spark, sf_dir).select("event_id", "ts", _zoned().alias("zoned"), ts.cast("date").alias("day"), _since().alias("since")))


def unsigned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(F.col("p_size"), F.lit(None).cast("int"), F.col("p_size") * 1_000)
    return plan_of(PartNumbers).flatten(table(spark, sf_dir, "part").select("p_partkey", "p_size", sizes.alias("sizes")))


def bool_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return plan_of(LabelBits).flatten(table(spark, sf_dir, "labels").select("doc_id", good.alias("good"), F.when(good, toxic).alias("maybe_toxic"), F.array(good, toxic).alias("bits")))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return plan_of(Pointed).flatten(joined.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("s_name"), F.struct("n_nationkey", "n_name").alias("nation"), F.array("s_nationkey", "n_regionkey").alias("numbers")))


def vec_option_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(*_ITEM, "l_discount"))).alias("all"))
    pair = lambda x: F.when(x.l_discount <= 0.05, F.struct(x.l_linenumber.alias("field_0"), x.l_quantity.alias("field_1")))
    return plan_of(OrderMaybePairs).flatten(held.select("o_orderkey", F.transform("all", pair).alias("pairs")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        orders_flat_customer, orders_items_lists, orders_items_rows, customer_orders_items, optional_nested, vec_option_nested, option_vec_empty_vs_null, tuple_fields, vec_tuple_fields, tuple_vec_element, skip_field,
        decimal_half_even, time_unit_ms, time_unit_us, date_leaf, as_string_bool_int, as_str_leaf, as_binary_leaf, list_leaf, generic_payload, unit_payload, empty_frame, stringify_nested, ingest_nations,
        timestamp_utc, duration_ns, duration_ms, time_leaf, as_string_times, unsigned_range, bool_leaves, pointers, vec_option_tuple,
    )
}

_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _lists(prefix: str, columns: tuple[str, ...], when: str = "") -> str:
    value = lambda c: f"CASE WHEN {when} THEN {c} END" if when else c
    return ", ".join(f'list({value(c)} ORDER BY {_ITEM_SQL}{", l_discount" if when else ""}) AS "{prefix}.{c}"' for c in columns)


_SINCE = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00.000001'))"
_UTC = "(ts - INTERVAL 150 MINUTE)"


def _shown(us: str, seconds: str) -> str:
    """Text up to the seconds, and none, three or six digits of their fraction."""
    return f"{seconds} || CASE WHEN {us} % 1000000 = 0 THEN '' WHEN {us} % 1000 = 0 THEN '.' || lpad(({us} % 1000000 // 1000)::VARCHAR, 3, '0') ELSE '.' || lpad(({us} % 1000000)::VARCHAR, 6, '0') END"


_ORDER_ITEMS = f"(SELECT l_orderkey, {_lists('items', _ITEM)} FROM lineitem GROUP BY l_orderkey)"

SQL: dict[str, str] = {
    "orders_flat_customer": f"""SELECT o_orderkey, o_orderstatus, {", ".join(f'{c} AS "customer.{c}"' for c in _CUSTOMER)} FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "orders_items_lists": f"""SELECT o_orderkey, {", ".join(f'"items.{c}"' for c in _ITEM)} FROM orders LEFT JOIN {_ORDER_ITEMS} ON o_orderkey = l_orderkey""",
    "orders_items_rows": f"""SELECT l_orderkey AS o_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEM_SQL}) - 1)::INT AS nth, {_ITEM_SQL} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "customer_orders_items": f"""
        WITH o AS (SELECT o_custkey, o_orderkey, i.* FROM orders LEFT JOIN {_ORDER_ITEMS} i ON o_orderkey = l_orderkey)
        SELECT c_custkey, list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL) AS "orders.o_orderkey",
          {", ".join(f'list("items.{c}" ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL) AS "orders.items.{c}"' for c in _ITEM)}
        FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey""",
    "optional_nested": f"""SELECT o_orderkey, o_orderstatus, {", ".join(f'''CASE WHEN o_orderstatus <> 'F' THEN {c} END AS "customer.{c}"''' for c in _CUSTOMER)} FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "vec_option_nested": f"""SELECT l_orderkey AS o_orderkey, {_lists("items", _ITEM, "l_discount <= 0.05")} FROM lineitem GROUP BY l_orderkey""",
    "option_vec_empty_vs_null": f"""SELECT o_orderkey, {", ".join(f'''CASE WHEN "items.{c}" IS NOT NULL AND o_orderstatus = 'F' THEN "items.{c}"[1:0] ELSE "items.{c}" END AS "items.{c}"''' for c in _ITEM)} FROM orders LEFT JOIN {_ORDER_ITEMS} ON o_orderkey = l_orderkey""",
    "tuple_fields": """SELECT p_partkey, p_brand AS "pair.field_0", p_size AS "pair.field_1", CASE WHEN p_size > 20 THEN p_name END AS "maybe.field_0", CASE WHEN p_size > 20 THEN p_type END AS "maybe.field_1" FROM part""",
    "vec_tuple_fields": """SELECT l_orderkey AS o_orderkey, list(l_linenumber ORDER BY l_linenumber, l_quantity) AS "pairs.field_0", list(l_quantity ORDER BY l_linenumber, l_quantity) AS "pairs.field_1" FROM lineitem GROUP BY l_orderkey""",
    "tuple_vec_element": """SELECT conv_id, list([role, text] ORDER BY turn, role, text) AS "turns.field_0", list(turn ORDER BY turn, role, text) AS "turns.field_1" FROM conversations GROUP BY conv_id""",
    "skip_field": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "decimal_half_even": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice::DECIMAL(18,2), 1)::DECIMAL(18,1) AS price FROM lineitem",
    "time_unit_ms": "SELECT event_id, date_trunc('milliseconds', ts) AS ts FROM events",
    "time_unit_us": "SELECT event_id, ts FROM events",
    "date_leaf": "SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders",
    "as_string_bool_int": "SELECT doc_id::VARCHAR AS doc_id, quality::VARCHAR AS quality, (toxic = 1)::VARCHAR AS toxic FROM labels",
    "as_str_leaf": "SELECT n_nationkey, n_name FROM nation",
    "as_binary_leaf": "SELECT doc_id, sha256(text) AS text_sha256, strlen(text)::BIGINT AS n_bytes FROM documents",
    "list_leaf": "SELECT vec_id, embedding FROM embeddings",
    "generic_payload": """SELECT r_regionkey, n_nationkey AS "payload.n_nationkey", n_name AS "payload.n_name" FROM region JOIN nation ON r_regionkey = n_regionkey""",
    "unit_payload": "SELECT r_regionkey FROM region",
    "empty_frame": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE false",
    "stringify_nested": "SELECT n_nationkey, n_nationkey::VARCHAR || ':' || n_name AS nation FROM nation",
    "ingest_nations": "SELECT n_nationkey, n_name FROM nation",
    "timestamp_utc": f"SELECT event_id, date_trunc('milliseconds', {_UTC}) AS ts, {_UTC} AS ts_us, epoch_us({_UTC}) * 1000 AS ts_ns FROM events",
    "duration_ns": f"SELECT event_id, {_SINCE} * 1000 AS since, abs({_SINCE}) * 1000 AS since_std FROM events",
    "duration_ms": f"SELECT event_id, {_SINCE} - {_SINCE} % 1000 AS since, -{_SINCE} AS until FROM events",
    "time_leaf": "SELECT event_id, epoch_us(ts) % 86400000000 * 1000 AS at, CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) % 86400000000 * 1000 END AS maybe FROM events",
    "as_string_times": f"""
        SELECT event_id, {_shown("epoch_us(ts)", "strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS ts, {_shown("epoch_us(ts)", f"strftime({_UTC}, '%Y-%m-%d %H:%M:%S')")} || ' UTC' AS zoned, ts::DATE::VARCHAR AS day,
          CASE WHEN s = 0 THEN 'P0D' ELSE CASE WHEN s < 0 THEN '-PT' ELSE 'PT' END || abs(s) // 1000000 || CASE WHEN abs(s) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((abs(s) % 1000000)::VARCHAR, 6, '0'), '0') END || 'S' END AS since
        FROM (SELECT *, {_SINCE} AS s FROM events)""",
    "unsigned_range": "SELECT p_partkey::DECIMAL(20,0) AS p_partkey, p_size::SMALLINT AS p_size, [p_size, NULL, p_size * 1000]::INTEGER[] AS sizes FROM part",
    "bool_leaves": "SELECT doc_id, quality = 1 AS good, CASE WHEN quality = 1 THEN toxic = 1 END AS maybe_toxic, [quality = 1, toxic = 1] AS bits FROM labels",
    "pointers": """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name END AS s_name, n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", [s_nationkey, n_regionkey] AS numbers FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "vec_option_tuple": f"""SELECT l_orderkey AS o_orderkey, list(CASE WHEN l_discount <= 0.05 THEN l_linenumber END ORDER BY {_ITEM_SQL}, l_discount) AS "pairs.field_0", list(CASE WHEN l_discount <= 0.05 THEN l_quantity END ORDER BY {_ITEM_SQL}, l_discount) AS "pairs.field_1" FROM lineitem GROUP BY l_orderkey""",
}
