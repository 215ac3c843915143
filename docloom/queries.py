"""The catalogue of queries, each said through the engine, over the tables of a folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import scalar
from .operators import audit, frames, indexes, lifecycle, packets, versions
from .oracles import ORACLES  # noqa: F401
from .plans import cost, frontends
from .plans.catalog import Catalog
from .plans.plan import CollectionConfig, QueryPlan, Relation, Where
from .plans.views import ViewDefinition, Views
from .sources import changelog

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}


def stamp(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def moment(text: str) -> Column:
    """A time without zone, as the tables have it."""
    return F.lit(text).cast("timestamp_ntz")


def _configs() -> dict[str, CollectionConfig]:
    config = CollectionConfig
    orders = config("o_orderkey", "o_orderdate", sort_fields=("o_totalprice",), exact_fields=("o_orderpriority",), composites=(("o_orderpriority", "o_orderdate"),))
    lineitem = config("l_orderkey", exact_fields=())
    customer = config("c_custkey", exact_fields=("c_mktsegment", "c_name"))
    events = config("event_id", "ts", sort_fields=("value",), exact_fields=())
    return {
        "events": events,
        "orders": orders.relate([Relation("customer", "o_custkey", "customer", "c_custkey")]),
        "lineitem": lineitem.relate([Relation("orders", "l_orderkey", "orders", "o_orderkey")]),
        "customer": customer.relate([Relation("nation", "c_nationkey", "nation", "n_nationkey"), Relation("orders", "c_custkey", "orders", "o_custkey")]),
        "nation": config("n_nationkey").relate([Relation("customers", "n_nationkey", "customer", "c_nationkey")]),
        "part": config("p_partkey", exact_fields=("p_name",)),
        "documents": config("doc_id", exact_fields=("text",)).relate([Relation("labels", "doc_id", "labels", "doc_id")]),
        "labels": config("doc_id"),
        "pages": config("page_id", exact_fields=("url",)),
    }


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.from_parquet(spark, sf_dir, _configs())


def query(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(catalog(spark, sf_dir))
    return f


EVENT = ("event_id", "ts", "user_id", "event_type", "value")


@query
def scan_all(c: Catalog) -> DataFrame:
    return c.collection("events").select(*EVENT).df()


@query
def record_count(c: Catalog) -> DataFrame:
    return c.record_counts("events", "orders")


@query
def point_id(c: Catalog) -> DataFrame:
    return c.collection("orders").where("o_orderkey", "=", 42).select("o_orderkey", "o_custkey", "o_totalprice").df()


@query
def filter_eq(c: Catalog) -> DataFrame:
    return c.collection("events").where("event_type", "=", "click").select(*EVENT).df()


@query
def filter_ne(c: Catalog) -> DataFrame:
    return c.collection("events").where("event_type", "!=", "click").select(*EVENT).df()


@query
def filter_gt_lte(c: Catalog) -> DataFrame:
    return frontends.find(c, "events", filter={"value": {"$gt": 10, "$lte": 50}}).select(*EVENT)


@query
def filter_between_int(c: Catalog) -> DataFrame:
    return c.collection("part").where("p_size", ">=", 10).where("p_size", "<=", 20).select("p_partkey", "p_name", "p_size").df()


@query
def filter_between_strict(c: Catalog) -> DataFrame:
    return c.collection("part").where("p_size", ">", 10).where("p_size", "<", 20).select("p_partkey", "p_size").df()


@query
def filter_string_range(c: Catalog) -> DataFrame:
    return c.collection("customer").where("c_mktsegment", ">=", "BUILDING").where("c_mktsegment", "<", "HOUSEHOLD").select("c_custkey", "c_mktsegment").df()


@query
def filter_bool(c: Catalog) -> DataFrame:
    c.add("flags", c.frame("labels").select("doc_id", (F.col("toxic") == 1).alias("is_toxic")), CollectionConfig("doc_id"))
    return c.collection("flags").where("is_toxic", "=", True).df()


@query
def filter_three_clauses(c: Catalog) -> DataFrame:
    return c.collection("events").where("event_type", "=", "click").where("user_id", "<", 50).where("ts", ">", stamp("2024-01-15")).select(*EVENT).df()


@query
def filter_no_hit(c: Catalog) -> DataFrame:
    return c.collection("events").where("event_type", "=", "__no_hit__").select(*EVENT).df()


@query
def missing_field_ne(c: Catalog) -> DataFrame:
    c.add("sparse", c.frame("events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("k")), CollectionConfig("event_id"))
    return c.collection("sparse").where("k", "!=", 7).df()


@query
def like_prefix(c: Catalog) -> DataFrame:
    return c.collection("part").where("p_name", "like", "red%").select("p_partkey", "p_name").df()


@query
def like_suffix(c: Catalog) -> DataFrame:
    return c.collection("part").where("p_name", "like", "%ring").select("p_partkey", "p_name").df()


@query
def like_contains(c: Catalog) -> DataFrame:
    return frontends.find(c, "documents", filter={"text": {"$regex": "%the%"}}).select("doc_id", "n_chars")


@query
def like_underscore(c: Catalog) -> DataFrame:
    return c.collection("part").where("p_brand", "like", "Brand#_").select("p_partkey", "p_brand").df()


@query
def like_multi(c: Catalog) -> DataFrame:
    return c.collection("pages").where("url", "like", "http://%example%/en/%").select("page_id", "url").df()


@query
def hybrid_eq_like_topk(c: Catalog) -> DataFrame:
    return c.collection("documents").where("lang", "=", "en").where("text", "like", "%the%").order_by("n_chars", "desc").limit(20).select("doc_id", "n_chars").df()


@query
def order_limit_desc(c: Catalog) -> DataFrame:
    return c.collection("events").order_by("ts", "desc").limit(50).select(*EVENT).df()


@query
def order_limit_asc(c: Catalog) -> DataFrame:
    return c.collection("orders").order_by("o_totalprice").limit(25).select("o_orderkey", "o_totalprice").df()


@query
def implicit_order_limit(c: Catalog) -> DataFrame:
    return c.collection("orders").where("o_orderstatus", "=", "F").limit(100).select("o_orderkey", "o_orderdate", "o_orderstatus").df()


@query
def composite_topk(c: Catalog) -> DataFrame:
    body = {"collection": "orders", "where": [{"field": "o_orderpriority", "op": "eq", "value": "1-URGENT"}], "orderBy": {"field": "o_orderdate", "direction": "desc"}, "limit": 30, "fields": ["o_orderkey", "o_orderpriority", "o_orderdate"]}
    return frontends.request(c, body).df()


@query
def prefix_order_by_id(c: Catalog) -> DataFrame:
    return c.collection("part").where("p_name", "like", "small%").order_by("p_partkey").limit(15).select("p_partkey", "p_name").df()


@query
def exact_multi_intersect(c: Catalog) -> DataFrame:
    customers = c.frame("customer")
    segment = indexes.range_lookup(indexes.exact_index(customers, "c_mktsegment", "c_custkey"), "BUILDING", "BUILDING")
    named = indexes.exact_index(customers, "c_name", "c_custkey").where(F.col("value").startswith("Customer#00000"))
    return customers.join(indexes.intersect_ids(segment, named), F.col("c_custkey") == F.col("id"), "left_semi").select("c_custkey", "c_name")


@query
def fetch_one(c: Catalog) -> DataFrame:
    return c.collection("orders").where("o_custkey", "=", 899).order_by("o_orderdate", "desc").select("o_orderkey", "o_custkey").fetch_one()


@query
def header_projection(c: Catalog) -> DataFrame:
    return frontends.sql(c, "SELECT event_id, value FROM events WHERE event_type = 'purchase'")


def _views() -> Views:
    views = Views()
    views.define(ViewDefinition("base", collections=frozenset(["customer"]), include=frozenset(["c_custkey"]), exclude=frozenset(["c_acctbal"])))
    views.define(ViewDefinition("names", parent="base", additionally_include=frozenset(["c_name", "c_acctbal"])))
    views.define(ViewDefinition("support", parent="base", include=frozenset(["c_name", "c_mktsegment"]), masks={"c_name": F.lit("***")}))
    return views


@query
def view_partial_mask(c: Catalog) -> DataFrame:
    return c.collection("customer", _views().resolve("names")).df()


@query
def view_value_mask(c: Catalog) -> DataFrame:
    return c.collection("customer", _views().resolve("support")).df()


@query
def include_one_hop(c: Catalog) -> DataFrame:
    return c.collection("orders").where("o_orderstatus", "=", "F").related("customer").select("o_orderkey", "c_custkey", "c_name")


@query
def include_two_hop(c: Catalog) -> DataFrame:
    return c.collection("lineitem").where("l_returnflag", "=", "R").where("l_quantity", ">=", 49).related("orders.customer").select("l_orderkey", "l_linenumber", "c_custkey")


@query
def include_left_outer_count(c: Catalog) -> DataFrame:
    return c.collection("customer").include_count("orders").select("c_custkey", F.col("n_related").alias("n_orders"))


@query
def include_two_hop_count(c: Catalog) -> DataFrame:
    return c.collection("nation").include_count("customers.orders").select("n_nationkey", "n_related")


@query
def include_nested(c: Catalog) -> DataFrame:
    found = c.collection("nation").include("customers").df()
    return found.select("n_nationkey", F.size("customers").cast("long").alias("n"), F.array_join(F.transform("customers", lambda x: x["c_custkey"].cast("string")), ",").alias("keys"))


@query
def include_under_view(c: Catalog) -> DataFrame:
    views = Views()
    views.define(ViewDefinition("desk", collections=frozenset(["orders", "customer"]), include=frozenset(["o_orderkey", "c_custkey", "c_name"]), masks={"c_name": F.lit("***")}))
    return c.collection("orders", views.resolve("desk")).related("customer")


@query
def sql_under_view(c: Catalog) -> DataFrame:
    return frontends.sql(c, "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 AND c_custkey <= 1000", _views().resolve("support"))


@query
def json_field_filter(c: Catalog) -> DataFrame:
    document = c.frame("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return c.add("props", document, CollectionConfig("event_id")).collection("props").where("k", ">=", 90).df()


@query
def snapshot_visible(c: Catalog) -> DataFrame:
    events = c.frame("events")
    seen = versions.latest(events, "user_id", ["ts", "event_id"], F.col("ts") <= moment("2024-01-20"), F.col("event_type") == "error")
    return seen.select("user_id", "event_id", "value")


@query
def version_count(c: Catalog) -> DataFrame:
    return versions.version_counts(c.frame("events"), "user_id")


@query
def version_compaction(c: Catalog) -> DataFrame:
    return versions.compacted(c.frame("events").select("user_id", "event_id", "ts"), "user_id", "ts", ["ts", "event_id"], moment("2024-01-20"), 2).select("user_id", "event_id")


@query
def write_conflicts(c: Catalog) -> DataFrame:
    written = c.collection("events").where("event_type", "=", "purchase").where("ts", ">", stamp("2024-01-29")).df()
    return versions.conflicts(written, c.frame("events"), "user_id", "ts", moment("2024-01-29 12:00:00"))


@query
def upsert_last_wins(c: Catalog) -> DataFrame:
    orders = c.frame("orders").select("o_orderkey", "o_orderstatus")
    first = orders.where(F.col("o_orderkey") % 10 == 0).withColumns({"o_orderstatus": F.lit("X"), "at": F.lit(1)})
    second = orders.where(F.col("o_orderkey") % 20 == 0).withColumns({"o_orderstatus": F.lit("Y"), "at": F.lit(2)})
    return versions.upserted(orders, second.union(first), "o_orderkey", order="at")


@query
def update_where(c: Catalog) -> DataFrame:
    change = frontends.sql_mutation("UPDATE orders SET o_orderstatus = 'F' WHERE o_orderpriority = '5-LOW'")
    return versions.updated(c.frame("orders"), change.wheres, change.values, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query
def delete_where(c: Catalog) -> DataFrame:
    change = frontends.delete_where("orders", {"o_orderstatus": "P"})
    return versions.remaining(c.frame("orders"), change.wheres).select("o_orderkey")


@query
def hash_index(c: Catalog) -> DataFrame:
    return indexes.index_summary(indexes.exact_index(c.frame("events"), "event_type", "event_id"))


@query
def range_index_gte(c: Catalog) -> DataFrame:
    return indexes.range_lookup(indexes.exact_index(c.frame("part"), "p_size", "p_partkey"), low=40).select(F.col("value").alias("k"), "id")


@query
def selectivity(c: Catalog) -> DataFrame:
    return indexes.selectivity(c.frame("events"), "event_type", "user_id")


@query
def segment_stats(c: Catalog) -> DataFrame:
    return indexes.segment_stats(c.frame("events"), "event_id", 4096, user="user_id", value="value")


@query
def block_skip_count(c: Catalog) -> DataFrame:
    return indexes.skip_counts(indexes.segment_stats(c.frame("events"), "event_id", 512, v="event_id"), "v", "gte", 9990)


@query
def value_dictionary(c: Catalog) -> DataFrame:
    return indexes.value_dictionary(c.frame("events"), "user_id", "event_id", 4096)


@query
def trigram_postings(c: Catalog) -> DataFrame:
    return indexes.trigram_postings(c.frame("part"), "p_name", "p_partkey").groupBy("gram").agg(F.count("*").alias("n"))


@query
def trigram_candidates(c: Catalog) -> DataFrame:
    part = c.frame("part").select("p_partkey", "p_name")
    return indexes.trigram_candidates(part, indexes.trigram_postings(part, "p_name", "p_partkey"), "p_name", "p_partkey", "idget").select("p_partkey")


@query
def latency_histogram(c: Catalog) -> DataFrame:
    return indexes.latency_histogram(c.frame("events"), "value")


@query
def tier_classify(c: Catalog) -> DataFrame:
    last = c.frame("events").groupBy("user_id").agg(F.max("ts").alias("last"))
    idle = lifecycle.seconds_between(F.col("last"), moment("2024-01-31"))
    return last.select("user_id", lifecycle.temperature(F.col("user_id") % 10, idle).alias("temperature"))


@query
def colocation(c: Catalog) -> DataFrame:
    return lifecycle.colocation_members(c.frame("events"), scalar.semantic_key(F.col("user_id"), F.lit("events")), "event_id")


@query
def colocation_summary(c: Catalog) -> DataFrame:
    return lifecycle.colocation(c.frame("events"), scalar.semantic_key(F.col("user_id"), F.lit("events")), "event_id")


@query
def compaction_order(c: Catalog) -> DataFrame:
    events = c.frame("events").select("event_id", "event_type")
    return lifecycle.positions(lifecycle.compact([events.where("event_id < 1000"), events.where("event_id >= 1000")], "event_type", "event_id")).select("event_id", "pos")


@query
def lifecycle_action(c: Catalog) -> DataFrame:
    old = ~(F.col("o_orderdate") > moment("2001-01-01"))
    status = F.col("o_orderstatus")
    refresh = F.when(status.isin("F", "O"), "AutoOnRead").otherwise("Manual")
    expire = F.when(status == "F", "Delete").when(status == "O", "Archive").otherwise("None")
    return c.frame("orders").select("o_orderkey", lifecycle.action(F.col("o_custkey") % 5, F.lit(False), old, refresh, expire).alias("action"))


@query
def deleted_pool_sweep(c: Catalog) -> DataFrame:
    pool = lifecycle.soft_deleted(c.frame("orders"), "o_orderkey", F.col("o_orderdate"), F.lit("expired"))
    return lifecycle.sweep(pool, moment("1996-01-01")).select("o_orderkey")


@query
def replication_resume(c: Catalog) -> DataFrame:
    return changelog.resume(c.frame("events").select(F.col("event_id").alias("sequence"), "event_type"), "sequence", 4000, 500)


@query
def replay_guard(c: Catalog) -> DataFrame:
    return packets.first_seen(c.frame("events"), "user_id", "event_id")


def _packets(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as packets of their users, those applied by some day, and each user's last applied number."""
    sent = c.frame("events").select(F.col("event_id").alias("packet_id"), F.col("user_id").alias("node"), F.col("event_id").alias("origin_sequence"), "ts")
    done = sent.where(F.col("ts") < moment("2024-01-25")).where("node % 3 <> 0")
    return sent.drop("ts"), done.select("packet_id"), done.groupBy("node").agg(F.max("origin_sequence").alias("high"))


@query
def sync_plan(c: Catalog) -> DataFrame:
    return packets.sync_plan(*_packets(c)).select("node", "origin_sequence")


@query
def partition_catch_up(c: Catalog) -> DataFrame:
    sent, applied, high = _packets(c)
    queue = packets.buffered(sent.where("node % 2 = 0"), sent.where("node % 4 = 0"))
    return packets.catch_up(queue, applied, high).select("node", "origin_sequence")


@query
def apply_report(c: Catalog) -> DataFrame:
    entries = c.frame("events").select("event_id")
    return packets.apply_report(entries.union(entries.where("event_id % 4 = 0")), "event_id", 2500)


@query
def schema_union_by_name(c: Catalog) -> DataFrame:
    packet = lambda name, kind, n: packets.Packet(f"p{n}", "documents", "add", name, "a", n, kind)
    documents = packets.evolve(c.frame("documents").select("doc_id", "lang"), [packet("quality", "integer", 1)])
    labels = packets.evolve(c.frame("labels").select("doc_id", "quality"), [packet("lang", "string", 2)])
    return documents.unionByName(labels)


@query
def access_sessions(c: Catalog) -> DataFrame:
    return lifecycle.access_bursts(c.frame("events"), "user_id", "ts", "event_id")


@query
def audit_digest(c: Catalog) -> DataFrame:
    return c.frame("events").select("event_id", audit.digest(F.col("event_id").cast("string"), F.col("event_type")).alias("digest"))


@query
def base4_round_trip(c: Catalog) -> DataFrame:
    data = c.frame("part").select("p_partkey", F.col("p_name").cast("binary").alias("raw"))
    coded = data.withColumn("symbols", scalar.base4_encode(F.col("raw")))
    back = scalar.base4_decode(F.col("symbols"), F.length("raw"))
    return coded.select("p_partkey", "symbols", scalar.mirror(F.col("symbols")).alias("mirror"), (back == F.col("raw")).alias("same"), F.size(scalar.broken_positions(F.col("symbols"), scalar.mirror(F.col("symbols")))).alias("n_broken"))


@query
def fnv_hash(c: Catalog) -> DataFrame:
    return c.frame("part").select("p_partkey", scalar.fnv1a64(F.col("p_name").cast("binary")).alias("hash"))


@query
def scrub_report(c: Catalog) -> DataFrame:
    frames = c.frame("part").select("p_partkey", "p_name")
    stored = audit.with_checksum(frames, "p_name").withColumn("crc", F.when(F.col("p_partkey") % 100 == 0, F.col("crc") + 1).otherwise(F.col("crc"))).where("p_partkey % 7 <> 0")
    return audit.scrub(frames, stored, "p_partkey", "p_name")


@query
def bloom_probe(c: Catalog) -> DataFrame:
    bits = indexes.bloom_bits(c.frame("events"), "user_id", "event_id", 512)
    return indexes.bloom_candidates(bits, 7)


@query
def dictionary_coverage(c: Catalog) -> DataFrame:
    events = c.frame("events")
    return indexes.dictionary_coverage(events, indexes.value_dictionary(events, "user_id", "event_id", 4096), "user_id", "event_id", 4096)


@query
def audit_chain(c: Catalog) -> DataFrame:
    entries = c.frame("events").select(F.col("user_id").cast("string").alias("identity_id"), F.col("event_id").alias("audit_id"), F.col("event_type").alias("operation"))
    return audit.chained(entries, "identity_id", "audit_id")


@query
def path_explain(c: Catalog) -> DataFrame:
    rows = c.frame("events").count()
    shares = {r["field"]: r["selectivity"] for r in indexes.selectivity(c.frame("events"), "event_type", "user_id").collect()}
    plans = {"by_id": (Where("event_id", "eq", 5),), "by_user": (Where("user_id", "eq", 7), Where("event_type", "eq", "click")), "span": (Where("value", "gte", 1), Where("value", "lt", 5)), "all": ()}
    found = [(name, p.kind, p.field, p.cost) for name, w in plans.items() for p in [cost.explain_path(QueryPlan("events", w), c.config("events"), rows, shares)]]
    return c.spark.createDataFrame(found, "query string, path string, field string, cost double")


NOW_NS = 1_706_659_200_000_000_000


@query
def rebalance_tick(c: Catalog) -> DataFrame:
    users = c.frame("events").groupBy(F.col("user_id").alias("block_id")).agg((lifecycle.micros(F.max("ts")) * 1000).alias("last_access_ns"))
    tiers = F.array(*map(F.lit, lifecycle.TIERS))
    blocks = users.withColumn("temperature", F.element_at(tiers, (F.col("block_id") % 4 + 1).cast("int")))
    stats = users.where("block_id % 9 <> 0").withColumn("access_count_recent", F.col("block_id") % 3)
    ttl = users.where("block_id % 6 <> 0").select("block_id", (F.col("block_id") % 5).alias("count"), (F.col("block_id") % 7 == 0).alias("immortal"))
    return lifecycle.rebalance(blocks, stats, ttl, blocks.where("block_id % 2 = 1"), NOW_NS)


@query
def access_counters(c: Catalog) -> DataFrame:
    last = c.frame("events").groupBy(F.col("user_id").alias("block_id")).agg((lifecycle.micros(F.max("ts")) * 1000).alias("last_access_ns"), F.count("*").alias("access_count_total"))
    stats = last.withColumn("access_count_recent", F.col("block_id") % 4)
    now = 1_706_612_400_000_000_000
    return lifecycle.accessed_once_more(stats, stats.where("block_id % 2 = 0"), now)


def _policies(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([("F", 3, False), ("O", 0, True)], "o_orderstatus string, ttl_count int, immortal boolean")


@query
def initial_ttl(c: Catalog) -> DataFrame:
    orders = c.frame("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return lifecycle.with_initial_ttl(orders, _policies(c), F.col("o_orderdate"), "o_orderstatus").select("o_orderkey", "ttl_count", "immortal", "last_refresh")


@query
def ttl_decrement(c: Catalog) -> DataFrame:
    orders = lifecycle.with_policies(c.frame("orders").select("o_orderkey", "o_orderstatus"), _policies(c), "o_orderstatus")
    return orders.select("o_orderkey", lifecycle.decremented(F.col("ttl_count") - F.col("o_orderkey") % 4, F.col("immortal")).alias("ttl_count"))


@query
def ttl_refresh(c: Catalog) -> DataFrame:
    orders = c.frame("orders").select("o_orderkey", "o_custkey", F.lit(1).alias("ttl_count"), F.col("o_orderdate").alias("last_refresh"))
    return lifecycle.refreshed(orders, F.col("o_custkey") % 3 == 0, "ttl_count", 5, "last_refresh", moment("2024-01-01")).select("o_orderkey", "ttl_count", "last_refresh")


@query
def soft_delete(c: Catalog) -> DataFrame:
    return lifecycle.soft_deleted(c.frame("orders"), "o_orderkey", F.col("o_orderdate"), F.lit("expired"))


def _frames(c: Catalog) -> DataFrame:
    return audit.materialised(c.frame("events").select("event_id", "event_type", "user_id"), "event_id", "event_type", "events")


@query
def materialised_frames(c: Catalog) -> DataFrame:
    entry = F.col("entries")[0]
    return _frames(c).select("signature", "symbols", "mirror", entry["field_name"].alias("field_name"), entry["length"].alias("length"), entry["value_hash"].alias("value_hash"))


@query
def hash_prefilter(c: Catalog) -> DataFrame:
    return _frames(c).where(frames.may_match(Where("_payload", "eq", "click"))).select("signature")


@query
def byte_range(c: Catalog) -> DataFrame:
    return frames.matching(_frames(c), Where("_payload", "gt", "click"), Where("_payload", "lte", "signup")).select("signature")


@query
def signature_probe(c: Catalog) -> DataFrame:
    return frames.probed(_frames(c), 4242).select("signature", F.decode("payload", "UTF-8").alias("payload"))


@query
def header_order(c: Catalog) -> DataFrame:
    found = _frames(c).withColumn("version", F.col("signature") % 10)
    return frames.ordered(found, "version", descending=True).limit(40).select("signature", "version")


@query
def header_order_fallback(c: Catalog) -> DataFrame:
    return frames.ordered(_frames(c), "nothing").limit(40).select("signature")


@query
def replayed_versions(c: Catalog) -> DataFrame:
    log = versions.replayed(c.frame("events").select(F.col("event_id").alias("sequence"), "user_id", "event_type"), "user_id")
    return versions.latest(log, "user_id", ["_seq", "_op"]).select("user_id", "sequence", "event_type")


@query
def scalar_keys(c: Catalog) -> DataFrame:
    part = c.frame("part")
    return part.select("p_partkey", scalar.canonical_key(F.col("p_size")).alias("size_key"), scalar.sort_key(F.col("p_name")).alias("sort_key"), scalar.size_bucket(F.col("p_size")).alias("bucket"))
