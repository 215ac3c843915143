import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import scalar
from docloom.operators import audit, frames, identity, indexes, lifecycle, packets, versions
from docloom.operators.predicates import like, like_contains, like_prefix
from docloom.plans import cost, frontends
from docloom.plans.catalog import Catalog
from docloom.plans.plan import CollectionConfig, PlanError, QueryPlan, Relation, Where
from docloom.plans.service import Overloaded, Service
from docloom.plans.views import AccessDenied, ViewDefinition, Views
from docloom.sources.changelog import ChangeLog, replay
from docloom.streaming import replication


@pytest.fixture
def posts(spark):
    rows = [(i, f"post-{i}", "published" if i % 2 else "draft", 1000 + i) for i in range(1, 51)]
    frame = spark.createDataFrame(rows, "id long, slug string, status string, updated_at long")
    return Catalog(spark).add("posts", frame, CollectionConfig("id", updated_field="updated_at", sort_fields=("updated_at",)))


def test_topk_prefix_and_implicit_order(posts):
    q = posts.collection("posts")
    assert sorted(r.slug for r in q.where("slug", "like", "post-4%").limit(20).fetch()) == sorted(["post-4", *[f"post-4{i}" for i in range(10)]])
    assert [r.id for r in q.limit(3).fetch()] == [50, 49, 48]
    assert [r.id for r in q.order_by("updated_at").limit(2).offset(1).fetch()] == [2, 3]
    assert q.count().first().n == 50 and q.where("id", "=", 7).fetch_one().first().slug == "post-7"


def test_missing_fields_and_kinds_match_nothing(spark):
    c = Catalog(spark).add("t", spark.createDataFrame([(1, None, "x"), (2, 5, None)], "id long, n long, s string"))
    t = c.collection("t")
    ids = lambda q: [r.id for r in q.fetch()]
    assert ids(t.where("n", "!=", 7)) == [2]
    assert ids(t.where("s", "!=", 5)) == [] and ids(t.where("nothing", "=", 1)) == []
    assert ids(t.where("n", "is_null")) == [1] and ids(t.where("n", "in", [5, "x"])) == [2]
    assert [r.id for r in t.order_by("n").fetch()] == [1, 2] and [r.id for r in t.order_by("n", "desc").fetch()] == [2, 1]


def test_like_against_a_model(spark):
    def model(s, p):
        if not p:
            return not s
        if p[0] == "%":
            return any(model(s[i:], p[1:]) for i in range(len(s) + 1))
        return bool(s) and (p[0] in ("_", s[0])) and model(s[1:], p[1:])

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\\%_\n") for _ in range(rng.randrange(6))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for pattern in ["", "%", "a%", "%b%", "_", "a_%", "%%", "\\%", "%\\_a", "b%a", *["".join(rng.choice("ab%_\\") for _ in range(4)) for _ in range(12)]]:
        got = [r[0] for r in df.select(like(F.col("s"), pattern)).collect()]
        assert got == [model(t, pattern) for t in texts], pattern
    assert like_prefix("post-9%") == "post-9" and like_prefix("foo_bar%") is None and like_prefix("%") is None
    assert like_contains("%x%") == "x" and like_contains("%%") is None and like_contains("%a%b%") is None


def test_front_doors_agree(posts):
    want = {r.id for r in posts.collection("posts").where("status", "=", "draft").where("updated_at", ">=", 1040).fetch()}
    assert {r.id for r in frontends.find(posts, "posts", filter={"status": "draft", "updated_at": {"$gte": 1040}}).collect()} == want
    assert {r.id for r in frontends.sql(posts, "SELECT * FROM posts WHERE status = 'draft' AND updated_at >= 1040").collect()} == want
    body = {"collection": "posts", "where": [{"field": "status", "op": "=", "value": "draft"}, {"field": "updated_at", "op": "gte", "value": 1040}]}
    assert {r.id for r in frontends.request(posts, body).fetch()} == want


def test_front_doors_reject():
    cases = {
        "where": (frontends.find_plan, "c", {"$where": "1"}, False),
        "op": (frontends.find_plan, "c", {"a": {"$in": [1]}}, False),
        "two sorts": (frontends.find_plan, "c", {}, {"a": 1, "b": 1}, False),
        "no set": (frontends.update_where, "c", {}, {"a": 1}, False),
        "create": (frontends.sql_mutation, "CREATE TABLE t (a int)", False),
        "insert": (frontends.sql_mutation, "INSERT INTO t (id, s) VALUES (1, 'a, = b')", True),
        "null": (Where, "a", "eq", None, False),
    }
    assert frontends.compatibility(cases) == {"total": 7, "passed": 7, "failed": []}
    assert frontends.conditions("a LIKE '%x=1 and y%' AND b <> 2.5") == (Where("a", "like", "%x=1 and y%"), Where("b", "ne", 2.5))
    with pytest.raises(PlanError):
        QueryPlan("c", limit=0)


def test_includes(spark):
    c = Catalog(spark)
    c.add("users", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), CollectionConfig().relate([Relation("orders", "id", "orders", "user_id")]))
    c.add("orders", spark.createDataFrame([(10, 1, 100), (11, 1, 101), (12, 1, 999)], "id long, user_id long, product_id long"), CollectionConfig().relate([Relation("products", "product_id", "products", "id")]))
    c.add("products", spark.createDataFrame([(100, "p"), (101, "q")], "id long, title string"))
    found = {r.id: [x.title for x in r["orders.products"]] for r in c.collection("users").include("orders.products").fetch()}
    assert found == {1: ["p", "q"], 2: []}
    with pytest.raises(PlanError):
        c.collection("users").include("nothing").df()


def test_views(spark, posts):
    views = Views()
    views.define(ViewDefinition("reader", collections=frozenset(["posts"]), include=frozenset(["id", "slug", "status"]), exclude=frozenset(["status"])))
    views.define(ViewDefinition("child", parent="reader", additionally_include=frozenset(["status", "updated_at"])))
    views.define(ViewDefinition("loop", parent="loop2"))
    views.define(ViewDefinition("loop2", parent="loop"))
    views.bind("s", "child")
    child = views.of_session("s")
    assert posts.collection("posts", child).df().columns == ["id", "slug", "updated_at"]
    with pytest.raises(AccessDenied):
        posts.collection("posts", child).where("status", "=", "draft").df()
    with pytest.raises(AccessDenied):
        child.apply(posts.frame("posts"), "users")
    for bad in ("loop", "none"):
        with pytest.raises(PlanError):
            views.resolve(bad)


def balances(spark, *rows):
    return spark.createDataFrame(rows, "id long, balance long")


def tuples(df):
    return {tuple(r) for r in df.collect()}


def test_version_store(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "v"), "id long, balance long")
    t = store.begin()
    t.upsert(balances(spark, (1, 100), (2, 5)))
    assert tuples(t.read()) == {(1, 100), (2, 5)} and store.read().isEmpty()
    first = t.commit()
    reader, writer = store.begin(), store.begin()
    writer.update((Where("id", "eq", 1),), {"balance": 50})
    writer.delete((Where("id", "eq", 2),))
    writer.commit()
    assert tuples(reader.read()) == {(1, 100), (2, 5)}
    assert tuples(store.read()) == {(1, 50)}
    reader.upsert(balances(spark, (1, 7)))
    with pytest.raises(versions.Conflict):
        reader.commit()
    late = store.begin()
    late.upsert(balances(spark, (3, 1)))
    late.rollback()
    with pytest.raises(PlanError):
        store.begin().update((), {"id": 3})
    with pytest.raises(PlanError):
        store.begin().upsert(spark.range(2).withColumn("other", F.lit(1)))
    null = store.begin()
    null.upsert(balances(spark, (None, 1)))
    with pytest.raises(PlanError):
        null.commit()
    assert store.snapshot() == first + 1


def test_compaction_serves_all_snapshots_from_the_oldest(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "v"), "id long, balance long")
    seen = {}
    for i in range(6):
        t = store.begin()
        t.upsert(balances(spark, (1, i), (10 + i, i)))
        if i == 4:
            t.delete((Where("id", "eq", 10),))
        s = t.commit()
        seen[s] = tuples(store.read())
    open_reader = store.read(3)
    assert store.compact(oldest=3) == 6
    for s, rows in seen.items():
        if s >= 3:
            assert tuples(store.read(s)) == rows, s
        else:
            with pytest.raises(versions.TooOld):
                store.read(s)
    assert tuples(open_reader) == seen[3] and store.log().count() < 12 + 1
    t = store.begin()
    t.upsert(balances(spark, (1, 99)))
    last = t.commit()
    old = versions.Transaction(store, 2)
    old.upsert(balances(spark, (77, 1)))
    with pytest.raises(versions.Conflict):
        old.commit()
    assert store.compact(oldest=last) == last and store.vacuum() >= 7
    assert (1, 99) in tuples(store.read()) and tuples(store.read()) - {(1, 99)} == seen[6] - {(1, 5)} and store.snapshot() == last


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    store = versions.VersionStore(spark, str(tmp_path / "v"), "id long, balance long")
    t = store.begin()
    t.upsert(balances(spark, (1, 1)))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store.files, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            t.commit()
    for i in (2, 3):
        again = store.begin()
        again.upsert(balances(spark, (i, i)))
        again.commit()
    assert tuples(store.read()) == {(2, 2), (3, 3)}


def test_the_loser_of_a_race_commits_after_the_winner(spark, tmp_path, monkeypatch):
    store, other = (versions.VersionStore(spark, str(tmp_path / "v"), "id long, balance long") for _ in range(2))
    publish = store.files.publish

    def overtaken(name, text):
        if not other.snapshot():
            t = other.begin()
            t.upsert(balances(spark, (2, 2)))
            t.commit()
        return publish(name, text)

    monkeypatch.setattr(store.files, "publish", overtaken)
    t = store.begin()
    t.upsert(balances(spark, (1, 1)))
    assert t.commit() == 2 and tuples(store.read()) == {(1, 1), (2, 2)} and tuples(store.read(1)) == {(2, 2)}
    assert not store.files.publish("manifest/00000000000000000002", "x") and store.files.read("manifest/00000000000000000002") != "x"


def test_last_row_of_a_batch_wins(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "v"), "id long, balance long")
    t = store.begin()
    t.upsert(balances(spark, *[(i % 7, i) for i in range(700)]).coalesce(1))
    t.commit()
    assert tuples(store.read()) == {(i % 7, i) for i in range(693, 700)}
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 9), (2, None, 1), (1, "c", 3)], "id long, v string, at long")
    assert tuples(versions.last_of_each(rows, "id", "at")) == {(1, "b"), (2, None)}


def test_group_commit():
    policy = versions.GroupCommit(max_batch=3)
    assert [policy.after(1, i) for i in range(4)] == [False, False, True, False] and policy.pending == 1
    timed = versions.GroupCommit(max_batch=100, max_interval=5.0)
    assert [timed.after(1, x) for x in (10.0, 14.0, 15.0, 16.0)] == [False, False, True, False]


def test_mutations_through_the_catalogue(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "v"), "id long, name string, age long")
    c = Catalog(spark).attach("users", store)
    assert frontends.execute(c, "INSERT INTO users (id, name, age) VALUES (1, 'ann', 30)") == 1
    assert c.execute(frontends.insert_one("users", {"id": 2, "name": "bob"})) == 1
    assert c.bulk_insert("users", [{"id": 3, "age": 5}, {"id": 3, "age": 6}, {"id": 1, "name": "ann", "age": 31}], "deferred") == 2
    assert tuples(c.frame("users")) == {(1, "ann", 31), (2, "bob", None), (3, None, 6)}
    assert frontends.execute(c, "UPDATE users SET name = 'x', age = 1 WHERE age >= 6") == 2
    assert c.execute(frontends.update_where("users", {"id": 77}, {"$set": {"age": 1}})) == 0
    assert frontends.execute(c, "DELETE FROM users WHERE name = 'bob'") == 1
    assert tuples(frontends.execute(c, "SELECT id, age FROM users WHERE age = 1")) == {(1, 1), (3, 1)}
    for bad in ([{"name": "no key"}], [{"id": True}], [{"id": 1, "other": 2}], [{"id": i} for i in range(5)]):
        with pytest.raises(PlanError):
            c.bulk_insert("users", bad, most=4)
    with pytest.raises(PlanError):
        c.bulk_insert("users", [{"id": 1}], "sometimes")
    with pytest.raises(PlanError):
        Catalog(spark).add("t", spark.range(1)).execute(frontends.insert_one("t", {"id": 1}))


def test_write_rights(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "v"), "id long, name string, secret string")
    c = Catalog(spark).attach("users", store)
    views = Views()
    views.define(ViewDefinition("reader", collections=frozenset(["users"]), include=frozenset(["id", "name"])))
    views.define(ViewDefinition("writer", parent="reader", mutations=frozenset(["users"])))
    reader, writer = views.resolve("reader"), views.resolve("writer")
    for change in (frontends.insert_one("users", {"id": 1}), frontends.delete_where("users", {})):
        with pytest.raises(AccessDenied):
            c.execute(change, reader)
    with pytest.raises(AccessDenied):
        c.bulk_insert("users", [{"id": 1}], view=reader)
    assert c.execute(frontends.insert_one("users", {"id": 1, "secret": "s"}), writer) == 1
    with pytest.raises(AccessDenied):
        c.execute(frontends.delete_where("users", {"secret": "s"}), writer)


def test_service(spark, tmp_path):
    c = Catalog(spark).attach("users", versions.VersionStore(spark, str(tmp_path / "v"), "id long, slug string, age long"))
    s = Service(c, most_requests=1, slow_ms=0.0, most_bulk=3)
    assert s.bulk("users", [{"id": i, "slug": f"s{i}", "age": 10 * i} for i in range(3)])["inserted"] == 3
    assert s.query("users", {"age": {"$gte": 10}}, {"age": -1}, 5)["rows"] == [{"id": 2, "slug": "s2", "age": 20}, {"id": 1, "slug": "s1", "age": 10}]
    with pytest.raises(PlanError):
        s.bulk("users", [{"id": i} for i in range(4)])
    assert s._request("outer", lambda: pytest.raises(Overloaded, s.insert_one, "users", {"id": 9})) and s.metrics.rejected == 1
    assert s.metrics.failed == 1 and s.metrics.slow == s.metrics.requests == len(s.slow_log) and s.metrics.by_field == {"users.age": 1}
    s.add_sort_index("users", "age")
    assert s.add_composite("users", "slug", "age")["indexes"]["composite"] == [["slug", "age"]]
    s.configure("users", exact_fields=["slug", " "])
    # the configuration is kept beside the store
    again = Catalog(spark).attach("users", versions.VersionStore(spark, str(tmp_path / "v"), "id long, slug string, age long"))
    assert again.config("users").sort_fields == ("age",) and again.config("users").composites == (("slug", "age"),) and again.config("users").exact_fields == ("slug",)
    assert again.configure("users", exact_fields=[]).exact_fields == ()
    assert s.status()["total_records"] == 3 and s.collections()["collections"][0]["bytes"] > 0 and s.sync("users")["snapshot"] == 1
    root = str(tmp_path / "i")
    s.rebuild("users", root)
    kept = indexes.IndexCatalogue.load(spark, root)
    assert (kept.hash_fields, kept.range_fields, kept.composites) == (("slug",), ("age",), (("slug", "age"),))
    assert [r.id for r in kept.exact("slug", "s1").collect()] == [1] and {r.id for r in kept.between("age", 0, 20, low_open=True).collect()} == {1, 2}
    assert [r.id for r in kept.top("slug", "s2", "age", 1).collect()] == [2]
    for bad in (lambda: kept.exact("age", 1), lambda: indexes.IndexCatalogue.load(spark, str(tmp_path / "none"))):
        with pytest.raises(PlanError):
            bad()


def test_views_hold_for_related_collections(spark):
    c = Catalog(spark)
    c.add("a", spark.createDataFrame([(1, 5, "x")], "id long, secret_id long, note string"), CollectionConfig().relate([Relation("s", "secret_id", "secret", "id"), Relation("t", "secret_id", "open", "id"), Relation("note", "secret_id", "open", "id")]))
    c.add("secret", spark.createDataFrame([(5, "123")], "id long, ssn string"))
    c.add("open", spark.createDataFrame([(5, "name", "123")], "id long, title string, ssn string"))
    views = Views()
    views.define(ViewDefinition("v", collections=frozenset(["a", "open"]), include=frozenset(["id", "title", "note"]), masks={"title": F.lit("***")}))
    v = views.resolve("v")
    for path in ("s",):
        with pytest.raises(AccessDenied):
            c.collection("a", v).include(path).df()
        with pytest.raises(AccessDenied):
            c.collection("a", v).related(path)
        with pytest.raises(AccessDenied):
            c.collection("a", v).include_count(path)
    row = c.collection("a", v).include("t").fetch()[0]
    assert row.asDict(recursive=True) == {"id": 1, "note": "x", "t": [{"id": 5, "title": "***"}]}
    assert c.collection("a", v).related("t").collect()[0].asDict() == {"id": 1, "note": "x", "t.id": 5, "title": "***"}
    assert c.collection("a", v).include_count("t").collect()[0].asDict() == {"id": 1, "note": "x", "n_related": 1}
    with pytest.raises(PlanError):
        c.collection("a").include("note").df()
    assert [tuple(r) for r in frontends.sql(c, "SELECT id, title FROM open LIMIT 3", v).collect()] == [(5, "***")]
    for text in ("SELECT ssn FROM open", "SELECT * FROM secret", "SELECT id FROM open WHERE ssn = '123'", "SELECT id FROM open UNION SELECT id FROM secret", "SELECT max(ssn) FROM open"):
        with pytest.raises(PlanError):
            frontends.sql(c, text, v)


def test_frames_and_packets_buffer(spark):
    entries = spark.createDataFrame([(i, x) for i, x in enumerate(["alpha", "beta", "", None, "gamma"])], "seq long, payload string")
    stored = audit.materialised(entries, "seq", "payload", "c")
    ids = lambda df: [r.signature for r in df.collect()]
    assert ids(frames.matching(stored, Where("_payload", "eq", "beta"))) == [1] and ids(frames.matching(stored, Where("_payload", "gt", "alpha"))) == [1, 4]
    assert ids(frames.matching(stored, Where("_payload", "like", "%a"), Where("_signature", "eq", 4))) == [4] and ids(frames.matching(stored, Where("other", "eq", "x"))) == []
    first = stored.where("signature = 0").collect()[0]
    assert first.symbols.startswith("1201") and len(first.mirror) == len(first.symbols) and first.entries[0].value_hash == frames.fnv1a64_of(b"alpha")
    queue = [("p2", "n", 2), ("p1", "n", 1), ("p3", "m", 9)]
    df = lambda rows: spark.createDataFrame(rows, "packet_id string, node string, origin_sequence long")
    buffer = packets.buffered(df(queue[:2]), df(queue[1:]))
    assert [r.packet_id for r in buffer.collect()] == ["p3", "p1", "p2"]
    rest = packets.catch_up(buffer, spark.createDataFrame([("p1",)], "packet_id string"), spark.createDataFrame([("n", 1)], "node string, high long"))
    assert [r.packet_id for r in rest.collect()] == ["p3", "p2"]


def test_replayed_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "id long, v string")
    log.append(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), "id")
    log.append(spark.createDataFrame([(1, "c"), (None, "lost")], "id long, v string"), "v")
    assert {(r.id, r.v) for r in versions.latest(versions.replayed(log.read(), "id"), "id", ["_seq", "_op"]).collect()} == {(1, "c"), (2, "b")}


def test_background_writer(spark, tmp_path):
    spark.range(30).selectExpr("id as sequence", "cast(id as string) as payload").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("sequence long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        replication.materialise(stream(), lambda df: audit.materialised(df, "sequence", "payload", "c"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 30 and done.where("crc = crc32(payload)").count() == 30


def test_change_log_and_replica(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "id long, v string")
    assert log.append(spark.createDataFrame([(i, f"a{i}") for i in range(20)], "id long, v string"), "id") == 20
    assert log.append(spark.createDataFrame([(i, f"b{i}") for i in range(5)], "id long, v string"), "id") == 25
    assert [r.sequence for r in log.read().collect()] == list(range(1, 26)) and [r.v for r in log.read(21, 2).collect()] == ["b0", "b1"]
    target, checkpoint = str(tmp_path / "r"), str(tmp_path / "c")
    for _ in range(2):
        replication.replicate(spark, f"{log.path}/log", log.schema, target, checkpoint).awaitTermination()
    assert replication.replica(spark, target).count() == 25
    assert {r.id: r.v for r in replication.replica_state(spark, target, "id").collect()}[3] == "b3"
    assert replay(log.read(), replication.replica(spark, target).where("sequence < 24")).count() == 2
    assert log.truncate() == 25 and log.append(spark.createDataFrame([(1, "c")], "id long, v string"), "id") == 26


def test_scalars(spark):
    raw = [b"", b"a", b"foobar", bytes(range(256)), None]
    df = spark.createDataFrame([(x,) for x in raw], "b binary")
    got = df.select(scalar.fnv1a64("b").alias("h"), scalar.base4_encode(F.col("b")).alias("s"), scalar.base4_decode(scalar.base4_encode(F.col("b")), F.length("b")).alias("back")).collect()

    def fnv(x):
        h = 0xCBF29CE484222325
        for b in x:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    for x, r in zip(raw[:-1], got):
        assert r.h == fnv(x) and bytes(r.back) == x and len(r.s) % 3 == 0
    assert got[-1].h is None
    ids = [r[0] for r in spark.createDataFrame([("users",), ("users",), ("orders",)], "n string").select(scalar.stable_id(F.col("n"))).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert [r[0] for r in spark.range(5).select(scalar.size_bucket(F.col("id"))).collect()] == [0, 0, 1, 1, 2]
    assert spark.range(1).select(scalar.hex_signature(F.lit(b"\x0f\xa0"))).first()[0] == "0fa0"
    broken = spark.createDataFrame([("0123", "3211")], "a string, b string").select(scalar.broken_positions(F.col("a"), F.col("b"))).first()[0]
    assert broken == [3]
    assert spark.createDataFrame([("abcab",), ("ab",), (None,)], "t string").select(scalar.trigrams(F.col("t"))).collect()[0][0] == ["abc", "bca", "cab"]


def test_pruning_is_sound(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.uniform(-50, 50), rng.randrange(30)) for i in range(500)], "id long, x double, k long")
    stats = indexes.segment_stats(df, "id", 64, x="x")
    for op, sign in (("lt", "<"), ("gte", ">="), ("eq", "=")):
        for v in (-49.0, 0.0, 48.0):
            kept = indexes.pruned(df, indexes.may_match(stats, "x", op, v), "id", 64)
            assert kept.where(f"x {sign} {v}").count() == df.where(f"x {sign} {v}").count()
    hits = {r.segment_id for r in indexes.bloom_candidates(indexes.bloom_bits(df, "k", "id", 64), 7).collect()}
    assert {r.id // 64 for r in df.where("k = 7").collect()} <= hits
    assert all(r.complete for r in indexes.dictionary_coverage(df, indexes.value_dictionary(df, "k", "id", 64), "k", "id", 64).collect())


def test_audit_chain(spark):
    entries = spark.createDataFrame([(str(i % 3), i, "read") for i in range(60)], "who string, seq long, operation string")
    chain = audit.chained(entries, "who", "seq").cache()
    assert audit.first_broken(chain, "who", "seq").isEmpty()
    tampered = chain.withColumn("operation", F.when(F.col("seq") == 31, "write").otherwise(F.col("operation")))
    assert [tuple(r) for r in audit.first_broken(tampered, "who", "seq").collect()] == [("1", 31)]
    for lost, where in (("entry_hash", 1), ("prev_hash", 1), ("entry_hash", 58)):  # 58 is the last of its chain
        holed = chain.withColumn(lost, F.when(F.col("seq") != where, F.col(lost)))
        assert [tuple(r) for r in audit.first_broken(holed, "who", "seq").collect()] == [(str(where % 3), where)]
    whole = spark.createDataFrame([("a", 1, None), ("a", 2, 7), (None, 3, 2**60 + 1)], "who string, seq long, n long")
    assert {(r.seq, r.n) for r in audit.chained(whole, "who", "seq").collect()} == {(1, None), (2, 7), (3, 2**60 + 1)}
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, p string")
    sums = audit.with_checksum(stored, "p").where("id < 3").withColumn("crc", F.when(F.col("id") == 2, 0).otherwise(F.col("crc")))
    assert tuple(audit.scrub(stored, sums, "id", "p").first()) == (2, 1, 1)


def test_lifecycle(spark):
    df = spark.createDataFrame([(1, 300.0, False), (1, 300.1, False), (1, 604800.0, False), (1, 604801.0, False), (0, 1.0, False), (0, 1.0, True)], "n long, idle double, immortal boolean")
    assert [r[0] for r in df.select(lifecycle.temperature(F.col("n"), F.col("idle"), F.col("immortal"))).collect()] == ["Hot", "Warm", "Warm", "Cold", "Frozen", "Hot"]
    now, hour = 10**18, 3600 * 10**9
    blocks = [(1, "Cold", now - 1000), (2, "Warm", now - 200 * hour), (3, "Warm", now), (4, "Warm", now - hour), (5, "Warm", now - hour), (6, "Frozen", now - 200 * hour), (7, "Hot", now - hour), (8, "Cold", now)]
    df = spark.createDataFrame(blocks, "block_id long, temperature string, last_access_ns long")
    stats = df.select("block_id", "last_access_ns", F.when(F.col("block_id").isin(3, 4), 2).otherwise(1).alias("access_count_recent")).where("block_id < 8")
    ttl = spark.createDataFrame([(1, 100, True), (2, 100, True), (3, 0, False), (6, 5, False)], "block_id long, count long, immortal boolean")
    moves = {r.block_id: (r.move, r.tier) for r in lifecycle.rebalance(df, stats, ttl, df.where("block_id in (1, 3, 4, 5)"), now).collect()}
    # accessed; idle; spent, however often accessed; in a burst; accessed once; frozen no more; cooled; without counters
    assert moves == {1: ("Promote", "Warm"), 2: ("Compress", "Cold"), 3: ("Freeze", "Frozen"), 4: ("Promote", "Hot"), 5: ("Noop", "Warm"), 6: ("Compress", "Cold"), 7: ("Demote", "Warm"), 8: ("Promote", "Hot")}
    counted = lifecycle.accessed_once_more(stats.withColumn("access_count_total", F.lit(9)), df.where("block_id in (1, 4)"), now)
    assert {r.block_id: (r.access_count_recent, r.access_count_total) for r in counted.where("block_id in (1, 2, 4)").collect()} == {1: (2, 10), 2: (1, 9), 4: (1, 10)}
    one = spark.createDataFrame([(1, "Cold"), (2, "Hot")], "segment_id long, temperature string")
    assert lifecycle.compaction_plan(one).isEmpty() and lifecycle.compaction_plan(one.replace("Hot", "Frozen")).count() == 2


def test_packets(spark):
    p = packets.Packet
    c = packets.SchemaCatalog()
    add = p("1", "users", "add", "age", "n", 1, "integer")
    assert c.absorb(add) and not c.absorb(add)
    report = c.absorb_all([p("2", "users", "rename", "age", "n", 2, new_name="years"), p("3", "users", "drop", "age", "n", 3)])
    assert report["applied"] == 1 and report["error"] and c.coexistence("users", ["years", "age"]) == {"years": "Present", "age": "Absent"}
    with pytest.raises(packets.PacketError):
        c.absorb(p("0", "users", "add", "x", "n", 1))
    assert packets.evolve(spark.range(1), [add, p("2", "users", "rename", "age", "n", 2, new_name="years")]).dtypes == [("id", "bigint"), ("years", "bigint")]


def test_identity():
    who = identity.Identities()
    who.create("ann", "secret", "reader", api_key="k")
    token = who.login("ann", "secret")
    assert who.validate(who.refresh(token)).view == "reader"
    for bad in (lambda: who.login("ann", "no"), lambda: who.validate(token), lambda: who.create("ann", "x", "v")):
        with pytest.raises(identity.AuthError):
            bad()
    assert who.validate(who.login("ann", api_key="k")).name == "ann" and b"secret" not in who.by_name["ann"].password
    assert identity.transport_allowed(True, False, False, False) and identity.transport_allowed(False, True, True, True) is None


def test_cost():
    config = CollectionConfig(exact_fields=("email", "status"))
    plan = QueryPlan("users", (Where("status", "eq", "a"), Where("email", "eq", "b")))
    assert cost.explain_path(plan, config, 10**6, {"status": 0.5, "email": 0.001}).field == "email"
    assert cost.explain_path(QueryPlan("users", (Where("status", "eq", "a"),)), config, 10**6, {"status": 0.9}, 0.95).kind == "scan"
    assert cost.explain_path(QueryPlan("users", (Where("id", "eq", 1),)), config, 10, {}).kind == "direct"


def test_streaming_fetch(posts):
    seen = []
    assert posts.collection("posts").order_by("id").limit(3).stream(lambda r: seen.append(r.id) or len(seen) < 2) == (1, 2)


def test_digest(spark):
    assert spark.range(1).select(audit.digest(F.lit("1"), F.lit("x"))).first()[0] == hashlib.sha256(b"1|x").hexdigest()
