"""Sources and sinks: whole tables written in the layouts they read, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitystats.operators import lines as L
from entitystats.plans.registry import query
from entitystats.plans.rounding import rounded
from entitystats.session import scratch_folder
from entitystats.sources import catalog, files

#: Kinds of events in the test tables.
KINDS = ["click", "error", "purchase", "signup", "view"]


def _rename(spark, pattern: str, to) -> None:
    """Give each file of a pattern the path that ``to(its path)`` names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(pattern).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(hadoop.Path(pattern)):
        fs.rename(status.getPath(), hadoop.Path(to(status.getPath())))


def _named_files(rows: DataFrame, folder: str, kind: str, suffix: str, order: tuple[str, ...] = ()) -> str:
    """One file ``<name><suffix>`` per ``name``, of the other columns, rows in ``order``.

    Spark writes a folder per name; its file is then given the name that the
    readers look for. There are as many renames as names.
    """
    lines = rows.repartition("name").sortWithinPartitions("name", *order).drop(*order)
    lines.write.partitionBy("name").format(kind).save(f"{folder}/_{kind}")
    _rename(rows.sparkSession, f"{folder}/_{kind}/name=*/part-*", lambda p: f"{folder}/{p.getParent().getName().split('=', 1)[1]}{suffix}")
    return folder


@query(
    "game_log_files",
    """
    SELECT c_nationkey::BIGINT AS entity_id, '2024-25' AS season, c_custkey::VARCHAR AS "GAME_ID", c_name AS "PLAYER_NAME" FROM customer
    UNION ALL SELECT (1000 + n_regionkey)::BIGINT, '2023-24', n_nationkey::VARCHAR, n_name FROM nation
    """,
)
def game_log_files(t):
    """Customers as JSON lines per nation, nations as one array per region."""
    folder = scratch_folder(t.spark, "logs")
    game = lambda i, n: F.struct(i.alias("GAME_ID"), n.alias("PLAYER_NAME"))
    rows = t.customer.select(F.format_string("player_%d_2024-25", "c_nationkey").alias("name"), F.to_json(game(F.col("c_custkey"), F.col("c_name"))).alias("value"))
    _named_files(rows, folder, "text", ".jsonl")
    # the nations are a fixed table of 25 rows
    arrays = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(game(F.col("n_nationkey"), F.col("n_name")))).alias("value"))
    _named_files(arrays.select(F.format_string("player_%d_2023-24", F.col("n_regionkey") + 1000).alias("name"), "value"), f"{folder}/arrays", "text", ".json")
    read = lambda base: files.read_game_logs(t.spark, base, fields=["GAME_ID", "PLAYER_NAME"])
    return read(folder).unionByName(read(f"{folder}/arrays")).select("entity_id", "season", "GAME_ID", "PLAYER_NAME")


@query(
    "league_game_lists",
    """
    WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders)
    SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY i) AS keys, round(3.14159e-9 + max(o_totalprice) FILTER (i = 1), 6) AS newest FROM r WHERE i <= 5 GROUP BY o_custkey
    """,
)
def league_game_lists(t):
    """The five newest orders of every customer as one list, newest first."""
    out = files.league_games(t.orders, "o_custkey", "o_orderkey", ["o_totalprice"], 5)
    keys = F.array_join(F.transform("games", lambda g: g["o_orderkey"].cast("string")), ",")
    return rounded(out.select("o_custkey", keys.alias("keys"), F.col("games")[0]["o_totalprice"].alias("newest")))


@query(
    "audit_lines",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN '2024-01-02' ELSE '2024-01-01' END AS ingest_date, event_type, count(*) AS copies FROM (
        SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'error'
    ) GROUP BY ALL
    """,
)
def audit_lines(t):
    """Events appended to the audit in three batches, one of them a second time."""
    path = scratch_folder(t.spark, "audit")
    rows = t.events.select("event_id", "event_type")
    failed = rows.filter("event_type = 'error'")
    for batch, day in ((rows.filter("event_type <> 'error'"), "2024-01-01"), (failed, "2024-01-02"), (failed, "2024-01-02")):
        files.append_audit(batch, path, day)
    back = t.spark.read.schema("event_id bigint, event_type string, ingest_date string").json(path)
    return back.groupBy("event_id", "ingest_date", "event_type").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "tolerant_lines",
    """
    SELECT doc_id::VARCHAR AS id, md5(text) AS digest, lang FROM documents WHERE doc_id % 7 <> 0 AND length(text) > 0
    """,
)
def tolerant_lines(t):
    """Documents under three id and two text fields; every seventh line is cut off, some blank lines follow."""
    kind = F.col("doc_id") % 5
    named = lambda on, column: F.when(on, column)
    ident = F.col("doc_id").cast("string")
    item = F.to_json(
        F.struct(
            named(kind > 1, ident).alias("id"), named(kind == 0, ident).alias("source_id"), named(kind == 1, ident).alias("news_id"),
            named(F.col("doc_id") % 3 > 0, F.col("text")).alias("text"), named(F.col("doc_id") % 3 == 0, F.col("text")).alias("content"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("meta"),
        )
    )
    line = F.when(F.col("doc_id") % 7 == 0, F.substring(item, F.lit(1), F.length(item) - 2)).otherwise(item)
    path = scratch_folder(t.spark, "items")
    t.documents.select(F.explode(F.when(F.col("doc_id") % 11 == 0, F.array(line, F.lit(" "))).otherwise(F.array(line))).alias("value")).write.text(path)
    return files.read_items(t.spark, path).select("id", F.md5("text").alias("digest"), F.col("meta")["lang"].alias("lang"))


@query(
    "raw_game_lines",
    """
    SELECT o_orderkey::VARCHAR AS game_id, o_orderpriority AS stat_type, o_totalprice AS value FROM orders
    """,
)
def raw_game_lines(t):
    path = scratch_folder(t.spark, "raw")
    t.orders.select(F.to_json(F.struct(F.col("o_orderkey").alias("game_id"), F.col("o_orderpriority").alias("stat_type"), F.col("o_totalprice").alias("value"))).alias("value")).write.text(path)
    return files.read_raw_games(t.spark, path).select("game_id", "stat_type", F.col("value").cast("double").alias("value"))


@query(
    "tracking_files",
    """
    SELECT 'n' || s_nationkey AS entity, s_suppkey::VARCHAR AS touches, CASE WHEN s_nationkey % 3 = 1 THEN 'on, "' || s_name || '"' ELSE s_name END AS game_date FROM supplier
    """,
)
def tracking_files(t):
    """Suppliers per nation as JSON, CSV with quoted cells, or Parquet; a CSV beside a JSON file is not read."""
    base = scratch_folder(t.spark, "tracking")
    rows = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("name"), F.col("s_nationkey") % 3 == 0, F.col("s_nationkey") % 3 == 1, "s_suppkey", "s_name").toDF(
        "name", "is_json", "is_csv", "touches", "day"
    )
    record = F.to_json(F.struct("touches", F.col("day").alias("game_date")))
    # JSON files hold one list each, so the list is written over several lines: a head, the rows, an end
    part = rows.filter("is_json").select("name", F.lit(1).alias("at"), "touches", F.concat(record, F.lit(",")).alias("value"))
    names = rows.filter("is_json").select("name").distinct()
    ends = names.select("name", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit('{"rows": [').alias("value")), F.struct(F.lit(2).alias("at"), F.lit("null]}").alias("value")))).alias("e"))
    listed = part.unionByName(ends.select("name", "e.at", F.lit(0).cast("bigint").alias("touches"), "e.value"))
    _named_files(listed.drop("touches"), base, "text", ".json", ("at",))
    quoted = F.concat(F.lit('"on, ""'), "day", F.lit('"""'))
    cells = rows.filter("is_csv").select("name", F.lit(1).alias("at"), F.concat(quoted, F.lit(",x,"), F.col("touches").cast("string")).alias("value"))
    heads = rows.filter("is_csv OR is_json").select("name").distinct().select("name", F.lit(0).alias("at"), F.lit("game_date,note,touches").alias("value"))
    _named_files(heads.unionByName(cells), f"{base}/csv", "text", ".csv", ("at",))
    _rename(t.spark, f"{base}/csv/*.csv", lambda p: f"{base}/{p.getName()}")
    rest = rows.filter("NOT is_csv AND NOT is_json").select("name", "touches", F.col("day").alias("game_date"))
    _named_files(rest, base, "parquet", ".parquet")
    return files.read_tracking(t.spark, base).filter("touches IS NOT NULL").select("entity", "touches", "game_date")


@query(
    "news_bodies",
    """
    SELECT 'd' || doc_id AS key, md5(CASE WHEN doc_id % 5 = 3 THEN '' WHEN doc_id % 5 = 4 THEN 'a, b ' || source || chr(10) || coalesce(lang, '') || ' "x"' ELSE text END) AS digest
    FROM documents WHERE length(text) > 0
    """,
)
def news_bodies(t):
    """Every document as the body of a news file: plain text, JSON object or list, cut-off JSON, quoted CSV."""
    kind = F.col("doc_id") % 5
    body = (
        F.when(kind == 1, F.to_json(F.struct("text"))).when(kind == 2, F.to_json(F.array("text")))
        .when(kind == 3, F.concat(F.lit('{"text": "'), "source")).when(kind == 4, F.concat(F.lit('"a, b",'), "source", F.lit("\n\n"), F.coalesce("lang", F.lit("")), F.lit(',"""x"""\n'))).otherwise(F.col("text"))
    )
    suffix = F.when(kind == 0, ".txt").when(kind == 4, ".csv").otherwise(".json")
    rows = t.documents.filter("length(text) > 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), body.alias("text"), suffix.alias("suffix"))
    return files.texts_of(rows, "text", "suffix").select("key", F.md5("text").alias("digest"))


@query(
    "dataset_export",
    """
    SELECT part, key, rows, n, round(3.14159e-7 + total, 4) AS total, (SELECT count(*) FROM lineitem) AS manifest_rows FROM (
        SELECT 'features' AS part, l_returnflag AS key, count(*) AS n, sum(l_quantity) AS total, (SELECT count(*) FROM lineitem) AS rows FROM lineitem GROUP BY 2
        UNION ALL SELECT 'labels', l_linestatus, count(*), sum(l_quantity), (SELECT count(*) FROM lineitem) FROM lineitem GROUP BY 2
    )
    """,
)
def dataset_export(t):
    """Line items exported with labels as Parquet and read back through the latest manifest."""
    base = scratch_folder(t.spark, "sets")
    catalog.export_dataset(t.lineitem.select("l_returnflag", "l_quantity"), base, "lines", labels=t.lineitem.select("l_linestatus", "l_quantity"), version="v1", uid="a")
    got = catalog.latest_dataset(t.spark, base, "lines")
    out = []
    for part, key in (("features", "l_returnflag"), ("labels", "l_linestatus")):
        rows = t.spark.read.parquet(got["files"][part])
        out.append(rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")).select(F.lit(part).alias("part"), "*"))
    both = out[0].unionByName(out[1])
    total = F.lit(got["rows"]).cast("bigint")
    return rounded(both.select("part", "key", total.alias("rows"), "n", "total", total.alias("manifest_rows")), 4)


_SPLIT = "CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'val' ELSE 'test' END"


@query(
    "dataset_versions",
    f"""
    SELECT split, count(*) AS n, sum(o_custkey)::BIGINT AS keys, count(*) AS manifest_rows FROM (SELECT *, {_SPLIT} AS split FROM orders) GROUP BY split
    """,
)
def dataset_versions(t):
    """Orders as a version of three splits; each is read from its own partition and held against the manifest."""
    base = scratch_folder(t.spark, "versions")
    made = catalog.create_version(t.orders.select("o_orderkey", "o_custkey", F.expr(_SPLIT).alias("split")), base, "orders", "2024-25", version="v1", uid="a")
    parts = [
        catalog.read_version(t.spark, made, s).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))
        .withColumn("manifest_rows", F.lit(made[f"rows_{s}"]).cast("bigint"))
        for s in catalog.SPLITS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "dataset_listing",
    """
    SELECT * FROM (
        SELECT 'customers' AS name, 'v1' AS version, 1 AS place, (SELECT count(*) FROM customer) AS rows, false AS latest
        UNION ALL SELECT 'customers', 'v2', 2, (SELECT count(*) FROM customer WHERE c_acctbal > 0), true
        UNION ALL SELECT 'parts', 'v1', 3, (SELECT count(*) FROM part), true
    )
    """,
)
def dataset_listing(t):
    """Three exported data sets in the order of their making, and which is the latest of its name."""
    base = scratch_folder(t.spark, "listing")
    for df, name, version, fmt in ((t.customer, "customers", "v1", "parquet"), (t.customer.filter("c_acctbal > 0"), "customers", "v2", "csv"), (t.part, "parts", "v1", "parquet")):
        catalog.export_dataset(df, base, name, fmt=fmt, version=version, uid="u")
    newest = {name: catalog.latest_dataset(t.spark, base, name)["version"] for name in ("customers", "parts")}
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("created_at"))  # of three manifests
    made = catalog.list_datasets(t.spark, base).withColumn("place", place)
    latest = F.element_at(F.create_map(*[F.lit(x) for pair in newest.items() for x in pair]), F.col("name")) == F.col("version")
    return made.select("name", "version", "place", "rows", latest.alias("latest"))


@query(
    "dataset_registry",
    """
    SELECT 'suppliers' AS name, 'v1' AS version, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS rows, false AS latest
    UNION ALL SELECT 'suppliers', 'v2', (SELECT count(*) FROM supplier), true
    """,
)
def dataset_registry(t):
    """Two versions, the first registered twice; its last entry counts."""
    base, registry = scratch_folder(t.spark, "sets"), scratch_folder(t.spark, "registry")
    first = catalog.export_dataset(t.supplier.filter("s_acctbal > 0"), base, "suppliers", version="v1", uid="u")
    second = catalog.export_dataset(t.supplier, base, "suppliers", version="v2", uid="u")
    for manifest in ({**first, "rows": -1}, second, first):
        catalog.register(t.spark, registry, manifest)
    newest = catalog.latest_registered(t.spark, registry, "suppliers")["version"]
    return catalog.registered(t.spark, registry).select("name", "version", F.get_json_object("manifest", "$.rows").cast("bigint").alias("rows"), (F.col("version") == newest).alias("latest"))


@query(
    "csv_export",
    """
    SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority || ', "x"' AS note FROM orders
    """,
)
def csv_export(t):
    """Orders as CSV with times and dates in ISO form and quoted cells, read as text."""
    path = scratch_folder(t.spark, "csv")
    note = F.concat("o_orderpriority", F.lit(', "x"'))
    files.export_csv(t.orders.select("o_orderkey", F.col("o_orderdate").alias("at"), F.col("o_orderdate").cast("date").alias("day"), note.alias("note")), path)
    return t.spark.read.csv(path, header=True, escape='"')


@query(
    "naive_times",
    "SELECT event_id, ts + INTERVAL (event_id % 5) HOUR AS ts FROM events",
)
def naive_times(t):
    """Times written with a zone of 0 to 4 hours west come back as plain UTC times."""
    path = scratch_folder(t.spark, "naive")
    zone = F.format_string("-%02d:00", F.col("event_id") % 5)
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    files.rewrite_parquet(t.events.select("event_id", text.alias("ts")), "ts", path)
    return t.spark.read.parquet(path)


@query(
    "feed_files",
    """
    SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 THEN c_name ELSE 'Unknown' END AS player, o_orderpriority AS stat, o_totalprice AS line
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
    """,
)
def feed_files(t):
    """A feed document per order, every second one a bare array without includes."""
    ref = lambda c: F.struct(F.struct(c.cast("string").alias("id")).alias("data"))
    attributes = F.struct(F.col("o_orderpriority").alias("stat_type"), F.col("o_totalprice").alias("line_score"), F.when(F.col("o_orderstatus") == "O", "pre_game").otherwise("final").alias("status"))
    item = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("projection").alias("type"), attributes.alias("attributes"), F.struct(ref(F.col("o_custkey")).alias("new_player")).alias("relationships"))
    player = F.struct(F.col("c_custkey").cast("string").alias("id"), F.lit("new_player").alias("type"), F.struct(F.col("c_name").alias("name")).alias("attributes"))
    body = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.array(item).alias("data"), F.array(player).alias("included")))).otherwise(F.to_json(F.array(item)))
    docs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(body.alias("value"))
    path = scratch_folder(t.spark, "feed")
    docs.write.text(path)
    # includes are looked up by id over the whole feed, so the bare arrays name customers of their own
    return L.flatten_feed(files.read_feed(t.spark, path, lines=True).withColumn("data", _own_players(F.col("data")))).select("id", "player", "stat", "line")


def _own_players(data):
    """Odd orders point at a player that no document includes."""
    missing = lambda d: F.when(d["id"].cast("bigint") % 2 == 1, F.lit("none")).otherwise(d["relationships"]["new_player"]["data"]["id"])
    return F.transform(data, lambda d: d.withField("relationships.new_player.data.id", missing(d)))


@query(
    "report_files",
    """
    SELECT kind, event_type, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (VALUES ('csv'), ('json')) k(kind)
    """,
)
def report_files(t):
    """A report per event type as one CSV and one JSON file."""
    report = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    base = scratch_folder(t.spark, "report")
    schema = "event_type string, n bigint"
    out = []
    for kind in ("csv", "json"):
        files.write_report(report, f"{base}/{kind}", kind)
        reader = t.spark.read.schema(schema)
        back = reader.csv(f"{base}/{kind}", header=True) if kind == "csv" else reader.json(f"{base}/{kind}")
        out.append(back.select(F.lit(kind).alias("kind"), "*"))
    return out[0].unionByName(out[1])


@query(
    "name_map_codes",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'N' || lpad(c_nationkey::VARCHAR, 2, '0') WHEN c_custkey % 3 = 1 THEN 'N' || lpad(c_nationkey::VARCHAR, 2, '0') ELSE 'XYZ' END AS code FROM customer
    """,
)
def name_map_codes(t):
    """Nations as a name file; customers name theirs in full, by a last word, or one the file lacks."""
    path = scratch_folder(t.spark, "names")
    code = F.format_string("n%02d", "n_nationkey")
    # a file of 25 names
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("Town"), F.col("n_nationkey").cast("string")), code)))
    t.nation.agg(F.to_json(pairs).alias("value")).write.text(path)
    kind, town = F.col("c_custkey") % 3, F.concat(F.lit("TOWN"), F.col("c_nationkey").cast("string"))
    name = F.when(kind == 0, town).when(kind == 1, F.concat(F.lit("the old  "), town)).otherwise("xyzzy place")
    return files.with_codes(t.customer.select("c_custkey", name.alias("name")), "name", files.read_name_map(t.spark, path)).select("c_custkey", "code")


@query(
    "canonical_csv",
    """SELECT c_name AS player, '2024-25' AS season, c_acctbal AS "PER", CASE WHEN c_custkey % 4 > 0 THEN c_custkey::DOUBLE END AS "WS" FROM customer""",
)
def canonical_csv(t):
    path = scratch_folder(t.spark, "canonical")
    wins = F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey"))
    t.customer.select(F.col("c_name").alias("player"), F.lit("2024-25").alias("season"), F.col("c_acctbal").alias("PER"), wins.alias("WS")).write.csv(path, header=True)
    return files.read_canonical(t.spark, path)


@query(
    "reject_log",
    "SELECT event_type AS kind, user_id::VARCHAR AS id, count(*) AS failures FROM events GROUP BY 1, 2",
)
def reject_log(t):
    """Every event as a reject of its kind, appended in a batch per kind."""
    path = scratch_folder(t.spark, "rejects")
    for kind in KINDS:
        files.append_rejects(t.events.filter(F.col("event_type") == kind), path, kind, "user_id", F.col("props"))
    return files.reject_counts(t.spark, path)


@query(
    "alias_csv",
    "SELECT c_name AS roster_name, c_custkey::VARCHAR AS resolved_id FROM customer WHERE c_custkey % 5 > 1",
)
def alias_csv(t):
    """Names and ids with spaces around them; of five ids one is null and one blank."""
    path = scratch_folder(t.spark, "aliases")
    kind = F.col("c_custkey") % 5
    ident = F.when(kind == 1, "  ").when(kind > 1, F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    t.customer.select(F.concat(F.lit(" "), "c_name").alias("roster_name"), ident.alias("resolved_player_id")).write.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path, header=True)
    return files.read_aliases(t.spark, path)
