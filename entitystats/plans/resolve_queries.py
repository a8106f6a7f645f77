"""Entity and event resolution, name mapping, set operations."""

from pyspark.sql import functions as F

from entitystats.operators import resolve as R
from entitystats.operators import sets as S
from entitystats.plans.registry import query


def _dim(t):
    """Known customers: only those with a positive balance have an external id."""
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey") + 1_000_000).alias("ext_id"),
    ).filter(F.col("name").isNotNull())


@query(
    "resolve_known_entities",
    "SELECT o_orderkey, o_custkey AS entity_id FROM orders",
)
def resolve_known_entities(t):
    """Orders name their customer by external id, or by name when it has none."""
    records = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_name", (F.col("o_custkey") + 1_000_000).alias("ext")
    )
    out, _ = R.resolve_entities(records, _dim(t), "o_orderkey", "c_name", "ext")
    return out.select("o_orderkey", "entity_id")


@query(
    "entities_after_batch",
    """
    WITH top AS (SELECT max(c_custkey) AS m FROM customer),
    fresh AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS rn, s_suppkey FROM supplier)
    SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_custkey + 1000000 END AS ext_id FROM customer
    UNION ALL SELECT m + rn, s_name, s_suppkey + 5000000 FROM fresh, top
    """,
)
def entities_after_batch(t):
    """Suppliers arrive as records no customer matches: one new entity each."""
    records = t.supplier.select("s_suppkey", "s_name", (F.col("s_suppkey") + 5_000_000).alias("ext"))
    _, table = R.resolve_entities(records, _dim(t), "s_suppkey", "s_name", "ext")
    return table




def _games(t):
    return t.orders.groupBy(
        F.col("o_orderdate").alias("game_date"), F.col("o_orderpriority").alias("home_team"), F.col("o_orderstatus").alias("away_team")
    ).agg(F.floor(F.max_by("o_totalprice", "o_orderkey")).alias("score"), F.min("o_orderkey").alias("id"))


@query(
    "resolve_events",
    """
    WITH g AS (SELECT o_orderdate AS game_date, o_orderpriority AS home_team, o_orderstatus AS away_team,
                 CAST(floor(max_by(o_totalprice, o_orderkey)) AS BIGINT) AS score, min(o_orderkey) AS id
          FROM orders GROUP BY ALL),
    old AS (SELECT * FROM g WHERE away_team <> 'P'),
    batch AS (SELECT g.*, (SELECT min(id) FROM old o WHERE o.game_date = g.game_date AND o.home_team = g.home_team AND o.away_team = g.away_team) AS k,
                     (SELECT min(id) FROM old o WHERE o.game_date = g.game_date) AS d FROM g),
    m AS (SELECT *, coalesce(k, d) AS hit FROM batch),
    change AS (SELECT hit AS id, max_by(score, id) AS score FROM m WHERE hit IS NOT NULL GROUP BY hit),
    fresh AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY id) AS id, game_date, home_team, away_team, score FROM m WHERE hit IS NULL)
    SELECT o.id, o.game_date, o.home_team, o.away_team, coalesce(c.score, o.score) AS score FROM old o LEFT JOIN change c USING (id)
    UNION ALL SELECT id, game_date, home_team, away_team, score FROM fresh
    """,
)
def resolve_events(t):
    """A full batch against a table that lacks the pending games."""
    games = _games(t)
    table, _ = R.resolve_events(games, games.filter("away_team <> 'P'"), "id", scores=["score"])
    return table


@query(
    "event_batch_counts",
    """
    WITH g AS (SELECT o_orderdate AS game_date, o_orderpriority AS home_team, o_orderstatus AS away_team,
                 CAST(floor(max_by(o_totalprice, o_orderkey)) AS BIGINT) AS score, min(o_orderkey) AS id
          FROM orders GROUP BY ALL),
    old AS (SELECT * FROM g WHERE away_team <> 'P'),
    m AS (SELECT g.*, coalesce((SELECT min(id) FROM old o WHERE o.game_date = g.game_date AND o.home_team = g.home_team AND o.away_team = g.away_team),
                     (SELECT min(id) FROM old o WHERE o.game_date = g.game_date)) AS hit FROM g),
    change AS (SELECT hit AS id, max_by(score, id) AS score FROM m WHERE hit IS NOT NULL GROUP BY hit)
    SELECT (SELECT count(DISTINCT game_date) FROM m WHERE hit IS NULL) AS inserted,
           (SELECT count(*) FROM change c JOIN old o USING (id) WHERE c.score <> o.score) AS updated
    """,
)
def event_batch_counts(t):
    """Counts under the date-only rule: one new event per unseen time."""
    games = _games(t)
    _, counts = R.resolve_events(games, games.filter("away_team <> 'P'"), "id", scores=["score"], match="date_only")
    return counts


@query(
    "name_mapping",
    """
    WITH r AS (SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN s_name WHEN s_nationkey < 16 THEN upper(s_name)
                      ELSE substr(s_name, 10) END AS roster_name FROM supplier),
    n AS (SELECT DISTINCT s_name, regexp_replace(lower(s_name), '[.,]', '', 'g') AS norm FROM supplier),
    q AS (SELECT roster_name, regexp_replace(lower(roster_name), '[.,]', '', 'g') AS norm FROM r),
    hits AS (SELECT q.roster_name, count(*) FILTER (WHERE n.norm = q.norm) AS strict, count(*) AS total,
                    min(s_name) FILTER (WHERE n.norm = q.norm) AS same, min(s_name) AS part
             FROM q JOIN n ON contains(n.norm, q.norm) OR contains(q.norm, n.norm) GROUP BY q.roster_name)
    SELECT roster_name, CASE WHEN strict > 0 THEN same WHEN total = 1 THEN part END AS mapped,
           CASE WHEN strict > 0 THEN 'strict' WHEN total = 1 THEN 'contains' ELSE 'none' END AS how FROM hits
    """,
)
def name_mapping(t):
    """Supplier names as they are, in capitals, or only their number."""
    roster = t.supplier.select(
        F.when(F.col("s_nationkey") < 8, F.col("s_name")).when(F.col("s_nationkey") < 16, F.upper("s_name"))
        .otherwise(F.substring("s_name", 10, 100)).alias("roster_name")
    )
    return R.map_names(roster, "roster_name", t.supplier, "s_name")


@query(
    "names_to_ids",
    """
    WITH q AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'FURNITURE' THEN lower(c_name)
                   WHEN 'MACHINERY' THEN c_name || ', Jr.' ELSE substr(c_name, 12) END AS asked FROM customer),
    e AS (SELECT c_custkey AS id, c_name, lower(c_name) AS norm FROM customer),
    p AS (SELECT asked, trim(regexp_replace(regexp_replace(lower(asked), '[,.]', '', 'g'), '\\b(jr|sr|ii|iii|iv)\\b', '', 'g')) AS norm FROM q),
    c AS (SELECT p.asked, min(e.id) AS id FROM p JOIN e ON contains(e.norm, p.norm) GROUP BY p.asked)
    SELECT DISTINCT p.asked, coalesce(e1.id, e2.id, e3.id, c.id) AS id,
           CASE WHEN e1.id IS NOT NULL THEN 'exact' WHEN e2.id IS NOT NULL THEN 'case' WHEN e3.id IS NOT NULL THEN 'normalised'
                WHEN c.id IS NOT NULL THEN 'contains' END AS tier
    FROM p LEFT JOIN e e1 ON e1.c_name = p.asked LEFT JOIN e e2 ON e2.norm = lower(trim(p.asked))
    LEFT JOIN e e3 ON e3.norm = p.norm LEFT JOIN c ON c.asked = p.asked
    """,
)
def names_to_ids(t):
    seg = F.col("c_mktsegment")
    asked = t.customer.select(
        F.when(seg == "BUILDING", F.col("c_name")).when(seg == "FURNITURE", F.lower("c_name"))
        .when(seg == "MACHINERY", F.concat("c_name", F.lit(", Jr."))).otherwise(F.substring("c_name", 12, 100)).alias("asked")
    )
    return R.names_to_ids(asked, "asked", t.customer, "c_name", "c_custkey")


@query(
    "mapping_method",
    """
    WITH m AS (SELECT s_name AS roster_name, CASE WHEN s_acctbal > 5000 THEN CAST(s_suppkey AS VARCHAR) END AS resolved_id,
                      CASE WHEN s_nationkey > 12 THEN s_name END AS mapped FROM supplier)
    SELECT *, CASE WHEN resolved_id IS NOT NULL AND mapped IS NOT NULL THEN 'alias+manifest' WHEN resolved_id IS NOT NULL THEN 'alias'
                   WHEN mapped IS NOT NULL THEN 'manifest' ELSE 'none' END AS mapping_method FROM m
    """,
)
def mapping_method(t):
    roster = t.supplier.select(F.col("s_name").alias("roster_name"))
    aliases = t.supplier.select(
        F.col("s_name").alias("roster_name"),
        F.when(F.col("s_acctbal") > 5000, F.col("s_suppkey").cast("string")).otherwise(" ").alias("resolved_id"), F.lit(0).alias("priority"),
    )
    mapped = t.supplier.select(F.col("s_name").alias("roster_name"), F.when(F.col("s_nationkey") > 12, F.col("s_name")).alias("mapped"))
    return R.mapping_method(roster, "roster_name", aliases, mapped)


@query(
    "fill_missing_names",
    """
    SELECT o_orderkey, c_name AS player_name, o_orderstatus = 'P' AS repaired FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def fill_missing_names(t):
    """Pending orders lost the customer name; it comes back by id."""
    dim = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    records = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("c_name")).alias("player_name"),
        F.lit(None).cast("bigint").alias("player_nba_id"), "o_custkey",
    )
    out = R.fill_names(records, dim, ["player_nba_id", "o_custkey"])
    return out.select("o_orderkey", "player_name", "repaired")


@query(
    "fill_empty_columns",
    """
    SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_type WHEN p_brand < 'Brand#2' THEN 'any ' || p_brand
             ELSE 'v1 ' || p_brand END AS kept FROM part
    """,
)
def fill_empty_columns(t):
    """Empty texts are filled by brand; some sources fit any version."""
    target = t.part.select("p_partkey", "p_brand", F.lit("v1").alias("version"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("kept"))
    brands = t.part.select("p_brand").distinct()
    exact = F.col("p_brand") >= "Brand#2"
    source = brands.select(
        "p_brand", F.when(exact, F.lit("v1")).alias("version"),
        F.concat(F.when(exact, "v1 ").otherwise("any "), F.col("p_brand")).alias("kept"),
    )
    return R.fill_empty(target, source, ["p_brand"], "version", "kept").select("p_partkey", "p_brand", "kept")


@query(
    "preferred_model",
    """
    SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'retrained' ELSE 'base' END AS kind,
           CASE WHEN s_acctbal > 0 THEN s_name || '_retrained' ELSE s_name END AS path FROM supplier
    """,
)
def preferred_model(t):
    base = t.supplier.select("s_suppkey", F.lit("base").alias("kind"), F.col("s_name").alias("path"))
    again = t.supplier.filter("s_acctbal > 0").select("s_suppkey", F.lit("retrained").alias("kind"), F.concat("s_name", F.lit("_retrained")).alias("path"))
    return R.prefer_first(base.unionByName(again), "s_suppkey", ["retrained", "base"])


@query(
    "union_parts",
    "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation UNION ALL SELECT r_name, NULL FROM region",
)
def union_parts(t):
    left = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    return S.union_all(left, t.region.select(F.col("r_name").alias("name")))


@query(
    "ordered_distinct",
    "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type",
)
def ordered_distinct(t):
    return S.ordered_distinct(t.events, "event_type", "event_id")


@query(
    "items_not_indexed",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def items_not_indexed(t):
    return S.difference(t.documents.select("doc_id"), t.labels, "doc_id")


@query(
    "subset_by_ids",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def subset_by_ids(t):
    return S.subset(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "keyed_upsert",
    """
    SELECT c_custkey AS k, coalesce(o.p, c_acctbal) AS v FROM customer LEFT JOIN
      (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
    """,
)
def keyed_upsert(t):
    current = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    incoming = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    return S.upsert(current, incoming, "k", "o_orderkey")


@query(
    "keyset_page",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1000",
)
def keyset_page(t):
    """A page is a limit by definition; the next one starts after its last id."""
    return S.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 1000)


@query(
    "versions_to_delete",
    """
    SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    WHERE rn > 3
    """,
)
def versions_to_delete(t):
    return S.keep_newest(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", 3, ["o_orderkey"]).select("o_orderkey")
