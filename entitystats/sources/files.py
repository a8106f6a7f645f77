"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.functions.text import file_key, keyword_flags
from entitystats.operators.lines import FEED_SCHEMA
from entitystats.operators.normalize import GAME_ALIASES
from entitystats.session import join_per_key, settled_small
from entitystats.skew import Timeline, as_list

#: Fields of a game log; everything is read as text and typed later.
LOG_FIELDS = [
    "GAME_DATE", "GAME_ID", "MATCHUP", "WL", "SEASON", "PLAYER_ID", "PLAYER_NAME", "TEAM_ABBREVIATION", "PTS", "OPP_PTS", "AST", "REB", "STL", "BLK",
    "TO", "TOV", "FGA", "FGM", "FG3A", "FG3M", "FTA", "FTM", "MIN", "opponentDefRating",
]
TEXT_SUFFIXES = [".txt", ".md", ".json", ".csv", ".html"]


def text_schema(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def _paths_exist(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_game_logs(spark: SparkSession, base: str, kind: str = "player", fields: Sequence[str] = tuple(LOG_FIELDS)) -> DataFrame:
    """Files ``<kind>_<id>_<season>.json`` (arrays) or ``.jsonl``; no file gives no rows.

    The id and season come from the file name. An array file is read whole by
    one task, so large logs should be JSON lines, which split.
    """
    schema = text_schema(fields)
    parts = []
    for pattern, many in ((f"{base}/{kind}_*.json", True), (f"{base}/{kind}_*.jsonl", False)):
        if _paths_exist(spark, pattern):
            parts.append(spark.read.schema(schema).option("multiLine", many).json(pattern).select("*", F.col("_metadata.file_name").alias("__file")))
    if not parts:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", F.lit(None).cast("bigint").alias("entity_id"), F.lit(None).cast("string").alias("season"))
    rows = reduce(DataFrame.unionByName, parts)
    name = rf"^{kind}_(.+)_([^_]+)\.jsonl?$"
    return rows.select(
        *fields, F.regexp_extract("__file", name, 1).try_cast("bigint").alias("entity_id"), F.regexp_extract("__file", name, 2).alias("season")
    )


def league_games(df: DataFrame, entity: str, ts: str, fields: Sequence[str], n: int) -> DataFrame:
    """Newest-first list of the last n games per entity; n bounds every list."""
    from entitystats.operators.windows import latest_rows

    recent = latest_rows(df, entity, ts, n, [f for f in fields if f != ts], rank="__rn")
    game = F.struct(F.col("__rn"), F.col(ts), *[F.col(f) for f in fields if f != ts])
    return recent.groupBy(entity).agg(F.array_sort(F.collect_list(game)).alias("__g")).select(
        entity, F.transform("__g", lambda g: g.dropFields("__rn")).alias("games")
    )


def append_audit(raw: DataFrame, path: str, when: str) -> None:
    """Append raw records as JSON lines under ``ingest_date=<when>``."""
    raw.withColumn("ingest_date", F.lit(when)).write.mode("append").partitionBy("ingest_date").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank and malformed lines are left out."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])
    text = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = text.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.filter("r IS NOT NULL AND r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, meta) of text items, from any of the usual field names."""
    rows = read_jsonl(spark, path, "id string, source_id string, news_id string, text string, content string, meta map<string,string>")
    first = lambda *n: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in n])
    return rows.select(first("id", "source_id", "news_id").alias("id"), first("text", "content").alias("text"), "meta").filter("id IS NOT NULL AND text IS NOT NULL")


def read_raw_games(spark: SparkSession, path: str, more: Sequence[str] = ("player_name", "player_nba_id", "stat_type", "value", "game_date")) -> DataFrame:
    """Provider records as JSON lines with every known spelling as a text column."""
    names = list(dict.fromkeys([n for a in GAME_ALIASES.values() for n in a] + list(more)))
    return read_jsonl(spark, path, text_schema(names))


def read_tracking(spark: SparkSession, base: str, key: str = "entity") -> DataFrame:
    """Tracking rows from ``<name>.json``, ``.csv`` or ``.parquet``; per name the first kind wins.

    JSON may be a list or an object that holds one. CSV cells may be quoted and
    then hold commas and doubled quotes, but no line breaks; a cell that a short
    row lacks is null. All values are read as text.
    """
    from entitystats.operators.aggregates import TRACKING

    fields = list(dict.fromkeys([n for opts in TRACKING.values() for names, _ in opts for n in names] + ["game_date"]))
    schema = text_schema(fields)
    name = lambda ext: F.regexp_extract("_metadata.file_name", rf"^(.*)\.{ext}$", 1)
    parts = []
    if _paths_exist(spark, f"{base}/*.json"):
        whole = spark.read.text(f"{base}/*.json", wholetext=True).select(name("json").alias(key), F.col("value"))
        rows = T.ArrayType(schema)
        wrapper = T.MapType(T.StringType(), T.StringType())
        inner = F.filter(F.map_values(F.from_json("value", wrapper)), lambda v: F.ltrim(v).startswith("["))
        body = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get(inner, F.lit(0)))
        parts.append(whole.select(key, F.explode(F.from_json(body, rows)).alias("r")).select(key, F.lit(0).alias("__kind"), "r.*"))
    if _paths_exist(spark, f"{base}/*.csv"):
        # headers differ between files, so each row is paired with its own file's header
        # (offset of the block, number inside the task) follows the order of lines
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        lines = spark.read.text(f"{base}/*.csv").select(name("csv").alias(key), place.alias("i"), F.col("value"))
        head = lines.groupBy(key).agg(F.min("i").alias("h"), F.min_by("value", "i").alias("head"))
        body = join_per_key(lines, head, [key]).filter("i > h").select(key, csv_cells(F.col("head")).alias("h"), csv_cells(F.col("value")).alias("c"))
        cell = lambda f: F.get("c", F.array_position("h", f).cast("int") - 1)
        parts.append(body.select(key, F.lit(1).alias("__kind"), *[cell(f).alias(f) for f in fields]))
    if _paths_exist(spark, f"{base}/*.parquet"):
        raw = spark.read.option("mergeSchema", "true").parquet(f"{base}/*.parquet")
        cols = [(F.col(f).cast("string") if f in raw.columns else F.lit(None).cast("string")).alias(f) for f in fields]
        parts.append(raw.select(name("parquet").alias(key), F.lit(2).alias("__kind"), *cols))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(key, T.StringType()), *schema.fields]))
    rows = reduce(DataFrame.unionByName, parts)
    first = rows.groupBy(key).agg(F.min("__kind").alias("__first"))
    return join_per_key(rows, first, [key]).filter("__kind = __first").drop("__kind", "__first")


def csv_cells(line: Column) -> Column:
    """Cells of a CSV line; quotes around a cell go, doubled ones inside become one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]++|"")*+"\s*|[^,]*+)'), F.lit(1))
    inside = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(F.transform(raw, lambda c: F.trim(c)), lambda c: F.when(c.rlike('(?s)^".*"$') & (F.length(c) > 1), inside(c)).otherwise(c))


def read_corpus(spark: SparkSession, base: str) -> DataFrame:
    """(key, path, text) of text files; JSON and CSV files are reduced to their text.

    A JSON file that cannot be parsed has an empty text. The cells of a CSV row
    are joined by a space, rows by a line break; blank rows are left out.
    """
    file = F.col("_metadata.file_name")
    suffix = F.lower(F.regexp_extract(file, r"(\.[^.]+)$", 1))
    found = spark.read.text(f"{base}/*", wholetext=True).select(F.regexp_replace(file, r"\.[^.]+$", "").alias("key"), file.alias("path"), F.col("value"), suffix.alias("suffix"))
    return texts_of(found.filter(F.col("suffix").isin(TEXT_SUFFIXES)), "value", "suffix").select("key", "path", F.col("value").alias("text"))


def texts_of(rows: DataFrame, body: str, suffix: str) -> DataFrame:
    """File bodies reduced to their text by their suffix; other columns stay."""
    value = F.col(body)
    listed = F.array_join(F.from_json(value, "array<string>"), "\n\n")
    field = F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in ("text", "body", "content")])
    string = F.from_json(F.concat(F.lit('{"s":'), value, F.lit("}")), "s string")["s"]
    lead = F.substring(F.ltrim(value), 1, 1)
    json_text = F.when(F.try_parse_json(value).isNull(), "").when(lead == '"', string).when(lead == "[", listed).otherwise(F.coalesce(field, value))
    lines = F.filter(F.split(value, r"\r?\n"), lambda r: F.length(r) > 0)
    csv_text = F.array_join(F.transform(lines, lambda r: F.array_join(csv_cells(r), " ")), "\n")
    return rows.withColumn(body, F.when(F.col(suffix) == ".json", json_text).when(F.col(suffix) == ".csv", csv_text).otherwise(value))


def corpus_matches(names: DataFrame, name: str, corpus: DataFrame) -> DataFrame:
    """(__who, path, text) of the files of every name: files named exactly so, else files that start with its first word.

    Both are equality joins: the exact one on the file key, the other on the
    part of the file key before the first separator or its full prefix.
    """
    asked = names.select(F.col(name).alias("__who")).filter(F.length(F.trim("__who")) > 0).distinct()
    keys = asked.withColumn("key", F.explode(F.array_distinct(F.array("__who", file_key(F.col("__who")), F.regexp_replace("__who", " ", "_")))))
    exact = keys.join(corpus, "key").select("__who", "path", "text").distinct()
    rest = asked.join(exact.select("__who").distinct(), "__who", "left_anti").withColumn("pref", F.split(file_key(F.col("__who")), "_")[0])
    # every prefix of a file key is a possible match for a first word
    prefixed = corpus.withColumn("pref", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr(F.col("key"), F.lit(1), i))))
    loose = rest.join(prefixed, "pref").select("__who", "path", "text")
    return exact.unionByName(loose)


def corpus_for_names(names: DataFrame, name: str, corpus: DataFrame) -> DataFrame:
    """(name, position, path, text): the texts of every name in path order, one row each."""
    found = ordered_texts(corpus_matches(names, name, corpus), ["__who"], "text", "path")
    return found.select(F.col("__who").alias(name), "position", "path", "text")


def ordered_texts(df: DataFrame, keys: str | Sequence[str], text: str, order: str, max_rows: int | None = None) -> DataFrame:
    """(keys, position, order, text): the texts of a key numbered from 0 in ``order``; empty ones are left out.

    Read by position they make up the joined text of the key. They stay rows of
    their own, so a key may have any number of texts; a hot key is numbered over
    slices.
    """
    keys = as_list(keys)
    rows = df.filter(F.length(text) > 0).select(*keys, order, text)
    line = Timeline(rows, keys, [order], max_rows).running(__upto=("count", F.lit(1), True))
    return line.result().select(*keys, (F.col("__upto") - 1).alias("position"), order, text)


def corpus_flags(names: DataFrame, name: str, corpus: DataFrame) -> DataFrame:
    """Keyword flags per name over all its files.

    No keyword can span the blank line between two files, so the flags of the
    joined text are the extreme flags of its files: an aggregate, no joining.
    """
    found = corpus_matches(names, name, corpus)
    flags = keyword_flags(F.col("text"))
    return found.groupBy(F.col("__who").alias(name)).agg(
        F.min(flags["injury_sentiment"]).alias("injury_sentiment"), *[F.max(c).alias(n) for n, c in flags.items() if n != "injury_sentiment"]
    )


def export_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header, quotes doubled; dates and times in ISO form. ``single`` is for small reports."""
    iso = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            iso[f.name] = F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            iso[f.name] = F.date_format(f.name, "yyyy-MM-dd")
    out = df.withColumns(iso) if iso else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Small aggregated report as one CSV or JSON file."""
    if fmt == "csv":
        export_csv(df, path, single=True)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)


def naive_utc(df: DataFrame, column: str) -> DataFrame:
    """Text, zoned or plain times as plain UTC times."""
    from entitystats.functions.dates import parse_timestamp

    kind = df.schema[column].dataType
    value = parse_timestamp(F.col(column)) if isinstance(kind, T.StringType) else F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        return df
    return df.withColumn(column, F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp").cast("timestamp_ntz")))


def rewrite_parquet(df: DataFrame, column: str, path: str) -> None:
    naive_utc(df, column).write.mode("overwrite").parquet(path)


def read_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON:API documents, either an object with data/included or a bare array of lines.

    A file is one document, read by one task; with ``lines`` each line is one,
    and large files split.
    """
    whole = spark.read.text(path, wholetext=not lines)
    schema = T.StructType.fromDDL(FEED_SCHEMA)
    is_list = F.ltrim("value").startswith("[")
    body = F.when(is_list, F.concat(F.lit('{"data":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    return whole.select(F.from_json(body, schema).alias("f")).select("f.*").filter("data IS NOT NULL")


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """(name in lower case, code in capitals) from a JSON object; replaces the built-in names."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return pairs.groupBy(F.lower("k").alias("name")).agg(F.max(F.upper("v")).alias("code"))


def with_codes(df: DataFrame, name: str, names: DataFrame, out: str = "code") -> DataFrame:
    """Adds the code of a name from a table of names (see ``read_name_map``) of any size.

    A name that is a code already is kept; else the full name counts, else its
    last word, else the first three letters in capitals.
    """
    table = settled_small(names.select("name", F.col("code").alias("__code")))
    text = F.lower(F.trim(name))
    last = F.element_at(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), -1)
    for key, label in ((text, "__full"), (last, "__last")):
        df = df.withColumn("__key", key).join(table.select(F.col("name").alias("__key"), F.col("__code").alias(label)), "__key", "left").drop("__key")
    shape = F.trim(name)
    is_code = (F.length(shape) == 3) & (shape == F.upper(shape)) & (F.upper(shape) != text)
    code = F.coalesce("__full", "__last", F.substring(F.upper(shape), 1, 3))
    kept = F.col(name).isNull() | (F.col(name) == "")
    return df.withColumn(out, F.when(kept, F.col(name)).when(is_code, shape).otherwise(code)).drop("__full", "__last")


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("player string, season string, PER double, WS double").csv(path, header=True)


def read_aliases(spark: SparkSession, path: str, name: str = "roster_name", ident: str = "resolved_player_id") -> DataFrame:
    """(name, id text) of alias CSVs; null and blank ids are left out."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.trim(name).alias("roster_name"), F.trim(ident).alias("resolved_id")).filter("length(resolved_id) > 0")


def append_rejects(rejects: DataFrame, path: str, kind: str, ident: str, reason: Column) -> None:
    """Append (kind, id, reason) records."""
    rejects.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), reason.cast("string").alias("reason")).write.mode("append").json(path)


def reject_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, id string, reason string").json(path).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("failures"))
