"""Text clean-up, keyword flags and JSON found inside text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Latin letters whose decomposition is one base letter plus marks."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    """Base letters without marks, for composed and decomposed Latin text."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}", "")


def normalise_name(name: Column) -> Column:
    """Lower case, without . , ' and double quotes, accents and double spaces."""
    text = F.regexp_replace(F.lower(name), r"[.,'\"]", "")
    return F.coalesce(F.trim(F.regexp_replace(strip_accents(text), r"\s+", " ")), F.lit(""))


def normalise_name_suffix(name: Column) -> Column:
    """Lower case, without commas, dots, generational suffixes and double spaces."""
    text = F.regexp_replace(F.lower(name), r"[,.]", "")
    text = F.regexp_replace(text, r"\b(jr|sr|ii|iii|iv)\b", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def file_key(name: Column) -> Column:
    """Name as used in file names: trimmed, lower case, blanks and slashes as _."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[ /\\]", "_")


def list_field(text: Column) -> Column:
    """Array from "['a', 'b']", "a, b", "a; b" or a single value."""
    s = F.trim(text)
    inner = F.regexp_extract(s, r"^[\[\(\{](.*)[\]\)\}]$", 1)
    is_literal = s.rlike(r"^[\[\(\{].*[\]\)\}]$")
    clean = lambda parts: F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), r"^['\"]|['\"]$", "")))
    # quoted items keep their commas
    items = F.regexp_extract_all(inner, F.lit(r"""\s*("[^"]*"(?=\s*(?:,|$))|'[^']*'(?=\s*(?:,|$))|[^,]+)\s*"""), F.lit(1))
    parts = (
        F.when(is_literal, clean(items))
        .when(s.contains(","), F.transform(F.split(s, ","), lambda p: F.trim(p)))
        .when(s.contains(";"), F.transform(F.split(s, ";"), lambda p: F.trim(p)))
        .otherwise(F.array(s))
    )
    return F.when(s.isNull() | (s == ""), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda p: p != ""))


#: Keywords, matched anywhere in the text ("out" also inside "about") - fixed values.
INJURY_WORDS = ["injur", "sprain", "strain", "out", "questionable", "doubtful"]
MORALE_WORDS = ["morale", "confidence", "motivated"]
MOTIVATION_WORDS = ["contract", "extension", "contract year"]
COACHING_WORDS = ["coach", "coaching change", "coach fired", "coach hired"]


def has_any(text: Column, words: list[str]) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | lower.contains(word)
    return hit


def keyword_flags(text: Column) -> dict[str, Column]:
    """Plain scale: -1 for injury, 1 for morale, motivation and coaching."""
    flag = lambda words, on, off=0.0: F.when(has_any(text, words), F.lit(on)).otherwise(F.lit(off))
    return {
        "injury_sentiment": flag(INJURY_WORDS, -1.0),
        "morale_score": flag(MORALE_WORDS, 1.0),
        "motivation": flag(MOTIVATION_WORDS, 1.0),
        "coaching_change_impact": flag(COACHING_WORDS, 1.0),
    }


def qualitative_fallback(text: Column) -> dict[str, Column]:
    """Structured scale: injury -0.5, morale 50, motivation 1 or 0.5."""
    injured = has_any(text, INJURY_WORDS)
    return {
        "injury_status": F.when(injured, F.lit("questionable")).otherwise(F.lit("healthy")),
        "morale_score": F.lit(50),
        "news_sentiment": F.when(injured, F.lit(-0.5)).otherwise(F.lit(0.0)),
        "trade_sentiment": F.lit(0.0),
        "motivation": F.when(has_any(text, MOTIVATION_WORDS), F.lit(1.0)).otherwise(F.lit(0.5)),
    }


def morale_unit(score: Column) -> Column:
    """0..100 to -1..1; 50 when missing."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.coalesce(score.cast("double"), F.lit(50.0)) - 50.0) / 50.0))


def json_object_in(text: Column) -> Column:
    """From the first { to the last }; null when there is no such span."""
    start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & text.contains("}") & (end > start), F.substr(text, start, end - start + 1))


def _json_text(body: Column, *names: str) -> Column:
    """First truthy field as text: missing, empty, zero and false are passed over."""
    values = [F.get_json_object(body, f"$.{n}") for n in names]
    return F.coalesce(*[F.when(~v.isin("", "false", "[]", "{}") & F.coalesce(v.try_cast("double") != 0, F.lit(True)), v) for v in values])


def qualitative_fields(text: Column) -> dict[str, Column]:
    """Fields of the JSON object inside a text, with aliases and defaults.

    ``is_valid`` tells whether an object was found, its numbers can be read and
    they are in range.
    """
    body = json_object_in(text)
    morale = F.coalesce(_json_text(body, "morale_score", "morale", "moraleScore"), F.lit("50")).try_cast("double")
    sentiment = F.coalesce(_json_text(body, "news_sentiment", "sentiment"), F.lit("0")).try_cast("double")
    trade = F.coalesce(_json_text(body, "trade_sentiment", "tradeSentiment"), F.lit("0")).try_cast("double")
    motivation = F.coalesce(_json_text(body, "motivation", "motivation_score"), F.lit("0.5")).try_cast("double")
    readable = F.try_parse_json(body).isNotNull() & morale.isNotNull() & sentiment.isNotNull() & trade.isNotNull() & motivation.isNotNull()
    return {
        "injury_status": F.coalesce(_json_text(body, "injury_status", "injury", "injuryStatus"), F.lit("healthy")),
        "morale_score": morale.cast("int"),
        "news_sentiment": sentiment,
        "trade_sentiment": trade,
        "motivation": motivation,
        "is_valid": F.coalesce(
            readable & morale.cast("int").between(0, 100) & sentiment.between(-1.0, 1.0), F.lit(False)
        ),
    }


def recent_games_text(values: Column) -> Column:
    """'Last n games: a, b, ...' for a newest-first array."""
    shown = F.array_join(F.transform(values, lambda v: v.cast("string")), ", ")
    return F.when(F.size(values) > 0, F.concat(F.lit("Last "), F.size(values).cast("string"), F.lit(" games: "), shown))
