"""Expressions over messages and model answers: code, JSON, front matter, quotes, waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _no_thought(t: Column) -> Column:
    return F.regexp_replace(F.coalesce(t, F.lit("")), r"(?s)<think>.*?</think>", "")


def extract_code(t: Column) -> Column:
    """The fenced blocks of an answer joined by a blank line; null for an odd number of fences; the bare text without any."""
    clean = _no_thought(t)
    fences = F.regexp_count(clean, F.lit(r"(?m)^```"))
    blocks = F.transform(F.regexp_extract_all(clean, F.lit(r"(?sm)^```[^\n]*\n(.*?)^```"), F.lit(1)), lambda b: F.rtrim(F.regexp_replace(b, r"\n+$", "")))
    return F.when(fences % 2 == 1, F.lit(None)).when(fences == 0, F.trim(clean)).otherwise(F.array_join(blocks, "\n\n"))


def extract_json(t: Column) -> Column:
    """The JSON object of an answer: the whole text if it parses, else the outermost braces; null if neither does."""
    clean = F.trim(F.regexp_replace(_no_thought(t), r"```(?:json)?", ""))
    outer = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    ok = lambda c: F.try_parse_json(c).isNotNull() & c.startswith("{")
    return F.when(ok(clean), clean).when(ok(outer), outer)


def missing_keys(answer: Column, required: list[str]) -> Column:
    """Required keys that a JSON object lacks; all of them if it isn't one."""
    need = F.array(*map(F.lit, required))
    return F.array_except(need, F.coalesce(F.json_object_keys(answer), F.array().cast("array<string>")))


def front_matter(t: Column) -> Column:
    """(fields MAP, body) of a text that begins with a --- block; without one no fields and the whole text."""
    t = F.coalesce(t, F.lit(""))
    p = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    block = F.regexp_extract(t, p, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r'^"(.*)"$', "$1").alias("v")))
    distinct = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return F.struct(F.when(t.rlike(p), distinct).otherwise(F.create_map().cast("map<string,string>")).alias("fields"), F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 2))).otherwise(t).alias("body"))


def retry_after(t: Column) -> Column:
    """Seconds of 'try again in XmYs' or '... in Zms'; null without."""
    p = r"try again in (?:(\d+)m(?!s))?(?:([\d.]+)s)?(?:([\d.]+)ms)?"
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, p, i), F.lit("")), F.lit("999999999.999999")).cast("double"), F.lit(0.0))
    return F.when(t.rlike(r"try again in [\d.]+m?s?"), part(1) * 60 + part(2) + part(3) / 1000)


def is_daily_quota(t: Column) -> Column:
    """Whether a message speaks of a quota by the day."""
    low = F.lower(F.coalesce(t, F.lit("")))
    return F.contains(low, F.lit("per day")) | F.contains(low, F.lit("daily")) | F.contains(low, F.lit("tpd")) | F.contains(low, F.lit("rpd"))


def quote_in(quote: Column, t: Column) -> Column:
    """Whether a window of 60, 40 or 25 characters of ``quote`` (every 10th), or all of it, stands in ``t``; spaces and quotes alike."""
    norm = lambda c: F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s`'\"“”‘’]+", " ")))
    q, hay = norm(quote), norm(t)
    def window(n: int) -> Column:
        starts = F.when(F.length(q) >= n, F.sequence(F.lit(0), F.length(q) - n, F.lit(10))).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: F.contains(hay, F.substring(q, i + 1, F.lit(n))))
    return (F.length(q) > 0) & (window(60) | window(40) | window(25) | F.contains(hay, q))


def yaml_quote(t: Column) -> Column:
    """A scalar for YAML: line ends as spaces, quoted with escapes if it holds a colon, hash, quote, brace or bracket."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), "\n", " "), r"^\s+|\s+$", "")
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"\\", r"\\\\"), '"', r'\\"'), "\t", r"\\t")
    return F.when(flat.rlike(r"[:#\"'{}\[\]]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(flat)


def content_text(blocks: Column) -> Column:
    """Text of content blocks (type, text): those of type text, a line each."""
    return F.array_join(F.transform(F.filter(F.coalesce(blocks, F.array().cast("array<struct<type:string,text:string>>")), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def short(t: Column, most: int = 500) -> Column:
    """``t`` with an ellipsis beyond ``most`` characters."""
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def learning_message(ok: Column, stage: Column, error: Column, check: Column) -> Column:
    """What an attempt tells a learner: that it passed, its error if the code crashed, or the assertion that failed."""
    return F.when(ok, "tests passed").when(stage == "code", F.coalesce(error, F.lit(""))).otherwise(F.concat(F.lit("AssertionError: test failed: assert "), F.coalesce(check, F.lit(""))))
