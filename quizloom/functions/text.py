"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizloom.functions import values as V


def trim_all(c: Column) -> Column:
    """Trims every Unicode white space, not only the space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(trim_all(c)) > 0, F.lit(False))


def clean_text(c: Column) -> Column:
    """No white space at line ends, one blank line at most in a row, none at either end."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\R", "\n"), r"(?U)[^\S\n]+(?=\n|$)", "")
    return trim_all(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def normalize_question(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim_all(c)), r"(?U)\s+", " ")


def normalize_heading(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]+", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def truncate_words(c: Column, n: int) -> Column:
    return F.when(word_count(c) <= n, c).otherwise(F.array_join(F.slice(words(c), 1, n), " "))


def truncate_chars(c: Column, n: int) -> Column:
    """At most n characters, the last three of which are dots where something was cut."""
    return F.when(F.length(c) <= n, c).otherwise(
        F.concat(F.substring(c, 1, max(0, n - 3)), F.lit("...")) if n > 3 else F.substring(c, 1, n)
    )


def option_letter(c: Column) -> Column:
    """The first letter that stands alone, else the first character, upper-cased; empty for null."""
    upper = F.upper(trim_all(F.coalesce(c, F.lit(""))))
    alone = F.regexp_extract(upper, r"\b([A-Z])\b", 1)
    return F.when(alone != "", alone).otherwise(F.substring(upper, 1, 1))


def risk_level(c: Column) -> Column:
    """S0 to S2 from labels, from the older scale 1 to 3, or from a text that holds either; else empty."""
    upper = F.upper(trim_all(F.coalesce(c, F.lit(""))))
    old = F.create_map(*[F.lit(x) for x in ("0", "S0", "1", "S0", "2", "S1", "3", "S2")])
    label = F.regexp_extract(upper, r"\bS([012])\b", 1)
    digit = F.regexp_extract(upper, r"\b([123])\b", 1)
    return (
        F.when(upper.isin(*V.RISKS), upper)
        .when(upper.isin("0", "1", "2", "3"), F.element_at(old, upper))
        .when(label != "", F.concat(F.lit("S"), label))
        .when(digit != "", F.element_at(old, digit))
        .otherwise("")
    )


def canonical_type(c: Column) -> Column:
    """Document type in its one spelling; unknown types are trimmed."""
    t = trim_all(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    return (
        F.when(low.isin("exam", "mcq"), "MCQ").when(low == "saq", "SAQ")
        .when(low.isin("case report", "casereport", "case_report"), "CaseReport").otherwise(t)
    )


def category(c: Column) -> Column:
    return F.when(c == "CaseReport", "CBQ").when(c.isin(*V.CATEGORIES), c).otherwise("")


def _first_keyword(text: Column, groups, default) -> Column:
    low = F.lower(text)
    out = F.lit(default)
    for name, keywords in reversed(groups):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords]), F.lit(name)).otherwise(out)
    return out


def fallback_type(c: Column, phrases=V.TYPE_PHRASES) -> Column:
    return _first_keyword(F.substring(c, 1, V.TYPE_SAMPLE_CHARS), phrases, "")


def discipline_number(c: Column, keywords=V.DISCIPLINE_KEYWORDS) -> Column:
    return _first_keyword(c, keywords, 0)


def reasoning_level(c: Column, keywords=V.LEVEL_KEYWORDS) -> Column:
    return _first_keyword(c, keywords, "L1")


def discipline_name(number: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.DISCIPLINES.items() for x in kv]), number), F.lit(""))


def parse_tags(response: Column, context: Column) -> Column:
    """struct(number, name, level) from a tagging response, with keywords of the context where it says nothing."""
    lines = F.filter(F.transform(F.split(response, r"\R"), trim_all), lambda x: x != "")
    text = F.array_join(lines, "\n")
    by_number = F.regexp_extract(text, r"(?i)(?:dental\s*discipline|taxonomy|label\s*1|category)?\D*\b([1-9]|1[0-4])\b", 1)
    names = [(n, (name.lower(),)) for n, name in V.DISCIPLINES.items()]
    said = F.when(by_number != "", F.try_cast(by_number, "int") if hasattr(F, "try_cast") else by_number.try_cast("int"))
    said = F.coalesce(said, F.nullif(_first_keyword(text, names, 0), F.lit(0)))
    level = F.nullif(F.upper(F.regexp_extract(text, r"(?i)\b(L[123])\b", 1)), F.lit(""))
    number = F.coalesce(said, discipline_number(context))
    default = reasoning_level(context)
    return F.struct(
        number.alias("number"),
        discipline_name(number).alias("name"),
        # Without any number the whole fallback holds, a level that was said included.
        F.when((number != 0) & level.isNotNull(), level).otherwise(default).alias("level"),
    )


def strip_json_fence(c: Column) -> Column:
    return trim_all(F.regexp_replace(trim_all(c), r"^```json\s*|\s*```$", ""))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trim_all), lambda x: x != "")


def options_block(options: Column) -> Column:
    """options: array of struct(key, value), in order."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["value"])), "\n")


def lettered(values: Column) -> Column:
    """Options from a plain list, under A, B, C and so on."""
    return F.transform(values, lambda v, i: F.struct(F.char(i + 65).alias("key"), v.alias("value")))


def key_point_block(points: Column) -> Column:
    """points: array of struct(content, location, explanation)."""
    none = F.lit("")

    def line(p: Column, i: Column) -> Column:
        return F.concat(
            (i + 1).cast("string"), F.lit(". "), F.coalesce(p["content"], none), F.lit("\nLocation: "),
            F.coalesce(p["location"], none), F.lit("\nExplanation: "), F.coalesce(p["explanation"], none),
        )

    return F.array_join(F.transform(points, line), "\n\n")


def render(template: str, **parts: Column) -> Column:
    """The template with each {name} replaced by its column; null counts as empty."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def conversion_tool(path: Column) -> Column:
    """The tool for a file's suffix; null for an unsupported one."""
    end, out = suffix(path), F.lit(None).cast("string")
    for tool, suffixes in V.TOOLS.items():
        out = F.when(end.isin(*suffixes), F.lit(tool)).otherwise(out)
    return out


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def runtime_name(index: Column, path: Column) -> Column:
    safe = F.substring(F.regexp_replace(file_stem(path), r"[^A-Za-z0-9_.-]+", "_"), 1, 80)
    return F.concat(F.lpad(index.cast("string"), 4, "0"), F.lit("_"), safe, F.lit(".pdf"))


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Rounds the exact binary value half to even, as Python does; round and bround don't."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit("")).cast("double")


def two_decimals(c: Column) -> Column:
    return F.coalesce(F.replace(F.format_number(c, 2), F.lit(","), F.lit("")), F.lit(""))


def merge_maps(a: Column, b: Column) -> Column:
    """The entries of both maps; b's take the place of a's.  A null map is empty."""
    b = F.coalesce(b, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce(a, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)
