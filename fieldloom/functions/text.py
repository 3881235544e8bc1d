"""Text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section markers, tag keywords, filename patterns and default texts of the domain.
SECTION = r"(?i)(?:^|\n)[#*\s\-\d.]*(DIAGNOSIS|SEVERITY|CONFIDENCE|AFFECTED AREA|TREATMENT|PREVENTION|EXPERT ADVICE|EXPERT|CONSULT)[:\s*\-]*"
TAG_WORDS = ["disease", "pest", "fungal", "bacterial", "viral", "drought", "irrigation"]
UUID_PREFIX = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}___"
HEALTHY_NAME = r"(?i)^GH_HL Leaf (\d+)(\.(\d+))?\s*$"
BLIGHT_NAME = r"(?i)^(GHLB2ES|GHLB2|GHLB_PS|GHLB|GH_HL)\s+Leaf\s+(\d+)(\.(\d+))?(\s+Day\s*(\d+))?\s*$"
DEFAULT_TREATMENT = "Please consult the full analysis below."
DEFAULT_PREVENTION = "Follow standard agricultural best practices."

def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def given(x: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(x, F.lit(""))


def sections(text: Column) -> Column:
    """``(name, body)`` of each marked section in order; a marker runs over the separators after it."""
    bodies = F.split(text, SECTION, -1)
    names = F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))
    return F.zip_with(names, F.slice(bodies, F.lit(2), F.size(names)), lambda n, s: F.struct(F.upper(n).alias("name"), strip(s).alias("body")))


def section(found: Column, *names: str) -> Column:
    """Body of the first section with one of the names; null if there is none."""
    return F.get(F.filter(found, lambda s: s["name"].isin(*names)), F.lit(0))["body"]


def first_paragraph(text: Column) -> Column:
    """The first line of over 20 characters, or else the first 200 characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(strip(x)) > 20)
    return F.coalesce(F.get(lines, F.lit(0)), F.substring(text, 1, 200))


def parsed_response(text: Column) -> Column:
    """A free-text response as ``(diagnosis, severity, confidence, treatment, prevention, expert_advice)``."""
    found = sections(text)
    severity = given(F.lower(F.regexp_extract(F.coalesce(section(found, "SEVERITY"), F.lit("")), "(?i)(critical|high|medium|low|healthy)", 1)))
    confidence = F.try_to_number(given(F.regexp_extract(F.coalesce(section(found, "CONFIDENCE"), F.lit("")), r"(\d+)", 1)), F.lit("9999999999"))
    return F.struct(
        F.coalesce(given(section(found, "DIAGNOSIS")), first_paragraph(text)).alias("diagnosis"),
        F.coalesce(severity, F.lit("medium")).alias("severity"),
        F.coalesce(confidence.cast("long"), F.lit(75)).alias("confidence"),
        F.coalesce(given(section(found, "TREATMENT")), F.lit(DEFAULT_TREATMENT)).alias("treatment"),
        F.coalesce(given(section(found, "PREVENTION")), F.lit(DEFAULT_PREVENTION)).alias("prevention"),
        given(section(found, "EXPERT ADVICE", "EXPERT", "CONSULT")).alias("expert_advice"),
    )


def tags(query: Column, crop: Column, kind: Column) -> Column:
    """Type, lower-cased crop and the keywords that the query holds, each once, in this order."""
    words = F.filter(F.array(*map(F.lit, TAG_WORDS)), lambda w: F.contains(F.lower(query), w))
    own = F.when(given(crop).isNotNull(), F.array(F.lower(crop))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(kind), own, words))


def leaf_key(name: Column) -> Column:
    """A file name without its UUID prefix, in lower case, stripped."""
    return strip(F.lower(F.regexp_replace(name, UUID_PREFIX, "")))


def stem(name: Column) -> Column:
    """Without the last dot and what follows, in lower case, stripped."""
    return strip(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(jpg|jpeg)$", "")


def _number(text: Column, pattern: str, group: int) -> Column:
    return given(F.regexp_extract(text, pattern, group)).cast("int")


def healthy_name(path: Column) -> Column:
    """Parts of a healthy-leaf file name, nulls where it doesn't follow the pattern."""
    s = F.regexp_replace(strip_extension(F.element_at(F.split(path, "/"), -1)), UUID_PREFIX, "")
    leaf = _number(s, HEALTHY_NAME, 1)
    return F.struct(s.rlike(HEALTHY_NAME).alias("parsed"), leaf.alias("leaf_number"), _number(s, HEALTHY_NAME, 3).alias("sub_index"), F.concat(F.lit("th::Leaf"), leaf.cast("string")).alias("group_key"))


def blight_name(path: Column) -> Column:
    """Parts of a late-blight file name; known session prefixes are upper-cased."""
    s = F.regexp_replace(strip_extension(F.element_at(F.split(path, "/"), -1)), UUID_PREFIX, "")
    raw = given(F.regexp_extract(s, BLIGHT_NAME, 1))
    prefix = F.when(F.upper(raw) == "GH_HL", raw).otherwise(F.upper(raw))
    leaf = _number(s, BLIGHT_NAME, 2)
    key = F.concat(F.lit("tlb::"), prefix, F.lit("::Leaf"), leaf.cast("string"))
    return F.struct(s.rlike(BLIGHT_NAME).alias("parsed"), prefix.alias("session_prefix"), leaf.alias("leaf_number"), _number(s, BLIGHT_NAME, 4).alias("sub_index"), _number(s, BLIGHT_NAME, 6).alias("day_number"), key.alias("group_key"))


def name_flags(path: Column) -> dict[str, Column]:
    """What a file name shows: a decimal suffix, a day, an upper-case extension, a UUID, or no convention at all."""
    bare = strip_extension(F.element_at(F.split(path, "/"), -1))
    plain = F.regexp_replace(bare, UUID_PREFIX, "")
    return {
        "decimal_suffix": plain.rlike(r"\d\.\d+(\s|$)"),
        "dated": plain.rlike(r"(?i)\sDay\s*\d+\s*$"),
        "upper_extension": path.rlike(r"\.[A-Z]+$"),
        "uuid_prefixed": bare.rlike(UUID_PREFIX),
        "unparsed": ~plain.rlike(HEALTHY_NAME) & ~plain.rlike(BLIGHT_NAME),
    }


def first_underscore(x: Column) -> Column:
    """The first underscore as a space."""
    return F.regexp_replace(x, "^([^_]*)_", "$1 ")


def safe_filename(name: Column, most: int = 100) -> Column:
    """Base name without control characters, stripped and cut; "upload" if nothing is left."""
    base = F.element_at(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/"), -1)
    return F.left(F.coalesce(given(strip(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""))), F.lit("upload")), F.lit(most))


def extension(name: Column) -> Column:
    """The last dot and what follows in lower case; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise(F.lit(""))


def chat_context(messages: Column, most: int = 5) -> Column:
    """The last messages as lines of ``role: content``."""
    last = F.slice(messages, F.greatest(F.size(messages) - most + 1, F.lit(1)), most)
    return F.array_join(F.transform(last, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def percent(x: Column) -> Column:
    """Whole percent, halves up."""
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def join_given(sep: str, *parts: Column) -> Column:
    """The parts that are given, joined."""
    return F.concat_ws(sep, *map(given, parts))


def unquoted(x: Column) -> Column:
    return F.regexp_replace(x, "^[\"']|[\"']$", "")


def soil_query(ph: Column, nitrogen: Column, phosphorus: Column, potassium: Column, notes: Column) -> Column:
    """A soil question with a line for each value that is given."""
    line = lambda label, x: F.when(given(x.cast("string")).isNotNull(), F.concat(F.lit(f"{label}: "), x.cast("string")))
    return F.concat_ws("\n", F.lit("Analyze this soil:"), line("pH", ph), line("Nitrogen", nitrogen), line("Phosphorus", phosphorus), line("Potassium", potassium), line("Notes", notes))


def percent2(x: Column) -> Column:
    """Percent with two decimals."""
    return F.format_string("%.2f%%", x * 100)


def first_name(x: Column) -> Column:
    """What stands before the first space."""
    return F.get(F.split(x, " "), F.lit(0))


def error_text(x: Column, most: int = 300) -> Column:
    """The start of an error's text."""
    return F.left(x, F.lit(most))


def normalised_email(x: Column) -> Column:
    """As it is stored: stripped, in lower case."""
    return F.lower(F.trim(x))


def canonical_sha256(**values: Column) -> Column:
    """SHA-256 of a flat JSON object with sorted keys, separators as ``", "`` and ``": "``; values are texts."""
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    cells = [F.concat(F.lit(f'"{k}": '), quoted(values[k].cast("string"))) for k in sorted(values)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}")), 256)
