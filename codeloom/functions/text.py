"""Scalar text functions, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_WS = r"^[\s]+|[\s]+$"
# Line breaks: LF, CR, VT, FF, FS to RS, NEL, and the two Unicode separators.
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Both ends, any white space (Spark's trim drops spaces only)."""
    return F.regexp_replace(col(c), _WS, "")


def tail(c: str | Column) -> Column:
    """Last dotted segment."""
    return F.substring_index(col(c), ".", -1)


def label(c: str | Column) -> Column:
    """Last two dotted segments."""
    return F.substring_index(col(c), ".", -2)


def base_name(c: str | Column) -> Column:
    return F.substring_index(col(c), "/", -1)


def file_stem(c: str | Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]+$", "")


def suffix(c: str | Column) -> Column:
    return F.regexp_extract(base_name(c), r"(?<=.)(\.[^.]+)$", 1)


def node_id(c: str | Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(col(c), "[^0-9a-zA-Z]", "_"))


def heading_slug(c: str | Column) -> Column:
    kept = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s-]", "")
    return F.replace(strip(kept), F.lit(" "), F.lit("-"))


def repo_from_url(c: str | Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(col(c), "/+$", ""), r"\.git$", "")
    return F.substring_index(trimmed, "/", -1)


def collection_name(c: str | Column) -> Column:
    slug = F.regexp_replace(col(c), "[^a-zA-Z0-9_-]", "_")
    slug = F.regexp_replace(slug, "^[_-]+|[_-]+$", "")
    return F.substring(F.concat(F.lit("repo_"), slug), 1, 500)


def without_fences(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?s)```.*?```", " ")


def sentences(c: str | Column) -> Column:
    return F.split(col(c), r"(?<=[.!?])\s+")


def dependency_name(c: str | Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(c), r"(?s)[<>=!~\[; ].*$", "")))


def package_file_name(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9_.-]", "")


def upper_first(c: Column) -> Column:
    """One character gives one: those whose capital is several letters take a single one, or stay."""
    first = F.substring(c, 1, 1)
    large = F.when(first.isin(*fixed.SINGLE_CAPITALS), F.translate(
        first, "".join(fixed.SINGLE_CAPITALS), "".join(fixed.SINGLE_CAPITALS.values()))).otherwise(F.upper(first))
    return F.concat(large, F.substring(c, 2, 2**31 - 1))


def short_purpose(c: str | Column, words: int = 7) -> Column:
    """First clause as a label: at most ``words`` words, no dangling function word."""
    clause = F.element_at(F.split(strip(c), r"[,.;]| by | which | that "), 1)
    parts = F.filter(F.slice(F.split(strip(clause), r"\s+"), 1, words), lambda w: w != "")
    dangling = F.transform(parts, lambda w: F.regexp_replace(
        F.lower(w), "^[.,'\"]+|[.,'\"]+$", "").isin(*fixed.TRAILING_WORDS))
    # Position of the last word worth keeping; 0 when there is none.
    last = F.coalesce(F.array_max(F.transform(
        dangling, lambda d, i: F.when(d, F.lit(0)).otherwise(i + 1))), F.lit(0))
    kept = F.regexp_replace(F.concat_ws(" ", F.slice(parts, F.lit(1), last)), "[ .,]+$", "")
    return upper_first(kept)


def title_from_name(c: str | Column) -> Column:
    name = tail(c)
    bare = F.regexp_replace(name, "^_+|_+$", "")
    words = strip(F.replace(bare, F.lit("_"), F.lit(" ")))
    return (F.when(bare == "", name)
            .when(~bare.contains("_") & F.substring(bare, 2, 2**31 - 1).rlike(r"\p{Lu}"), bare)
            .otherwise(upper_first(words)))


def clean_body(c: str | Column) -> Column:
    t = F.regexp_replace(col(c), fixed.LEAKED_FACTS, "")
    t = F.regexp_replace(t, fixed.ROLE_LABEL, "")
    t = F.regexp_replace(t, r"\s+[—–]\s+", ", ")
    return strip(F.regexp_replace(t, "[—–]", "-"))


def name_severity(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.contains(".") | c.contains("_") | c.rlike(r"(?s)\p{Lu}.*\p{Lu}"),
                  "error").otherwise("warning")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"),
                    F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def cut(c: str | Column, limit: int, marker: str, keep: int | None = None) -> Column:
    """Shorten past ``limit`` characters and say so."""
    c = col(c)
    return F.when(F.length(c) > limit,
                  F.concat(F.substring(c, 1, keep or limit), F.lit(marker))).otherwise(c)


def table_cell(c: str | Column) -> Column:
    escaped = F.replace(F.coalesce(col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    return cut(escaped, 110, "…", 107)


def lines(c: str | Column) -> Column:
    """Lines of a text, without the empty one after a final break."""
    parts = F.split(col(c), _BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)) \
            .otherwise(parts)


def first_line(c: str | Column) -> Column:
    return strip(F.element_at(F.split(strip(c), _BREAK), 1))


def without_prompt(c: str | Column) -> Column:
    """Drop any leading run of dollar signs and spaces."""
    return strip(F.regexp_replace(strip(c), "^[$ ]+", ""))


def quote_pattern(c: str | Column) -> Column:
    """A text as a literal inside a regular expression."""
    return F.regexp_replace(col(c), r"([\\.^$|?*+()\[\]{}\-])", r"\\\\$1")


def module_file(c: str | Column) -> Column:
    """`a.b` as a place is the file `a/b.py`; paths and `.py` names stay."""
    c = col(c)
    return F.when((c != "") & ~c.endswith(".py") & ~c.contains("/"),
                  F.concat(F.replace(c, F.lit("."), F.lit("/")), F.lit(".py"))).otherwise(c)


def claimed_line(c: str | Column) -> Column:
    """The number after the last colon, if it is one."""
    c = col(c)
    number = strip(F.substring_index(c, ":", -1))
    return F.when(c.contains(":") & number.rlike("^[0-9]+$"), number.try_cast("int"))


# ---- fenced code -------------------------------------------------------------------

def fenced(c: str | Column) -> Column:
    """array<struct<lang, body>> of every fenced block, in order."""
    c = col(c)
    pattern = r"(?s)```([^\n`]*)\n(.*?)```"
    langs = F.regexp_extract_all(c, F.lit(pattern), 1)
    bodies = F.regexp_extract_all(c, F.lit(pattern), 2)
    return F.zip_with(langs, bodies, lambda a, b: F.struct(
        F.coalesce(F.nullif(F.lower(strip(a)), F.lit("")), F.lit("text")).alias("lang"),
        strip(b).alias("body")))


def mentions(c: str | Column) -> Column:
    """Distinct backticked texts."""
    found = F.regexp_extract_all(col(c), F.lit(r"`([^`\n]+)`"), 1)
    # Equal ones are one before each is stripped.
    return F.array_distinct(F.transform(F.array_distinct(found), strip))


def mention_token(c: Column) -> Column:
    """The identifier a mention names, or null when it is not an identifier at all."""
    token = strip(F.regexp_replace(F.regexp_replace(c, r"[()]+$", ""), r"^\*+", ""))
    literal = c.rlike("^['\"]") | c.rlike("['\"]$")
    expression = c.rlike(r"[\[\]{}=,]") | c.startswith(".")
    told = F.when(literal | expression | (token == "") | token.rlike(fixed.IGNORED_MENTION),
                  None).otherwise(token)
    # Most mentions are a plain word, of which nothing is cut and only the last rule can apply.
    return F.when(c.rlike(r"\A[A-Za-z0-9_]+\z"), F.when(~c.rlike(fixed.IGNORED_MENTION), c)).otherwise(told)


def self_defined(c: str | Column) -> Column:
    """Names that a text's own fenced code introduces."""
    blocks = F.regexp_extract_all(col(c), F.lit(r"(?s)(```.*?```)"), 1)
    names = F.transform(blocks, lambda b: F.concat(
        F.regexp_extract_all(b, F.lit(r"(?Um)^\s*def\s+(\w+)"), 1),
        F.regexp_extract_all(b, F.lit(r"(?Um)^\s*class\s+(\w+)"), 1),
        F.regexp_extract_all(b, F.lit(r"(?Um)^\s*(\w+)\s*=(?!=)"), 1)))
    return F.array_distinct(F.flatten(names))


def example_names(c: str | Column) -> Column:
    """Every identifier inside fenced code."""
    blocks = F.regexp_extract_all(col(c), F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(
        b, F.lit(r"(?U)\b([A-Za-z_][A-Za-z0-9_]*)\b"), 1))))


def json_text(c: str | Column) -> Column:
    """JSON salvaged from a reply wrapped in prose or fences."""
    c = col(c)
    parts = F.slice(F.split(c, "```"), 2, 2**31 - 1)
    # A part headed "json" starts after its first line (if it has a second one).
    bodies = F.transform(parts, lambda p: strip(F.when(
        F.lower(strip(F.substring(p, 1, 20))).startswith("json"),
        F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(p)))
    in_fence = F.try_element_at(
        F.filter(bodies, lambda b: b.startswith("{") | b.startswith("[")), F.lit(1))
    braces = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    brackets = F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit(""))
    return F.coalesce(in_fence, braces, brackets, c)


def reply(c: str | Column, schema) -> Column:
    """A model reply as a struct: parsed as it is, else from the salvaged part, else null."""
    c = col(c)

    def parsed(t: Column) -> Column:
        return F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, schema))

    return F.coalesce(parsed(c), parsed(json_text(c)))
