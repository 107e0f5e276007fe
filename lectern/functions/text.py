"""String columns: normalisation, boilerplate, detectors, labels, identifiers. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, patterns and placeholders that decide results.
HEDGES = ["depends on", "various factors", "multiple factors", "several factors", "context-dependent", "it depends", "many factors", "complex relationship", "not straightforward"]
PLACEHOLDERS = ["", "unknown", "...", "n/a", "none"]
NUMERIC = r"\b\d+(?:\.\d+)?\b"
UNIT = r"\b(?:g/mol|mol%|wt%|vol%|°C|deg\s*C|K|MPa|Pa\b|kPa|GPa|nm|µm|um|mm|cm|min|hours?|h|s\b|rpm|kJ/mol|kcal/mol|Hz|kHz|MHz|Da|kDa)\b"
TRIPLE_PHRASES = [
    r"\bwhat\s+(?:is|was|are|were)\s+the\s+\w[\w\s\-]{0,30}\s+of\s+\w",
    r"\bwhich\s+\w[\w\s\-]{0,30}\s+(?:is|are|was|were|did|do|does)\s+",
    r"\bby\s+which\s+\w[\w\s\-]{0,30}\b",
    r"\bhow\s+does\s+\w[\w\s\-]{0,40}\s+(?:affect|influence|relate)\b",
    r"\b(?:produced|measured|characterised|prepared|reported)\s+by\b",
    r"\btriple\b|\bsubject[- ]predicate[- ]object\b",
]
TABLE_LABEL = r"\b(?:TABLE|Table|Tab\.?)\s+((?:X{0,3})(?:IX|IV|V?I{0,3})|\d+)\b"
VARIABLE = r"\?([a-zA-Z]\w*)"
ISSUE_CODE = r"^\[([A-Z]+)\]"
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
# End of fixed values.


def plain_spaces(c: Column) -> Column:
    """No-break spaces as plain ones, so that every engine agrees on what white space is."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" "))


def norm(c: Column) -> Column:
    """Null to empty, lower case, trimmed, any run of white space to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def strip_boilerplate(c: Column) -> Column:
    """Collapse blanks, cap blank lines at two, drop lines of one to four digits."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^\s*\d{1,4}\s*$"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def section_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda line: line.startswith("## "))).cast("long")


def too_short(answer: Column, least: int = 8) -> Column:
    return word_count(F.trim(F.lower(answer))) < least


def hedge_phrase(answer: Column) -> Column:
    """The first hedge phrase (in list order) an answer contains, or null."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in HEDGES])


def vague_flags(answer: Column) -> Column:
    """Flags of a vague answer: too short, and at most one hedge phrase."""
    return F.array_compact(F.array(F.when(too_short(answer), F.lit("answer_too_short")), F.concat(F.lit("hedge_phrase: '"), hedge_phrase(answer), F.lit("'"))))


def has_number(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?U)" + NUMERIC)


def has_unit(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?iU)" + UNIT)


def has_triple_phrase(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    found = F.lit(False)
    for pattern in TRIPLE_PHRASES:
        found = found | text.rlike("(?iU)" + pattern)
    return found


def variables(c: Column) -> Column:
    """?names in order, repeats kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(VARIABLE), F.lit(1))


def table_labels(c: Column) -> Column:
    """Number of distinct table numerals, arabic or roman."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)" + TABLE_LABEL), F.lit(1)))).cast("long")


def invalid_section(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(PLACEHOLDERS)


def issue_code(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), ISSUE_CODE, 1)


def paper_id(author: Column, year: Column) -> Column:
    """Author and year, with stand-ins for either."""
    author, year = F.trim(F.coalesce(author, F.lit(""))), F.trim(F.coalesce(year.cast("string"), F.lit("")))
    return F.concat(F.when(author == "", "Unknown").otherwise(author), F.when(year == "", "0000").otherwise(year))


def stem_paper_id(stem: Column) -> Column:
    """A file stem up to its pipeline or model suffix."""
    return F.split_part(F.split_part(stem, F.lit("_cq_v2"), F.lit(1)), F.lit("_ext-"), F.lit(1))


def model_slug(name: Column) -> Column:
    """Short code of a model name: first letters and digits of each segment, then the tag's short form."""
    base, tag = F.split_part(name, F.lit(":"), F.lit(1)), F.substring_index(name, ":", -1)
    tag = F.when(F.instr(name, ":") == 0, "").otherwise(tag)

    def short(segment: Column) -> Column:
        letters, digits = F.regexp_extract(segment, r"^([a-zA-Z]*)(\d*)$", 1), F.regexp_extract(segment, r"^([a-zA-Z]*)(\d*)$", 2)
        letters = F.when(F.length(letters) >= 3, F.substring(letters, 1, 2)).otherwise(letters)
        return F.when(segment.rlike(r"^[a-zA-Z]*\d*$"), F.concat(letters, digits)).otherwise(F.substring(segment, 1, 2))

    code = F.array_join(F.transform(F.split(base, "-"), short), "")
    mark = F.when(tag.rlike(r"^\d"), F.split_part(tag, F.lit("-"), F.lit(1))).otherwise(F.substring(tag, 1, 3))
    return F.when((tag == "") | (tag == "latest"), code).otherwise(F.concat(code, F.lit("-"), mark))


def pipeline_slug(generator: Column, validator: Column, refiner: Column) -> Column:
    g, v, r = model_slug(generator), model_slug(validator), model_slug(refiner)
    return F.when((g == v) & (v == r), g).otherwise(F.concat(F.lit("g-"), g, F.lit("_v-"), v, F.lit("_r-"), r))


def duration(seconds: Column) -> Column:
    """'Xh Ym Zs Wms'; hours and minutes only when they count."""
    x = F.greatest(F.lit(0.0), seconds.cast("double"))
    h, m, s = F.floor(x / 3600), F.floor((x % 3600) / 60), F.floor(x % 60)
    ms = F.round((x - F.floor(x)) * 1000).cast("long")
    return F.concat_ws(
        " ",
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))),
        F.when((m > 0) | (h > 0), F.concat(m.cast("string"), F.lit("m"))),
        F.concat(s.cast("string"), F.lit("s")),
        F.concat(ms.cast("string"), F.lit("ms")),
    )


def archetype_key(raw: Column) -> Column:
    """Spelling-free key of an archetype name: case, blanks and underscores do not count."""
    return F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[ _]", "")


def query_text(question: Column, model: Column) -> Column:
    """Retrieval queries of instruction-tuned small models carry an instruction; nothing else does."""
    return F.when(F.lower(model).contains("bge"), F.concat(F.lit(QUERY_INSTRUCTION), question)).otherwise(question)


def numbered_block(items: Column) -> Column:
    """'1. a', '2. b', ... on lines of their own."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


# Characters shown of a passage nothing was found in, of judged evidence, of the weakest question, of a paper's opening.
EXCERPTS = {"not_found": 200, "judged": 300, "weakest": 200, "opening": 5000}
# End of fixed values.


def excerpt(c: Column, view: str) -> Column:
    """The leading characters a view shows; a null text shows nothing."""
    return F.substring(F.coalesce(c, F.lit("")), 1, EXCERPTS[view])
