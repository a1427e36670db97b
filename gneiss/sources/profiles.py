"""User profiles in Markdown: sections read into columns, and columns written as Markdown again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.arrays import let
from gneiss.sources.memory_files import _strip

#: The fields of the sections of ``- **key**: value`` lines, with their types, in the order in which they are written.
PREFERENCES = {"language": "string", "verbosity": "string", "response_style": "string", "preferred_framework": "string", "preferred_test_framework": "string", "auto_format": "boolean"}
CODING_STYLE = {"indent_style": "string", "indent_size": "int", "quote_style": "string", "semicolons": "boolean", "trailing_comma": "boolean", "max_line_length": "int", "naming_convention": "string"}
#: Words for true.
YES = ("true", "yes", "1")
HEADING = r"(?dUm)^##\s+(.+)$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _key(x: Column) -> Column:
    return F.replace(F.lower(_strip(x)), F.lit(" "), F.lit("_"))


def _last(pairs: Column, key: str) -> Column:
    """The value of a key's last pair, or null."""
    found = F.filter(pairs, lambda p: p["key"] == key)
    return F.try_element_at(found, F.lit(-1))["value"]


def _lines(body: Column) -> Column:
    return F.transform(F.split(F.coalesce(body, F.lit("")), LINE_END), _strip)


def _typed(value: Column, kind: str) -> Column:
    """A field from its text: what is missing is empty, zero or false; a number that is none is zero."""
    text = F.coalesce(value, F.lit(""))
    if kind == "boolean":
        return F.lower(text).isin(*YES)
    if kind == "int":
        whole = F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(text, F.lit("_"), F.lit("")))
        return F.coalesce(whole.try_cast("int"), F.lit(0))
    return text


def parse(markdown: Column) -> Column:
    """A struct of ``preferences``, ``coding_style``, ``common_patterns``, ``project_context`` and ``custom_instructions``.

    Sections begin at ``## name``, whatever the case; of equal names the last one counts, and so does the last of equal keys. Lines that don't fit, unknown keys and sections are left out. A null text is a profile of empty fields.
    """
    pair = r"(?U)^-\s+\*\*(.+?)\*\*:\s*(.+)$"
    item = r"(?U)^-\s+(.+)$"

    def fields(body: Column, kinds: dict[str, str]) -> Column:
        found = F.transform(F.filter(_lines(body), lambda x: x.rlike(pair)), lambda x: F.struct(_key(F.regexp_extract(x, pair, 1)).alias("key"), _strip(F.regexp_extract(x, pair, 2)).alias("value")))
        return let(found, lambda f: F.struct(*[_typed(_last(f, k), kind).alias(k) for k, kind in kinds.items()]))

    def profile(sections: Column) -> Column:
        body = lambda name: _last(sections, name)
        patterns = F.transform(F.filter(_lines(body("common_patterns")), lambda x: x.rlike(item)), lambda x: _strip(F.regexp_extract(x, item, 1)))
        free = [_strip(F.coalesce(body(s), F.lit(""))).alias(s) for s in ("project_context", "custom_instructions")]
        return F.struct(fields(body("preferences"), PREFERENCES).alias("preferences"), fields(body("coding_style"), CODING_STYLE).alias("coding_style"), patterns.alias("common_patterns"), *free)

    def of_text(text: Column) -> Column:
        heads = F.transform(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), _key)
        bodies = F.split(text, HEADING)
        return let(F.zip_with(heads, F.slice(bodies, F.lit(2), F.size(heads)), lambda k, v: F.struct(k.alias("key"), v.alias("value"))), profile)

    return let(F.coalesce(markdown, F.lit("")), of_text)


def render(profile: Column) -> Column:
    """The Markdown of a struct as ``parse`` returns it; empty, zero, false and null fields, and sections without any, are left out."""

    def block(title: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"## {title}")), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    def fields(section: str, kinds: dict[str, str]) -> Column:
        said = []
        for k, kind in kinds.items():
            v = profile[section][k]
            set_ = v if kind == "boolean" else v != (0 if kind == "int" else "")
            said.append(F.when(set_, F.concat(F.lit(f"- **{k.replace('_', ' ').title()}**: "), v.cast("string"))))
        return F.array_compact(F.array(*said))

    patterns = F.transform(F.coalesce(profile["common_patterns"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))
    free = [block(t, F.filter(F.array(profile[s]), lambda x: x != "")) for t, s in (("Project Context", "project_context"), ("Custom Instructions", "custom_instructions"))]
    head = F.array(F.lit("# User Profile"), F.lit(""))
    return F.array_join(F.concat(head, block("Preferences", fields("preferences", PREFERENCES)), block("Coding Style", fields("coding_style", CODING_STYLE)), block("Common Patterns", patterns), *free), "\n")
