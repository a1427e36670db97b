"""Column expressions over texts: lines, cuts, tokens, encodings, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that count as 1/1.5 token.
CJK = r"[一-鿿぀-ゟ゠-ヿ가-힯]"
#: Message overhead by role.
ROLE_TOKENS = {"system": 3, "user": 4, "assistant": 3, "assistant_tool_call": 7, "tool_result": 6, "assistant_progress": 3}


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def estimate_tokens(text: Column) -> Column:
    """0 if empty, else at least 1: a token for 1.5 CJK or 4 other characters, cut to a whole number."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), (cjk / F.lit(1.5) + (F.length(text) - cjk) / F.lit(4.0)).cast("long"))).cast("long")


def message_tokens(role: Column, text: Column) -> Column:
    over = F.lit(0)
    for name, n in ROLE_TOKENS.items():
        over = F.when(role == name, n).otherwise(over)
    return over.cast("long") + estimate_tokens(text)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def tokens(text: Column) -> Column:
    """Latin runs and single CJK characters in lower case, then CJK pairs that don't overlap."""
    return F.concat(F.transform(F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9]+|[一-鿿]"), F.lit(0)), F.lower), F.regexp_extract_all(text, F.lit(r"[一-鿿]{2}"), F.lit(0)))


def trimmed_lines(text: Column) -> Column:
    """Lines without outer white space, blank ones left out."""
    return F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def percent_encode(text: Column) -> Column:
    """Percent encoding that keeps letters, digits and _.-~/ only."""
    x = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def percent_decode(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def html_text(html: Column) -> Column:
    """Scripts and styles dropped, tags to spaces, six entities, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", "")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def head_tail(text: Column, most: int, head: int, tail: int) -> Column:
    """A text of more than ``most`` lines as its first and last ones around a note of how many are left out."""
    x = lines(text)
    n = F.size(x)
    cut = F.concat_ws("\n", F.slice(x, 1, head), F.array(F.concat(F.lit("... ["), (n - head - tail).cast("string"), F.lit(" lines omitted] ..."))), F.slice(x, -tail, tail))
    return F.when(n > most, cut).otherwise(text)


def middle_cut(text: Column, most: int, head: float = 0.6) -> Column:
    """A text of more than ``most`` characters as its head (60 %) and tail around a note."""
    h = int(most * head)
    t = most - h
    note = F.concat(F.lit("\n... ["), (F.length(text) - most).cast("string"), F.lit(" characters omitted] ...\n"))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(h)), note, F.right(text, F.lit(t)))).otherwise(text)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")


def display_width(text: Column) -> Column:
    """Columns on a terminal: wide characters count twice."""
    plain = strip_ansi(text)
    return (F.length(plain) + F.regexp_count(plain, F.lit(r"[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"))).cast("long")


def glob_regex(glob: str) -> str:
    """A regular expression for a glob whose * also crosses /."""
    special = set(".^$+{}[]()|\\")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in special else c for c in glob) + "$"
