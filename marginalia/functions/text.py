"""Text functions as column expressions: all run in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one ASCII character and marks, and that character."""
    pairs = []
    for code in range(0xA0, 0x10000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_MARKED, _PLAIN = _marked_letters()
#: Ligatures and typographic quotes, and what they stand for.
_EXPANSIONS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'", "“": '"', "”": '"'}
_LIGATURES = [c for c in _EXPANSIONS if _EXPANSIONS[c].isalpha()]
SLUG_CHARS = 200


def plain_letters(c: Column) -> Column:
    """Letters without their marks, whether composed or followed by combining ones; ligatures as letters."""
    for old in _LIGATURES:
        c = F.replace(c, F.lit(old), F.lit(_EXPANSIONS[old]))
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), "[\\x{300}-\\x{36F}]", "")


def tidy(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Fixed value: the characters that a pattern's \\s is with (?U).
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def tidy_ends(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def normal_key(c: Column) -> Column:
    """Lower-case words of letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(plain_letters(c)), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """Words joined by hyphens; an ampersand is the word and. The cut to 200 characters comes last. Null stays null."""
    spelled = F.replace(F.lower(plain_letters(c)), F.lit("&"), F.lit(" and "))
    return F.substring(F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, SLUG_CHARS)


def expand_ligatures(c: Column) -> Column:
    for old, new in _EXPANSIONS.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def dehyphenate(c: Column) -> Column:
    """Words that a hyphen splits over two lines are joined."""
    return F.regexp_replace(c, "([a-z])-\n([a-z])", "$1$2")


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def decode_entities(c: Column) -> Column:
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def occurrences(haystack: Column, needle: str) -> Column:
    """How often a non-empty string occurs, without overlaps."""
    return F.floor((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def word_count(c: Column) -> Column:
    """Words are separated by white space; null and blank texts have none."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")).cast("long")


def lines_of(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\r?\n")


def outer_lines(c: Column) -> Column:
    """The first two and the last two lines that aren't blank, in their order; a line may stand among both. Only the ends of a text are searched."""
    ends = r"(?U)^\s*+[^\n]*+(?:\n\s*+[^\n]*+)?+"
    text = F.coalesce(c, F.lit(""))
    outer = F.concat_ws("\n", F.regexp_extract(text, ends, 0), F.reverse(F.regexp_extract(F.reverse(text), ends, 0)))
    return F.filter(lines_of(outer), lambda x: tidy_ends(x) != "")


def is_folio(line: Column) -> Column:
    """A line that is a page number only."""
    return line.rlike(r"(?U)^\s*[0-9]{1,3}\s*$")


def furniture_key(line: Column) -> Column:
    """What is equal in running heads of different pages: white space single, lower case."""
    return F.lower(tidy(line))


#: The roman numbers that are read.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def small_number(c: Column) -> Column:
    """An arabic number, or a roman one from i to x; else null."""
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return F.coalesce(F.trim(c).try_cast("int"), F.try_element_at(roman, F.lower(F.trim(c))))


def first_line(c: Column) -> Column:
    return F.substring_index(F.coalesce(c, F.lit("")), "\n", 1)


def standfirst(text: Column, least: int = 60, lines: int = 4, floor: int = 120, cut: int = 420, early: int = 140) -> Column:
    """A summary from the first lines of prose: long ones that begin like a sentence and have a word in lower case. It ends with the last
    sentence that ends in the first characters, else with an ellipsis. Null if there is too little, or too few letters."""
    prose = F.filter(F.transform(lines_of(text), tidy), lambda x: (F.length(x) > least) & x.rlike("^[A-Z\"'(]") & x.rlike("[a-z]{4}"))
    joined = F.array_join(F.slice(prose, 1, lines), " ")
    head = F.substring(joined, 1, cut)
    at = F.instr(F.reverse(head), " .")
    stop = F.length(head) - at  # characters up to the last full stop before a space, with it
    short = F.when((at > 0) & (stop - 1 > early), F.substring(head, F.lit(1), stop)).otherwise(F.concat(F.trim(head), F.lit("…")))
    return F.when((F.length(joined) >= floor) & (F.regexp_count(short, F.lit("[A-Za-z]")) * 10 >= F.length(short) * 7), F.trim(short))


def contained_key(c: Column) -> Column:
    """Lower-case letters and digits only; an ampersand is the word and."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")


def clean_title(c: Column) -> Column:
    """Ligatures as letters, no REPRINT before it, white space single, no dashes before and no commas, semicolons and colons after it."""
    bare = tidy(F.regexp_replace(expand_ligatures(c), r"(?i)^REPRINT\s+", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[-–—\s]+", ""), r"[\s,;:]+$", ""))


def agree(a: Column, b: Column, ignored: Sequence[str] = (), share: float = 0.34, longer_than: int = 3) -> Column:
    """Whether two titles have so large a share of the longer words of the one with fewer in common, ``ignored`` ones left out; true if either has none."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > longer_than) & ~w.isin(*ignored))) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return (least == 0) | (F.size(F.array_intersect(x, y)) >= F.lit(share) * least)


def with_picked_title(df: DataFrame, front: Column, contents: Column, confident: Column, garbled: Callable[[Column], Column], recased: Callable[[Column], Column], ignored: Sequence[str]) -> DataFrame:
    """The rows with _picked (title, source, needs_review): the headline of the opening page if it is certain, else the contents entry, else the uncertain headline.

    Both are cleaned first, and can't be ``garbled``; the one that is taken is ``recased``. A certain headline needs review if the contents entry is usable and disagrees, words
    ``ignored`` left out; so does an uncertain one, and if there is none.
    """
    rows = df.withColumns({"_front": F.nullif(clean_title(front), F.lit("")), "_contents": F.nullif(clean_title(contents), F.lit("")), "_sure": F.coalesce(confident, F.lit(False))})
    rows = rows.withColumns({c: F.when(~garbled(F.col(c)), F.col(c)) for c in ("_front", "_contents")})
    source = (
        F.when(F.col("_front").isNotNull() & F.col("_sure"), "front page").when(F.col("_contents").isNotNull(), "contents")
        .when(F.col("_front").isNotNull(), "front page (unverified)").otherwise("none")
    )
    disagree = F.col("_contents").isNotNull() & ~agree(F.col("_front"), F.col("_contents"), ignored)
    review = F.when(F.col("_source") == "front page", disagree).otherwise(F.col("_source") != "contents")
    rows = rows.withColumn("_source", source).withColumn("_chosen", F.when(F.col("_source") == "contents", F.col("_contents")).otherwise(F.col("_front")))
    return rows.withColumn("_picked", F.struct(recased(F.col("_chosen")).alias("title"), F.col("_source").alias("source"), review.alias("needs_review"))).drop("_front", "_contents", "_sure", "_source", "_chosen")


def overlap(a: Column, b: Column) -> Column:
    """Shared words as a share of the smaller set of words; 0 if either has none."""
    x, y = (F.array_distinct(F.filter(F.split(normal_key(c), " "), lambda w: w != "")) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)
