"""Headings: their numbers, their plain form, aliases, and how two of them are related."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunks import once, stripped

#: Digits of numbers in headings, and the forms of numbered headings as (number, title), tried in this order.
NUMERALS = "零一二三四五六七八九"
FORMS = (
    r"^(第[一二三四五六七八九十百零〇0-9]+章)\s*([^\n]+?)\s*$",
    r"^(第[一二三四五六七八九十百零〇0-9]+节)\s*([^\n]+?)\s*$",
    r"^(第[一二三四五六七八九十百零〇0-9]+条)\s*([^\n]+?)\s*$",
    r"^([一二三四五六七八九十]+)[、.．]\s*([^\n]+?)\s*$",
    r"^[（(]([一二三四五六七八九十0-9]+)[)）]\s*([^\n]+?)\s*$",
    r"^([0-9]+\.[0-9]+(?:\.[0-9]+){0,2})(?:[、.．])?\s*([^\n]+?)\s*$",
    r"^([0-9]{1,2})(?:\s*[、.．]\s*|\s+)([^\n]+?)\s*$",
    r"^([0-9]{1,2})([一-鿿][^\n]+?)\s*$",
)
#: A number alone, in words or with dots; fillers of tables of contents; punctuation that counts as a space.
UNIT_ALONE, NUMERAL_ALONE, DOTTED_ALONE = r"^第[一二三四五六七八九十百零〇0-9]+[章节条]$", r"^[一二三四五六七八九十百零〇0-9]+$", r"^[0-9]+(\.[0-9]+){0,3}$"
FILLER, PUNCTUATION = r"[.。·…]{2,}", r"[：:+（）()【】\[\]、,.，。;；/\\-]+"
#: The characters of PUNCTUATION and white space.
GAPS = "：:+（）()【】[]、,.，。;；/\\- \t\n\x0b\f\r"
IDEOGRAPH = "[一-鿿]"


def normalised(text: Column) -> Column:
    """The title without its number, fillers and punctuation; no gap between ideographs."""
    return once(F.trim(stripped(text)), _normalised)


def _title(t: Column) -> Column:
    return reduce(lambda found, form: found.when(t.rlike(form), F.regexp_extract(t, form, 2)), FORMS[1:], F.when(t.rlike(FORMS[0]), F.regexp_extract(t, FORMS[0], 2))).otherwise(t)


def _normalised(t: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(_title(t), FILLER, " "), PUNCTUATION, " "), r"\s+", " ")
    return F.regexp_replace(F.trim(spaced), f"(?<={IDEOGRAPH}) (?={IDEOGRAPH})", "")


def compact(text: Column) -> Column:
    """The same without spaces: all that would become one goes at once."""
    return once(F.trim(stripped(text)), lambda t: F.translate(F.regexp_replace(_title(t), FILLER, ""), GAPS, ""))


def aliases(text: Column) -> Column:
    """Up to five forms under which a heading is looked up, the plain one first; none for an empty heading."""
    own = normalised(text)
    close = F.replace(own, F.lit(" "), F.lit(""))
    long = F.length(own) > 4
    found = F.array(
        own,
        close,
        F.replace(close, F.lit("及"), F.lit("")),
        F.when(own.startswith("系统") & long, F.trim(F.substr(own, F.lit(3)))),
        F.when(own.startswith("总体") & long, F.concat(F.lit("系统"), own)),
    )
    return F.array_distinct(F.filter(found, lambda a: a.isNotNull() & (a != "")))


def numeral(token: Column) -> Column:
    """A number in digits or in words up to 99; null for anything else."""
    bare = F.regexp_replace(F.trim(token), "^第|[章节条]$", "")
    before, after = F.substring_index(bare, "十", 1), F.substr(bare, F.instr(bare, "十") + 1)
    words = (
        F.when(bare == "十", F.lit(10))
        .when(~bare.contains("十"), _digit(bare))
        .when(bare.startswith("十"), 10 + F.coalesce(_digit(after), F.lit(0)))
        .when(bare.endswith("十"), F.coalesce(_digit(before), F.lit(0)) * 10)
        .otherwise(_digit(before) * 10 + _digit(after))
    )
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")).otherwise(words)


def _digit(c: Column) -> Column:
    table = F.create_map(*(x for i, n in enumerate(NUMERALS) for x in (F.lit(n), F.lit(i))), F.lit("〇"), F.lit(0))
    return table[c]


def ordinals(text: Column) -> Column:
    """The numbers of a heading, outermost first: [3, 2, 1] of "3.2.1 Title"; empty where it has none."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    one = lambda token: F.array(numeral(token))
    dotted = lambda token: F.transform(F.split(token, r"\."), lambda n: n.try_cast("int"))
    found = F.when(t.rlike(UNIT_ALONE) | t.rlike(NUMERAL_ALONE), one(t)).when(t.rlike(DOTTED_ALONE), dotted(t))
    for form in FORMS[:5]:
        found = found.when(t.rlike(form), one(F.regexp_extract(t, form, 1)))
    for form in FORMS[5:]:
        found = found.when(t.rlike(form), dotted(F.regexp_extract(t, form, 1)))
    return F.array_compact(F.coalesce(found, F.array().cast("array<int>")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading numbers two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    return F.when(n > 0, same).otherwise(F.lit(0))


def may_be_parent(parent: Column, child: Column) -> Column:
    """Whether a heading's numbers are a strict prefix, and not empty."""
    return (F.size(parent) > 0) & (F.size(parent) < F.size(child)) & (F.slice(child, F.lit(1), F.size(parent)) == parent)


def family(text: Column) -> Column:
    """The leading dotted number of a heading, as an array of strings."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(number != "", F.split(number, r"\.")).otherwise(F.array().cast("array<string>"))


#: Similarity of headings whose first two numbers agree, and of those of which only the first does.
FAMILY_CLOSE, FAMILY_SAME = 0.2, 0.12


def family_similarity(a: Column, b: Column) -> Column:
    return family_closeness(family(a), family(b))


def family_closeness(x: Column, y: Column) -> Column:
    """The same of two numbers as ``family`` gives them."""
    both = (F.size(x) > 0) & (F.size(y) > 0)
    two = (F.size(x) >= 2) & (F.size(y) >= 2) & (F.slice(x, 1, 2) == F.slice(y, 1, 2))
    return F.when(both & (F.get(x, F.lit(0)) == F.get(y, F.lit(0))), F.when(two, F.lit(FAMILY_CLOSE)).otherwise(F.lit(FAMILY_SAME))).otherwise(F.lit(0.0))
