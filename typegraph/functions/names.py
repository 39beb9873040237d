"""How type names and file paths are read: the identity rules of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modifiers and operators that C# writes in front of a type name.
_LEAD = r"(?:(?:ref|out|in|params|readonly|scoped|this|new|typeof|nameof)[\s(]+)*"
_BARE = r"(?U)^[\s(]*" + _LEAD + r"(?:\w+\s*::\s*)?(@?\w+(?:\s*\.\s*@?\w+)*)"


def _without_arguments(name: Column) -> Column:
    """A name without its type arguments, however deep they nest.

    Names without nested ones, nearly all, take one regular expression or none; the others
    are walked bracket by bracket. A bracket that closes nothing stays.
    """
    flat = F.regexp_replace(name, "<[^<>]*>", "")
    parts = F.split(name, "(?=[<>])")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        opens, closes = part.startswith("<"), part.startswith(">") & (acc["depth"] > 0)
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        shown = F.when(depth > 0, "").otherwise(F.when(closes, F.substring(part, 2, 1_000_000_000)).otherwise(part))
        return F.struct(depth.alias("depth"), F.concat(acc["out"], shown).alias("out"))

    walked = F.aggregate(parts, start, step, lambda acc: acc["out"])
    nested = F.contains(flat, F.lit("<"))
    return F.when(~F.contains(name, F.lit("<")), name).when(~nested, flat).otherwise(walked)


def bare_key(name: Column) -> Column:
    """Upper-case bare or dotted name; null for a null, blank or nameless text.

    White space around the name, ``global::``, type arguments, arity marks, nullable
    marks, array ranks and pointers are not part of a name.
    """
    plain = F.regexp_replace(_without_arguments(name), r"`\d+", "")
    found = F.get(F.regexp_extract_all(plain, F.lit(_BARE), F.lit(1)), 0)
    return F.upper(F.translate(found, "@ \t\r\n\f\u00a0", ""))


def last_segment(key: Column) -> Column:
    """The part of a dotted name behind its last dot."""
    return F.substring_index(key, ".", -1)


def target_key(name: Column, resolved: Column) -> Column:
    """Full name of a resolved target, last segment of any other."""
    parts = F.when(resolved, F.lit(-1_000_000)).otherwise(F.lit(-1))
    return F.call_function("substring_index", bare_key(name), F.lit("."), parts)


def file_key(path: Column) -> Column:
    """One key for all spellings of a file on a case-insensitive file system.

    Either separator, repeated separators, ``.`` segments and ``x/..`` pairs are
    levelled; case is folded. Null stays null.
    """
    p = F.translate(path, "\\", "/")
    segments = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != "..")
        root = (part == "..") & (F.size(acc) == 0) & p.startswith("/")
        back = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(up, back).when(root, acc).otherwise(F.concat(acc, F.array(part)))

    walked = F.aggregate(segments, F.array().cast("array<string>"), step)
    walked = F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))
    # nearly all paths are plain and need no walk
    odd = p.rlike(r"//|(?:^|/)\.{1,2}(?:/|$)|./$")
    return F.upper(F.when(odd, walked).otherwise(p))


def relation_key(relation: Column) -> Column:
    """Relation label without case and surrounding blanks."""
    return F.lower(F.regexp_replace(relation, r"(?U)^\s+|\s+$", ""))
