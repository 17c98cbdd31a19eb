"""Globs, braces and paths: compiled on the driver, matched by the JVM's regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_braces(pattern: str) -> list[str]:
    """All alternatives of nested {a,b} groups; a backslash keeps the next character literal."""
    group = re.search(r"(?<!\\)(?:\\\\)*\{", pattern)
    if not group:
        return [pattern]
    start, depth, cuts = group.end() - 1, 0, []
    for i in range(start, len(pattern)):
        depth += {"{": 1, "}": -1}.get(pattern[i], 0)
        if depth == 0:
            break
        if (pattern[i] == "," and depth == 1) or i == start:
            cuts.append(i)
    else:
        i = len(pattern)
    parts = [pattern[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], i], strict=True)]
    return [out for part in parts for out in expand_braces(pattern[:start] + part + pattern[i + 1 :])]


def to_regex(pattern: str, ignore_case: bool = True) -> str:
    """One glob as a Java regular expression for a whole path.

    A leading slash anchors it, otherwise it matches below any folder. * and ? stay within one component, ** does not.
    """
    body = pattern if pattern.startswith("/") else "**/" + pattern
    tokens = re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?\]?[^\]]*\]|\\.|.", body, re.S)
    known = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = []
    for t in tokens:
        if t in known:
            out.append(known[t])
        elif len(t) > 2 and t[0] == "[":
            inner = t[1:-1]
            inner = ("^/" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{inner}]" if inner[0] == "^" else f"[{inner}&&[^/]]")
        else:
            out.append(re.escape(t[-1]))
    # a path's own leading slash belongs to the folders of an unanchored pattern
    return ("(?is)" if ignore_case else "(?s)") + ("\\A" if pattern.startswith("/") else "\\A/?") + "".join(out) + "\\z"


def matches(path: Column, patterns: str | list[str], ignore_case: bool = True) -> Column:
    """Whether a path matches any alternative of any pattern."""
    patterns = [patterns] if isinstance(patterns, str) else patterns
    out = F.lit(False)
    for regex in dict.fromkeys(to_regex(p, ignore_case) for pattern in patterns for p in expand_braces(pattern)):
        out |= path.rlike(regex)
    return out


def literal_prefix(pattern: str) -> str:
    """The text with which every path begins that an anchored pattern matches; empty for others."""
    return re.match(r"[^*?\[\]{}\\]*", pattern)[0] if pattern.startswith("/") else ""


def select(entries: DataFrame, include: str | list[str], exclude: list[str] = (), path: str = "path", ignore_case: bool = True) -> DataFrame:
    """Entries that match an include and no exclude. Literal prefixes become range predicates, which scans can skip by."""
    patterns = [include] if isinstance(include, str) else list(include)
    keep = matches(F.col(path), patterns, ignore_case)
    if len(patterns) == 1 and not ignore_case and (prefix := literal_prefix(patterns[0])):
        keep = (F.col(path) >= prefix) & (F.col(path) < prefix[:-1] + chr(ord(prefix[-1]) + 1)) & keep
    for pattern in exclude:
        keep &= ~matches(F.col(path), pattern, ignore_case)
    return entries.where(keep)


def lookup(entries: DataFrame, paths: list[str], path: str = "path") -> DataFrame:
    """The entries at some paths, told by their components: doubled and final slashes do not count."""
    wanted = ["/" + "/".join(split_path(p)) for p in paths]
    return entries.where(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.col(path), r"\A/+|/+\z", ""), "/+", "/")).isin(wanted))


def split_path(path: str, colon: bool = False) -> list[str]:
    """Components of a path; in the slash grammar a backslash escapes a slash or a backslash, and is literal elsewhere."""
    if colon:
        return [p for p in path.split(":") if p]
    parts = re.findall(r"(?:\\[/\\]|[^/])+", path)
    return [re.sub(r"\\([/\\])", r"\1", p) for p in parts]


@dataclass(frozen=True)
class ImageRef:
    path: str
    partition: int | None


def image_ref(text: str) -> ImageRef:
    """path@N, N from 1; without a number the default partition."""
    found = re.fullmatch(r"(.*)@(\d+)", text, re.S)
    if not found:
        return ImageRef(text, None)
    if int(found[2]) == 0:
        raise ValueError("partitions are numbered from 1")
    return ImageRef(found[1], int(found[2]))


def default_partition(partitions: DataFrame) -> DataFrame:
    """The one partition of each image that is no container, driver or map; an error where there is not exactly one."""
    kind = F.coalesce(F.col("type_string"), F.lit(""))
    usable = partitions.where(~F.col("is_extended") & ~F.startswith(kind, F.lit("Apple_Driver")) & (kind != "Apple_partition_map"))
    found = usable.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.first("part_index").alias("part_index"), F.array_sort(F.collect_list("part_index")).alias("all"))
    one = F.when(F.col("n") == 1, F.col("part_index")).otherwise(F.raise_error(F.concat(F.lit("choose a partition of "), "image_id", F.lit(": "), F.array_join(F.transform("all", lambda x: x.cast("string")), ", "))).cast("int"))
    return found.select("image_id", one.alias("part_index"))
