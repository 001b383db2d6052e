"""Path rules: globs and a subset of regular expressions, compiled on the driver to patterns that the JVM matches.

A rule without a slash matches at any depth. ``*`` and ``?`` stay within a component; ``**`` stands for whole components, and at the end for
one character or more. ``re:`` rules are patterns over the whole path without anchors, groups of the ``(?`` kind, letter or digit escapes, or
empty components. Both kinds are read by one token pattern each, and a table says what each token becomes or why it is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleError(ValueError):
    """All defects of a rule set."""


_WILD = {"*": "[^/]*", "?": "[^/]"}
_GLOB = re.compile(r"[*?]|[^*?]+")
_META = re.compile(r"[\\.\[\]{}()+^$|#&~-]")
#: What a whole-component wildcard stands for, at the end of a rule and before it.
_TAIL, _FOLDERS = ".+", "(?:[^/]+/)*"


def glob_pattern(rule: str) -> str:
    """The pattern of a whole path for a glob; raises for empty components and for ``**`` beside other characters."""
    if not rule:
        raise RuleError("empty rule")
    *folders, name = (rule if "/" in rule else f"**/{rule}").split("/")
    for part in (*folders, name):
        if not part or ("**" in part and part != "**"):
            raise RuleError(f"{rule}: " + ("** must be a whole component" if part else "empty component"))
    known = lambda part: _GLOB.sub(lambda m: _WILD.get(m[0]) or _META.sub(r"\\\g<0>", m[0]), part)
    before = (_FOLDERS if part == "**" else known(part) + "/" for part in folders)
    return "".join(before) + (_TAIL if name == "**" else known(name))


#: Tokens of a ``re:`` rule, tried in this order; those that are refused stand with the reason.
_TOKENS = {
    "escape": r"\\[^0-9A-Za-z]", "set": r"\[\^?\]?(?:\\[^0-9A-Za-z]|[^\]\\])*\]", "count": r"\{\d+(?:,\d*)?\}", "odd_escape": r"\\", "open_set": r"\[", "group": r"\(\?", "anchor": r"[\^$]", "brace": r"[{}]", "slash": "/", "rest": ".",
}
_REFUSED = {"odd_escape": "escapes of letters and digits aren't portable", "open_set": "unterminated or unportable class", "group": "(? isn't portable", "anchor": "anchors are implied", "brace": "stray brace"}
_REGEX = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _TOKENS.items()), re.S)


def _regex_pattern(text: str) -> str:
    kinds = [m.lastgroup for m in _REGEX.finditer(text)]
    slashes = [-1, *(i for i, k in enumerate(kinds) if k == "slash"), len(kinds)]
    defects = [_REFUSED[k] for k in kinds if k in _REFUSED] + ["empty component"] * any(b - a == 1 for a, b in zip(slashes, slashes[1:]))
    if defects:
        raise RuleError(f"re:{text}: {defects[0]}")
    try:
        re.compile(text)
    except re.error as e:
        raise RuleError(f"re:{text}: {e}") from e
    return text


def rule_pattern(rule: str, case_sensitive: bool = True) -> str:
    """A pattern for the whole path: dot matches newlines, and the end is the very end."""
    body = _regex_pattern(rule[3:]) if rule.startswith("re:") else glob_pattern(rule)
    return f"(?s{'' if case_sensitive else 'iu'})\\A(?:{body})\\z"


def validate(rules: list[str]) -> list[str]:
    """What is wrong with the rules: all defects, none if the set is fit for use."""
    out = []
    for r in rules:
        try:
            rule_pattern(r)
        except RuleError as e:
            out.append(str(e))
    return out


def matches(path: Column, rule: str, case_sensitive: bool = True) -> Column:
    return path.rlike(rule_pattern(rule, case_sensitive))


def prefixes(path: Column) -> Column:
    """A path and its ancestors, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def any_rule(path: Column, rules: list[str], case_sensitive: bool = True) -> Column:
    """Whether a rule matches the path or an ancestor; the rules become one pattern."""
    if not rules:
        return F.lit(False)
    pattern = "|".join(f"(?:{rule_pattern(r, case_sensitive)})" for r in rules)
    return F.exists(prefixes(path), lambda p: p.rlike(pattern))


def evaluate(paths: DataFrame, includes: list[str], excludes: list[str], case_sensitive: bool = True) -> DataFrame:
    """``paths`` with captured and descend. Excludes win; a rule on an ancestor holds for the subtree; without includes all is included.

    An invalid set raises with every defect. Null paths are not captured.
    """
    if defects := validate([*includes, *excludes]):
        raise RuleError("; ".join(defects))
    out = any_rule(F.col("path"), excludes, case_sensitive)
    inside = any_rule(F.col("path"), includes, case_sensitive) if includes else F.lit(True)
    here = F.col("path").isNotNull()
    return paths.withColumn("captured", here & F.coalesce(~out & inside, F.lit(False))).withColumn("descend", here & F.coalesce(~out, F.lit(False)))
