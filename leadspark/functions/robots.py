"""robots.txt rules: the wildcard-agent groups and the longest-match verdict."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .derive import let

_AGENT_LINE = r"(?i)(?:^|\n)[^\S\n]*user-agent[^\S\n]*:"


def wildcard_rules(text: Column, field: str) -> Column:
    """Non-empty values of `field` in the groups for agent `*`, in file order.

    The text is cut at its user-agent lines, so each piece starts with an agent
    name and holds the rules up to the next one.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"#[^\r\n]*", "")
    pieces = F.split(plain, _AGENT_LINE)
    groups = F.filter(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: p.rlike(r"^[^\S\n]*\*[^\S\n]*(\n|$)"),
    )
    lines = F.split(F.array_join(groups, "\n"), r"\r?\n")
    rule = rf"(?i)^\s*{field}\s*:\s*(\S[\s\S]*?)\s*$"
    values = F.transform(lines, lambda line: F.regexp_extract(line, rule, 1))
    return F.filter(values, lambda v: v != "")


def rule_matches(rule: Column, path: Column) -> Column:
    """`*` stands for any run and a final `$` anchors; otherwise a prefix match.

    Pieces between stars are located left to right, earliest first, so the cost
    stays linear on patterns built to make a regex backtrack.
    """
    anchored = F.endswith(rule, F.lit("$"))
    glob = F.when(anchored, F.regexp_replace(rule, r"\$$", "")).otherwise(
        F.concat(rule, F.lit("*"))
    )

    def advance(pos, piece):
        at = F.call_function("locate", piece, path, pos)
        return F.when((pos == 0) | (piece == ""), pos).otherwise(
            F.when(at == 0, F.lit(0)).otherwise(at + F.length(piece))
        )

    def fits(pieces):
        first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
        middle = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
        end = F.aggregate(middle, F.length(first) + 1, advance)
        room = F.length(path) - F.length(last) + 1
        spread = (
            F.startswith(path, first)
            & F.endswith(path, last)
            & let(end, lambda e: (e > 0) & (room >= e))
        )
        return F.when(F.size(pieces) == 1, path == first).otherwise(spread)

    return let(F.split(glob, r"\*"), fits)


def longest_match(rules: Column, path: Column) -> Column:
    hits = F.filter(rules, lambda r: rule_matches(r, path))
    return F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(-1))


def allowed(disallow: Column, allow: Column, path: Column) -> Column:
    """Longest rule as written wins, Allow wins ties, no rule allows."""
    empty = F.array().cast("array<string>")
    denied = longest_match(F.coalesce(disallow, empty), path)
    permitted = longest_match(F.coalesce(allow, empty), path)
    return (denied == -1) | (permitted >= denied)
