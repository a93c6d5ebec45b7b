"""Column expressions over texts: rule hits, entities, clauses, keywords and names of sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from re import _parser as regex

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import values as V

def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def needed(pattern: str) -> frozenset[str] | None:
    """Lower-case texts of which every match of a pattern, case aside, holds at least one; None if there are none to tell.

    Read off the parsed pattern: a run of letters, what a group needs, or one need of each branch. Of several needs the one whose shortest text is longest.
    """
    def of(nodes) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run = ""
        for op, value in [*nodes, (None, None)]:
            if op is regex.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append(frozenset([run.lower()]))
                run = ""
            inner = None
            if op is regex.SUBPATTERN:
                inner = of(value[3])
            elif op is regex.BRANCH:
                each = [of(branch) for branch in value[1]]
                inner = frozenset().union(*each) if all(each) else None
            elif op in (regex.MAX_REPEAT, regex.MIN_REPEAT, regex.POSSESSIVE_REPEAT) and value[0] > 0:
                inner = of(value[2])
            if inner:
                found.append(inner)
        return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)

    try:
        return of(regex.parse(pattern))
    except (re.error, OverflowError, RecursionError):  # what only Java reads is searched without
        return None


def needed_of_any(patterns: Sequence[str]) -> list[str] | None:
    """``needed`` of a match of any of the patterns."""
    each = [needed(p) for p in patterns]
    return sorted(frozenset().union(*each)) if each and all(each) else None


def rule_hits(text: str, rules: Sequence = V.RULES) -> Column:
    """array of (signal_type, base_score, patterns): for each type its best rule that matches and that rule's matching patterns.

    ``text`` is a column's name or an SQL expression. Patterns are literals, so each compiles once per task, and lower rules are only
    searched if no better one matches. Patterns are slow beside plain search, so a rule is only tried on texts that hold one of the words its matches need, or
    characters beyond ASCII, whose cases are not that plain. Of rules with equal scores the earlier one wins. A null text has no hits. The body is a
    lambda over the lower-cased text, which is computed once and keeps the long body out of the generated code; it is given as SQL text, as that
    is read in one step.
    """
    hits = []
    for kind in dict.fromkeys(r[0] for r in rules):
        best = []
        for _, score, patterns in sorted((r for r in rules if r[0] == kind), key=lambda r: -r[1]):
            any_ = sql_string("(?iUd)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
            found = ", ".join(f"if(s.t rlike {sql_string('(?iUd)' + p)}, {sql_string(p)}, null)" for p in patterns)
            words = needed_of_any(patterns)
            held = "" if words is None else "(s.wide or " + " or ".join(f"contains(s.t, {sql_string(w)})" for w in words) + ") and "
            best.append(f"if({held}s.t rlike {any_}, named_struct('signal_type', {sql_string(kind)}, 'base_score', double({score}), 'patterns', filter(array({found}), p -> p is not null)), null)")
        hits.append(f"coalesce({', '.join(best)})")
    return F.expr(f"element_at(transform(transform(array(lower({text})), t -> named_struct('t', t, 'wide', t rlike '[^\\\\x00-\\\\x7F]')), s -> filter(array({', '.join(hits)}), h -> h is not null)), 1)")


def once(value: Column, body) -> Column:
    """``body(value)`` inside a lambda: the value is computed once, and a long body stays out of the generated code, whose methods have a size limit."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, add, block: int = 64, levels: int = 3) -> Column:
    """Running results of an associative ``add`` over an array, in steps that grow in proportion to it: blocks are added up, their totals
    scanned the same way, and each element adds up its own block only."""
    def fold(a: Column) -> Column:
        return F.aggregate(a, zero, add)

    def long(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(block)), lambda at: F.slice(a, at + 1, F.lit(block)))
        return once(blocks, lambda bs: once(running(F.transform(bs, fold), zero, add, block, levels - 1), lambda before: F.flatten(F.transform(
            bs, lambda b, k: once(F.coalesce(F.get(before, k - 1), zero), lambda start: F.transform(b, lambda x, i: F.aggregate(F.slice(b, 1, i + 1), start, add)))))))

    return once(values, lambda a: F.when(F.size(a) <= block, F.transform(a, lambda x, i: fold(F.slice(a, 1, i + 1)))).otherwise(long(a) if levels > 1 else F.transform(a, lambda x, i: fold(F.slice(a, 1, i + 1)))))


def first_contained(text: Column, names: Mapping[str, object], default: Column, lower: bool = True) -> Column:
    """The value of the first key that ``text`` contains, in order of the keys."""
    chain = None
    for key, value in names.items():
        hit = text.contains(key.lower() if lower else key)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return default if chain is None else chain.otherwise(default)


def contained_credibility(source: Column) -> Column:
    return first_contained(F.lower(source), V.CREDIBILITY, F.lit(V.DEFAULT_CREDIBILITY))


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """The value of an exact key."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def source_of_url(url: Column, hosts: Mapping[str, str]) -> Column:
    host = F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)
    label = F.substring_index(F.replace(host, F.lit("www."), F.lit("")), ".", 1)
    label = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substring(label, 2, 1000)))
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit("Unknown")).otherwise(first_contained(host, hosts, label, lower=False))


def relevance(title: Column, snippet: Column, company: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """0.3 for the company's name (0.1 for a part of it longer than 3 characters), 0.12 for each category with a keyword, at most 1."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    name = F.lower(company)
    part = F.exists(F.split(name, r"\s+"), lambda p: (F.length(p) > 3) & text.contains(p))
    score = F.when(text.contains(name), 0.3).when(part, 0.1).otherwise(0.0)
    for words in keywords.values():
        hit = None
        for word in words:  # plain letters: an upper-case keyword never occurs in a lower-cased text
            hit = text.contains(word) if hit is None else hit | text.contains(word)
        score = score + F.when(hit, 0.12).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def entities(text: Column) -> Column:
    """Company names, amounts and percentages, distinct in this order, at most MOST_ENTITIES."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (V.ENTITY_COMPANY, "(?i)" + V.ENTITY_AMOUNT, V.ENTITY_PERCENT)])
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.trim(x))), 1, V.MOST_ENTITIES)


def clauses(text: Column, templates: Sequence = V.CLAUSES) -> Column:
    """array of (kind_no, pattern_no, start, kind, confidence, clause, context) of all clause matches in a text.

    A text is tested once for each kind; only where it holds one are the kind's patterns searched. Running sums of the lengths of the matches and of
    the pieces between them give the offsets, in characters.
    """
    each = F.struct(text.alias("t"), F.lower(text).alias("low"), text.rlike(r"[^\x00-\x7F]").alias("wide"))
    return once(each, lambda s: _placed(s["t"], _matches(s["t"], s["low"], s["wide"], templates)))


def _matches(text: Column, low: Column, wide: Column, templates: Sequence) -> Column:
    """array of (kind_no, pattern_no, kind, confidence, found, gaps) of the patterns that match, with the lengths of the pieces before each match; ``low`` is the
    lower-cased text, ``wide`` whether it goes beyond ASCII."""
    out = []
    for k, (kind, confidence, patterns) in enumerate(templates):
        own = []
        for p, pattern in enumerate(patterns):
            rx = F.lit("(?iUd)" + pattern)
            row = F.struct(
                F.lit(k).alias("kind_no"), F.lit(p).alias("pattern_no"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"),
                F.regexp_extract_all(text, rx, F.lit(0)).alias("found"), F.transform(F.split(text, "(?iUd)" + pattern, -1), F.length).alias("gaps"),
            )
            own.append(F.when(F.rlike(text, rx), row))
        words = needed_of_any(patterns)
        held = text.rlike("(?iUd)" + "|".join(f"(?:{p})" for p in patterns))
        if words is not None:
            may = wide
            for w in words:
                may = may | low.contains(w)
            held = may & held
        out.append(F.when(held, F.array(*own)))
    return F.filter(F.flatten(F.filter(F.array(*out), lambda a: a.isNotNull())), lambda m: m.isNotNull())


def _placed(text: Column, matches: Column) -> Column:
    def row(m: Column, clause: Column, end: Column) -> Column:
        start = end - F.length(clause)
        lo = F.greatest(F.lit(0), start - V.CLAUSE_WINDOW)
        context = F.trim(F.substring(text, lo + 1, end + V.CLAUSE_WINDOW - lo))
        return F.struct(m["kind_no"].alias("kind_no"), m["pattern_no"].alias("pattern_no"), start.alias("start"), m["kind"].alias("kind"), m["confidence"].alias("confidence"), F.trim(clause).alias("clause"), context.alias("context"))

    def of(m: Column) -> Column:
        ends = running(F.transform(m["found"], lambda c, i: F.get(m["gaps"], i) + F.length(c)), F.lit(0), lambda a, n: a + n)
        return once(ends, lambda e: F.transform(m["found"], lambda c, i: row(m, c, F.get(e, i))))

    return F.flatten(F.transform(matches, of))


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up as a decimal, so that a value that ends on a half does not hang on how its double is stored."""
    return F.round(x.cast("decimal(20,8)"), digits).cast("double")
