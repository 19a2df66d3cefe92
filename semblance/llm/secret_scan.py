"""Secret scans: a trigram index names the texts in which a rule can match; the rule then verifies."""

from __future__ import annotations

import re._constants as ops
import re._parser as regex_tree
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import Scratch, let, lower_ascii, packed, same_key

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex of whole spans, and the least size of one of its groups (0: the span)."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The three base kinds, then kinds by public formats of tokens.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@[A-Za-z0-9]"),
)
RULES = BASE_RULES + MORE_RULES


def required_strings(regex: str) -> list[list[str]]:
    """Clauses of strings, lower-cased: every match contains a string of each clause.

    Reads the parsed regex from left to right and keeps the set of strings that may stand just
    there, as long as that set is small; where it ends, it becomes a clause if all its strings
    have a trigram. An empty list means that nothing is mandatory.
    """
    clauses: list[list[str]] = []

    def finite(op, arg) -> set[str] | None:
        if op is ops.LITERAL:
            return {chr(arg).lower()}
        if op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        if op is ops.SUBPATTERN:
            return language(arg[3])
        if op is ops.BRANCH:
            parts = [language(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[1] == 1 and arg[0] == 0:
            inner = language(arg[2])
            return None if inner is None else inner | {""}
        return None

    def language(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            more = finite(op, arg)
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a, b in ((a, b) for a in out for b in more)}
        return out

    def close(strings: set[str]) -> None:
        if min(map(len, strings)) >= 3:
            clauses.append(sorted(strings))

    here = {""}
    for op, arg in regex_tree.parse(regex):
        more = finite(op, arg)
        if more is None or len(here) * len(more) > MOST_STRINGS:
            close(here)
            here = {""} if more is None else more
        else:
            joined = {a + b for a in here for b in more}
            if min(map(len, here)) >= 3 and len(joined) > len(here):  # a complete clause is not spread by what may follow
                close(here)
                here = more
            else:
                here = joined
    close(here)
    return clauses


def trigram_query(rules: Sequence[Rule]) -> list[tuple[str, int, int, str, int]]:
    """(kind, clause, string, trigram, trigrams of the string): AND of clauses, OR of strings, AND of trigrams."""
    out = []
    for r in rules:
        for c, strings in enumerate(required_strings(r.regex)):
            for k, s in enumerate(strings):
                grams = sorted({s[i : i + 3] for i in range(len(s) - 2)})
                out += [(r.kind, c, k, g, len(grams)) for g in grams]
    return out


def postings(base: DataFrame, grams: Sequence[str]) -> DataFrame:
    """(trigram, id, th): the inverted index of lower-cased texts for the trigrams that queries use."""
    low = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    held = let(low, lambda t: F.filter(F.lit(list(grams)), lambda g: F.contains(t, g)))
    return base.select(F.explode(held).alias("trigram"), "id", "th")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(id, th, kinds): rules whose Boolean query a text's postings satisfy."""
    spark = index.sparkSession
    query = trigram_query(rules)
    wants = spark.createDataFrame(query, "kind string, clause int, string int, trigram string, needed int")
    clauses = spark.createDataFrame(sorted({(k, 1 + max(c for x, c, *_ in query if x == k)) for k, *_ in query}), "kind string, clauses int")
    # both tables follow from the rules alone
    strings = index.distinct().join(F.broadcast(wants), "trigram").groupBy("id", "th", "kind", "clause", "string", "needed").agg(F.count("*").alias("n")).where("n = needed")
    met = strings.groupBy("id", "th", "kind").agg(F.count_distinct("clause").alias("met")).join(F.broadcast(clauses), "kind").where("met = clauses")
    return met.groupBy("id", "th").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans (start, place, end, kind) of a rule's leftmost non-overlapping matches that are large enough.

    The parts between matches and the matches alternate, so their lengths give the positions in
    code points.
    """
    def located(between: Column, found: Column, sizes: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>").alias("spans"))

        def step(acc, m):
            begin = acc["at"] + F.char_length(between[acc["i"]])
            end = begin + F.char_length(m)
            fit = F.char_length(sizes[acc["i"]]) >= rule.least
            span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            return F.struct((acc["i"] + 1).alias("i"), end.alias("at"), F.when(fit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(found, start, step, lambda acc: acc["spans"])

    # runs of one class are the same spans with the least size in the pattern, and fewer of them
    pattern = re_least(rule)
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else every
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), lambda b: let(every, lambda f: let(sizes, lambda s: located(b, f, s))))).otherwise(none)


def re_least(rule: Rule) -> str:
    """The pattern; a run of one character class takes its least size into the pattern."""
    tree = list(regex_tree.parse(rule.regex))
    if rule.group == 0 and len(tree) == 1 and tree[0][0] is ops.MAX_REPEAT and rule.regex.endswith("]+"):
        return f"{rule.regex[:-1]}{{{rule.least},}}"
    return rule.regex


def secret_scan(docs: DataFrame, ident: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: row, id, th, spans: array of (start, place, end, kind) by start, then place of the rule.

    Spans are whole matches in code points, end exclusive. Matches of a rule are leftmost and do
    not overlap; those whose group is too small are dropped after that. Rules with mandatory
    trigrams are tried on the texts that the postings name, which are all that can match; others
    on every text. Null and empty texts have no span; rows equal in id and text get equal spans.
    """
    base = packed(docs, ident, text)
    query = trigram_query(rules)
    indexed = {k for k, *_ in query}
    full = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    if indexed:
        scratch = Scratch(docs.sparkSession)
        index = scratch.keep(postings(base, sorted({g for *_, g, _ in query})))
        named = candidates(index, rules)
        joined = base.join(named, same_key(base, named), "left").select("row", base["id"], base["th"], "text", "kinds")
    else:
        joined = base.withColumn("kinds", F.array().cast("array<string>"))
    spans = [F.when(F.array_contains("kinds", r.kind), rule_spans(full, r, i)).otherwise(none) if r.kind in indexed else rule_spans(full, r, i) for i, r in enumerate(rules)]
    spans = [F.coalesce(s, none) for s in spans]
    return joined.select("row", "id", "th", F.array_sort(F.concat(*spans)).alias("spans"))
