"""Rules over tokens, planned as one DataFrame of violations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import applies
from ..operators import aggregate, files, primary, search
from ..operators.lexing import language_column, lex_files
from ..rules.ast import Rule
from ..schema import MATCHED_FIELDS, SPAN_FIELDS, VIOLATIONS

#: Waivers that are sent to every executor; more are joined by a shuffle.
SENT_WAIVERS = 100_000


@dataclass
class Context:
    """What suppresses findings: (rule, file) waivers and accepted decision records."""

    waivers: list[tuple[str, str]] = field(default_factory=list)
    adrs: list[tuple[str, bool]] = field(default_factory=list)

    def accepts(self, topic: str) -> bool:
        return any(t == topic and ok for t, ok in self.adrs)


def path_order(column: str = "file") -> Column:
    """Paths order by their components, as strings do in which nothing comes before a slash."""
    return F.replace(F.col(column), F.lit("/"), F.lit("\0"))


def _lookup(index: Column, values: list) -> Column:
    """The rule's entry of ``values``, folded into one literal array."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), index + 1)


def _unwaived(df: DataFrame, rules: list[Rule], context: Context) -> DataFrame:
    """Drop findings waived for their rule, or for the rule their guard names."""
    if not context.waivers:
        return df
    spark = df.sparkSession
    waivers = spark.createDataFrame(sorted(set(context.waivers)), "waived string, waived_file string")
    if len(context.waivers) <= SENT_WAIVERS:
        waivers = F.broadcast(waivers)
    own = [_lookup(F.col("rule"), [r.id for r in rules])]
    if any(r.unless_waiver not in (None, r.id) for r in rules):
        own.append(_lookup(F.col("rule"), [r.unless_waiver or r.id for r in rules]))
    for name in own:
        df = df.join(waivers, (name == F.col("waived")) & (F.col("file") == F.col("waived_file")), "left_anti")
    return df


def _alive(rule: Rule, context: Context) -> bool:
    return rule.unless_adr is None or not context.accepts(rule.unless_adr)


def primary_findings(tokens: DataFrame, rules: list[Rule], context: Context) -> DataFrame | None:
    """Findings of match and sequence rules that survive suppression; None without such rules."""
    numbered = [(i, r) for i, r in enumerate(rules) if not r.aggregate and _alive(r, context)]
    plain = [(i, r) for i, r in numbered if r.match is not None and not r.where]
    parts = [primary.plain_matches(tokens, plain)] if plain else []
    for plan, own in ((primary.scoped_matches, [n for n in numbered if n[1].where]), (search.sequences, [n for n in numbered if n[1].steps is not None])):
        for i, r in own:
            of_rule, asked = files.of_rule(tokens, i, r)
            parts.append(plan(of_rule, i, asked))
    if not parts:
        return None
    found = reduce(DataFrame.unionAll, parts)
    if files.decided(tokens) is None:
        found = _unwaived(found, rules, context)
    return found.select(
        "rule",
        _lookup(F.col("rule"), [r.id for r in rules]).alias("rule_id"),
        "file",
        F.struct(*SPAN_FIELDS).alias("span"),
        F.struct(*MATCHED_FIELDS).alias("matched"),
        F.struct("rule", path_order().alias("path"), "open", "pos").alias("emitted"),
    )


def _guarded(derived: DataFrame, rules: list[Rule], aggregates: list[tuple[int, Rule]], context: Context) -> DataFrame:
    """Without what the guards and waivers of ``aggregates`` suppress; primary findings have passed theirs."""
    for i, rule in aggregates:
        guard = Rule(rule.id, rule.severity, None, None, None, (), (), unless_path=rule.unless_path)
        if rule.unless_path is not None:
            derived = derived.filter((F.col("rule") != i) | applies(guard))
    return _unwaived(derived, rules, context) if aggregates else derived


def lexed_for(texts: DataFrame, rules: list[Rule], context: Context | None = None, lex: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tokens of the files of ``texts`` (file, text) to which some rule applies, with their rules as bits.

    A file's language is that of its extension, unless ``texts`` has a column for
    it.  ``lex`` makes tokens of (file, language, text, bits) and keeps the bits;
    without it the extension chooses a lexer.
    """
    context = context or Context()
    if "language" not in texts.columns:
        texts = texts.withColumn("language", language_column(F.col("file")))
    wanted = files.with_rule_bits(texts.select("file", "language", "text"), rules, context.waivers, lambda r: _alive(r, context))
    return (lex or (lambda t: lex_files(t, carried=(files.BITS,))))(wanted)


def check_files(texts: DataFrame, rules: list[Rule], context: Context | None = None, lex: Callable[[DataFrame], DataFrame] | None = None, ordered: bool = True) -> DataFrame:
    """The violations of ``rules`` in files (file, text); those that no rule applies to are never lexed."""
    return check_tokens(lexed_for(texts, rules, context, lex), rules, context, ordered)


def check_tokens(tokens: DataFrame, rules: list[Rule], context: Context | None = None, ordered: bool = True) -> DataFrame:
    """The violations of ``rules`` in ``tokens``, in report order unless told otherwise.

    Tokens that several rules or aggregates read should be persisted or written
    by the caller; a plan of plain matches alone reads them once.
    """
    context = context or Context()
    spark = tokens.sparkSession
    found = primary_findings(tokens, rules, context)
    aggregates = [(i, r) for i, r in enumerate(rules) if r.aggregate and _alive(r, context)]
    parts = []
    if found is not None:
        inside = [(i, r) for i, r in aggregates if aggregate.within_files(r)]
        across = [(i, r) for i, r in aggregates if not aggregate.within_files(r)]
        whole = aggregate.with_derived(found, inside) if inside else found.select("rule", "file", "span", "matched")
        parts = [_guarded(whole, rules, inside, context)]
        for i, rule in across:
            derived = aggregate.composed(found, rule).select(F.lit(i).alias("rule"), "file", "span", "matched")
            parts.append(_guarded(derived, rules, [(i, rule)], context))
    if not parts:
        schema = "rule_id string, severity string, description string, message string, file string"
        empty = spark.createDataFrame([], schema + ", span struct<" + ", ".join(f"{f}: bigint" for f in SPAN_FIELDS) + ">")
        matched = ", ".join(f"{f}: {'boolean' if f == 'named' else 'string'}" for f in MATCHED_FIELDS)
        return empty.withColumn("matched", F.lit(None).cast(f"struct<{matched}>"))
    out = reduce(DataFrame.unionAll, parts)
    columns = {"rule_id": "id", "severity": "severity", "description": "description", "message": "message"}
    out = out.select(*(_lookup(F.col("rule"), [getattr(r, a) for r in rules]).alias(c) for c, a in columns.items()), "file", "span", "matched")
    if ordered:
        if not aggregates:  # sorting samples its input: what was dealt by file is not computed twice
            out = out.repartition("file")
        out = out.orderBy(path_order(), "span.start_line", "span.start_col", "rule_id")
    return out.select(*VIOLATIONS)
