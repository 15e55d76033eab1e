"""Token corpora made from the tables: prose, chat, JSON, markup, and code.

The code corpus is rendered from orders and their items: a file per customer, a
function per order, nested blocks for returned items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import needed, text_lexer
from .operators.delimiters import LINKED, linked_lexemes
from .operators.files import BITS
from .operators.lexing import lex_files
from .rules.ast import Rule

#: Orders, some 30 tokens each, whose customers' files one task makes and lexes.
ORDERS_PER_TASK = 25_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    file = F.concat_ws("/", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(file.alias("file"), "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("file"), F.col("role").alias("function"), "turn", "text")


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    file = F.concat(F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".json"))
    return e.select(file.alias("file"), F.col("props").alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) of the code corpus."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    call = F.when(
        F.col("l_returnflag") == "R", F.concat(F.lit("{ release("), F.col("l_partkey").cast("string"), F.lit("); }"))
    ).otherwise(F.concat(F.lit("acquire("), F.col("l_suppkey").cast("string"), F.lit(");")))
    ordered = lambda key, text: F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("s")))), lambda x: x.s)
    calls = items.groupBy("l_orderkey").agg(F.array_join(ordered("l_linenumber", call), " ").alias("calls"))
    stop = F.when(F.col("o_orderstatus") == "F", F.lit("debugger; ")).otherwise(F.lit(""))
    line = F.concat(F.lit("function o"), F.col("o_orderkey").cast("string"), F.lit("() { "), stop, F.col("calls"), F.lit(" }"))
    joined = orders.join(calls, F.col("o_orderkey") == F.col("l_orderkey"))
    # Dealt once, by the number of orders: lexing follows, which costs more than its input's bytes tell.
    joined = joined.repartition(max(spark.sparkContext.defaultParallelism, orders.count() // ORDERS_PER_TASK), "o_custkey")
    files = joined.groupBy("o_custkey").agg(F.array_join(ordered("o_orderkey", line), "\n").alias("text"))
    return files.select(F.concat(F.lit("c/"), F.col("o_custkey").cast("string"), F.lit(".ts")).alias("file"), "text")


def built_in_tokens(files: DataFrame, function: Column | None = None, language: str = "javascript") -> DataFrame:
    """Tokens by built-in functions alone, with the columns that matches need.

    Spans hold the position in the stream; there are no depths and no links,
    which ``linked_tokens`` adds.
    """
    function = F.lit("") if function is None else function
    bits = [c for c in files.columns if c == BITS]
    t = text_lexer.light_tokens(files.select("file", function.alias("function"), "text", *bits))
    unlinked = {"jmp": F.lit(None).cast("int"), "block_path": F.array(F.lit(-1))} | {f"{d}_depth": F.lit(0) for d in ("curly", "round", "bracket")}
    return _named(t.select("*", *(c.alias(n) for n, c in unlinked.items())), language, bits)


def _named(t: DataFrame, language: str, bits: list[str]) -> DataFrame:
    """The columns of tokens, of lexemes with depths and links."""
    kind = F.when(F.col("class") == "ident", "identifier").when(F.col("class") == "num", "number").when(F.col("class") == "str", "string")
    place = F.col("pos").cast("long")
    return t.select(
        "file",
        F.lit(language).alias("language"),
        "pos",
        kind.when(F.col("class") == "comment", "comment").otherwise(F.col("text")).alias("node_kind"),
        "class",
        "text",
        "function",
        (F.col("class") != "symbol").alias("named"),
        place.alias("start_byte"),
        (place + F.col("text_len")).alias("end_byte"),
        F.lit(1).cast("long").alias("start_line"),
        (place + 1).alias("start_col"),
        F.lit(1).cast("long").alias("end_line"),
        (place + 2).alias("end_col"),
        "curly_depth",
        "round_depth",
        "bracket_depth",
        "jmp",
        "block_path",
        *bits,
    )


def linked_tokens(files: DataFrame, function: Column | None = None, language: str = "javascript") -> DataFrame:
    """``built_in_tokens`` with depths, links and blocks.

    A row is a whole file, so no token moves: texts without a bracket have none
    to link, the lexemes of others are linked where they are.
    """
    function = F.lit("") if function is None else function
    bits = [c for c in files.columns if c == BITS]
    brackets = F.col("text").rlike(r"[(){}\[\]]")
    without = built_in_tokens(files.filter(~brackets), function, language)
    arrays = files.filter(brackets).select("file", function.alias("function"), *bits, text_lexer.lexemes(F.col("text")).alias("_raw"))
    linked = text_lexer.described(linked_lexemes(arrays), "file", "function", *bits, *LINKED)
    return without.unionAll(_named(linked, language, bits))


def code_tokens(spark: SparkSession, sf_dir: str, rules: list[Rule] | None = None, shown: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of the code corpus; if ``rules`` are given, as far as they need them, and their findings those that are ``shown``."""
    if rules is None:
        return lex_files(code(spark, sf_dir))
    return lex_files(code(spark, sf_dir), columns=needed.columns(rules, shown), wanted=needed.wanted(rules))


def json_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex_files(props(spark, sf_dir), text_lexer.scan, "javascript")
