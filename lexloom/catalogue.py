"""Registered queries: one per operator, over corpora made from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpora
from .operators import text_lexer
from .operators.aggregate import summary
from .operators.lexing import language_column, register_table_function
from .operators.needed import rules_for
from .plans.engine import Context, check_tokens, lexed_for, primary_findings
from .rules.ast import Rule
from .rules.compile import load_dsl, load_yaml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# -- SQL that rebuilds the corpora ------------------------------------------

_PATTERN = text_lexer.PATTERN.replace("'", "''")
_CLASS = r"""CASE WHEN starts_with(raw, '<!--') AND length(raw) > 6 THEN 'comment' WHEN starts_with(raw, '"') AND length(raw) > 1 THEN 'str'
  WHEN regexp_matches(raw, '^[0-9]') THEN 'num' WHEN raw IN ('true', 'false') THEN 'bool' WHEN raw = 'null' THEN 'null'
  WHEN regexp_matches(raw, '^[\p{L}_]') THEN 'ident' ELSE 'symbol' END"""
_FILES = {
    "docs": "SELECT lang || '/' || source || '/' || doc_id || '.txt' AS file, '' AS function, 0 AS turn, text FROM documents",
    "conv": "SELECT CAST(conv_id AS VARCHAR) AS file, role AS function, turn, text FROM conversations",
    "props": "SELECT event_type || '/' || event_id || '.json' AS file, '' AS function, 0 AS turn, props AS text FROM events",
    "pages": "SELECT CAST(page_id AS VARCHAR) AS file, '' AS function, 0 AS turn, html AS text FROM pages",
}


def _tokens_sql(corpus: str, name: str = "t") -> str:
    """A CTE of (file, function, turn, pos, raw, text, class)."""
    return f"""WITH f AS ({_FILES[corpus]}),
u AS (SELECT file, function, turn, unnest(a) AS raw, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT file, function, turn, regexp_extract_all(text, '{_PATTERN}') AS a FROM f)),
{name} AS (SELECT file, function, turn, pos, raw, CASE WHEN length(raw) > 120 THEN substr(raw, 1, 120) || '…' ELSE raw END AS text, {_CLASS} AS class FROM u)
"""


_CODE_PIECES = r"""WITH calls AS (SELECT l_orderkey, string_agg(call, ' ' ORDER BY l_linenumber, call) AS calls
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN '{ release(' || l_partkey || '); }' ELSE 'acquire(' || l_suppkey || ');' END AS call FROM lineitem) GROUP BY 1),
f AS (SELECT 'c/' || o_custkey || '.ts' AS file, string_agg('function o' || o_orderkey || '() { ' || CASE WHEN o_orderstatus = 'F' THEN 'debugger; ' ELSE '' END || calls || ' }', chr(10) ORDER BY o_orderkey) AS text
  FROM orders JOIN calls ON l_orderkey = o_orderkey GROUP BY o_custkey),
u AS (SELECT file, unnest(a) AS text, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos FROM (SELECT file, regexp_extract_all(text, '[a-z][a-z0-9]*|[0-9]+|[^\s]') AS a FROM f))
"""
_CODE = (
    _CODE_PIECES
    + """, d AS (SELECT *, CAST(coalesce(sum(CASE text WHEN '{' THEN 1 ELSE 0 END) OVER before, 0) - sum(CASE text WHEN '}' THEN 1 ELSE 0 END) OVER through AS INTEGER) AS level
  FROM u WINDOW before AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), through AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT file, pos AS open, level + 1 AS level FROM d WHERE text = '{'),
t AS (SELECT d.file, d.pos, d.text, d.level, coalesce(o.open, -1) AS open, max(CASE WHEN regexp_matches(d.text, '^o[0-9]+$') THEN d.text END) OVER (PARTITION BY d.file ORDER BY d.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most
  FROM d ASOF LEFT JOIN o ON d.file = o.file AND d.level = o.level AND d.pos > o.open)
"""
)


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# -- tokens -----------------------------------------------------------------

_CORPORA = {"docs": corpora.docs, "conv": corpora.conversations, "props": corpora.props, "pages": corpora.pages}


def _light(corpus: str) -> Query:
    return lambda spark, d: text_lexer.light_tokens(_CORPORA[corpus](spark, d))


_register(
    "tok_stream",
    lambda s, d: _light("docs")(s, d).select("file", "pos", "class", "text", "text_len"),
    _tokens_sql("docs") + "SELECT file, pos, class, text, CAST(strlen(raw) AS BIGINT) AS text_len FROM t",
)
_register(
    "tok_classes",
    lambda s, d: _light("pages")(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
    _tokens_sql("pages") + "SELECT class, count(*) AS n FROM t GROUP BY 1",
)
for _name in _CORPORA:
    _register(
        f"tok_counts_{_name}",
        lambda s, d, c=_name: _light(c)(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("text_len").alias("bytes"), F.countDistinct("text").alias("texts")),
        _tokens_sql(_name) + "SELECT count(*) AS n, CAST(sum(strlen(raw)) AS BIGINT) AS bytes, count(DISTINCT text) AS texts FROM t",
    )
_register(
    "tok_cap",
    # Each text as one string literal, whose token is cut after 120 characters.
    lambda s, d: text_lexer.light_tokens(
        corpora.docs(s, d).select("file", F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit("_")), F.lit('"')).alias("text"))
    ).select("file", "pos", "class", "text", "text_len"),
    f"""SELECT file, CAST(0 AS INTEGER) AS pos, 'str' AS class, CASE WHEN length(q) > 120 THEN substr(q, 1, 120) || '…' ELSE q END AS text,
CAST(strlen(q) AS BIGINT) AS text_len FROM (SELECT file, '"' || replace(text, '"', '_') || '"' AS q FROM ({_FILES["docs"]}))""",
)
_SUFFIX = {"en": "ts", "fr": "test.jsx", "de": "py", "es": "d.rs"}


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files whose extension follows from their language, and the language that the extension tells."""
    d = corpora.docs(spark, sf_dir).select(F.regexp_replace("file", "txt$", "").alias("stem"), F.substring_index("file", "/", 1).alias("lang"))
    suffix = F.lit("txt")
    for lang, ext in _SUFFIX.items():
        suffix = F.when(F.col("lang") == lang, ext).otherwise(suffix)
    files = d.select(F.concat("stem", suffix).alias("file"))
    return files.select("file", language_column(F.col("file")).alias("language"))


_register(
    "tok_language",
    _languages,
    f"""WITH f AS ({_FILES["docs"]}), g AS (SELECT split_part(file, '/', 1) AS lang, regexp_replace(file, 'txt$', '') AS stem FROM f)
SELECT stem || CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SUFFIX.items())} ELSE 'txt' END AS file,
CASE lang WHEN 'en' THEN 'typescript' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'python' WHEN 'es' THEN 'rust' END AS language FROM g""",
)
_register(
    "tok_depths",
    lambda s, d: corpora.json_tokens(s, d).select("file", "pos", "text", "curly_depth"),
    _tokens_sql("props")
    + """SELECT file, pos, text, CAST(sum(CASE text WHEN '{' THEN 1 ELSE 0 END) OVER w - coalesce(sum(CASE text WHEN '}' THEN 1 ELSE 0 END) OVER b, 0) AS INTEGER) AS curly_depth
FROM t WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
_register(
    "tok_links",
    lambda s, d: corpora.code_tokens(s, d).filter("text in ('{', '}')").select("file", "pos", "text", "jmp", F.element_at("block_path", -1).alias("open")),
    # Braces of one outer level alternate; a brace lies behind the last opener of the level around it.
    _CODE_PIECES
    + """, b AS (SELECT file, pos, text, sum(CASE text WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY file ORDER BY pos) + CASE text WHEN '{' THEN -1 ELSE 0 END AS level FROM u WHERE text IN ('{', '}')),
p AS (SELECT *, CASE text WHEN '{' THEN lead(pos) OVER w ELSE lag(pos) OVER w END AS jmp FROM b WINDOW w AS (PARTITION BY file, level ORDER BY pos)),
k AS (SELECT file, level, pos, text, jmp, true AS asks, CAST(NULL AS INTEGER) AS place FROM p UNION ALL SELECT file, level + 1, pos, text, jmp, false, pos FROM p WHERE text = '{'),
l AS (SELECT *, last_value(place IGNORE NULLS) OVER (PARTITION BY file, level ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM k)
SELECT file, pos, text, CAST(jmp AS INTEGER) AS jmp, CAST(coalesce(open, -1) AS INTEGER) AS open FROM l WHERE asks""",
)
_register(
    "tok_spans",
    lambda s, d: corpora.code_tokens(s, d).select("file", "pos", "text", "class", "function", "start_line", "end_byte"),
    _CODE
    + r"""SELECT file, pos, text, CASE WHEN text IN ('function', 'debugger') THEN 'symbol' WHEN regexp_matches(text, '^[a-z]') THEN 'ident' WHEN regexp_matches(text, '^[0-9]') THEN 'num' ELSE 'symbol' END AS class,
CAST(last_value(CASE WHEN regexp_matches(lag_name, '^o[0-9]') THEN lag_name END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS function,
CAST(sum(CASE text WHEN 'function' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS start_line,
CAST(sum(strlen(text) + gap) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_byte
FROM (SELECT *, CASE WHEN text = 'function' THEN lead(text) OVER (PARTITION BY file ORDER BY pos) END AS lag_name,
  CASE WHEN pos = 0 OR text IN ('(', ')', ';') THEN 0 WHEN lag(text) OVER (PARTITION BY file ORDER BY pos) = '(' THEN 0 ELSE 1 END AS gap FROM t)""",
)



def _by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per file and nesting, counted in SQL over lexed files."""
    register_table_function(spark)
    corpora.code(spark, sf_dir).createOrReplaceTempView("lexloom_files")
    return spark.sql(
        """SELECT file, text, curly_depth, count(*) AS n, count(DISTINCT function) AS functions FROM lex(TABLE(lexloom_files))
        WHERE class = 'ident' AND text IN ('acquire', 'release') GROUP BY ALL"""
    )


_register(
    "tok_table_function",
    _by_table_function,
    _CODE_PIECES
    + """, d AS (SELECT *, CAST(sum(CASE text WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS INTEGER) AS curly_depth, sum(CASE text WHEN 'function' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS nth FROM u)
SELECT file, text, curly_depth, count(*) AS n, count(DISTINCT nth) AS functions FROM d WHERE text IN ('acquire', 'release') GROUP BY ALL""",
)

# Brackets one after another through one stack, for all files at once; then pairs, and the braces around each token.
_STACK = r"""
, b AS MATERIALIZED (SELECT file, pos, raw, row_number() OVER (PARTITION BY file ORDER BY pos) AS nth FROM t WHERE raw IN ('(', ')', '[', ']', '{', '}')),
st AS (SELECT file, 0::BIGINT AS nth, []::INTEGER[] AS stack, '' AS kinds, CAST(NULL AS INTEGER) AS opener, CAST(NULL AS INTEGER) AS closer FROM (SELECT DISTINCT file FROM b)
  UNION ALL SELECT b.file, b.nth, CASE WHEN b.raw IN ('(', '[', '{') THEN list_append(stack, b.pos) WHEN right(kinds, 1) = translate(b.raw, ')]}', '([{') THEN stack[1:len(stack) - 1] ELSE stack END,
  CASE WHEN b.raw IN ('(', '[', '{') THEN kinds || b.raw WHEN right(kinds, 1) = translate(b.raw, ')]}', '([{') THEN left(kinds, length(kinds) - 1) ELSE kinds END,
  CASE WHEN b.raw NOT IN ('(', '[', '{') AND right(kinds, 1) = translate(b.raw, ')]}', '([{') THEN stack[len(stack)] END, b.pos
  FROM st JOIN b ON b.file = st.file AND b.nth = st.nth + 1),
pairs AS MATERIALIZED (SELECT st.file, opener, closer, b.raw FROM st JOIN b ON b.file = st.file AND b.pos = st.closer WHERE opener IS NOT NULL)
"""


def _height(opener: str, closer: str, name: str) -> str:
    """SQL for a depth that a closer too many leaves at zero: behind a token, and before it where it closes."""
    return f"""(SELECT file, pos, CASE WHEN raw = '{closer}' THEN coalesce(lag(behind) OVER (PARTITION BY file ORDER BY pos), 0) ELSE behind END AS {name} FROM (
  SELECT *, height - least(0, min(height) OVER (PARTITION BY file ORDER BY pos)) AS behind FROM (
  SELECT file, pos, raw, sum(CASE raw WHEN '{opener}' THEN 1 WHEN '{closer}' THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS height FROM t)))"""


for _name in ("docs", "pages", "props"):
    _register(
        f"tok_blocks_{_name}",
        lambda s, d, c=_name: corpora.linked_tokens(_CORPORA[c](s, d)).select(
            "file", "pos", "text", "jmp", "curly_depth", "round_depth", "bracket_depth", F.array_join(F.transform("block_path", lambda b: b.cast("string")), ",").alias("blocks")
        ),
        _tokens_sql(_name).replace("WITH", "WITH RECURSIVE", 1)
        + _STACK
        + f""", e AS (SELECT t.file, t.pos, string_agg(CAST(p.opener AS VARCHAR), ',' ORDER BY p.opener) AS inside FROM t JOIN pairs p ON p.file = t.file AND p.raw = '}}' AND p.opener < t.pos AND t.pos < p.closer GROUP BY 1, 2)
SELECT t.file, t.pos, t.text, CAST(coalesce(o.closer, c.opener) AS INTEGER) AS jmp, CAST(curly AS INTEGER) AS curly_depth, CAST(round_ AS INTEGER) AS round_depth, CAST(bracket AS INTEGER) AS bracket_depth,
'-1' || coalesce(',' || e.inside, '') AS blocks FROM t LEFT JOIN pairs o ON o.file = t.file AND o.opener = t.pos LEFT JOIN pairs c ON c.file = t.file AND c.closer = t.pos LEFT JOIN e ON e.file = t.file AND e.pos = t.pos
JOIN {_height("{", "}", "curly")} h1 ON h1.file = t.file AND h1.pos = t.pos JOIN {_height("(", ")", "round_")} h2 ON h2.file = t.file AND h2.pos = t.pos JOIN {_height("[", "]", "bracket")} h3 ON h3.file = t.file AND h3.pos = t.pos""",
    )

# -- rules ------------------------------------------------------------------

_TOKENS: dict[str, Query] = {
    "docs": lambda s, d: corpora.built_in_tokens(corpora.docs(s, d)),
    "props": lambda s, d: corpora.built_in_tokens(corpora.props(s, d)),
    "pages": lambda s, d: corpora.built_in_tokens(corpora.pages(s, d)),
    "json": corpora.json_tokens,
    "code": corpora.code_tokens,
    "linked": lambda s, d: corpora.linked_tokens(corpora.pages(s, d)),
    "conv": lambda s, d: corpora.built_in_tokens(corpora.conversations(s, d), F.col("function")),
}
#: Every rule by itself: name -> (corpus, rule, SQL for its findings).
RULES: dict[str, tuple[str, str]] = {}


def _tokens_for(spark: SparkSession, sf_dir: str, corpus: str, rules: list[Rule], *shown: str) -> DataFrame:
    """Tokens of a corpus; of code, which is lexed for the rules, with what they need and what is shown of their findings."""
    return corpora.code_tokens(spark, sf_dir, rules, shown) if corpus == "code" else _TOKENS[corpus](spark, sf_dir)


def _findings(corpus: str, text: str, context: Context | None = None, load=load_dsl) -> Query:
    """Findings with their positions, of one rule or more."""
    rules, _ = load(text)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = primary_findings(_tokens_for(spark, sf_dir, corpus, rules, "text"), rules, context or Context())
        return found.select("rule_id", "file", F.col("emitted.pos").alias("pos"), F.col("matched.text").alias("text"))

    return query


def _rule(name: str, corpus: str, body: str, where: str, sql: str | None = None, context: Context | None = None) -> None:
    text = f"rule R {{ {body} }}"
    RULES[name] = (corpus, text)
    base = _CODE if corpus == "code" else _tokens_sql("props" if corpus == "json" else corpus)
    sql = sql or f"SELECT 'R' AS rule_id, file, pos, text FROM t WHERE {where}"
    _register(name, _findings(corpus, text, context), base + sql)


def _beside(name: str, corpus: str, text: str, where: str) -> None:
    """Rules R and S, of which S alone finds something."""
    RULES[name] = (corpus, text)
    base = _CODE if corpus == "code" else _tokens_sql(corpus)
    _register(name, _findings(corpus, text), base + f"SELECT 'S' AS rule_id, file, pos, text FROM t WHERE {where}")


_rule("m_literal", "docs", "match the", "text = 'the'")
_rule("m_class", "docs", "match @num", "class = 'num'")
_rule("m_regex", "docs", "match @ident & /^th/", "class = 'ident' AND starts_with(text, 'th')")
_rule("m_not_regex", "pages", "match @ident & ^/[a-z]/", "class = 'ident' AND NOT regexp_matches(text, '[a-z]')")
_rule(
    "m_class_algebra",
    "docs",
    r"match @ident & /^(?U)[a-z--[aeiou]][\p{L}&&[^b-y]~~z]/",
    r"""class = 'ident' AND regexp_matches(text, '^[b-df-hj-np-tv-z]') AND regexp_matches(substr(text, 2, 1), '^\p{L}$') AND NOT regexp_matches(substr(text, 2, 1), '^[b-z]$')""",
)
_rule("m_conj", "pages", 'match Token[class = "ident", text ~ /^[a-m]/, text !~ /e/, text_len >= 4]', "class = 'ident' AND regexp_matches(text, '^[a-m]') AND NOT contains(text, 'e') AND strlen(raw) >= 4")
_rule("m_overwrite", "docs", "match /^a/ & /z$/", "regexp_matches(text, 'z$')")
_rule("m_in", "pages", 'match Token[text in ["div", "span", "<"]]', "text IN ('div', 'span', '<')")
_rule("m_gt", "pages", "match Token[text_len > 12]", "strlen(raw) > 12")
_rule("m_lt", "props", "match Token[text_len < 2]", "strlen(raw) < 2")
_rule("m_ge", "props", 'match Token[class = "num", text >= 50]', "class = 'num' AND try_cast(text AS DOUBLE) >= 50")
_rule("m_le", "props", 'match Token[class = "num", text <= 50]', "class = 'num' AND try_cast(text AS DOUBLE) <= 50")
_rule("m_unknown_field", "props", "match Token[colour !~ /x/, named = \"true\"]", "class <> 'symbol'")
# Rules that never match stand beside one that does, over the same tokens.
_beside("m_ref_is_false", "props", "rule R { match :x } rule S { match @num }", "class = 'num'")
_rule("f_lang", "docs", "lang javascript match @num", "class = 'num'")
_beside("f_lang_none", "docs", "rule R { lang rust, python match @num } rule S { lang typescript, javascript match @num }", "class = 'num'")
_rule("f_in", "docs", 'in "en/**" in "de/*" match @num', "class = 'num' AND (starts_with(file, 'en/') OR starts_with(file, 'de/'))")
_rule("f_not_in", "docs", 'not in "en/**", "**/src1/*.txt" match @num', "class = 'num' AND NOT starts_with(file, 'en/') AND NOT contains(file, '/src1/')")
_rule("f_alternates", "docs", 'in "{en,fr}/src[1-3]/?*.txt" match @num', "class = 'num' AND regexp_matches(file, '^(en|fr)/src[1-3]/.+[.]txt$')")

# Globs, languages and waivers decided per file: documents that no rule applies to are not split into tokens.
_DECIDED = '''rule A { in "en/**" not in "**/src1/*.txt" match @num } rule B { in "de/**", "fr/src2/*" unless path "**/src7/*" match @num }
rule C { lang rust match the } rule D { in "es/**" sequence { @num any * } }'''
RULES["f_decided"] = ("docs", _DECIDED)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, _ = load_dsl(_DECIDED)
    texts = corpora.docs(spark, sf_dir).withColumn("language", F.lit("javascript"))
    found = primary_findings(lexed_for(texts, rules, _SOME_WAIVED, corpora.built_in_tokens), rules, _SOME_WAIVED)
    return found.select("rule_id", "file", F.col("emitted.pos").alias("pos"), F.col("matched.text").alias("text"))


_SOME_WAIVED = Context(waivers=[*(("A", f"en/src{i % 20}/{i}.txt") for i in range(0, 1000, 9)), ("D", "es/src0/0.txt")])
_register(
    "f_decided",
    _decided,
    _tokens_sql("docs")
    + f"""SELECT 'A' AS rule_id, file, pos, text FROM t WHERE class = 'num' AND starts_with(file, 'en/') AND NOT contains(file, '/src1/') AND file NOT IN ({", ".join(f"'{f}'" for r, f in _SOME_WAIVED.waivers if r == "A")})
UNION ALL SELECT 'B', file, pos, text FROM t WHERE class = 'num' AND (starts_with(file, 'de/') OR starts_with(file, 'fr/src2/')) AND NOT contains(file, '/src7/')
UNION ALL SELECT 'D', file, pos, text FROM t WHERE class = 'num' AND starts_with(file, 'es/') AND file <> 'es/src0/0.txt'""",
)

#: A rule for every number below this, which tokens look up in a dictionary.
_NUMBERED = 2_000


def _numbered(n: int) -> str:
    body = f'Token[class = "num", text = "{n}"]' if n % 2 else f'"{n}"'
    return f"rule N{n} {{ match {body} }}"


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, _ = load_dsl("\n".join(map(_numbered, range(_NUMBERED))))
    found = primary_findings(_TOKENS["docs"](spark, sf_dir), rules, Context())
    return found.select("rule_id", "file", F.col("emitted.pos").alias("pos"), F.col("matched.text").alias("text"))


_register(
    "m_dictionary",
    _dictionary,
    _tokens_sql("docs") + f"SELECT 'N' || text AS rule_id, file, pos, text FROM t WHERE class = 'num' AND try_cast(text AS INTEGER) < {_NUMBERED} AND CAST(try_cast(text AS INTEGER) AS VARCHAR) = text",
)

# A block's tokens, by its opener: those up to the closing brace on its level.
_BLOCKS = """, c AS (SELECT o.file, o.open, min(t.pos) AS close FROM o JOIN t ON t.file = o.file AND t.text = '}' AND t.pos > o.open AND t.level = o.level - 1 GROUP BY 1, 2),
b AS (SELECT file, open, close FROM c UNION ALL SELECT DISTINCT file, -1, 1000000000 FROM t)
"""
_TARGETS = "SELECT 'R' AS rule_id, t.file, t.pos, t.text FROM t JOIN b ON b.file = t.file AND b.open = t.open WHERE "
_OTHER = "EXISTS (SELECT 1 FROM t x WHERE x.file = t.file AND x.pos > b.open AND x.pos < b.close AND x.text = '{}'{})"
_rule("s_contains", "code", "match debugger where scope contains release", "", _BLOCKS + _TARGETS + "t.text = 'debugger' AND " + _OTHER.format("release", ""))
_rule("s_not_contains", "code", "match debugger where scope not contains release", "", _BLOCKS + _TARGETS + "t.text = 'debugger' AND NOT " + _OTHER.format("release", ""))
_rule("s_followed_by", "code", "match acquire where scope followed by release", "", _BLOCKS + _TARGETS + "t.text = 'acquire' AND " + _OTHER.format("release", " AND x.pos > t.pos"))
_rule("s_self", "code", "match acquire where scope not contains acquire", "", _BLOCKS + _TARGETS + "t.text = 'acquire' AND NOT " + _OTHER.format("acquire", " AND x.pos <> t.pos"))
_rule("s_root", "code", "match function where scope contains debugger where scope not contains release", "", _BLOCKS + _TARGETS + "t.text = 'function' AND " + _OTHER.format("debugger", "") + " AND NOT " + _OTHER.format("release", ""))

_INSIDE = """, i AS (SELECT t.file, t.pos, t.text, t.class, coalesce(max(p.opener), -1) AS open FROM t LEFT JOIN pairs p ON p.file = t.file AND p.raw = '}' AND p.opener < t.pos AND t.pos < p.closer GROUP BY ALL),
w AS (SELECT file, opener AS open, closer AS close FROM pairs WHERE raw = '}' UNION ALL SELECT DISTINCT file, -1, 1000000000 FROM t)
SELECT 'R' AS rule_id, i.file, i.pos, i.text FROM i JOIN w ON w.file = i.file AND w.open = i.open WHERE """
_LINKED = _tokens_sql("pages").replace("WITH", "WITH RECURSIVE", 1) + _STACK + _INSIDE
_register(
    "s_linked",
    _findings("linked", "rule R { match @ident & /^[a-m]/ where scope contains @num where scope not contains script }"),
    _LINKED
    + """i.class = 'ident' AND regexp_matches(i.text, '^[a-m]') AND EXISTS (SELECT 1 FROM t x WHERE x.file = i.file AND x.pos > w.open AND x.pos < w.close AND x.class = 'num' AND x.pos <> i.pos)
AND NOT EXISTS (SELECT 1 FROM t x WHERE x.file = i.file AND x.pos > w.open AND x.pos < w.close AND x.text = 'script' AND x.pos <> i.pos)""",
)

_NEXT = """, n AS (SELECT *, lead(text) OVER w AS n1, lead(text, 2) OVER w AS n2, lead(text, 3) OVER w AS n3, max(pos) OVER (PARTITION BY file) AS final FROM t WINDOW w AS (PARTITION BY file ORDER BY pos))
SELECT 'R' AS rule_id, file, pos, text FROM n WHERE """
_LAST = """, m AS (SELECT file, max(pos) AS final, max(CASE WHEN text = 'debugger' THEN pos END) AS last_debugger, max(CASE WHEN text = 'release' THEN pos END) AS last_release FROM t GROUP BY 1)
SELECT 'R' AS rule_id, t.file, t.pos, t.text FROM t JOIN m USING (file) WHERE """
# Sequences in a scope: what follows a token, up to the end of each block around it.
_AROUND = """, i AS (SELECT t.file, t.pos, t.text, b.open, b.close FROM t JOIN c b ON b.file = t.file AND t.pos > b.open AND t.pos < b.close)
"""
_rule("q_adjacent", "code", 'sequence { debugger ";" acquire any * }', "", _NEXT + "text = 'debugger' AND n1 = ';' AND n2 = 'acquire'")
_rule("q_gap", "code", "sequence { debugger any * release any * }", "", _LAST + "text = 'debugger' AND last_release > pos")
_rule("q_optional", "code", 'sequence { debugger ";" "{" ? release any * }', "", _NEXT + "text = 'debugger' AND n1 = ';' AND (n2 = 'release' OR n2 = '{' AND n3 = 'release')")
_rule("q_plus", "code", 'sequence { ";" "}" + }', "", _LAST.replace("SELECT 'R'", ", x AS (SELECT file, max(CASE WHEN text <> '}' THEN pos END) AS stop FROM t GROUP BY 1) SELECT 'R'").replace("JOIN m USING (file)", "JOIN m USING (file) JOIN x USING (file)").replace("final FROM", "final FROM") + "text = ';' AND pos = stop AND final > pos")
_rule("q_negate", "code", 'sequence { debugger ";" not acquire any * }', "", _NEXT + "text = 'debugger' AND n1 = ';' AND n2 <> 'acquire'")
_rule("q_alt", "code", "sequence { function any any any any (debugger | acquire) any * }", "", _NEXT.replace("lead(text, 3) OVER w AS n3", "lead(text, 5) OVER w AS n5") + "text = 'function' AND n5 IN ('debugger', 'acquire')")
_rule("q_set", "code", 'sequence { debugger ";" [acquire release] any * }', "", _NEXT + "text = 'debugger' AND n1 = ';' AND n2 IN ('acquire', 'release')")
_beside("q_empty_set", "code", "rule R { sequence { debugger [] any * } } rule S { sequence { debugger any any * } }", "text = 'debugger'")
_rule("q_tail_absent", "code", "sequence { debugger not release * }", "", _LAST + "text = 'debugger' AND coalesce(last_release, -1) < pos")
_rule("q_file", "code", "sequence { function not debugger * }", "", _LAST + "text = 'function' AND coalesce(last_debugger, -1) < pos")
_rule("q_in_scope", "code", "sequence in scope { acquire not release * }", "", _BLOCKS + _AROUND + "SELECT DISTINCT 'R' AS rule_id, file, pos, text FROM i WHERE text = 'acquire' AND NOT EXISTS (SELECT 1 FROM i x WHERE x.file = i.file AND x.open = i.open AND x.pos > i.pos AND x.text = 'release')")
_rule("q_nested_dedupe", "code", "sequence in scope { release any * }", "", _BLOCKS + _AROUND + "SELECT DISTINCT 'R' AS rule_id, file, pos, text FROM i WHERE text = 'release'")
_rule("q_backref", "code", "sequence in scope { x:@num any * :x any * }", "", _BLOCKS + _AROUND + "SELECT DISTINCT 'R' AS rule_id, file, pos, text FROM i WHERE regexp_matches(text, '^[0-9]+$') AND EXISTS (SELECT 1 FROM i x WHERE x.file = i.file AND x.open = i.open AND x.pos > i.pos AND x.text = i.text)")
_rule("q_self_call", "code", 'sequence in scope { f:@ident "(" any ")" ";" :f any * }', "", _BLOCKS + _AROUND + ", n AS (SELECT *, lead(text) OVER w AS n1, lead(text, 3) OVER w AS n3, lead(text, 4) OVER w AS n4, lead(text, 5) OVER w AS n5 FROM i WINDOW w AS (PARTITION BY file, open ORDER BY pos)) SELECT DISTINCT 'R' AS rule_id, file, pos, text FROM n WHERE text IN ('acquire', 'release') AND n1 = '(' AND n3 = ')' AND n4 = ';' AND n5 = text")
_rule("q_balanced", "code", 'sequence in scope { debugger ";" "{" any * "}" any * }', "", _BLOCKS + _AROUND + ", n AS (SELECT *, lead(text) OVER w AS n1, lead(text, 2) OVER w AS n2 FROM i WINDOW w AS (PARTITION BY file, open ORDER BY pos)) SELECT DISTINCT 'R' AS rule_id, file, pos, text FROM n WHERE text = 'debugger' AND n1 = ';' AND n2 = '{'")

_DIFFERS = """
rules:
  - id: R
    severity: error
    match_sequence:
      anchor: {within: ScopeStart..ScopeEnd}
      steps:
        - {attrs: {class: ident}, bind: {f: text, k: node_kind}}
        - {alt: [[{attrs: {text: "("}}]]}
        - {attrs: {class: num}}
        - {attrs: {class: symbol}, quant: one_or_more}
        - {attrs: {text.ne_ref: f, node_kind.eq_ref: k}}
        - {attrs: {}, quant: zero_or_more}
"""
_register(
    "q_differs",
    _findings("code", _DIFFERS, load=load_yaml),
    _CODE
    + _BLOCKS
    + _AROUND
    + ", n AS (SELECT *, lead(text) OVER w AS n1, lead(text, 3) OVER w AS n3, lead(text, 4) OVER w AS n4, lead(text, 5) OVER w AS n5, lead(text, 6) OVER w AS n6, lead(text, 7) OVER w AS n7 FROM i WINDOW w AS (PARTITION BY file, open ORDER BY pos)) "
    "SELECT DISTINCT 'R' AS rule_id, file, pos, text FROM n WHERE text IN ('acquire', 'release') AND n1 = '(' "
    "AND CASE WHEN n5 IN ('acquire', 'release') THEN n5 WHEN n5 IN ('{', '}') AND n6 IN ('acquire', 'release') THEN n6 WHEN n5 = '}' AND n6 = '{' AND n7 IN ('acquire', 'release') THEN n7 END <> text",
)

# -- rules over findings ----------------------------------------------------


def _violations(corpus: str, text: str, only: str, context: Context | None = None) -> Query:
    """Violations of one rule of a set, with what groups and represents them."""
    rules = rules_for(load_dsl(text)[0], [only])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = check_tokens(_tokens_for(spark, sf_dir, corpus, rules, "text", "function"), rules, context, ordered=False)
        return out.filter(F.col("rule_id") == only).select("rule_id", "severity", "file", F.col("matched.text").alias("text"), F.col("matched.function").alias("function"))

    return query


def _aggregate(name: str, body: str, key: str, select: str, corpus: str = "code") -> None:
    text = f"rule STOP {{ match debugger }} rule FREE {{ match release }} rule TAKE {{ match acquire }} rule A (warning) {{ {body} }}"
    RULES[name] = (corpus, text)
    base = (
        _CODE
        + r""", g AS (SELECT file, pos, text, last_value(name IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS function,
  CASE text WHEN 'debugger' THEN 'STOP' WHEN 'release' THEN 'FREE' WHEN 'acquire' THEN 'TAKE' END AS rule, """
        + "string_split(file, '/') AS parts FROM (SELECT *, CASE WHEN text = 'function' THEN lead(text) OVER (PARTITION BY file ORDER BY pos) END AS name FROM t)), "
        + f"h AS (SELECT *, row_number() OVER (PARTITION BY rule, {key} ORDER BY parts, pos) AS nth, count(*) OVER (PARTITION BY rule, {key}) AS n FROM g WHERE rule IS NOT NULL) "
    )
    _register(name, _violations(corpus, text, "A"), base + f"SELECT 'A' AS rule_id, 'warning' AS severity, file, text, function FROM h WHERE nth = 1 AND {select}")


_HAS = "EXISTS (SELECT 1 FROM h x WHERE x.rule = '{0}' AND x.file = h.file)"
_HAS_F = "EXISTS (SELECT 1 FROM h x WHERE x.rule = '{0}' AND x.file = h.file AND x.function = h.function)"
_aggregate("a_inter", "compose intersection of STOP, FREE, TAKE", "file", "rule = 'STOP' AND " + _HAS.format("FREE") + " AND " + _HAS.format("TAKE"))
# One aggregation per file says the same.
ORACLES["a_inter"] = (
    _CODE_PIECES
    + """, n AS (SELECT *, CASE WHEN text = 'function' THEN lead(text) OVER (PARTITION BY file ORDER BY pos) END AS name FROM u),
g AS (SELECT file, pos, text, last_value(name IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS function FROM n)
SELECT 'A' AS rule_id, 'warning' AS severity, file, 'debugger' AS text, arg_min(function, pos) FILTER (text = 'debugger') AS function FROM g WHERE text IN ('debugger', 'release', 'acquire')
GROUP BY file HAVING count(DISTINCT text) = 3"""
)
_aggregate("a_union", "compose union of FREE, STOP by file", "file", "(rule = 'FREE' OR rule = 'STOP' AND NOT " + _HAS.format("FREE") + ")")
_aggregate("a_diff", "compose difference of TAKE, FREE by file, function", "file, function", "rule = 'TAKE' AND NOT " + _HAS_F.format("FREE"))
_aggregate("a_by_function", "compose intersection of STOP, FREE by function", "function", "rule = 'STOP' AND EXISTS (SELECT 1 FROM h x WHERE x.rule = 'FREE' AND x.function = h.function)")
_aggregate("a_missing_rule", "compose union of NOWHERE, STOP", "file", "rule = 'STOP'")
_aggregate("a_count_file", "count FREE per file > 20", "file", "rule = 'FREE' AND n > 20")
_aggregate("a_count_function", "count TAKE per function >= 5", "file, function", "rule = 'TAKE' AND n >= 5")
_aggregate("a_count_eq", "count FREE per function == 2", "file, function", "rule = 'FREE' AND n = 2")
_aggregate("a_count_less", "count STOP per file < 3", "file", "rule = 'STOP' AND n < 3")

_CHAT = "rule ASK { match /^[A-Z]/ } rule NUM { match @num } rule A { count ASK per function > 3 }"
RULES["a_conversations"] = ("conv", _CHAT)
_register(
    "a_conversations",
    lambda s, d: check_tokens(_TOKENS["conv"](s, d), load_dsl(_CHAT)[0], None, ordered=False)
    .filter("rule_id = 'A'")
    .select("rule_id", "file", F.col("matched.function").alias("function")),
    _tokens_sql("conv") + "SELECT 'A' AS rule_id, file, function FROM t WHERE regexp_matches(text, '^[A-Z]') GROUP BY file, function HAVING count(*) > 3",
)

# -- suppression ------------------------------------------------------------

_WAIVED = Context(waivers=[("R", "en/src1/1.txt"), ("R", "en/src2/2.txt"), ("OTHER", "en/src3/3.txt"), *(("R", f"en/src{i % 20}/{i}.txt") for i in range(0, 1000, 7))], adrs=[("numbers", True), ("words", False)])
_LIST = ", ".join(f"'{f}'" for r, f in _WAIVED.waivers if r == "R")
_OTHERS = ", ".join(f"'{f}'" for r, f in _WAIVED.waivers if r == "OTHER")
_rule("w_waiver", "docs", "match @num", f"class = 'num' AND file NOT IN ({_LIST})", context=_WAIVED)
_rule("w_guard", "docs", "match @num unless waiver OTHER", f"class = 'num' AND file NOT IN ({_LIST}, {_OTHERS})", context=_WAIVED)
_rule("w_unless_path", "docs", 'unless path "en/*", "**/src5/*" match @num', "class = 'num' AND NOT starts_with(file, 'en/') AND NOT contains(file, '/src5/')")
_rule("w_unless_adr_open", "docs", 'unless adr "words" match @num', f"class = 'num' AND file NOT IN ({_LIST})", context=_WAIVED)
_register(
    "w_unless_adr",
    lambda s, d: check_tokens(_TOKENS["docs"](s, d), load_dsl('rule R { unless adr "numbers" match @num } rule S { match the }')[0], _WAIVED, ordered=False).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")),
    _tokens_sql("docs") + "SELECT 'S' AS rule_id, count(*) AS n FROM t WHERE text = 'the' GROUP BY 1",
)

# -- reports ----------------------------------------------------------------

_PACK = "rule W (warning) { match @num } rule E { match the } rule X { match @ident & /^[A-Z]+$/ }"
_HITS = "SELECT 'W' AS rule_id, 'warning' AS severity, file, pos, text FROM t WHERE class = 'num' UNION ALL SELECT 'E', 'error', file, pos, text FROM t WHERE text = 'the' UNION ALL SELECT 'X', 'error', file, pos, text FROM t WHERE class = 'ident' AND regexp_matches(text, '^[A-Z]+$')"
_register(
    "r_summary",
    lambda s, d: summary(check_tokens(_TOKENS["docs"](s, d), load_dsl(_PACK)[0], None, ordered=False)),
    _tokens_sql("docs") + f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity <> 'error') AS warnings, count(*) AS total FROM ({_HITS})",
)
_register(
    "r_sorted",
    lambda s, d: check_tokens(_TOKENS["docs"](s, d), load_dsl(_PACK)[0]).select("rule_id", "severity", "file", F.col("span.start_byte").alias("place"), F.col("matched.text").alias("text")),
    _tokens_sql("docs") + f"SELECT rule_id, severity, file, CAST(pos AS BIGINT) AS place, text FROM ({_HITS})",
)
