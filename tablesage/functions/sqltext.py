"""Expressions that read features off SQL text by pattern, without parsing it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.functions.binding import let
from tablesage.functions.text import clean_sql

# Words that are never column names.
KEYWORDS = [
    "all", "and", "as", "asc", "between", "by", "case", "cast", "cross", "date", "desc", "distinct", "else", "end",
    "except", "exists", "false", "float", "from", "full", "group", "having", "in", "inner", "int", "integer",
    "intersect", "is", "join", "left", "like", "limit", "natural", "not", "null", "numeric", "offset", "on", "or",
    "order", "outer", "over", "partition", "real", "right", "select", "text", "then", "true", "union", "using",
    "values", "varchar", "when", "where", "with",
]
AGGREGATES = ["SUM", "COUNT", "AVG", "MIN", "MAX"]

NAME = r"[A-Za-z_]\w*"
# Only keywords are read regardless of case, and first letters are looked at first: that is cheaper than a whole pattern of any case.
OPENING = r"\b(?=[FfJj])(?i:from|join)"
TABLE_REF = rf"{OPENING}\s+({NAME})"
# The keywords by first letter, so that a name is compared with few of them.
BY_LETTER = "|".join(
    f"{letter}(?:{'|'.join(k[1:] for k in KEYWORDS if k[0] == letter)})" for letter in sorted({k[0] for k in KEYWORDS})
)
NO_KEYWORD = rf"(?!(?i:{BY_LETTER})\b)"
TABLE_ALIAS = rf"{OPENING}\s+({NAME})\s+(?:[Aa][Ss]\s+)?{NO_KEYWORD}({NAME})"
GIVEN_NAME = rf"(?:\b[Aa][Ss]|{OPENING}(?:\s+{NAME})?)\s+{NO_KEYWORD}({NAME})"
# A name or a qualified name that is no keyword and is not called as a function.
COLUMN_REF = rf"(?=[A-Za-z_])(?<![\w.]){NO_KEYWORD}{NAME}(?:\.{NAME})?\b(?!\s*\()(?!\.)"
STRING_LITERAL = r"'(?:[^']|'')*'"
ANY_LITERAL = r"'((?:[^']|'')*)'|(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"
CLAUSE_END = r"(?=\s+(?:where|group\s+by|having|order\s+by|limit|union|intersect|except)\b|\s*\)|\s*;|\s*$)"
JOIN_ON = (
    r"(?is)\bon\s+(.+?)(?=\s+(?:(?:inner|left|right|full|cross|natural)\s+(?:outer\s+)?)?join\b"
    r"|\s+(?:where|group\s+by|having|order\s+by|limit|union|intersect|except)\b|\s*\)\s*(?:where|group|order|limit|as)\b|\s*;|\s*$)"
)
SELECT_LIST = r"(?is)\bselect\s+(.+?)\s+from\b"
AGGREGATE_CALL = rf"(?i)\b({'|'.join(AGGREGATES)})\s*\("


# Words that stand for a quoted name or a bracketed part while patterns are at work; the number says which one.
NAME_MARK, PART_MARK = "qzn", "qzp"
QUOTED_NAME = r'\[[^\]\[]+\]|`[^`]+`|"[^"]+"'
FROM_LIST = rf"(?i)(\bfrom\s+{NAME}(?:\s+(?:as\s+)?{NO_KEYWORD}{NAME})?(?:\s+join\s+{NAME}(?:\s+(?:as\s+)?{NO_KEYWORD}{NAME})?)*)\s*,\s*(?={NAME})"


def _mark(kind: str, number: Column) -> Column:
    return F.concat(F.lit(kind), number.cast("string"), F.lit(f"{kind[::-1]}"))


def quoted_names(sql: Column) -> Column:
    """Different names in quotes or brackets that are no plain words, as written."""
    def names(text: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_replace(text, STRING_LITERAL, "''"), F.lit(QUOTED_NAME), F.lit(0))
        return F.when(_quoting(text), F.array_distinct(F.filter(found, lambda n: ~n.rlike(rf"^.{NAME}.$")))).otherwise(F.array().cast("array<string>"))

    return let(sql, names)


def _quoting(text: Column) -> Column:
    """Whether the text has a mark that quoted names begin with; most have none and need no pattern."""
    return text.contains("[") | text.contains("`") | text.contains('"')


def normalized(sql: Column, names: Column | None = None) -> Column:
    """Fence-free text with single blanks; plain names lose their quotes, others become words that stand for them."""
    def plain(text: Column) -> Column:
        return F.when(_quoting(text), F.regexp_replace(text, rf'\[({NAME})\]|`({NAME})`|"({NAME})"', "$1$2$3")).otherwise(text)

    text = let(F.regexp_replace(clean_sql(sql), r"\s+", " "), plain)
    if names is None:
        return text
    placed = F.transform(names, lambda n, i: F.struct(n.alias("name"), _mark(NAME_MARK, i).alias("mark")))
    return F.aggregate(placed, text, lambda done, e: F.replace(done, e["name"], e["mark"]))


def restored(text: Column, names: Column, quotes: bool) -> Column:
    """Quoted names put back in place of their words, with their quotes or without."""
    placed = F.transform(names, lambda n, i: F.struct((n if quotes else F.substring(n, F.lit(2), F.length(n) - 2)).alias("name"), _mark(NAME_MARK, i).alias("mark")))
    return F.aggregate(placed, text, lambda done, e: F.replace(done, e["mark"], e["name"]))


def joined_lists(bare: Column) -> Column:
    """FROM a, b as FROM a join b, so that one pattern reads both."""
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(",")))
    return F.when(~(bare.contains(",") & bare.rlike(FROM_LIST)), bare).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(commas, F.lit(1))), bare, lambda done, _: F.regexp_replace(done, FROM_LIST, "$1 join ")))


def folded(text: Column) -> Column:
    """struct(text, parts): every bracketed part, innermost first, replaced by a word, so that clauses end where they do."""
    def fold(state: Column, _: Column) -> Column:
        inner = F.regexp_extract(state["text"], r"\([^()]*\)", 0)
        at = F.locate("\u0001", F.regexp_replace(state["text"], r"\([^()]*\)", "\u0001"))
        word = F.concat(F.lit(" "), _mark(PART_MARK, F.size(state["parts"])), F.lit(" "))
        changed = F.concat(F.substring(state["text"], F.lit(1), at - 1), word, F.substring(state["text"], at + F.length(inner), F.length(state["text"])))
        return F.when(inner == "", state).otherwise(F.struct(changed.alias("text"), F.concat(state["parts"], F.array(inner)).alias("parts")))

    opened = F.length(text) - F.length(F.replace(text, F.lit("(")))
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), start, fold)


def unfolded(text: Column, parts: Column) -> Column:
    """Bracketed parts put back, the last one first, since it may hold earlier ones."""
    placed = F.reverse(F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.concat(F.lit(" "), _mark(PART_MARK, i), F.lit(" ")).alias("mark"))))
    return F.trim(F.aggregate(placed, F.concat(F.lit(" "), text, F.lit(" ")), lambda done, e: F.replace(done, e["mark"], e["part"])))


def blanked(text: Column) -> Column:
    """The text with its string literals emptied, so that no word inside one is taken for a name."""
    return F.regexp_replace(text, STRING_LITERAL, "''")


def parse_error(bare: Column) -> Column:
    """A lexical check of a blanked text: it starts with SELECT or WITH and its brackets and quotes are balanced."""
    def without(mark: str) -> Column:
        return F.length(F.replace(bare, F.lit(mark)))

    odd_quotes = (F.length(bare) - without("'")) % 2 != 0
    return ~bare.rlike(r"(?is)^\s*\(?\s*(?:select|with)\b") | (without("(") != without(")")) | odd_quotes


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sorted_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def table_refs(bare: Column) -> Column:
    """Tables as named after FROM and JOIN, in order, with repeats."""
    return _all(bare, TABLE_REF, 1)


def table_names(bare: Column) -> Column:
    return sorted_set(table_refs(bare))


def table_aliases(bare: Column) -> Column:
    """(alias, table) of the tables that have an alias, in order."""
    return F.transform(_all(bare, TABLE_ALIAS, 0), lambda found: let(F.split(found, r"\s+"), lambda words: F.struct(F.element_at(words, -1).alias("alias"), words[1].alias("table"))))


def alias_map(refs: Column, aliases: Column) -> Column:
    """map<alias, table>; a table without alias stands for itself."""
    plain = F.transform(refs, lambda t: F.struct(t.alias("alias"), t.alias("table")))

    def first_of_each(entries: Column) -> Column:
        return let(
            entries.getField("alias"),
            lambda names: F.filter(entries, lambda e, i: F.array_position(names, e["alias"]) == i + 1),
        )

    return F.map_from_entries(let(F.concat(aliases, plain), first_of_each))


def given_names(bare: Column, refs: Column, aliases: Column) -> Column:
    """Bare names that are tables or aliases, hence no columns."""
    return F.array_distinct(F.concat(refs, aliases.getField("alias"), _all(bare, GIVEN_NAME, 1)))


def column_refs(bare: Column, given: Column) -> Column:
    """Column names as written in a piece of SQL, in order, with repeats."""
    return F.filter(_all(bare, COLUMN_REF, 0), lambda c: c.contains(".") | ~F.array_contains(given, c))


def column_names(bare: Column) -> Column:
    return sorted_set(let(given_names(bare, table_refs(bare), table_aliases(bare)), lambda given: column_refs(bare, given)))


def join_predicates(text: Column) -> Column:
    return _all(text, JOIN_ON, 1)


def _top_level(text: Column, pattern: str) -> Column:
    """The first group of a pattern outside all brackets, with the brackets' content; of a bracketed query, inside them."""
    plain = F.regexp_extract(text, pattern, 1)
    outside = let(folded(text), lambda f: F.when(f["text"].rlike(r"(?i)\bselect\b"), unfolded(F.regexp_extract(f["text"], pattern, 1), f["parts"])))
    return F.when(text.contains("("), F.coalesce(outside, plain)).otherwise(plain)


def clause(text: Column, opening: str) -> Column:
    """The query's own text after ``opening`` up to its next clause, or NULL. Subqueries' clauses are not looked at."""
    body = _top_level(text, rf"(?is)\b{opening}\s+(.+?){CLAUSE_END}")
    return let(body, lambda found: F.when(found != "", found))


def select_list(text: Column) -> Column:
    return _top_level(text, SELECT_LIST)


def aggregate_functions(bare: Column) -> Column:
    return F.transform(_all(bare, AGGREGATE_CALL, 1), lambda f: F.upper(f))


def literals(text: Column) -> Column:
    """String and number literals, quotes dropped, in order of appearance."""
    return F.transform(_all(text, ANY_LITERAL, 0), lambda v: F.regexp_replace(v, "^'|'$", ""))


Fields = Callable[[Column, Column, Column], dict[str, Column]]


def read(sql: Column, names: Column) -> Column:
    """struct(text, bare, good): the normalized text, its blanked form and whether that is good, each made once."""
    def made(text: Column) -> Column:
        return let(let(blanked(text), joined_lists), lambda bare: F.struct(text.alias("_text"), bare.alias("_bare"), (~parse_error(bare)).alias("_good")))

    return let(normalized(sql, names), made)


# Features that are pieces of SQL in order of appearance; other lists are sorted sets of names.
PIECES = ("joins", "join_predicates", "literals_used", "aggregation_functions")


def _put_back(value: Column, name: str, kind: T.DataType, names: Column) -> Column:
    """A feature with its quoted names: bare in lists of names, in quotes in pieces of SQL."""
    if isinstance(kind, T.StringType):
        return restored(value, names, True)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        put = F.transform(value, lambda v: restored(v, names, name in PIECES))
        return put if name in PIECES else sorted_set(put)
    return value


def with_features(rows: DataFrame, sql: str, fields: Fields, marked: bool = False, shared: tuple[Fields, ...] = ()) -> DataFrame:
    """Rows with the features of ``sql`` as columns, of which those that nobody reads are not made.

    The generator keeps the normalized text from being made once per feature, and a filter by ``good`` from making it again.
    What several features read may be made once, as columns that ``shared`` gives, step by step, and the result does not have.
    With ``marked`` quoted names stay words, for further patterns, and the column ``quoted_names`` restores them.
    """
    named = rows.withColumn("quoted_names", quoted_names(clean_sql(F.col(sql))))
    given = named.select("*", F.inline(F.array(read(F.col(sql), F.col("quoted_names")))))
    seen = [F.col("_text"), F.col("_bare"), F.col("_good")]
    for step in shared:
        given = given.withColumns(step(*seen))
    made = fields(*seen)
    found = given.withColumns(made).select(*named.columns, *[n for n in made if n not in named.columns])
    if marked:
        return found
    put = {
        f.name: F.when(F.size("quoted_names") > 0, _put_back(F.col(f.name), f.name, f.dataType, F.col("quoted_names"))).otherwise(F.col(f.name))
        for f in found.schema.fields if f.name not in named.columns
    }
    return found.withColumns(put).drop("quoted_names")
