"""The structure of SQL text by its nesting, as Column expressions.

A statement is cut into tokens (strings and comments are one token each), and
a small walk in Arrow batches keeps a stack of open parentheses.  Each level
knows whether it is a subquery, the body of a common table, EXISTS, a call or a
mere group, and in which clause it is.  Flags, tables and aliases are then read
off the walked tokens, so that words in strings, comments and quoted names, and
clauses of inner queries, are not mistaken for the statement's own.  Where only
names are wanted, ``names`` reads them where the walk is made, and no tokens
travel.

A null or blank text, and one that is not well formed (unbalanced parentheses,
an open string, no statement word at the start), has every flag 'no' and no
names.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

TOKEN = (
    r"--[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/|'[^']*+(?:''[^']*+)*+'|" + r'"[^"]*+(?:""[^"]*+)*+"|`[^`]*+`|\[[^\]]*+\]|'
    r"[A-Za-z_][A-Za-z0-9_$]*+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|<>|!=|<=|>=|\|\||\S"
)

# Words of the language, and the functions of each kind.
STARTS = ("select", "with", "(", "values", "insert", "update", "delete", "create", "explain", "replace")
NOT_NAMES = (
    "select", "from", "where", "group", "having", "order", "limit", "offset", "by", "on", "using", "set", "inner", "left", "right", "full", "outer", "cross", "natural", "join", "as", "and", "or", "not", "in", "is", "like",
    "glob", "between", "exists", "case", "when", "then", "else", "end", "distinct", "all", "union", "intersect", "except", "window", "asc", "desc", "with", "recursive", "values", "over", "partition", "escape", "collate",
    "materialized", "return", "lateral",
)
AGGREGATES = ("count", "sum", "avg", "min", "max", "group_concat", "string_agg", "array_agg", "total", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "median")
TEXT_FUNCTIONS = ("replace", "substr", "substring", "upper", "lower", "trim", "ltrim", "rtrim", "instr", "length", "glob")
DATE_FUNCTIONS = ("strftime", "date", "datetime", "julianday", "time")
FLAGS = (
    "has_join", "has_subquery", "has_nested_subquery", "has_union", "has_limit", "has_distinct", "has_case", "has_where", "has_group_by", "has_having", "has_order_by", "has_aggregation", "has_like", "has_between", "has_in",
    "has_exists", "multi_join", "multi_table", "many_conditions", "wide_select", "has_math", "has_string_op", "has_date_func", "has_null_check", "has_or", "has_not",
)

_WALKED = "struct<t:string,k:string,name:string,prev:string,prev_k:string,next:string,i:int,depth:int,queries:int,subqueries:int,clause:string,at:int,where_at:int,having_at:int,logic:boolean,role:string,of:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


_FIELDS = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[t]) for n, t in (f.split(":") for f in _WALKED[7:-1].split(","))])
_SPLIT = re.compile(TOKEN, re.ASCII)
_CLAUSES = frozenset(("select", "from", "where", "group", "having", "order", "limit", "with", "union", "intersect", "except"))
_STARTS, _NOT_NAMES, _QUERIES, _INNER = frozenset(STARTS), frozenset(NOT_NAMES), frozenset(("root", "sub", "exists", "cte")), frozenset(("sub", "exists", "cte"))
_LETTERS, _DIGITS = frozenset(string.ascii_letters + "_"), frozenset(string.digits)


def _tokens(sql: str) -> list[tuple[str, str, str]]:
    """(k, t, name): ``k`` (w word, q quoted name, s string, n number, o other), ``t`` in lower case, ``name`` as written without quotes; comments go."""
    out = []
    for t in _SPLIT.findall(sql):
        first, long = t[0], len(t) > 1
        if t.startswith("--") or (t.startswith("/*") and len(t) > 3):
            continue
        k = "w" if first in _LETTERS else "s" if first == "'" and long else "q" if first in '"`[' and long else "n" if first in _DIGITS else "o"
        out.append((k, t.lower(), t[1:-1] if k == "q" else t))
    return out


def _walk(sql: str | None) -> list[tuple]:
    """The tokens of one statement with their place in the nesting, as ``_WALKED``."""
    toks = _tokens(sql or "")
    if not toks or toks[0][1] not in _STARTS:
        return []
    # a level: kind, clause, at, between, table_next, alias_next, table; beside it what all levels up to it
    # add up to: queries, subqueries, and of those below it the outermost where and having
    stack, beside, out, prev, prev_k = [("root", "", -1, False, False, False, None)], [(0, 0, -1, -1)], [], "", ""
    for i, (k, t, name) in enumerate(toks):
        following = toks[i + 1][1] if i + 1 < len(toks) else ""
        kind, clause, at, between, table_next, alias_next, table = top = stack[-1]
        word, in_query, opens, closes = k == "w", kind in _QUERIES, t == "(", t == ")"
        if (closes and len(stack) == 1) or (k == "o" and t in "'\"`"):
            return []
        in_from = clause == "from" and (in_query or kind == "group")
        starts = word and in_query and t in _CLAUSES and not (t == "from" and prev == "distinct") and not (t == "group" and following != "by")
        back = in_query and clause == "on" and ((word and t == "join") or t == ",")
        name_like = k == "q" or (word and t not in _NOT_NAMES)
        is_table = in_from and table_next and name_like and following not in (".", "(")
        is_alias = in_from and alias_next and name_like
        is_cte = in_query and clause == "with" and prev in ("with", "recursive", ",") and name_like
        opened = None
        if opens:
            if following in ("select", "with", "values"):
                opened = "exists" if prev == "exists" else "cte" if prev in ("as", "materialized") and clause == "with" else "sub"
            else:
                opened = "call" if prev_k == "q" or (prev_k == "w" and prev not in _NOT_NAMES) else "group"

        now = t if starts else "on" if word and in_from and t in ("on", "using") else "from" if back else clause
        now_at = i if starts else at
        if starts:
            next_table = t == "from"
        elif (word and t == "join") or t == ",":
            next_table = in_from or back
        elif is_table or (name_like and following != "."):
            next_table = False
        else:
            next_table = table_next and (t == "." or name_like or t == "lateral")
        next_alias = is_table or (word and t == "as" and alias_next)
        now_between = True if word and t == "between" else False if word and t == "and" else between

        queries, subqueries, where_at, having_at = beside[-1]
        where_at = at if where_at < 0 and clause == "where" else where_at
        having_at = at if having_at < 0 and clause == "having" else having_at
        role = "table" if is_table else "alias" if is_alias else "cte" if is_cte else f"open {opened}" if opens else None
        out.append((
            t, k, name, prev, prev_k, following, i, len(stack), queries, subqueries, now, now_at, where_at, having_at,
            word and t in ("and", "or") and not (t == "and" and between), role, table if is_alias else None,
        ))
        if closes:
            stack.pop()
            beside.pop()
        else:
            stack[-1] = (kind, now, now_at, now_between, next_table, next_alias, name if is_table else table)
            if opens:
                tables = opened == "group" and in_from and top[4]
                stack.append((opened, "from" if tables else "", -1, False, tables, False, None))
                under = now_at if now == "where" and beside[-1][2] < 0 else beside[-1][2], now_at if now == "having" and beside[-1][3] < 0 else beside[-1][3]
                beside.append((queries + (opened in _INNER), subqueries + (opened == "sub"), *under))
        prev, prev_k = t, k
    return out if len(stack) == 1 else []


def _each(sql: pa.Array, make) -> pa.Array:
    """``make`` of the distinct texts of a batch, for each row."""
    coded = sql.dictionary_encode(null_encoding="encode")
    made = make(coded.dictionary.to_pylist())
    return made if len(made) == len(sql) else made.take(coded.indices)


@F.arrow_udf(ArrayType(StructType([StructField(f.name, {pa.int32(): IntegerType(), pa.bool_(): BooleanType()}.get(f.type, StringType())) for f in _FIELDS])))
def walked(sql: pa.Array) -> pa.Array:
    """The tokens with their place in the nesting; empty where the text is not well formed."""

    def make(texts: list[str | None]) -> pa.Array:
        walks = [_walk(t) for t in texts]
        columns = list(zip(*itertools.chain.from_iterable(walks))) or [()] * len(_FIELDS)
        rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], fields=list(_FIELDS))
        return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, walks))], pa.int32()), rows)

    return _each(sql, make)


_AT = {f.name: i for i, f in enumerate(_FIELDS)}
_T, _K, _NAME, _NEXT, _ROLE, _OF = (_AT[n] for n in ("t", "k", "name", "next", "role", "of"))


def _aliases(walk: list[tuple]) -> dict[str, str]:
    return {x[_NAME].lower(): x[_OF] for x in walk if x[_ROLE] == "alias" and x[_OF] is not None}


@F.arrow_udf(MapType(StringType(), StringType()))
def alias_map(sql: pa.Array) -> pa.Array:
    """``aliases_of`` of a statement's text, without its tokens."""
    return _each(sql, lambda texts: pa.array([list(_aliases(_walk(t)).items()) for t in texts], pa.map_(pa.string(), pa.string())))


_NAMES = pa.struct([("tables", pa.list_(pa.string())), ("aliases", pa.map_(pa.string(), pa.string())), ("common_tables", pa.list_(pa.string())), ("columns", pa.list_(pa.string()))])


@F.arrow_udf(StructType([StructField(f.name, MapType(StringType(), StringType()) if pa.types.is_map(f.type) else ArrayType(StringType())) for f in _NAMES]))
def names(sql: pa.Array) -> pa.Array:
    """``tables_of``, ``aliases_of``, ``common_tables_of`` and ``columns_of`` of a statement's text, without its tokens."""

    def found(text: str | None) -> tuple:
        walk = _walk(text)
        aliases = _aliases(walk)
        named = lambda role: sorted({x[_NAME] for x in walk if x[_ROLE] == role})
        columns = {
            f"{aliases.get(q[_NAME].lower(), q[_NAME])}.{x[_NAME]}".lower()
            for q, dot, x in zip(walk, walk[1:], walk[2:])
            if dot[_T] == "." and x[_K] in ("w", "q") and x[_NEXT] != "." and q[_K] in ("w", "q") and x[_ROLE] != "table"
        }
        return named("table"), list(aliases.items()), named("cte"), sorted(columns)

    def make(texts: list[str | None]) -> pa.Array:
        columns = zip(*map(found, texts)) if texts else [[]] * len(_NAMES)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NAMES)], fields=list(_NAMES))

    return _each(sql, make)


def flags(walk: Column, prefix: str = "wrong_") -> dict[str, Column]:
    """The 26 flags, 'yes' or 'no', of a column of ``walked``."""
    count = lambda test: F.size(F.filter(walk, test))
    word = lambda *ws: lambda x: (x["k"] == "w") & x["t"].isin(*ws)
    call = lambda *ws: lambda x: (x["k"] == "w") & x["t"].isin(*ws) & (x["next"] == "(")
    any_of = lambda *tests: functools.reduce(or_, (count(t) > 0 for t in tests))

    joins = count(word("join")) + count(lambda x: (x["t"] == ",") & (x["clause"] == "from") & (x["k"] == "o") & (x["role"].isNull()))
    outer = lambda t: F.get(F.array_sort(F.transform(F.filter(walk, lambda x: (x["k"] == "w") & (x["t"] == t) & (x["at"] == x["i"])), lambda x: F.struct(x["queries"], x["i"]))), F.lit(0))["i"]
    # the place of the outer clause is found once a row, not once a token
    after = lambda t, test: _let(F.struct(walk.alias("w"), outer(t).alias("o")), lambda y: F.when(y["o"].isNull(), 0).otherwise(1 + F.size(F.filter(y["w"], lambda x: test(x, y["o"])))))
    conditions = lambda t, at: after(t, lambda x, o: (x[at] == o) & x["logic"])
    width = after("select", lambda x, o: (x["t"] == ",") & (x["k"] == "o") & (x["clause"] == "select") & (x["at"] == o))
    operand = lambda x: x["prev_k"].isin("n", "s", "q") | (x["prev"] == ")") | ((x["prev_k"] == "w") & ~x["prev"].isin(*NOT_NAMES))
    math = lambda x: (x["k"] == "o") & x["t"].isin("*", "/", "-") & operand(x) & ~((x["t"] == "*") & x["next"].isin("", ",", ")", "from"))
    null_check = lambda x: (x["k"] == "w") & (x["t"] == "null") & ((x["prev"] == "is") | (x["prev"] == "not"))
    tests = {
        "has_join": joins >= 1, "has_subquery": count(lambda x: x["role"] == "open sub") >= 1, "has_nested_subquery": count(lambda x: (x["role"] == "open sub") & (x["subqueries"] >= 1)) >= 1,
        "has_union": any_of(word("union")), "has_limit": any_of(word("limit")), "has_distinct": any_of(word("distinct")), "has_case": any_of(word("case")), "has_where": any_of(word("where")),
        "has_group_by": any_of(lambda x: (x["t"] == "group") & (x["k"] == "w") & (x["next"] == "by")), "has_having": any_of(word("having")), "has_order_by": any_of(lambda x: (x["t"] == "order") & (x["k"] == "w") & (x["next"] == "by")),
        "has_aggregation": any_of(call(*AGGREGATES)), "has_like": any_of(word("like")), "has_between": any_of(word("between")), "has_in": any_of(word("in")), "has_exists": any_of(call("exists")),
        "multi_join": joins >= 2, "multi_table": count(lambda x: x["role"] == "table") >= 3, "many_conditions": conditions("where", "where_at") + conditions("having", "having_at") >= 3, "wide_select": width >= 5,
        "has_math": any_of(math), "has_string_op": any_of(word("like"), call(*TEXT_FUNCTIONS)), "has_date_func": any_of(call(*DATE_FUNCTIONS)), "has_null_check": any_of(null_check), "has_or": any_of(word("or")), "has_not": any_of(word("not")),
    }
    return {prefix + name: F.when(tests[name], "yes").otherwise("no") for name in FLAGS}


def tables_of(walk: Column) -> Column:
    """Names of the tables that the statement reads at any depth, sorted and distinct, as written; names of common tables too where they are read."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(walk, lambda x: x["role"] == "table"), lambda x: x["name"])))


def aliases_of(walk: Column) -> Column:
    """A map from each alias in lower case to its table; the last one wins."""
    return F.aggregate(
        F.filter(walk, lambda x: (x["role"] == "alias") & x["of"].isNotNull()), F.create_map().cast("map<string,string>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda a, _: a != F.lower(x["name"])), F.create_map(F.lower(x["name"]), x["of"])),
    )


def common_tables_of(walk: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(walk, lambda x: x["role"] == "cte"), lambda x: x["name"])))


def columns_of(walk: Column) -> Column:
    """Qualified columns, as ``qualifier.name`` in lower case with aliases put back to tables; sorted and distinct."""

    def found(y: Column) -> Column:
        walk, aliases = y["w"], y["a"]
        after_dot = F.transform(walk, lambda x, i: F.struct(x.alias("x"), F.get(walk, i - 1)["t"].alias("dot"), F.get(walk, i - 2).alias("q")))
        hits = F.filter(after_dot, lambda y: (y["dot"] == ".") & y["x"]["k"].isin("w", "q") & (y["x"]["next"] != ".") & y["q"]["k"].isin("w", "q") & ~(F.coalesce(y["x"]["role"], F.lit("")) == "table"))
        table = lambda y: F.coalesce(F.try_element_at(aliases, F.lower(y["q"]["name"])), y["q"]["name"])
        return F.array_sort(F.array_distinct(F.transform(hits, lambda y: F.lower(F.concat(table(y), F.lit("."), y["x"]["name"])))))

    return _let(F.struct(walk.alias("w"), aliases_of(walk).alias("a")), found)
