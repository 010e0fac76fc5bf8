"""From a syntax tree to a DataFrame: binder, expressions, expansion, aggregation.

Every bound variable is a set of columns ``<variable>__<property>`` holding only the properties that the query needs;
a hop is an equi-join on the edges. Conditions at the top of WHERE stay bare, so that they reach the scans.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.kernels import EPSILON, as_text
from codeloom.graph import PropertyGraph
from codeloom.lang.procedures import PROCEDURES
from codeloom.lang.syntax import Agg, Func, ListOf, Lit, Node, Op, Prop, Query, QueryError, Rel, Var, parse

NUMBERS = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
ROW_CAP = 1000


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _walk(e):
    yield e
    for x in (getattr(e, "left", None), getattr(e, "right", None), getattr(e, "arg", None), *getattr(e, "args", ()), *getattr(e, "items", ())):
        if x is not None and not isinstance(x, (str, int, float, bool)):
            yield from _walk(x)


class Compiler:
    def __init__(self, graph: PropertyGraph, dialect: str, compat: bool, varlen: bool, implicit_grouping: bool, promote_overflow: bool):
        self.g, self.dialect, self.compat, self.varlen, self.grouping, self.promote = graph, dialect, compat, varlen, implicit_grouping, promote_overflow
        self.types = {f.name: f.dataType.simpleString() for f in graph.nodes.schema}
        self.needed: dict[str, set[str]] = {}
        self.vars: list[str] = []

    # properties

    def column_of(self, name: str) -> str | None:
        name = {"_id": "id", "_label": "label"}.get(name, name)
        return name if name in self.types else snake(name) if snake(name) in self.types else None

    def need(self, q: Query) -> None:
        for e in [q.where, *[r for r, _ in q.returns], *[o for o, _ in q.order]]:
            for x in _walk(e) if e is not None else ():
                if isinstance(x, Prop) and (c := self.column_of(x.field)):
                    self.needed.setdefault(x.var, set()).add(c)
                elif isinstance(x, Var) and self.dialect == "cypher" and not isinstance(e, Agg):
                    self.needed.setdefault(x.name, set()).update(self.types)

    # patterns

    def scan(self, node: Node, name: str) -> DataFrame:
        df = self.g.nodes
        if node.label:
            df = df.where(F.col("label") == node.label)
        for k, v in node.props:
            df = df.where(self.strict(k, v))
        return df.select(F.col("id").alias(f"{name}__id"), *[F.col(c).alias(f"{name}__{c}") for c in sorted(self.needed.get(name, set()) - {"id"})])

    def strict(self, key: str, value: Lit, prefix: str = "") -> Column:
        """Equality of the same type; a missing property equals null."""
        c = self.column_of(key)
        if not isinstance(value, Lit):
            raise QueryError("a property filter needs a literal")
        if c is None:
            return F.lit(value.value is None)
        kind, v = self.types[c], value.value
        col = F.col(f"{prefix}{c}")
        fits = v is None or (isinstance(v, bool) and kind == "boolean") or (isinstance(v, int) and not isinstance(v, bool) and kind in ("int", "bigint")) or (isinstance(v, float) and kind in ("double", "float")) or (isinstance(v, str) and kind == "string")
        return col.isNull() if v is None else col == F.lit(v) if fits else F.lit(False)

    def edges(self, rel: Rel) -> DataFrame:
        e = self.g.edges
        if rel.type is not None:
            if rel.type in self.g.rel_types:
                e = e.where(F.col("type") == rel.type)
            elif not self.compat:
                raise QueryError(f"unknown relationship type {rel.type}")
        a, b = ("target_id", "source_id") if rel.direction == "in" else ("source_id", "target_id")
        out = e.select(F.col(a).alias("e_from"), F.col(b).alias("e_to"))
        return out.unionAll(e.select(F.col(b).alias("e_from"), F.col(a).alias("e_to"))) if rel.direction == "both" else out

    def match(self, q: Query) -> DataFrame:
        df, n = None, 0
        for pattern in q.patterns:
            here = None
            for i in range(0, len(pattern), 2):
                node, name = pattern[i], pattern[i].var
                if name is None:
                    n += 1
                    name = f"anonymous{n}"
                if i == 0:
                    if node.var in self.vars:
                        df = self.narrow(df, node, name)
                    else:
                        s = self.scan(node, name)
                        df = s if df is None else df.crossJoin(s)
                        self.vars.append(name)
                else:
                    df = self.hop(df, here, pattern[i - 1], node, name)
                here = name
            if self.dialect == "cql" and len(pattern) > 1:  # sets of bindings, where the other dialect has bags
                df = df.dropDuplicates([f"{v}__id" for v in self.vars if not v.startswith("anonymous") or v == here])
        return df

    def narrow(self, df: DataFrame, node: Node, name: str) -> DataFrame:
        """A variable that is bound already: its further conditions."""
        if node.label or node.props:
            ok = self.scan(Node(None, node.label, node.props), "again").select("again__id")
            df = df.join(ok, F.col(f"{name}__id") == F.col("again__id"), "left_semi")
        return df

    def hop(self, df: DataFrame, source: str, rel: Rel, node: Node, name: str) -> DataFrame:
        if source.startswith("anonymous") and self.dialect == "cql" and self.compat:
            df = df.where(F.lit(False))  # the reference behaviour: nothing leads on from a node without a name
        e = self.edges(rel)
        if self.varlen and rel.hops and rel.hops != (1, 1):
            e = self.paths(df.select(F.col(f"{source}__id").alias("e_from")).distinct(), e, *rel.hops)
        bound = name in self.vars
        joined = df.join(e, F.col(f"{source}__id") == F.col("e_from"))
        if bound:
            joined = self.narrow(joined.where(F.col("e_to") == F.col(f"{name}__id")), node, name)
        else:
            dangling = self.dialect == "cypher" and node.label is None
            s = self.scan(node, name)
            joined = joined.join(s, F.col("e_to") == F.col(f"{name}__id"), "left" if dangling else "inner")
            if dangling:
                joined = joined.withColumn(f"{name}__id", F.coalesce(f"{name}__id", "e_to"))
            self.vars.append(name)
        return joined.drop("e_from", "e_to")

    def paths(self, starts: DataFrame, e: DataFrame, low: int, high: int) -> DataFrame:
        """(start, end) pairs of walks of low to high hops."""
        front = starts.select("e_from", F.col("e_from").alias("e_to"))
        out = [front] if low == 0 else []
        for k in range(1, high + 1):
            step = e.select(F.col("e_from").alias("s_from"), F.col("e_to").alias("s_to"))
            front = front.join(step, F.col("e_to") == F.col("s_from")).select("e_from", F.col("s_to").alias("e_to")).distinct()
            if k >= low:
                out.append(front)
        return reduce(DataFrame.unionAll, out).distinct()

    # expressions: a Column with its type

    def value(self, e, aliases: dict | None = None) -> tuple[Column, str]:
        if isinstance(e, Lit):
            v = e.value
            return F.lit(v), "null" if v is None else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
        if isinstance(e, Prop):
            if e.var not in self.vars:
                raise QueryError(f"unbound variable {e.var}")
            c = self.column_of(e.field)
            return (F.col(f"{e.var}__{c}"), self.types[c]) if c else (F.lit(None).cast("string"), "null")
        if isinstance(e, Var):
            if e.name not in self.vars:
                raise QueryError(f"unbound variable {e.name}")
            return F.col(f"{e.name}__id"), "node"
        if isinstance(e, ListOf):
            return F.array(*[self.value(x)[0] for x in e.items]), "array"
        if isinstance(e, Func):
            return self.function(e)
        if isinstance(e, Op):
            return self.operation(e)
        raise QueryError(f"{type(e).__name__} is not allowed here")

    def function(self, e: Func) -> tuple[Column, str]:
        name, args = e.name.lower(), [self.value(a) for a in e.args]
        if name in ("size", "length") and len(args) == 1:
            c, kind = args[0]
            if kind.startswith("array"):
                return F.size(c).cast("long"), "bigint"
            return (F.octet_length(c).cast("long"), "bigint") if kind == "string" else (F.lit(None).cast("long"), "bigint")
        if name == "tostring" and len(args) == 1:
            c, kind = args[0]
            if kind == "node":
                return F.concat(F.lit("("), c, F.lit(")")), "string"
            if kind.startswith("array"):
                return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ", "), F.lit("]")), "string"
            return as_text(c, kind), "string"
        if name in ("toupper", "tolower") and len(args) == 1:
            return (F.upper if name == "toupper" else F.lower)(args[0][0].cast("string")) if args[0][1] == "string" else F.lit(None).cast("string"), "string"
        if name == "coalesce" and args:
            return F.coalesce(*[a for a, _ in args]), next((k for _, k in args if k != "null"), "null")
        raise QueryError(f"unsupported function {e.name}")

    def equal(self, a: tuple[Column, str], b: tuple[Column, str]) -> Column:
        (x, s), (y, t) = a, b
        if s in NUMBERS and t in NUMBERS:
            if "double" in (s, t) or "float" in (s, t):
                both = x.isNull() & y.isNull()
                return F.coalesce(F.abs(x.cast("double") - y.cast("double")) < EPSILON, both)
            return x.eqNullSafe(y)
        if "null" in (s, t) or s == t or {s, t} <= {"string", "node"} and s == t:
            return x.eqNullSafe(y) if s != "null" or t != "null" else F.lit(True)
        return x.isNull() & y.isNull()

    def truth(self, e) -> Column:
        c, kind = self.value(e)
        return F.coalesce(c, F.lit(False)) if kind == "boolean" else F.lit(False) if kind == "null" else c.isNotNull()

    def operation(self, e: Op) -> tuple[Column, str]:
        if e.op in ("and", "or"):
            a, b = self.truth(e.left), self.truth(e.right)
            return (a & b if e.op == "and" else a | b), "boolean"
        if e.op == "not":
            c, kind = self.value(e.left)
            return (~c, "boolean") if kind == "boolean" else (F.lit(None).cast("boolean"), "boolean")
        a = self.value(e.left)
        if e.op == "in":
            if not isinstance(e.right, ListOf):
                raise QueryError("IN needs a list")
            return reduce(lambda p, q: p | q, [self.equal(a, self.value(x)) for x in e.right.items], F.lit(False)), "boolean"
        b = self.value(e.right)
        (x, s), (y, t) = a, b
        if e.op == "=":
            return self.equal(a, b), "boolean"
        if e.op == "<>":
            return ~self.equal(a, b), "boolean"
        if e.op in ("<", ">", "<=", ">="):
            if (s in NUMBERS and t in NUMBERS) or (s == t == "string"):
                return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.op], "boolean"
            return F.lit(False), "boolean"
        if e.op in ("contains", "starts", "ends"):
            if s == t == "string":
                return {"contains": x.contains(y), "starts": x.startswith(y), "ends": x.endswith(y)}[e.op], "boolean"
            return F.lit(False), "boolean"
        if e.op == "=~":
            return (F.rlike(x, y), "boolean") if s == t == "string" else (F.lit(False), "boolean")
        if s in NUMBERS and t in NUMBERS:
            if "double" in (s, t) or self.promote:
                x, y = x.cast("double"), y.cast("double")
                return (x + y if e.op == "+" else x - y), "double"
            f = F.try_add if e.op == "+" else F.try_subtract
            return f(x.cast("long"), y.cast("long")), "bigint"
        if e.op == "+" and s == t == "string":
            return F.concat(x, y), "string"
        return F.lit(None).cast("string"), "null"

    # cypher conditions: two-valued, on display strings

    def cypher(self, e) -> Column:
        if e.op == "and":
            return self.cypher(e.left) & self.cypher(e.right)
        if e.op == "or":
            return self.cypher(e.left) | self.cypher(e.right)
        if e.op == "not":
            return ~self.cypher(e.left)
        c, kind = self.value(e.left)
        v = e.right.value
        if v is None:
            return (c.isNull() if e.op == "=" else c.isNotNull()) if e.op in ("=", "<>") else F.lit(False)
        if kind == "null":
            return F.lit(False)
        s = c if kind == "string" else F.when(c.isNotNull(), as_text(c, kind))
        y = F.lit(str(v).lower() if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
        r = {"=": s == y, "<>": s != y, "contains": s.contains(y), "starts": s.startswith(y), "ends": s.endswith(y)}[e.op]
        return F.coalesce(r, F.lit(False))

    # statements

    def conjuncts(self, e) -> list:
        return self.conjuncts(e.left) + self.conjuncts(e.right) if isinstance(e, Op) and e.op == "and" else [e]

    def run(self, q: Query) -> DataFrame:
        if q.call:
            name = q.call.name.upper()
            if name not in PROCEDURES:
                raise QueryError(f"unknown function {q.call.name}")
            return PROCEDURES[name](self.g, self.dialect, [a.value if isinstance(a, Lit) else None for a in q.call.args])
        self.need(q)
        df = self.match(q)
        if q.where is not None:
            try:
                for c in self.conjuncts(q.where):
                    col, kind = (self.cypher(c), "boolean") if self.dialect == "cypher" else self.value(c)
                    df = df.where(col if kind == "boolean" else F.lit(False) if kind == "null" else col.isNotNull())
            except QueryError as e:
                if "unbound" not in str(e) or self.dialect != "cql":
                    raise
                df = df.where(F.lit(False))  # an error in WHERE drops every row
        return self.cypher_result(q, df) if self.dialect == "cypher" else self.cql_result(q, df)

    def title(self, e, alias: str | None) -> str:
        if alias:
            return alias
        return e.name if isinstance(e, (Var, Func)) else f"{e.var}.{e.field}" if isinstance(e, Prop) else e.name.lower() if isinstance(e, Agg) else "expr"

    def aggregate(self, e: Agg) -> Column:
        if e.arg is None:
            c, kind = F.lit(1), "bigint"
        else:
            c, kind = self.value(e.arg)
        number = c.cast("double") if kind in NUMBERS else F.lit(0.0)
        if e.distinct:
            shown = as_text(c, kind)
            if e.name == "count":
                return F.countDistinct(shown)
            if e.name == "collect":
                return F.array_sort(F.collect_set(shown))
            # equal numbers are shown alike, so their distinct sum needs no list of them; a null is a value of its own, 0
            total = F.coalesce(F.sum_distinct(number), F.lit(0.0))
            if e.name == "sum":
                return total
            if e.name == "avg":
                return total / F.nullif(F.countDistinct(shown), F.lit(0))
        if e.name == "count":
            return F.count(F.lit(1))
        if e.name == "collect":
            return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"])
        if e.name == "sum":
            return F.coalesce(F.sum(F.coalesce(number, F.lit(0.0))), F.lit(0.0))
        if e.name == "avg":
            return F.sum(F.coalesce(number, F.lit(0.0))) / F.nullif(F.count(F.lit(1)), F.lit(0))
        return (F.min if e.name == "min" else F.max)(c)

    def cql_result(self, q: Query, df: DataFrame) -> DataFrame:
        titles = []
        for e, alias in q.returns:
            t, k = self.title(e, alias), 1
            while t in titles:  # a title may stand twice; later ones get a number
                k += 1
                t = f"{self.title(e, alias)}_{k}"
            titles.append(t)
        if any(isinstance(e, Agg) for e, _ in q.returns):
            plain = [(t, e) for t, (e, _) in zip(titles, q.returns) if not isinstance(e, Agg)]
            aggs = [self.aggregate(e).alias(t) for t, (e, _) in zip(titles, q.returns) if isinstance(e, Agg)]
            if self.grouping:
                out = df.groupBy(*[self.value(e)[0].alias(t) for t, e in plain]).agg(*aggs)
            else:
                out = df.agg(*aggs)
                for t, e in plain:
                    out = out.withColumn(t, F.lit(None).cast("string"))
            out = out.select(*[F.col(f"`{t}`") for t in titles])
        else:
            out = df.select(*[self.value(e)[0].alias(t) for t, (e, _) in zip(titles, q.returns)])
        order = []
        for e, desc in q.order:
            t = self.title(e, None)
            if t in titles:  # a key that is not projected orders nothing
                c = F.col(f"`{t}`")
                order.append(c.desc_nulls_last() if desc else c.asc_nulls_first())
        if order:
            out = out.orderBy(*order)
        return out.limit(q.limit) if q.limit is not None else out

    def cypher_result(self, q: Query, df: DataFrame) -> DataFrame:
        if len(q.returns) == 1 and isinstance(q.returns[0][0], Agg):
            return df.agg(F.count(F.lit(1)).alias("count"))
        items = [(self.title(e, None), e) for e, _ in q.returns if not isinstance(e, Agg)]

        def shown(e):
            if isinstance(e, Var):
                props = [F.col(f"{e.name}__{c}").alias(camel(c)) for c in self.types if c not in ("id", "label")]
                return F.to_json(F.struct(F.col(f"{e.name}__id").alias("_id"), F.col(f"{e.name}__label").alias("_label"), *props))
            return self.value(e)[0]

        order = []
        for e, desc in q.order:
            c, kind = self.value(e)
            s = F.coalesce(as_text(c, kind) if kind != "string" else c, F.lit(""))
            s = F.when(c.isNull(), "").otherwise(s)
            n = s.try_cast("double")
            for k in (n.isNull(), n, s):
                order.append(k.desc() if desc else k.asc())
        cols = [shown(e).alias(t) for t, e in items]
        if q.distinct:
            text = [F.coalesce(shown(e).cast("string"), F.lit("")).alias(f"__d{i}") for i, (_, e) in enumerate(items)]
            df = df.withColumns({f"__d{i}": c for i, c in enumerate(text)}).dropDuplicates([f"__d{i}" for i in range(len(text))])
        if order:
            df = df.orderBy(*order)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*cols)


def run_query(graph: PropertyGraph, text: str, dialect: str = "cql", compat: bool = True, varlen: bool = False, implicit_grouping: bool = False, promote_overflow: bool = False, cap: int | None = None) -> DataFrame:
    """Run a query of either dialect over a graph.

    compat: behave as the reference where it departs from common sense (unknown types match all edges, nothing leads
    on from an anonymous node). varlen: expand ``*m..n`` instead of taking it as one hop. implicit_grouping: group by
    the items that do not aggregate. promote_overflow: sums of integers are doubles. cap: greatest number of rows.
    """
    q = parse(text, dialect)
    out = Compiler(graph, dialect, compat, varlen, implicit_grouping, promote_overflow).run(q)
    return out.limit(cap) if cap is not None else out


def backend_query(graph: PropertyGraph, text: str, cap: int = ROW_CAP) -> DataFrame:
    """The cypher dialect as the tool surface runs it, with its cap on rows."""
    return run_query(graph, text, "cypher", cap=cap)
