"""XPath over the node relation: each axis is a join of nested-set intervals within a page, each predicate a condition.

A path is parsed into steps and compiled to joins from context nodes to the nodes that an axis reaches: child, parent
and sibling axes join by equality, ancestors and descendants by intervals. Paths inside predicates are compiled the same
way, from the candidates, and come back as flags. What is outside this language raises a ValueError.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import subtree_text

TOKEN = re.compile(r"""\s*(?:(?P<str>"[^"]*"|'[^']*')|(?P<num>\d+(?:\.\d+)?)|(?P<op>//|::|\.\.|!=|<=|>=|[/\[\]()@,=<>.*+-])|(?P<name>[A-Za-z_][\w-]*))""")
#: Where an axis leads from a context node (columns with __) to nodes of the same page.
AXES = {
    "child": "parent = __pre", "parent": "pre = __parent", "self": "pre = __pre",
    "descendant": "pre > __pre AND pre <= __post", "descendant-or-self": "pre >= __pre AND pre <= __post",
    "ancestor": "pre < __pre AND post >= __post", "ancestor-or-self": "pre <= __pre AND post >= __post",
    "following-sibling": "parent = __parent AND pre > __pre", "preceding-sibling": "parent = __parent AND pre < __pre",
    "following": "pre > __post", "preceding": "post < __pre",
}
REVERSE = {"parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}
COMPARISONS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}


class _Parser:
    """A path as (absolute, steps), a step as (axis, test, predicates); expressions as tuples that begin with their kind."""

    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        at, text = 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                self._fail()
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def _fail(self):
        raise ValueError(f"not understood: {self.text!r}")

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else None

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if found is None or wanted and found not in wanted:
            self._fail()
        self.at += 1
        return found

    def path(self) -> tuple:
        absolute, steps = self.peek() in ("/", "//"), []
        if absolute and self.take() == "//":
            steps.append(("descendant-or-self", "node()", []))
        steps.append(self.step())
        while self.peek() in ("/", "//"):
            if self.take() == "//":
                steps.append(("descendant-or-self", "node()", []))
            steps.append(self.step())
        if any(s[0] in ("attribute", "text") for s in steps[:-1]):
            self._fail()  # nothing lies below an attribute or a text
        return "path", absolute, steps

    def step(self) -> tuple:
        if self.peek() == "..":
            self.take()
            return "parent", "node()", []
        if self.peek() == ".":
            self.take()
            return "self", "node()", []
        axis = "child"
        if self.peek() == "@":
            self.take()
            axis = "attribute"
        elif self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis not in AXES and axis != "attribute":
                self._fail()
        kind, test = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" and test != "*":
            self._fail()
        self.at += 1
        if test in ("text", "node") and self.peek() == "(":
            self.take("(")
            self.take(")")
            test += "()"
        if test == "text()":
            if axis != "child":
                self._fail()
            axis = "text"
        predicates = []
        while self.peek() == "[":
            self.take("[")
            predicates.append(self.either())
            self.take("]")
        if predicates and axis in ("attribute", "text") or axis == "attribute" and test == "node()":
            self._fail()
        return axis, test.lower() if kind == "name" else test, predicates

    def either(self) -> tuple:
        found = self.both()
        while self.peek() == "or":
            self.take()
            found = ("or", found, self.both())
        return found

    def both(self) -> tuple:
        found = self.compared()
        while self.peek() == "and":
            self.take()
            found = ("and", found, self.compared())
        return found

    def compared(self) -> tuple:
        left = self.sum()
        if self.peek() in COMPARISONS:
            return "compare", self.take(), left, self.sum()
        return left

    def sum(self) -> tuple:
        found = self.value()
        while self.peek() in ("+", "-"):
            found = ("sum", self.take(), found, self.value())
        return found

    def value(self) -> tuple:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind == "str":
            self.take()
            return "str", text[1:-1]
        if kind == "num":
            self.take()
            return "num", float(text)
        if text == "(":
            self.take()
            found = self.either()
            self.take(")")
            return found
        if kind == "name" and self.peek(1) == "(" and text not in ("text", "node"):
            self.take()
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.either())
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            arity = {"position": 0, "last": 0, "not": 1, "count": 1, "contains": 2, "starts-with": 2, "string-length": 1, "normalize-space": 1}
            if arity.get(text) != len(args) or text == "count" and args[0][0] != "path":
                self._fail()
            return "call", text, args
        return self.path()

    def whole(self) -> tuple:
        found = self.path()
        if self.at < len(self.tokens):
            self._fail()
        return found


class _Compiler:
    def __init__(self, all_nodes: DataFrame, key: str):
        self.key, self.columns = key, [c for c in all_nodes.columns if c != key]
        self.nodes, self.flags = all_nodes, 0

    def root(self) -> DataFrame:
        """Above each page's nodes, a node that holds them all."""
        return self.nodes.select(self.key).distinct().select(self.key, F.lit(-1).alias("__o"), F.lit(-1).alias("pre"), F.lit(2**31 - 1).alias("post"), F.lit(-2).alias("parent"))

    def steps(self, context: DataFrame, steps: list) -> DataFrame:
        """context: key, __o (where a path began), pre, post, parent. The nodes that the path reaches, once for each __o, or their values."""
        for axis, test, predicates in steps:
            held = context.select(F.col(self.key).alias("__k"), "__o", *[F.col(c).alias(f"__{c}") for c in ("pre", "post", "parent")])
            if axis == "attribute":
                own = self.nodes.join(held, (F.col(self.key) == F.col("__k")) & (F.col("pre") == F.col("__pre")))
                values = F.map_values("attrs") if test == "*" else F.array(F.element_at("attrs", F.lit(test)))
                return own.select(self.key, "__o", "pre", F.lit(0).alias("turn"), F.explode(F.filter(values, lambda v: v.isNotNull())).alias("value"))
            if axis == "text":
                both = self.nodes.join(held, (F.col(self.key) == F.col("__k")) & (F.col("pre") == F.col("__pre"))).select(self.key, "__o", "pre", F.lit(-1).alias("turn"), F.col("own_text").alias("value"))
                tails = self.nodes.join(held, (F.col(self.key) == F.col("__k")) & (F.col("parent") == F.col("__pre"))).select(self.key, "__o", F.col("__pre").alias("pre"), F.col("pre").alias("turn"), F.col("tail_text").alias("value"))
                return both.union(tails).where("value <> ''")
            tested = F.col("tag") != "#text" if test in ("*", "node()") else F.col("tag") == test
            near = self.nodes.where(tested).join(held, (F.col(self.key) == F.col("__k")) & F.expr(AXES[axis])).drop("__k")
            if test == "node()" and axis in ("self", "descendant-or-self", "ancestor-or-self", "ancestor", "parent"):  # the root is a node too
                tops = context.where("pre = -1") if axis in ("self", "descendant-or-self") else context.select(self.key, "__o").distinct().join(self.root().drop("__o"), self.key).where(F.lit(axis != "self"))
                if axis == "parent":
                    tops = context.where("parent = -1").select(self.key, "__o").distinct().join(self.root().drop("__o"), self.key)
                if not predicates:
                    near = near.unionByName(tops.select(self.key, "__o", "pre", "post", "parent"), allowMissingColumns=True)
            for predicate in predicates:
                near = self.kept(near, axis, predicate)
            context = near.dropDuplicates([self.key, "__o", "pre"]).select(self.key, *self.columns, "__o")
        return context

    def kept(self, near: DataFrame, axis: str, predicate: tuple) -> DataFrame:
        group = Window.partitionBy(self.key, "__o", "__pre")
        order = group.orderBy(F.desc("pre") if axis in REVERSE else F.asc("pre"))
        if self.uses(predicate, ("position", "last")) or predicate[0] in ("num", "sum"):
            near = near.withColumn("__position", F.row_number().over(order)).withColumn("__last", F.count(F.lit(1)).over(group))
        near, found = self.value(near, predicate)
        number = predicate[0] in ("num", "sum") or predicate[:2] in (("call", "last"), ("call", "position"), ("call", "count"), ("call", "string-length"))
        keep = F.col("__position") == found if number else self.truth(predicate, found)
        return near.where(F.coalesce(keep, F.lit(False))).select(self.key, *self.columns, *[c for c in near.columns if c in ("__o", "__pre", "__post", "__parent")])

    def uses(self, expression, names: tuple) -> bool:
        """Whether an expression calls one of these functions, outside paths, which have positions of their own."""
        if not isinstance(expression, (tuple, list)) or expression and expression[0] == "path":
            return False
        return expression[:1] == ("call",) and expression[1] in names or any(self.uses(e, names) for e in expression)

    def truth(self, expression: tuple, value: Column) -> Column:
        if expression[0] == "path":
            return F.size(value) > 0
        if expression[0] == "str":
            return value != ""
        return value

    def value(self, near: DataFrame, e: tuple) -> tuple[DataFrame, Column]:
        """near with what the expression needs, and its value: a boolean, a number, a string, or an array of strings for a path."""
        kind = e[0]
        if kind in ("str", "num"):
            return near, F.lit(e[1])
        if kind in ("or", "and"):
            near, a = self.value(near, e[1])
            near, b = self.value(near, e[2])
            a, b = (F.coalesce(self.truth(x, v), F.lit(False)) for x, v in ((e[1], a), (e[2], b)))
            return near, a | b if kind == "or" else a & b
        if kind == "sum":
            near, a = self.value(near, e[2])
            near, b = self.value(near, e[3])
            return near, a + b if e[1] == "+" else a - b
        if kind == "path":
            return self.path_values(near, e)
        if kind == "compare":
            near, a = self.value(near, e[2])
            near, b = self.value(near, e[3])
            numeric = any(x[0] in ("num", "sum") or x[:1] == ("call",) and x[1] in ("position", "last", "count", "string-length") for x in (e[2], e[3]))
            cast = lambda c: c.try_cast("double") if numeric else c
            test = lambda x, y: getattr(cast(x), COMPARISONS[e[1]])(cast(y))
            if e[2][0] == "path" and e[3][0] == "path":
                return near, F.exists(a, lambda x: F.exists(b, lambda y: test(x, y)))
            if e[2][0] == "path":
                return near, F.exists(a, lambda x: test(x, b))
            return near, F.exists(b, lambda y: test(a, y)) if e[3][0] == "path" else test(a, b)
        name, args = e[1], e[2]
        if name in ("position", "last"):
            return near, F.col(f"__{name}")
        near, found = self.value(near, args[0])
        if name == "not":
            return near, ~F.coalesce(self.truth(args[0], found), F.lit(False))
        if name == "count":
            return near, F.size(found)
        text = lambda x, v: F.coalesce(F.get(v, F.lit(0)), F.lit("")) if x[0] == "path" else v.cast("string")
        first = text(args[0], found)
        if name == "string-length":
            return near, F.length(first)
        if name == "normalize-space":
            return near, F.trim(F.regexp_replace(first, r"\s+", " "))
        near, second = self.value(near, args[1])
        return near, (F.contains if name == "contains" else F.startswith)(first, text(args[1], second))

    def path_values(self, near: DataFrame, path: tuple) -> tuple[DataFrame, Column]:
        """Strings of what a path reaches from each candidate, in document order: attributes, texts, or whole texts of elements, trimmed."""
        self.flags += 1
        name = f"__v{self.flags}"
        origin = near.select(self.key, F.col("pre").alias("__o"), "pre", "post", "parent").dropDuplicates([self.key, "pre"])
        if path[1]:  # from the root, whatever the candidate
            origin = origin.select(self.key, "__o").join(self.root().drop("__o"), self.key)
        found = self.steps(origin, path[2])
        if "value" not in found.columns:
            texts = subtree_text(self.nodes, self.key, found.select(self.key, "pre").distinct()).select(F.col(self.key).alias("__k"), F.col("pre").alias("__p"), "text")
            found = found.join(texts, (F.col(self.key) == F.col("__k")) & (F.col("pre") == F.col("__p")), "left").select(self.key, "__o", "pre", F.lit(0).alias("turn"), F.coalesce("text", F.lit("")).alias("value"))
        lists = found.groupBy(self.key, "__o").agg(F.array_sort(F.collect_list(F.struct("pre", "turn", "value"))).alias("all"))
        lists = lists.select(F.col(self.key).alias("__k"), F.col("__o").alias("__of"), F.transform("all", lambda x: x["value"]).alias(name))
        joined = near.join(lists, (F.col(self.key) == F.col("__k")) & (F.col("pre") == F.col("__of")), "left").drop("__k", "__of")
        return joined, F.coalesce(name, F.array().cast("array<string>"))


def xpath(all_nodes: DataFrame, path: str, key: str = "page_id") -> DataFrame:
    """The nodes that a path names, or where it ends in an attribute or text(): key, pre, turn and value, in document order by these.

    Axes: child, parent, self, descendant, ancestor (and -or-self), following, preceding, following-sibling,
    preceding-sibling, and attribute at the end; tests: names, *, node(), text() at the end; predicates: positions,
    comparisons, and / or / not(), count(), contains(), starts-with(), normalize-space(), string-length(), and paths.
    Alternatives are parted by |. An element's string is its whole text, trimmed. Paths begin at the page.
    """
    parts = [p for p in re.split(r"""\|(?=(?:[^'"]|'[^']*'|"[^"]*")*$)""", path)]
    found = []
    for part in parts:
        parsed = _Parser(part).whole()
        compiler = _Compiler(all_nodes, key)
        found.append(compiler.steps(compiler.root(), parsed[2]).drop("__o"))
    if len({tuple(f.columns) for f in found}) > 1:
        raise ValueError(f"not understood: elements and values in {path!r}")
    whole = reduce(DataFrame.unionByName, found).where("pre >= 0")
    return whole.dropDuplicates([key, "pre", *(["turn", "value"] if "value" in whole.columns else [])])
