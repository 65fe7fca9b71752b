"""Three-valued rules: NULL is unknown. Applicability, inheritance, access, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators.graphs import paths

DEPTH, OPERANDS = 12, 100


def compile_rule(rule: dict, fact, depth: int = 0) -> Column:
    """A rule tree (all_of, any_of, not, fact, unknown) as a nullable boolean column. SQL's three-valued logic is the rule's own algebra.

    ``fact(name, values)`` gives the nullable column of one fact predicate. Rules that are too deep or too wide are an error.
    """
    if depth > DEPTH:
        raise ValueError(f"a rule may be {DEPTH} levels deep")
    (kind, body), *rest = [(k, v) for k, v in rule.items() if k != "in"]
    if rest:
        raise ValueError("a rule has one operator")
    if kind in ("all_of", "any_of"):
        if not 1 <= len(body) <= OPERANDS:
            raise ValueError(f"an operator takes 1 to {OPERANDS} operands")
        parts = [compile_rule(x, fact, depth + 1) for x in body]
        return reduce(lambda a, b: a & b if kind == "all_of" else a | b, parts)
    if kind == "not":
        return ~compile_rule(body, fact, depth + 1)
    if kind == "fact":
        return fact(body, rule["in"])
    if kind == "unknown":
        return F.lit(None).cast("boolean")
    raise ValueError(f"unknown operator {kind}")


def trace_rule(rule: dict, fact, missing) -> tuple[Column, Column]:
    """(state, names of the facts that are missing): a decisive operand drops the others' lists; otherwise they are joined.

    ``missing(name)`` gives an array column: the name if its fact is unknown.
    """
    state = compile_rule(rule, fact)
    kind = next(k for k in rule if k != "in")
    if kind in ("all_of", "any_of"):
        pairs = [trace_rule(x, fact, missing) for x in rule[kind]]
        decided = reduce(lambda a, b: a | b, [F.coalesce(s == (kind == "any_of"), F.lit(False)) for s, _ in pairs])
        every = F.array_distinct(F.concat(*[m for _, m in pairs]))
        return state, F.when(decided, F.array().cast("array<string>")).otherwise(every)
    if kind == "not":
        return state, trace_rule(rule["not"], fact, missing)[1]
    return state, missing(rule["fact"]) if kind == "fact" else F.array(F.lit("unknown"))


def state_label(state: Column) -> Column:
    return F.when(state.isNull(), "unknown").when(state, "applicable").otherwise("not_applicable")


def fact_predicate(values: Column, complete: Column, evidence: Column, wanted: list) -> Column:
    """A fact without evidence is unknown; a listed value is true; an unlisted one is false only if the list is complete."""
    hit = F.arrays_overlap(values, F.array(*map(F.lit, wanted)))
    return F.when(F.coalesce(evidence, F.lit(0)) == 0, None).when(hit, True).when(complete, False)


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``node, ancestor, distance, cycle``: every node with itself (distance 0) and all its ancestors at any depth, by path doubling; ``cycle``: the ancestor reaches itself, so the pair
    should not be relied on. ``rejected`` names the nodes whose inheritance is wrong."""
    up = paths(edges, child, parent)
    nodes = edges.select(F.col(child).alias("node")).union(edges.select(F.col(parent))).where("node is not null").distinct()
    itself = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    every = itself.unionByName(up).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
    loops = up.where("node = ancestor").select(F.col("node").alias("_loop"))
    return every.join(loops, F.col("ancestor") == F.col("_loop"), "left").select("node", "ancestor", "distance", F.col("_loop").isNotNull().alias("cycle"))


def rejected(nodes: DataFrame, edges: DataFrame, child: str = "child", parent: str = "parent", depth: int = DEPTH) -> DataFrame:
    """``node, problems``: nodes that must not inherit, with the sorted reasons: ``cycle`` (it reaches a cycle), ``depth`` (an ancestor more than ``depth`` steps away) and ``unknown`` (it or an
    ancestor names a parent that isn't in ``nodes``, column node). A node whose parent is rejected for a cycle or an unknown name is rejected too, as its rules would be incomplete."""
    known = nodes.select(F.col("node").alias("_known")).distinct()
    up = closure(edges, child, parent)
    j = up.join(known, F.col("ancestor") == F.col("_known"), "left").join(nodes.select("node").distinct(), "node", "left_semi")
    found = F.array_compact(F.array(F.when(F.bool_or("cycle"), "cycle"), F.when(F.max("distance") > depth, "depth"), F.when(F.bool_or(F.col("_known").isNull()), "unknown")))
    return j.groupBy("node").agg(found.alias("problems")).where(F.size("problems") > 0)


def any_applies(rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    """``keys, state``: one applicable path wins, else unknown if any is unknown, else not applicable."""
    worst = F.when(F.bool_or(F.coalesce(F.col(state), F.lit(False))), True).when(F.count_if(F.col(state).isNull()) > 0, None).otherwise(False)
    return rows.groupBy(*keys).agg(worst.alias("state"), F.count("*").alias("paths"))


def issues(*cases: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order; a null condition counts as holding (unknown isn't fine)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in cases]))


def refine(parents: DataFrame, children: DataFrame) -> DataFrame:
    """``parents``: id, state, hash; ``children``: parent_id, approved, current, holds, parent_hash. A local rule turns its parent off only if it is
    approved, current, its condition holds and the parent is unchanged; a changed parent is an issue."""
    c = children.groupBy("parent_id").agg(
        F.bool_or(F.col("approved") & F.col("current") & F.coalesce("holds", F.lit(False))).alias("off"),
        F.min("parent_hash").alias("parent_hash"),
    )
    j = parents.join(c, F.col("id") == F.col("parent_id"), "left")
    changed = F.coalesce(F.col("parent_hash") != F.col("hash"), F.lit(False))
    return j.select("id", F.when(F.coalesce("off", F.lit(False)) & ~changed, False).otherwise(F.col("state")).alias("state"), changed.alias("parent_changed"))


def accessible(asked: DataFrame, users: DataFrame, grants: DataFrame, ancestors: DataFrame, roles: DataFrame, everything: list[str]) -> DataFrame:
    """``user, node, permissions, visible``: what a user may do on each asked node, as a sorted list, and whether they may see its row.

    ``asked``: user, node, owner (user or null); ``users``: user, kind (staff, expert or plain); ``grants``: user, scope, role; ``roles``: role, permission; ``ancestors``: node, ancestor. A role that
    is granted on a scope holds for the scope and all below it; staff may do ``everything``, experts may read whatever they are asked about. Rows of others are visible to staff and to
    those who may edit only. Asked pairs meet their node's ancestors, then grants by (user, scope): nothing is expanded to all nodes below a scope.
    """
    up = ancestors.select(F.col("node").alias("_n"), F.col("ancestor").alias("scope"))
    by_role = grants.join(roles, "role").groupBy("user", "scope").agg(F.collect_set("permission").alias("_p"))
    met = asked.select("user", "node").distinct().join(up, F.col("node") == F.col("_n")).join(by_role, ["user", "scope"])
    own = met.groupBy("user", "node").agg(F.array_distinct(F.flatten(F.collect_list("_p"))).alias("_own"))
    j = asked.join(users, "user", "left").join(own, ["user", "node"], "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
    given = F.when(F.col("kind") == "staff", F.array(*map(F.lit, everything))).when(F.col("kind") == "expert", F.array_union("_own", F.array(F.lit("read")))).otherwise(F.col("_own"))
    j = j.withColumn("_all", F.array_sort(given))
    visible = (F.col("kind") == "staff") | F.array_contains("_all", "edit") | F.coalesce(F.col("owner") == F.col("user"), F.lit(False))
    return j.select("user", "node", F.array_join("_all", ",").alias("permissions"), F.coalesce(visible, F.lit(False)).alias("visible"))


def without_disabled(items: DataFrame, key: str, disabled: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Items none of whose ancestors (itself included) is disabled. ``disabled``: node."""
    off = ancestors.join(disabled.select(F.col("node").alias("_off")), F.col("ancestor") == F.col("_off"), "left_semi").select(F.col("node").alias("_node")).distinct()
    return items.join(off, F.col(key) == F.col("_node"), "left_anti")
