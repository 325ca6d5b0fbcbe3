"""Parent links to full hierarchies by pointer doubling.

Only nodes that have children take part in the doubling; all others hang on one of them by a single last join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.session import cut_counted

#: Rows of one key that are no burden to one task. Beyond it keys are counted before a join.
TASK_ROWS = 200_000
#: A pointer that more than one in HOT rows share is looked up by broadcast: there are fewer than HOT such pointers.
HOT = 1000


def _look_up(rows: DataFrame, table: DataFrame, n_rows: int) -> DataFrame:
    """rows ⋈ table on ``ptr = t_id``, which is unique in the table.

    A pointer may be shared by a large part of all rows (a flat tree). Of many rows such pointers, fewer than ``HOT`` by count,
    are split off and their rows of the table broadcast; the others are shuffled.
    """
    if n_rows <= TASK_ROWS:
        return rows.join(table, rows.ptr == table.t_id)
    hot = rows.groupBy(F.col("ptr").alias("hot_ptr")).count().where(F.col("count") > n_rows / HOT).select("hot_ptr")
    hot_rows = F.broadcast(table.join(F.broadcast(hot), table.t_id == hot.hot_ptr, "left_semi"))
    usual = rows.join(F.broadcast(hot), rows.ptr == hot.hot_ptr, "left_anti").join(table, F.col("ptr") == F.col("t_id"))
    return usual.unionByName(rows.join(hot_rows, F.col("ptr") == F.col("t_id")))


def _as_table(state: DataFrame, *columns: str) -> DataFrame:
    return state.select(F.col("id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in columns])


def _gathered(links: DataFrame, values: Sequence[str] = (), up: dict[str, Column] | None = None) -> DataFrame:
    """One row per id that is a node's or a node's parent: id, parent (null: none), here (it is a node), asked (it has
    children), the values of the node and, by ``up``, an aggregate of its children's.

    Links from both of their ends meet in one shuffle; each task combines its rows before, so a parent of very many children
    moves one row a task.
    """
    up = up or {}
    known = links.where("id is not null").withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))
    none = lambda c: F.lit(None).cast(known.schema[c].dataType).alias(c)
    own = known.select("id", "parent", F.lit(True).alias("here"), *values, *[none(c).alias(f"_{c}") for c in values])
    above = known.where("parent is not null").select(F.col("parent").alias("id"), none("parent"), F.lit(False).alias("here"), *[none(c) for c in values], *[F.col(c).alias(f"_{c}") for c in values])
    return own.unionByName(above).groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("here").alias("here"), F.min("here").alias("only"), *[F.max(c).alias(c) for c in values], *[c.alias(n) for n, c in up.items()]
    ).withColumn("asked", ~F.col("only")).drop("only")


def _double(state: DataFrame, n: int, carried: Sequence[str]) -> tuple[list[DataFrame], DataFrame, int]:
    """Pointer doubling. state: id, ptr (null at an end), last, depth, kind and carried columns, cut from its lineage; n: how many have a ptr.

    Gives (parts of the resolved state, the unresolved state, how many unresolved). ptr is the node that ``depth`` links lead
    to and ``last`` the one before it. In round k every pointer jumps 2^k links; a node that reaches an end takes over what the
    end carries and leaves the join. An end of kind ``missing`` is no node: ``last`` is the end then. As the ancestors of a
    deep node have all smaller depths, each round resolves nodes until only those are left whose chain never ends, so a round
    without progress ends the loop: logarithmically many rounds in the largest depth.

    Carried columns: ``path`` is concatenated, ``least`` is the smallest id met, others are the end's.
    """
    ended, active = state.where("ptr is null"), state.where("ptr is not null")
    done = [ended]
    others = [c for c in carried if c not in ("path", "least")]
    while n:
        table = active
        for d in done:  # nodes resolved earlier are still looked up: their links end here
            table = table.unionByName(d)
        met = _look_up(active, _as_table(table, "ptr", "last", "depth", "kind", *carried), n)
        gone = F.col("t_kind").eqNullSafe(F.lit("missing"))
        step = met.select(
            "id", F.col("t_ptr").alias("ptr"), F.when(F.col("t_ptr").isNotNull(), F.col("t_last")).otherwise(F.col("last")).alias("last"),
            F.when(gone, F.col("depth") - 1).otherwise(F.col("depth") + F.col("t_depth")).alias("depth"), F.when(gone, "orphaned").otherwise(F.col("t_kind")).alias("kind"),
            *[F.when(gone, F.col("last")).otherwise(F.col("t_root")).alias("root") if c == "root" else F.coalesce(c, f"t_{c}").alias(c) for c in others],
            *([F.when(gone, F.col("path")).otherwise(F.concat("t_path", "path")).alias("path")] if "path" in carried else []),
            *([F.least("least", "t_least").alias("least")] if "least" in carried else []),
        )
        step, left = cut_counted(step, "ptr is not null")
        done.append(step.where("ptr is null"))
        active = step.where("ptr is not null")
        if left == n:
            break
        n = left
    return done, active, n


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _on_cycles(endless: DataFrame, n: int) -> DataFrame:
    """endless: id, parent, ptr (some links on), least (smallest id up to there). Gives the nodes on cycles: id, parent, least
    (of its cycle), pred (the node on the cycle whose parent it is).

    Doubled pointers map all nodes onto fewer and fewer, those on cycles among them. When the parents of an image are as many
    as the image itself, the parent map is one-to-one on it, and it is exactly the nodes on cycles.
    """
    of = ("id", "parent", "ptr", "least")
    part = endless.select(*of)
    while True:
        image = part.select(F.col("ptr").alias("i")).distinct()
        part, n = cut_counted(part.join(image, part.id == image.i, "left_semi").select(*of), "true")
        if part.select("parent").distinct().count() == n:
            break
        met = _look_up(part, _as_table(part, "ptr", "least"), n)
        part = met.select("id", "parent", F.col("t_ptr").alias("ptr"), F.least("least", "t_least").alias("least"))
    while True:  # minima over windows of 2^k links; equal ones all along a cycle are its minimum
        up = _as_table(part, "least")
        if part.join(up, (part.parent == up.t_id) & (part.least != up.t_least)).isEmpty():
            break
        t = _as_table(part, "ptr", "least")
        part, _ = cut_counted(part.join(t, part.ptr == t.t_id).select("id", "parent", F.col("t_ptr").alias("ptr"), F.least("least", "t_least").alias("least")), "true")
    pred = part.select(F.col("parent").alias("p"), F.col("id").alias("pred"))
    return part.join(pred, part.id == pred.p).select("id", "parent", "least", "pred")


def resolve_hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """links: id, parent. One row per id: id, root, depth, kind and, with_path, path.

    Repeated rows count once; of several rows of one id the one with the largest parent does. Rows without an id are dropped. A
    null or negative parent means none. ``rooted``: the chain of
    parents ends at a node without parent. ``orphaned``: it ends at a node whose parent is no node. ``on_cycle``: root is the
    smallest id of the cycle, depth 0. ``below_cycle``: root is that id too, depth the links to the first node on the cycle.
    path: all ids from the root (or the first node on the cycle) to the node. An empty table gives no rows.
    """
    paths = ["path"] if with_path else []
    nodes, (n_above, n_hanging, n_moving) = cut_counted(_gathered(links), "asked", "here and parent is not null", "asked and parent is not null")
    moving = F.col("parent").isNotNull()
    own_path = [F.array("id").alias("path")] if with_path else []
    start = nodes.where("asked").select(
        "id", F.col("parent").alias("ptr"), F.col("id").alias("last"), F.when(moving, 1).otherwise(0).cast("long").alias("depth"),
        F.when(~F.col("here"), "missing").when(~moving, "rooted").alias("kind"), F.when(~moving, F.col("id")).alias("root"), *own_path, F.least("id", "parent").alias("least"),
    )
    done, endless, n_endless = _double(start, n_moving, ["root", *paths, "least"])
    known = _all(done).select("id", "root", "depth", "kind", *paths, F.lit(None).cast("long").alias("pred"))
    if n_endless:
        parents = nodes.where("asked and parent is not null").select(F.col("id").alias("c"), "parent")
        turning, _ = cut_counted(endless.join(parents, endless.id == parents.c).select("id", "parent", "ptr", "least"), "true")
        on, _ = cut_counted(_on_cycles(turning, n_endless).select(F.col("id").alias("c"), "least", "pred"), "true")
        marked, n_below = cut_counted(
            turning.drop("least").join(on, turning.id == on.c, "left").select(
                "id", F.when(F.col("c").isNull(), F.col("parent")).alias("ptr"), F.col("id").alias("last"), F.when(F.col("c").isNull(), 1).otherwise(0).cast("long").alias("depth"),
                F.when(F.col("c").isNotNull(), "below_cycle").alias("kind"), F.col("least").alias("root"), "pred", *own_path,
            ),
            "ptr is not null",
        )
        below, _, _ = _double(marked, n_below, ["root", "pred", *paths])
        own_pred = F.when(F.col("depth") == 0, F.col("pred")).alias("pred")  # of the node on the cycle itself
        known = known.unionByName(_all(below).select("id", "root", "depth", "kind", *paths, own_pred))
    alone = nodes.where("here and parent is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("rooted").alias("kind"), *own_path)
    if not n_above:
        return alone
    hanging = _look_up(nodes.where("here and parent is not null").select("id", F.col("parent").alias("ptr")), _as_table(known, "root", "depth", "kind", "pred", *paths), n_hanging)
    gone, turn = F.col("t_kind") == "missing", F.col("t_pred").eqNullSafe(F.col("id"))
    first = gone | turn
    below = hanging.select(
        "id", F.when(gone, F.col("id")).otherwise(F.col("t_root")).alias("root"), F.when(first, F.lit(0)).otherwise(F.col("t_depth") + 1).cast("long").alias("depth"),
        F.when(gone, "orphaned").when(turn, "on_cycle").otherwise(F.col("t_kind")).alias("kind"),
        *([F.when(first, F.array("id")).otherwise(F.concat("t_path", F.array("id"))).alias("path")] if with_path else []),
    )
    return alone.unionByName(below)


def descendants(resolved: DataFrame) -> DataFrame:
    """All pairs (ancestor, id, distance), a node itself left out, from resolved hierarchies with paths.

    The pairs are written out of each node's own path: no join, and a node of very many descendants is spread over the tasks
    of its descendants.
    """
    pairs = resolved.select("id", "depth", F.posexplode("path").alias("at", "ancestor"))
    return pairs.where("ancestor != id").select("ancestor", "id", (F.col("depth") - F.col("at")).cast("long").alias("distance"))


AGGREGATES = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b))}


def fold_below(links: DataFrame, values: dict[str, str]) -> DataFrame:
    """links: id (unique), parent and values. Per node whose chain of parents ends: id, its values, and ``below_<value>``, the
    aggregate (``min``, ``max`` or ``sum``) of that value over all nodes below it, null without any.

    Doubling again: a node that knows its subtree down to 2^k links hands it to the node 2^k links up, so both know 2^(k+1);
    distances never overlap, so sums are right too. What is handed up is aggregated per receiver before the shuffle. Only
    nodes with children take part: each begins with its children's aggregate. Work grows with the nodes and the logarithm of
    the depth, never with the pairs of ancestors and descendants. Nodes on or below cycles are left out.
    """
    names = list(values)
    merged = {n: AGGREGATES[values[n]] for n in names}
    gathered = _gathered(links, names, {f"below_{n}": merged[n][0](f"_{n}") for n in names})
    nodes, (n_moving, n_leaves) = cut_counted(gathered, "asked and here and parent is not null", "here and not asked and parent is not null")
    belows = [f"below_{n}" for n in names]
    known = nodes.where("asked and here").select(F.col("id").alias("k"))
    # a parent that is no node ends the chain like none
    state, n = cut_counted(
        nodes.where("asked and here").join(known, F.col("parent") == F.col("k"), "left").select("id", F.col("k").alias("ptr"), *belows)
        if n_moving <= TASK_ROWS
        else _look_up(nodes.where("asked and here").select("id", F.col("parent").alias("ptr"), *belows).where("ptr is not null"), nodes.where("asked").select(F.col("id").alias("t_id"), "here"), n_moving)
        .select("id", F.when(F.col("here"), F.col("ptr")).alias("ptr"), *belows)
        .unionByName(nodes.where("asked and here and parent is null").select("id", F.col("parent").alias("ptr"), *belows)),
        "ptr is not null",
    )
    while n:
        handed = state.where("ptr is not null").groupBy(F.col("ptr").alias("to")).agg(*[merged[m][0](f"below_{m}").alias(f"_{m}") for m in names])
        jumped = _look_up(state.where("ptr is not null").select("id", "ptr"), _as_table(state, "ptr"), n).select(F.col("id").alias("j"), F.col("t_ptr").alias("ptr"))
        grown = state.drop("ptr").join(handed, F.col("id") == F.col("to"), "left").join(jumped, F.col("id") == F.col("j"), "left")
        state, left = cut_counted(grown.select("id", "ptr", *[merged[m][1](F.col(f"below_{m}"), F.col(f"_{m}")).alias(f"below_{m}") for m in names]), "ptr is not null")
        if left == n:
            break
        n = left
    inner = state.where("ptr is null").select(F.col("id").alias("i"), *belows)
    out = nodes.where("here and not asked").select("id", "parent", *names, *[F.lit(None).cast(state.schema[b].dataType).alias(b) for b in belows])
    if n:  # leaves of endless chains go as well
        ends = state.where("ptr is not null").select(F.col("id").alias("t_id"))
        lost = _look_up(out.where("parent is not null").select("id", F.col("parent").alias("ptr")), ends, n_leaves).select(F.col("id").alias("x"))
        out = out.join(lost, F.col("id") == F.col("x"), "left_anti")
    return out.drop("parent").unionByName(nodes.drop(*belows).join(inner, F.col("id") == F.col("i")).select("id", *names, *belows))


def carry_down(links: DataFrame, value: str) -> DataFrame:
    """links: id (unique), parent, value. Per node: id and its value or, where null, that of the nearest node above that has one.

    Pointer doubling over the nodes with children, ended by nodes with a value; what an end carries is taken over.
    """
    nodes, (n_moving, n_hanging) = cut_counted(_gathered(links, [value]), f"asked and parent is not null and `{value}` is null", f"here and parent is not null and `{value}` is null")
    own = F.col(value)
    ptr = F.when(own.isNull(), F.col("parent"))
    start = nodes.where("asked").select("id", ptr.alias("ptr"), F.col("id").alias("last"), F.lit(1).cast("long").alias("depth"), F.lit(None).cast("string").alias("kind"), own)
    done, endless, _ = _double(start, n_moving, [value])
    known = _all(done).select("id", value).unionByName(endless.select("id", F.lit(None).cast(nodes.schema[value].dataType).alias(value)))
    met = _look_up(nodes.where("here").where(ptr.isNotNull()).select("id", ptr.alias("ptr")), _as_table(known, value), n_hanging)
    return nodes.where("here").where(ptr.isNull()).select("id", value).unionByName(met.select("id", F.col(f"t_{value}").alias(value)))
