"""Replay of the deploy/rollback log as a segmented scan.

An event changes the pair (active, last different) of its service: a deploy of another
checkpoint makes it active and keeps the one before, a rollback swaps the two. Each event, and each stretch of
events, is an ``effect``: a struct that says what becomes of an unknown pair. Effects
compose associatively, so the scan goes up a tree - 256 events make one effect, 256 of those the next - and
down again with the pair each stretch starts from. No step looks at more than 256 siblings, however
many events one service has, and all of it runs on the JVM.

An effect is one of three things:

* no deploy yet (``first`` is null): the incoming pair, swapped or not;
* one slot known: the first deploy met the incoming pair (perhaps ``swapped``), the slot ``known`` is the active one or
  not (``known_active``), and the other slot holds what came in, unless ``changed`` names something else for it;
* both slots known (``both``): ``active`` and ``other``, whatever came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import with_position
from pairloom.session import write_once

# Siblings that one aggregate folds, as a power of two.
_FAN_BITS = 8

_PAIR = "struct<active:string,other:string>"
EFFECT = (
    "struct<swapped:boolean,first:string,known:string,known_active:boolean,"
    "changed:map<string,string>,both:boolean,active:string,other:string>"
)


def _effect(swapped, first, known, known_active, changed, both, active, other) -> Column:
    named = dict(
        swapped=swapped, first=first, known=known, known_active=known_active, changed=changed, both=both, active=active, other=other
    )
    return F.struct(*[c.alias(name) for name, c in named.items()]).cast(EFFECT)


def _no_changes() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def _nothing() -> Column:
    none, no = F.lit(None).cast("string"), F.lit(False)
    return _effect(no, none, none, no, _no_changes(), no, none, none)


def event_effect(action: Column, checkpoint: Column) -> Column:
    """Effect of one event: a deploy of ``checkpoint``, a rollback, or nothing for any other action."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    deployed = F.when(action == "deploy", checkpoint)
    swapped = F.coalesce(action == "rollback", no)
    return _effect(swapped, deployed, deployed, deployed.isNotNull(), _no_changes(), no, none, none)


def _replaced(changed: Column, value: Column) -> Column:
    return F.coalesce(F.try_element_at(changed, value), value)


def after(effect: Column, active: Column, other: Column) -> Column:
    """The pair (active, other) after an effect."""
    e = effect
    front, back = F.when(e["swapped"], other).otherwise(active), F.when(e["swapped"], active).otherwise(other)
    kept = _replaced(e["changed"], F.when(front == e["first"], back).otherwise(front))
    known_first = e["known_active"]
    return (
        F.when(e["both"], F.struct(e["active"].alias("active"), e["other"].alias("other")))
        .when(e["first"].isNull(), F.struct(front.alias("active"), back.alias("other")))
        .otherwise(
            F.struct(
                F.when(known_first, e["known"]).otherwise(kept).alias("active"),
                F.when(known_first, kept).otherwise(e["known"]).alias("other"),
            )
        )
        .cast(_PAIR)
    )


def then(one: Column, two: Column) -> Column:
    """The effect of ``one`` followed by ``two``."""
    none = F.lit(None).cast("string")
    # Both slots known after the first: the second acts on them.
    fixed = after(two, one["active"], one["other"])
    # Where the known slot is what the second effect's first deploy meets.
    meets_known = one["known_active"] != two["swapped"]
    settled = _replaced(two["changed"], one["known"])
    # The unknown slot, first against that deploy, then through the changes of the second effect.
    turned = F.transform_values(one["changed"], lambda _, v: F.when(v == two["first"], one["known"]).otherwise(v))
    missing = F.map_filter(
        F.map_from_arrays(F.array(two["first"]), F.array(one["known"])), lambda k, _: ~F.map_contains_key(one["changed"], k)
    )
    met = F.when(meets_known, one["changed"]).otherwise(F.map_concat(turned, missing))
    passed = F.transform_values(met, lambda _, v: _replaced(two["changed"], v))
    more = F.map_filter(two["changed"], lambda k, _: ~F.map_contains_key(met, k))
    no_changes, both = _no_changes(), F.lit(True)
    return (
        F.when(two["both"], two)
        .when(one["both"], _effect(F.lit(False), none, none, F.lit(False), no_changes, both, fixed["active"], fixed["other"]))
        .when(
            one["first"].isNull(),
            _effect(
                one["swapped"] != two["swapped"], two["first"], two["known"], two["known_active"],
                two["changed"], F.lit(False), none, none,
            ),
        )
        .when(
            two["first"].isNull(),
            _effect(
                one["swapped"], one["first"], one["known"], one["known_active"] != two["swapped"],
                one["changed"], F.lit(False), none, none,
            ),
        )
        .when(
            meets_known & (two["first"] != one["known"]),
            _effect(
                F.lit(False), none, none, F.lit(False), no_changes, both,
                F.when(two["known_active"], two["known"]).otherwise(settled),
                F.when(two["known_active"], settled).otherwise(two["known"]),
            ),
        )
        .otherwise(
            _effect(
                one["swapped"], one["first"], two["known"], two["known_active"],
                F.map_concat(passed, more), F.lit(False), none, none,
            )
        )
    )


def folded(effects: Column) -> Column:
    """One effect for an array of them, in order."""
    return F.aggregate(effects, _nothing(), then)


def pairs_before(effects: Column, start: Column) -> Column:
    """For each effect of an array the pair it meets, when the first meets ``start``."""
    empty = F.expr(f"cast(array() as array<{_PAIR}>)")
    state = F.struct(start.cast(_PAIR).alias("now"), empty.alias("seen"))

    def move(s: Column, effect: Column) -> Column:
        return F.struct(
            after(effect, s["now"]["active"], s["now"]["other"]).alias("now"),
            F.concat(s["seen"], F.array(s["now"])).alias("seen"),
        )

    return F.aggregate(effects, state, move, lambda s: s["seen"])


def pairs_around(events: Column, start: Column) -> Column:
    """The pair before each event of an array, and one more: the pair after the last."""
    first = start.cast(_PAIR)
    state = F.struct(first.alias("now"), F.array(first).alias("seen"))

    def move(s: Column, event: Column) -> Column:
        action, checkpoint = event["row"]["action"], event["row"]["checkpoint_id"]
        active, other = s["now"]["active"], s["now"]["other"]
        now = (
            F.when(action == "rollback", F.struct(other.alias("active"), active.alias("other")))
            .when((action == "deploy") & (checkpoint != active), F.struct(checkpoint.alias("active"), active.alias("other")))
            .otherwise(s["now"])
            .cast(_PAIR)
        )
        return F.struct(now.alias("now"), F.concat(s["seen"], F.array(now)).alias("seen"))

    return F.aggregate(events, state, move, lambda s: s["seen"])


def _in_order(numbered: Column, number: str) -> Column:
    """The structs of an array by a number that no two share."""

    def compared(a: Column, b: Column) -> Column:
        return F.when(a[number] < b[number], -1).when(a[number] > b[number], 1).otherwise(0)

    return F.array_sort(numbered, compared)


def scan(events: DataFrame, key: str, order: list[str], start: tuple[str, str]) -> DataFrame:
    """Each event with the pair it meets (``active_before``, ``other_before``) and leaves (``active_after``, ``other_after``).

    Events have an ``action`` and a ``checkpoint_id``; ``start`` is the pair every ``key`` starts with.
    Rows of one key are taken in the given order.
    """
    placed = with_position(events, [key, *order], "_position")
    stretch = F.shiftright("_position", _FAN_BITS).alias("_stretch")
    rows = F.collect_list(F.struct("_position", F.struct(*events.columns).alias("row")))
    grouped = placed.groupBy(F.col(key).alias("_key"), stretch).agg(_in_order(rows, "_position").alias("_rows"))
    effects = F.transform("_rows", lambda r: event_effect(r["row"]["action"], r["row"]["checkpoint_id"]))
    leaves = write_once(grouped.withColumn("_effect", folded(effects)), "stretches")

    # Up: each level has fewer stretches, until every key has one.
    levels = [leaves]
    top = leaves.agg(F.max("_stretch")).first()[0] or 0
    while top:
        children = F.collect_list(F.struct("_stretch", "_effect"))
        parent = F.shiftright("_stretch", _FAN_BITS).alias("_parent")
        parents = levels[-1].groupBy("_key", parent).agg(_in_order(children, "_stretch").alias("_rows"))
        parents = parents.withColumn("_effect", folded(F.col("_rows._effect")))
        levels.append(write_once(parents.withColumnRenamed("_parent", "_stretch"), "stretches"))
        top >>= _FAN_BITS
    # Down: what each stretch starts from.
    first = F.struct(F.lit(start[0]).alias("active"), F.lit(start[1]).alias("other"))
    starts = levels[-1].select("_key", "_stretch", first.alias("_start"))
    for level in reversed(levels[1:]):
        met = _matched(level, starts).withColumn("_pairs", pairs_before(F.col("_rows._effect"), F.col("_start")))
        each = met.select("_key", F.explode(F.arrays_zip(F.col("_rows._stretch").alias("s"), F.col("_pairs").alias("p"))).alias("_e"))
        starts = each.select("_key", F.col("_e.s").alias("_stretch"), F.col("_e.p").alias("_start"))
    met = _matched(leaves, starts).withColumn("_pairs", pairs_around(F.col("_rows"), F.col("_start")))
    following = F.slice("_pairs", F.lit(2), F.size("_rows"))
    each = met.select(F.explode(F.arrays_zip(F.col("_rows.row").alias("row"), F.col("_pairs").alias("p"), following.alias("q"))).alias("_e"))
    # One pair more than rows: the last has no row.
    return each.filter(F.col("_e.q").isNotNull()).select(
        *[F.col(f"_e.row.{c}").alias(c) for c in events.columns],
        F.col("_e.p.active").alias("active_before"), F.col("_e.p.other").alias("other_before"),
        F.col("_e.q.active").alias("active_after"), F.col("_e.q.other").alias("other_after"),
    )


def _matched(level: DataFrame, starts: DataFrame) -> DataFrame:
    """Stretches with the pair they start from."""
    named = starts.withColumnsRenamed({"_key": "_k", "_stretch": "_s"})
    # A null key is a key like others.
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_s"))
    return level.join(named, same)
