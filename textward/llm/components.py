"""Links between candidates that share a bucket, and connected components, as DataFrame operations.

No step gathers a bucket or a component in one task: minima and counts are
aggregated before the shuffle, and joins on a hot key can be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textward.session import Scratch

#: Candidate pairs per candidate that are compared at once to finish small leftovers.
LEFTOVER = 2
#: Members of a bucket whose pairs are compared at once.
SMALL = 32


def _written(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The edges (u, v) as written, and their number and checksum, taken while they were."""
    seen = Observation()
    out = scratch.write(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every end of `edges` (a, b); component is the smallest id reachable.

    Large-star and small-star steps in turn, until no edge changes: then every id
    hangs directly on its component's smallest id.
    """
    now, state = _written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), scratch, f"{name}-0")
    k = 0
    while state[0]:
        k += 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        after, found = _written(small, scratch, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        scratch.sweep()
        now = after
        if found == state:
            break
        state = found
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def link_by_middle(buckets: DataFrame, alike: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], scratch: Scratch, settle: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """As `link`, of buckets (key, id, score, marks), in few steps.

    The middle of a bucket is the member of the largest score, how many others its
    member shares buckets with: of copies of one text, the one that the others vary.
    All members are compared with it. Of what then holds several components, buckets
    of at most `SMALL` members are compared by pairs. In both steps `alike`, a
    condition on the names of two structs `marks`, tells within the join which
    pairs are compared at all. The members (id, c) of larger buckets, with their
    components, go to `settle` with the links so far; it returns all links.
    """
    best = F.max(F.struct("score", (-F.col("id")).alias("m"), "marks")).alias("p")
    middle = buckets.groupBy("key").agg(best).select("key", (-F.col("p.m")).alias("p"), F.col("p.marks").alias("others"))
    met = buckets.join(middle, "key").where((F.col("id") != F.col("p")) & alike("marks", "others"))
    tested = scratch.write(met.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct(), "pairs-1")
    scratch.sweep()
    links = scratch.write(verify(tested), "links-1")
    scratch.sweep()
    opened, rows = _open(buckets, links, scratch, "step-1", largest=False)
    if not rows:
        return links
    small = opened.where(F.col("members") <= SMALL)
    one = small.select("key", F.col("id").alias("a"), "c", "marks")
    two = small.select("key", F.col("id").alias("b"), F.col("c").alias("d"), F.col("marks").alias("others"))
    met = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & alike("marks", "others"))
    rest = scratch.write(met.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs-2")
    scratch.sweep()
    links = links.union(scratch.write(verify(rest), "links-2"))
    large = scratch.write(opened.where(F.col("members") > SMALL).select("id", "c").distinct(), "large")
    for name in ("pairs-1", "pairs-2", "step-1-open"):
        scratch.drop(name)
    scratch.sweep()
    return settle(large, links) if large.take(1) else links


def link_by_prefix(prefixes: DataFrame, links: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """The links and all others between sets of different components, whose Jaccard similarity is 0.75 or more.

    `prefixes` has key, id, c, n and pos: of each set of n elements those that a set
    alike enough may have as the first in common, in one order of all elements, and
    their place there from 1. What follows the first common element bounds what two
    sets share, so few pairs but links are rows. The member with the least before a
    key is compared first: of sets with a common part, the one with the least besides.
    """
    best = F.min(F.struct("pos", "n", "id", "c")).alias("p")
    pivot = prefixes.groupBy("key").agg(best).select("key", F.col("p.id").alias("a"), F.col("p.c").alias("d"), F.col("p.n").alias("m"), F.col("p.pos").alias("at"))
    pairs = prefixes.join(pivot, "key").where(_may_share()).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    tested = scratch.write(pairs, "near-1")
    links = links.union(scratch.write(verify(tested), "found-1"))
    scratch.sweep()
    opened, rows = _open(prefixes, links, scratch, "prefix-1")
    if not rows:
        return links
    one = opened.where("c != main").select("key", F.col("id").alias("a"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("pos").alias("at"), "main")
    # A pair outside the largest component meets once, others from outside.
    met = opened.drop("main", "members").join(one, (opened["key"] == one["key"]) & _may_share() & ((opened["c"] == one["main"]) | (F.col("a") < F.col("id"))))
    pairs = met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    pairs = scratch.write(pairs, "near-2")
    scratch.drop("prefix-1-open")
    scratch.sweep()
    return links.union(scratch.write(verify(pairs), "found-2"))


def _may_share() -> Column:
    """Whether (id, c, n, pos) and (a, d, m, at) with a common key are of different components and may be alike enough."""
    return (F.col("c") != F.col("d")) & (7 * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) + 7 >= 3 * (F.col("n") + F.col("m")))


def _open(rows: DataFrame, links: DataFrame, scratch: Scratch, name: str, largest: bool = True) -> tuple[DataFrame, int]:
    """The rows of the buckets of several components c, with `main`, the largest there or else any, and their `members`; and how many rows they are."""
    comp = components(links, scratch, name)
    rows = rows.drop("c", "main", "members").join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    if largest:
        sizes = rows.groupBy("key", "c").agg(F.count("*").alias("s"))
        mixed = sizes.groupBy("key").agg(F.max(F.struct("s", "c")).alias("m"), F.sum("s").alias("n"), F.count("*").alias("k")).where("k > 1").select("key", F.col("m.c").alias("main"), "n")
    else:
        mixed = rows.groupBy("key").agg(F.min("c").alias("main"), F.max("c").alias("other"), F.count("*").alias("n")).where("main != other")
    seen = Observation()
    mixed = mixed.select("key", "main", "n").observe(seen, F.sum("n").alias("rows"))
    mixed = scratch.write(mixed.select("key", "main", F.col("n").alias("members")), f"{name}-mixed")
    scratch.sweep()
    if not seen.get["rows"]:
        return rows, 0
    return scratch.write(rows.join(mixed.hint("shuffle_hash"), "key"), f"{name}-open"), seen.get["rows"]


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, settle: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 2) -> DataFrame:
    """(a, b) links that connect all candidates which any link connects.

    `buckets` has key, id and size (of the id's set); ids that share a key are
    candidates of each other. `verify` returns those of the pairs (a, b) that are
    links. In each round some members of every bucket, the pivots, are compared
    with all members not yet in their component, and leave the bucket. A bucket
    is done once its members are in one component. Pivots are as many as there
    were rounds squared; what is little enough is compared at once. So every
    candidate pair is compared or known to be connected, and nearly all that a
    hot bucket holds is settled by a few pivots, without all its pairs.

    With `settle`, what is open after `rounds` rounds goes to it: it gets key, id,
    component and n (members of the bucket) of the open buckets and returns links
    that connect whatever is linked there.
    """
    left = scratch.write(buckets.select("key", "id", "size"), "buckets-0")
    ids = left.select("id").distinct().count()
    links: DataFrame | None = None
    tested: DataFrame | None = None
    comp: DataFrame | None = None
    step = 0
    while True:
        if comp is None:
            rows = left.withColumn("component", F.col("id"))
        else:
            rows = left.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        group = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        rows = scratch.write(rows.join(group.where("lo != hi").select("key", "n"), "key").select("key", "id", "size", "component", "n"), f"open-{step}")
        total = rows.agg(F.sum(F.col("n") - 1), F.max("n")).first()
        if not total[0]:
            break
        if settle is not None and step >= rounds:
            scratch.sweep()
            found = scratch.write(settle(rows), "settled")
            links = found if links is None else links.union(found)
            break
        last = total[0] / 2 <= LEFTOVER * ids and total[1] <= 64
        alike = lambda a, b: 100 * F.least(a, b) >= 75 * F.greatest(a, b)
        if last:
            one, two = rows.select("key", F.col("id").alias("a"), F.col("size").alias("m"), F.col("component").alias("c")), rows.select("key", F.col("id").alias("b"), F.col("size").alias("k"), F.col("component").alias("d"))
            pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & alike(F.col("m"), F.col("k"))).select("a", "b").distinct()
            picked = None
        else:
            pivots = (step + 1) ** 2
            if links is None:
                scored = rows.withColumn("degree", F.lit(0).cast("long"))
            else:
                degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
                scored = rows.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
            best = scored.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(pivots)).alias("part")).agg(F.max(F.struct(F.col("degree"), (-F.col("id")).alias("id"), "size", "component")).alias("p"))
            picked = scratch.write(best.select("key", (-F.col("p.id")).alias("p"), F.col("p.size").alias("m"), F.col("p.component").alias("c")), f"picked-{step}")
            pairs = (
                rows.join(picked, "key")
                .where((F.col("id") != F.col("p")) & (F.col("c") != F.col("component")) & alike(F.col("size"), F.col("m")))
                .select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
                .distinct()
            )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, f"pairs-{step}")
        scratch.sweep()
        found = scratch.write(verify(pairs), f"links-{step}")
        scratch.sweep()
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        if last:
            break
        comp = components(links, scratch, f"round-{step}")
        left = rows.join(picked.select("key", F.col("p").alias("id")), ["key", "id"], "left_anti").select("key", "id", "size")
        step += 1
    if links is None:
        links = left.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return links
