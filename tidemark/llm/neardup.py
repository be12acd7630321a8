"""MinHash near-duplicates by bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles, hashed once; the k smallest
   hashes are its sketch. Texts of equal sets form one class; one of them
   stands for it from then on.
2. Inverted lists of the retained values generate candidates. A list of up to
   ``hot`` members gives its pairs. Values on longer lists are left to step 4.
3. Candidates whose union sketch estimates too small a similarity go; the rest
   is verified on full shingle sets: first one candidate per class, then only
   pairs that the links so far leave in different components.
4. Classes with at least ``least_estimate`` of their sketch on long lists are
   tied, for the lists of their lowest such values, to the member of similar
   size whose values are on the longest lists. After the first components, each
   list with members outside its largest one gets a second such member from
   among them, to which all others are tied. This only saves work for step 5. Classes
   that lack the same lowest values of the sketch they are tied to (copies cut
   in the same place) are tied to the shortest of them.
5. What long lists still leave in different components goes by families: each
   list has a pivot, and classes are known by the values in which they differ
   from it. Those similar to the pivot join its component. For any other pair
   the sizes of the differences tell how many values both must have, and a
   prefix filter over the differences finds it (see ``_across``); the likeliest
   pair of two components is verified first, then what that leaves apart.

Nothing is capped: steps 4 and 5 find the components of long lists, not all
their links. Step 4's work is linear in a list. In step 5 copies edited each in
its own places have too few common differences, which counting alone shows,
and a class brings only so many of its rarest ones as the nearest other
component leaves open. A pair of similarity 0.75 is lost only
where its estimate is below ``least_estimate``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, materialise, shared_dir, table


#: Small tables of links are written in files of so many rows rather than one for each partition.
EDGES_IN_A_FILE = 50_000


@dataclass(frozen=True)
class SketchConfig:
    k: int = 64
    shingle: int = 5
    percent: int = 75
    hot: int = 32
    #: Lowest long lists of a class by which step 4 ties it.
    ties: int = 8
    #: Pairs whose union sketch estimates less are dropped (0.75 has a 1e-7 chance of it at k = 64).
    least_estimate: float = 0.45
    #: Tables of at most so many ids (24 bytes each) are broadcast, larger ones joined by shuffle.
    broadcast_ids: int = 500_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    import xxhash

    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for i in range(min(width, len(words))):  # mix so that order counts
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def sketches(docs: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(doc_id, th, n, digest, sketch) of each row; ``th`` hashes the text, digest stands for the whole set."""

    @F.arrow_udf("struct<n:long,digest:binary,sketch:array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        import xxhash

        n, digest, low = [], [], []
        for text in texts:  # one text at a time as Python bytes
            s = shingle_set(text.as_py(), cfg.shingle)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            low.append(s[: cfg.k].copy())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.list_(pa.int64()))], ["n", "digest", "sketch"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), sketch.asNondeterministic()(F.encode("text", "UTF-8")).alias("s"))
    return out.select("doc_id", "th", "s.n", "s.digest", "s.sketch")


def _similar_size(a: str, b: str, cfg: SketchConfig):
    return (100 * F.least(a, b) >= cfg.percent * F.greatest(a, b))


def _verified(pairs: DataFrame, texts: DataFrame, cfg: SketchConfig) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    k, percent = cfg.shingle, cfg.percent

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        last: tuple = (None, None)  # neighbouring rows often share their left text
        out = []
        for x, y in zip(left, right, strict=True):
            x = x.as_py()
            if x != last[0] or last[1] is None:
                last = (x, shingle_set(x, k))
            p, q = last[1], shingle_set(y.as_py(), k)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
        return pa.array(out, pa.bool_())

    left = texts.select(F.col("node").alias("a"), F.encode("text", "UTF-8").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.encode("text", "UTF-8").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(linked.asNondeterministic()("ta", "tb")).select("a", "b").distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, cfg: SketchConfig, lacking: bool = False) -> DataFrame:
    """``pairs`` with ``est``: the share of the union's sketch that both have.

    With ``lacking`` also ``lacks``, the three lowest values of the pivot's
    sketch that the node's set lacks.
    """
    left = reps.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, cfg.k)
    est = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    out = pairs.join(left, "a").join(right, "b").withColumn("est", est)
    if lacking:
        own, other = F.when(F.col("node") == F.col("a"), F.col("sa")).otherwise(F.col("sb")), F.when(F.col("node") == F.col("a"), F.col("sb")).otherwise(F.col("sa"))
        known = F.when(F.size(own) < cfg.k, F.lit(2**63 - 1)).otherwise(F.element_at(own, -1))  # beyond it the sketch says nothing
        out = out.withColumn("known", known).withColumn("lacks", F.slice(F.filter(F.array_sort(F.array_except(other, own)), lambda v: v <= F.col("known")), 1, 3)).drop("known")
    return out.drop("sa", "sb").where(F.col("est") >= cfg.least_estimate)


def components(links: DataFrame, base: str, name: str) -> DataFrame:
    """(node, comp) with comp the smallest node reachable, for each node with a link.

    Each round every node moves to the neighbour (or itself) of least random
    rank, then to that one's choice, and links become links between the choices;
    it ends when no link is left. Ranks are drawn anew each round, so that the
    nodes shrink by a constant factor a round, whatever their order.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    edges = materialise(both.where("x <> y").distinct(), base, f"{name}-edges")
    labels, k = None, 0
    parts = edges.count() // EDGES_IN_A_FILE + 1  # of what the rounds write, which only shrinks
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        near = edges.groupBy("x").agg(F.min(rank("y")).alias("m")).select(F.col("x").alias("v"), F.least("m", rank("x")).getField("to").alias("p"))
        far = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = materialise(near.join(far, "p").select("v", "q").coalesce(parts), base, f"{name}-step-{k}")
        labels = step.select(F.col("v").alias("node"), F.col("q").alias("root")) if labels is None else (
            labels.join(step, labels["root"] == step["v"], "left").select("node", F.coalesce("q", "root").alias("root")))
        x, y = step.select(F.col("v").alias("x"), F.col("q").alias("qx")), step.select(F.col("v").alias("y"), F.col("q").alias("qy"))
        moved = edges.join(x, "x").join(y, "y").where("qx <> qy").select(F.col("qx").alias("x"), F.col("qy").alias("y")).distinct()
        edges = materialise(moved.coalesce(parts), base, f"{name}-edges-{k}")
        k += 1
    if labels is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("comp"))
    labels = materialise(labels.coalesce(parts), base, f"{name}-roots")
    least = labels.groupBy("root").agg(F.min("node").alias("comp"))
    return materialise(labels.join(least, "root").select("node", "comp").coalesce(parts), base, f"{name}-labels")


def _ties(members: DataFrame, choice: DataFrame) -> DataFrame:
    """(a, b): each list's pivot of a size class and its members there in other components.

    The pivot is, of ``choice``, the one of largest ``weight``, the mean length
    of its lists: the most central one. Those of neighbouring size classes are tied to each other. Size classes
    (``level``) keep a short piece of a text from being the pivot of the texts.
    """
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))).alias("p")
    pivot = choice.groupBy("value", "level").agg(best).select("value", "level", "p.pivot", "p.pivot_comp")
    tied = members.join(pivot, ["value", "level"]).where("comp <> pivot_comp").select("node", "pivot")
    above = pivot.select("value", (F.col("level") - 1).alias("level"), F.col("pivot").alias("node"))
    tied = tied.unionByName(pivot.join(above, ["value", "level"]).where("pivot <> node").select("node", "pivot"))
    return tied.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "node", "pivot").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components so far."""
    a = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(~F.coalesce(F.col("ca"), F.col("a")).eqNullSafe(F.coalesce(F.col("cb"), F.col("b")))).drop("ca", "cb")


def _merged(labels: DataFrame, links: DataFrame, base: str, name: str) -> DataFrame:
    """``labels`` after further links between different components."""
    a, b = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(ends, base, name)
    moved = joined.select(F.col("node").alias("old"), F.col("comp").alias("new"))
    kept = labels.join(moved, labels["comp"] == moved["old"], "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return materialise(kept.unionByName(joined.join(labels, "node", "left_anti").select("node", "comp")), base, f"{name}-merged")


def _families(own: DataFrame, labels: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(family, node): the families of each class, named after their pivot.

    A long list that several components share has a pivot: of the members in
    its largest component the most central one. The list belongs to the family
    of the heaviest pivot among those of its pivot's lists. A class is in the
    families of its lists, but for those of the fewest as long as they are less
    than half of what the estimate asks for: two classes that leave out
    different families still meet in one.
    """
    members = own.join(labels, "node", "left").select("node", "weight", F.coalesce("comp", "node").alias("comp"), F.explode("values").alias("value"))
    by_comp = members.groupBy("value", "comp").agg(F.count("*").alias("c"), F.max(F.struct("weight", "node")).alias("best"))
    pivots = by_comp.groupBy("value").agg(F.count("*").alias("comps"), F.max(F.struct("c", "best")).getField("best").alias("best")).where("comps > 1")
    pivots = pivots.select("value", F.col("best.node").alias("pivot"), F.col("best.weight").alias("weight"))
    held = members.select("node", "value").join(pivots, "value").groupBy("node", "pivot").agg(F.count("*").alias("c"), F.first("weight").alias("weight"))
    some = held.select("pivot").distinct().withColumnRenamed("pivot", "node")
    roots = held.join(some, "node", "left_semi").groupBy("node").agg(F.max(F.struct("weight", "pivot")).getField("pivot").alias("family"))
    roots = roots.withColumnRenamed("node", "pivot")
    counts = held.join(roots, "pivot", "left").groupBy("node", F.coalesce("family", "pivot").alias("family")).agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("node").orderBy("c", "family"))
    need = F.ceil(cfg.least_estimate * F.least(F.col("size"), F.lit(cfg.k)))
    return counts.withColumn("upto", upto).join(own.select("node", "size"), "node").where(2 * F.col("upto") >= need).select("family", "node")


def _differences(families: DataFrame, texts: DataFrame, base: str, cfg: SketchConfig) -> DataFrame:
    """(family, node, n, far, near, d) with d the values that only one of the class and its family's pivot has.

    Let the pivot have b values, of which the class lacks r, while it has a
    others. Two classes of a family have b - r - r' values of the pivot and
    those that are in both differences in common, so they are similar if and
    only if 2 * (100 + percent) * (values in both differences) >= far + far',
    where far = 200 * r + 2 * percent * a - (100 - percent) * b. ``near`` is
    the most that a class similar to the pivot itself can have.
    """

    @F.arrow_udf("struct<n:long,b:long,r:long,d:array<long>>")
    def differ(own: pa.Array, pivots: pa.Array) -> pa.Array:
        last: tuple = (None, None)  # neighbouring rows often share their pivot
        n, b, r, d = [], [], [], []
        for x, y in zip(own, pivots, strict=True):
            y = y.as_py()
            if y != last[0] or last[1] is None:
                last = (y, shingle_set(y, cfg.shingle))
            q, p = last[1], shingle_set(x.as_py(), cfg.shingle)
            lost = np.setdiff1d(q, p, assume_unique=True)
            n.append(len(p))
            b.append(len(q))
            r.append(len(lost))
            d.append(np.concatenate([lost, np.setdiff1d(p, q, assume_unique=True)]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(r, pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["n", "b", "r", "d"])

    pivot = texts.select(F.col("node").alias("family"), F.encode("text", "UTF-8").alias("tp"))
    both = families.join(texts.select("node", F.encode("text", "UTF-8").alias("tx")), "node").join(pivot, "family")
    both = both.select("family", "node", differ.asNondeterministic()("tx", "tp").alias("s")).select("family", "node", "s.*")
    far = 200 * F.col("r") + 2 * cfg.percent * (F.size("d") - F.col("r")) - (100 - cfg.percent) * F.col("b")
    return materialise(both.select("family", "node", "n", far.alias("far"), ((100 - cfg.percent) * F.col("b")).alias("near"), "d"), base, "differences")


def _across(diffs: DataFrame, labels: DataFrame, base: str, cfg: SketchConfig) -> DataFrame:
    """(a, b): the pairs of classes of a family in different components that can be similar.

    Classes similar to their pivot are in its component, the core, by now; of
    the others each pair needs ``far + far' > 0``, so it has a value of both
    differences, and a prefix filter over the differences finds it. Values are
    ordered by how many classes of the family have them; those of one
    component only count for nobody. Let a pair's first common value be at
    ranks r and q of s and t values: they have at most 1 + min(s - r, t - q)
    in common. A class looks for partners in the core and outside it by the
    least ``far`` that there is, so that edited copies, which nearly always lie
    apart, bring few values or none, and only those meet.
    """
    core = labels.select(F.col("node").alias("family"), F.col("comp").alias("core"))
    known = diffs.join(labels, "node", "left").join(core, "family", "left")
    known = known.withColumn("comp", F.coalesce("comp", "node")).withColumn("outer", F.col("comp") != F.coalesce("core", "family")).drop("core")
    least = known.groupBy("family").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.when(~F.col("outer"), F.col("far"))).alias("least_core"), F.min(F.when(F.col("outer"), F.col("far"))).alias("least_outer"),
    ).where("lo <> hi").drop("lo", "hi")
    open_ = materialise(known.join(least, "family"), base, "open")
    values = materialise(open_.select("family", "node", "comp", F.explode("d").alias("value")), base, "values")
    counts = values.groupBy("family", "value").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("family", "value", "c")
    ordered = values.select("family", "node", "value").join(counts, ["family", "value"]).groupBy("family", "node").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("v"))
    ranked = ordered.join(open_.drop("d"), ["family", "node"]).withColumn("s", F.size("v"))
    unit = 2 * (100 + cfg.percent)
    sides = F.filter(F.array(
        F.struct(F.lit("core").alias("side"), F.when(F.col("outer"), F.col("least_core")).otherwise(F.col("least_outer")).alias("other")),
        F.struct(F.lit("outer").alias("side"), F.when(F.col("outer"), F.col("least_outer")).alias("other")),
    ), lambda x: x["other"].isNotNull())
    ranked = ranked.withColumn("m", F.explode(sides))
    length = F.col("s") - F.greatest(F.lit(1), F.ceil((F.col("far") + F.col("m.other")) / unit)) + 1
    ranked = ranked.withColumn("length", length.cast("int")).where("length > 0")
    ranked = ranked.select("family", "node", "comp", "outer", "n", "far", "s", F.col("m.side").alias("side"), F.posexplode(F.slice("v", F.lit(1), F.col("length"))).alias("i", "p"))
    ranked = materialise(ranked.select("family", "p.value", "side", "node", "comp", "outer", "n", "far", (F.col("s") - F.col("i")).alias("room")), base, "prefixes")

    key = ["family", "value", "side"]
    x = ranked.where("outer").select(*key, *(F.col(c).alias(f"{c}_x") for c in ("node", "comp", "n", "far", "room")))
    y = ranked.where("not outer or side = 'outer'").select(*key, *(F.col(c).alias(f"{c}_y") for c in ("node", "comp", "n", "far", "room")))
    once = (F.col("side") == "core") | (F.col("node_x") < F.col("node_y"))
    can = once & (F.col("comp_x") != F.col("comp_y")) & _similar_size("n_x", "n_y", cfg) & (unit * F.least("room_x", "room_y") >= F.col("far_x") + F.col("far_y"))
    pairs = x.join(y, key).where(can)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), F.least("comp_x", "comp_y").alias("compx"), F.greatest("comp_x", "comp_y").alias("compy")).distinct()


def near_duplicates(docs: DataFrame, cfg: SketchConfig | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Rows without words, or with a null text, have no shingles and are linked
    with nothing. A row's component is that of its text: rows of one doc_id
    with different texts are different documents, each in its own component
    unless the texts are linked. A row with a null doc_id can't stand for a
    class: it keeps component_id null and kept true. An empty table gives an
    empty table. Extra columns aren't read.
    """
    return _judged(docs, cfg or SketchConfig()).drop("th")


def _judged(docs: DataFrame, cfg: SketchConfig) -> DataFrame:
    """``near_duplicates`` with ``th``, the hash of a row's text."""
    base = shared_dir(docs.sparkSession)
    sk = materialise(sketches(docs, cfg), base, "sketches")
    reps = (
        sk.where("n > 0 and doc_id is not null").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "th")).alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    # A class is known by a number; once written it stays the same. Its text is that of its row of smallest id.
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "low.doc_id", "low.th", "n", "sketch"), base, "classes")

    # inverted lists: only values on two lists or more matter
    postings = reps.select("node", "n", F.explode("sketch").alias("value"))
    lists = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = materialise(postings.join(lists, "value"), base, "lists")

    cold = shared.where(F.col("df") <= cfg.hot).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("m"))
    pairs = cold.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, cfg.hot), lambda y: _similar_size(x["n"], y["n"], cfg) & (y["node"] != x["node"])),
        lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.greatest(x["n"], y["n"]).alias("n")))))).alias("p"))
    pairs = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("ov"), F.max("p.n").alias("n"))
    hot = shared.where(F.col("df") > cfg.hot)
    heat = hot.groupBy("node").agg(F.count("*").alias("n_hot"), F.max("n").alias("size"), F.sum("df").alias("weight"), F.array_sort(F.collect_list("value")).alias("values"))
    heat = materialise(heat, base, "heat")
    # A pair shares its short lists and at most all long lists of the one with fewer: less than the estimate asks for can go unseen.
    ha, hb = heat.select(F.col("node").alias("a"), F.col("n_hot").alias("ha")), heat.select(F.col("node").alias("b"), F.col("n_hot").alias("hb"))
    most = F.col("ov") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    pairs = pairs.join(ha, "a", "left").join(hb, "b", "left").where(most >= cfg.least_estimate * F.least(F.col("n"), F.lit(cfg.k)))
    pairs = materialise(_estimated(pairs.select("a", "b", "ov", "n"), reps, cfg), base, "pairs")

    # Others can't have the estimate asked for by long lists alone.
    own = heat.withColumn("share", F.col("n_hot") / F.least(F.col("size"), F.lit(cfg.k))).where(F.col("share") >= cfg.least_estimate)
    level = F.floor(F.ln("size") / math.log(100 / cfg.percent))
    own = own.withColumn("weight", F.col("weight") / F.least(F.col("size"), F.lit(cfg.k))).withColumn("level", level)
    lowest = F.explode(F.slice("values", 1, cfg.ties)).alias("value")
    alone = own.select(lowest, "node", "weight", "level", F.col("node").alias("comp"))
    tied = materialise(_estimated(_ties(alone, alone), reps, cfg, lacking=True), base, "tied")

    # first one candidate per class (the likeliest), then what is still apart
    best = pairs.groupBy(F.col("b").alias("node")).agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", F.col("node").alias("b"))
    first = materialise(best.unionByName(tied.select("a", "b")).distinct(), base, "first")
    every = pairs.select("a", "b").unionByName(first)
    nodes = every.select(F.col("a").alias("node")).unionByName(every.select(F.col("b").alias("node"))).unionByName(own.select("node")).distinct()
    nodes = materialise(nodes.join(reps.select("node", "doc_id", "th"), "node"), base, "nodes")
    few = nodes.count() <= cfg.broadcast_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(nodes) if few else nodes, "doc_id")
    texts = materialise(texts.where(F.xxhash64("text") == F.col("th")).select("node", "text").dropDuplicates(["node"]), base, "texts")

    links = materialise(_verified(first, texts, cfg), base, "links-1")
    labels = components(links, base, "comp-1")
    rest = _apart(pairs.select("a", "b"), labels)

    # long lists: the members in other components than a list's second pivot are tied to it
    marked = own.join(labels, "node", "left").select(lowest, "node", "weight", "level", F.coalesce("comp", "node").alias("comp"))
    marked = materialise(marked, base, "hot-marked")
    largest = marked.groupBy("value", "level", "comp").agg(F.count("*").alias("c")).groupBy("value", "level").agg(F.max(F.struct("c", "comp")).getField("comp").alias("big"))
    held = _ties(marked, marked.join(largest, ["value", "level"]).where("comp <> big")).select("a", "b")
    near = tied.groupBy("node").agg(F.max(F.struct("est", "pivot", "lacks")).alias("t")).join(reps.select("node", "n"), "node")
    cut = near.select("node", "n", "t.pivot", "t.lacks", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t.lacks")))).alias("i")).where(F.size("lacks") > 0)
    cut = cut.select(F.xxhash64("pivot", F.slice("lacks", F.lit(1), F.col("i"))).alias("value"), "node", (-F.col("n")).cast("double").alias("weight"), F.lit(0).alias("level"))
    cut = cut.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    held = _estimated(held.unionByName(_ties(cut, cut).select("a", "b")).distinct(), reps, cfg).select("a", "b")
    second = materialise(rest.unionByName(held).distinct(), base, "second")
    if not second.isEmpty():
        labels = _merged(labels, materialise(_verified(second, texts, cfg), base, "links-2"), base, "comp-2")
    diffs = _differences(_families(own, labels, cfg), texts, base, cfg)
    central = diffs.where("far <= near and node <> family").select(F.least("family", "node").alias("a"), F.greatest("family", "node").alias("b"))
    central = materialise(_apart(central, labels), base, "central")
    if not central.isEmpty():
        labels = _merged(labels, central, base, "comp-3")
    third = materialise(_estimated(_across(diffs, labels, base, cfg), reps, cfg), base, "third")
    if not third.isEmpty():
        likeliest = third.groupBy("compx", "compy").agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b")
        labels = _merged(labels, materialise(_verified(likeliest, texts, cfg), base, "links-4"), base, "comp-4")
        fourth = materialise(_apart(third.select("a", "b"), labels).join(likeliest, ["a", "b"], "left_anti"), base, "fourth")
        if not fourth.isEmpty():
            labels = _merged(labels, materialise(_verified(fourth, texts, cfg), base, "links-5"), base, "comp-5")

    # from classes back to rows
    least = labels.join(reps.select("node", "doc_id"), "node").groupBy("comp").agg(F.min("doc_id").alias("least"))
    linked = labels.join(least, "comp").select("node", "least")
    names = reps.join(linked, "node", "left").select("digest", F.coalesce("least", "doc_id").alias("component_id"))
    out = sk.join(names, "digest", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, cfg: SketchConfig | None = None) -> DataFrame:
    """The rows of ``docs`` that stand for their group; rows go by doc_id and text, so no other text of an id goes with them."""
    cfg = cfg or SketchConfig()
    gone = _judged(docs, cfg).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    gone = materialise(gone, shared_dir(docs.sparkSession), "gone")
    same = (docs["doc_id"].cast("long") == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_th"])
    return docs.join(F.broadcast(gone) if gone.count() <= cfg.broadcast_ids else gone, same, "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    """Component of every row of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""
