"""Near-duplicate groups from an inverted join over MinHash coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import kernels
from foliant.llm.components import connected_components
from foliant.llm.scratch import Scratch

#: Coordinates of a signature, and how many of them two documents must share to be compared in full.
#: A pair at similarity 0.75 shares fewer than 20 of 48 once in some 5 million times.
COORDINATES, LEAST = 48, 20
#: Shingles that this share of a component's neighbours holds (and three at least) come last in their order.
COMMON_SHARE = 0.02
#: Shingles that this share of them holds are the component's centre.
CENTRE_SHARE = 0.5
#: Tables of components up to this many bytes, as measured, are broadcast; larger ones meet their members over SALTS parts.
BROADCAST_BYTES, SALTS = 32 << 20, 64
_rng = np.random.Generator(np.random.PCG64(48))
_FACTORS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, 64, dtype=np.uint64)


def signature(values: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least hash of each coordinate, its low 6 bits giving the coordinate's number."""
    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 2048):
        np.minimum(low, (values[k : k + 2048, None] * _FACTORS[:coordinates] + _SHIFTS[:coordinates]).min(axis=0), out=low)
    return (low & ~np.uint64(63)) | np.arange(coordinates, dtype=np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(width: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, n, h1, h2 and the whole set of shingle hashes, or only its signature; then any columns after the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = kernels.buffers(batch.column(1))
            for first in range(0, batch.num_rows, 1000):
                last = min(batch.num_rows, first + 1000)
                own = offsets[first : last + 1]
                count = last - first
                n, h1, h2 = np.zeros(count, np.int64), np.zeros(count, np.uint64), np.zeros(count, np.uint64)
                out = [np.zeros(0, np.uint64)] * count
                for i, values in kernels.shingles(buf[own[0] : own[-1]], own - own[0], width):
                    n[i], h1[i], h2[i] = len(values), values.sum(), kernels.mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum()
                    out[i] = values if whole else signature(values)
                columns = [batch.column(0).slice(first, count), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), _lists(out)]
                extra = batch.schema.names[2:]
                columns += [batch.column(c).slice(first, count) for c in extra]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "hashes", *extra])

    return run


_SCHEMA = "doc_id long, n long, h1 long, h2 long, hashes array<long>"


def near_dedup(df: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (and n_links, the set's confirmed links).

    Documents with equal shingle sets form a class, found by a grouped 128-bit
    sum of their hashes; only classes go on, so exact copies cost nothing
    further. Each class is posted under its (coordinate, value) pairs. Of its
    pairs that other classes have too, ordered from rare to common, it keeps
    those of the prefix in which two signatures with LEAST matches must meet;
    the common rest, which passages shared by many documents fill, is skipped.
    Candidates are counted on whole signatures, those with LEAST matches or
    more confirmed on whole sets, and links joined into components.

    A list of n near copies isn't expanded into n^2 pairs. First every class
    meets the class of its lists with which it collides most. Then, in lists
    which still hold more than one component, the members outside the largest
    one meet those of other components. Here the method is departed from:
    between components it isn't collisions of coordinates that are counted,
    as near copies of one text collide in nearly all of them, but the same
    prefix and skip merge runs, now exact, over what sets each member apart
    from its group's common shingles, by having or by missing them. So each
    candidate pair is either within one component or compared or too far apart
    for its prefixes: no link between components is lost. Sets are sets of
    64-bit hashes of shingles, and links are confirmed on these.

    A component may hold a third of all classes: nothing is joined by
    component alone. What is known of one goes to its members by broadcast if
    it is measured small for all components, else over SALTS parts.

    A null, empty or wordless text has no shingles, no links and its own id as
    component. Ids are compared as they are: rows that share an id are
    separate members; a component's id is its least id that isn't null, and
    kept says that a row's id is the component's (null with null). ``carry``
    names a column of strings that is returned beside the rest. Columns that
    aren't named aren't read. An empty table gives no rows. Memory
    follows a single text.
    """
    scratch = Scratch(df.sparkSession, "near")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    extra = [F.col(carry).alias("carried")] if carry else []
    whole_rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    signed = scratch.save(whole_rows.mapInArrow(_sets(width, whole=False), _SCHEMA + (", carried string" if carry else "")).withColumn("row", F.monotonically_increasing_id()))
    key = ["h1", "h2", "n"]
    classes = signed.where("n > 0").groupBy(*key).agg(F.min("row").alias("node"), F.min("doc_id").alias("least_doc"), F.first("hashes").alias("signature"))
    classes = scratch.save(classes)

    postings = scratch.save(_postings(classes))
    sets = scratch.save(_sets_of(rows, signed, postings.select("node").distinct(), width))
    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)

    def confirm(pairs: DataFrame) -> DataFrame:
        """Of candidates (a, b), the links: counted on signatures, then on whole sets."""
        signs = classes.select("node", "signature")
        pairs = pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b")
        pairs = pairs.where(F.size(F.array_intersect("sign_a", "sign_b")) >= LEAST).select("a", "b")
        pairs = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        pairs = pairs.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b") - shared).alias("either"))
        return pairs.where(F.col("shared") * 100 >= F.col("either") * percent).select("a", "b").distinct()

    # Each class meets the most central class of its lists.
    central = postings.groupBy("token").agg(F.max(F.struct("score", "node", "n")).alias("hub"))
    central = central.select("token", F.col("hub.node").alias("b"), F.col("hub.n").alias("n_b"))
    met = postings.select("token", F.col("node").alias("a"), F.col("n").alias("n_a")).join(central, "token").where(fits & (F.col("a") != F.col("b")))
    met = met.groupBy("a", "b").count().groupBy("a").agg(F.max(F.struct("count", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = scratch.save(confirm(met))

    def rooted_by(links: DataFrame) -> DataFrame:
        roots = connected_components(links, scratch)
        return scratch.save(postings.join(roots, "node", "left").select("token", "node", "n", "score", F.coalesce("root", "node").alias("root")))

    # In lists with more than one component, those outside the largest meet its most central class, which may be new to them.
    rooted = rooted_by(links)
    hubs = rooted.groupBy(F.col("root").alias("main")).agg(F.max(F.struct("score", "node", "n")).alias("hub")).select("main", F.col("hub.node").alias("b"), F.col("hub.n").alias("n_b"))
    met = _to_members(_members(rooted).where("root <> main").select(F.col("node").alias("a"), F.col("n").alias("n_a"), "main"), hubs, "a", scratch)
    links = scratch.save(links.union(confirm(met.where(fits).select("a", "b").distinct())))

    # Then those which are still outside meet the others.
    links = scratch.save(links.union(confirm(_across(rooted_by(links), sets, percent, scratch).where(fits).select("a", "b").distinct())))

    roots = connected_components(links, scratch)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = classes.select(*key, "node", "least_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(degree, "node", "left")
    least = grouped.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    grouped = scratch.save(grouped.join(least, "root").select(*key, "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    scratch.keep_only(signed, grouped)
    out = signed.select("doc_id", *key, *(["carried"] if carry else [])).join(grouped, key, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        *([F.col("carried").alias(carry)] if carry else []),
    )


def _postings(classes: DataFrame) -> DataFrame:
    """token, node, n, score: the prefixes that can meet, in lists of two classes or more."""
    tokens = classes.select("node", "n", F.explode("signature").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    ordered = tokens.join(common, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("own"))  # COORDINATES at most
    ordered = ordered.where(F.size("own") >= LEAST)
    score = F.expr("aggregate(own, 0L, (s, x) -> s + x.count)")
    prefix = F.expr(f"slice(own, 1, size(own) - {LEAST - 1})")
    return ordered.select("node", "n", score.alias("score"), F.explode(prefix).alias("x")).select(F.col("x.token").alias("token"), "node", "n", "score")


def _members(rooted: DataFrame) -> DataFrame:
    """(main, node, n, root): the classes of lists with several components, under the list's largest."""
    per = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("count"))
    per = per.groupBy("token").agg(F.max(F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    per = per.where("roots > 1").select("token", F.col("main.root").alias("main"))
    return rooted.join(per, "token").select("main", "node", "n", "root").distinct()


def _to_members(members: DataFrame, known: DataFrame, node: str, scratch: Scratch, lists: tuple[str, ...] = ()) -> DataFrame:
    """Members (main, ...) with the row of ``known`` (main, ...) of their component; ``lists`` name its array columns of numbers."""
    known = scratch.save(known)
    longs = sum((F.size(c) for c in lists), F.lit(len(known.columns) + 4))
    if (known.agg(F.sum(longs)).first()[0] or 0) * 8 <= BROADCAST_BYTES:
        return members.join(F.broadcast(known), "main")
    parts = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("_salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")).join(parts, ["main", "_salt"]).drop("_salt")


def _across(rooted: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, n_a, b, n_b) that can be links between components which still share a list.

    Again a prefix and skip merge, now exact, over what sets each member apart.
    Around each largest component, the shingles that half of its lists' members
    hold are the centre; a member is written as its difference: shingles that
    it has and the centre hasn't, and those that it misses. With m misses and
    size n, its cost is (100 + percent) * m + percent * n. Two members link if
    their differences share at least ceil(sum of costs / (100 + percent)) less
    the centre's size. Where that is 0 or less they link for certain, and then
    both link with the member of least cost, so each meets that one alone.
    Otherwise they must meet in prefixes of their differences, which are short
    and in which entries that many hold come last; where they meet bounds what
    they can share. A group's size doesn't count.
    """
    members = scratch.save(_members(rooted))
    size = members.groupBy("main").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("members"))
    held = members.join(sets, "node").select("main", F.explode("set").alias("shingle")).groupBy("main", "shingle").agg(F.count(F.lit(1)).alias("count"))
    # At most 1 / COMMON_SHARE times the mean set size of shingles for each component.
    held = _to_members(held, size, "shingle", scratch).where(F.col("count") >= F.greatest(F.lit(3), F.col("members") * COMMON_SHARE))
    core, usual = F.col("count") >= F.col("members") * CENTRE_SHARE, F.col("count") <= F.col("members") * (1 - COMMON_SHARE)
    known = held.groupBy("main").agg(F.collect_list(F.when(core, F.col("shingle"))).alias("centre"), F.collect_list(F.when(usual, F.col("shingle"))).alias("common"))
    none = F.array().cast("array<bigint>")
    known = size.join(known, "main", "left").select("main", "least", F.coalesce("centre", none).alias("centre"), F.coalesce("common", none).alias("common"))
    members = _to_members(members, known, "node", scratch, ("centre", "common")).join(sets, "node")
    members = members.withColumn("missed", F.array_except("centre", "set")).withColumn("apart", F.concat(F.array_except("set", "centre"), "missed"))
    whole = 100 + percent
    cost = (F.size("missed") * whole + F.col("n") * percent).alias("cost")
    ordered = F.concat(F.array_sort(F.array_except("apart", "common")), F.array_sort(F.array_intersect("apart", "common")))
    members = members.select("main", "node", "n", "root", "least", F.size("centre").alias("centre"), F.size("apart").alias("size"), cost, ordered.alias("ordered"))
    enough = f"greatest(1L, ceil((cost + {percent}L * greatest(ceil(n * {percent}L / 100D), least)) / {whole}D) - centre)"
    prefix = F.slice("ordered", 1, F.expr(f"CAST(greatest(size - {enough} + 1, 0) AS INT)"))
    members = scratch.save(members.select("main", "node", "n", "root", "centre", "size", "cost", prefix.alias("prefix")))

    pole = members.groupBy("main").agg(F.min(F.struct("cost", "node", "n", "root")).alias("pole"))
    sure = (F.col("root") != F.col("pole.root")) & (F.col("cost") + F.col("pole.cost") <= F.col("centre") * whole)
    certain = _to_members(members, pole, "node", scratch).where(sure).select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pole.node").alias("b"), F.col("pole.n").alias("n_b"))

    posted = members.select("main", "node", "n", "root", "centre", "size", "cost", F.posexplode("prefix").alias("at", "shingle")).withColumn("rest", F.col("size") - F.col("at"))
    outer = posted.where("root <> main").select("main", "shingle", "centre", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("cost").alias("cost_a"), F.col("rest").alias("rest_a"))
    other = posted.select("main", "shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("cost").alias("cost_b"), F.col("rest").alias("rest_b"))
    can = (F.least("rest_a", "rest_b") + F.col("centre")) * whole >= F.col("cost_a") + F.col("cost_b")
    apart = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b")))
    return outer.join(other, ["main", "shingle"]).where(apart & can).select("a", "n_a", "b", "n_b").union(certain)


def _sets_of(rows: DataFrame, signed: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set) of whole shingle sets, made anew from the texts of these classes alone."""
    wanted = signed.join(nodes, F.col("row") == F.col("node")).select("doc_id", "h1", "h2", "n", "node")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    made = texts.mapInArrow(_sets(width, whole=True), _SCHEMA).drop("doc_id").dropDuplicates(["h1", "h2", "n"])
    return made.join(wanted, ["h1", "h2", "n"]).select("node", F.col("hashes").alias("set"))
