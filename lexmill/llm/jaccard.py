"""N-gram Jaccard self-join by a size-aware heavy-light split.

A document is the set of its distinct k-word shingles; two documents link when
``100 * |intersection| >= threshold * |union|``. Steps:

1. Documents with equal sets are collapsed to one node, named by a 64-bit hash of the set.
2. A linked set lacks few of its elements in the other. Of its elements with the lowest hashes
   (``head_size``) all but as many must therefore be among those of another set; sets of
   which that is not so are finished. For those that are left the elements that occur in two or
   more of them are kept; all else cannot add to an intersection.
3. *Light* sets (up to a boundary size chosen by estimated cost) enumerate subsets of the fixed
   size that a partner of each admissible size must share; equal subsets are links without
   further check.
4. *Heavy* sets, and light ones near enough in size to have a heavy partner, scan inverted
   lists over a rarest-first prefix. Members leave a list where too little of them follows the element
   for its smallest set. In each round every list compares its members with a few
   pivots, which then leave the list; sets found to be connected need not be compared again, and only
   pairs that place and parity filters let through are compared at the end.
5. Components are labelled by their least document id.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, least_neighbours, materialize, pick
from .hashing import mix, shingle_sets, slices, small_batches

#: Light sets are at most this large whatever the cost estimate says.
LIGHT_MOST = 40
#: Pivots of a list in each round, and rounds at most before what is left is compared pair by pair; it is, too, when
#: a round has not halved the open pairs.
PIVOTS = 3
ROUNDS = 4
#: Elements kept with a row of a list to tell whether a pair has met before.
LAST = 8
#: Open pairs for each row of the lists up to which comparing them all is cheap: the filters need no sets.
CHEAP = 32


def prefix_size(n, threshold: int):
    """Elements of a set of size n that must be indexed: n minus the least overlap, plus one."""
    return n - (-((-threshold * n) // 100)) + 1


def head_size(n: int, threshold: int) -> int:
    """Elements of lowest hash by which a set of size n is tested for partners.

    Grows so slowly with n that a set lacks no more elements in a shorter head of a linked set than it may lack in all.
    """
    return 2 * (100 - threshold) * n // 100 + 2


def overlap_needed(a: int, b: int, threshold: int) -> int:
    """Least intersection size with which sets of sizes a and b link."""
    return -((-threshold * (a + b)) // (100 + threshold))


def _set_hash(s: np.ndarray) -> np.int64:
    return mix(s.view(np.uint64)).sum(dtype=np.uint64).astype(np.int64)


def _features(k: int, threshold: int):
    def run(batches):
        for batch in small_batches(batches, "text"):
            ids, texts = batch.column("id"), batch.column("text")
            rows = texts.to_pylist()
            sizes = [len(x) if x else 0 for x in rows]
            for a, b in slices(sizes):
                sets = shingle_sets(rows[a:b], k)
                n = np.array([len(s) for s in sets], np.int64)
                node = np.array([_set_hash(s) for s in sets], np.int64)
                heads = [s[: head_size(len(s), threshold)].tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(node), pa.array(heads, pa.binary())], ["id", "n", "node", "head"])

    return run


def _explode_ids(batches):
    """(id, n, packed longs) to one row (e, id, n) for each long."""
    for batch in small_batches(batches, "head"):
        packed = batch.column("head").to_pylist()
        for a, b in slices([len(p) // 8 for p in packed], 200_000):
            count = np.array([len(p) // 8 for p in packed[a:b]])
            e = np.frombuffer(b"".join(packed[a:b]), np.int64)
            take = pa.array(np.repeat(np.arange(a, b), count))
            yield pa.RecordBatch.from_arrays([pa.array(e), batch.column("id").take(take), batch.column("n").take(take)], ["e", "id", "n"])


def _whole(k: int):
    """Whole sets of the nodes again, packed; texts that have another set give none."""

    def run(batches):
        for batch in small_batches(batches, "text"):
            texts, nodes = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            for a, b in slices([len(t) if t else 0 for t in texts]):
                sets = shingle_sets(texts[a:b], k)
                keep = [i for i, s in enumerate(sets) if int(_set_hash(s)) == nodes[a + i]]
                take = pa.array([a + i for i in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("n").take(take), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["id", "n", "head"])

    return run


def _pack(threshold: int):
    """Rows (id, n, df, e) in order of id, df and e to packed elements, of the sets with enough of them."""

    def run(batches):
        last, parts = None, []

        def row():
            e = np.concatenate(parts)
            e = e[np.concatenate([[True], e[1:] != e[:-1]])]  # a repeated row gives its elements twice
            if 100 * len(e) >= threshold * last[1]:
                yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([e.tobytes()], pa.binary())], ["id", "n", "es"])

        for batch in batches:
            i, n, e = (batch.column(c).to_numpy() for c in ("id", "n", "e"))
            cuts = np.flatnonzero(i[1:] != i[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(i)]):
                if a == b:
                    continue
                if last is not None and i[a] != last[0]:
                    yield from row()
                    parts = []
                last = (int(i[a]), int(n[a]))
                parts.append(e[a:b].copy())
        if last is not None:
            yield from row()

    return run


def _subsets(boundary: int, threshold: int):
    """Keys of the light sets: (smaller size, larger size, hash of a subset of the size both must share)."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for i, n, packed in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "es"))):
                e = np.frombuffer(packed, np.uint64)
                hashed = mix(e)
                total = int(hashed.sum(dtype=np.uint64))
                for m in range(-(-threshold * n // 100), min(boundary, 100 * n // threshold) + 1):
                    need = overlap_needed(n, m, threshold)
                    if need > len(e):
                        continue
                    # a subset is told by what it leaves out: its hash is the total less the rest
                    for rest in combinations(range(len(e)), len(e) - need):
                        key = (total - int(hashed[list(rest)].sum(dtype=np.uint64)) if rest else total) % (1 << 64) - (1 << 63)
                        for x, v in zip(out, (min(n, m), max(n, m), key, i, n)):
                            x.append(v)
                if len(out[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["lo", "hi", "key", "id", "n"])
                    out = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["lo", "hi", "key", "id", "n"])

    return run


def _heads(threshold: int):
    """Rarest-first prefixes as rows (e, place, id, n, s, bits, last); elements in one set only come first and are in no list.

    ``place`` is the element's place in the whole order, ``s`` the number of elements that are in
    other sets too, ``bits`` their parities by hash in four longs, ``last`` the elements whose lists come just before.
    """

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            bits: list[list[np.ndarray]] = [[], [], [], []]
            last, length = [], []
            for i, n, packed in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "es"))):
                e = np.frombuffer(packed, np.int64)
                alone = n - len(e)
                size = min(len(e), max(0, prefix_size(n, threshold) - alone))
                if not size:
                    continue
                parity = np.packbits((np.bincount((mix(e.view(np.uint64)) & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
                for x, v in zip(out, (e[:size], np.arange(alone, alone + size), np.full(size, i), np.full(size, n), np.full(size, len(e)))):
                    x.append(v)
                for x, v in zip(bits, parity):
                    x.append(np.full(size, v))
                some = np.minimum(np.arange(size), LAST)
                length.append(some)
                last.append(e[np.repeat(np.arange(size) - np.cumsum(some), some) + np.arange(some.sum())])
            cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (*out, *bits, last, length)]
            ends = pa.array(np.concatenate([[0], np.cumsum(cols.pop())]), pa.int32())
            before = pa.ListArray.from_arrays(ends, pa.array(cols.pop()))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), before], ["e", "place", "id", "n", "s", "b0", "b1", "b2", "b3", "last"])

    return run


def _may_link(threshold: int):
    """Whether a pair met in a list (columns ending in a and b) can reach the overlap its sizes need.

    It cannot if what follows the common element in either order is too little, or if the parities differ
    in so many places that the sets differ in more elements than allowed.
    """
    need = F.ceil(F.lit(threshold) * (F.col("na") + F.col("nb")) / F.lit(100 + threshold))
    rest = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    differ = sum((F.bit_count(F.col(f"b{k}a").bitwiseXOR(F.col(f"b{k}b"))) for k in range(4)), F.lit(0))
    return _size_filter("na", "nb", threshold) & (rest >= need) & (F.col("sa") + F.col("sb") - differ >= 2 * need)


def _side(lists: DataFrame, side: str) -> DataFrame:
    return lists.select("e", *[F.col(c).alias(c + side) for c in lists.columns if c != "e"])


def _verify(threshold: int):
    def run(batches):
        for batch in small_batches(batches, "ea"):
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ea", "eb"))):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= threshold * (na + nb - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _boundary(sets: DataFrame, threshold: int) -> int:
    """The size up to which enumerating subsets is estimated to cost less than scanning lists.

    A row for each size up to LIGHT_MOST and number of shared elements comes to the driver. Enumerating costs a row for each subset; a list costs a row for each
    prefix element and two more for comparing whole sets.
    """
    shared = (F.length("es") / 8).cast("int")
    rows = sets.where(F.col("n") <= LIGHT_MOST).groupBy("n", shared.alias("s")).agg(F.count("*").alias("c")).collect()
    enumerate_, scan = {}, {}
    for n, s, c in ((r["n"], r["s"], r["c"]) for r in rows):
        partners = range(-(-threshold * n // 100), 100 * n // threshold + 1)
        enumerate_[n] = enumerate_.get(n, 0) + c * sum(comb(s, overlap_needed(n, m, threshold)) for m in partners)
        scan[n] = scan.get(n, 0) + c * (max(0, prefix_size(n, threshold) - (n - s)) + 2 * s)
    best, least = 0, sum(scan.values())
    for x in range(1, LIGHT_MOST + 1):
        cost = sum(v for n, v in enumerate_.items() if n <= x) + sum(v for n, v in scan.items() if 100 * n >= threshold * (x + 1))
        if cost < least:
            best, least = x, cost
    return best


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by the exact intersection of their elements."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("es").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("es").alias("eb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ea", "eb").mapInArrow(_verify(threshold), "a long, b long")


def _size_filter(a: str, b: str, threshold: int):
    return (F.lit(100) * F.least(a, b)) >= (F.lit(threshold) * F.greatest(a, b))


def _light_edges(sets: DataFrame, boundary: int, threshold: int) -> DataFrame:
    """Links among sets of up to ``boundary`` elements, by equal subsets."""
    light = sets.where(F.col("n") <= boundary).mapInArrow(_subsets(boundary, threshold), "lo long, hi long, key long, id long, n long")
    # In a group all pairs of the two sizes link. The least id of each size stands for the group.
    light = materialize(light, "light")
    low, high = F.when(F.col("n") == F.col("lo"), F.col("id")), F.when(F.col("n") == F.col("hi"), F.col("id"))
    group = light.groupBy("lo", "hi", "key").agg(F.min(low).alias("a"), F.min(high).alias("b"), F.count("*").alias("c")).where("c > 1 and a is not null and b is not null")
    group = materialize(group.drop("c"), "light")
    member = light.join(group, ["lo", "hi", "key"])
    edges = member.select(F.col("id").alias("a"), F.when(F.col("n") == F.col("lo"), F.col("b")).otherwise(F.col("a")).alias("b"))
    return materialize(edges.where("a <> b").distinct(), "edges")


def _edges_of_distinct(sets: DataFrame, threshold: int) -> DataFrame:
    """Links between different sets, enough of them to give the right components."""
    boundary = _boundary(sets, threshold)
    edges = _light_edges(sets, boundary, threshold) if boundary else sets.sparkSession.createDataFrame([], "a long, b long")

    # Both of a pair may be light only where subsets have been enumerated for it.
    reach = F.col("n") * 100 >= F.lit(threshold * (boundary + 1))
    columns = "e long, place long, id long, n long, s long, b0 long, b1 long, b2 long, b3 long, last array<long>"
    lists = materialize(sets.where(reach).mapInArrow(_heads(threshold), columns), "lists")
    heavy = F.greatest("na", "nb") > F.lit(boundary)
    now = _alive(lists.withColumn("part", F.col("id")), threshold)
    before = None
    for turn in range(ROUNDS):
        if turn:
            # Sets known to be connected: not whole components, but what one step over the links shows.
            parts = least_neighbours(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
            every, now = lists, _alive(lists.join(parts, "id", "left").select(*lists.columns, F.coalesce("component", "id").alias("part")), threshold)
            todo = now.agg(F.coalesce(F.sum("others"), F.lit(0.0)).alias("p"), F.count("*").alias("m")).first()
            discard(every, parts)
            if not todo["p"]:
                return edges
            if todo["p"] <= CHEAP * todo["m"] or before is not None and 2 * todo["p"] > before:
                break
            before = todo["p"]
        # Sets with the least share before a list's element are the likeliest partners of its others: the first of all
        # members, and of parts of them by hash.
        fields = ["id", "place", "n", "s", "b0", "b1", "b2", "b3", "part"]
        order = F.struct(F.col("place") / F.col("n"), F.xxhash64("id"))
        lot = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(PIVOTS))
        least = [F.min_by(F.struct(*fields), order), *(F.min_by(F.when(lot == k, F.struct(*fields)), F.when(lot == k, order)) for k in range(1, PIVOTS))]
        pivots = now.groupBy("e").agg(F.array_distinct(F.array_compact(F.array(*least))).alias("p"))
        pivots = materialize(pivots.select("e", F.explode("p").alias("p")).select("e", *[F.col(f"p.{c}").alias(c) for c in fields]), "pivots")
        met = _side(now, "a").join(_side(pivots, "b"), "e").where("parta <> partb").where(_may_link(threshold) & heavy)
        pairs = materialize(met.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "pairs")
        edges = materialize(edges.unionByName(_linked(pairs, sets, threshold)), "edges")
        # A pivot has met all members of its list.
        gone = pivots.groupBy("e").agg(F.collect_set("id").alias("gone"))
        lists = materialize(now.select(lists.columns).join(gone, "e").where(~F.array_contains("gone", F.col("id"))).drop("gone"), "lists")
        discard(pivots, pairs, now)
    # A pair that shares one of the elements just before has met in that one's list.
    again = F.arrays_overlap("lasta", "lastb")
    met = _side(now, "a").join(_side(now, "b"), "e").where("ida < idb and parta <> partb").where(_may_link(threshold) & heavy & ~again)
    pairs = materialize(met.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "pairs")
    return materialize(edges.unionByName(_linked(pairs, sets, threshold)), "edges")


def _alive(lists: DataFrame, threshold: int) -> DataFrame:
    """The rows of lists that can still have a partner in their list, with ``others``: half the members in other parts, on average.

    What follows the element must be enough for the smallest set of the list, or the smallest partner that the size admits.
    """
    each = lists.groupBy("e", "part").agg(F.count("*").alias("c"), F.min("n").alias("low"))
    each = each.groupBy("e").agg(F.sum("c").alias("members"), F.sum(F.col("c").cast("double") * F.col("c")).alias("q"), F.count("*").alias("parts"), F.min("low").alias("low")).where("parts > 1")
    smallest = F.greatest("low", F.ceil(F.lit(threshold) * F.col("n") / F.lit(100)))
    need = F.ceil(F.lit(threshold) * (F.col("n") + smallest) / F.lit(100 + threshold))
    kept = lists.join(each, "e").where(F.col("n") - F.col("place") >= need)
    return materialize(kept.select(*lists.columns, ((F.col("members") - F.col("q") / F.col("members")) / 2).alias("others")), "lists")


def jaccard_components(docs: DataFrame, k: int = 4, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than k words has its
    whole sequence as its one shingle. Null and blank texts have an empty set and link with
    nothing, so their component is themselves. Repeated rows are returned as often as given; rows
    of one id belong to one component. Rows with a null id are returned with a null component and
    link with nothing. Further columns are ignored; an empty table gives an empty result.
    """
    given = pick(docs, id_col, text_col).toDF("id", "text")
    schema = "id long, n long, node long, head binary"
    rows = materialize(given.select(F.col("id").cast("long"), "text").mapInArrow(_features(k, threshold), schema), "sets")
    named = rows.where("id is not null and n > 0")
    groups = materialize(named.groupBy("node", "n").agg(F.min("id").alias("least")), "groups")

    # Copies of a set count once: an element is of one set only if its least and greatest node agree.
    heads = named.select(F.col("node").alias("id"), "n", "head").mapInArrow(_explode_ids, "e long, id long, n long")
    alone = heads.groupBy("e").agg(F.min("id").alias("id"), F.max("id").alias("most")).where("id = most").groupBy("id").agg(F.count("*").alias("u"))
    lacks = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") / F.lit(100))
    alive = groups.select(F.col("node").alias("id"), F.col("least").alias("doc"), "n").join(alone, "id", "left")
    alive = materialize(alive.where(F.coalesce("u", F.lit(0)) <= lacks).select("id", "doc", "n"), "alive")
    # The texts of the nodes that are left, one text for each.
    again = given.where("id is not null").select(F.col("id").cast("long").alias("doc"), "text").join(alive.hint("merge"), "doc")
    whole = materialize(again.select("id", "n", "text").mapInArrow(_whole(k), "id long, n long, head binary"), "whole")
    # The same test over whole sets, among the sets that are left.
    elements = whole.mapInArrow(_explode_ids, "e long, id long, n long")
    counts = materialize(elements.groupBy("e").agg(F.count("*").alias("df"), F.min("id").alias("id"), F.max("id").alias("most")), "counts")
    alone = counts.where("id = most").groupBy("id").agg(F.count("*").alias("u"))
    whole2 = materialize(whole.join(alone, "id", "left").where(F.coalesce("u", F.lit(0)) <= lacks).select("id", "n", "head"), "whole")
    shared = counts.where("id <> most").select("e", "df")
    counted = whole2.mapInArrow(_explode_ids, "e long, id long, n long").join(shared, "e").repartition("id").sortWithinPartitions("id", "df", "e")
    sets = materialize(counted.select("id", "n", "e").mapInArrow(_pack(threshold), "id long, n long, es binary"), "sets")
    discard(whole, whole2, counts, alive)
    edges = _edges_of_distinct(sets, threshold)
    discard(sets)

    # From here on a set goes by its least document. Rows of one id with different sets are one document.
    least = groups.select("node", "least")
    edges = edges.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = named.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("id")
    several = named.select("id", "node").join(several, "id").join(least, "node").select(F.col("id").alias("a"), F.col("least").alias("b"))
    parts = connected_components(edges.unionByName(several)).withColumnRenamed("id", "least")
    label = least.join(parts, "least", "left").select("node", F.coalesce("component", "least").alias("label"))
    label = materialize(label, "labels")
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(label, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 4, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the least of their component, with all their columns; of rows with one id one, the least.

    Rows with a null id and those with a null or blank text, which link with nothing, stay; an empty table gives an
    empty result. Columns whose names clash are kept apart.
    """
    found = jaccard_components(docs, k, threshold, id_col, text_col).where("doc_id is not null")
    ids = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component")), "ids")
    names = docs.columns
    flat = [f"_c{i}" for i in range(len(names))]
    rows, key = docs.toDF(*flat), flat[names.index(id_col)]
    gone = ids.where("n > 1 or component <> doc_id").select(F.col("doc_id").alias("_id")).hint("merge")
    kept = ids.where("n > 1 and component = doc_id").select(F.col("doc_id").alias("_id"))
    out = rows.join(gone, F.col(key).cast("long") == F.col("_id"), "left_anti")
    several = rows.join(kept, F.col(key).cast("long") == F.col("_id"), "left_semi")
    several = several.groupBy(F.col(key).cast("long").alias("_id")).agg(F.min(F.struct(*flat)).alias("_row")).select("_row.*")
    return out.unionByName(several).toDF(*names)
