"""MinHash near-duplicates with tensored banding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gather, lower_ascii, settle, small_batches, word_hashes
from .components import connected_components

SHINGLE = 5
#: Each collection holds so many keys of so many minhashes each. A table is a
#: pair of keys, one of each collection: 18 * 18 tables of six minhashes from
#: 108 minhashes instead of 1,944.
KEYS, ROWS = 18, 3
#: Documents are hashed in pieces of about so many words.
PIECE_WORDS = 250_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all their values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets_of(words: np.ndarray, sizes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of several documents: their hashes one after another, and the sets' sizes.

    ``words`` are those of the documents, one after another, ``sizes`` their
    numbers. A set holds the sorted distinct 64-bit hashes of the runs of ``size``
    words. Fewer words are one run, marked with their number; no words have none.
    """
    starts = np.cumsum(sizes) - sizes
    runs = np.where(sizes >= size, sizes - size + 1, np.minimum(sizes, 1))
    ends = np.cumsum(runs)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    whole += np.uint64(size)
    for i in range(size):
        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(whole)])
    at = np.repeat(starts - (ends - runs), runs) + np.arange(total)
    short = np.flatnonzero((sizes > 0) & (sizes < size))
    hashes = np.empty(total, np.uint64)
    inside = at < len(whole)
    hashes[inside] = whole[at[inside]]
    for d in short.tolist():
        h = np.full(1, sizes[d], np.uint64)
        for word in words[starts[d] : starts[d] + sizes[d]]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
        hashes[ends[d] - 1] = h[0]
    firsts = ends - runs
    for a, b in zip(firsts.tolist(), ends.tolist(), strict=True):
        hashes[a:b].sort()
    distinct = np.ones(total, bool)
    distinct[1:] = hashes[1:] != hashes[:-1]
    distinct[firsts[runs > 0]] = True
    kept = np.concatenate([[0], np.cumsum(distinct)])
    return hashes[distinct], kept[ends] - kept[firsts]


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The set of one document's words."""
    return shingle_sets_of(words, np.array([len(words)]), size)[0]


def seeds(keys: int = KEYS) -> np.ndarray:
    """A multiplier and a mask for each minhash."""
    made = np.random.default_rng(20).integers(0, 1 << 32, (2 * keys * ROWS, 2), np.uint32)
    return made | np.array([1, 0], np.uint32)


def band_keys(shingles: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The keys of non-empty sets, a row each: those of the left collection, then the right.

    Minhashes are least values of multiplied and masked hashes; a key mixes ``ROWS`` of them.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    firsts = np.cumsum(sizes) - sizes
    least = np.empty((len(seeds), len(sizes)), np.uint32)
    for k, (times, mask) in enumerate(seeds):
        least[k] = np.minimum.reduceat((x * times) ^ mask, firsts)
    groups = least.T.reshape(len(sizes), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(groups.shape[1], dtype=np.uint64), groups.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, i])
    return key.view(np.int64)


def pieces(batch: pa.RecordBatch, most: int = PIECE_WORDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in pieces of about ``most`` words, a document at least: (rows, words, sizes)."""
    column = batch.column("words")
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    while at < len(column):
        stop = min(max(at + 1, int(np.searchsorted(ends, ends[at] + most))), len(column))
        yield batch.slice(at, stop - at), values[ends[at] : ends[stop]], np.diff(ends[at : stop + 1]).astype(np.int64)
        at = stop


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def signatures(docs: DataFrame, keys: int = KEYS) -> DataFrame:
    """(doc_id, n_shingles, same, left, right) for each row of ``docs(doc_id, words)``.

    ``same`` is a 128-bit digest of the whole set; left and right hold the keys.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = seeds(keys)
        for batch in batches:
            for rows, words, sizes in pieces(batch):
                shingles, n = shingle_sets_of(words, sizes)
                found = np.zeros((len(n), 2 * keys), np.int64)
                if len(shingles):
                    found[n > 0] = band_keys(shingles, n[n > 0], made)
                raw, ends = memoryview(shingles).cast("B"), np.cumsum(n) * 8
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip((ends - n * 8).tolist(), ends.tolist(), strict=True)]
                each = np.where(n > 0, keys, 0)
                sides = [listed(found[n > 0][:, side].ravel(), each) for side in (slice(None, keys), slice(keys, None))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *sides], names=["doc_id", "n_shingles", "same", "left", "right"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, same binary, left array<long>, right array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): the set of each row of ``docs(id, text)``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words, sizes in pieces(batch):
                shingles, n = shingle_sets_of(words, sizes)
                yield pa.RecordBatch.from_arrays([rows.column("id"), listed(shingles.view(np.int64), n)], names=["id", "shingles"])

    return docs.select("id", word_hashes(lower_ascii(F.col("text"))).alias("words")).mapInArrow(sets, "id long, shingles array<long>")


def met(classes: DataFrame, side: str) -> DataFrame:
    """(key, id, n): the keys of one collection that n classes have, more than one. A key tells its place."""
    rows = classes.select("id", F.explode(side).alias("key"))
    common = gather(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return rows.join(common, "key")


def compare(pairs: DataFrame, sets: DataFrame, changes: bool = False) -> DataFrame:
    """``pairs(u, v)`` with the sizes of both sets, ``nu`` and ``nv``, and of what they share, ``common``.

    ``changes`` adds the shingles of u that v lacks, ``extra``, and those of v that u
    lacks, ``lacks``. Each pair's set of u goes where the set of v is, which goes
    there once.
    """
    u = sets.join(pairs.select(F.col("u").alias("id"), "v"), "id").select(F.col("id").alias("u"), "v", F.col("shingles").alias("su"))
    v = sets.join(pairs.select(F.col("v").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    columns = ["u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"), F.size(F.array_intersect("su", "sv")).alias("common")]
    return u.join(v, "v").select(*columns, *([F.array_except("su", "sv").alias("extra"), F.array_except("sv", "su").alias("lacks")] if changes else []))


def similar(percent: int):
    """Whether compared sets have a Jaccard of ``percent``."""
    return 100 * F.col("common") >= percent * (F.col("nu") + F.col("nv") - F.col("common"))


def placed(rows: DataFrame, groups: DataFrame, name: str = "id", as_: str = "c") -> DataFrame:
    """``rows`` with the component of each class, its own id if it has no link yet."""
    found = groups.select(F.col("id").alias(name), F.col("component").alias("__c"))
    return rows.join(found, name, "left").withColumn(as_, F.coalesce("__c", name)).drop("__c")


def in_open(rows: DataFrame) -> DataFrame:
    """``rows(key, id, c, ..)`` under those keys whose classes are in more than one component."""
    mixed = gather(rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"))
    return rows.join(mixed, "key", "left_semi")


def stars_of(rows: DataFrame) -> DataFrame:
    """(key, star): the class under each key that meets others most."""
    return gather(rows.groupBy("key").agg(F.max(F.struct("fame", "id")).alias("star")))


def centred(stars: DataFrame) -> DataFrame:
    """(v, id, size, n, m, extra): what classes change of the text that they seem to be copies of.

    ``stars(u, v, nu, nv, common, extra, lacks)`` are compared pairs; v is the star
    that many u have in common. It is a copy itself, with changes of its own. So
    its set is amended: what more than half of the u add to it comes in, what more
    than half lack goes out. Of that set's n shingles the class lacks m; ``extra``
    are the shingles it has besides.
    """
    often = lambda name: (
        stars.select("v", F.explode(name).alias("s")).groupBy("v", "s").agg(F.count(F.lit(1)).alias("k"))
        .join(stars.groupBy("v").agg(F.count(F.lit(1)).alias("all")), "v").filter("2 * k > all AND all > 2")
        .groupBy("v").agg(F.collect_list("s").alias(f"often_{name}"))
    )
    none = F.array().cast("array<long>")
    x = stars.join(often("extra"), "v", "left").join(often("lacks"), "v", "left")
    come, go = F.coalesce("often_extra", none), F.coalesce("often_lacks", none)
    x = x.select("v", F.col("u").alias("id"), F.col("nu").alias("size"), (F.col("nv") - F.size(go) + F.size(come)).alias("n"), F.concat(F.array_except("extra", come), F.array_except(go, "lacks")).alias("extra"))
    return x.select("v", "id", "size", "n", (F.col("n") - F.col("size") + F.size("extra")).alias("m"), "extra")


def undecided(changes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs of classes with changes of the same text that may still be linked.

    ``changes`` are those of ``centred``. Two sets x and y with c changes in common,
    that is shingles that both lack or both add, share n - m_x - m_y + c. So with
    a Jaccard of P percent, P * (|x| + |y|) <= (100 + P) * (n - m_x - m_y + c),
    where c is at most the lesser of both m plus the number of additions in
    common. x needs P * |x| / 100 shingles of y and so at least as many additions in common
    with it as that exceeds n - m_x: all but one of these may be left out of the
    search, and the most common ones are. As c is at most m_y and the additions in common, x also
    needs (P * (|x| + |y|) / (100 + P)) - (n - m_x) of them, and |y| is at least the least size
    of those it can be paired with; a class with fewer additions that any other
    has too is left out before anything is joined. Without an addition in common, x and y
    share no more than x and the text do: then y must be smaller than the text if
    x isn't similar to that itself. Of two classes in different components one is not in
    the star's component; that is the x with which the search begins.
    """
    x = placed(placed(changes, groups), groups, "v", "cv").withColumn("apart", F.col("c") != F.col("cv")).drop("cv")
    # The least size of the classes that one can be paired with: one of the two is apart.
    sizes = x.groupBy("v").agg(F.min("size").alias("any"), F.min(F.when(F.col("apart"), F.col("size"))).alias("of_apart")).filter("of_apart IS NOT NULL")
    x = settle(x.join(gather(sizes), "v").withColumn("partner", F.when(F.col("apart"), F.col("any")).otherwise(F.col("of_apart"))).drop("any", "of_apart"))
    apart = x.filter("apart")
    second = lambda df, names: df.select("v", *(F.col(c).alias(f"{c}_") for c in names))
    # What both sides need beyond the changes in common: nothing if it is at most 0.
    need = percent * (F.col("size") + F.col("size_")) - (100 + percent) * (F.col("n") - F.col("m") - F.col("m_"))
    room = (100 + percent) * F.least("m", "m_")
    # What a class needs in additions in common, whoever it is paired with.
    needed = percent * (F.col("size") + F.col("partner")) - (100 + percent) * (F.col("n") - F.col("m"))
    other = F.col("c") != F.col("c_")
    numbers = ["id", "c", "size", "m"]
    near = percent * (F.col("size") + F.col("n")) <= (100 + percent) * (F.col("n") - F.col("m"))
    by_size = None
    for ours, theirs in ((apart.filter(~near), x.filter("size < n")), (apart.filter(near), x)):
        found = ours.filter(needed <= 0).select("v", "n", *numbers).join(second(theirs.filter(needed <= 0), numbers), "v").filter(other & (need <= room)).select("id", "id_")
        by_size = found if by_size is None else by_size.unionByName(found)
    by_size = by_size.select(F.greatest("id", "id_").alias("u"), F.least("id", "id_").alias("v"))
    least = F.greatest(F.lit(1), F.ceil(percent * F.col("size") / 100) - (F.col("n") - F.col("m")), F.ceil(needed / (100 + percent)))
    additions = x.select("v", "id", "c", "apart", least.alias("least"), F.explode("extra").alias("s"))
    # Where all that share an addition are in one component, there is nothing to decide.
    shared = additions.groupBy("v", "s").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("v", "s", "times")
    mine = Window.partitionBy("v", "id")
    ranked = additions.join(shared, ["v", "s"]).select("v", "id", "c", "apart", "s", (F.row_number().over(mine.orderBy("times", "s")) <= F.count(F.lit(1)).over(mine) - F.col("least") + 1).alias("searched"))
    searched = settle(ranked.filter("searched").select("v", "id", "c", "apart", "s"))
    theirs = searched.select(F.col("v").alias("v_"), F.col("s").alias("s_"), F.col("id").alias("id_"), F.col("c").alias("c_"))
    met_ = searched.filter("apart").join(theirs, (F.col("v") == F.col("v_")) & (F.col("s") == F.col("s_")) & (F.col("c") != F.col("c_"))).select("v", "id", "id_").distinct()
    sizes = x.select("v", "n", *numbers, "extra")
    both = met_.join(sizes, ["v", "id"]).join(second(x, [*numbers, "extra"]), ["v", "id_"]).filter(other & (need <= room + (100 + percent) * F.least(F.size("extra"), F.size("extra_"))))
    by_addition = both.filter(need <= room + (100 + percent) * F.size(F.array_intersect("extra", "extra_")))
    return by_size.unionByName(by_addition.select(F.greatest("id", "id_").alias("u"), F.least("id", "id_").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, keys: int = KEYS) -> DataFrame:
    """Links documents whose sets of five-word shingles have a Jaccard of ``percent``.

    Rows with equal sets form a class, named by its least id. Classes that meet in
    a table, that is share a left and a right key, are candidates.

    1. Each class is compared with a star: of the classes that meet most under the
       left keys it shares, the one that does so under most of them. That links
       most copies to the text that they are copies of.
    2. Tables are formed, by combining keys, of the classes whose left and right
       keys still hold several components. In every table entry that does, all are
       compared with its star.
    3. Two classes of an entry that aren't connected by now have both been compared
       with its star. What each lacks of it and adds to it decides which of those
       pairs can be similar at all (see ``undecided``); these are compared.

    So a large group of near copies costs a few comparisons each, also of those
    copies that nothing else is similar to, and every pair that meets in a table is
    connected, compared, or proven to be too far apart. Every link is confirmed on
    the whole sets. A pair at the threshold meets in no table with a probability of
    2 * (1 - 0.75 ** 3) ** 18 = 1e-4, at 0.8 with 5e-6.

    Returns doc_id, n_shingles, component_id (the least id reachable), kept (it is
    its own). Texts are lower-cased (A-Z); null, empty and wordless texts have
    empty sets and are linked with nothing. Rows with the same id and text are one
    document, of which each row is returned; rows without an id are left alone:
    their component is null and they are kept. Ids are taken to be integers; other
    columns play no part.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = settle(signatures(source.select("doc_id", word_hashes(lower_ascii(F.col("text"))).alias("words")), keys))
    named = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settle(named.groupBy("same").agg(F.min("doc_id").alias("id")))
    members = named.select("doc_id", "same").join(classes, "same").select("doc_id", "id")
    firsts = named.join(classes.select(F.col("id").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id", "same"])
    firsts = firsts.select(F.col("doc_id").alias("id"), "left", "right")
    left, right = settle(met(firsts, "left")), settle(met(firsts, "right"))
    meeting = gather(left.select("id").distinct().join(right.select("id").distinct(), "id", "left_semi"))

    # The sets of all classes that meet another one.
    texts = source.withColumnRenamed("doc_id", "id").join(meeting, "id", "left_semi").select("id", F.xxhash64("text").alias("k"), "text").dropDuplicates(["id", "k"])
    sets = settle(shingle_sets(texts.select("id", "text")))

    # How often a class meets others: the text that they are copies of does so most.
    fame = left.groupBy("id").agg(F.sum("n").alias("fame"))
    left = settle(left.join(fame, "id").select("key", "id", "fame"))
    asks = left.join(stars_of(left), "key").filter(F.col("id") != F.col("star.id")).groupBy("id", "star").agg(F.count(F.lit(1)).alias("times"))
    asks = asks.groupBy("id").agg(F.max(F.struct("times", "star")).alias("best"))
    asks = gather(asks.select(F.col("id").alias("u"), F.col("best.star.id").alias("v")))
    links = gather(compare(asks, sets).filter(similar(percent)).select("u", "v"))
    groups = gather(connected_components(links))

    sides = [in_open(placed(rows.select("key", "id"), groups)).groupBy("id").agg(F.collect_list("key").alias(name)) for rows, name in ((left, "left"), (right, "right"))]
    both = settle(placed(sides[0].join(sides[1], "id").join(fame, "id"), groups))
    tables = both.select("id", "c", "fame", F.explode("left").alias("l"), "right").select("id", "c", "fame", "l", F.explode("right").alias("r"))
    entries = settle(in_open(tables.select(F.xxhash64("l", "r").alias("key"), "id", "c", "fame")).select("key", "id", "fame"))
    asks = gather(entries.join(stars_of(entries), "key").select(F.col("id").alias("u"), F.col("star.id").alias("v")).filter("u <> v").distinct())
    stars = settle(compare(asks, sets, changes=True))
    links = links.unionByName(stars.filter(similar(percent)).select("u", "v"))
    changes = settle(centred(stars))
    # Who isn't linked with the star is compared with the copy that has the fewest changes as well.
    plain = changes.groupBy("v").agg(F.min(F.struct(F.col("m") + F.size("extra"), "id")).alias("plain")).select("v", F.col("plain.id").alias("plain"))
    asks = placed(placed(stars.filter(~similar(percent)).select("u", "v"), groups, "u", "c"), groups, "v", "cv").filter("c <> cv").join(plain, "v")
    asks = gather(asks.select("u", F.col("plain").alias("v")).filter("u <> v").distinct())
    links = links.unionByName(compare(asks, sets).filter(similar(percent)).select("u", "v"))
    groups = gather(connected_components(links))
    rest = gather(undecided(changes, groups, percent))
    more = gather(placed(placed(compare(rest, sets).filter(similar(percent)).select("u", "v"), groups, "u", "u_"), groups, "v", "v_").select(F.col("u_").alias("u"), F.col("v_").alias("v")))
    joined = connected_components(more).toDF("component", "__whole")
    groups = groups.join(joined, "component", "left").select("id", F.coalesce("__whole", "component").alias("component")).unionByName(joined.toDF("id", "component")).groupBy("id").agg(F.min("component").alias("component"))

    found = members.join(groups, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of its least id.

    Of rows that repeat both id and text one stays; rows without an id all stay, as
    do those whose texts are null or have no words. Columns stay as they are.
    """
    dropped = gather(near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias("__id")).distinct())
    left = docs.join(dropped, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")
    named = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__k"))
    repeated = gather(named.groupBy("__id", "__k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__id").distinct())
    again = F.col("doc_id") == F.col("__id")
    one = left.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, again, "left_anti").unionByName(one)
