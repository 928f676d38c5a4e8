"""Near-duplicate documents by a signature-coordinate inverted join.

Every document becomes its set of word shingles, and the set a signature of ``COORDINATES`` minima. Documents
with equal sets form a class, and only classes are compared. A class is posted under its (coordinate, value) pairs.
Sets at the asked similarity collide in at least ``least_matches`` coordinates, but for one pair in a million at
the very threshold; so a class has to be posted only under its rarest pairs (prefix), and classes whose pairs
mostly occur once are skipped without merging. Postings of one pair name candidates; their collisions are counted
on whole signatures, and those that reach the match threshold are confirmed on whole sets.

Links are wanted for their components. A posting list of m classes is therefore not turned into m * m pairs:
all members are compared with one hub, the class with the most common signature, round after round while long lists
gain links by it; lists whose members are connected by then are finished. For the members of the others the shingles
that occur in one component only are counted: a link to another component shares none of them, which bounds its
similarity. Members that the bound parts from all of their list leave it. Lists that share members are one group by
now; a group is dealt into blocks of bounded size, and a task compares the signatures of two blocks, confirms on whole
sets, and keeps one link for each two components that it joins: no pair of classes is a row. No list is cut, so no link
between components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import as_table, small_batches
from .words import Words, mix, pieces, released

COORDINATES = 64
#: A pair of sets at the threshold is missed with at most this probability.
MISS = 1e-6
#: Ids of candidate classes are broadcast up to this many rows (16 MB); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Lists of more classes than this are compared with one hub after the other while that links any.
HUB_LIST = 4096
#: Classes, and shingles on average, of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 2_000_000

_SEEDS = np.random.default_rng(97).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(similarity: float, coordinates: int = COORDINATES) -> int:
    """The largest number of collisions that sets of this similarity reach but with probability MISS."""
    tail, t = 0.0, 0
    while True:
        tail += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if tail > MISS:
            return t
        t += 1


def shingle_sets(body: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted in the row, and the offsets of the rows."""
    words = Words(body, rows, lower=True)
    h = words.hashes()
    key = words.windows(h, k)
    take = words.whole(k)
    for n in range(1, k):  # fewer words than a shingle has: the whole sequence
        at = words.first[:-1][words.count == n]
        key[at] = mix(words.windows(h, n)[at] + np.uint64(n))
        take[at] = True
    key, row = key[take], words.row[take]
    order = np.argsort(key)
    if len(rows) <= 1 << 16:
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # a radix sort
    else:
        order = order[np.argsort(row[order], kind="stable")]
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(len(rows)))


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.list_(pa.int32()))])


def _sign(k: int):
    def signed(batches):
        for batch in released(batches):
            ids = batch.column(0)
            for first, end, body, rows in pieces(batch.column(1)):
                key, at = shingle_sets(body, rows, k)
                n = np.diff(at)
                some = np.flatnonzero(n)
                start = at[:-1][some]
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig = np.zeros((len(some), COORDINATES), np.uint32)
                if len(some):
                    d1[some] = np.add.reduceat(mix(key), start)
                    d2[some] = np.bitwise_xor.reduceat(mix(key ^ np.uint64(0xA0761D6478BD642F)), start)
                    for i, seed in enumerate(_SEEDS):
                        sig[:, i] = np.minimum.reduceat(key * seed, start) >> np.uint64(32)
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, COORDINATES, 0), out=offsets[1:])
                yield pa.record_batch(
                    [ids.slice(first, end - first).cast(pa.int64()), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.reshape(-1).view(np.int32)))],
                    schema=_SIGNED_ARROW,
                )

    return signed


def _sets(k: int):
    def sets(batches):
        for batch in released(batches):
            ids = batch.column(0)
            for first, end, body, rows in pieces(batch.column(1)):
                key, at = shingle_sets(body, rows, k)
                yield pa.record_batch([ids.slice(first, end - first), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)))], names=["rep", "hashes"])

    return sets


def _colliding(least: int):
    def colliding(batches):
        for batch in released(batches):
            x, y = (batch.column(c).flatten().to_numpy().reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return colliding


def _confirmed(num: int, den: int):
    def confirmed(batches):
        for batch in released(batches):
            good = []
            sides = [(c.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(c.value_lengths().to_numpy())]) for c in (batch.column("set_a"), batch.column("set_b"))]
            (u, i), (v, j) = sides
            for r in range(batch.num_rows):
                x, y = u[i[r] : i[r + 1]], v[j[r] : j[r + 1]]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirmed


def _unfinished(lists: DataFrame) -> DataFrame:
    """Members of lists that hold several components."""
    open_ = lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return lists.join(open_.where("lo < hi").select("token"), "token", "left_semi")


def _each(batches):
    for batch in released(batches):
        sizes = batch.column("hashes").value_lengths().to_numpy()
        yield pa.record_batch(
            [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("rep", "comp")] + [batch.column("hashes").flatten()],
            names=["rep", "comp", "s"],
        )


def _common_sizes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """For each member (rep, comp): n, the size of its set, and common, how many of its shingles another component has."""
    each = members.join(sets, "rep").select("rep", "comp", "hashes").mapInArrow(_each, "rep long, comp long, s long")
    met = each.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).select("s", (F.col("lo") < F.col("hi")).alias("met"))
    return each.join(met, "s").groupBy("rep").agg(F.count("*").alias("n"), F.count_if("met").alias("common"))


def linked(rep: np.ndarray, comp: np.ndarray, sig: np.ndarray, start: np.ndarray, shingles: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and ``right`` that join two components: enough collisions, and confirmed on whole sets.

    Row r has the sorted distinct shingles[start[r]:start[r + 1]]. A link is left out where earlier ones join its
    components already, so there are fewer links than components.
    """
    size = np.diff(start)
    number = np.unique(shingles, return_inverse=True)[1]
    mark = np.zeros(len(shingles), bool)
    label, found = comp.copy(), []
    for x in left:
        y = right[(label[right] != label[x]) & (den * np.minimum(size[right], size[x]) >= num * np.maximum(size[right], size[x]))]
        y = y[(sig[y] == sig[x]).sum(1) >= least]
        if not len(y):
            continue
        own = number[start[x] : start[x + 1]]
        mark[own] = True
        if len(y) > 16:
            both = np.add.reduceat(mark[number], start[:-1], dtype=np.int64)[y]
        else:
            both = np.array([np.count_nonzero(mark[number[start[r] : start[r + 1]]]) for r in y])
        mark[own] = False
        for r in y[den * both >= num * (size[x] + size[y] - both)]:
            if label[r] != label[x]:
                found.append((int(rep[x]), int(rep[r])))
                label[label == label[r]] = label[x]
    return found


def _compare(least: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table):
        table = table.combine_chunks().sort_by([("group", "ascending"), ("rep", "ascending")])
        group, rep, comp, block = (table.column(c).to_numpy() for c in ("group", "rep", "comp", "block"))
        first = table.column("i")[0].as_py() if table.num_rows else 0
        last = table.column("j")[0].as_py() if table.num_rows else 0
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        sets = table.column("hashes").combine_chunks()
        at = np.r_[0, np.cumsum(sets.value_lengths().to_numpy())]
        shingles = sets.flatten().to_numpy()
        edge = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)] if len(group) else np.zeros(1, int)
        found = []
        for a, b in zip(edge[:-1], edge[1:]):
            rows, one = np.arange(b - a), block[a:b]
            left, right = (rows, rows) if first == last else (rows[one == first], rows[one == last])
            found += linked(rep[a:b], comp[a:b], sig[a:b], at[a : b + 1] - at[a], shingles[at[a] : at[b]], left, right, least, num, den)
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    return compare


def _within_groups(lists: DataFrame, sets: DataFrame, sizes: DataFrame, classes: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the components of lists (token, rep, comp) that share members."""
    star = lists.groupBy("token").agg(F.min("rep").alias("b"))
    groups = components(lists.join(star, "token").select(F.col("rep").alias("a"), "b")).select(F.col("node").alias("rep"), F.col("label").alias("group"))
    members = as_table(lists.select("rep", "comp").distinct().join(groups, "rep").join(sizes.select("rep", "n"), "rep"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    members = members.join(members.groupBy("group").agg(blocks.alias("blocks")), "group")
    load = members.agg(F.count("*").alias("m"), F.sum("n").alias("n")).first()
    buckets = load["m"] // BLOCK_ROWS + (load["n"] or 0) // BLOCK_SHINGLES + 1
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.select("group", "rep", "comp", "blocks", block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lone = F.col("blocks") == 1  # groups of one block share tasks
    home = F.when(lone, F.pmod(F.xxhash64("group"), F.lit(buckets))).otherwise(F.col("group"))
    dealt = dealt.select("group", "rep", "comp", "block", lone.alias("lone"), home.alias("home"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = dealt.join(classes.select("rep", "sig"), "rep").join(sets, "rep")
    return rows.groupBy("lone", "home", "i", "j").applyInArrow(_compare(least, num, den), "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    return as_table(components(links).select(F.col("node").alias("rep"), F.col("label").alias("comp")), "known")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose shingle sets have den * |both| >= num * |either|.

    Words are maximal runs outside space, tab and line breaks, A-Z in lower case; a shingle is ``words`` consecutive
    words, or all words of a shorter text. Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links, itself included) and kept (doc_id = component_id). Null and empty texts
    have no shingle and no link. Rows without doc_id are left out; repeated rows come back as often. Other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    least = least_matches(num / den)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = as_table(source.mapInArrow(_sign(words), _SIGNED), "signed")
    same = ["n_shingles", "d1", "d2"]
    classes = as_table(signed.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")), "classes")

    # Postings: of each class the rarest coordinate-value pairs that reach into every set of `least` collisions.
    pairs = classes.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", (F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("token"))
    often = pairs.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = pairs.join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ts"), F.sum("n").alias("score")).where(F.size("ts") >= least)
    prefix = F.transform(F.slice("ts", F.lit(1), F.size("ts") - (least - 1)), lambda t: t["token"])
    wide = as_table(shared.select("rep", "score", prefix.alias("prefix")), "prefixes")
    lists = as_table(wide.select("rep", "score", F.explode("prefix").alias("token")).join(classes.select("rep", "n_shingles"), "rep").withColumnRenamed("n_shingles", "n"), "postings")

    chosen = F.broadcast(wide.select("rep")) if wide.count() <= BROADCAST_ROWS else wide.select("rep")
    sets = as_table(source.withColumnRenamed("doc_id", "rep").join(chosen, "rep").dropDuplicates(["rep"]).select("rep", "text").mapInArrow(_sets(words), "rep long, hashes array<long>"), "sets")

    links = known = None  # known: (rep, comp) of the classes that have links
    tried = lists.select("token", "rep").limit(0)  # the hubs of all rounds
    while True:
        here = lists.withColumn("comp", F.col("rep")) if known is None else lists.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        here = as_table(_unfinished(here), "lists")
        longest = here.groupBy("token").count().agg(F.max("count")).first()[0]
        if longest is None or links is not None and (longest <= HUB_LIST or not gained):
            break
        central = F.struct((-F.col("score")).alias("score"), "rep", "comp", "n")
        hub = here.join(tried, ["token", "rep"], "left_anti").groupBy("token").agg(F.min(central).alias("hub"))
        hub = as_table(hub.select("token", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("rep", "comp", "n")]), "hubs")
        met = here.join(hub, "token").where(f"hub_comp <> comp and {den} * least(n, hub_n) >= {num} * greatest(n, hub_n)")
        pairs = met.select(F.least("rep", "hub_rep").alias("a"), F.greatest("rep", "hub_rep").alias("b")).distinct()
        of = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_colliding(least), "a long, b long")
        whole = lambda x: sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"set_{x}"))
        new = as_table(pairs.join(whole("a"), "a").join(whole("b"), "b").mapInArrow(_confirmed(num, den), "a long, b long"), "links")
        gained = not new.isEmpty()
        links = new if links is None else links.unionByName(new)
        tried = tried.unionByName(hub.select("token", F.col("hub_rep").alias("rep")))
        if gained:
            known = _labels(links)

    if longest is not None:
        sizes = as_table(_common_sizes(here.select("rep", "comp").distinct(), sets), "sizes")
        here = as_table(here.drop("n").join(sizes, "rep"), "lists")
        # No more shared shingles than a class has outside its component.
        may = f"{den} * common >= {num} * (n + greatest(least_n, common) - common)"
        here = here.join(here.groupBy("token").agg(F.min("n").alias("least_n")), "token").where(may)
        here = as_table(_unfinished(here), "lists")
        if not here.isEmpty():
            new = as_table(_within_groups(here, sets, sizes, classes, least, num, den), "links")
            if not new.isEmpty():
                known = _labels(links.unionByName(new))

    keyed = classes.select("rep", *same)
    if known is not None:
        smallest = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
        keyed = keyed.join(known.join(smallest, "comp").select("rep", "component_id"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    else:
        keyed = keyed.withColumn("component_id", F.col("rep"))
    out = signed.drop("sig").join(keyed, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
